"""Filling fixed-capacity containers, by a linear grouping scheme.

Lengths are whole numbers of at most the capacity, so everything that the plan needs is the number of items of each
length: at most ``capacity`` rows, gathered on the driver whatever the number of items. There:

1. items longer than a share of the capacity are *large*; in descending order they form groups of equal cardinality,
   and each is rounded up to the longest of its group, which leaves few sizes;
2. the best configurations of these few sizes come from the configuration linear program, solved by column generation
   (the pricing problem is a knapsack over the capacity); whole multiples are used, the few items left over are placed
   best-fit;
3. actual items take the slots of their group in order of length, so a slot's true length is known for whole runs of
   containers, and so is the room that is left;
4. small items go best-fit into the left room, run by run, and into new containers after that.

The plan is a list of *runs* ("the items of length L with ranks r to r+n go to containers c, c+1, ... at offset o"),
whose number depends on the capacity and not on the items. Items get their rank among those of equal length from
counts per (length, bucket), never from one sort of a whole length, and look up their run by a broadcast join.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import common

#: Items above this share of the capacity are large; number of groups of equal cardinality.
LARGE_SHARE, GROUPS = 0.125, 48
#: Items of one length that one task ranks.
BUCKET_ROWS = 1 << 16
_RUN_BYTES = 128


@dataclass
class Run:
    """Items of ``size`` with ranks from ``first``: ``per`` to each of ``n`` containers from ``base`` on, from ``at`` on."""

    size: int
    first: int
    n: int
    per: int
    base: int
    at: int
    count: int


def _best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack: how many of each size give the most worth within the capacity."""
    layers = [np.zeros(capacity + 1)]
    for s, w in zip(sizes, worth):
        f = layers[-1].copy()
        if w > 0:
            for _ in range(capacity // s):
                f[s:] = np.maximum(f[s:], f[:-s] + w)
        layers.append(f)
    out, c = np.zeros(len(sizes)), capacity
    for j in range(len(sizes) - 1, -1, -1):
        while c >= sizes[j] and layers[j + 1][c] > layers[j][c] + 1e-12:
            out[j] += 1
            c -= sizes[j]
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, most_steps: int = 2000) -> list[tuple[np.ndarray, float]]:
    """The configuration program's solution as (items of each size, containers); revised simplex on generated columns."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    d = np.array(demand, float)
    for _ in range(most_steps):
        price = np.linalg.solve(basis.T, np.ones(k))
        column = _best_configuration(sizes, price, capacity)
        if price @ column <= 1 + 1e-7:
            break
        x, move = np.linalg.solve(basis, d), np.linalg.solve(basis, column)
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, d)
    return [(basis[:, i].round().astype(int), float(v)) for i, v in enumerate(x) if v > 1e-9]


class _Slots:
    """Hands out the items of one group in descending order of length, as (size, rank, count) stretches."""

    def __init__(self, stretches: list[tuple[int, int, int]]):
        self.rest = list(reversed(stretches))

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n and self.rest:
            size, rank, count = self.rest.pop()
            m = min(n, count)
            out.append((size, rank, m))
            if m < count:
                self.rest.append((size, rank + m, count - m))
            n -= m
        return out


def plan(histogram: dict[int, int], capacity: int, large_share: float = LARGE_SHARE, groups: int = GROUPS) -> list[Run]:
    """Runs that place every item of the histogram {length: items}; lengths from 1 to ``capacity``."""
    runs: list[Run] = []
    room: list[tuple[int, int, int]] = []  # (room left, first container, containers), kept in order
    used = 0

    def leave(left: int, base: int, n: int) -> None:
        if left and n:
            bisect.insort(room, (left, base, n))

    large = sorted((s for s in histogram if s > capacity * large_share and histogram[s]), reverse=True)
    total = sum(histogram[s] for s in large)
    if total:
        cuts = [total * g // groups for g in range(1, groups + 1)]
        stretches: dict[int, list[tuple[int, int, int]]] = {}
        at, g, top = 0, 0, None
        for s in large:
            rank, left = 0, histogram[s]
            while left:
                while cuts[g] <= at:
                    g, top = g + 1, None
                top = top or s
                m = min(left, cuts[g] - at)
                stretches.setdefault(top, []).append((s, rank, m))
                rank, left, at = rank + m, left - m, at + m
        sizes = list(stretches)
        demand = [sum(n for _, _, n in stretches[s]) for s in sizes]
        slots = [_Slots(stretches[s]) for s in sizes]
        missing = list(demand)

        def fill(config: np.ndarray, n: int) -> None:
            """n containers of one configuration; some slots may stay empty when a group runs out."""
            nonlocal used
            cuts_at, columns = {0, n}, []
            for j, a in enumerate(config):
                for _ in range(int(a)):
                    got = slots[j].take(n)
                    missing[j] -= sum(c for _, _, c in got)
                    column, i = [], 0
                    for size, rank, count in got:
                        column.append((i, i + count, size, rank))
                        i += count
                        cuts_at.add(i)
                    columns.append(column)
            edges = sorted(cuts_at)
            for lo, hi in zip(edges, edges[1:]):
                offset = 0
                for column in columns:
                    for b, e, size, rank in column:
                        if b <= lo < e:
                            runs.append(Run(size, rank + lo - b, hi - lo, 1, used + lo, offset, hi - lo))
                            offset += size
                leave(capacity - offset, used + lo, hi - lo)
            used += n

        for config, x in configurations(sizes, demand, capacity):
            n = int(math.floor(x + 1e-7))
            if n:
                fill(config, n)
        # what rounding down left over: at most a few configurations' worth of items, placed best-fit one by one
        for j in range(len(sizes)):
            for size, rank, count in slots[j].take(missing[j]):
                used = _best_fit(runs, room, size, rank, count, capacity, used)
    for s in sorted((s for s in histogram if s <= capacity * large_share and histogram[s]), reverse=True):
        used = _best_fit(runs, room, s, 0, histogram[s], capacity, used)
    return runs


def _best_fit(runs: list[Run], room: list, size: int, rank: int, count: int, capacity: int, used: int) -> int:
    """Places equal items into the tightest rooms that hold them, many containers at a time."""
    while count:
        i = bisect.bisect_left(room, (size, -1, -1))
        if i < len(room):
            left, base, n = room.pop(i)
        else:
            left, base, n = capacity, used, -(-count // (capacity // size))
            used += n
        per = left // size
        full = min(n, count // per)
        at = capacity - left
        if full:
            runs.append(Run(size, rank, full, per, base, at, full * per))
            rank, count = rank + full * per, count - full * per
            if left - per * size:
                bisect.insort(room, (left - per * size, base, full))
        if full < n and count:  # the last few go into one more container of this room
            runs.append(Run(size, rank, 1, count, base + full, at, count))
            if left - count * size:
                bisect.insort(room, (left - count * size, base + full, 1))
            full, rank, count = full + 1, rank + count, 0
        if full < n:
            bisect.insort(room, (left, base + full, n - full))
    return used


def fill_containers(df: DataFrame, key: Column, size: Column, capacity: int) -> DataFrame:
    """(key, piece INT, size BIGINT, container BIGINT, start BIGINT): where each item, or piece of it, lies.

    An item longer than ``capacity`` is split into pieces of ``capacity`` and a rest, numbered from 0; no other item is
    split. Pieces in a container don't overlap and end within the capacity. Items of size 0, and of null or negative
    size, which count as 0, need no room: they lie at the start of container 0. Repeated rows are items of their own;
    null keys are keys. An empty input gives an empty result. Containers are numbered from 0 without gaps.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    items = df.select(key.alias("key"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("whole"))
    last = F.greatest(F.ceil(F.col("whole") / capacity).cast("int") - 1, F.lit(0))
    pieces = items.select("key", "whole", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "key", "piece", F.least(F.col("whole") - F.col("piece") * F.lit(capacity), F.lit(capacity)).cast("long").alias("size")
    )
    pieces = scratch.write(pieces)
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}
    empty = pieces.where("size = 0").select("key", "piece", "size", F.lit(0).cast("long").alias("container"), F.lit(0).cast("long").alias("start"))
    histogram.pop(0, None)
    runs = plan(histogram, capacity)
    if not runs:
        return empty
    buckets = max(1, sum(histogram.values()) // BUCKET_ROWS)
    real = pieces.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)))
    before = real.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = before.withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inner = Window.partitionBy("size", "bucket").orderBy("key", "piece")
    ranked = real.withColumn("r", F.row_number().over(inner) - 1)
    ranked = ranked.join(before.drop("n"), ["size", "bucket"]).withColumn("rank", F.col("before") + F.col("r"))
    table = spark.createDataFrame(
        [(r.size, r.first, r.first + r.count, r.per, r.base, r.at) for r in runs],
        "run_size long, run_first long, run_end long, per long, base long, at long",
    )
    if len(runs) * _RUN_BYTES <= common.BROADCAST_BYTES:
        table = F.broadcast(table)
    hit = (F.col("size") == F.col("run_size")) & (F.col("rank") >= F.col("run_first")) & (F.col("rank") < F.col("run_end"))
    step = F.col("rank") - F.col("run_first")
    placed = ranked.join(table, hit).select(
        "key",
        "piece",
        "size",
        (F.col("base") + F.floor(step / F.col("per"))).cast("long").alias("container"),
        (F.col("at") + F.pmod(step, F.col("per")) * F.col("size")).cast("long").alias("start"),
    )
    return placed.unionByName(empty)
