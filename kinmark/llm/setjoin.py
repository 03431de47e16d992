"""All similar pairs of set-valued records, by recursive chosen-path splitting.

Sets of equal content are one class. All sets start in the root of each tree. A node with more than ``node_most`` sets branches: it
draws a random order of all tokens, each set *chooses* the first ``choices`` of its tokens that are not yet on the path by that order,
and goes to the child node of each. Small nodes are compared by brute force, and what is found is verified on the values themselves;
hence every pair that is found is right, and each comes out once.

*Recall.* With n tokens of which any similar partner shares at least t, a set that chooses its first n - t + 1 tokens shares one
with every such partner, whatever the order is. Sets that need no more than ``choices`` for that never lose a partner. Of larger
sets a tree loses a pair at a level only if all choices of one set are missing in the other, at most ``(1 - similarity) ** choices``.
Trees are repeated, for these sets alone, until the losses of all trees together stay below 1 - ``recall``.

A path of t tokens leaves nothing to choose, so depth is limited; nodes that are still large there (all their sets share
t tokens) are compared in blocks. Large nodes are few (their number is at most rows / ``node_most``) and are told to
the rows by a broadcast of checked size, so a token that a third of all sets hold never gathers in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import common
from .classes import Classes

NODE_MOST, CHOICES, RECALL = 256, 6, 0.999999
_KEYS = ["node", "bi", "bj"]
_FEW = 12


def _least_overlap(n: Column, similarity: float) -> Column:
    return F.ceil(n * F.lit(similarity) - 1e-9).cast("int")


def _brute_force(similarity: float):
    """All pairs of a node's sets that reach the similarity; between two blocks where a node has several."""

    def pairs_of(lo: int, hi: int, size: np.ndarray, blk: np.ndarray, flat: np.ndarray, off: np.ndarray, split: bool) -> tuple[list[int], list[int]]:
        a, b = [], []
        m = hi - lo
        if m <= _FEW:
            sets = [set(flat[off[i] : off[i + 1]].tolist()) for i in range(lo, hi)]
            for i in range(m):
                x, nx = sets[i], len(sets[i])
                for j in range(i + 1, m):
                    if split and blk[lo + i] == blk[lo + j]:
                        continue
                    ny = len(sets[j])
                    if min(nx, ny) < similarity * max(nx, ny) - 1e-9:
                        continue
                    both = len(x & sets[j])
                    if both / (nx + ny - both) >= similarity:
                        a.append(lo + i)
                        b.append(lo + j)
            return a, b
        _, col = np.unique(flat[off[lo] : off[hi]], return_inverse=True)
        held = np.zeros((m, int(col.max()) + 1), np.float32)
        held[np.repeat(np.arange(m), size[lo:hi]), col] = 1
        n = size[lo:hi]
        both = held @ held.T
        good = both / (n[:, None] + n[None, :] - both) >= similarity
        if split:
            good &= blk[lo:hi, None] != blk[None, lo:hi]
        i, j = np.nonzero(np.triu(good, 1))
        return (i + lo).tolist(), (j + lo).tolist()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.whole_groups(it, _KEYS):
            blk, cls, bi, bj = (t[c].to_numpy() for c in ("blk", "cls", "bi", "bj"))
            lists = t["tokens"].combine_chunks()
            flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            off = np.concatenate([[0], np.cumsum(size)])
            edges = common.edges_of(t, _KEYS)
            a: list[int] = []
            b: list[int] = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if hi - lo > 1:
                    x, y = pairs_of(lo, hi, size, blk, flat, off, bool(bi[lo] != bj[lo]))
                    a += x
                    b += y
            x, y = cls[np.array(a, np.int64)], cls[np.array(b, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def trees_for(similarity: float, choices: int, depth: int, recall: float) -> int:
    """Trees after which a pair is lost with a probability of at most 1 - ``recall``."""
    lost = 1 - (1 - (1 - similarity) ** choices) ** depth
    return 1 if lost <= 0 else max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def similar_sets(
    df: DataFrame,
    record: Column,
    group: Column,
    values: Column,
    similarity: float = 0.7,
    least: int = 5,
    choices: int = CHOICES,
    recall: float = RECALL,
    node_most: int = NODE_MOST,
) -> Classes:
    """Records of one group whose sets have ``|both| / |either| >= similarity``, as classes of equal sets and links between classes.

    ``Classes.pairs`` are the pairs of records (a BIGINT, b BIGINT), a < b, ``Classes.rows`` a row per record.

    ``values`` is an array of strings; order and repetition play no part, null values are no values. Sets of fewer than
    ``least`` values take no part, nor do rows with a null id, group or array. A record delivered more than once counts
    once. For two tables, join them with a union and keep
    pairs across. An empty input gives an empty result. Columns of ``df`` beyond those passed play no part.
    """
    if not 0 < similarity <= 1 or least < 1 or choices < 1 or not 0 <= recall < 1:
        raise ValueError("similarity must be in (0, 1], least and choices at least 1 and recall in [0, 1)")
    scratch = Scratch(df.sparkSession, "setjoin")
    rows = df.select(record.cast("long").alias("record"), group.cast("string").alias("grp"), values.alias("v"))
    rows = rows.where(F.col("record").isNotNull() & F.col("grp").isNotNull() & (F.size("v") >= least))
    rows = rows.select("record", "grp", F.array_sort(F.array_distinct(F.array_compact("v"))).alias("names")).where(F.size("names") >= least)
    s1, s2 = common.wide_hash(F.col("grp"), F.col("names"))
    rows = scratch.write(rows.withColumns({"s1": s1, "s2": s2}))
    classes = Classes.of(scratch, rows.select("record", "s1", "s2"))
    sets = rows.groupBy("s1", "s2").agg(F.min("record").alias("cls"), F.first("grp").alias("grp"), F.first("names").alias("names"))
    token = F.array_sort(F.transform("names", lambda x: F.xxhash64(F.col("grp"), x)))
    sets = scratch.write(sets.select("cls", "grp", "names", token.alias("tokens")))

    depth_most = max(1, math.ceil(similarity * least - 1e-9))
    trees = trees_for(similarity, choices, depth_most, recall)
    sure = next(n for n in range(1, 1 << 20) if n - math.ceil(n * similarity - 1e-9) + 1 > choices) if similarity < 1 else 1 << 20  # the least set that may lose a partner
    one = F.lit(1).cast("long")
    root = F.explode(F.when(F.size("tokens") >= similarity * sure, F.sequence(one, F.lit(trees).cast("long"))).otherwise(F.array(one)))
    level = sets.select("cls", "tokens", root.alias("node"), F.array().cast("array<long>").alias("path"))
    leaves: list[DataFrame] = []
    if sets.limit(node_most + 1).count() <= node_most:
        leaves.append(_whole(level.where("node = 1")))
        depth_most = 0
    for depth in range(1, depth_most + 1):
        older, level = level, scratch.write(_branch(level, similarity, choices))
        if depth > 1:
            scratch.drop(older)
        sizes = scratch.write(level.groupBy("node").agg(F.count("*").alias("m")).where("m > 1"))  # a set that is alone meets nobody
        leaves.append(_whole(level.join(_told(sizes.where(F.col("m") <= node_most).select("node")), "node", "left_semi")))
        large = sizes.where(F.col("m") > node_most)
        if large.isEmpty():
            break
        level = level.join(_told(large), "node")
        if depth == depth_most:
            leaves.append(_blocks(level, node_most))
        else:
            level = scratch.write(level.drop("m"))
    cells = leaves[0]
    for other in leaves[1:]:
        cells = cells.unionByName(other)
    cells = cells.repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    met = scratch.write(cells.mapInArrow(_brute_force(similarity), "a long, b long").distinct())
    for x in "ab":  # tokens are hashes: what counts are the values
        met = met.join(sets.select(F.col("cls").alias(x), F.col("grp").alias(f"g{x}"), F.col("names").alias(f"n{x}")), x)
    both = F.size(F.array_intersect("na", "nb"))
    good = (F.col("ga") == F.col("gb")) & (both / (F.size("na") + F.size("nb") - both) >= similarity)
    classes.links = scratch.write(met.where(good).select("a", "b"))
    return classes


def _told(nodes: DataFrame) -> DataFrame:
    """Nodes as a broadcast, if they are few enough."""
    return F.broadcast(nodes) if common.fits_broadcast(nodes, 96) else nodes


def _branch(level: DataFrame, similarity: float, choices: int) -> DataFrame:
    """Each set to the children of the tokens that it chooses by its node's random order."""
    n = F.size("tokens")
    count = F.least(n - _least_overlap(n, similarity) + 1, F.lit(choices))
    rest = F.filter("tokens", lambda t: ~F.array_contains("path", t))
    order = F.array_sort(F.transform(rest, lambda t: F.struct(F.xxhash64(F.col("node"), t).alias("r"), t.alias("t"))))
    chosen = level.select("path", "cls", "tokens", F.explode(F.slice(order, F.lit(1), count)).alias("c"))
    return chosen.select("cls", "tokens", F.col("c.r").alias("node"), F.concat("path", F.array("c.t")).alias("path"))


def _whole(level: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("int")
    return level.select("node", zero.alias("bi"), zero.alias("bj"), zero.alias("blk"), "cls", "tokens")


def _blocks(large: DataFrame, node_most: int) -> DataFrame:
    """A large node as pairs of blocks: each set goes to the cells of its block with every block."""
    many = F.ceil(F.col("m") / F.lit(node_most)).cast("int")
    own = F.pmod(F.xxhash64("cls"), many).cast("int")
    each = large.withColumns({"blk": own, "other": F.explode(F.sequence(F.lit(0), many - 1))})
    return each.select("node", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "cls", "tokens")
