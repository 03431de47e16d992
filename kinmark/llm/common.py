"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest table that is broadcast; its size is measured before.
BROADCAST_BYTES = 16 << 20


def wide_hash(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a row of values; a null differs from every value."""
    parts: list[Column] = []
    for c in cols:
        parts += [c, c.isNull()]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(-7_046_029_254_386_353_131), *parts)


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Counts at most one row beyond the bound."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


#: Rows of one key from which a join spreads them over several tasks.
HOT_ROWS = 200_000


def split_join(many: DataFrame, few: DataFrame, keys: list[str], heavy: DataFrame, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``many`` joined with ``few`` where a key may have any number of rows in ``many``.

    ``heavy`` (keys, n) has the number of rows of each key in ``many``, or of the larger ones. Keys of more than ``hot_rows`` rows are salted: their rows
    spread over n / hot_rows partitions, and their few rows on the other side are copied to each. The result is that of a plain join.
    """
    hot = heavy.where(F.col("n") > hot_rows).select(*keys, F.ceil(F.col("n") / F.lit(hot_rows)).cast("int").alias("_many"))
    if hot.isEmpty():
        return many.join(few, keys, how)
    if fits_broadcast(hot, 160):  # one row per hot_rows rows
        hot = F.broadcast(hot)
    one = F.coalesce("_many", F.lit(1))
    salt = F.pmod(F.xxhash64(*[c for c in many.columns if c not in keys]), one).cast("int")
    left = many.join(hot, keys, "left").withColumn("_salt", salt).drop("_many")
    right = few.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_many")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def whole_groups(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``keys``; a group never falls into two tables."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        n = batch.num_rows
        if not n:
            continue
        same = np.ones(n, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            same &= v == v[-1]
        at = n - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last group starts
        if held and (at or any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys)):
            joins = all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys)
            if not joins:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
        if at:
            yield pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks()
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def edges_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a sorted table start, and its end."""
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for k in keys:
        v = table[k].to_numpy()
        new |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]]).astype(np.int64)


def pairs_within(edges: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of rows of the same group, about ``most`` pairs at a time; groups must be of bounded size."""
    end = np.repeat(edges[1:], np.diff(edges))
    rest = end - np.arange(len(end)) - 1  # partners after each row
    total = np.cumsum(rest)
    lo = 0
    while lo < len(rest):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        n = rest[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        lo = hi


def element_key(e: Column) -> Column:
    """64-bit hash of a whole element; nulls in its fields are kept apart from values."""
    return F.xxhash64(
        F.coalesce(e["kind"], F.lit("\x00")),
        F.coalesce(e["s"], F.lit("\x00")),
        F.coalesce(e["i"], F.lit(-1)),
        e["i"].isNull(),
        F.coalesce(e["n"], F.lit(-1)),
        e["n"].isNull(),
        F.coalesce(F.array_join(e["gram"], "\x01", "\x02"), F.lit("\x00")),
    )


def batches(rows: Iterable, size: int):
    """Lists of at most ``size`` rows."""
    part: list = []
    for r in rows:
        part.append(r)
        if len(part) >= size:
            yield part
            part = []
    if part:
        yield part
