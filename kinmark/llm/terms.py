"""Frequency of every term, from a vertical layout of compressed record bitmaps.

Each term has, per container of 65,536 consecutive record ids, the set of records that hold it: a sorted list of 16-bit
positions while that is smaller, a bitmap of 8 KB beyond. Beside it stands an occurrence counter: what a record has beyond one occurrence, for the
records that have more. Map tasks build partial containers of what they read, so elements never travel; containers of one term
merge by union, in which a record that was delivered to several tasks counts once, and the document frequency is the sum of their cardinalities. A
term that stands in every record costs
8 KB per 65,536 records; its containers merge in parallel, and only (term, count) pairs meet at the end.

Ids may be any numbers. Where they are sparse, with few records to 65,536 consecutive ids, containers are small and many: at
worst one per record and term, as in a plain list of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import common

#: Positions beyond which the bitmap is the smaller container.
SPARSE_MOST = 4096
#: Pairs of record and term that a task turns into containers at once.
FLUSH = 1 << 21

_PARTS = "grp string, term string, container long, bits binary, more binary"
_MERGED = "grp string, term string, occ long, docs long"
_SCHEMA = pa.schema([("grp", pa.string()), ("term", pa.string()), ("container", pa.int64()), ("bits", pa.binary()), ("more", pa.binary())])
_MORE = np.dtype([("at", "<u2"), ("n", "<i8")])  # a position and its occurrences, where they are not one


def pack(positions: np.ndarray) -> bytes:
    """Sorted unique 16-bit positions to a container."""
    if len(positions) <= SPARSE_MOST:
        return positions.astype("<u2").tobytes()
    bitmap = np.zeros(65536, np.uint8)
    bitmap[positions] = 1
    return np.packbits(bitmap, bitorder="little").tobytes() + b"\x00"  # odd length marks the bitmap


def unpack(data: bytes) -> np.ndarray:
    if len(data) % 2 == 0:
        return np.frombuffer(data, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data[:-1], np.uint8), bitorder="little")).astype("<u2")


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes one after another, lengths) of binary values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset]) if len(column) else 0
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[start : start + int(size.sum())] if data else np.zeros(0, np.uint8)), size


def _positions(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of all positions of many containers."""
    data, size = _flat(column)
    sparse = size % 2 == 0
    rows = np.repeat(np.arange(len(size)), np.where(sparse, size // 2, 0))
    keep = np.repeat(sparse, size)
    at = data[keep].view("<u2") if len(data) else np.zeros(0, "<u2")
    if not sparse.all():
        ends = np.cumsum(size)
        dense = [(r, unpack(data[ends[r] - size[r] : ends[r]].tobytes())) for r in np.flatnonzero(~sparse)]
        rows = np.concatenate([rows, *(np.full(len(p), r) for r, p in dense)])
        at = np.concatenate([at, *(p for _, p in dense)])
    return rows, at


def _containers(g: np.ndarray, w: np.ndarray, i: np.ndarray, n: np.ndarray, names: pa.Array, words: pa.Array) -> pa.RecordBatch:
    """Partial containers of (group, term, record id, occurrences)."""
    order = np.lexsort((i, w, g))
    g, w, i, n = g[order], w[order], i[order], n[order]
    one_more = np.ones(len(i), bool)  # a term that stands in several elements of a record
    one_more[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1]) | (i[1:] != i[:-1])
    at = np.flatnonzero(one_more)
    n = np.add.reduceat(n, at) if len(at) else n
    g, w, i = g[at], w[at], i[at]
    c = i >> 16
    new = np.ones(len(i), bool)
    new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1]) | (c[1:] != c[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(i)))
    low = (i & 0xFFFF).astype("<u2")
    row = np.repeat(np.arange(len(start)), size)
    big = np.flatnonzero(size > SPARSE_MOST)
    bits = _binary(low, np.where(size > SPARSE_MOST, 0, size), ~np.isin(row, big))
    if len(big):
        packed = bits.to_pylist()
        for r in big:
            packed[r] = pack(low[start[r] : start[r] + size[r]])
        bits = pa.array(packed, pa.binary())
    several = n != 1
    more = np.zeros(int(several.sum()), _MORE)
    more["at"], more["n"] = low[several], n[several]
    more = _binary(more, np.bincount(row[several], minlength=len(start)), slice(None))
    return pa.RecordBatch.from_arrays([names.take(pa.array(g[start])), words.take(pa.array(w[start])), pa.array(c[start]), bits, more], schema=_SCHEMA)


def _binary(values: np.ndarray, size: np.ndarray, keep) -> pa.Array:
    """Runs of values as binary values."""
    ends = np.concatenate([[0], np.cumsum(size * values.dtype.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values[keep].tobytes())])


def _build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    room = 0

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        t = t.take(pa.array(np.unique(t["id"].to_numpy(), return_index=True)[1]))  # deliveries agree: one of each record
        ids = t["id"].to_numpy()
        terms, counts = t["terms"].combine_chunks(), t["ns"].combine_chunks()
        size = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        group, word = t["grp"].combine_chunks().dictionary_encode(), terms.flatten().dictionary_encode()
        names, words = group.dictionary.to_pylist(), [*word.dictionary.to_pylist(), None]
        # each record stands once more under the null term: the count of all records
        g0 = group.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        w = word.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return _containers(
            np.concatenate([np.repeat(g0, size), g0]), np.concatenate([w, np.full(len(ids), len(words) - 1)]), np.concatenate([np.repeat(ids, size), ids]),
            np.concatenate([n, np.ones(len(ids), np.int64)]), pa.array(names, pa.string()), pa.array(words, pa.string()),
        )

    for batch in it:
        if not batch.num_rows:
            continue
        held.append(batch)
        room += batch.num_rows + len(batch.column("terms").flatten())
        if room >= FLUSH:
            yield flush()
            held, room = [], 0
    if held:
        yield flush()


def _merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions of containers; rows come sorted by the hash of group, term and container, so that equal ones are neighbours.

    The parts of one container hold its 65,536 positions among them, each once per delivery, so what a task holds is bounded.
    """
    for t in common.whole_groups(it, ["key"]):
        names = [t[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("grp", "term")]
        key = [t["key"].to_numpy(), *names, t["container"].to_numpy()]
        order = np.lexsort(key[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        many = int(new.sum())
        row, at = _positions(t["bits"])
        docs = np.bincount(np.unique(group[row] << 16 | at) >> 16, minlength=many)
        data, size = _flat(t["more"])
        more = np.frombuffer(data.tobytes(), _MORE)
        place, first = np.unique(group[np.repeat(np.arange(len(size)), size // _MORE.itemsize)] << 16 | more["at"], return_index=True)
        occ = docs.astype(np.int64)
        np.add.at(occ, place >> 16, more["n"][first] - 1)
        one = pa.array(order[new])
        yield pa.RecordBatch.from_arrays([t["grp"].combine_chunks().take(one), t["term"].combine_chunks().take(one), pa.array(occ), pa.array(docs)], names=["grp", "term", "occ", "docs"])


def term_counts(df: DataFrame, record: Column, group: Column, terms: Column, ns: Column | None = None) -> DataFrame:
    """(grp STRING, term STRING, occurrences BIGINT, docs BIGINT, records BIGINT): one row per term of each group.

    ``terms`` is an array of strings per record and ``ns`` the occurrences of each (1 where absent or null). ``docs`` is
    the number of records that hold the term, ``records`` that of all records of the group, with those whose array is
    empty. Records with a null id, group or array take no part; null terms are no terms; the empty string is one.
    A record delivered more than once counts once (deliveries must agree). An empty input gives an empty result.
    """
    ns = F.transform(terms, lambda _: F.lit(1).cast("long")) if ns is None else ns
    rows = df.select(record.cast("long").alias("id"), group.cast("string").alias("grp"), terms.alias("terms"), ns.alias("ns"))
    rows = rows.where(F.col("id").isNotNull() & F.col("grp").isNotNull() & F.col("terms").isNotNull())
    pairs = F.filter(F.arrays_zip("terms", "ns"), lambda p: p["terms"].isNotNull())
    rows = rows.select("id", "grp", pairs.alias("p")).select(
        "id", "grp", F.col("p.terms").alias("terms"), F.transform("p", lambda p: F.coalesce(p["ns"], F.lit(1)).cast("long")).alias("ns")
    )
    parts = rows.mapInArrow(_build, _PARTS).withColumn("key", F.xxhash64("grp", "term", "container"))
    merged = parts.repartition("key").sortWithinPartitions("key").mapInArrow(_merge, _MERGED)
    totals = merged.groupBy("grp", "term").agg(F.sum("occ").alias("occurrences"), F.sum("docs").alias("docs"))
    totals = Scratch(df.sparkSession, "terms").write(totals)
    every = totals.where(F.col("term").isNull()).select("grp", F.col("docs").alias("records"))
    if common.fits_broadcast(every, 256):  # groups may be few and their terms many: no shuffle on the group alone
        every = F.broadcast(every)
    return totals.where(F.col("term").isNotNull()).join(every, "grp")


def rare_or_common(counted: DataFrame, rare_most: int = 2, common_share: float = 0.25) -> DataFrame:
    """(grp, term, flag): ``rare`` in at most ``rare_most`` records, ``common`` in more than ``common_share`` of all."""
    flags = F.array(
        F.when(F.col("docs") <= rare_most, F.lit("rare")), F.when(F.col("docs") > F.col("records") * common_share, F.lit("common"))
    )
    return counted.select("grp", "term", F.explode(F.array_compact(flags)).alias("flag"))
