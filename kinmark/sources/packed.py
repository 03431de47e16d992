"""Documents of all comparisons, packed: the same items in the same order as in a plain document, with each of their texts once a block.

Every item of such a document names two records, and each record is named as often as there are others, so a plain one is mostly repetition: some 430 bytes
a pair. A packed one has blocks of some million items. A block is an Arrow stream with five columns of numbered texts, and an item is its five texts
one after another: up to the info of b, that info, up to the score, the score, the rest (``items`` gives them as plain documents have them). Blocks are made
where pairs are compared, in the order of the document, so pairs are neither sorted nor shuffled: a band of rows meets all records from its first one on.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FatalError
from ..operators import compare
from ..operators.pairs import PARTITIONS_MOST
from ..schema import CTYPES
from ..scratch import Scratch
from . import files

#: What a document begins with, and what ends it and each block.
_HEAD, _END = b"kinmark packed document 1", b"\n#kinmark-block-5d41402abc4b2a76b9719d911017c592#\n"
#: Pairs of a band and of a block at most, bands at least but for bands of so few rows, and records that a band meets at once.
_BAND, _BLOCK, _BANDS_LEAST, _ROWS_LEAST, _MET = 1 << 23, 1 << 21, 64, 32, 2048
#: Items that leave a block at once.
_BATCH = 1 << 15
_TEXTS = ("head", "b", "mid", "score", "tail")
_INFO = ("name", "path", "btype", "mode")


@F.pandas_udf(T.StringType())
def _info_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: files._pretty(json.loads(t), "\n    "))


def _ranked(birthmarks: DataFrame, ctype: str, order: str) -> tuple[DataFrame, int]:
    """(what the comparator needs of each record, btype, told: the text of its info in an item, rank: its place among all), and how many there are."""
    rows = compare._told(birthmarks, ctype, order).where(F.col("ord").isNotNull())
    told = _info_text(F.coalesce(F.to_json("info", {"ignoreNullFields": "false"}), F.lit("null")))
    rows = rows.select("ord", "n", "codes", "txt", F.col("info.btype").alias("btype"), told.alias("told"))
    rows = rows.orderBy("ord").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    rows = Scratch(birthmarks.sparkSession, "compare").write(rows)
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("at")).orderBy("part").collect()  # one row a partition
    first = np.cumsum([0, *(r["n"] for r in parts)])
    shift = F.create_map(*[F.lit(x) for r, k in zip(parts, first) for x in (r["part"], int(k) - r["at"])]) if parts else F.create_map(F.lit(0), F.lit(0))
    return rows.select("n", "codes", "txt", "btype", "told", (F.col("at") + shift[F.col("part")]).alias("rank")), int(first[-1])


def _score_text(x: float) -> str:
    return repr(x) if np.isfinite(x) else '"NaN"' if x != x else '"Infinity"' if x > 0 else '"-Infinity"'


def _numbers(n: int) -> pa.DataType:
    return pa.uint8() if n < 1 << 8 else pa.uint16() if n < 1 << 16 else pa.int32()


def _column(at: np.ndarray | pa.Array, texts: list[str] | pa.Array) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(at).cast(_numbers(len(texts))), pa.array(texts, pa.string()) if isinstance(texts, list) else texts)


def _block(heads: list[str], told: pa.Array, ctype: str, scores: list[np.ndarray]) -> bytes:
    """The items of neighbouring rows; told has the infos from that of the first item on, and a row its scores with the last records of them."""
    many = [len(s) for s in scores]
    held = pc.dictionary_encode(pa.array(np.concatenate(scores)))
    one = np.zeros(sum(many), np.uint8)
    columns = [
        _column(np.repeat(np.arange(len(many)), many), heads),
        _column(np.concatenate([np.arange(len(told) - n, len(told)) for n in many]), told),
        _column(one, [f',\n    "ctype": {files._plain(ctype)},\n    "score": ']),
        _column(held.indices, [_score_text(x) for x in held.dictionary.to_pylist()]),
        _column(one, [',\n    "elapsed_ms": null\n  }']),
    ]
    batch = pa.RecordBatch.from_arrays(columns, names=list(_TEXTS))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    block = out.getvalue().to_pybytes()
    return b"+" + block if _END not in block else b"=" + base64.b64encode(block)


def _bands(ctype: str):
    """Blocks of the pairs of each band; its own rows come first, then all records from the first of them on, in order."""

    def blocks(own: pa.Table, met: Iterator[pa.Table]) -> Iterator[bytes]:
        rows, n, told, scores = np.arange(len(own)), own["n"].to_numpy().astype(np.int64), [], []
        for some in met:
            t = pa.concat_tables([own, some]).combine_chunks()
            ids, size, kinds = compare._numbered(t)
            n, cols = t["n"].to_numpy().astype(np.int64), np.arange(len(own), len(t))
            found = compare._found(ctype, ids, size, n, kinds, rows, cols)
            scores.append(compare._raw_scores(ctype, found, n[rows], n[cols]))
            told.append(some["told"])
        told, scores = pa.chunked_array([c for x in told for c in x.chunks], pa.string()).combine_chunks(), np.hstack(scores)
        heads = [f'  {{\n    "btype": {files._pretty(b, "")},\n    "a_info": {i},\n    "b_info": ' for b, i in zip(own["btype"].to_pylist(), own["told"].to_pylist())]
        step = max(1, _BLOCK // len(told))
        for lo in range(0, len(rows), step):
            some = [r for r in range(lo, min(len(rows), lo + step)) if r + 1 < len(told)]
            if some:
                yield _block([heads[r] for r in some], told[lo + 1 :], ctype, [scores[r, r + 1 :] for r in some])

    def bands(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []
        first: list[pa.Table] = []
        for batch in it:
            k = int(np.count_nonzero(~batch.column("right").to_numpy(zero_copy_only=False)))
            own.append(batch.slice(0, k))
            if k < len(batch):
                first.append(pa.Table.from_batches([batch.slice(k)]))
                break

        def met() -> Iterator[pa.Table]:
            held, n = first, len(first[0])
            for batch in it:
                held, n = [*held, pa.Table.from_batches([batch])], n + len(batch)
                if n >= 2 * _MET:
                    yield from parted(held)
                    held, n = [], 0
            if held:
                yield from parted(held)

        def parted(held: list[pa.Table]) -> Iterator[pa.Table]:
            t = pa.concat_tables(held)
            for lo in range(0, len(t), _MET):
                yield t.slice(lo, _MET)

        if first:
            for b in blocks(pa.Table.from_batches(own), met()):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary())], names=["block"])

    return bands


def write_comparisons(birthmarks: DataFrame, ctype: str, dest: str, order: str = "bm_ord") -> None:
    """All comparisons of the records as one packed document, in order, after the checks of ``compare``; ``dest`` names its file system.

    A band holds the texts of all records from its own on and its scores with them: a fixed number of pairs.
    """
    if ctype not in CTYPES:
        raise FatalError(f"unknown comparator: {ctype}")
    compare.check_comparable(birthmarks, order)
    rows, many = _ranked(birthmarks, ctype, order)
    height = max(1, min(_BAND // many, max(_ROWS_LEAST, -(-many // _BANDS_LEAST))), -(-many // PARTITIONS_MOST))
    bands = -(-many // height)
    band = F.floor(F.col("rank") / height).cast("int")
    left = rows.select(band.alias("band"), F.lit(False).alias("right"), "*")
    right = rows.select(F.explode(F.sequence(F.lit(0), band)).alias("band"), F.lit(True).alias("right"), "*")
    met = left.unionByName(right).repartitionById(bands, "band").sortWithinPartitions("right", "rank")
    folder = f"{files.qualified(Scratch(birthmarks.sparkSession, 'parts').root)}/parts"
    end = _END.decode()
    met.mapInArrow(_bands(ctype), "block binary").select(F.col("block").cast("string").alias("t")).write.option("lineSep", end).text(folder)
    files._string_together(folder, dest, _HEAD + _END, 0, b"", _HEAD + _END)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", _END.decode()).text(files._uri(path))
    return text.select(F.col("value").cast("binary").alias("block"), F.monotonically_increasing_id().alias("at"))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        for block, at in zip(batch.column(0), batch.column(1).to_pylist()):
            raw = block.as_buffer()
            kind = raw.slice(0, 1).to_pybytes()
            if kind == b"k" and raw.to_pybytes() == _HEAD:
                continue
            if kind not in (b"+", b"="):
                raise FatalError("no packed document, or one that is cut off")
            raw = raw.slice(1) if kind == b"+" else pa.py_buffer(base64.b64decode(raw.slice(1).to_pybytes(), validate=True))
            for one in pa.ipc.open_stream(raw):
                yield at, one


def _items(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for at, block in _opened(it):
        for lo in range(0, len(block), _BATCH):
            some = block.slice(lo, _BATCH)
            text = pc.binary_join_element_wise(*[c.dictionary.take(c.indices) for c in some.columns], "")
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at)), pa.array(np.arange(lo, lo + n)), text], names=["at", "pos", "content"])


def items(spark: SparkSession, path: str) -> DataFrame:
    """(at, pos, content): the items of a packed document as a plain one has them; their order is that of at and pos."""
    return _blocks(spark, path).mapInArrow(_items, "at long, pos long, content string")


def _rows(digits: int | None):
    """Items with the values of their texts, each of which is parsed once a block."""

    def infos(texts: list[dict | None]) -> list[pa.Array]:
        return [pa.array([(x or {}).get(k) for x in texts], pa.string()) for k in _INFO]

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _opened(it):
            head, b, mid, score, tail = (c.dictionary.to_pylist() for c in block.columns)
            head = [json.loads(x + "null}") for x in head]
            scores = np.array([np.nan if (v := json.loads(x)) is None else float(v) for x in score])
            if digits is not None:
                scores = compare.rounded(scores, digits)
            told = {
                "head": [pa.array([x["btype"] for x in head], pa.string()), *infos([x["a_info"] for x in head])],
                "b": infos([json.loads(x) for x in b]),
                "mid": [pa.array([json.loads("{" + x.removeprefix(",") + "null}")["ctype"] for x in mid], pa.string())],
                "score": [pa.array(scores, mask=np.array([x == "null" for x in score]))],
                "tail": [pa.array([json.loads("{" + x.removeprefix(",")[: -len("}")] + "}")["elapsed_ms"] for x in tail], pa.float64())],
            }
            for lo in range(0, len(block), _BATCH):
                some = block.slice(lo, _BATCH)
                yield pa.RecordBatch.from_arrays([v.take(some.column(k).indices) for k in _TEXTS for v in told[k]], names=_NAMES)

    return rows


_NAMES = ["btype", *(f"{x}_{k}" for x in "ab" for k in _INFO), "ctype", "score", "elapsed_ms"]


def similarities(spark: SparkSession, path: str, digits: int | None = None) -> DataFrame:
    """(btype, a_name, a_path, a_btype, a_mode, the same of b, ctype, score, elapsed_ms): every field of the items, read in parallel; scores rounded to ``digits``."""
    kinds = ["string"] * (len(_NAMES) - 2) + ["double"] * 2
    return _blocks(spark, path).mapInArrow(_rows(digits), ", ".join(f"{n} {k}" for n, k in zip(_NAMES, kinds)))
