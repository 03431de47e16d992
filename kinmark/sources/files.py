"""Files of modules and of birthmarks: paths to DataFrames, and results to files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from json.encoder import encode_basestring
from math import isfinite

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as X
from ..operators import extract as ops
from ..schema import FUNCTIONS
from ..scratch import Scratch
from . import bitcode, ir_text, records

STDOUT = "-"


def _remote(path: str) -> bool:
    """Whether a path names its file system; others are on this machine."""
    return re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:/", path) is not None


def _file_system(path: str):
    """(file system, path) of the cluster's Java side."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()  # threads without one of their own
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def qualified(path: str) -> str:
    """The path with its file system, which is the session's default one where it names none."""
    system, where = _file_system(path)
    return system.makeQualified(where).toString()


def _exists(path: str) -> bool:
    if _remote(path):
        system, where = _file_system(path)
        return system.exists(where)
    return os.path.exists(path)


def _is_folder(path: str) -> bool:
    if _remote(path):
        system, where = _file_system(path)
        return system.getFileStatus(where).isDirectory()
    return os.path.isdir(path)


def source_type(path: str) -> str:
    """``ir`` or ``bc``, by the extension; raises for anything that can't be a module.

    A path may name any file system that the session can read (``hdfs://``, ``file:/``); one that names none is on this machine.
    """
    if not _exists(path):
        raise X.NotFound(path)
    if _is_folder(path):
        raise X.NotFile(path)
    extension = os.path.splitext(path)[1]
    if not extension:
        raise X.NoExtension(path)
    kind = {".ll": "ir", ".bc": "bc"}.get(extension)
    if kind is None:
        raise X.UnsupportedFormat(extension[1:])
    return kind


def _checked(paths: Sequence[str]) -> dict[str, str]:
    kinds, failed = {}, []
    for p in paths:
        try:
            kinds[p] = source_type(p)
        except X.BirthmarkError as e:
            failed.append(e)
    X.raise_all(failed)
    return kinds


def _uri(path: str) -> str:
    """The path as sources name it: with its file system, without repeated slashes."""
    if not _remote(path):
        return "file://" + os.path.abspath(path)
    return re.sub("^file:/*", "file:///", qualified(path))


def _name() -> Column:
    """The path of a row's file, as ``_uri`` has it."""
    name = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "file:///")
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))  # a plus sign in a path is one


def read_modules(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(src_idx, path, functions, error) of IR and bitcode files, in argument order; a path may be given repeatedly."""
    kinds = _checked(paths)
    listed = spark.createDataFrame([(i, p, _uri(p)) for i, p in enumerate(paths)], "src_idx int, path string, uri string")
    parts = []
    ir = sorted({_uri(p) for p, k in kinds.items() if k == "ir"})
    bc = sorted({_uri(p) for p, k in kinds.items() if k == "bc"})
    if ir:
        text = spark.read.text(ir, wholetext=True).select(_name().alias("uri"), F.col("value").alias("content"))
        parts.append(ir_text.parse(text).select("uri", "functions", "error"))
    if bc:
        binary = spark.read.format("binaryFile").load(bc).select(_name().alias("uri"), "content")
        parts.append(bitcode.parse(binary))
    parsed = parts[0] if parts else spark.createDataFrame([], f"uri string, functions {FUNCTIONS.simpleString()}, error string")
    for p in parts[1:]:
        parsed = parsed.unionByName(p)
    rows = listed.join(parsed, "uri", "left").drop("uri")
    # a file of no bytes is no row of the text source; it is a module without definitions
    rows = rows.withColumn("nothing", F.col("functions").isNull() & F.col("error").isNull())
    nothing = F.col("nothing")
    binary = F.col("path").endswith(".bc")
    rows = rows.withColumn("error", F.when(nothing & binary, F.lit("no content")).otherwise(F.col("error")))
    return rows.withColumn("functions", F.when(nothing & ~binary, F.array().cast(FUNCTIONS)).otherwise(F.col("functions"))).drop("nothing")


def raise_format_errors(modules: DataFrame) -> None:
    """Fails as a whole if any module could not be parsed."""
    bad = modules.where(F.col("error").isNotNull()).select("src_idx", "path", "error").orderBy("src_idx").collect()  # of files that an argument names
    X.raise_all(X.FormatError(f"Failed to parse {'BC' if r['path'].endswith('.bc') else 'IR'} file: {r['path']}: {r['error']}") for r in bad)


def from_paths(spark: SparkSession, paths: Sequence[str], btype: str, mode: str) -> DataFrame:
    """(bm_ord, info, elements): birthmarks of files, in order; raises if any file fails."""
    modules = read_modules(spark, paths)
    raise_format_errors(modules)
    return ops.numbered(ops.extract(modules, btype, mode))


def from_str(spark: SparkSession, text: str, btype: str, mode: str) -> DataFrame:
    """Birthmarks of IR given as text; its path is ``<str>``."""
    modules = ir_text.parse(spark.createDataFrame([(0, "<str>", text)], "src_idx int, path string, content string"))
    bad = modules.where(F.col("error").isNotNull()).select("error").first()
    if bad:
        raise X.FormatError(f"Failed to parse IR from reader: {bad['error']}")
    return ops.numbered(ops.extract(modules, btype, mode))


#: What stands between two items of a document that ``_write`` has written, and at its ends; line ends within strings are escaped.
_BETWEEN, _BEFORE, _AFTER = "\n  },\n", "[\n", "\n  }\n]\n"
_ITEM = ',{"info":{"name":"","path":"","btype":"OpSeq","mode":"File"},"elements":[]}]'
#: Bytes from which a document is read in pieces, if it has this layout: one value can neither hold nor parse any number of items.
_WHOLE_MOST = 4 << 20


def _pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, n = None, 0
    for batch in it:
        rows = []
        for text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = n + 1 if at == block else 0
            block = at
            first, last = at + n == 0 and text.startswith(_BEFORE), text.endswith(_AFTER)
            text = text[len(_BEFORE) if first else 0 : -len(_AFTER) if last else None]
            rows.append((at + n, text + "\n  }", first, last))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.bool_(), pa.bool_()))] if rows else [pa.array([], k) for k in (pa.int64(), pa.string(), pa.bool_(), pa.bool_())], names=["pos", "content", "first", "last"])


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(pos, content, first, last): the items of a written document at growing places, read in parallel."""
    text = spark.read.option("lineSep", _BETWEEN).text(_uri(path)).select("value", F.col("_metadata.file_block_start").alias("at"))
    return text.mapInArrow(_pieces, "pos long, content string, first boolean, last boolean")


def _size(path: str) -> int:
    system, where = _file_system(_uri(path))
    return system.getFileStatus(where).getLen()


def _in_pieces(spark: SparkSession, path: str) -> DataFrame | None:
    """(pos, info, elements) of a large document; nothing if it has another layout or an error."""
    # with an item behind it: what a piece ends before its end would be lost without an error
    docs = records.parse_json(pieces(spark, path).withColumn("content", F.concat(F.lit("["), "content", F.lit(_ITEM))))
    whole = F.coalesce(F.col("error").isNull() & (F.size("birthmarks") == 2), F.lit(False))
    rows = docs.select("pos", "first", "last", whole.alias("whole"), F.col("birthmarks")[0].alias("b")).select("pos", "first", "last", "whole", "b.info", "b.elements")
    table, seen = Scratch(spark, "documents").measured(
        rows, bad=F.count_if(~F.col("whole")), firsts=F.count_if("first"), lasts=F.count_if("last"), end=F.max(F.when(F.col("last"), F.col("pos"))), top=F.max("pos")
    )
    fine = not seen["bad"] and seen["firsts"] == seen["lasts"] == 1 and seen["end"] == seen["top"]
    return table.select("pos", "info", "elements") if fine else None


def load(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(bm_ord, info, elements) of birthmark JSON files, in argument order; any failure fails all."""
    missing = [X.IoError(p) for p in paths if not _exists(p) or _is_folder(p)]
    X.raise_all(missing)
    large = {p: _in_pieces(spark, p) for p in dict.fromkeys(paths) if _size(p) > _WHOLE_MOST}
    parts = [_ordered(large[p].select(F.lit(i).alias("src_idx"), "*")) for i, p in enumerate(paths) if large.get(p) is not None]
    rest = [(i, p, _uri(p)) for i, p in enumerate(paths) if large.get(p) is None]
    if rest or not parts:
        parts.append(_load_whole(spark, rest))
    return reduce(DataFrame.unionByName, parts)


def _ordered(each: DataFrame) -> DataFrame:
    return each.select((F.shiftleft(F.col("src_idx").cast("long"), 40) + F.col("pos")).alias("bm_ord"), "info", "elements")


def _load_whole(spark: SparkSession, paths: Sequence[tuple[int, str, str]]) -> DataFrame:
    listed = spark.createDataFrame(list(paths), "src_idx int, path string, uri string")
    text = spark.read.text(sorted({u for _, _, u in paths}), wholetext=True)
    docs = records.parse_json(text.select(_name().alias("uri"), F.col("value").alias("content")))
    docs = listed.join(docs, "uri", "left")
    error = F.when(F.col("birthmarks").isNull(), F.coalesce("error", F.lit("no content")))  # no bytes, no row
    bad = docs.select("path", error.alias("error")).where(F.col("error").isNotNull()).collect()
    X.raise_all(X.JsonError(f"{r['path']}: {r['error']}") for r in bad)
    return _ordered(docs.select("src_idx", F.posexplode("birthmarks").alias("pos", "b")).select("src_idx", "pos", "b.info", "b.elements"))


_plain = json.JSONEncoder(ensure_ascii=False).encode


def _pretty(v: object, at: str) -> str:
    """What ``json.dumps`` gives at an indent of 2, which it works out character by character."""
    if isinstance(v, str):
        return encode_basestring(v)
    if not v or not isinstance(v, dict | list):
        return repr(v) if type(v) is float and isfinite(v) else _plain(v)
    inner = at + "  "
    if isinstance(v, dict):
        return "{" + ",".join([f"{inner}{encode_basestring(k)}: {_pretty(x, inner)}" for k, x in v.items()]) + at + "}"
    return "[" + ",".join([inner + _pretty(x, inner) for x in v]) + at + "]"


def _laid_out(text: str) -> str:
    return "  " + _pretty(json.loads(text), "\n  ")


@F.pandas_udf(T.StringType())
def _item(texts: pd.Series) -> pd.Series:
    return texts.map(_laid_out)


def _write_rows(rows: DataFrame, dest: str) -> None:
    """One JSON array from rows of items in their order, which tasks lay out and write; the driver only strings their files together.

    A file is deleted when the document has it, so no item but those of one file is on disk twice.
    """
    if not _remote(dest):
        _write((r["t"] for r in rows.toLocalIterator()), dest)
        return
    folder = f"{qualified(Scratch(rows.sparkSession, 'parts').root)}/parts"
    rows.select(_item("t").alias("t")).write.option("lineSep", ",\n").text(folder)
    _string_together(folder, dest, b"[\n", 2, b"\n]\n", b"[]\n")  # nothing follows the last item


def _string_together(folder: str, dest: str, before: bytes, less: int, after: bytes, nothing: bytes) -> None:
    """One file of those that tasks have written, without the last ``less`` bytes of them; each is deleted when the file has it."""
    context = (SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()).sparkContext
    jvm, gateway = context._jvm, context._gateway
    try:
        system, where = _file_system(folder)
        parts = sorted((f.getPath().toString(), f.getLen()) for f in system.listStatus(where) if f.getPath().getName().startswith("part-") and f.getLen())
        copy, room = jvm.org.apache.commons.io.IOUtils.copyLarge, gateway.new_array(jvm.byte, 1 << 20)
        target, at = _file_system(dest)
        out = target.create(at, True)
        try:
            out.write(bytearray(before if parts else nothing))
            for i, (path, size) in enumerate(parts):
                part = _file_system(path)[1]
                source = system.open(part)
                try:
                    copy(source, out, 0, size if i < len(parts) - 1 else size - less, room)
                finally:
                    source.close()
                system.delete(part, False)
            if parts:
                out.write(bytearray(after))
        finally:
            out.close()
        system.delete(where, True)
    except Py4JError as e:
        raise X.IoError(str(e)) from e


def _write(text: Iterable[str], dest: str) -> None:
    """One JSON array from the texts of its items, item by item."""
    def lines():
        first = True
        yield "["
        for t in text:
            yield ("\n" if first else ",\n") + _laid_out(t)
            first = False
        yield "]\n" if first else "\n]\n"

    if dest == STDOUT:
        for x in lines():
            print(x, end="")
        return
    if _remote(dest):
        try:
            system, where = _file_system(dest)
            out = system.create(where, True)
            try:
                for x in lines():
                    out.write(bytearray(x, "utf-8"))
            finally:
                out.close()
        except Py4JError as e:
            raise X.IoError(str(e)) from e
        return
    try:
        with open(dest, "w", encoding="utf-8") as f:
            f.writelines(lines())
    except OSError as e:
        raise X.IoError(str(e)) from e


def write_birthmarks(birthmarks: DataFrame, dest: str) -> None:
    """A pretty JSON array in record order; on a named file system tasks write its parts, elsewhere it is streamed through the driver."""
    rows = birthmarks.orderBy("bm_ord").select(records.birthmark_json(F.col("info"), F.col("elements")).alias("t"))
    _write_rows(rows, dest)


def write_similarities(similarities: DataFrame, dest: str) -> None:
    rows = similarities.orderBy("a_ord", "b_ord").select(
        F.to_json(F.struct("btype", "a_info", "b_info", "ctype", "score", "elapsed_ms"), {"ignoreNullFields": "false"}).alias("t")
    )
    _write_rows(rows, dest)


def write_table(df: DataFrame, dest: str, fmt: str = "parquet") -> None:
    """The distributed way out: a table of many files, in ``parquet``, ``json`` or ``orc``."""
    df.write.mode("overwrite").format(fmt).save(dest)
