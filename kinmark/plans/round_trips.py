"""Queries that go through files: written to the shared folder, read back by what the command line uses.

Documents are one file each, strung together of parts that tasks have written and read again in pieces; the folder of a query is deleted with its other tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import cli
from .. import errors as X
from ..operators import compare
from ..scratch import Scratch
from ..sources import files, packed
from . import queries as Q

#: Modules of the file queries: two that can be parsed, one that has no functions, one that is cut off.
MODULES = {
    "swap.ll": "define void @swap(ptr %a, ptr %b) {\n  %x = load i32, ptr %a\n  %y = load i32, ptr %b\n  store i32 %y, ptr %a\n  store i32 %x, ptr %b\n  ret void\n}\n"
    "define i32 @both(ptr %a) {\ntop:\n  call void @swap(ptr %a, ptr %a)\n  %r = call i32 @check(ptr %a)\n  br label %end\nend:\n  ret i32 %r\n}\n",
    "sum one.ll": "define i32 @sum(i32, i32) {\n  %s = add i32 %0, %1\n  ret i32 %s\n}",
    "none.ll": 'source_filename = "none.c"\n',
    "cut.ll": "define i32 @sum(i32, i32) {\n  %s = add",
}


def _folder(spark: SparkSession) -> str:
    """A new folder by its full name: one that names no file system would be taken for a place on the driver's machine."""
    return files.qualified(Scratch(spark, "files").root)


def _put(path: str, text: str) -> str:
    system, where = files._file_system(path)
    out = system.create(where, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    return path


def _modules(folder: str, *names: str) -> list[str]:
    return [_put(f"{folder}/{n}", MODULES[n]) for n in names]


def _flat(birthmarks: DataFrame, folder: str = "", *more: str) -> DataFrame:
    """Rows with readable elements; paths without the folder, which is another one each time."""
    clean = lambda c: F.replace(F.col(c), F.lit(f"{folder}/"), F.lit("")) if folder else F.col(c)
    return birthmarks.select(
        clean("info.name").alias("name"), clean("info.path").alias("path"), "info.btype", "info.mode",
        F.size("elements").cast("long").alias("n"), Q._texts(F.col("elements")).alias("elements"), *more,
    )


@Q._query
def s_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OpSeq of every function of module files, in the order of the arguments; one file is given twice."""
    folder = _folder(spark)
    paths = _modules(folder, "sum one.ll", "none.ll", "swap.ll")
    b = files.from_paths(spark, [*paths, paths[0]], "OpSeq", "Function")
    b = b.withColumn("nth", F.row_number().over(Window.orderBy("bm_ord")) - 1)  # a handful of rows
    return _flat(b, folder, "nth")


@Q._query
def s_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called functions of IR that is given as text."""
    return _flat(files.from_str(spark, MODULES["swap.ll"], "Sfc", "File"))


@Q._query
def s_birthmark_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OpSeq records of functions, written as one birthmark document and loaded again."""
    rows = Q.of_kind(spark, sf_dir, "OpSeq", "Function").dropna(subset=["info.name", "info.path"])
    rows = rows.withColumn("info", F.col("info").withField("btype", F.lit("OpSeq")))
    path = f"{_folder(spark)}/birthmarks.json"
    files.write_birthmarks(rows, path)
    return _flat(files.load(spark, [path]))


@Q._query
def s_similarity_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All comparisons of OpSeq files by Dice, written as one packed document and read again: every field of a similarity."""
    rows = Q.of_kind(spark, sf_dir, "OpSeq", "File").withColumn("info", F.col("info").withField("btype", F.lit("OpSeq")))
    path = f"{_folder(spark)}/similarities.packed"
    packed.write_comparisons(rows, "Dice", path)
    s = packed.similarities(spark, path, digits=9)
    return s.select(*s.columns[:-1], F.col("elapsed_ms").isNull().alias("untimed"))


@Q._query
def k_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line from files to files: extract two files, compare what came out, and do both in one go."""
    folder = _folder(spark)
    paths = _modules(folder, "sum one.ll", "swap.ll")
    marks, compared, ran = (f"{folder}/{n}" for n in ("marks.json", "compared.json", "ran.parquet"))
    done = [
        cli.main(["extract", "-t", "op-set", "-m", "function", "-d", marks, *paths], spark),
        cli.main(["compare", "-c", "simpson", "-d", compared, marks], spark),
        cli.main(["run", "-t", "op-set", "-m", "function", "-c", "simpson", "-f", "parquet", "-d", ran, *paths], spark),
    ]
    first = spark.read.option("multiLine", True).json(compared)
    both = [first.select(F.lit(c).alias("command"), "a_info.name", F.col("b_info.name").alias("other"), "score") for c, first in (("compare", first), ("run", spark.read.parquet(ran)))]
    return both[0].unionByName(both[1]).select("command", "name", "other", F.round("score", 9).alias("score"), F.lit(sum(done)).cast("long").alias("failed"))


@Q._query
def x_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fails, and as what: one error by itself, several together, and nothing is given out beside them."""
    folder = _folder(spark)
    good, cut, empty = _modules(folder, "swap.ll", "cut.ll", "none.ll")
    text = _put(f"{folder}/notes.txt", "x")
    bare = _put(f"{folder}/notes", "x")
    mixed = _put(f"{folder}/mixed.json", "[" + ",".join(f'{{"info":{{"name":"f","path":"p","btype":"{b}","mode":"File"}},"elements":[]}}' for b in ("OpSeq", "OpSet")) + "]")
    wrong = _put(f"{folder}/wrong.json", '[{"info":{"name":"f","path":"p","btype":"OpSeq","mode":"Nowhere"},"elements":[]}]')
    extract = lambda *p: (lambda: files.from_paths(spark, list(p), "OpSeq", "File").collect())
    tried = {
        "a missing file": extract(f"{folder}/missing.ll"),
        "a folder": extract(folder),
        "no extension": extract(bare),
        "another extension": extract(text),
        "a module that is cut off": extract(good, cut),
        "two wrong paths": extract(text, f"{folder}/missing.ll", good),
        "a file and an empty one": extract(good, empty),
        "text that is no module": lambda: files.from_str(spark, "no module", "OpSeq", "File"),
        "a birthmark of no known mode": lambda: files.load(spark, [wrong]),
        "birthmarks that are not there": lambda: files.load(spark, [f"{folder}/missing.json"]),
        "types that differ": lambda: compare.compare(files.load(spark, [mixed]), "Jaccard"),
        "one birthmark only": lambda: compare.compare(files.from_paths(spark, [good], "OpSeq", "File"), "Jaccard"),
        "no known comparator": lambda: compare.similarities(files.from_paths(spark, [good], "OpSeq", "File"), "Other"),
        "a script": lambda: cli.perform(cli.parser().parse_args(["execute"]), spark),
    }
    rows = []
    for what, f in tried.items():
        try:
            f()
            rows.append((what, "none", 0))
        except X.BirthmarkError as e:
            rows.append((what, type(e).__name__, len(getattr(e, "errors", [e]))))
    return spark.createDataFrame(rows, "request string, error string, errors int")


@Q._query
def f_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the records of a path may be compared with one another: two at least, of one type and mode."""
    rows = Q._records(spark, sf_dir).where(F.col("elements").isNotNull() & F.col("info.path").isNotNull())
    kinds = rows.groupBy("info.path").agg(F.count("*").alias("records"), F.count_distinct(F.struct("info.btype", "info.mode")).alias("kinds"))
    return kinds.withColumn("comparable", (F.col("records") > 1) & (F.col("kinds") == 1))
