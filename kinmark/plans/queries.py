"""Queries on the reference-like capabilities: extraction, comparison, sources and sinks, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.opcodes import OPCODES, TERMINATORS
from ..operators import compare, extract
from ..schema import BTYPES, CTYPES, MODES, kebab
from ..sources import ir_text, records
from ..tables import btype_name, counts, is_btype, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


# sources -----------------------------------------------------------------------------------------------------------
def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each IR file, parsed."""
    files = records.latest(read(spark, sf_dir, "ir_files"))
    return ir_text.parse(files).withColumn("src_idx", F.xxhash64("path"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).where(F.col("error").isNull())


@_query
def s_ir_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that can't be parsed, and why."""
    return parsed(spark, sf_dir).where(F.col("error").isNotNull()).select("path", "error")


@_query
def s_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed files as one row per instruction."""
    rows = extract.flat(modules(spark, sf_dir))
    return rows.select("path", *[F.col(c).cast("long").alias(c) for c in ("fn_idx", "bb_idx", "pos")], "fn_name", "bb_name", "opcode", "is_term", "callee")


@_query
def s_json_birthmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Birthmarks of the documents that are arrays of birthmarks."""
    docs = records.parse_json(records.latest(read(spark, sf_dir, "birthmark_json"))).where(F.col("error").isNull())
    each = docs.select(F.col("path").alias("doc"), F.posexplode("birthmarks").alias("pos", "b"))
    return each.select("doc", F.col("pos").cast("long").alias("pos"), "b.info.*", F.size("b.elements").cast("long").alias("n"), _texts(F.col("b.elements")).alias("elements"))


@_query
def s_json_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = records.parse_json(records.latest(read(spark, sf_dir, "birthmark_json")))
    return docs.where(F.col("error").isNotNull()).select(F.col("path").alias("doc"), "error")


@_query
def s_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the records with a whole info, how many are the same after being written as JSON, under the name of their type, and read again."""
    rows = _records(spark, sf_dir).where(F.col("elements").isNotNull()).dropna(subset=["info.name", "info.path", "info.btype", "info.mode"])
    rows = rows.withColumn("info", F.col("info").withField("btype", btype_name(F.col("info.btype"))))
    written = rows.withColumn("content", F.concat(F.lit("["), records.birthmark_json(F.col("info"), F.col("elements")), F.lit("]")))
    back = records.parse_json(written).withColumn("b", F.col("birthmarks")[0])
    same = (F.col("b.elements") == F.col("elements")) & (F.col("b.info") == F.col("info"))
    return back.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.coalesce(same, F.lit(False)).cast("long")), F.lit(0)).alias("same"))


def _texts(elements: Column) -> Column:
    return F.array_join(F.transform(elements, lambda e: records.element_text(e)), "|")


# extraction --------------------------------------------------------------------------------------------------------
def _extraction(btype: str, mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = extract.extract(modules(spark, sf_dir), btype, mode)
        return b.select(
            "info.path", F.col("fn_idx").cast("long").alias("fn_idx"), F.col("bb_idx").cast("long").alias("bb_idx"), "info.name",
            F.size("elements").cast("long").alias("n"), _texts(F.col("elements")).alias("elements"),
        )

    return run


def snake(name: str) -> str:
    return kebab(name).replace("-", "_")


for _b in BTYPES:
    for _m in MODES:
        QUERIES[f"e_{snake(_b)}_{snake(_m)}"] = _extraction(_b, _m)


# comparison --------------------------------------------------------------------------------------------------------
def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.records(read(spark, sf_dir, "birthmarks"))


def of_kind(spark: SparkSession, sf_dir: str, btype: str, mode: str) -> DataFrame:
    """Records of one type and mode, with their id as order."""
    b = read(spark, sf_dir, "birthmarks")
    b = b.where(is_btype(F.col("info.btype"), btype) & (F.col("info.mode") == mode) & F.col("elements").isNotNull())
    return records.records(b).withColumnRenamed("bm_id", "bm_ord")


def _comparison(ctype: str, btype: str, mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = compare.scores(of_kind(spark, sf_dir, btype, mode), ctype, digits=9)
        return s.select("a_ord", "b_ord", F.lit(ctype).alias("ctype"), "score")

    return run


#: Comparators over all pairs of a type and mode. A type of counted or grouped elements scores 0 in all but Cosine.
COMPARED = (
    *[(c, "OpSeq", "File") for c in CTYPES],
    ("LCS", "OpSeq", "BasicBlock"),
    *[("Cosine", b, "Function") for b in ("OpSet", "OpFreq", "Ffc", "BiGram", "TriGram", "OctaGram")],
    ("Cosine", "Sfc", "BasicBlock"),
    ("Jaccard", "Sfc", "BasicBlock"),
    ("Dice", "OpSet", "Function"),
    ("Jaccard", "BiGram", "Function"),
    ("Levenshtein", "OpFreq", "Function"),
    ("LCS", "TetraGram", "Function"),
)
for _c, _b, _m in COMPARED:
    QUERIES[f"c_{snake(_c)}_{snake(_b)}_{snake(_m)}"] = _comparison(_c, _b, _m)


@_query
def c_run_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to similarities in one plan: OpSeq birthmarks of all files, all pairs, by Jaccard."""
    b = extract.extract(modules(spark, sf_dir), "OpSeq", "File").select(F.col("info.path").alias("bm_ord"), "info", "elements")
    s = compare.scores(b, "Jaccard", digits=9)
    return s.select(F.col("a_ord").alias("a_path"), F.col("b_ord").alias("b_path"), "score")


def _rescored(ctype: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The listed comparisons of one comparator, scored again from the birthmarks that exist."""
        s = read(spark, sf_dir, "similarities").where((F.col("ctype") == ctype) & F.col("a_info").isNotNull() & F.col("b_info").isNotNull())
        s = s.select("sim_id", "a_info", "b_info").dropDuplicates(["sim_id"])
        named = ["name", "path", "mode"]
        b = read(spark, sf_dir, "birthmarks").where(is_btype(F.col("info.btype"), "OpSeq") & F.col("elements").isNotNull())
        b = records.records(b).withColumnRenamed("bm_id", "bm_ord")
        first = b.groupBy(*[F.col(f"info.{k}").alias(k) for k in named]).agg(F.min("bm_ord").alias("ord"))
        for x in "ab":
            side = first.select(*[F.col(k).alias(f"{x}_{k}") for k in named], F.col("ord").alias(f"{x}_ord"))
            s = s.withColumns({f"{x}_{k}": F.col(f"{x}_info.{k}") for k in named}).join(side, [f"{x}_{k}" for k in named])
        wanted = s.select("sim_id", "a_ord", "b_ord")
        scores = compare.listed(wanted.select("a_ord", "b_ord").distinct(), b, ctype)
        return wanted.join(scores, ["a_ord", "b_ord"]).select("sim_id", "a_ord", "b_ord", F.round("score", 9).alias("score"))

    return run


for _c in CTYPES:
    QUERIES[f"r_{snake(_c)}"] = _rescored(_c)


@_query
def a_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each record, and of its distinct whole elements."""
    rows = _records(spark, sf_dir).where(F.col("elements").isNotNull())
    return rows.select("bm_id", F.size("elements").cast("long").alias("n"), F.size(F.array_distinct("elements")).cast("long").alias("kinds"))


@_query
def a_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each whole element stands in each record."""
    rows = _records(spark, sf_dir).select("bm_id", F.explode("elements").alias("e"))
    return rows.groupBy("bm_id", F.col("e.kind").alias("kind"), records.element_text(F.col("e")).alias("element")).agg(F.count("*").alias("k"))


@_query
def f_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and modes of the records: what may be compared with what."""
    rows = _records(spark, sf_dir)
    return rows.groupBy("info.btype", "info.mode").agg(F.count("*").alias("records"), F.sum((F.coalesce(F.size("elements"), F.lit(0)) == 0).cast("long")).alias("empty"))


@_query
def f_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored comparisons by comparator: how many count, and their spread."""
    s = read(spark, sf_dir, "similarities").select("sim_id", "ctype", "score").dropDuplicates(["sim_id"])
    s = s.withColumn("score", F.when(counts(F.col("score")), F.col("score")))
    return s.groupBy("ctype").agg(
        F.count("*").alias("n"), F.count("score").alias("scored"), F.round(F.min("score"), 9).alias("least"), F.round(F.max("score"), 9).alias("most"),
        F.round(F.avg("score"), 6).alias("mean"),
    )


@_query
def k_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be extracted and compared, by the names of the command line."""
    rows = [("birthmark", kebab(b), b) for b in BTYPES] + [("mode", kebab(m), m) for m in MODES] + [("comparator", kebab(c), c) for c in CTYPES]
    return spark.createDataFrame(rows, "what string, option string, name string")


@_query
def k_opcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instruction kinds and how often the parsed files have them."""
    table = spark.createDataFrame([(o, o in TERMINATORS) for o in OPCODES], "opcode string, is_term boolean")
    used = extract.flat(modules(spark, sf_dir)).groupBy("opcode").agg(F.count("*").alias("used"))
    return table.join(used, "opcode", "left").select("opcode", "is_term", F.coalesce("used", F.lit(0)).cast("long").alias("used"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["c_jaccard_op_seq_file"](spark, sf_dir)

