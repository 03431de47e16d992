"""The queries of problems 1 to 9, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BTYPES
from ..tables import btype_key, counts, is_btype, read
from . import components, neardup, packing, setjoin, spans, subjects, terms, tokens, topn

#: Types whose elements are terms, as written in the results.
TERM_TYPES = ("Sfc", "Ffc", "OpSeq", "OpFreq")


# 1 ----------------------------------------------------------------------------------------------------------------
def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "birthmarks")
    return b.where(is_btype(F.col("info.btype"), "OpSeq") & (F.col("info.mode") == "Function") & F.col("elements").isNotNull())


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(_functions(spark, sf_dir), F.col("bm_id"), F.col("info.name"), F.col("elements"), 40)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir).select(F.col("record").alias("bm_id"), "start_pos", "end_pos")


def p1_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _shared(spark, sf_dir)
    total = runs.groupBy(F.col("record").alias("bm_id"), "elements").agg(F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("shared"))
    return total.withColumn("share", F.round(F.col("shared") / F.col("elements"), 9))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``p1_share``, with a row for every record that may share; short ones and those that share nothing have 0."""
    named = _functions(spark, sf_dir).where(F.col("bm_id").isNotNull() & F.col("info.name").isNotNull())
    every = named.select("bm_id", F.size("elements").cast("long").alias("elements")).distinct()
    some = p1_share(spark, sf_dir).select("bm_id", "shared", "share")
    return every.join(some, "bm_id", "left").fillna({"shared": 0, "share": 0.0})


# 2 ----------------------------------------------------------------------------------------------------------------
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "similarities").where(F.col("a_info").isNotNull() & counts(F.col("score")))
    group = [F.col(f"a_info.{k}") for k in ("name", "path", "btype", "mode")]
    best = topn.top_n_per_group(s, group, F.col("score"), F.col("sim_id"), 5)
    return best.select(F.col("id").alias("sim_id"), "rnk")


# 3 ----------------------------------------------------------------------------------------------------------------
def _near(spark: SparkSession, sf_dir: str) -> neardup.Classes:
    return neardup.near_duplicates(_functions(spark, sf_dir), F.col("bm_id"), F.col("elements"), 0.8, 64)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _near(spark, sf_dir).pairs()
    return pairs.select(F.col("a").alias("bm_id_a"), F.col("b").alias("bm_id_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: its class of equal contents, and how many other contents are near it."""
    return _near(spark, sf_dir).rows().select(F.col("record").alias("bm_id"), F.col("cls").alias("class_id"), "copies", "links")


# 4 ----------------------------------------------------------------------------------------------------------------
def _alike(spark: SparkSession, sf_dir: str) -> setjoin.Classes:
    b = read(spark, sf_dir, "birthmarks")
    b = b.where(is_btype(F.col("info.btype"), "Sfc", "Ffc") & (F.col("info.mode") == "Function") & F.col("elements").isNotNull())
    return setjoin.similar_sets(b, F.col("bm_id"), btype_key(F.col("info.btype")), F.col("elements.s"), 0.7, 5)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _alike(spark, sf_dir).pairs()
    return pairs.select(F.col("a").alias("bm_id_a"), F.col("b").alias("bm_id_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: its class of equal sets, and how many other sets largely agree with it."""
    return _alike(spark, sf_dir).rows().select(F.col("record").alias("bm_id"), F.col("cls").alias("class_id"), "copies", "links")


# 5 ----------------------------------------------------------------------------------------------------------------
def _term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "birthmarks").where(is_btype(F.col("info.btype"), *TERM_TYPES))
    key = btype_key(F.col("info.btype"))
    name = F.coalesce(*[F.when(key == t.lower(), F.lit(t)) for t in TERM_TYPES])
    return terms.term_counts(b, F.col("bm_id"), name, F.col("elements.s"), F.col("elements.n"))


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``p5_counts``, over all types; numbers and grams (as JSON arrays) are terms of their own kinds."""
    b = read(spark, sf_dir, "birthmarks").where(is_btype(F.col("info.btype"), *BTYPES))
    key = btype_key(F.col("info.btype"))
    name = F.coalesce(*[F.when(key == t.lower(), F.lit(t)) for t in BTYPES])
    term = lambda e: F.coalesce(F.concat(F.lit("s"), e["s"]), F.concat(F.lit("i"), e["i"].cast("string")), F.concat(F.lit("g"), F.to_json(e["gram"])))
    t = terms.term_counts(b, F.col("bm_id"), name, F.transform("elements", term), F.col("elements.n"))
    kind = F.substring("term", 1, 1)
    kind = F.when(kind == "s", F.lit("Str")).when(kind == "i", F.lit("Int")).otherwise(F.lit("Kgram"))
    return t.select(F.col("grp").alias("btype"), kind.alias("kind"), F.expr("substring(term, 2)").alias("term"), "occurrences", "docs", "records")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = terms.rare_or_common(_term_counts(spark, sf_dir))
    return flags.select(F.col("grp").alias("btype"), "term", "flag")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _term_counts(spark, sf_dir)
    return t.select(F.col("grp").alias("btype"), "term", "occurrences", "docs", "records")


# 6 ----------------------------------------------------------------------------------------------------------------
def record_key(info: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(f"{info}.{k}"), F.lit("")) for k in ("path", "name", "btype", "mode")])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "similarities")
    links = s.where(
        counts(F.col("score")) & (F.col("score") >= 0.9) & F.col("a_info").isNotNull() & F.col("b_info").isNotNull()
    )
    return components.connected_groups(links, record_key("a_info"), record_key("b_info"))


# 7 ----------------------------------------------------------------------------------------------------------------
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return tokens.encode_texts(d, F.col("doc_id"), F.col("text")).withColumnRenamed("key", "doc_id")


# 8 ----------------------------------------------------------------------------------------------------------------
CONTAINER_TOKENS = 2048


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    sizes = tokens.count_tokens(d, F.col("doc_id"), F.col("text"))
    placed = packing.fill_containers(sizes, F.col("key"), F.col("tokens"), CONTAINER_TOKENS)
    return placed.select(F.col("key").alias("doc_id"), "piece", F.col("size").alias("tokens"), "container", "start")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = p8_pack(spark, sf_dir)
    total = p.agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), (F.max("container") + 1).alias("containers"))
    room = F.col("containers") * CONTAINER_TOKENS
    return total.withColumn("unused_share", F.when(room > 0, 1 - F.col("tokens") / room))


# 9 ----------------------------------------------------------------------------------------------------------------
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = read(spark, sf_dir, "documents"), read(spark, sf_dir, "subject_examples")
    found = subjects.subjects_of(d, F.col("doc_id"), F.col("text"), e, F.col("text"), F.col("subject"))
    return found.withColumnRenamed("key", "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_shares(spark, sf_dir).select("doc_id", "subject")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "p" and k[1].isdigit()}
