"""Birthmarks as tables: deliveries to records, JSON documents to rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BTYPES, ELEMENT, INFO, MODES

_RAW = T.ArrayType(T.StructType([T.StructField("info", INFO, False), T.StructField("elements", T.ArrayType(T.VariantType()))]))
_INFO_KEYS = [f.name for f in INFO.fields]


def records(deliveries: DataFrame, key: str = "bm_id") -> DataFrame:
    """One row (key, info, elements) per record, however often it was delivered; deliveries must agree."""
    return deliveries.select(key, "info", "elements").where(F.col(key).isNotNull()).dropDuplicates([key])


def latest(deliveries: DataFrame, path: str = "path", content: str = "content", loaded: str = "loaded_at") -> DataFrame:
    """(path, content): the last delivery of each file.

    Parsing is heavy for its bytes, so the partitions are as many as the session's shuffles have, not coalesced by size.
    """
    many = int(deliveries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = deliveries.select(path, content, loaded).repartition(many, path).groupBy(path).agg(F.max(F.struct(F.col(loaded), F.col(content))).alias("d"))
    return last.select(F.col(path).alias("path"), F.col(f"d.{content}").alias("content"))


def element_of(v: Column) -> Column:
    """An untagged JSON element: a string, a whole number, an array of strings, or a pair of count and name.

    Null where it is none of these.
    """
    shape = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    null = lambda t: F.lit(None).cast(t)
    gram = F.try_variant_get(v, "$", "array<string>")
    count, name = F.try_variant_get(v, "$[0]", "bigint"), F.try_variant_get(v, "$[1]", "string")

    def made(kind: str, **f: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *[f.get(x.name, null(x.dataType)).cast(x.dataType).alias(x.name) for x in ELEMENT.fields[1:]])

    pair = F.try_variant_get(v, "$[2]", "variant").isNull() & (F.schema_of_variant(F.try_variant_get(v, "$[0]", "variant")) == "BIGINT")
    named = F.schema_of_variant(F.try_variant_get(v, "$[1]", "variant")) == "STRING"
    return (
        F.when(shape == "STRING", made("Str", s=text))
        .when(shape == "BIGINT", made("Int", i=F.try_variant_get(v, "$", "bigint")))
        .when(shape.isin("ARRAY<STRING>", "ARRAY<VOID>"), made("Kgram", gram=F.coalesce(gram, F.array().cast("array<string>"))))
        .when(pair & named & (count >= 0), made("Freq", n=count, s=name))
    )


def parse_json(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``birthmarks`` (array of info and elements) and ``error`` to documents of birthmark JSON.

    A document must be an array of objects with an ``info`` of four strings, type and mode among those that there are, and an ``elements`` array; anything else
    (null, cut off, other keys or layouts, an element of another shape) makes the whole document an error.
    """
    doc = F.try_parse_json(F.col(content))
    items = F.try_variant_get(doc, "$", "array<variant>")
    out = df.withColumn("_items", items)

    def info(v: Column) -> Column:
        is_text = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.info.{k}", "variant")) == "STRING"
        return F.struct(*[F.when(is_text(k), F.try_variant_get(v, f"$.info.{k}", "string")).alias(k) for k in _INFO_KEYS])

    def item(v: Column) -> Column:
        elements = F.try_variant_get(v, "$.elements", "array<variant>")
        return F.struct(info(v).alias("info"), F.transform(elements, element_of).alias("elements"))

    out = out.withColumn("birthmarks", F.transform("_items", item)).drop("_items")
    bad = F.exists(
        "birthmarks",
        lambda b: b["elements"].isNull() | F.exists(b["elements"], lambda e: e.isNull()) | b["info"]["name"].isNull() | b["info"]["path"].isNull()
        | F.coalesce(~b["info"]["btype"].isin(*BTYPES), F.lit(True)) | F.coalesce(~b["info"]["mode"].isin(*MODES), F.lit(True)),
    )
    error = F.when(F.col(content).isNull(), F.lit("no content")).when(F.col("birthmarks").isNull() | F.coalesce(bad, F.lit(False)), F.lit("not an array of birthmarks"))
    out = out.withColumn("error", error)
    return out.withColumn("birthmarks", F.when(F.col("error").isNull(), F.col("birthmarks")))


def element_json(e: Column) -> Column:
    """The untagged JSON of an element."""
    return (
        F.when(e["kind"] == "Str", F.get_json_object(F.to_json(F.array(e["s"])), "$") )
        .when(e["kind"] == "Int", e["i"].cast("string"))
        .when(e["kind"] == "Kgram", F.to_json(e["gram"]))
        .otherwise(F.concat(F.lit("["), e["n"].cast("string"), F.lit(","), _quoted(e["s"]), F.lit("]")))
    )


def _quoted(s: Column) -> Column:
    """A JSON string: that of a one-element array without its brackets."""
    text = F.to_json(F.array(s))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def birthmark_json(info: Column, elements: Column) -> Column:
    """One birthmark as compact JSON text."""
    one = lambda e: F.when(e["kind"] == "Str", _quoted(e["s"])).otherwise(element_json(e))
    return F.concat(F.lit('{"info":'), F.to_json(info), F.lit(',"elements":['), F.array_join(F.transform(elements, one), ","), F.lit("]}"))


def element_text(e: Column) -> Column:
    """A short readable form, used in flat results: ``s``, ``i``, ``a,b`` or ``n:s``."""
    return F.coalesce(
        F.when(e["kind"] == "Freq", F.concat_ws(":", e["n"].cast("string"), e["s"])), F.array_join(e["gram"], ","), e["s"], e["i"].cast("string")
    )
