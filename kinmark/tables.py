"""Reading the input tables and the predicates that all queries on them share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lookup import lookup
from .schema import BTYPES


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def btype_key(btype: Column) -> Column:
    """A birthmark type without case and without anything but letters; two spellings of one type agree in it."""
    return F.lower(F.regexp_replace(btype, "[^A-Za-z]", ""))


def btype_name(btype: Column) -> Column:
    """The name of the type that a spelling means; null if there is no such type."""
    return lookup(btype_key(btype), {b.lower(): b for b in BTYPES})


def is_btype(btype: Column, *names: str) -> Column:
    return btype_key(btype).isin([n.lower() for n in names])


def counts(score: Column) -> Column:
    """A score counts if it is neither null nor not-a-number."""
    return score.isNotNull() & ~F.isnan(score)
