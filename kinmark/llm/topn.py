"""Top N items within every group, by descending score bands.

The items are staged once, narrow (two hashes of the group, id, score), in bands of descending score whose edges are
quantiles of all scores. Bands are taken from the top; groups that are already filled are taken out of a band by an
anti-join, and what is left is ranked exactly by (score descending, id ascending). A group whose Nth item lies inside a
band gets the ranks that its higher bands left open, so band edges never change a result.

No task ever holds a whole group: the rank filter becomes a limit of N rows a group *before* the shuffle (Catalyst's
window group limit), so a group with a third of all rows sends N rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import common

#: Shares of all items above each band edge. They steer the work only, never the result.
BANDS = (0.25, 0.55)
#: Bytes of a row of two hashes in a broadcast table, with its overhead.
KEY_BYTES = 160


def top_n_per_group(
    df: DataFrame, group: Sequence[Column], score: Column, item: Column, n: int, shares: Sequence[float] = BANDS
) -> DataFrame:
    """(item BIGINT, rnk INT): the ``n`` items of each group with the highest score, ties by smaller item id.

    ``group`` columns are compared with null as a value of its own. Rows with a null or not-a-number score are not
    items. An item that repeats in a group counts once, with its highest score; a null id sorts after all others and
    counts as one item. Groups of fewer than ``n`` items give all they have; an empty input gives an empty result.
    Columns of ``df`` beyond those passed play no part, whatever their names.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = df.sparkSession
    scratch = Scratch(spark, "topn")
    k1, k2 = common.wide_hash(*group)
    items = df.select(k1.alias("k1"), k2.alias("k2"), item.cast("long").alias("id"), score.cast("double").alias("sc"))
    items = items.where(F.col("sc").isNotNull() & ~F.isnan("sc"))
    edges = items.agg(F.percentile_approx("sc", [1 - s for s in shares], 1000).alias("q")).first()["q"] or []
    edges = sorted(set(edges), reverse=True)
    band = F.lit(len(edges))
    for b in reversed(range(len(edges))):
        band = F.when(F.col("sc") >= edges[b], F.lit(b)).otherwise(band)
    staged = items.groupBy("id", "k1", "k2").agg(F.max("sc").alias("sc")).withColumn("band", band)
    staged = scratch.write(staged, partition_by="band")

    order = Window.partitionBy("k1", "k2").orderBy(F.col("sc").desc(), F.col("id").asc_nulls_last())
    found: list[DataFrame] = []
    state: DataFrame | None = None
    for b in range(len(edges) + 1):
        rows = staged.where(F.col("band") == b).select("k1", "k2", "id", "sc")
        late = None
        if state is not None:
            filled = state.where(F.col("have") >= n).select("k1", "k2")
            if common.fits_broadcast(filled, KEY_BYTES):
                rows = rows.join(F.broadcast(filled), ["k1", "k2"], "left_anti")
            else:
                late = filled
        rows = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
        if late is not None:  # after the map-side limit, on the partitioning that the rank has already made
            rows = rows.join(late, ["k1", "k2"], "left_anti")
        if state is not None:
            rows = rows.join(state, ["k1", "k2"], "left").withColumn("r", F.col("r") + F.coalesce("have", F.lit(0)))
            rows = rows.where(F.col("r") <= n)
        done = scratch.write(rows.select("k1", "k2", "id", F.col("r").cast("int").alias("r")))
        found.append(done)
        if b < len(edges):
            have = done.groupBy("k1", "k2").agg(F.max("r").alias("have"))
            if state is not None:
                have = state.unionByName(have).groupBy("k1", "k2").agg(F.max("have").alias("have"))
            older, state = state, scratch.write(have)
            scratch.drop(older)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("id", F.col("r").alias("rnk"))
