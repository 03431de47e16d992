"""Connected components of pairwise matches, by deterministic Borůvka hooking.

Every component selects its smallest outgoing edge. With edges ordered by (smaller end, larger end) that edge leads to
the component's smallest neighbour, so a round is one aggregation with map-side combine, also for a hub that a third of
all edges touch. The selected edges form trees (the only cycles are two components that select each other; the
smaller becomes root), which collapse by pointer doubling; edges are relabelled to the roots, loops and repeats leave,
and rounds go on until no edge is left. Components at least halve per round.

A hub, the parent of a star and the root of a giant component are keys of very many rows on one side of a join and of one row on the
other. Their rows are spread over many tasks; tables with fewer rows than a hot key has are not looked through for any.

Vertices are 128-bit digests of their keys; the smallest key of a group comes from one aggregation at the end. The maps
of the rounds are composed from the last one back, each on a table at most half as large as the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import common


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def connected_groups(pairs: DataFrame, a: Column, b: Column, hot_rows: int = common.HOT_ROWS) -> DataFrame:
    """(record_key STRING, group_key STRING): one row per linked record; the smallest key of its group, in code points.

    ``a`` and ``b`` are the string keys of a link's ends. Links with a null end and links of a record with itself are
    no links; repeated and reversed links count once. A record without a link has no row; an empty input gives an empty
    result. The empty string is a key like any other. Other columns play no part.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "components")
    keyed = pairs.select(a.cast("string").alias("a"), b.cast("string").alias("b")).where(F.col("a") != F.col("b"))
    keyed = scratch.write(keyed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = keyed.select(F.explode(F.array("a", "b")).alias("key")).distinct().select(_digest(F.col("key")).alias("v"), "key")
    u, v = _digest(F.col("a")), _digest(F.col("b"))
    edges, seen = scratch.measured(keyed.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")), n=F.count("*"))

    rounds: list[tuple[DataFrame, int]] = []
    while seen["n"]:
        roots, many = _forest(scratch, edges, hot_rows)
        rounds.append((roots, many))
        moved = edges
        for x in "uv":
            heavy = _heavy(moved, x, seen["n"], hot_rows)
            moved = _join(moved, roots.select(F.col("u").alias(x), F.col("p").alias(f"r{x}")), x, heavy, hot_rows)
        moved = moved.where(F.col("ru") != F.col("rv")).select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        older = edges
        edges, seen = scratch.measured(moved, n=F.count("*"))
        scratch.drop(older)
    if not rounds:
        return keyed.select(F.col("a").alias("record_key"), F.col("b").alias("group_key")).limit(0)

    label = rounds[-1][0]
    for earlier, many in reversed(rounds[:-1]):
        later = label.select(F.col("u").alias("p"), F.col("p").alias("root"))
        composed = _join(earlier, later, "p", _heavy(earlier, "p", many, hot_rows), hot_rows, "left")
        label = scratch.write(composed.select("u", F.coalesce("root", "p").alias("p")))
    member = scratch.write(names.join(label, names["v"] == label["u"]).select("key", F.col("p").alias("root")))
    least = member.groupBy("root").agg(F.min("key").alias("group_key"), F.count("*").alias("n"))
    if rounds[0][1] > hot_rows:
        least = scratch.write(least)
        out = common.split_join(member, least.drop("n"), ["root"], least.select("root", "n"), hot_rows=hot_rows)
    else:
        out = member.join(least, "root")
    return out.select(F.col("key").alias("record_key"), "group_key")


def _heavy(df: DataFrame, key: str, rows: int, hot_rows: int) -> DataFrame | None:
    """Rows per key, counted with map-side combine; nothing where no key can have more than ``hot_rows``."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows) if rows > hot_rows else None


def _join(many: DataFrame, few: DataFrame, key: str, heavy: DataFrame | None, hot_rows: int, how: str = "inner") -> DataFrame:
    return many.join(few, key, how) if heavy is None else common.split_join(many, few, [key], heavy, how, hot_rows)


def _forest(scratch: Scratch, edges: DataFrame, hot_rows: int) -> tuple[DataFrame, int]:
    """(u, p): each component and the root of the tree it is hooked into; and how many components there are."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hook, seen = scratch.measured(both.groupBy("u").agg(F.min("v").alias("p")), n=F.count("*"))
    many, first = seen["n"], True
    while True:
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("gp"))
        step = _join(hook.select("u", "p"), up, "p", _heavy(hook, "p", many, hot_rows), hot_rows).select("u", F.col("p").alias("old"), F.col("gp"))
        if first:  # two components that selected each other: the smaller one becomes the root
            step = step.withColumn("gp", F.when(F.col("gp") == F.col("u"), F.least("u", "old")).otherwise(F.col("gp")))
        step = step.select("u", F.col("gp").alias("p"), (F.col("gp") != F.col("old")).alias("moved"))
        step, seen = scratch.measured(step, moved=F.coalesce(F.max(F.col("moved").cast("int")), F.lit(0)))
        scratch.drop(hook)
        done = not first and not seen["moved"]
        hook, first = step, False
        if done:
            return step.select("u", "p"), many
