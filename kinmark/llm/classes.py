"""Pairs of records where many may be exact copies: classes of copies, links between classes, and what they mean for records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import common

#: Records of a class that are paired up together.
BLOCK = 1000


@dataclass
class Classes:
    """``members`` (record, cls): each record once, with the least record of its class. ``links`` (a, b), a < b: linked classes, each once."""

    scratch: Scratch
    members: DataFrame
    links: DataFrame | None = None

    @staticmethod
    def of(scratch: Scratch, rows: DataFrame, hot_rows: int = common.HOT_ROWS) -> Classes:
        """The classes of rows (record, s1, s2) with equal content (s1, s2)."""
        rows = rows.distinct()
        least = scratch.write(rows.groupBy("s1", "s2").agg(F.min("record").alias("cls"), F.count("*").alias("n")))
        few = least.where("n > 1")
        # a class of one names itself; only records that have copies need the join, and its hot keys are split
        some = common.split_join(rows, few.select("s1", "s2", "cls"), ["s1", "s2"], few.select("s1", "s2", "n"), "left", hot_rows)
        return Classes(scratch, scratch.write(some.select("record", F.coalesce("cls", "record").alias("cls"))))

    def rows(self) -> DataFrame:
        """(record, cls, copies, links): one row per record; how many records its class has and to how many other classes it is linked."""
        sizes = self.members.groupBy("cls").agg(F.count("*").alias("copies"))
        each = self.links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
        told = self.scratch.write(sizes.join(each, "cls", "left").select("cls", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links")))
        return common.split_join(self.members, told, ["cls"], told.select("cls", F.col("copies").alias("n"))).select("record", "cls", "copies", "links")

    def pairs(self, block: int = BLOCK) -> DataFrame:
        """(a, b), a < b: all pairs of records of one class or of linked classes.

        The records of a class meet in blocks, so no task pairs up a large class alone; n copies give n (n - 1) / 2 rows.
        """
        zero = F.lit(0).cast("long")
        sizes = self.members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1")
        sizes = self.scratch.write(sizes.withColumn("many", F.ceil(F.col("n") / F.lit(block))))
        large = sizes.where("many > 1").select("cls", "n", "many")
        some = not large.isEmpty()
        one = F.coalesce("many", F.lit(1).cast("long"))
        parts = lambda first, many: F.explode(F.sequence(first, many - 1))

        blocks = self.members.withColumn("many", F.lit(1).cast("long"))
        if some:
            blocks = common.split_join(self.members, large.select("cls", "many"), ["cls"], large.select("cls", "n"), "left")
        blocks = blocks.withColumn("part", F.pmod(F.xxhash64("record"), one))
        blocks = self.scratch.write(blocks.groupBy("cls", "part").agg(F.collect_list("record").alias("ids")))
        between = self.links.withColumns({"p": zero, "q": zero})
        if some:
            for x, k in (("a", "p"), ("b", "q")):
                between = between.drop(k).join(large.select(F.col("cls").alias(x), "many"), x, "left").withColumn(k, parts(zero, one)).drop("many")
        own = sizes.withColumn("p", parts(zero, F.col("many"))).withColumn("q", parts(F.col("p"), F.col("many")))
        own = own.select(F.col("cls").alias("a"), F.col("cls").alias("b"), "p", "q", (F.col("p") == F.col("q")).alias("same"))
        cells = between.select("a", "b", "p", "q", F.lit(False).alias("same")).unionByName(own)
        side = lambda x, k, ids: blocks.select(F.col("cls").alias(x), F.col("part").alias(k), F.col("ids").alias(ids))
        cells = cells.join(side("a", "p", "xs"), ["a", "p"]).join(side("b", "q", "ys"), ["b", "q"])
        each = cells.select("same", F.explode("xs").alias("x"), "ys").select("same", "x", F.explode("ys").alias("y"))
        return each.where(~F.col("same") | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
