"""All unordered pairs of rows without a cross join.

Rows are spread over blocks; every two blocks meet in one cell, and an equality join on the cell brings their rows
together. Each pair meets in exactly one cell, cells run in parallel, and no task sees more than two blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and blocks at least; each row is copied once per block and side.
BLOCK_ROWS, BLOCKS_LEAST = 2048, 8
#: Partitions of the cells, at most.
PARTITIONS_MOST = 10_000


def _blocks(df: DataFrame, order: str, blocks: int | None) -> tuple[DataFrame, int]:
    if blocks is None:
        blocks = max(BLOCKS_LEAST, -(-df.count() // BLOCK_ROWS))
    return df.select(F.pmod(F.xxhash64(order), F.lit(blocks)).cast("int").alias("own"), F.struct(*df.columns).alias("row")), blocks


def _partitions(blocks: int) -> int:
    # the work of a cell is in its pairs and not in its bytes, so partitions are set by number
    return min(PARTITIONS_MOST, blocks * (blocks + 1) // 2)


def cell_rows(df: DataFrame, order: str, blocks: int | None = None) -> DataFrame:
    """(i, j, right, row): the rows of both blocks of every cell, in the partition of the cell; block i is left, block j right."""
    rows, blocks = _blocks(df.where(F.col(order).isNotNull()), order, blocks)
    left = rows.select(F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("j"), F.lit(False).alias("right"), "row")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.lit(True).alias("right"), "row")
    cell = F.col("i") * F.lit(blocks) - (F.col("i") * (F.col("i") + 1) / 2).cast("int") + F.col("j")  # numbers of the cells, row by row
    many = _partitions(blocks)
    return left.unionByName(right).repartitionById(many, F.pmod(cell, F.lit(many)).cast("int"))


def all_pairs(df: DataFrame, order: str, blocks: int | None = None) -> DataFrame:
    """(a STRUCT, b STRUCT) of whole rows with ``a.order < b.order``; rows with a null order have no pairs."""
    rows, blocks = _blocks(df, order, blocks)
    last = F.lit(blocks - 1)
    left = rows.select(F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), last)).alias("j"), F.col("row").alias("x"))
    right = rows.select(F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.col("row").alias("y"))
    left = left.repartition(_partitions(blocks), "i", "j")
    x, y = F.col("x")[order], F.col("y")[order]
    # the copies are many times what the table's size promises, so no side may be broadcast
    met = left.hint("shuffle_merge").join(right, ["i", "j"]).where(((F.col("i") < F.col("j")) & (x != y)) | (x < y))
    return met.select(F.when(x < y, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(x < y, F.col("y")).otherwise(F.col("x")).alias("b"))
