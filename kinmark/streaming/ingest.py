"""Birthmarks of modules as they arrive: the batch plan on a file stream.

Extraction is an expression on each row (frequencies aside, which aggregate), so a stream of files needs no state:
every file that lands in the folder is parsed once, and its birthmarks go to the sink exactly once per checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import FatalError
from ..operators import extract as ops
from ..sources import ir_text


def modules_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Parsed modules (src_idx, path, functions, error) of the ``.ll`` files of a folder, as a stream."""
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.ll").option("maxFilesPerTrigger", files_per_batch)
    text = reader.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return ir_text.parse(text).withColumn("src_idx", F.xxhash64("path")).drop("content")


def extract_stream(spark: SparkSession, folder: str, btype: str, mode: str) -> DataFrame:
    """Birthmarks of the parsable modules of a folder, as a stream; types that need no aggregation."""
    if btype in ops._COUNTED:
        raise FatalError(f"{btype} is counted; use batches (see write_stream)")
    return ops.extract(modules_stream(spark, folder).where(F.col("error").isNull()), btype, mode)


def write_stream(spark: SparkSession, folder: str, btype: str, mode: str, dest: str, checkpoint: str, errors: str | None = None) -> StreamingQuery:
    """Runs what is there through to parquet, batch by batch; every type, since a module is whole within its batch.

    Modules that can't be parsed go to the table ``errors`` (path, error), by default beside ``dest``.
    """
    errors = errors or dest.rstrip("/") + "_errors"

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read twice
        try:
            ops.extract(batch.where(F.col("error").isNull()), btype, mode).write.mode("overwrite").parquet(f"{dest}/batch={number}")
            batch.where(F.col("error").isNotNull()).select("path", "error").write.mode("overwrite").parquet(f"{errors}/batch={number}")
        finally:
            batch.unpersist()

    stream = modules_stream(spark, folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()
