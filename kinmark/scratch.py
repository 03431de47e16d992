"""Intermediate tables in the cluster's shared folder.

Iterative plans cut their lineage by writing a parquet table and reading it back: it survives the loss of any
executor, is compressed and column-pruned on the next read, and can be deleted as soon as it is superseded.
"""

from __future__ import annotations

import atexit
import logging
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from .errors import FatalError

SETTING = "spark.checkpoint.dir"
log = logging.getLogger(__name__)
_ROOTS: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one where it is unset in local mode.

    Elsewhere a missing setting is an error: each executor would write to a disk of its own, and rows would be lost.
    """
    folder = spark.conf.get(SETTING, None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise FatalError(f"{SETTING} must name a folder that all executors share (master {master})")
        folder = "file://" + tempfile.mkdtemp(prefix="kinmark-")
        spark.conf.set(SETTING, folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    if path.startswith("file:/"):  # local mode; also after the session has ended
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as e:  # a leftover costs disk, never a result
        log.warning("could not delete %s: %s", path, e)


def release() -> None:
    """Deletes all tables of this process; no result that reads them may be in use."""
    while _ROOTS:
        _delete(*_ROOTS.pop())


atexit.register(release)


class Scratch:
    """Written tables of one operator run; those still there at ``release`` or the end of the process are deleted then."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = os.path.join(shared_folder(spark), f"kinmark-{label}-{uuid.uuid4().hex[:12]}")
        self._paths: dict[int, str] = {}
        self._n = 0
        _ROOTS.append((spark, self.root))

    def write(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Writes ``df`` and returns the table as read back."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        back._kinmark_scratch = self  # keeps the id unique while the frame lives
        return back

    def measured(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """As ``write``, with aggregates over the rows that are taken while they are written: no job of their own."""
        seen = Observation()
        back = self.write(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]))
        return back, seen.get

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes superseded tables; they must not be read again."""
        for t in tables:
            path = self._paths.pop(id(t), None) if t is not None else None
            if path:
                _delete(self.spark, path)
