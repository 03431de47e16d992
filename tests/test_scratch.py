import os

import pytest

from kinmark import scratch
from kinmark.errors import FatalError


class _Session:
    """A session off local mode, as far as the choice of a folder looks at it."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = settings

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(FatalError, match="spark.checkpoint.dir"):
        scratch.shared_folder(_Session(**{"spark.master": master}))
    assert scratch.shared_folder(_Session(**{"spark.master": master, "spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]", "local[2,3]"])
def test_local_mode_makes_its_own(master):
    assert scratch.shared_folder(_Session(**{"spark.master": master})).startswith("file://")


def test_nothing_is_left(spark):
    folder = scratch.shared_folder(spark).removeprefix("file://")
    s = scratch.Scratch(spark, "left")
    a, b = s.write(spark.range(5)), s.write(spark.range(6))
    assert (a.count(), b.count()) == (5, 6)
    from pyspark.sql import functions as F

    c, seen = s.measured(spark.range(7).where("id > 3"), n=F.count("*"), most=F.max("id"))
    assert c.count() == 3 and seen == {"n": 3, "most": 6}
    d, seen = s.measured(spark.range(7).where("id > 30"), n=F.count("*"))
    assert d.isEmpty() and seen == {"n": 0}
    s.drop(a)
    with pytest.raises(Exception):
        spark.read.parquet(f"{s.root}/1").count()
    scratch.release()
    assert not [n for n in os.listdir(folder) if n.startswith("kinmark-left")]
