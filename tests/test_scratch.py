"""Tables in the shared folder and joins on counted keys."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from kithspark import scratch


def test_a_cluster_needs_a_shared_folder():
    fake = lambda at, master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: at, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.scratch_dir(fake(None, "spark://host:7077"))
    assert scratch.scratch_dir(fake("file:///x/", "spark://host:7077")) == "file:///x"
    assert os.path.isdir(scratch.scratch_dir(fake(None, "local[2]")))


def test_tables_go(spark):
    before = scratch.written()
    a = scratch.cut(spark.range(5))
    b = scratch.cut_last(a.filter("id > 1"), before)
    assert b.count() == 3 and len(scratch.written() - before) == 1
    scratch.drop_scratch(list(scratch.written() - before))
    assert scratch.written() == before


@pytest.mark.parametrize("share", [0, 3])
def test_join_on_hot_keys(spark, share):
    """A third of all rows on one key: the same rows as a plain join, and the hot key's stay out of the shuffle."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % max(share, 1) == (0 if share else -1), 7).otherwise(F.col("id") % 5000 + 100).alias("k"))
    counted = scratch.cut(rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 2").withColumn("first", F.col("k") * 10))
    got = scratch.join_counted(rows, counted, "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(counted.drop("n"), "k").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("Union" in plan) == bool(share)
    assert scratch.join_counted(rows.limit(0), counted.limit(0), "k").count() == 0
