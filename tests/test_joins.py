"""Joins whose keys may hold a large share of all rows."""

import pytest
from pyspark.sql import functions as F

from ticketscope.operators.joins import hot_keys, spread_join


@pytest.fixture
def shuffled(spark):
    """Settings under which every join shuffles and tasks stay as they are dealt."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.fixture
def rows(spark):
    values = [("hot", i) for i in range(300)] + [(f"k{i % 60}", i) for i in range(300, 600)] + [(None, 7)]
    return spark.createDataFrame(values, "key string, value int")


@pytest.mark.parametrize("how", ["inner", "left_semi", "left"])
def test_results_are_those_of_a_plain_join(spark, rows, shuffled, how):
    lookup = spark.createDataFrame([("hot", 1.0), ("k3", 2.0), ("k3", 3.0), ("none", 4.0), (None, 5.0)], "key string, x double")
    found = spread_join(rows, lookup, "key", how)
    plain = rows.join(lookup, "key", how)
    assert found.columns == plain.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert spread_join(rows.limit(0), lookup, "key", how).count() == 0


def test_only_hot_keys_are_dealt_and_repeated(spark, rows, shuffled):
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    assert [r.key for r in hot_keys(counts, "key", 601).collect()] == ["hot"]
    lookup = rows.select("key").distinct()
    found = spread_join(rows, lookup, "key", "inner").withColumn("task", F.spark_partition_id())
    tasks = {r.key: r.n for r in found.groupBy("key").agg(F.count_distinct("task").alias("n")).collect()}
    assert tasks.pop("hot") > shuffled // 2 and set(tasks.values()) == {1} and len(tasks) == 60
