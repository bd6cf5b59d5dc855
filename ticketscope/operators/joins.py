"""A join for keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Salts of a hot key for each task of a shuffle: with one, hashing would leave a third of the tasks without any.
SALTS_PER_TASK = 4


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, key: str, total: int | Column) -> DataFrame:
    """Keys that hold more than one task's even share of ``total`` rows.

    ``counts`` has the number ``n`` of rows of each key. There are fewer such keys than tasks of a
    shuffle, whatever the data.
    """
    limit = F.lit(total) if isinstance(total, int) else total
    return counts.filter(F.col("n") * _tasks(counts) > limit).select(key)


def spread_join(
    rows: DataFrame, lookup: DataFrame, key: str, how: str = "left_semi", hot: DataFrame | None = None
) -> DataFrame:
    """Join of very many ``rows`` per key with few ``lookup`` rows per key.

    Rows of a hot key take one salt each and its lookup rows are repeated once per salt, so that it
    is shared by the tasks of a shuffle; all other rows have salt 0 and nothing of theirs is
    repeated. ``hot`` are the hot keys, as ``hot_keys`` finds them; without it they are counted.
    They are fewer than the tasks of a shuffle, so they are broadcast. The salt also makes
    Spark shuffle both sides for this join alone, and only such joins are split further by
    adaptive execution: a side that arrives partitioned by key from an aggregation is not.

    The salt is a hash of the row's own columns: it is the same when a task runs again and does not
    depend on how the rows were read.
    """
    salts = SALTS_PER_TASK * _tasks(rows)
    if hot is None:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        hot = hot_keys(counts, key, counts.agg(F.sum("n")).scalar())
    marks = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    own = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    salted = rows.join(marks, key, "left").withColumn("_salt", F.when(F.col("_hot"), own).otherwise(0))
    repeated = lookup.join(marks, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))
    )
    return salted.drop("_hot").join(repeated.drop("_hot"), [key, "_salt"], how).drop("_salt")
