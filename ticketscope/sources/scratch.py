"""Intermediate results in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str | None:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = tempfile.gettempdir()
    return base


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it uses a temporary folder.
    """
    base = _base(spark)
    if not base:
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read again: no lineage, nothing is redone."""
    path = shared_folder(rows.sparkSession) + ".parquet"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stored_if_shared(rows: DataFrame) -> DataFrame:
    """``stored`` where there is a shared folder, else ``rows`` as they are."""
    return stored(rows) if _base(rows.sparkSession) else rows
