"""Writing reports and tickets."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.config import DAY_COLUMN, DERIVED_COLUMNS, LOAD_COLUMN, ROLLUP_FOLDER, SKETCH_FOLDER
from ticketscope.operators.normalize import derive, without_derived
from ticketscope.operators.rollup import ticket_rollup
from ticketscope.operators.sketches import ticket_sketches

_OPTIONS = {
    "csv": {
        "header": True,
        "quote": '"',
        "escape": '"',
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    },
    "json": {},
    "parquet": {},
}


def export(data: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> None:
    """Write a report or any other frame as a folder of files.

    Text formats get times as ``2025-06-02 09:24:00``, which ``read_tickets`` can load again.
    """
    if format not in _OPTIONS:
        raise ValueError(f"Unsupported format {format!r}")
    if format != "parquet":
        times = [name for name, kind in data.dtypes if kind == "timestamp_ntz"]
        data = data.withColumns({name: F.col(f"`{name}`").cast("string") for name in times})
    data.write.format(format).options(**_OPTIONS[format]).mode(mode).save(path)


def selected_rows(report: DataFrame, keys: DataFrame, key_columns: Sequence[str]) -> DataFrame:
    """Rows of a report whose key occurs in ``keys``; Spark picks the join by the size of ``keys``."""
    return report.join(keys.select(*key_columns), list(key_columns), "left_semi")


def export_selected(
    report: DataFrame,
    keys: DataFrame,
    key_columns: Sequence[str],
    path: str,
    format: str = "csv",
    mode: str = "errorifexists",
) -> None:
    """Write only the chosen rows of a report."""
    export(selected_rows(report, keys, key_columns), path, format, mode)


def export_tickets(
    tickets: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists"
) -> None:
    """Write (filtered) tickets under their file headers, without the derived columns."""
    export(without_derived(tickets), path, format, mode)


def store_tickets(
    tickets: DataFrame, path: str, mode: str = "errorifexists", sites: int = 20_000,
    parquet: Mapping[str, str] | None = None,
) -> str:
    """Store clean tickets as Parquet, partitioned by day of creation, for ``read_stored``.

    Date filters then read only the days they need. The rows are rebalanced by day: adaptive
    execution joins small days in a task and splits large ones over several tasks and files.
    Within a file rows are sorted by site, so that page and row group statistics separate sites, and row groups carry a
    Bloom filter on the site, made for up to ``sites`` different ones: a filter on a site skips
    what cannot hold it. Derived columns are left out: they depend on the moment that counts as
    "now".

    A rollup and sketches of the same tickets go to folders beside the days (``_rollup`` and
    ``_sketches``). ``append`` adds the new tickets' own; readers merge them. If a load fails
    between the tickets and these, ``rebuild_rollup`` makes them anew.

    Returns the name of this load, which its rows carry in a column that readers leave out.
    """
    spark, load = tickets.sparkSession, uuid.uuid4().hex
    if mode == "ignore" and _exists(spark, path):
        return load
    by_day = tickets.drop(*DERIVED_COLUMNS).withColumns(
        {DAY_COLUMN: F.col("created").cast("date"), LOAD_COLUMN: F.lit(load)}
    )
    spread = by_day.hint("rebalance", DAY_COLUMN).sortWithinPartitions(DAY_COLUMN, "site", "created")
    options = {
        "parquet.bloom.filter.enabled#site": "true", "parquet.bloom.filter.expected.ndv#site": str(sites),
        "parquet.bloom.filter.adaptive.enabled": "true", **(parquet or {}),
    }
    spread.write.partitionBy(DAY_COLUMN).options(**options).mode(mode).parquet(path)
    _store_rollup(derive(rows_of_load(spread, path, load), _ANY_TIME), path, mode)
    return load


def rows_of_load(like: DataFrame, path: str, load: str) -> DataFrame:
    """What one load has stored; ``like`` has its columns, as a load may have no rows."""
    stored = like.sparkSession.read.schema(like.schema).parquet(path)
    return stored.filter(F.col(LOAD_COLUMN) == load)


# Rollups hold nothing that depends on the moment that counts as "now".
_ANY_TIME = "2000-01-01"


def rebuild_rollup(spark: SparkSession, path: str) -> None:
    """Make the rollup and the sketches of stored tickets anew."""
    _store_rollup(derive(spark.read.parquet(path), _ANY_TIME), path, "overwrite")


def _store_rollup(tickets: DataFrame, path: str, mode: str) -> None:
    ticket_rollup(tickets).sortWithinPartitions(DAY_COLUMN, "site").write.mode(mode).parquet(
        f"{path}/{ROLLUP_FOLDER}"
    )
    ticket_sketches(tickets).write.mode(mode).parquet(f"{path}/{SKETCH_FOLDER}")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True
