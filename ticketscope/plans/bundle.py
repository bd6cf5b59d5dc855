"""Export of the summary, all reports and the tickets in one folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ticketscope.config import DEFAULT_CONFIG, ROLLUP_FOLDER, Config
from ticketscope.operators.filters import TicketFilter, apply_filters
from ticketscope.operators.normalize import derive, with_inner_names
from ticketscope.operators.rollup import sites_of, ticket_rollup
from ticketscope.operators.summary import sheet_of
from ticketscope.plans.reports import REPORTS, run_report
from ticketscope.sources.writers import export, export_tickets


def export_everything(
    tickets: DataFrame,
    path: str,
    as_of: datetime | str,
    conditions: TicketFilter = TicketFilter(),
    config: Config = DEFAULT_CONFIG,
    format: str = "csv",
    mode: str = "errorifexists",
) -> dict[str, int]:
    """Write eleven datasets below ``path`` and return how many rows each has.

    The filtered tickets are written first, as Parquet in ``tickets``, so that cleaning and
    filtering run once. One aggregation of that copy, a rollup kept in ``tickets/_rollup``, then gives the summary and
    seven reports; only what has a row per ticket (``raw_data``, ``resolution_tracking``,
    ``incident_details``) reads the copy again: it is scanned four times for eleven datasets. A lost executor costs no
    more than the scan of a few files. ``path`` must be on storage that all executors share. A report
    without rows leaves a folder without rows and counts 0. The active filters are recorded
    in ``filters``.
    """
    datasets = stored_bundle(tickets, path, as_of, conditions, config, mode)
    counts = {}
    for name, data in datasets.items():
        written = Observation(name)
        export(
            data.observe(written, F.count(F.lit(1)).alias("rows")), f"{path}/{name}", format, mode
        )
        counts[name] = written.get["rows"]
    lines = tickets.sparkSession.createDataFrame([(line,) for line in conditions.describe()], "filter string")
    export(lines.coalesce(1), f"{path}/filters", format, mode)
    return counts


def stored_bundle(
    tickets: DataFrame,
    path: str,
    as_of: datetime | str,
    conditions: TicketFilter = TicketFilter(),
    config: Config = DEFAULT_CONFIG,
    mode: str = "errorifexists",
) -> dict[str, DataFrame]:
    """Write the filtered tickets and their rollup below ``path``; the datasets over this copy by name."""
    spark = tickets.sparkSession
    raw_path = f"{path}/tickets"
    export_tickets(apply_filters(tickets, conditions), raw_path, "parquet", mode)
    stored = spark.read.parquet(raw_path)
    filtered = derive(with_inner_names(stored), as_of)

    ticket_rollup(filtered, labels=True).write.mode(mode).parquet(f"{raw_path}/{ROLLUP_FOLDER}")
    rollup = spark.read.parquet(f"{raw_path}/{ROLLUP_FOLDER}")
    return bundle(stored, filtered, rollup, as_of, config)


def bundle(
    stored: DataFrame, filtered: DataFrame, rollup: DataFrame, as_of: datetime | str, config: Config
) -> dict[str, DataFrame]:
    """The eleven datasets by name: from the rollup (with labels) where it has what they need.

    ``filtered`` are stored tickets, so that a sort may read them twice.
    """
    sheet = sheet_of(sites_of(rollup), as_of).orderBy("position")
    reports = {
        name: run_report(name, filtered, as_of, config, as_text=True, rollup=rollup, copied=True)
        for name in REPORTS
    }
    return {"raw_data": stored, "summary": sheet, **reports}
