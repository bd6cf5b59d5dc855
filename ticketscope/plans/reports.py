"""The nine reports by name: typed rows, order, display text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.config import DEFAULT_CONFIG, Config
from ticketscope.operators import category_reports, site_reports, ticket_reports
from ticketscope.operators.normalize import require_number
from ticketscope.operators.rollup import LABELS, sites_of
from ticketscope.plans import display
from ticketscope.sources.scratch import stored_if_shared


@dataclass(frozen=True)
class Report:
    """``build`` makes typed rows without sorting them, so that they can feed other steps.

    ``one_row_per_ticket`` marks reports that can hold any number of identical rows.
    """

    build: Callable[[DataFrame, datetime | str, Config], DataFrame]
    order: Callable[[], list[Column]]
    show: display.Display
    one_row_per_ticket: bool = False
    # The same rows from a rollup (``ticket_rollup``), with labels if the report has categories.
    from_rollup: Callable[[DataFrame, datetime | str, Config], DataFrame] | None = None
    labels: bool = False


def _of_sites(build: Callable[[DataFrame, datetime | str, Config], DataFrame]):
    return lambda rollup, as_of, config: build(sites_of(rollup), as_of, config)


def _by(*names: str) -> Callable[[], list[Column]]:
    """Order by columns, ``-`` in front for descending; missing values come last."""
    return lambda: [
        F.col(n[1:]).desc_nulls_last() if n.startswith("-") else F.col(n).asc_nulls_last()
        for n in names
    ]


# The last columns of each order are the keys of the report, so no tie is left to chance.
REPORTS = {
    "critical_hotspots": Report(
        site_reports.critical_hotspots,
        _by("-critical_count", "-latest_incident", "site", "company"),
        display.hotspots,
        from_rollup=site_reports.hotspots_of,
    ),
    "site_scorecard": Report(
        site_reports.site_scorecard,
        _by("-critical_pct", "-avg_mttr_hours", "site", "company"),
        display.scorecard,
        from_rollup=_of_sites(site_reports.scorecard_of),
    ),
    "green_list": Report(
        site_reports.green_list,
        _by("-total_non_critical", "site", "company"),
        display.green,
        from_rollup=_of_sites(site_reports.green_of),
    ),
    "franchise_overview": Report(
        site_reports.franchise_overview,
        _by("performance_score", "company"),
        display.franchise,
        from_rollup=_of_sites(site_reports.franchise_of),
    ),
    "equipment_analysis": Report(
        category_reports.equipment_analysis,
        _by("-total_count", "category", "subcategory"),
        display.equipment,
        from_rollup=category_reports.equipment_of,
        labels=True,
    ),
    "repeat_offenders": Report(
        category_reports.repeat_offenders,
        _by("-pattern_score", "site", "company", "category"),
        display.repeats,
        from_rollup=category_reports.repeats_of,
        labels=True,
    ),
    "resolution_tracking": Report(
        ticket_reports.resolution_tracking,
        _by("-days_overdue", "number", "site"),
        display.resolution,
        one_row_per_ticket=True,
    ),
    "workload_trends": Report(
        ticket_reports.workload_trends,
        _by("-week_start"),
        display.trends,
        from_rollup=ticket_reports.trends_of,
    ),
    "incident_details": Report(
        ticket_reports.incident_details,
        _by("site", "-created", "number", "company", "resolved"),
        display.incidents,
        one_row_per_ticket=True,
    ),
}


def sort_report(name: str, rows: DataFrame, copied: bool = False) -> DataFrame:
    """Put report rows in the order people read them.

    A global sort reads its input twice. Rows per ticket are stored first, so that joins and cleaning run once,
    unless the tickets are a stored copy (``copied``) or there is no folder that all executors share.
    In these reports the number of the reading task is the last sort key: it lets
    the sort split identical rows, which all would go to one task otherwise.
    """
    report = REPORTS[name]
    if not report.one_row_per_ticket:
        return rows.orderBy(*report.order())
    if not copied:
        rows = stored_if_shared(rows)
    tasks = rows.withColumn("_task", F.spark_partition_id())
    return tasks.orderBy(*report.order(), "_task").drop("_task")


def run_report(
    name: str,
    tickets: DataFrame,
    as_of: datetime | str,
    config: Config = DEFAULT_CONFIG,
    ordered: bool = True,
    as_text: bool = False,
    rollup: DataFrame | None = None,
    copied: bool = False,
) -> DataFrame:
    """Build a report over (filtered) tickets, or over their ``rollup`` if the report can use it.

    ``ordered=False`` saves the global sort where the rows are processed further. The text
    columns are made after the sort, so the sort moves typed values. ``copied`` says that the tickets
    are a stored copy, cheap to read twice.
    """
    if name not in REPORTS:
        raise ValueError(f"Unknown report {name!r}; known: {', '.join(REPORTS)}")
    report = REPORTS[name]
    if rollup is not None and report.from_rollup and (not report.labels or LABELS[0] in rollup.columns):
        require_number(tickets)
        rows = report.from_rollup(rollup, as_of, config)
    else:
        rows = report.build(tickets, as_of, config)
    if ordered:
        rows = sort_report(name, rows, copied)
    return REPORTS[name].show(rows, config) if as_text else rows
