"""Reports with a row per ticket or per week."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketscope.config import DAY_COLUMN, DEFAULT_CONFIG, Config
from ticketscope.functions.dates import timestamp_literal, week_start, whole_days_between
from ticketscope.functions.numbers import percent, round1
from ticketscope.operators.normalize import require_number
from ticketscope.operators.rollup import merged

# Weekday names, Monday first.
_WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _number_or_null(tickets: DataFrame) -> Column:
    found = "number" in tickets.columns
    return (F.col("number") if found else F.lit(None).cast("string")).alias("number")


def incident_details(
    tickets: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG
) -> DataFrame:
    """One row per ticket with a short description and one category label."""
    text = F.col("short_description")
    category = F.when(F.col("category") != "", F.col("category")).otherwise(F.lit("Other"))
    subcategory = F.when(
        F.col("subcategory") != "", F.concat(F.lit(" - "), F.col("subcategory"))
    ).otherwise(F.lit(""))
    return tickets.select(
        "site",
        _number_or_null(tickets),
        F.when(F.length(text) > 60, F.concat(F.substring(text, 1, 57), F.lit("...")))
        .when(text != "", text)
        .otherwise(F.lit("No description"))
        .alias("description"),
        F.concat(category, subcategory).alias("category_label"),
        "priority",
        "created",
        "resolved",
        "resolution_hours",
        F.when(
            ~F.col("is_resolved"), whole_days_between(F.col("created"), timestamp_literal(as_of))
        ).alias("days_open"),
        F.when(F.col("is_resolved"), "Resolved").otherwise("Open").alias("status"),
        "company",
    )


def site_drill_down(
    tickets: DataFrame, site: str, as_of: datetime | str, config: Config = DEFAULT_CONFIG
) -> DataFrame:
    """``incident_details`` of one site."""
    return incident_details(tickets.filter(F.col("site") == site), as_of, config)


def with_sample_tickets(report: DataFrame, tickets: DataFrame) -> DataFrame:
    """Add up to three ticket numbers of its site to each row of a report.

    The numbers are the earliest ones. The limit is applied before and after the shuffle, so a
    large site sends at most three rows per task. The report is computed once: sites that it lacks
    fall out in the join with it.
    """
    require_number(tickets)
    if "site" not in report.columns:
        raise ValueError("Sample tickets need a report with a site column")
    earliest = W.partitionBy("site").orderBy(F.col("created").asc_nulls_last(), "number")
    samples = (
        tickets.filter(F.col("number").isNotNull())
        .select("site", "created", "number", F.row_number().over(earliest).alias("place"))
        .filter(F.col("place") <= 3)
        .groupBy("site")
        .agg(F.array_sort(F.collect_list(F.struct("place", "number"))).alias("shown"))
        .select("site", F.col("shown.number").alias("shown"))
    )
    sizes = tickets.groupBy("site").agg(F.count(F.lit(1)).alias("site_rows"))
    more = F.when(
        (F.size("shown") == 3) & (F.col("site_rows") > 3),
        F.concat(F.lit(" (+"), (F.col("site_rows") - 3).cast("string"), F.lit(" more)")),
    ).otherwise(F.lit(""))
    text = (
        F.when(F.col("site_rows").isNull(), "No tickets")
        .when(F.col("shown").isNull(), "No ticket #s")
        .otherwise(F.concat(F.array_join("shown", ", "), more))
    )
    lookup = sizes.join(samples, "site", "left")
    return report.join(lookup, "site", "left").select(
        *report.columns, text.alias("sample_tickets")
    )


def resolution_tracking(
    tickets: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG
) -> DataFrame:
    """Resolved tickets that took longer than the target of their priority."""
    target = F.lit(None).cast("double")
    if config.mttr_targets:
        pairs = [F.lit(x) for p, hours in config.mttr_targets.items() for x in (p, float(hours))]
        target = F.try_element_at(F.create_map(*pairs), F.col("priority"))
    overdue = F.col("resolution_hours") - F.col("target_hours")
    # One comparison says it all: open tickets have no hours, other priorities no target.
    return (
        tickets.withColumn("target_hours", target)
        .filter(F.col("resolution_hours") > F.col("target_hours"))
        .select(
            "site",
            _number_or_null(tickets),
            "priority",
            "resolution_hours",
            "target_hours",
            F.lit("Missed SLA").alias("sla_status"),
            (overdue / 24).alias("days_overdue"),
        )
    )


def workload_trends(
    tickets: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG
) -> DataFrame:
    """Tickets per week of creation; weeks without tickets do not appear.

    ``resolved_of_created`` counts tickets created in the week that are resolved by now, and
    the backlog change is new tickets minus those. The peak day is the most frequent weekday,
    the earliest one on a tie.
    """
    require_number(tickets)
    by_day = (
        tickets.filter(F.col("created").isNotNull())
        .groupBy(
            week_start(F.col("created")).alias("week_start"),
            F.weekday(F.col("created").cast("date")).alias("weekday"),
        )
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("number").alias("numbered"),
            F.count_if("is_critical").alias("critical"),
            F.count_if("is_resolved").alias("resolved"),
        )
    )
    return _weeks(by_day)


def trends_of(rollup: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG) -> DataFrame:
    """``workload_trends`` of the tickets behind a rollup."""
    days = merged(rollup.filter(F.col(DAY_COLUMN).isNotNull()), DAY_COLUMN)
    return _weeks(days.select(
        week_start(F.col(DAY_COLUMN)).alias("week_start"), F.weekday(DAY_COLUMN).alias("weekday"),
        F.col("tickets").alias("rows"), "numbered", "critical", "resolved",
    ))


def _weeks(by_day: DataFrame) -> DataFrame:
    weeks = by_day.groupBy("week_start").agg(
        F.sum("numbered").alias("new_tickets"),
        F.sum("critical").alias("critical_count"),
        F.sum("resolved").alias("resolved_of_created"),
        F.min_by("weekday", F.struct(-F.col("rows"), "weekday")).alias("peak_weekday"),
    )
    names = F.array(*[F.lit(day) for day in _WEEKDAYS])
    return weeks.select(
        "week_start",
        "new_tickets",
        "critical_count",
        round1(percent(F.col("critical_count"), F.col("new_tickets"))).alias("critical_pct"),
        "resolved_of_created",
        round1(percent(F.col("resolved_of_created"), F.col("new_tickets"))).alias(
            "resolution_pct"
        ),
        (F.col("new_tickets") - F.col("resolved_of_created")).alias("backlog_change"),
        F.element_at(names, F.col("peak_weekday") + 1).alias("peak_day"),
    )
