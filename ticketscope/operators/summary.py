"""One-row figures about a whole frame, all taken from the site rollup."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.functions.dates import day_text, seconds_between
from ticketscope.functions.numbers import mean_hours, percent, printed1, round1, text1
from ticketscope.operators.rollup import overall, site_rollup


def report_summary(tickets: DataFrame) -> DataFrame:
    """Totals, shares, date range and mean hours, rounded."""
    return summary_of(site_rollup(tickets))


def summary_of(sites: DataFrame) -> DataFrame:
    """``report_summary`` of a site rollup."""
    figures = overall(sites)
    return figures.select(
        F.col("tickets").alias("total_tickets"),
        F.col("critical").alias("critical_tickets"),
        F.coalesce(round1(percent(F.col("critical"), F.col("tickets"))), F.lit(0.0)).alias(
            "critical_pct"
        ),
        F.col("resolved").alias("resolved_tickets"),
        F.coalesce(round1(percent(F.col("resolved"), F.col("tickets"))), F.lit(0.0)).alias(
            "resolution_rate"
        ),
        F.col("sites").alias("unique_sites"),
        F.col("companies").alias("unique_companies"),
        "first_created",
        "last_created",
        round1(mean_hours(F.col("resolution_seconds"), F.col("measured"))).alias("avg_mttr_hours"),
    )


def filtered_count(filtered: DataFrame) -> DataFrame:
    """Number of tickets and critical tickets under the current filter, and a status text."""
    counts = filtered.agg(
        F.count(F.lit(1)).alias("total_tickets"),
        F.count_if("is_critical").alias("critical_tickets"),
    )
    return _with_status(counts)


def count_of(sites: DataFrame) -> DataFrame:
    """``filtered_count`` of a site rollup."""
    return _with_status(overall(sites).select(
        F.col("tickets").alias("total_tickets"), F.col("critical").alias("critical_tickets")
    ))


def _with_status(counts: DataFrame) -> DataFrame:
    critical = F.when(
        F.col("critical_tickets") > 0,
        F.concat(F.lit(" ("), F.col("critical_tickets").cast("string"), F.lit(" critical)")),
    ).otherwise(F.lit(""))
    status = F.concat(
        F.lit("Filtered: "), F.col("total_tickets").cast("string"), F.lit(" tickets"), critical
    )
    return counts.withColumn("status_text", status)


def summary_sheet(tickets: DataFrame, as_of: datetime | str) -> DataFrame:
    """The summary as (position, metric, value) text rows; absent dates give no row."""
    return sheet_of(site_rollup(tickets), as_of)


def sheet_of(sites: DataFrame, as_of: datetime | str) -> DataFrame:
    """``summary_sheet`` of a site rollup."""
    summary = summary_of(sites)
    number = lambda name: F.col(name).cast("string")
    share = lambda name: F.concat(text1(F.col(name)), F.lit("%"))
    generated = F.lit(str(as_of)).cast("timestamp_ntz").cast("string")
    hours = F.when(F.col("avg_mttr_hours") != 0, text1(F.col("avg_mttr_hours")))
    rows = [
        ("Report Generated", F.substring(generated, 1, 19)),
        ("Total Records", number("total_tickets")),
        ("Critical Incidents", number("critical_tickets")),
        ("Critical Percentage", share("critical_pct")),
        ("Resolved Tickets", number("resolved_tickets")),
        ("Resolution Rate", share("resolution_rate")),
        ("Open Tickets", (F.col("total_tickets") - F.col("resolved_tickets")).cast("string")),
        ("Unique Sites", number("unique_sites")),
        ("Unique Companies", number("unique_companies")),
        ("Average Resolution Time (hours)", F.coalesce(hours, F.lit("N/A"))),
        ("Date Range Start", day_text(F.col("first_created"))),
        ("Date Range End", day_text(F.col("last_created"))),
    ]
    lines = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("metric"), text.alias("value"))
            for i, (name, text) in enumerate(rows, start=1)
        ]
    )
    return summary.select(F.inline(lines)).filter(F.col("value").isNotNull())


def data_summary(tickets: DataFrame) -> DataFrame:
    """The whole dataset in one row, with date ranges and unrounded mean hours."""
    return data_summary_of(site_rollup(tickets))


def data_summary_of(sites: DataFrame) -> DataFrame:
    """``data_summary`` of a site rollup."""
    figures = overall(sites)
    span = F.floor(seconds_between(F.col("first_created"), F.col("last_created")).cast("double") / 86400)
    return figures.select(
        F.col("tickets").alias("total_tickets"),
        F.col("critical").alias("critical_tickets"),
        percent(F.col("critical"), F.col("tickets")).alias("critical_pct"),
        F.col("resolved").alias("resolved_tickets"),
        percent(F.col("resolved"), F.col("tickets")).alias("resolved_pct"),
        (F.col("tickets") - F.col("resolved")).alias("open_tickets"),
        F.col("sites").alias("unique_sites"),
        F.col("companies").alias("unique_companies"),
        "first_created",
        "last_created",
        "created_count",
        "first_resolved",
        "last_resolved",
        F.col("resolved").alias("resolved_count"),
        mean_hours(F.col("resolution_seconds"), F.col("measured")).alias("avg_resolution_hours"),
        span.alias("time_span_days"),
    )


def data_summary_lines(tickets: DataFrame) -> DataFrame:
    """``data_summary`` as (position, line) text."""
    grouped = lambda name: F.format_number(F.col(name), 0)
    lines = [
        F.concat(F.lit("Total Tickets: "), grouped("total_tickets")),
        F.concat(F.lit("Critical Tickets: "), grouped("critical_tickets"),
                 F.lit(" ("), printed1(F.col("critical_pct")), F.lit("%)")),
        F.concat(F.lit("Resolved Tickets: "), grouped("resolved_tickets"),
                 F.lit(" ("), printed1(F.col("resolved_pct")), F.lit("%)")),
        F.concat(F.lit("Open Tickets: "), grouped("open_tickets")),
        F.concat(F.lit("Unique Sites: "), grouped("unique_sites")),
        F.concat(F.lit("Unique Companies: "), grouped("unique_companies")),
        F.when(
            F.col("avg_resolution_hours") != 0,
            F.concat(F.lit("Average Resolution Time: "), printed1(F.col("avg_resolution_hours")),
                     F.lit(" hours")),
        ),
        F.concat(F.lit("Date Range: "), day_text(F.col("first_created")), F.lit(" to "),
                 day_text(F.col("last_created"))),
        F.concat(F.lit("Time Span: "), F.col("time_span_days").cast("string"), F.lit(" days")),
    ]
    rows = F.array(
        *[F.struct(F.lit(i).alias("position"), t.alias("line")) for i, t in enumerate(lines, 1)]
    )
    return data_summary(tickets).select(F.inline(rows)).filter(F.col("line").isNotNull())


def date_range(tickets: DataFrame) -> DataFrame:
    """Earliest and latest value and number of values of each date column that has any."""
    figures = tickets.agg(
        *[
            f(name).alias(f"{name}_{label}")
            for name in ("created", "resolved")
            for label, f in (("min", F.min), ("max", F.max), ("count", F.count))
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(header).alias("date_column"),
                F.col(f"{name}_min").alias("min_date"),
                F.col(f"{name}_max").alias("max_date"),
                F.col(f"{name}_count").alias("date_count"),
            )
            for header, name in (("Created", "created"), ("Resolved", "resolved"))
        ]
    )
    return figures.select(F.inline(rows)).filter(F.col("date_count") > 0)


def dataset_profile(tickets: DataFrame) -> DataFrame:
    """Size of a loaded dataset: records, sites, companies, categories, column names.

    Cleaning removes no row, so that there are as many raw records as processed ones.
    """
    label = F.when((F.col("category") != "") & F.col("subcategory").isNotNull(), F.col("category"))
    groups = tickets.groupBy("site", "company", label.alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    rows = F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint")
    return groups.agg(
        rows.alias("processed_records"),
        rows.alias("raw_records"),
        F.count_distinct("site").alias("sites"),
        F.count_distinct("company").alias("companies"),
        F.count_distinct("label").alias("categories"),
    ).withColumn("columns", F.lit(", ".join(tickets.columns)))
