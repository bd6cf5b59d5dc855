"""From typed reports to the text tables people read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.config import Config
from ticketscope.functions.dates import day_text, minute_text
from ticketscope.functions.numbers import printed1, text1

# Labels with their signs.
_STATUS_LABELS = {"High Risk": "🔴 High Risk", "Medium Risk": "🟡 Medium Risk", "Good": "🟢 Good"}
_MISSED_LABEL = "🔴 Missed SLA"
_BACKLOG_UP, _BACKLOG_DOWN, _BACKLOG_SAME = "📈", "📉", "➡️"


def _or_na(text: Column) -> Column:
    return F.coalesce(text, F.lit("N/A"))


def _percent(name: str) -> Column:
    return _or_na(F.concat(text1(F.col(name)), F.lit("%")))


def _mean_hours(name: str = "avg_mttr_hours") -> Column:
    hours = F.col(name)
    return F.when(hours > 0, F.concat(text1(hours), F.lit("h"))).otherwise("N/A")


def _hours_or_days(hours: Column) -> Column:
    """Below a day in hours, else in days."""
    return F.when(hours < 24, F.concat(printed1(hours), F.lit("h"))).otherwise(
        F.concat(printed1(hours / 24), F.lit("d"))
    )


def _whole(name: str) -> Column:
    return _or_na(F.col(name).cast("string"))


def hotspots(report: DataFrame, config: Config) -> DataFrame:
    return report.select(
        F.col("site").alias("Site"),
        F.col("company").alias("Company"),
        F.col("critical_count").alias("Critical Count"),
        _or_na(minute_text(F.col("latest_incident"))).alias("Latest Incident"),
        _whole("days_since_last").alias("Days Since Last"),
    )


def hotspot_list(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("site").alias("Site"),
        F.col("company").alias("Company"),
        _or_na(minute_text(F.col("created"))).alias("Created"),
        F.coalesce("number", F.lit("No ticket #")).alias("Ticket #"),
    )


def scorecard(report: DataFrame, config: Config) -> DataFrame:
    status = F.lit(_STATUS_LABELS["Good"])
    for name in ("Medium Risk", "High Risk"):
        status = F.when(F.col("status") == name, _STATUS_LABELS[name]).otherwise(status)
    days = F.col("longest_open_days")
    return report.select(
        F.col("site").alias("Site"),
        F.col("company").alias("Company"),
        F.col("total_tickets").alias("Total Tickets"),
        F.col("critical_count").alias("Critical Count"),
        _percent("critical_pct").alias("Critical %"),
        _mean_hours().alias("Avg MTTR"),
        F.when(days > 0, days.cast("string")).otherwise("N/A").alias("Longest Open (days)"),
        status.alias("Status"),
    )


def green(report: DataFrame, config: Config) -> DataFrame:
    return report.select(
        F.col("site").alias("Site"),
        F.col("company").alias("Company"),
        F.col("total_non_critical").alias("Total Non-Critical"),
        _or_na(day_text(F.col("last_issue"))).alias("Last Issue"),
        _whole("uptime_days").alias("Uptime Days"),
    )


def franchise(report: DataFrame, config: Config) -> DataFrame:
    return report.select(
        F.col("company").alias("Company"),
        F.col("sites").alias("Sites"),
        F.col("total_tickets").alias("Total Tickets"),
        _percent("critical_pct").alias("Critical %"),
        _mean_hours().alias("Avg MTTR"),
        text1(F.col("tickets_per_site")).alias("Tickets/Site"),
        F.col("best_site").alias("Best Site"),
        F.col("worst_site").alias("Worst Site"),
    )


def equipment(report: DataFrame, config: Config) -> DataFrame:
    return report.select(
        F.col("category").alias("Category"),
        F.col("subcategory").alias("Subcategory"),
        F.col("total_count").alias("Count"),
        _percent("pct_of_total").alias("% of Total"),
        F.col("critical_count").alias("Critical"),
        _percent("critical_pct").alias("Critical %"),
        _mean_hours().alias("Avg MTTR"),
        F.col("most_affected_site").alias("Most Affected Site"),
    )


def incidents(report: DataFrame, config: Config) -> DataFrame:
    hours = F.col("resolution_hours")
    open_for = _or_na(F.concat(F.col("days_open").cast("string"), F.lit("d open")))
    took = F.when(hours > 0, _hours_or_days(hours)).otherwise("N/A")
    is_open = F.col("status") == "Open"
    return report.select(
        F.col("site").alias("Site"),
        _or_na(F.col("number")).alias("Ticket #"),
        F.col("description").alias("Description"),
        F.col("category_label").alias("Category"),
        F.col("priority").alias("Priority"),
        _or_na(minute_text(F.col("created"))).alias("Created"),
        F.when(is_open, "Open").otherwise(minute_text(F.col("resolved"))).alias("Resolved"),
        F.when(is_open, open_for).otherwise(took).alias("Resolution Time"),
        F.col("status").alias("Status"),
        F.col("company").alias("Company"),
    )


def repeats(report: DataFrame, config: Config) -> DataFrame:
    return report.select(
        F.col("site").alias("Site"),
        F.col("company").alias("Company"),
        F.col("category").alias("Category"),
        F.col("incident_count").alias("Incident Count"),
        F.col("time_span_days").alias("Time Span (days)"),
        F.col("critical_count").alias("Critical Count"),
        F.col("pattern_score").alias("Pattern Score"),
    )


def resolution(report: DataFrame, config: Config) -> DataFrame:
    target = F.lit("N/A")
    for priority, hours in config.mttr_targets.items():
        label = f"{hours}h" if hours < 24 else f"{hours / 24:.1f}d"
        target = F.when(F.col("priority") == priority, label).otherwise(target)
    return report.select(
        F.col("site").alias("Site"),
        _or_na(F.col("number")).alias("Ticket #"),
        F.col("priority").alias("Priority"),
        _hours_or_days(F.col("resolution_hours")).alias("Resolution Time"),
        target.alias("Target"),
        F.lit(_MISSED_LABEL).alias("SLA Status"),
        F.concat(printed1(F.col("days_overdue")), F.lit("d")).alias("Days Overdue"),
    )


def trends(report: DataFrame, config: Config) -> DataFrame:
    def month_day(day: Column) -> Column:
        text = day.cast("string")
        return F.concat(F.substring(text, 6, 2), F.lit("/"), F.substring(text, 9, 2))

    change = F.col("backlog_change")
    sign = F.when(change > 0, _BACKLOG_UP).when(change < 0, _BACKLOG_DOWN).otherwise(_BACKLOG_SAME)
    first = F.col("week_start")
    return report.select(
        F.concat(month_day(first), F.lit(" - "), month_day(F.date_add(first, 6))).alias("Week"),
        F.col("new_tickets").alias("New Tickets"),
        F.col("critical_count").alias("Critical"),
        _percent("critical_pct").alias("Critical %"),
        F.col("resolved_of_created").alias("Resolved"),
        _percent("resolution_pct").alias("Resolution %"),
        F.concat(sign, F.lit(" "), F.abs(change).cast("string")).alias("Backlog Change"),
        F.col("peak_day").alias("Peak Day"),
    )


Display = Callable[[DataFrame, Config], DataFrame]
