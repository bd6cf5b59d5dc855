"""Reports about categories: equipment analysis and repeat offenders."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketscope.config import DEFAULT_CONFIG, Config
from ticketscope.functions.dates import whole_days_between
from ticketscope.functions.numbers import mean_hours, percent, round1
from ticketscope.operators.normalize import require_number
from ticketscope.operators.rollup import merged


def equipment_analysis(
    tickets: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG
) -> DataFrame:
    """Volume, share of all tickets and most affected site per (category, subcategory).

    The first step also groups by site: its partial sums keep a large category off a single
    task, and the most frequent site (first by name on a tie) is then a cheap minimum.
    """
    require_number(tickets)
    by_site = tickets.groupBy("category", "subcategory", "site").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("number").alias("numbered"),
        F.count_if("is_critical").alias("critical"),
        F.sum("resolution_seconds").alias("seconds"),
        F.count("resolution_seconds").alias("measured"),
    )
    return _equipment(by_site)


def equipment_of(rollup: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG) -> DataFrame:
    """``equipment_analysis`` of the tickets behind a rollup with labels."""
    by_site = merged(rollup, "category", "subcategory", "site").select(
        "category", "subcategory", "site", F.col("tickets").alias("rows"), "numbered", "critical",
        F.col("resolution_seconds").alias("seconds"), "measured",
    )
    return _equipment(by_site)


def _equipment(by_site: DataFrame) -> DataFrame:
    groups = by_site.groupBy("category", "subcategory").agg(
        F.sum("numbered").alias("total_count"),
        F.sum("critical").alias("critical_count"),
        F.sum("seconds").alias("seconds"),
        F.sum("measured").alias("measured"),
        F.min_by("site", F.struct(-F.col("rows"), "site")).alias("most_affected_site"),
        F.sum("rows").alias("rows"),
    )
    # The groups are few, one per pair of labels; their rows add up to all tickets.
    total = F.sum("rows").over(W.partitionBy())
    mttr = F.coalesce(round1(mean_hours(F.col("seconds"), F.col("measured"))), F.lit(0.0))
    named = F.col("category").isNotNull() & F.col("subcategory").isNotNull()
    return groups.withColumn("total", total).filter(named).select(
        "category",
        "subcategory",
        "total_count",
        round1(percent(F.col("total_count"), F.col("total"))).alias("pct_of_total"),
        "critical_count",
        round1(percent(F.col("critical_count"), F.col("total_count"))).alias("critical_pct"),
        mttr.alias("avg_mttr_hours"),
        "most_affected_site",
    )


def repeat_offenders(
    tickets: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG
) -> DataFrame:
    """(Site, company, category) groups with at least ``repeat_threshold`` tickets."""
    require_number(tickets)
    groups = (
        tickets.filter(F.col("category").isNotNull())
        .groupBy("site", "company", "category")
        .agg(
            F.count("number").alias("incident_count"),
            F.min("created").alias("first_created"),
            F.max("created").alias("last_created"),
            F.count_if("is_critical").alias("critical_count"),
        )
    )
    return _repeats(groups, config)


def repeats_of(rollup: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG) -> DataFrame:
    """``repeat_offenders`` of the tickets behind a rollup with labels."""
    groups = merged(rollup.filter(F.col("category").isNotNull()), "site", "company", "category").select(
        "site", "company", "category", F.col("numbered").alias("incident_count"), "first_created",
        "last_created", F.col("critical").alias("critical_count"),
    )
    return _repeats(groups, config)


def _repeats(groups: DataFrame, config: Config) -> DataFrame:
    span = whole_days_between(F.col("first_created"), F.col("last_created"))
    return (
        groups.filter(F.col("incident_count") >= config.repeat_threshold)
        .select(
            "site",
            "company",
            "category",
            "incident_count",
            F.greatest(F.coalesce(span, F.lit(0)), F.lit(0)).cast("bigint").alias("time_span_days"),
            "critical_count",
            (F.col("incident_count") * 10 + F.col("critical_count") * 5).alias("pattern_score"),
        )
    )
