"""Reports about sites and companies: hotspots, scorecard, green list, company overview."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.config import CRITICAL, DEFAULT_CONFIG, Config
from ticketscope.functions.dates import timestamp_literal, whole_days_between
from ticketscope.functions.numbers import mean_hours, percent, round1
from ticketscope.operators.joins import spread_join
from ticketscope.operators.normalize import require_number
from ticketscope.operators.rollup import merged, site_rollup


def _hotspots(tickets: DataFrame, config: Config) -> DataFrame:
    groups = (
        tickets.filter(F.col("priority") == CRITICAL)
        .groupBy("site", "company")
        .agg(F.count("created").alias("critical_count"), F.max("created").alias("latest_incident"))
    )
    return groups.filter(F.col("critical_count") >= config.critical_threshold)


def hotspot_tickets(tickets: DataFrame, config: Config = DEFAULT_CONFIG) -> DataFrame:
    """One row per critical ticket of each site that has a hotspot, over all its companies.

    A list of a site's tickets in one cell would not hold a site with very many of them.
    """
    require_number(tickets)
    sites = _hotspots(tickets, config).select("site").distinct()
    critical = tickets.filter(F.col("priority") == CRITICAL).select("site", "company", "created", "number")
    return spread_join(critical, sites, "site")


def critical_hotspots(
    tickets: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG
) -> DataFrame:
    """(Site, company) groups with at least ``critical_threshold`` critical tickets.

    Always one row per group; ``hotspot_tickets`` has the tickets.
    """
    require_number(tickets)
    return _with_age(_hotspots(tickets, config), as_of)


def hotspots_of(rollup: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG) -> DataFrame:
    """``critical_hotspots`` of the tickets behind a rollup."""
    groups = merged(rollup.filter(F.col("priority") == CRITICAL), "site", "company").select(
        "site", "company", F.col("created_count").alias("critical_count"),
        F.col("last_created").alias("latest_incident"),
    )
    return _with_age(groups.filter(F.col("critical_count") >= config.critical_threshold), as_of)


def _with_age(hotspots: DataFrame, as_of: datetime | str) -> DataFrame:
    return hotspots.withColumn(
        "days_since_last", whole_days_between(F.col("latest_incident"), timestamp_literal(as_of))
    )


def site_scorecard(
    tickets: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG
) -> DataFrame:
    """Volume, critical share, mean time to resolve and risk status per (site, company).

    ``longest_open_days`` is the age of the oldest ticket whether resolved or not;
    ``longest_truly_open_days`` looks at open tickets only.
    """
    require_number(tickets)
    return scorecard_of(site_rollup(tickets), as_of, config)


def scorecard_of(sites: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG) -> DataFrame:
    """``site_scorecard`` of a site rollup."""
    now = timestamp_literal(as_of)
    mttr = F.coalesce(
        round1(mean_hours(F.col("resolution_seconds"), F.col("measured"))), F.lit(0.0)
    )
    return (
        sites.withColumn("avg_mttr_hours", mttr)
        .select(
            "site",
            "company",
            F.col("numbered").alias("total_tickets"),
            F.col("critical").alias("critical_count"),
            round1(percent(F.col("critical"), F.col("numbered"))).alias("critical_pct"),
            "avg_mttr_hours",
            F.col("measured").alias("resolved_count"),
            F.col("resolved").alias("total_resolved"),
            F.coalesce(whole_days_between(F.col("first_created"), now), F.lit(0)).alias(
                "longest_open_days"
            ),
            whole_days_between(F.col("first_open_created"), now).alias("longest_truly_open_days"),
            F.when(F.col("avg_mttr_hours") > config.high_risk_hours, "High Risk")
            .when(F.col("avg_mttr_hours") > config.medium_risk_hours, "Medium Risk")
            .otherwise("Good")
            .alias("status"),
        )
    )


def green_list(
    tickets: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG
) -> DataFrame:
    """(Site, company) groups without any critical ticket."""
    require_number(tickets)
    return green_of(site_rollup(tickets), as_of, config)


def green_of(sites: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG) -> DataFrame:
    """``green_list`` of a site rollup."""
    return (
        sites.filter(F.col("critical") == 0)
        .select(
            "site",
            "company",
            F.col("numbered").alias("total_non_critical"),
            F.col("last_created").alias("last_issue"),
            whole_days_between(F.col("last_created"), timestamp_literal(as_of)).alias(
                "uptime_days"
            ),
        )
    )


def franchise_overview(
    tickets: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG
) -> DataFrame:
    """Company figures, aggregated from the site rollup.

    Best and worst site are those with the fewest and most critical tickets, the first by name
    on a tie. The performance score is the critical share plus a tenth of the mean hours.
    """
    require_number(tickets)
    return franchise_of(site_rollup(tickets), as_of, config)


def franchise_of(sites: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG) -> DataFrame:
    """``franchise_overview`` of a site rollup."""
    companies = (
        sites.groupBy("company")
        .agg(
            F.count("site").alias("sites"),
            F.sum("numbered").alias("total_tickets"),
            F.sum("critical").alias("critical_count"),
            F.sum("resolution_seconds").alias("seconds"),
            F.sum("measured").alias("measured"),
            F.sum("resolved").alias("resolved_count"),
            F.min_by("site", F.struct("critical", "site")).alias("best_site"),
            F.min_by("site", F.struct(-F.col("critical"), "site")).alias("worst_site"),
        )
    )
    mttr = F.coalesce(round1(mean_hours(F.col("seconds"), F.col("measured"))), F.lit(0.0))
    return companies.select(
        "company",
        "sites",
        "total_tickets",
        "critical_count",
        round1(percent(F.col("critical_count"), F.col("total_tickets"))).alias("critical_pct"),
        mttr.alias("avg_mttr_hours"),
        "resolved_count",
        round1(F.try_divide(F.col("total_tickets").cast("double"), F.col("sites"))).alias(
            "tickets_per_site"
        ),
        "best_site",
        "worst_site",
    ).withColumn("performance_score", F.col("critical_pct") + F.col("avg_mttr_hours") / 10)
