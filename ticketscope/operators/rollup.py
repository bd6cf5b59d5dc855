"""Rollups: aggregations that feed every report about sites, companies, categories and weeks.

They hold counts, exact sums, minima and maxima only, so they can be merged again, and they are
far smaller than the tickets: distinct counts and company figures are taken from them, not from the rows.
Columns that a report does not use are pruned away by the optimizer.

``ticket_rollup`` has a row per day, site, company, priority and state. It is what is stored
beside tickets: date, priority, company, site and status filters apply to it as they do to
tickets, and rollups of several loads are merged by reading them together.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.config import CRITICAL, DAY_COLUMN
from ticketscope.operators.filters import TicketFilter, apply_filters, as_datetime, is_set

# Reserved name: whether the tickets of a rollup row were created at midnight sharp. A date that ends a
# range means its midnight, which is the first moment of its day.
MIDNIGHT = "ticketscope_midnight"
ROLLUP_KEYS = (DAY_COLUMN, MIDNIGHT, "site", "company", "priority", "is_resolved")
LABELS = ("category", "subcategory")


def _measures(number: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("tickets"),
        F.count(number).alias("numbered"),
        F.count("resolution_seconds").alias("measured"),
        F.sum("resolution_seconds").alias("resolution_seconds"),
        F.count("created").alias("created_count"),
        F.min("created").alias("first_created"),
        F.max("created").alias("last_created"),
        F.min("resolved").alias("first_resolved"),
        F.max("resolved").alias("last_resolved"),
    ]


def _number(tickets: DataFrame) -> Column:
    return F.col("number") if "number" in tickets.columns else F.lit(None)


def site_rollup(tickets: DataFrame) -> DataFrame:
    """One row per (site, company); partial sums are built before the shuffle."""
    return tickets.groupBy("site", "company").agg(
        *_measures(_number(tickets)),
        F.count_if("is_critical").alias("critical"),
        F.count_if("is_resolved").alias("resolved"),
        F.min(F.when(~F.col("is_resolved"), F.col("created"))).alias("first_open_created"),
    )


def ticket_rollup(tickets: DataFrame, labels: bool = False) -> DataFrame:
    """Partial figures per ``ROLLUP_KEYS``, with ``labels`` also per category and subcategory."""
    created = F.col("created")
    midnight = created == created.cast("date").cast("timestamp_ntz")
    keyed = tickets.withColumns({DAY_COLUMN: created.cast("date"), MIDNIGHT: midnight})
    keys = [*ROLLUP_KEYS, *(LABELS if labels else ())]
    return keyed.groupBy(*keys).agg(*_measures(_number(tickets)))


def merged(rollup: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows of a rollup, of one or of several loads, added up per ``keys``."""
    total = {
        name: F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)
        for name in ("tickets", "numbered", "measured", "created_count")
    }

    def where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("tickets"))), F.lit(0)).cast("bigint")

    return rollup.groupBy(*keys).agg(
        *total.values(),
        F.sum("resolution_seconds").alias("resolution_seconds"),
        *[F.min(name).alias(name) for name in ("first_created", "first_resolved")],
        *[F.max(name).alias(name) for name in ("last_created", "last_resolved")],
        where(F.col("priority") == CRITICAL).alias("critical"),
        where(F.col("is_resolved")).alias("resolved"),
        F.min(F.when(~F.col("is_resolved"), F.col("first_created"))).alias("first_open_created"),
    )


def sites_of(rollup: DataFrame) -> DataFrame:
    """What ``site_rollup`` gives for the tickets behind a rollup."""
    return merged(rollup, "site", "company")


def filtered_rollup(
    rollup: DataFrame, conditions: TicketFilter, tickets: DataFrame | None = None
) -> DataFrame:
    """The rollup of the tickets that fulfil ``conditions``.

    Ranges of whole days, and such as end at a midnight, need the rollup alone. For a day that a
    range cuts, its ``tickets`` are read; on stored tickets this prunes to that day. Conditions on
    a category need a rollup with labels.
    """
    found, cut = rollup, []
    if conditions.date_from:
        start = as_datetime(conditions.date_from)
        if start == _midnight(start):
            found = found.filter(F.col(DAY_COLUMN) >= F.lit(start.date()))
        else:
            found = found.filter(F.col(DAY_COLUMN) > F.lit(start.date()))
            cut.append(start.date())
    if conditions.date_to:
        end = as_datetime(conditions.date_to)
        before = F.col(DAY_COLUMN) < F.lit(end.date())
        if end != _midnight(end):
            found = found.filter(before)
            cut.append(end.date())
        elif conditions.inclusive_end:
            found = found.filter(F.col(DAY_COLUMN) < F.lit((end + timedelta(days=1)).date()))
        else:
            found = found.filter(before | ((F.col(DAY_COLUMN) == F.lit(end.date())) & F.col(MIDNIGHT)))
    if conditions.priorities:
        found = found.filter(F.col("priority").isin(*conditions.priorities))
    for name in ("company", "site", *LABELS):
        if is_set(getattr(conditions, name)):
            if name not in rollup.columns:
                raise ValueError(f"This rollup has no {name}; filter the tickets instead")
            found = found.filter(F.col(name) == getattr(conditions, name))
    if conditions.resolution_status in ("Open", "Resolved"):
        resolved = F.col("is_resolved")
        found = found.filter(resolved if conditions.resolution_status == "Resolved" else ~resolved)
    if not cut:
        return found
    if tickets is None:
        raise ValueError(f"The range cuts {', '.join(map(str, cut))}: the tickets of such days are needed")
    day = F.col(DAY_COLUMN) if DAY_COLUMN in tickets.columns else F.col("created").cast("date")
    rest = apply_filters(tickets.filter(day.isin(*cut)), conditions)
    return found.unionByName(ticket_rollup(rest, labels=LABELS[0] in rollup.columns).select(rollup.columns))


def _midnight(moment: datetime) -> datetime:
    return datetime(moment.year, moment.month, moment.day)


def answers(rollup: DataFrame, conditions: TicketFilter) -> bool:
    """Whether the rollup has every column that the conditions ask for."""
    return all(name in rollup.columns or not is_set(getattr(conditions, name)) for name in LABELS)


def overall(rollup: DataFrame) -> DataFrame:
    """One row for the whole of a site rollup."""
    return rollup.agg(
        *[
            F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)
            for name in ("tickets", "critical", "resolved", "measured", "created_count")
        ],
        F.sum("resolution_seconds").alias("resolution_seconds"),
        F.count_distinct("site").alias("sites"),
        F.count_distinct("company").alias("companies"),
        F.min("first_created").alias("first_created"),
        F.max("last_created").alias("last_created"),
        F.min("first_resolved").alias("first_resolved"),
        F.max("last_resolved").alias("last_resolved"),
    )
