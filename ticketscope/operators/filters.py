"""Ticket filters: a set of conditions that becomes one boolean column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.config import DAY_COLUMN, PRIORITIES
from ticketscope.functions.dates import timestamp_literal

# The named date ranges, in days, "YTD" for this year, "ALL" for no limit.
DATE_PRESETS = {
    "Last 7 Days": 7,
    "Last 30 Days": 30,
    "Last 90 Days": 90,
    "This Year": "YTD",
    "All Time": "ALL",
}


def as_datetime(value: datetime | date | str) -> datetime:
    """A moment; a plain date means its midnight."""
    if isinstance(value, str):
        return datetime.fromisoformat(value)
    if isinstance(value, datetime):
        return value
    return datetime(value.year, value.month, value.day)


def is_set(value: object) -> bool:
    """Whether a condition is one: not ``None``, blank or ``All``."""
    return bool(value) and value != "All"


@dataclass(frozen=True)
class TicketFilter:
    """All conditions must hold. ``None``, blank, ``All`` and an empty list mean no condition.

    A plain date in ``date_to`` means its midnight, so that day itself is left out unless
    ``inclusive_end`` is set.
    """

    date_from: datetime | date | str | None = None
    date_to: datetime | date | str | None = None
    priorities: Sequence[str] | None = None
    company: str | None = None
    site: str | None = None
    category: str | None = None
    subcategory: str | None = None
    resolution_status: str | None = None
    inclusive_end: bool = False

    @classmethod
    def preset(cls, name: str | int, as_of: datetime | str, **conditions) -> TicketFilter:
        """A named date range or a number of days ending at the date of ``as_of``."""
        days = DATE_PRESETS[name] if name in DATE_PRESETS else name
        today = as_datetime(as_of).date()
        if days == "ALL":
            return cls(**conditions)
        if days == "YTD":
            return cls(date_from=today.replace(month=1, day=1), date_to=today, **conditions)
        if not isinstance(days, int):
            raise ValueError(f"Unknown date preset {name!r}")
        return cls(date_from=today - timedelta(days=days), date_to=today, **conditions)

    def conditions(self) -> list[Column]:
        """The conditions that are set."""
        found = []
        if self.date_from:
            found.append(F.col("created") >= timestamp_literal(as_datetime(self.date_from)))
        if self.date_to:
            end = as_datetime(self.date_to)
            if self.inclusive_end and end == datetime(end.year, end.month, end.day):
                found.append(F.col("created") < timestamp_literal(end + timedelta(days=1)))
            else:
                found.append(F.col("created") <= timestamp_literal(end))
        if self.priorities:
            found.append(F.col("priority").isin(*self.priorities))
        for name in ("company", "site", "category", "subcategory"):
            if is_set(getattr(self, name)):
                found.append(F.col(name) == getattr(self, name))
        if self.resolution_status == "Open":
            found.append(F.col("resolved").isNull())
        elif self.resolution_status == "Resolved":
            found.append(F.col("resolved").isNotNull())
        return found

    def partition_conditions(self) -> list[Column]:
        """The date range again, on the partition column of stored tickets."""
        found = []
        if self.date_from:
            found.append(F.col(DAY_COLUMN) >= F.lit(as_datetime(self.date_from).date()))
        if self.date_to:
            found.append(F.col(DAY_COLUMN) <= F.lit(as_datetime(self.date_to).date()))
        return found

    def to_column(self) -> Column:
        """One boolean column; true if nothing is set."""
        return reduce(lambda a, b: a & b, self.conditions(), F.lit(True))

    def describe(self) -> list[str]:
        """Readable lines about the active conditions, for the record beside an export."""
        lines = []
        if self.date_from:
            lines.append(f"Date from: {_date_label(self.date_from)}")
        if self.date_to:
            lines.append(f"Date to: {_date_label(self.date_to)}")
        if self.priorities:
            lines.append(f"Priorities: {', '.join(self.priorities)}")
        for name in ("company", "site", "category", "subcategory"):
            if is_set(getattr(self, name)):
                lines.append(f"{name.capitalize()}: {getattr(self, name)}")
        if self.resolution_status in ("Open", "Resolved"):
            lines.append(f"Status: {self.resolution_status}")
        return lines or ["No filters applied"]


def _date_label(value: datetime | date | str) -> str:
    return value if isinstance(value, str) else str(value)


def checked_priorities(
    critical: bool = True, high: bool = True, medium: bool = True, low: bool = True
) -> list[str]:
    """Priority labels for four check boxes; all checked leaves out unknown priorities."""
    boxes = (critical, high, medium, low)
    return [label for label, checked in zip(PRIORITIES, boxes) if checked]


def apply_filters(tickets: DataFrame, conditions: TicketFilter) -> DataFrame:
    """Tickets that fulfil all conditions.

    On stored tickets (``read_stored``) the date range prunes partitions; only these have the
    reserved day column.
    """
    filtered = tickets.filter(conditions.to_column())
    if DAY_COLUMN in tickets.columns:
        for condition in conditions.partition_conditions():
            filtered = filtered.filter(condition)
    return filtered
