"""Dates without time zones: parsing, differences, weeks and presets.

All values are TIMESTAMP_NTZ. Nothing here passes through a zoned TIMESTAMP, so results do not
change with the session time zone.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.functions.text import WHITESPACE

_TOKEN = re.compile(r"yyyy|MM?|dd?|HH?|mm?|ss?|\s+|.")
_FIELDS = "yMdHms"
# What each field may hold. A cell whose numbers are in range but no real date, like 30 February, is none
# with day and month exchanged either, so that the first format whose ranges fit can decide.
_RANGES = {
    "y": "(?!0000)[0-9]{4}", "M": "0?[1-9]|1[0-2]", "d": "0?[1-9]|[12][0-9]|3[01]", "H": "[01]?[0-9]|2[0-3]",
    "m": "[0-5]?[0-9]", "s": "[0-5]?[0-9]",
}
_BLANKS = "[" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "]*"
# Stands before rewritten cells; a cell of the source that begins so fits no format.
_MARK = "\u0001"


def timestamp_literal(value: datetime | date | str) -> Column:
    """A TIMESTAMP_NTZ literal; a plain date means its midnight."""
    text = value if isinstance(value, str) else value.isoformat()
    return F.lit(text).cast("timestamp_ntz")


def _pattern(date_format: str) -> tuple[str, str]:
    """A regular expression for fitting cells, and the same moment as year-month-day time."""
    pattern, place = "", {}
    for token in _TOKEN.findall(date_format):
        field = token[0]
        if field in _FIELDS and (field != "y" or token == "yyyy") and field not in place:
            place[field] = len(place) + 1
            pattern += f"({_RANGES[field]})"
        elif token.isspace():
            pattern += r"\s+"
        elif token.isalnum():
            raise ValueError(f"unknown or repeated {token!r} in date format {date_format!r}")
        else:
            pattern += re.escape(token)
    if not {"y", "M", "d"} <= place.keys():
        raise ValueError(f"date format {date_format!r} needs yyyy, M and d")
    parts = {field: f"${place[field]}" if field in place else "0" for field in _FIELDS}
    return rf"^{_BLANKS}{pattern}{_BLANKS}\z", "{y}-{M}-{d} {H}:{m}:{s}".format(**parts)


def parse_date(text: Column, formats: Sequence[str]) -> Column:
    """First format that fits wins; blank or unreadable text is NULL. White space around it is ignored.

    Every format rewrites a cell that fits it, behind a mark that keeps the others off; what has no
    mark is emptied, and one cast judges the rest. The cell occurs once in the expression: it is
    compiled as a whole, and stays small where a filter on the result is pushed below it.
    """
    cell = F.regexp_replace(text, f"(?s)^{_MARK}.*", "")
    for date_format in formats:
        pattern, moment = _pattern(date_format)
        cell = F.regexp_replace(cell, pattern, _MARK + moment)
    marked = F.regexp_replace(cell, f"(?s)^(?!{_MARK}).*", "")
    return F.regexp_replace(marked, _MARK, "").try_cast("timestamp_ntz")


def with_times(rows: DataFrame, names: Mapping[str, str], formats: Sequence[str]) -> DataFrame:
    """Add a TIMESTAMP_NTZ column for each date column in ``names`` (source -> new name).

    Text is parsed, a column that is already a date or timestamp is cast.
    """
    types = dict(rows.dtypes)
    return rows.withColumns({
        new: parse_date(F.col(f"`{old}`"), formats) if types[old] == "string"
        else F.col(f"`{old}`").cast("timestamp_ntz")
        for old, new in names.items()
    })


def seconds_between(start: Column, end: Column) -> Column:
    """Exact seconds as DECIMAL(18, 6), negative if ``end`` comes first."""
    return (end - start).cast("interval second").cast("decimal(18,6)")


def whole_days_between(start: Column, end: Column) -> Column:
    """Whole days, rounded down: 25 hours backwards is -2 days, not -1."""
    return F.floor(seconds_between(start, end).cast("double") / 86400)


def week_start(moment: Column) -> Column:
    """The Monday of the week as a DATE."""
    day = moment.cast("date")
    return F.date_sub(day, F.weekday(day))


def minute_text(moment: Column) -> Column:
    """``2025-06-02 09:24``"""
    return F.substring(moment.cast("string"), 1, 16)


def day_text(moment: Column) -> Column:
    """``2025-06-02``"""
    return moment.cast("date").cast("string")
