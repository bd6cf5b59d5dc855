"""From raw ticket rows to clean, typed tickets."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.config import (
    COLUMN_ALIASES,
    CRITICAL,
    DAY_COLUMN,
    DEFAULT_CONFIG,
    DERIVED_COLUMNS,
    MALFORMED_COLUMN,
    STANDARD_COLUMNS,
    Config,
)
from ticketscope.functions.dates import (
    seconds_between,
    timestamp_literal,
    whole_days_between,
    with_times,
)
from ticketscope.functions.text import blank_if_missing, null_tokens_to_null, strip

# HotSpot leaves longer methods interpreted. Above this limit Spark compiles a stage in parts; by default it
# makes one method of the whole cleaning, which then runs at half the speed or less. No result depends on it.
_LONGEST_METHOD = "8000"
_CLEANED_TEXT = ("Site", "Company", "Category", "Subcategory", "Short description")
_OPTIONAL_TYPES = {
    "Category": "string",
    "Subcategory": "string",
    "Short description": "string",
    "Resolved": "timestamp_ntz",
}


class MissingColumnsError(ValueError):
    """Required columns are absent; raised before any Spark job runs."""


def missing_columns(raw: DataFrame, config: Config = DEFAULT_CONFIG) -> list[str]:
    """Required columns that the frame lacks (names are case-sensitive)."""
    return [name for name in config.required_columns if name not in raw.columns]


def suggest_mapping(columns: list[str]) -> dict[str, str]:
    """Guess which non-standard headers stand for a standard column.

    Standard columns already present are left alone; the first known alias wins.
    """
    by_lower: dict[str, str] = {}
    for name in columns:
        by_lower.setdefault(name.lower(), name)
    mapping = {}
    for standard, aliases in COLUMN_ALIASES.items():
        found = next((by_lower[a] for a in aliases if a in by_lower), None)
        if standard not in columns and found is not None:
            mapping[found] = standard
    return mapping


def rename_columns(raw: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Give source columns their standard names."""
    return raw.withColumnsRenamed(dict(mapping))


def blank_null_tokens(raw: DataFrame) -> DataFrame:
    """Replace the text tokens for "missing" by NULL in every string column."""
    return raw.select(
        *[
            null_tokens_to_null(F.col(f"`{name}`")).alias(name)
            if kind == "string" and name != MALFORMED_COLUMN else F.col(f"`{name}`")
            for name, kind in raw.dtypes
        ]
    )


def clean(raw: DataFrame, config: Config = DEFAULT_CONFIG) -> DataFrame:
    """Strip text, parse dates and take the internal column names.

    Cells missing in a text column become ``''``; a text column that is absent becomes a NULL
    column, which grouping reports skip. A missing Resolved column means that every ticket is
    open. A missing priority stays NULL: it matches no filter and is no filter option. Number
    stays absent if it is absent, and reports that need it say so. Other columns pass through.
    """
    missing = missing_columns(raw, config)
    if missing:
        raise MissingColumnsError(f"Missing required columns: {', '.join(missing)}")
    if DAY_COLUMN in raw.columns:
        raise ValueError(f"The column name {DAY_COLUMN!r} is reserved; rename it in the source")
    raw.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", _LONGEST_METHOD)
    text = [n for n in (*_CLEANED_TEXT, "Priority", "Number") if n in raw.columns]
    stripped = with_times(
        raw.withColumns(
            {
                name: F.col(f"`{name}`").cast("string") if name == "Number"
                else strip(F.col(f"`{name}`").cast("string"))
                for name in text
            }
        ),
        {name: name for name in ("Created", "Resolved") if name in raw.columns},
        config.date_formats,
    )

    def standard(name: str) -> Column:
        if name not in raw.columns:
            return F.lit(None).cast(_OPTIONAL_TYPES[name])
        column = F.col(f"`{name}`")
        return blank_if_missing(column) if name in _CLEANED_TEXT else column

    present = [n for n in STANDARD_COLUMNS if n in raw.columns or n in _OPTIONAL_TYPES]
    extra = [n for n in raw.columns if n not in STANDARD_COLUMNS and n != MALFORMED_COLUMN]
    return stripped.select(
        *[standard(name).alias(STANDARD_COLUMNS[name]) for name in present],
        *[F.col(f"`{name}`") for name in extra],
    )


def derive(tickets: DataFrame, as_of: datetime | str) -> DataFrame:
    """Add resolution time, flags and age to clean tickets.

    Resolution may be negative; age counts whole days up to ``as_of``, rounded down, for
    resolved tickets as well.
    """
    seconds = seconds_between(F.col("created"), F.col("resolved"))
    return tickets.withColumns(
        {
            "resolution_seconds": seconds,
            "resolution_hours": seconds.cast("double") / 3600,
            "is_critical": F.coalesce(F.col("priority") == CRITICAL, F.lit(False)),
            "is_resolved": F.col("resolved").isNotNull(),
            "days_since_created": whole_days_between(F.col("created"), timestamp_literal(as_of)),
        }
    )


def normalize(raw: DataFrame, as_of: datetime | str, config: Config = DEFAULT_CONFIG) -> DataFrame:
    """``clean`` followed by ``derive``."""
    return derive(clean(raw, config), as_of)


def without_derived(tickets: DataFrame) -> DataFrame:
    """The tickets under their file headers and without the derived columns."""
    headers = {inner: header for header, inner in STANDARD_COLUMNS.items()}
    return tickets.drop(*DERIVED_COLUMNS, DAY_COLUMN).withColumnsRenamed(headers)


def with_inner_names(tickets: DataFrame) -> DataFrame:
    """Undo the renaming of ``without_derived``."""
    return tickets.withColumnsRenamed(STANDARD_COLUMNS)


def require_number(tickets: DataFrame) -> None:
    """Reports that count tickets by number cannot run without that column."""
    if "number" not in tickets.columns:
        raise MissingColumnsError("This report needs the column Number")
