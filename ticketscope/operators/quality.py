"""Checks on raw ticket rows, before cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.config import DEFAULT_CONFIG, MALFORMED_COLUMN, PRIORITIES, Config
from ticketscope.functions.dates import parse_date, with_times
from ticketscope.functions.numbers import percent, printed1, round1
from ticketscope.operators.normalize import missing_columns

# Share of the rows above which a date format counts as detected, and missing values (in
# percent) above which a column gets a warning.
_DETECTION_SHARE = 0.8
_MISSING_WARNING_PCT = 10


def completeness(raw: DataFrame, config: Config = DEFAULT_CONFIG) -> DataFrame:
    """Missing cells per required column that is present, from one aggregation."""
    present = [name for name in config.required_columns if name in raw.columns]
    figures = raw.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(f"`{name}`").isNull()).alias(f"nulls_{i}") for i, name in enumerate(present)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("column_name"), F.col(f"nulls_{i}").alias("null_count"))
            for i, name in enumerate(present)
        ]
    )
    unrounded = percent(F.col("null_count"), F.col("rows"))
    return (
        figures.select("rows", F.inline(rows))
        .withColumn("unrounded_null_pct", unrounded)
        .select(
            "column_name",
            "null_count",
            round1(F.col("unrounded_null_pct")).alias("null_pct"),
            round1(100 - F.col("unrounded_null_pct")).alias("completeness_pct"),
            F.coalesce(F.col("unrounded_null_pct") > _MISSING_WARNING_PCT, F.lit(False)).alias(
                "warns"
            ),
        )
    )


def unexpected_priorities(raw: DataFrame) -> DataFrame:
    """Distinct priority values outside the domain, judged before cleaning; NULL is not one."""
    return raw.filter(~F.col("Priority").isin(*PRIORITIES)).select("Priority").distinct()


def duplicate_numbers(raw: DataFrame) -> DataFrame:
    """One row: how many ticket numbers occur more than once. Nothing is removed."""
    return (
        raw.filter(F.col("Number").isNotNull())
        .groupBy("Number")
        .agg(F.count(F.lit(1)).alias("rows"))
        .agg(F.count_if(F.col("rows") > 1).alias("duplicate_numbers"))
    )


_TIMES = {"Created": "_created_time", "Resolved": "_resolved_time"}


def _parsed(raw: DataFrame, config: Config) -> DataFrame:
    names = {name: time for name, time in _TIMES.items() if name in raw.columns}
    return with_times(raw, names, config.date_formats)


def _bad_dates(name: str) -> Column:
    return F.count_if(is_bad_date(name, F.col(_TIMES[name]), F.col(name).isNotNull()))


def bad_dates(raw: DataFrame, config: Config = DEFAULT_CONFIG) -> DataFrame:
    """Values per date column that are no dates, judged by the parser that loads them."""
    present = [name for name in _TIMES if name in raw.columns]
    figures = _parsed(raw, config).agg(*[_bad_dates(name).alias(name) for name in present])
    return figures.unpivot([], present, "column_name", "bad_dates")


def validate(raw: DataFrame, config: Config = DEFAULT_CONFIG) -> DataFrame:
    """All findings as (check_name, column_name, severity, finding_count, message) rows.

    A row of severity ``error`` makes the dataset invalid; an ``info`` row gives the number of
    records. Everything comes from one reading of the rows.
    """
    present = [name for name in config.required_columns if name in raw.columns]
    dates = [name for name in _TIMES if name in raw.columns]
    counters = {f"nulls_{i}": F.col(f"`{name}`").isNull() for i, name in enumerate(present)}
    counters |= {f"bad_{name}": is_bad_date(name, F.col(_TIMES[name]), F.col(name).isNotNull()) for name in dates}
    if MALFORMED_COLUMN in raw.columns:
        counters["malformed"] = F.col(MALFORMED_COLUMN).isNotNull()
    number = F.col("Number") if "Number" in raw.columns else None
    unexpected = unexpected_priority(F.col("Priority")) if "Priority" in raw.columns else None
    figures = figures_of(_parsed(raw, config), counters, number, unexpected)
    return findings(figures, present, missing_columns(raw, config), dates, list(raw.columns))


def unexpected_priority(priority: Column) -> Column:
    """The value if it is outside the domain, else NULL; NULL is not one."""
    return F.when(~priority.isin(*PRIORITIES), priority)


def is_bad_date(name: str, time: Column, has_text: Column) -> Column:
    """A missing Created is bad, a missing Resolved is an open ticket."""
    return time.isNull() if name == "Created" else time.isNull() & has_text


def figures_of(
    rows: DataFrame, counters: Mapping[str, Column], number: Column | None, unexpected: Column | None
) -> DataFrame:
    """One row: ``rows``, how many fulfil each counter, ``duplicate_numbers`` and ``unexpected``.

    Two levels, so that the rows are read once: first all counters per (number, unexpected
    priority), then per number and per priority. Rows are merged before each shuffle; a number
    that very many rows share, or none, sends a row per task.
    """
    nothing = F.lit(None).cast("string")
    key = nothing if number is None else number.cast("string")
    other = nothing if unexpected is None else unexpected
    names = list(counters)
    first = rows.groupBy(key.alias("_number"), other.alias("_priority")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(counters[n]).alias(f"_{n}") for n in names]
    )
    counted = ["_rows", *(f"_{n}" for n in names)]
    both = first.select(F.inline(F.array(
        F.struct(F.lit("number").alias("_kind"), F.col("_number").alias("_value"), *counted),
        F.struct(F.lit("priority").alias("_kind"), F.col("_priority").alias("_value"),
                 *[F.lit(0).cast("bigint").alias(n) for n in counted]),
    )))
    values = both.groupBy("_kind", "_value").agg(*[F.sum(n).alias(n) for n in counted])
    is_number, there = F.col("_kind") == "number", F.col("_value").isNotNull()
    return values.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        *[F.coalesce(F.sum(f"_{n}"), F.lit(0)).alias(n) for n in names],
        F.count_if(is_number & there & (F.col("_rows") > 1)).alias("duplicate_numbers"),
        F.count_if(~is_number & there).alias("unexpected"),
    )


def findings(
    figures: DataFrame, present: Sequence[str], missing: Sequence[str], dates: Sequence[str],
    columns: Sequence[str],
) -> DataFrame:
    """The rows of ``validate`` from the one row of ``figures_of``."""
    rows = F.col("rows")
    found = [_finding("record_count", "", "info", rows, _text(rows, " records"))]
    if missing:
        found.append(
            _finding("required_columns", ", ".join(missing), "error", F.lit(len(missing)),
                     F.lit(f"Missing required columns: {', '.join(missing)}"))
        )
    found.append(
        _finding("no_data", "", "error", F.lit(0), F.when(rows == 0, "No data found in file"))
    )
    for i, name in enumerate(present):
        nulls = F.col(f"nulls_{i}")
        share = percent(nulls, rows)
        message = F.concat(F.lit(f"Column '{name}' has "), printed1(share),
                           F.lit("% missing values"))
        found.append(
            _finding("completeness", name, "warning", nulls,
                     F.when(share > _MISSING_WARNING_PCT, message))
        )

    def warns(check: str, column: str, count: Column, message: Column) -> None:
        found.append(_finding(check, column, "warning", count, F.when(count > 0, message)))

    if "Priority" in columns:
        count = F.col("unexpected")
        warns("priority_values", "Priority", count, _text(count, " unexpected priority values found"))
    if MALFORMED_COLUMN in columns:
        count = F.col("malformed")
        warns("malformed_rows", "", count, _text(count, " rows have more cells than the header"))
    for name in dates:
        count = F.col(f"bad_{name}")
        suffix = " (excluding legitimately empty values)" if name == "Resolved" else ""
        warns("bad_dates", name, count, F.concat(
            F.lit(f"Column '{name}' has "), count.cast("string"), F.lit(f" invalid date formats{suffix}")))
    if "Number" in columns:
        count = F.col("duplicate_numbers")
        warns("duplicates", "Number", count, F.concat(
            F.lit("Found "), count.cast("string"), F.lit(" duplicate ticket numbers")))
    return figures.select(F.inline(F.array(*found))).filter(F.col("message").isNotNull())


def _finding(check: str, column: str, severity: str, count: Column, message: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check_name"),
        F.lit(column).alias("column_name"),
        F.lit(severity).alias("severity"),
        count.cast("bigint").alias("finding_count"),
        message.alias("message"),
    )


def _text(count: Column, suffix: str) -> Column:
    return F.concat(count.cast("string"), F.lit(suffix))


def detect_date_format(
    raw: DataFrame, column: str, formats: Sequence[str]
) -> DataFrame:
    """Share of cells that fit each date format; ``detected`` marks the best one above 80 %.

    The earlier format wins a tie. All rows are judged.
    """
    rows = raw.select(F.col(f"`{column}`").alias("cell"))
    shares = [f"share_{i}" for i in range(len(formats))]
    figures = rows.agg(
        *[
            F.try_divide(
                F.count_if(parse_date(F.col("cell"), [f]).isNotNull()).cast("double"),
                F.count(F.lit(1)),
            ).alias(share)
            for f, share in zip(formats, shares)
        ]
    ).withColumn("best", F.array_max(F.array(*shares)))

    def detected(i: int) -> Column:
        found = (F.col(shares[i]) == F.col("best")) & (F.col("best") > _DETECTION_SHARE)
        for earlier in shares[:i]:
            found = found & (F.col(earlier) < F.col("best"))
        return F.coalesce(found, F.lit(False))

    lines = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(f).alias("date_format"),
                F.col(shares[i]).alias("match_share"),
                detected(i).alias("detected"),
            )
            for i, f in enumerate(formats)
        ]
    )
    return figures.select(F.inline(lines))
