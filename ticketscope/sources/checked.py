"""Load, store and validate with one reading of the source.

The checks need raw cells, which cleaning loses. So that they need not be read again, stored
rows carry marks of their raw cells (what was missing, whether Resolved held text, too many
cells) and an unexpected priority as it came. The findings are an aggregation of these narrow columns of the
stored rows. Metrics observed while writing would count the rows of a task again that is re-run after
an executor was lost; stored columns do not.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.config import (
    DAY_COLUMN,
    DEFAULT_CONFIG,
    DERIVED_COLUMNS,
    LOAD_COLUMN,
    MALFORMED_COLUMN,
    MARKS_COLUMN,
    RAW_PRIORITY_COLUMN,
    Config,
)
from ticketscope.operators.normalize import normalize
from ticketscope.operators.quality import figures_of, findings, is_bad_date, unexpected_priority
from ticketscope.sources.writers import rows_of_load, store_tickets


def _marked(raw: DataFrame, config: Config) -> list[tuple[str, Column]]:
    """The marks of a raw row by name; their order gives their bits."""
    marks = [(f"nulls_{i}", F.col(f"`{name}`").isNull()) for i, name in enumerate(config.required_columns)]
    if "Resolved" in raw.columns:
        marks.append(("resolved_text", F.col("Resolved").isNotNull()))
    if MALFORMED_COLUMN in raw.columns:
        marks.append(("malformed", F.col(MALFORMED_COLUMN).isNotNull()))
    return marks


def noted(raw: DataFrame, config: Config = DEFAULT_CONFIG) -> DataFrame:
    """Raw tickets with the two columns that the findings need later."""
    bits = [F.when(mark, F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, mark) in enumerate(_marked(raw, config))]
    return raw.withColumns({
        MARKS_COLUMN: reduce(lambda a, b: a.bitwiseOR(b), bits),
        RAW_PRIORITY_COLUMN: unexpected_priority(F.col("Priority").cast("string")),
    })


def noted_findings(tickets: DataFrame, raw: DataFrame, config: Config = DEFAULT_CONFIG) -> DataFrame:
    """What ``validate`` finds in ``raw``, from clean tickets made of ``noted(raw)``."""
    names = [name for name, _ in _marked(raw, config)]
    bit = {name: F.col(MARKS_COLUMN).bitwiseAND(F.lit(1 << i)) != 0 for i, name in enumerate(names)}
    dates = [name for name in ("Created", "Resolved") if name in raw.columns]
    counters = {name: bit[name] for name in bit if name != "resolved_text"}
    counters |= {
        f"bad_{name}": is_bad_date(name, F.col(name.lower()), bit.get("resolved_text", F.lit(False))) for name in dates
    }
    number = F.col("number") if "Number" in raw.columns else None
    figures = figures_of(tickets, counters, number, F.col(RAW_PRIORITY_COLUMN))
    return findings(figures, list(config.required_columns), [], dates, list(raw.columns))


def store_checked(
    raw: DataFrame, path: str, as_of: datetime | str, config: Config = DEFAULT_CONFIG, mode: str = "errorifexists"
) -> DataFrame:
    """Clean and store raw tickets like ``store_tickets``; returns what ``validate`` finds in them.

    The findings are about this load only, also where it was appended. Absent required columns
    raise before anything runs. With ``mode="ignore"`` and a table that is there, nothing was loaded, and
    the findings say so.
    """
    normalize(raw, as_of, config)  # raises if columns are missing
    tickets = normalize(noted(raw, config), as_of, config)
    load = store_tickets(tickets, path, mode)
    columns = tickets.drop(*DERIVED_COLUMNS).withColumns({DAY_COLUMN: F.col("created").cast("date"), LOAD_COLUMN: F.lit(load)})
    return noted_findings(rows_of_load(columns, path, load), raw, config)
