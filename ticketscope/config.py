"""Settings and fixed vocabulary of the ticket model."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

# Header names of a ticket file and the column names used inside.
STANDARD_COLUMNS = {
    "Site": "site",
    "Number": "number",
    "Short description": "short_description",
    "Category": "category",
    "Subcategory": "subcategory",
    "Priority": "priority",
    "Created": "created",
    "Resolved": "resolved",
    "Company": "company",
}

# The priority domain.
PRIORITIES = ("1 - Critical", "2 - High", "3 - Medium", "4 - Low")
CRITICAL = "1 - Critical"

# Other headers seen for a standard column, best guess first.
COLUMN_ALIASES = {
    "Site": ("site", "location", "store", "branch", "facility"),
    "Priority": ("priority", "severity", "level", "urgency"),
    "Created": ("created", "opened", "start", "date_created", "created_date"),
    "Resolved": ("resolved", "closed", "completed", "end", "date_resolved"),
    "Company": ("company", "franchise", "owner", "organization"),
    "Category": ("category", "type", "issue_type", "problem_type"),
    "Subcategory": ("subcategory", "subtype", "sub_category", "detail_type"),
}

# Cells that mean "missing" in a text file (exact match, before trimming).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Date formats tried in this order (yyyy = four digits, M d H m s = one or two).
DATE_FORMATS = ("M/d/yyyy H:m", "yyyy-M-d H:m:s", "M/d/yyyy", "yyyy-M-d")
EXTENDED_DATE_FORMATS = DATE_FORMATS + (
    "d/M/yyyy H:m",
    "d/M/yyyy",
    "yyyy-M-d H:m",
    "M-d-yyyy H:m",
    "M-d-yyyy",
)

# Columns added by ``derive``; exports of the tickets themselves leave them out.
DERIVED_COLUMNS = (
    "resolution_seconds",
    "resolution_hours",
    "is_critical",
    "is_resolved",
    "days_since_created",
)

# Reserved names: the partition column of stored tickets, and the text of CSV rows with more cells
# than the header. A source with a column of the first name is refused.
DAY_COLUMN = "ticketscope_day"
MALFORMED_COLUMN = "ticketscope_malformed_row"

# Columns that stored tickets carry beside their own, and that readers leave out: the load that wrote a
# row, its priority as it came if that is outside the domain, and marks of its raw cells.
LOAD_COLUMN = "ticketscope_load"
RAW_PRIORITY_COLUMN = "ticketscope_raw_priority"
MARKS_COLUMN = "ticketscope_marks"
STORED_COLUMNS = (LOAD_COLUMN, RAW_PRIORITY_COLUMN, MARKS_COLUMN)

# Folders inside stored tickets; readers of the tickets pass over names that begin so.
ROLLUP_FOLDER = "_rollup"
SKETCH_FOLDER = "_sketches"


@dataclass(frozen=True)
class Config:
    """Everything that changes a result, with the usual defaults.

    The targets, required columns and thresholds are fixed values of the usual reports.
    """

    critical_threshold: int = 2
    mttr_targets: Mapping[str, float] = field(
        default_factory=lambda: MappingProxyType(
            {"1 - Critical": 4, "2 - High": 24, "3 - Medium": 72, "4 - Low": 168}
        )
    )
    date_formats: tuple[str, ...] = DATE_FORMATS
    required_columns: tuple[str, ...] = ("Site", "Priority", "Created", "Company")
    repeat_threshold: int = 3
    medium_risk_hours: float = 24
    high_risk_hours: float = 48


DEFAULT_CONFIG = Config()
