from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.session import local_session  # noqa: E402
from ticketscope.operators.normalize import normalize  # noqa: E402

AS_OF = "2025-08-01 00:00:00"
HEADERS = (
    "Site", "Number", "Short description", "Category", "Subcategory", "Priority", "Created",
    "Resolved", "Company",
)
_DEFAULTS = {
    "Site": "Store 1", "Number": None, "Short description": "HW-Printer", "Category": "Printer",
    "Subcategory": "Jam", "Priority": "3 - Medium", "Created": "7/1/2025 8:00", "Resolved": None,
    "Company": "North Foods, LLC",
}


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    """Build raw text tickets from dictionaries; Number defaults to T001, T002, ..."""

    def build(*rows: dict, drop: tuple[str, ...] = ()):
        filled = []
        for i, row in enumerate(rows, start=1):
            values = {**_DEFAULTS, "Number": f"T{i:03}", **row}
            filled.append(tuple(values[h] for h in HEADERS if h not in drop))
        schema = ", ".join(f"`{h}` string" for h in HEADERS if h not in drop)
        return spark.createDataFrame(filled, schema)

    return build


@pytest.fixture(scope="session")
def tickets(raw):
    """The same, cleaned."""

    def build(*rows: dict, drop: tuple[str, ...] = (), as_of: str = AS_OF, **options):
        return normalize(raw(*rows, drop=drop), as_of, **options)

    return build


def rows_of(frame, *columns: str) -> list[tuple]:
    return [tuple(r) for r in (frame.select(*columns) if columns else frame).collect()]
