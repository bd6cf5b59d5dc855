from datetime import datetime

import pytest
from conftest import AS_OF, rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketscope.config import DATE_FORMATS, EXTENDED_DATE_FORMATS, Config
from ticketscope.functions.dates import whole_days_between, with_times
from ticketscope.functions.numbers import printed1, round1
from ticketscope.functions.text import WHITESPACE, strip
from ticketscope.operators.normalize import (
    MissingColumnsError,
    blank_null_tokens,
    clean,
    normalize,
    rename_columns,
    suggest_mapping,
    without_derived,
)
from ticketscope.plans.reports import run_report


def test_blanks(raw):
    rows = raw(
        {"Site": "", "Category": "N/A", "Priority": ""},
        {"Site": "  ", "Category": " nan ", "Priority": "\t2 - High  "},
        {"Site": "\tStore　", "Category": None, "Priority": None},
        {"Site": "nan", "Category": " N/A", "Priority": "nan"},
    )
    found = clean(blank_null_tokens(rows)).orderBy("number")
    assert rows_of(found, "site", "category", "priority") == [
        ("", "", None),
        ("", "", "2 - High"),
        ("Store", "", None),
        ("", "N/A", None),
    ]


def test_strip_is_the_same_as_in_python(spark):
    cells = [f"{c}x{c}" for c in map(chr, range(0x3001)) if c.isspace()] + ["​x", " a b ", ""]
    frame = spark.createDataFrame([(c,) for c in cells], "cell string")
    assert [r[0] for r in frame.select(strip(F.col("cell"))).collect()] == [c.strip() for c in cells]
    assert all(c.isspace() for c in WHITESPACE)


DATES = {
    "6/2/2025 9:24": datetime(2025, 6, 2, 9, 24),
    "06/02/2025 09:04": datetime(2025, 6, 2, 9, 4),
    " 6/2/2025   9:24\t": datetime(2025, 6, 2, 9, 24),
    "2025-06-02 09:24:05": datetime(2025, 6, 2, 9, 24, 5),
    "2025-6-2 9:2:5": datetime(2025, 6, 2, 9, 2, 5),
    "6/2/2025": datetime(2025, 6, 2),
    "2025-06-02": datetime(2025, 6, 2),
    "2/30/2025": None,
    "6/2/25 9:24": None,
    "6/2/2025 24:00": None,
    "0000-01-01": None,
    "2025-06-02T09:24:05": None,
    "junk": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_date_formats(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 3/9/2025 2:30 does not exist on New York clocks; ticket times have no zone.
        cases = {**DATES, "3/9/2025 2:30": datetime(2025, 3, 9, 2, 30)}
        frame = spark.createDataFrame([(c,) for c in cases], "cell string")
        parsed = with_times(frame, {"cell": "time"}, DATE_FORMATS).select("time")
        assert [r[0] for r in parsed.collect()] == list(cases.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_extended_formats(spark):
    cases = {
        "25/12/2025 8:05": datetime(2025, 12, 25, 8, 5),
        "25/12/2025": datetime(2025, 12, 25),
        "2025-12-25 8:05": datetime(2025, 12, 25, 8, 5),
        "12-25-2025 8:05": datetime(2025, 12, 25, 8, 5),
        "12-25-2025": datetime(2025, 12, 25),
        "3/4/2025": datetime(2025, 3, 4),
    }
    frame = spark.createDataFrame([(c,) for c in cases], "cell string")
    parsed = with_times(frame, {"cell": "time"}, EXTENDED_DATE_FORMATS).select("time")
    assert [r[0] for r in parsed.collect()] == list(cases.values())
    base = with_times(frame, {"cell": "time"}, DATE_FORMATS).select("time").collect()
    assert [r[0] for r in base] == [None] * 5 + [datetime(2025, 3, 4)]


def test_unknown_format_letters_are_refused(spark):
    frame = spark.createDataFrame([("x",)], "cell string")
    with pytest.raises(ValueError):
        with_times(frame, {"cell": "time"}, ["dd MMM yyyy"])


def test_derived_columns(tickets):
    found = tickets(
        {"Created": "7/31/2025 23:00", "Resolved": "8/1/2025 0:30", "Priority": "1 - Critical"},
        {"Created": "8/2/2025 1:00", "Resolved": "8/1/2025 1:00"},
        {"Created": "junk", "Resolved": "8/1/2025 1:00"},
    ).orderBy("number")
    assert rows_of(found, "resolution_hours", "is_critical", "is_resolved", "days_since_created") == [
        (1.5, True, True, 0),
        (-24.0, False, True, -2),
        (None, False, True, None),
    ]


def test_days_are_rounded_down(spark):
    frame = spark.sql("select timestamp_ntz'2025-08-02 01:00:00' a, timestamp_ntz'2025-08-01 00:00:00' b")
    assert frame.select(whole_days_between(F.col("a"), F.col("b"))).first()[0] == -2
    assert frame.select(whole_days_between(F.col("b"), F.col("a"))).first()[0] == 1


def test_typed_input_is_not_parsed_again(spark):
    raw = spark.sql(
        "select 's' as Site, 'c' as Company, '4 - Low' as Priority, 7 as Number,"
        " timestamp_ntz'2025-07-01 08:00:00.5' as Created, date'2025-07-02' as Resolved, 5 as Extra"
    )
    row = normalize(raw, AS_OF).first()
    assert row["created"] == datetime(2025, 7, 1, 8, 0, 0, 500000)
    assert row["resolution_hours"] == pytest.approx(15.99986111)
    assert (row["number"], row["category"], row["Extra"]) == ("7", None, 5)


def test_missing_required_columns(raw):
    with pytest.raises(MissingColumnsError, match="Company"):
        normalize(raw({}, drop=("Company",)), AS_OF)
    kept = normalize(raw({}, drop=("Company",)).withColumnRenamed("Site", "x").withColumnRenamed("x", "Site"),
                     AS_OF, Config(required_columns=("Site", "Priority", "Created")))
    assert kept.count() == 1


def test_missing_resolved_column_means_open(tickets):
    found = tickets({}, drop=("Resolved",))
    assert rows_of(found, "resolved", "is_resolved", "resolution_hours") == [(None, False, None)]
    assert run_report("resolution_tracking", found, AS_OF).count() == 0


def test_missing_category_gives_empty_reports(tickets):
    found = tickets({}, {}, {}, drop=("Category",))
    assert run_report("equipment_analysis", found, AS_OF).count() == 0
    assert run_report("repeat_offenders", found, AS_OF).count() == 0
    shown = run_report("incident_details", found, AS_OF, as_text=True)
    assert shown.first()["Category"] == "Other - Jam"


def test_missing_number_column(tickets):
    found = tickets({}, drop=("Number",))
    for name in ("critical_hotspots", "site_scorecard", "green_list", "franchise_overview",
                 "equipment_analysis", "repeat_offenders", "workload_trends"):
        with pytest.raises(MissingColumnsError, match="Number"):
            run_report(name, found, AS_OF)
    assert run_report("incident_details", found, AS_OF, as_text=True).first()["Ticket #"] == "N/A"
    assert run_report("resolution_tracking", found, AS_OF).count() == 0


def test_aliases(raw):
    foreign = raw({}).withColumnsRenamed(
        {"Site": "Store", "Priority": "Severity", "Created": "Opened", "Company": "Franchise"}
    )
    mapping = suggest_mapping(foreign.columns)
    assert mapping == {"Store": "Site", "Severity": "Priority", "Opened": "Created",
                       "Franchise": "Company"}
    assert normalize(rename_columns(foreign, mapping), AS_OF).count() == 1
    # A standard name that is there is kept, and the first alias in the list wins.
    assert suggest_mapping(["Site", "Location"]) == {}
    assert suggest_mapping(["Store", "LOCATION", "site_id"]) == {"LOCATION": "Site"}


def test_without_derived_restores_headers(tickets):
    found = without_derived(tickets({}))
    assert set(found.columns) == {
        "Site", "Number", "Short description", "Category", "Subcategory", "Priority", "Created",
        "Resolved", "Company",
    }


def test_round1_sends_ties_to_even(spark):
    frame = spark.createDataFrame([(12.25,), (12.35,), (0.25,), (0.75,)], "x double")
    assert [r[0] for r in frame.select(round1(F.col("x"))).collect()] == [12.2, 12.4, 0.2, 0.8]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(0, 1e7), min_size=1, max_size=200))
def test_printed1_is_the_same_as_in_python(spark, values):
    # Whole minutes as hours hold many decimal ties such as 0.15 and 0.25.
    values = values + [m / 60 for m in range(0, 3000, 3)] + [m / 1440 for m in range(0, 4000, 36)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in frame.select(printed1(F.col("x"))).collect()] == [f"{v:.1f}" for v in values]
