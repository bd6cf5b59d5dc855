from datetime import datetime

from conftest import AS_OF, rows_of

from ticketscope.config import DATE_FORMATS, EXTENDED_DATE_FORMATS, Config
from ticketscope.operators import quality, summary
from ticketscope.operators.filters import TicketFilter, apply_filters
from ticketscope.operators.normalize import blank_null_tokens


def test_validation_of_good_data(raw):
    assert rows_of(quality.validate(raw({}, {}))) == [("record_count", "", "info", 2, "2 records")]


def test_validation_findings(raw):
    rows = raw(
        {"Priority": "P1", "Number": "X"}, {"Priority": "2 - High ", "Number": "X"},
        {"Priority": None, "Number": "X", "Created": "2025-02-30"}, {"Number": None, "Created": None},
        {"Number": None, "Resolved": "soon"}, *[{}] * 4, {"Site": None},
    )
    assert sorted(rows_of(quality.validate(rows))) == [
        ("bad_dates", "Created", "warning", 2, "Column 'Created' has 2 invalid date formats"),
        ("bad_dates", "Resolved", "warning", 1,
         "Column 'Resolved' has 1 invalid date formats (excluding legitimately empty values)"),
        ("duplicates", "Number", "warning", 1, "Found 1 duplicate ticket numbers"),
        ("priority_values", "Priority", "warning", 2, "2 unexpected priority values found"),
        ("record_count", "", "info", 10, "10 records"),
    ]
    assert sorted(rows_of(quality.unexpected_priorities(rows))) == [("2 - High ",), ("P1",)]
    # Exactly 10 % is no warning, more than 10 % is.
    assert not any(r["warns"] for r in quality.completeness(rows).collect())
    found = quality.completeness(rows.filter("Number is not null"))
    assert rows_of(found.filter("column_name = 'Site'")) == [("Site", 1, 12.5, 87.5, True)]


def test_missing_columns_and_empty_data(raw):
    found = quality.validate(raw({}, drop=("Company", "Number", "Resolved")))
    assert ("required_columns", "Company", "error", 1, "Missing required columns: Company") in rows_of(found)
    empty = rows_of(quality.validate(raw({}).filter("false")))
    assert empty == [("record_count", "", "info", 0, "0 records"),
                     ("no_data", "", "error", 0, "No data found in file")]


def test_null_tokens_are_missing(raw):
    rows = blank_null_tokens(raw({"Site": "N/A"}, {"Site": "null"}, {"Site": " NA"}))
    found = {r["column_name"]: r["null_count"] for r in quality.completeness(rows).collect()}
    assert found == {"Site": 2, "Priority": 0, "Created": 0, "Company": 0}


def test_detect_date_format(raw):
    rows = raw(*[{"Created": "7/1/2025 8:00"}] * 9, {"Created": "junk"})
    found = quality.detect_date_format(rows, "Created", DATE_FORMATS)
    assert rows_of(found.filter("detected"), "date_format", "match_share") == [("M/d/yyyy H:m", 0.9)]
    # Ambiguous days: the earlier format of a tie wins. 80 % is not enough.
    tie = quality.detect_date_format(raw({"Created": "3/4/2025"}), "Created", EXTENDED_DATE_FORMATS)
    assert rows_of(tie.filter("detected"), "date_format") == [("M/d/yyyy",)]
    few = raw(*[{"Created": "7/1/2025"}] * 4, {"Created": None})
    assert quality.detect_date_format(few, "Created", DATE_FORMATS).filter("detected").count() == 0


def test_summaries(tickets):
    found = tickets(
        {"Priority": "1 - Critical", "Created": "7/1/2025 0:00", "Resolved": "7/1/2025 12:15"},
        {"Site": "Store 2", "Created": "7/3/2025 23:00"}, {"Created": "junk", "Resolved": "7/9/2025"},
    )
    first, last = datetime(2025, 7, 1), datetime(2025, 7, 3, 23)
    assert rows_of(summary.report_summary(found)) == [
        (3, 1, 33.3, 2, 66.7, 2, 1, first, last, 12.2)
    ]
    assert rows_of(summary.date_range(found)) == [
        ("Created", first, last, 2),
        ("Resolved", datetime(2025, 7, 1, 12, 15), datetime(2025, 7, 9), 2),
    ]
    row = summary.data_summary(found).first()
    assert (row["open_tickets"], row["avg_resolution_hours"], row["time_span_days"]) == (1, 12.25, 2)
    assert [r["line"] for r in summary.data_summary_lines(found).orderBy("position").collect()] == [
        "Total Tickets: 3", "Critical Tickets: 1 (33.3%)", "Resolved Tickets: 2 (66.7%)",
        "Open Tickets: 1", "Unique Sites: 2", "Unique Companies: 1",
        "Average Resolution Time: 12.2 hours", "Date Range: 2025-07-01 to 2025-07-03",
        "Time Span: 2 days",
    ]
    profile = summary.dataset_profile(found)
    assert rows_of(profile.drop("columns")) == [(3, 3, 2, 1, 1)]
    assert profile.first()["columns"] == ", ".join(found.columns)
    assert rows_of(summary.filtered_count(found)) == [(3, 1, "Filtered: 3 tickets (1 critical)")]
    none = apply_filters(found, TicketFilter(site="Store 2"))
    assert rows_of(summary.filtered_count(none)) == [(1, 0, "Filtered: 1 tickets")]


def test_summary_sheet(tickets):
    found = tickets({"Created": "7/1/2025 0:00"}, {"Created": "7/2/2025 0:00"})
    sheet = summary.summary_sheet(found, AS_OF).orderBy("position")
    assert rows_of(sheet, "metric", "value") == [
        ("Report Generated", "2025-08-01 00:00:00"), ("Total Records", "2"),
        ("Critical Incidents", "0"), ("Critical Percentage", "0.0%"), ("Resolved Tickets", "0"),
        ("Resolution Rate", "0.0%"), ("Open Tickets", "2"), ("Unique Sites", "1"),
        ("Unique Companies", "1"), ("Average Resolution Time (hours)", "N/A"),
        ("Date Range Start", "2025-07-01"), ("Date Range End", "2025-07-02"),
    ]
    empty = summary.summary_sheet(found.filter("false"), AS_OF)
    assert empty.count() == 10
    assert rows_of(summary.data_summary(found.filter("false")), "total_tickets") == [(0,)]


def test_config_of_required_columns(raw):
    found = quality.validate(raw({}), Config(required_columns=("Site", "Owner")))
    assert ("required_columns", "Owner", "error", 1, "Missing required columns: Owner") in rows_of(found)
