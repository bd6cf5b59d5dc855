"""A file of 100 invented tickets whose figures follow from the rule that makes them.

Ticket i (0 to 99) has site i % 10, and its company is that of site % 3. Every tenth ticket is of
one site, so a site has ten tickets. Ticket i is critical if i % 20 = 0 (all of site 0), open if
i % 5 = 4 (sites 4 and 9), and was created on day i % 50 after Monday, 2 June 2025, at 8:00. The
others were resolved after i % 4 + 1 days.
"""

from datetime import datetime, timedelta

import pytest
from conftest import AS_OF, rows_of

from ticketscope import TicketDataset, TicketFilter
from ticketscope.operators import options


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    lines = ["Site,Number,Short description,Category,Subcategory,Priority,Created,Resolved,Company"]
    for i in range(100):
        created = datetime(2025, 6, 2, 8) + timedelta(days=i % 50)
        resolved = "" if i % 5 == 4 else f"{created + timedelta(days=i % 4 + 1):%m/%d/%Y %H:%M}"
        priority = "1 - Critical" if i % 20 == 0 else ("2 - High", "3 - Medium", "4 - Low")[i % 3]
        lines.append(
            f"Store {i % 10},CS{i:04},Thing {i},Kind {i % 4},Part {i % 2},{priority},"
            f"{created:%m/%d/%Y %H:%M},{resolved},\"Company {i % 10 % 3}, LLC\""
        )
    path = tmp_path_factory.mktemp("tickets") / "hundred.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return TicketDataset.load(spark, str(path), AS_OF)


def test_summary(data):
    row = data.summary().first()
    assert (row["total_tickets"], row["critical_tickets"], row["open_tickets"]) == (100, 5, 20)
    assert (row["unique_sites"], row["unique_companies"]) == (10, 3)
    assert str(row["first_created"]) == "2025-06-02 08:00:00"
    assert str(row["last_created"]) == "2025-07-21 08:00:00"
    # Of each 20 tickets 16 are resolved, four after each of 1, 2, 3 and 4 days.
    assert row["avg_resolution_hours"] == 60.0


@pytest.mark.parametrize("name, rows", [
    ("critical_hotspots", 1), ("site_scorecard", 10), ("green_list", 9), ("franchise_overview", 3),
    # Kinds 0 and 2 go with part 0, kinds 1 and 3 with part 1; a site has two kinds, five times each.
    ("equipment_analysis", 4), ("repeat_offenders", 20), ("workload_trends", 8),
    ("incident_details", 100),
])
def test_report_sizes(data, name, rows):
    assert data.report(name).count() == rows
    assert data.report(name, as_text=True).count() == rows


def test_reports(data):
    assert rows_of(data.report("critical_hotspots"), "site", "critical_count", "days_since_last") == [
        ("Store 0", 5, 19)  # tickets 0, 20, 40, 60, 80: the last one of 12 July, 8:00
    ]
    assert data.hotspot_tickets().count() == 5
    companies = {r["company"]: r["total_tickets"] for r in data.report("franchise_overview").collect()}
    assert companies == {"Company 0, LLC": 40, "Company 1, LLC": 30, "Company 2, LLC": 30}
    weeks = rows_of(data.report("workload_trends"), "new_tickets")
    assert weeks == [(2,), *[(14,)] * 7]


def test_filters_and_options(data):
    first_week = TicketFilter(date_from="2025-06-02", date_to="2025-06-09")
    assert data.filtered(first_week).count() == 14
    assert data.filtered(TicketFilter(resolution_status="Open")).count() == 20
    assert options.category_map(data.tickets).count() == 4
    assert rows_of(data.validation(), "check_name") == [("record_count",)]
