from datetime import date, datetime

import pytest
from conftest import rows_of

from ticketscope.config import Config
from ticketscope.operators import options
from ticketscope.operators.filters import TicketFilter, apply_filters, checked_priorities


def numbers(frame) -> list[str]:
    return sorted(r["number"] for r in frame.collect())


@pytest.fixture(scope="module")
def some(tickets):
    return tickets(
        {"Site": "Store 1", "Company": "North", "Priority": "1 - Critical", "Created": "7/1/2025 0:00"},
        {"Site": "Store 2", "Company": "North", "Priority": "2 - High", "Created": "7/10/2025 0:00"},
        {"Site": "Store 2", "Company": "South", "Priority": "P1", "Created": "7/10/2025 0:01",
         "Resolved": "7/11/2025", "Category": "Oven", "Subcategory": ""},
        {"Site": "", "Company": "South", "Priority": None, "Created": "", "Category": "",
         "Subcategory": "Loose"},
        {"Site": "Store 3", "Company": "South", "Priority": "4 - Low", "Created": "7/11/2025 0:00",
         "Category": "Oven", "Subcategory": "Door", "Resolved": "junk"},
    )


@pytest.mark.parametrize("conditions, expected", [
    (TicketFilter(), ["T001", "T002", "T003", "T004", "T005"]),
    (TicketFilter(company="All", site="", category=None, priorities=[]),
     ["T001", "T002", "T003", "T004", "T005"]),
    (TicketFilter(date_from="2025-07-10"), ["T002", "T003", "T005"]),
    (TicketFilter(date_to="2025-07-10"), ["T001", "T002"]),
    (TicketFilter(date_to="2025-07-10", inclusive_end=True), ["T001", "T002", "T003"]),
    (TicketFilter(date_to=datetime(2025, 7, 10, 0, 1), inclusive_end=True), ["T001", "T002", "T003"]),
    (TicketFilter(date_from=date(2025, 7, 2), date_to=date(2025, 7, 11)), ["T002", "T003", "T005"]),
    (TicketFilter(priorities=["1 - Critical", "2 - High"]), ["T001", "T002"]),
    (TicketFilter(priorities=checked_priorities()), ["T001", "T002", "T005"]),
    (TicketFilter(company="South", site="Store 2"), ["T003"]),
    (TicketFilter(category="Oven", subcategory="Door"), ["T005"]),
    (TicketFilter(resolution_status="Open"), ["T001", "T002", "T004", "T005"]),
    (TicketFilter(resolution_status="Resolved"), ["T003"]),
])
def test_filters(some, conditions, expected):
    assert numbers(apply_filters(some, conditions)) == expected


def test_presets():
    now = "2025-07-15 10:30:00"
    assert TicketFilter.preset("Last 7 Days", now) == TicketFilter(date(2025, 7, 8), date(2025, 7, 15))
    assert TicketFilter.preset("Last 30 Days", now).date_from == date(2025, 6, 15)
    assert TicketFilter.preset("Last 90 Days", now).date_from == date(2025, 4, 16)
    assert TicketFilter.preset("This Year", now).date_from == date(2025, 1, 1)
    assert TicketFilter.preset("All Time", now) == TicketFilter()
    assert TicketFilter.preset(3, now, site="x") == TicketFilter(
        date(2025, 7, 12), date(2025, 7, 15), site="x"
    )
    with pytest.raises(ValueError):
        TicketFilter.preset("Last 8 Days", now)


def test_describe():
    assert TicketFilter(site="All").describe() == ["No filters applied"]
    assert TicketFilter(
        date_from="2025-01-01", date_to=date(2025, 2, 1), priorities=["1 - Critical", "2 - High"],
        company="North", site="Store 1", category="Oven", subcategory="Door",
    ).describe() == [
        "Date from: 2025-01-01", "Date to: 2025-02-01", "Priorities: 1 - Critical, 2 - High",
        "Company: North", "Site: Store 1", "Category: Oven", "Subcategory: Door",
    ]


def test_filter_options(some):
    found = rows_of(options.filter_options(some).orderBy("field", "value"))
    assert found == [
        ("category", "Oven"), ("category", "Printer"), ("company", "North"), ("company", "South"),
        ("priority", "1 - Critical"), ("priority", "2 - High"), ("priority", "4 - Low"),
        ("priority", "P1"), ("site", ""), ("site", "Store 1"), ("site", "Store 2"),
        ("site", "Store 3"),
    ]


def test_category_tree(some):
    assert rows_of(options.category_map(some)) == [("Oven", ""), ("Oven", "Door"), ("Printer", "Jam")]
    assert sorted(rows_of(options.subcategories(some, "Oven"))) == [("",), ("Door",)]
    assert rows_of(options.subcategories(some, "Unknown")) == []
    assert sorted(rows_of(options.all_subcategories(some))) == [("",), ("Door",), ("Jam",)]


def test_cascade_and_search(some):
    assert sorted(rows_of(options.sites_for_company(some, "South"))) == [("",), ("Store 2",), ("Store 3",)]
    assert options.sites_for_company(some, "All").count() == 4
    found = options.filter_options(some)
    assert sorted(rows_of(options.search_options(found, "STORE 2"))) == [("site", "Store 2")]
    assert options.search_options(found, "all").count() == found.count()
