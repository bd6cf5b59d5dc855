from datetime import date, datetime

import pytest
from conftest import AS_OF, rows_of
from pyspark.sql import functions as F

from ticketscope.config import Config
from ticketscope.dataset import TicketDataset
from ticketscope.operators.site_reports import hotspot_tickets
from ticketscope.operators.summary import dataset_profile
from ticketscope.operators.ticket_reports import site_drill_down, with_sample_tickets
from ticketscope.plans.reports import REPORTS, run_report
from ticketscope.sources.writers import selected_rows

CRIT = "1 - Critical"


def text(name, tickets, **options):
    return rows_of(run_report(name, tickets, AS_OF, as_text=True, **options))


def test_hotspots(tickets):
    found = tickets(
        {"Priority": CRIT, "Created": "7/3/2025 9:00"},
        {"Priority": CRIT, "Created": "7/1/2025 9:00"},
        {"Priority": CRIT, "Created": "7/2/2025 9:00", "Company": "South"},
        {"Priority": CRIT, "Created": "", "Company": "South"},
        {"Priority": CRIT, "Site": "Store 2", "Created": "7/9/2025"},
        {"Priority": CRIT, "Site": "Store 3", "Created": "7/9/2025", "Number": None},
        {"Priority": CRIT, "Site": "Store 3", "Created": "8/1/2025 1:00", "Number": None},
        {"Site": "Store 2"},
    )
    assert text("critical_hotspots", found) == [
        ("Store 3", "North Foods, LLC", 2, "2025-08-01 01:00", "-1"),
        ("Store 1", "North Foods, LLC", 2, "2025-07-03 09:00", "28"),
    ]
    # The list of Store 1 covers both companies; a missing date sorts last and does not count.
    listed = TicketDataset(found, found, AS_OF).hotspot_tickets(as_text=True)
    assert rows_of(listed, "Site", "Company", "Created", "Ticket #") == [
        ("Store 1", "North Foods, LLC", "2025-07-01 09:00", "T002"),
        ("Store 1", "South", "2025-07-02 09:00", "T003"),
        ("Store 1", "North Foods, LLC", "2025-07-03 09:00", "T001"),
        ("Store 1", "South", "N/A", "T004"),
        ("Store 3", "North Foods, LLC", "2025-07-09 00:00", "No ticket #"),
        ("Store 3", "North Foods, LLC", "2025-08-01 01:00", "No ticket #"),
    ]
    assert run_report("critical_hotspots", found, AS_OF, Config(critical_threshold=1)).count() == 4


def test_tickets_of_a_hot_site_go_to_several_tasks(spark, tickets):
    found = tickets(*[{"Priority": CRIT}] * 200, {"Site": "Store 2", "Priority": CRIT}).coalesce(1)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "24"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        listed = hotspot_tickets(found).select(F.spark_partition_id().alias("task"), "number")
        rows = listed.collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len({row["task"] for row in rows}) > 8
    assert len(rows) == 200


def _scans(frame) -> int:
    return frame._jdf.queryExecution().optimizedPlan().toString().count("Relation ")


def test_one_scan_per_report(spark, tickets, tmp_path):
    tickets({}).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for name in ("equipment_analysis", "critical_hotspots", "site_scorecard", "franchise_overview"):
        assert _scans(run_report(name, stored, AS_OF)) == 1
    assert _scans(dataset_profile(stored)) == 1
    chosen = run_report("critical_hotspots", stored, AS_OF, ordered=False)
    card = run_report("site_scorecard", stored, AS_OF, ordered=False)
    assert _scans(selected_rows(card, chosen, ["site", "company"])) == 2


def test_identical_tickets_are_sorted_by_several_tasks(spark, tickets):
    found = tickets(*[{"Number": "SAME"}] * 400).repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = run_report("incident_details", found, AS_OF)
        tasks = [r[0] for r in rows.select(F.spark_partition_id()).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(tasks) == 400 and len(set(tasks)) > 1
    assert rows.columns == run_report("incident_details", found, AS_OF, ordered=False).columns


def test_scorecard_status_edges(tickets):
    found = tickets(
        {"Site": "A", "Created": "7/1/2025 0:00", "Resolved": "7/2/2025 0:00"},
        {"Site": "B", "Created": "7/1/2025 0:00", "Resolved": "7/2/2025 0:06"},
        {"Site": "C", "Created": "7/1/2025 0:00", "Resolved": "7/3/2025 0:00"},
        {"Site": "D", "Created": "7/1/2025 0:00", "Resolved": "7/3/2025 0:06"},
        {"Site": "E", "Created": "8/1/2025 0:00"},
        {"Site": "F", "Created": "7/1/2025 0:00", "Resolved": "6/30/2025 0:00", "Priority": CRIT},
        {"Site": "F", "Created": "6/1/2025 0:00"},
        {"Site": "G", "Number": None},
    )
    company = "North Foods, LLC"
    assert text("site_scorecard", found) == [
        ("F", company, 2, 1, "50.0%", "N/A", "61", "🟢 Good"),
        ("D", company, 1, 0, "0.0%", "48.1h", "31", "🔴 High Risk"),
        ("C", company, 1, 0, "0.0%", "48.0h", "31", "🟡 Medium Risk"),
        ("B", company, 1, 0, "0.0%", "24.1h", "31", "🟡 Medium Risk"),
        ("A", company, 1, 0, "0.0%", "24.0h", "31", "🟢 Good"),
        ("E", company, 1, 0, "0.0%", "N/A", "N/A", "🟢 Good"),
        ("G", company, 0, 0, "N/A", "N/A", "30", "🟢 Good"),
    ]
    core = {r["site"]: r for r in run_report("site_scorecard", found, AS_OF).collect()}
    assert core["F"]["avg_mttr_hours"] == -24.0
    assert (core["A"]["longest_open_days"], core["A"]["longest_truly_open_days"]) == (31, None)
    assert core["G"]["critical_pct"] is None


def test_percentages_send_ties_to_even(tickets):
    # 1 of 400 is 0.25 %, shown as 0.2; a mean of 12.25 h is shown as 12.2.
    found = tickets(
        {"Priority": CRIT, "Created": "7/1/2025 0:00", "Resolved": "7/1/2025 12:15"},
        *[{}] * 399,
    )
    assert text("site_scorecard", found)[0][4:6] == ("0.2%", "12.2h")


def test_green_list(tickets):
    found = tickets(
        {"Site": "A"}, {"Site": "B"}, {"Site": "B", "Created": "7/30/2025 12:00"},
        {"Site": "C", "Priority": CRIT}, {"Site": "D", "Created": "junk"},
        {"Site": "A", "Company": "South"},
    )
    assert text("green_list", found) == [
        ("B", "North Foods, LLC", 2, "2025-07-30", "1"),
        ("A", "North Foods, LLC", 1, "2025-07-01", "30"),
        ("A", "South", 1, "2025-07-01", "30"),
        ("D", "North Foods, LLC", 1, "N/A", "N/A"),
    ]


def test_franchise_overview(tickets):
    hour = {"Created": "7/1/2025 0:00", "Resolved": "7/1/2025 1:00"}
    found = tickets(
        {"Site": "B", **hour, "Priority": CRIT}, {"Site": "A", "Priority": CRIT},
        {"Site": "C"}, {"Site": "D"}, {"Site": "D"},
        {"Site": "Z", "Company": "South"}, {"Site": "Y", "Company": "South"},
    )
    # Ties of best and worst site go to the first name.
    assert text("franchise_overview", found) == [
        ("South", 2, 2, "0.0%", "N/A", "1.0", "Y", "Y"),
        ("North Foods, LLC", 4, 5, "40.0%", "1.0h", "1.2", "C", "A"),
    ]


def test_equipment_analysis(tickets):
    found = tickets(
        {"Site": "B"}, {"Site": "A"}, {"Site": "B", "Number": None, "Priority": CRIT},
        {"Site": "D", "Subcategory": "Toner"}, {"Site": "C", "Subcategory": "Toner"},
        {"Category": "", "Subcategory": "", "Created": "7/1/2025", "Resolved": "7/2/2025"},
    )
    # The share is of all six rows, the count leaves out the row without a number.
    assert text("equipment_analysis", found) == [
        ("Printer", "Jam", 2, "33.3%", 1, "50.0%", "N/A", "B"),
        ("Printer", "Toner", 2, "33.3%", 0, "0.0%", "N/A", "C"),
        ("", "", 1, "16.7%", 0, "0.0%", "24.0h", "Store 1"),
    ]


def test_repeat_offenders(tickets):
    found = tickets(
        {"Created": "7/1/2025 10:00"}, {"Created": "7/3/2025 9:00", "Priority": CRIT}, {},
        *[{"Category": "Oven", "Created": "junk"}] * 3,
        *[{"Site": "Store 2"}] * 2, {"Site": "Store 2", "Number": None},
    )
    assert text("repeat_offenders", found) == [
        ("Store 1", "North Foods, LLC", "Printer", 3, 2, 1, 35),
        ("Store 1", "North Foods, LLC", "Oven", 3, 0, 0, 30),
    ]


def test_resolution_tracking(tickets):
    start = {"Created": "7/1/2025 0:00"}
    found = tickets(
        {**start, "Priority": CRIT, "Resolved": "7/1/2025 4:00"},
        {**start, "Priority": CRIT, "Resolved": "7/1/2025 4:09"},
        {**start, "Priority": "2 - High", "Resolved": "7/2/2025 0:00"},
        {**start, "Priority": "2 - High", "Resolved": "7/3/2025 12:00"},
        {**start, "Priority": "3 - Medium", "Resolved": "7/4/2025 0:01"},
        {**start, "Priority": "4 - Low", "Resolved": "7/10/2025 0:00"},
        {**start, "Priority": "P1", "Resolved": "7/10/2025 0:00"},
        {**start, "Priority": CRIT, "Resolved": "6/1/2025 0:00"},
        {**start, "Priority": CRIT},
        {**start, "Priority": CRIT, "Resolved": "7/1/2025 4:15", "Number": None},
    )
    missed = "🔴 Missed SLA"
    # 4.15 hours is stored slightly above 4.15 and prints as 4.2, 4.25 is a true tie.
    assert text("resolution_tracking", found) == [
        ("Store 1", "T006", "4 - Low", f"{9.0:.1f}d", "7.0d", missed, "2.0d"),
        ("Store 1", "T004", "2 - High", "2.5d", "1.0d", missed, "1.5d"),
        ("Store 1", "N/A", CRIT, f"{4.25:.1f}h", "4h", missed, "0.0d"),
        ("Store 1", "T002", CRIT, f"{4 + 9 / 60:.1f}h", "4h", missed, "0.0d"),
        ("Store 1", "T005", "3 - Medium", "3.0d", "3.0d", missed, "0.0d"),
    ]
    own = Config(mttr_targets={"P1": 1.5})
    assert rows_of(run_report("resolution_tracking", found, AS_OF, own, as_text=True),
                   "Priority", "Target") == [("P1", "1.5h")]
    assert run_report("resolution_tracking", found, AS_OF, Config(mttr_targets={})).count() == 0


def test_workload_trends(tickets):
    found = tickets(
        {"Created": "7/6/2025 23:59"},  # Sunday
        {"Created": "7/7/2025 0:00", "Resolved": "7/20/2025"},  # Monday
        {"Created": "7/9/2025 0:00", "Resolved": "7/9/2025 1:00", "Priority": CRIT},
        {"Created": "7/13/2025 23:59"},
        {"Created": "12/30/2024 1:00", "Resolved": "1/2/2025"},
        {"Created": "junk"},
        {"Created": "7/15/2025 1:00", "Number": None, "Resolved": "7/16/2025"},
    )
    assert text("workload_trends", found) == [
        ("07/14 - 07/20", 0, 0, "N/A", 1, "N/A", "📉 1", "Tuesday"),
        ("07/07 - 07/13", 3, 1, "33.3%", 2, "66.7%", "📈 1", "Monday"),
        ("06/30 - 07/06", 1, 0, "0.0%", 0, "0.0%", "📈 1", "Sunday"),
        ("12/30 - 01/05", 1, 0, "0.0%", 1, "100.0%", "➡️ 0", "Monday"),
    ]
    assert run_report("workload_trends", found, AS_OF).first()["week_start"] == date(2025, 7, 14)


def test_incident_details(tickets):
    long = "x" * 61
    found = tickets(
        {"Short description": f" {long} ", "Created": "7/1/2025 0:00", "Resolved": "7/1/2025 23:54"},
        {"Short description": "y" * 60, "Created": "7/2/2025 0:00", "Resolved": "7/3/2025 0:00"},
        {"Short description": "", "Category": "", "Created": "7/3/2025 0:00", "Number": None},
        {"Created": "junk", "Subcategory": "nan", "Priority": None},
        {"Created": "junk", "Resolved": "7/3/2025 0:00"},
        {"Created": "7/4/2025 0:00", "Resolved": "7/3/2025 0:00"},
        {"Site": "Aaa", "Category": "", "Subcategory": ""},
    )
    company = "North Foods, LLC"
    medium = "3 - Medium"
    assert text("incident_details", found) == [
        ("Aaa", "T007", "HW-Printer", "Other", medium, "2025-07-01 08:00", "Open", "30d open", "Open", company),
        ("Store 1", "T006", "HW-Printer", "Printer - Jam", medium, "2025-07-04 00:00", "2025-07-03 00:00", "N/A", "Resolved", company),
        ("Store 1", "N/A", "No description", "Other - Jam", medium, "2025-07-03 00:00", "Open", "29d open", "Open", company),
        ("Store 1", "T002", "y" * 60, "Printer - Jam", medium, "2025-07-02 00:00", "2025-07-03 00:00", "1.0d", "Resolved", company),
        ("Store 1", "T001", "x" * 57 + "...", "Printer - Jam", medium, "2025-07-01 00:00", "2025-07-01 23:54", "23.9h", "Resolved", company),
        ("Store 1", "T004", "HW-Printer", "Printer", None, "N/A", "Open", "N/A", "Open", company),
        ("Store 1", "T005", "HW-Printer", "Printer - Jam", medium, "N/A", "2025-07-03 00:00", "N/A", "Resolved", company),
    ]
    assert rows_of(site_drill_down(found, "Aaa", AS_OF), "number") == [("T007",)]
    assert site_drill_down(found, "Nowhere", AS_OF).count() == 0


def test_sample_tickets(tickets):
    found = tickets(
        *[{"Site": "A"}] * 2, *[{"Site": "B"}] * 3,
        *[{"Site": "C", "Created": f"7/{9 - i}/2025"} for i in range(4)],
        {"Site": "D", "Number": None},
        *[{"Site": "E"}] * 2, {"Site": "E", "Number": None}, {"Site": "E", "Number": None},
    )
    report = run_report("green_list", found, AS_OF, ordered=False).select("site")
    report = report.union(report.sparkSession.sql("select 'Gone'"))
    assert sorted(rows_of(with_sample_tickets(report, found))) == [
        ("A", "T001, T002"), ("B", "T003, T004, T005"), ("C", "T009, T008, T007 (+1 more)"),
        ("D", "No ticket #s"), ("E", "T011, T012"), ("Gone", "No tickets"),
    ]
    with pytest.raises(ValueError, match="site"):
        with_sample_tickets(run_report("franchise_overview", found, AS_OF), found)


@pytest.mark.parametrize("name", REPORTS)
def test_empty_input_gives_typed_empty_reports(tickets, name):
    none = tickets({}).filter("false")
    some = tickets({})
    for as_text in (False, True):
        empty = run_report(name, none, AS_OF, as_text=as_text)
        assert empty.count() == 0
        assert empty.schema == run_report(name, some, AS_OF, as_text=as_text).schema


def test_unknown_report(tickets):
    with pytest.raises(ValueError, match="Unknown report"):
        run_report("nonsense", tickets({}), AS_OF)


def test_age_of_open_tickets_uses_as_of(tickets):
    found = tickets({"Created": "7/1/2025 8:00"}, as_of="2025-07-02 07:59:59")
    shown = run_report("incident_details", found, datetime(2025, 7, 2, 7, 59, 59), as_text=True)
    assert shown.first()["Resolution Time"] == "0d open"
