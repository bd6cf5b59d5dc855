"""Stored rollups, sketches, pruning, one-pass export and checked loads."""

from datetime import date, datetime

import pytest
from conftest import AS_OF, rows_of
from pyspark.sql import functions as F

from checks.compare import _sorted_rows
from checks.ticket_views import raw_ticket_rows, tickets as ticket_view
from ticketscope import TicketDataset, TicketFilter
from ticketscope.config import DEFAULT_CONFIG, DERIVED_COLUMNS, STORED_COLUMNS
from ticketscope.operators import quality, summary
from ticketscope.operators.filters import apply_filters
from ticketscope.operators.normalize import blank_null_tokens, derive, normalize, with_inner_names
from ticketscope.operators.rollup import filtered_rollup, sites_of, ticket_rollup
from ticketscope.operators.sketches import ERROR_BOUND
from ticketscope.plans.bundle import bundle
from ticketscope.plans.reports import REPORTS, run_report
from ticketscope.sources.readers import file_metadata, read_tickets
from ticketscope.sources.writers import rebuild_rollup, store_tickets

SF_DIR = "/root/testdata/sf0.001"
NOW = "1998-07-15 10:30:00"
FILTERS = [
    TicketFilter(),
    TicketFilter(date_from="1998-03-01", date_to="1998-06-30"),
    TicketFilter(date_from=date(1998, 3, 1), date_to=date(1998, 6, 30), inclusive_end=True),
    TicketFilter(date_from="1998-03-01 06:30:00", date_to="1998-06-30 18:15:00", resolution_status="Open"),
    TicketFilter(date_from="1998-03-01 06:30:00", date_to="1998-03-01 18:15:00"),
    TicketFilter(date_from="1998-05-01", date_to="1998-03-01"),
    TicketFilter.preset("Last 90 Days", NOW, priorities=["1 - Critical", "2 - High"]),
    TicketFilter(company="NATION_7", resolution_status="Resolved"),
    TicketFilter(site="Customer#000000017"),
    TicketFilter(priorities=["1 - Critical"], site="nowhere"),
]


def same(a, b) -> bool:
    return _sorted_rows(a.columns, rows_of(a)) == _sorted_rows(b.columns, rows_of(b))


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def found(spark):
    tickets = ticket_view(spark, SF_DIR).filter("created > '1998-02-20' AND created < '1998-07-15'")
    midnight = F.when(F.substring("number", -1, 1) == "7", F.col("created").cast("date").cast("timestamp_ntz"))
    tickets = tickets.withColumn("created", F.coalesce(midnight, "created"))
    undated = tickets.limit(3).withColumn("created", F.lit(None).cast("timestamp_ntz"))
    return derive(tickets.unionByName(undated).drop(*DERIVED_COLUMNS), NOW).coalesce(2).persist()


@pytest.fixture(scope="module")
def stored(spark, found, tmp_path_factory):
    """Two loads of the tickets in one table."""
    path = str(tmp_path_factory.mktemp("tickets") / "stored")
    first = F.coalesce(F.substring("number", -1, 1) < "5", F.lit(True))
    TicketDataset(found, found.filter(first), NOW).store(path)
    TicketDataset(found, found.filter(~first), NOW).store(path, mode="append")
    return path


@pytest.mark.parametrize("conditions", FILTERS, ids=range(len(FILTERS)))
def test_reports_from_the_stored_rollup_equal_those_from_the_tickets(spark, found, stored, conditions):
    data = TicketDataset.open(spark, stored, NOW)
    plain = TicketDataset(found, found, NOW)
    for name in ("critical_hotspots", "site_scorecard", "green_list", "franchise_overview", "workload_trends"):
        assert rows_of(data.report(name, conditions)) == rows_of(plain.report(name, conditions)), name
    assert rows_of(data.filtered_count(conditions)) == rows_of(plain.filtered_count(conditions))
    assert rows_of(data.report_summary(conditions)) == rows_of(plain.report_summary(conditions))
    assert rows_of(data.summary()) == rows_of(plain.summary())


def test_reports_from_the_rollup_scan_no_ticket(spark, stored):
    data = TicketDataset.open(spark, stored, NOW)
    for conditions in FILTERS[:3]:
        for frame in (data.report("site_scorecard", conditions), data.report("franchise_overview", conditions),
                      data.report("green_list", conditions), data.filtered_count(conditions),
                      data.report_summary(conditions), data.summary()):
            plan = plan_of(frame)
            assert plan.count("FileScan parquet") >= 1 and "category" not in plan
            assert all("_rollup" in line for line in plan.split("FileScan parquet")[1:])
    # A range that cuts days reads these days of the tickets only.
    plan = plan_of(data.filtered_count(FILTERS[3]))
    scans = [part for part in plan.split("FileScan parquet")[1:] if "_rollup" not in part]
    assert scans and all("PartitionFilters: [ticketscope_day" in s or "ticketscope_day" in s.split("PushedFilters")[0] for s in scans)


def test_conditions_on_categories_read_the_tickets(spark, found, stored):
    conditions = TicketFilter(category=found.filter("category <> ''").first()["category"])
    data, plain = TicketDataset.open(spark, stored, NOW), TicketDataset(found, found, NOW)
    assert rows_of(data.report("site_scorecard", conditions)) == rows_of(plain.report("site_scorecard", conditions))
    with pytest.raises(ValueError, match="category"):
        filtered_rollup(data.rollup, conditions)
    labelled = filtered_rollup(ticket_rollup(found, labels=True), conditions)
    assert same(summary.count_of(sites_of(labelled)), summary.filtered_count(apply_filters(found, conditions)))
    with pytest.raises(ValueError, match="cuts"):
        filtered_rollup(data.rollup, FILTERS[3])


def test_tables_without_a_rollup_and_rebuilt_ones(spark, found, stored, tmp_path):
    path = str(tmp_path / "bare")
    found.drop("ticketscope_day").write.parquet(path)
    bare = TicketDataset.open(spark, path, NOW)
    assert bare.rollup is None and bare.sketches is None
    expected = rows_of(TicketDataset(found, found, NOW).report("site_scorecard"))
    assert rows_of(bare.report("site_scorecard")) == expected
    rebuild_rollup(spark, path)
    again = TicketDataset.open(spark, path, NOW)
    assert again.rollup is not None and rows_of(again.report("site_scorecard")) == expected
    TicketDataset(found, found.limit(0), NOW).store(path, mode="ignore")
    assert TicketDataset.open(spark, path, NOW).report_summary().first()["total_tickets"] == found.count()
    empty = str(tmp_path / "empty")
    TicketDataset(found, found.limit(0), NOW).store(empty)
    assert spark.read.parquet(f"{empty}/_rollup").count() == 0
    TicketDataset(found, found, NOW).store(empty, mode="overwrite")
    assert rows_of(TicketDataset.open(spark, empty, NOW).report("site_scorecard")) == expected


def test_stored_tickets_are_the_tickets(spark, found, stored):
    data = TicketDataset.open(spark, stored, NOW)
    assert not set(STORED_COLUMNS) & set(data.tickets.columns)
    columns = ["number", "site", "company", "created", "resolved", "priority", "category"]
    assert same(data.tickets.select(columns), found.select(columns))


def test_reports_need_numbers_from_the_rollup_too(spark, found, tmp_path):
    path = str(tmp_path / "t")
    TicketDataset(found, found.drop("number"), NOW).store(path)
    data = TicketDataset.open(spark, path, NOW)
    with pytest.raises(ValueError, match="Number"):
        data.report("site_scorecard")
    assert data.report_summary().first()["total_tickets"] == found.count()


def test_approximate_counts(spark, found, stored):
    data = TicketDataset.open(spark, stored, NOW)
    for approx, exact in ((data.profile(approx=True), summary.dataset_profile(found)),
                          (data.summary(approx=True), summary.data_summary(found)),
                          (TicketDataset(found, found, NOW).summary(approx=True), summary.data_summary(found))):
        a, e = approx.first().asDict(), exact.first().asDict()
        names = [n for n in e if n in ("sites", "companies", "categories", "unique_sites", "unique_companies")]
        assert all(abs(a[n] - e[n]) <= ERROR_BOUND * e[n] for n in names)
        assert {n: a[n] for n in e if n not in (*names, "columns")} == {n: e[n] for n in e if n not in (*names, "columns")}
    plan = plan_of(data.summary(approx=True))
    assert all("_rollup" in p or "_sketches" in p for p in plan.split("FileScan parquet")[1:])
    a = {r.company: r for r in data.approximate_overview().collect()}
    for row in run_report("franchise_overview", found, NOW).collect():
        assert abs(a[row.company].sites - row.sites) <= max(1, ERROR_BOUND * row.sites)
        assert a[row.company].total_tickets == row.total_tickets
    empty = TicketDataset(found, found.limit(0), NOW)
    assert empty.profile(approx=True).first()["sites"] == 0


def test_one_site_reads_few_rows_of_a_day(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 1).select(
        F.concat(F.lit("Store "), F.lpad((F.col("id") % 400).cast("string"), 3, "0")).alias("Site"),
        F.col("id").cast("string").alias("Number"), F.lit("2 - High").alias("Priority"),
        F.lit("7/1/2025 8:00").alias("Created"), F.lit("North").alias("Company"))
    path = str(tmp_path / "t")
    store_tickets(normalize(rows, AS_OF), path, parquet={
        "parquet.page.row.count.limit": "500", "parquet.block.size": "100000", "parquet.page.size.row.check.min": "1"})
    day = TicketDataset.open(spark, path, AS_OF).tickets

    def rows_read(frame) -> int:
        plan = frame._jdf.queryExecution().executedPlan()
        frame.collect()
        stack = [plan]
        total = 0
        while stack:
            node = stack.pop()
            if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                stack.append(node.executedPlan())
            if "Scan" in node.nodeName():
                total += node.metrics().apply("numOutputRows").value()
            children = node.children()
            stack += [children.apply(i) for i in range(children.size())]
        return total

    one = day.filter(F.col("site") == "Store 123").select("number")
    assert one.count() == 100 and rows_read(one) <= 4_000
    # A site that is not there but lies between others: the Bloom filter says so.
    assert rows_read(day.filter(F.col("site") == "Store 1230").select("number")) == 0


def test_bundle_scans_its_copy_four_times(spark, found, tmp_path):
    path = str(tmp_path / "out")
    data = TicketDataset(found, found, NOW)
    counts = data.export_everything(path, FILTERS[1])
    filtered = data.filtered(FILTERS[1])
    expected = {name: run_report(name, filtered, NOW, as_text=True).count() for name in REPORTS}
    expected |= {"raw_data": filtered.count(), "summary": summary.summary_sheet(filtered, NOW).count()}
    assert counts == expected
    for name in REPORTS:
        found_rows = spark.read.option("header", True).csv(f"{path}/{name}").count()
        assert found_rows == expected[name]
    copy = spark.read.parquet(f"{path}/tickets")
    rollup = spark.read.parquet(f"{path}/tickets/_rollup")
    frames = bundle(copy, derive(with_inner_names(copy), NOW), rollup, NOW, DEFAULT_CONFIG)
    scans = sum(any("_rollup" not in file for file in frame.inputFiles()) for frame in frames.values())
    assert len(frames) == 11 and scans + 1 <= 4  # and one for the rollup
    for name, frame in frames.items():
        if name in REPORTS:
            assert same(frame, run_report(name, filtered, NOW, as_text=True)), name


def test_files_of_a_load(spark, tmp_path):
    folder = tmp_path / "two.csv"
    folder.mkdir()
    (folder / "a.csv").write_text('Site,Number,Priority,Created,Company\nS1,1,2 - High,6/2/2025,"N\nM"\nS1,2,2 - High,6/2/2025,N\n')
    (folder / "b.csv").write_text("Site,Number,Priority,Created,Company\nS2,2,2 - High,6/2/2025,N\n")
    rows = {r.file_name: r for r in file_metadata(spark, str(folder), AS_OF, "csv").collect()}
    assert {n: r.total_records for n, r in rows.items()} == {"a.csv": 2, "b.csv": 1}
    assert rows["a.csv"].file_size == (folder / "a.csv").stat().st_size and rows["a.csv"].file_path.endswith("two.csv/a.csv")
    assert rows["b.csv"].columns == "Site, Number, Priority, Created, Company"
    data = TicketDataset.load(spark, str(folder), AS_OF, format="csv")
    assert data.files(AS_OF, "csv").agg(F.sum("total_records")).first()[0] == data.metadata(AS_OF).first()["total_records"]
    for kind in ("parquet", "json"):
        read_tickets(spark, str(folder), "csv").repartition(2).write.format(kind).save(str(tmp_path / kind))
        found = file_metadata(spark, str(tmp_path / kind), AS_OF, kind)
        assert found.agg(F.sum("total_records")).first()[0] == 3
    with pytest.raises(ValueError):
        file_metadata(spark, "t", AS_OF, "table")


def test_folders_of_several_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Store,Number,Severity,Opened,Franchise,Extra\nS1,1,2 - High,6/2/2025,N,x\n")
    (tmp_path / "b.csv").write_text('﻿Number,branch,priority,created,owner\n2,"S, 2",1 - Critical,6/3/2025,M\n3,S3,,6/4/2025,M\n')
    (tmp_path / "c.csv").write_text("Store,Number,Severity,Opened,Franchise,Extra\nS4,4,4 - Low,6/5/2025,N,NULL\n")
    data = TicketDataset.load_mixed(spark, str(tmp_path), AS_OF)
    rows = {r["number"]: r for r in data.tickets.collect()}
    assert {n: r["site"] for n, r in rows.items()} == {"1": "S1", "2": "S, 2", "3": "S3", "4": "S4"}
    assert rows["2"]["company"] == "M" and rows["2"]["created"] == datetime(2025, 6, 3) and rows["3"]["priority"] is None
    assert (rows["1"]["Extra"], rows["2"]["Extra"], rows["4"]["Extra"]) == ("x", None, None)
    mapped = TicketDataset.load_mixed(spark, str(tmp_path), AS_OF, column_mapping={"Extra": "Category"})
    assert {r["number"]: r["category"] for r in mapped.tickets.collect()} == {"1": "x", "2": "", "3": "", "4": ""}
    empty = tmp_path / "nothing"
    empty.mkdir()
    (empty / "x.csv").write_text("")
    with pytest.raises(ValueError, match="header"):
        TicketDataset.load_mixed(spark, str(empty), AS_OF)


def test_checked_store_finds_what_validation_finds(spark, tmp_path):
    raw = blank_null_tokens(raw_ticket_rows(spark, SF_DIR)).filter("`Row key` < '13'").coalesce(1).persist()
    path = str(tmp_path / "t")
    data = TicketDataset(raw, normalize(raw, AS_OF), AS_OF)
    assert same(data.store_checked(path), quality.validate(raw))
    # Appended rows are checked by themselves, also if they repeat numbers of the first load.
    some = raw.limit(50).withColumn("ticketscope_malformed_row", F.lit("x"))
    more = TicketDataset(some, normalize(some, AS_OF), AS_OF)
    assert same(more.store_checked(path, mode="append"), quality.validate(some))
    again = TicketDataset.open(spark, path, AS_OF)
    assert again.tickets.count() == raw.count() + 50 and not set(STORED_COLUMNS) & set(again.tickets.columns)
    assert again.report_summary().first()["total_tickets"] == raw.count() + 50
    nothing = TicketDataset(raw.limit(0), normalize(raw.limit(0), AS_OF), AS_OF)
    assert same(nothing.store_checked(str(tmp_path / "none")), quality.validate(raw.limit(0)))
    with pytest.raises(ValueError, match="Missing"):
        TicketDataset(raw.drop("Site"), data.tickets, AS_OF).store_checked(str(tmp_path / "x"))


def test_validation_reads_the_rows_once(spark, tmp_path):
    raw_ticket_rows(spark, SF_DIR).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    assert plan_of(quality.validate(raw)).count("FileScan parquet") == 1
    hot = raw.withColumn("Number", F.lit("same"))
    found = {r.check_name: r.finding_count for r in quality.validate(hot).collect()}
    assert found["duplicates"] == 1 and found["record_count"] == raw.count()
    assert "duplicates" not in {r.check_name for r in quality.validate(raw.withColumn("Number", F.lit(None).cast("string"))).collect()}
