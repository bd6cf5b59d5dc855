import json
import os

import pytest
from conftest import AS_OF, rows_of

from checks.compare import _sorted_rows
from ticketscope import TicketDataset, TicketFilter
from ticketscope.config import DAY_COLUMN, MALFORMED_COLUMN
from ticketscope.operators.filters import apply_filters
from ticketscope.operators.normalize import normalize, without_derived
from ticketscope.plans.reports import REPORTS, run_report
from ticketscope.sources.readers import load_metadata, read_stored, read_tickets
from ticketscope.sources.writers import (
    export,
    export_selected,
    export_tickets,
    selected_rows,
)

CSV = '''Site,Number,Short description,Category,Subcategory,Priority,Created,Resolved,Company,Owner
"Store ""1"", North",0007,"two
lines",Printer,Jam,1 - Critical,6/2/2025 9:24,6/2/2025 15:06,"North Foods, LLC",Ann
 Store 2 ,,plain,N/A,"",2 - High,6/3/2025 9:24,,South,NULL
'''


@pytest.fixture()
def csv(tmp_path):
    path = tmp_path / "tickets.csv"
    path.write_text(CSV, encoding="utf-8")
    return str(path)


def same(a, b) -> bool:
    return _sorted_rows(a.columns, rows_of(a)) == _sorted_rows(b.columns, rows_of(b))


def test_read_csv(spark, csv):
    raw = read_tickets(spark, csv)
    assert dict(raw.dtypes) == {name: "string" for name in raw.columns}
    rows = {r["Company"]: r for r in raw.collect()}
    north = rows["North Foods, LLC"]
    assert (north["Site"], north["Number"]) == ('Store "1", North', "0007")
    assert north["Short description"] == "two\nlines"
    south = rows["South"]
    assert (south["Site"], south["Number"], south["Category"], south["Owner"]) == (
        " Store 2 ", None, None, None
    )


def test_over_long_and_short_rows(spark, tmp_path):
    header, *_ = CSV.splitlines()
    path = tmp_path / "odd.csv"
    path.write_text(f"""{header}
Store 1,1,"a, ""b"", c",Printer,Jam,2 - High,6/2/2025,,North,Ann
Store 2,2,plain,Printer,Jam,2 - High,6/2/2025,,North,Ann,extra,"more, still"
Store 3,3,plain,Printer,Jam,2 - High,6/2/2025,,North
""", encoding="utf-8")
    data = TicketDataset.load(spark, str(path), AS_OF)
    rows = {r["Number"]: r for r in data.raw.collect()}
    assert rows["1"][MALFORMED_COLUMN] is None and rows["3"][MALFORMED_COLUMN] is None
    assert rows["2"][MALFORMED_COLUMN].endswith('Ann,extra,"more, still"')
    assert (rows["2"]["Owner"], rows["3"]["Owner"]) == ("Ann", None)
    found = data.validation().filter("check_name = 'malformed_rows'")
    assert rows_of(found, "finding_count", "message") == [(1, "1 rows have more cells than the header")]
    assert MALFORMED_COLUMN not in data.tickets.columns and data.tickets.count() == 3


def test_files_with_other_headers_are_refused(spark, csv, tmp_path):
    folder = tmp_path / "two.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("Site,Number,Priority,Created,Company\nS1,1,2 - High,6/2/2025,N\n")
    (folder / "b.csv").write_text("Site,Number,Priority,Created,Company\nS2,2,2 - High,6/2/2025,N\n")
    assert read_tickets(spark, str(folder)).count() == 2
    (folder / "b.csv").write_text("Number,Site,Priority,Created,Company\n2,S2,2 - High,6/2/2025,N\n")
    with pytest.raises(Exception, match="header"):
        read_tickets(spark, str(folder)).collect()


@pytest.mark.parametrize("day", ["2025-01-01", "01/01/2025"])
def test_a_source_may_have_a_column_created_date(spark, tmp_path, day):
    path = tmp_path / "t.csv"
    path.write_text(f"Site,Number,Priority,Created,Company,created_date\nS,1,2 - High,7/1/2025,N,{day}\n")
    data = TicketDataset.load(spark, str(path), AS_OF)
    june = TicketFilter(date_from="2025-06-01", date_to="2025-07-31")
    assert rows_of(data.filtered(june), "created_date") == [(day,)]
    export_tickets(data.tickets, str(tmp_path / "out.csv"))
    assert rows_of(read_tickets(spark, str(tmp_path / "out.csv")), "created_date") == [(day,)]
    data.store(str(tmp_path / "stored"))
    again = TicketDataset.open(spark, str(tmp_path / "stored"), AS_OF)
    assert rows_of(again.filtered(june), "created_date") == [(day,)]
    with pytest.raises(ValueError, match="reserved"):
        normalize(data.raw.withColumn(DAY_COLUMN, data.raw.Created), AS_OF)


def test_other_formats(spark, csv, tmp_path):
    raw = read_tickets(spark, csv).drop(MALFORMED_COLUMN)
    raw.write.json(str(tmp_path / "t.json"))
    raw.write.parquet(str(tmp_path / "t.parquet"))
    assert same(read_tickets(spark, str(tmp_path / "t.json")), raw)
    assert same(read_tickets(spark, str(tmp_path / "t.parquet")), raw)
    raw.createOrReplaceTempView("some_tickets")
    assert same(read_tickets(spark, "some_tickets", format="table"), raw)
    with pytest.raises(ValueError, match="Unsupported"):
        read_tickets(spark, str(tmp_path / "t.xlsx"))
    with pytest.raises(ValueError, match="Unsupported"):
        read_tickets(spark, csv, format="excel")


def test_dataset(spark, csv, tmp_path):
    foreign = tmp_path / "foreign.csv"
    foreign.write_text(CSV.replace("Site,", "Store,", 1), encoding="utf-8")
    data = TicketDataset.load(spark, str(foreign), AS_OF, column_mapping={"Store": "Site"})
    assert same(data.tickets, TicketDataset.load(spark, csv, AS_OF).tickets)
    assert "Owner" in data.tickets.columns
    assert data.report("site_scorecard", as_text=True).count() == 2
    assert data.report("green_list", TicketFilter(company="South")).count() == 1
    assert data.drill_down("Store 2", as_text=True).first()["Description"] == "plain"
    assert rows_of(data.subcategories()) == [("Jam",)]
    assert rows_of(data.subcategories("Printer")) == [("Jam",)]
    assert rows_of(data.sites("South")) == [("Store 2",)]
    assert data.filter_options().count() == 7
    assert data.validation().filter("severity = 'error'").count() == 0
    assert data.summary().first()["total_tickets"] == 2
    assert data.filtered_count(TicketFilter(site="Store 2")).first()["total_tickets"] == 1
    found = data.metadata("2025-08-01 09:00:00").first()
    assert (found["file_name"], found["total_records"]) == ("foreign.csv", 2)


def test_file_without_rows(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text(CSV.splitlines()[0] + "\n", encoding="utf-8")
    data = TicketDataset.load(spark, str(path), AS_OF)
    assert rows_of(data.validation(), "check_name", "severity") == [
        ("record_count", "info"), ("no_data", "error")
    ]
    assert data.report("site_scorecard").count() == 0
    assert data.summary().first()["total_tickets"] == 0


def test_load_metadata_names_columns(spark, csv):
    raw = read_tickets(spark, csv)
    assert load_metadata(raw, csv, AS_OF).first()["columns"] == ", ".join(raw.columns)


def test_export_report(spark, tickets, tmp_path):
    report = run_report("site_scorecard", tickets({}, {"Site": 'A "b", c'}), AS_OF, as_text=True)
    path = str(tmp_path / "scorecard")
    export(report, path)
    back = spark.read.csv(path, header=True, quote='"', escape='"')
    assert back.columns == report.columns
    assert {r["Site"] for r in back.collect()} == {"Store 1", 'A "b", c'}
    with pytest.raises(ValueError):
        export(report, path, "excel")


def test_export_selected(spark, tickets, tmp_path):
    found = tickets({}, {"Site": "Store 2"}, {"Site": "Store 3"})
    report = run_report("site_scorecard", found, AS_OF)
    keys = spark.createDataFrame([("Store 2",), ("Store 3",), ("Store 9",)], "site string")
    export_selected(report, keys, ["site"], str(tmp_path / "some"), "parquet")
    back = spark.read.parquet(str(tmp_path / "some"))
    assert sorted(rows_of(back, "site")) == [("Store 2",), ("Store 3",)]
    assert same(back, selected_rows(report, keys, ["site"]))


def test_export_tickets_can_be_loaded_again(spark, tickets, tmp_path):
    found = tickets({"Resolved": "7/3/2025 9:30", "Site": " padded "}, {"Created": "junk"})
    export_tickets(found, str(tmp_path / "out.csv"))
    again = normalize(read_tickets(spark, str(tmp_path / "out.csv")), AS_OF)
    assert same(again, found)


def test_stored_tickets_prune_days(spark, tickets, tmp_path):
    found = tickets(*[{"Created": f"7/{d}/2025 8:00"} for d in range(1, 21)], {"Created": "junk"})
    path = str(tmp_path / "stored")
    TicketDataset(found, found, AS_OF).store(path)
    stored = read_stored(spark, path, AS_OF)
    conditions = TicketFilter(date_from="2025-07-05", date_to="2025-07-07", inclusive_end=True)
    chosen = apply_filters(stored, conditions)
    assert same(chosen.drop(DAY_COLUMN), apply_filters(found, conditions))
    assert same(stored.drop(DAY_COLUMN), found)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert DAY_COLUMN in plan.split("PartitionFilters: [")[1].split("]")[0]
    # Another "now" changes the ages, and exports do not show the partition column.
    later = TicketDataset.open(spark, path, "2025-09-01 00:00:00")
    assert later.report("green_list").first()["uptime_days"] == 42
    assert same(later.raw, without_derived(found))
    assert later.validation().filter("check_name = 'bad_dates'").count() == 1


def test_json_with_named_columns(spark, csv, tmp_path):
    raw = read_tickets(spark, csv)
    raw.write.json(str(tmp_path / "t.json"))
    named = read_tickets(spark, str(tmp_path / "t.json"), columns=["Site", "Number"])
    assert same(named, raw.select("Site", "Number"))


@pytest.mark.parametrize("format", ["csv", "parquet", "json"])
def test_export_everything(spark, tickets, tmp_path, format):
    found = tickets(
        {"Priority": "1 - Critical", "Resolved": "7/30/2025"}, {"Priority": "1 - Critical"},
        *[{"Site": "Store 2", "Short description": "a, b"}] * 3, {"Company": "South"},
    )
    conditions = TicketFilter(company="North Foods, LLC")
    path = str(tmp_path / "bundle")
    data = TicketDataset(found, found, AS_OF)
    counts = data.export_everything(path, conditions, format)
    assert sorted(os.listdir(path)) == sorted(["filters", "raw_data", "summary", "tickets", *REPORTS])
    options = {"header": True} if format == "csv" else {}
    assert spark.read.format(format).options(**options).load(f"{path}/raw_data").count() == 5
    assert len(counts) == 11
    assert counts["raw_data"] == counts["incident_details"] == 5
    assert counts["critical_hotspots"] == counts["repeat_offenders"] == 1
    for name in REPORTS:
        expected = data.report(name, conditions, as_text=True)
        assert counts[name] == expected.count()
        if format == "parquet":
            assert same(spark.read.parquet(f"{path}/{name}"), expected)
    lines = spark.read.format(format).options(header=True).load(f"{path}/filters")
    assert rows_of(lines) == [("Company: North Foods, LLC",)]
    if format == "json":
        part = next(p for p in os.listdir(f"{path}/summary") if p.endswith(".json"))
        with open(f"{path}/summary/{part}", encoding="utf-8") as lines:
            assert json.loads(lines.readline())["metric"] == "Report Generated"


def test_empty_reports_count_zero(tickets, tmp_path):
    found = tickets({})
    counts = TicketDataset(found, found, AS_OF).export_everything(str(tmp_path / "b"))
    assert counts["critical_hotspots"] == counts["resolution_tracking"] == 0
    assert counts["green_list"] == 1
