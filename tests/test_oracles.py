"""Every query against its SQL, and what must hold between queries."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import oracles, queries
from checks.compare import connect, differences
from checks.ticket_views import AS_OF, tickets as ticket_view
from ticketscope.operators.normalize import normalize
from ticketscope.operators.ticket_reports import site_drill_down
from ticketscope.plans.reports import run_report

SF_DIR = "/root/testdata/sf0.001"
QUERIES = queries.queries()
ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def found(spark):
    return ticket_view(spark, SF_DIR).persist()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    assert differences(result, duck, ORACLES[name]) == []
    plan = result._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval"):
        assert unwanted not in plan


@pytest.mark.parametrize("name", ["export_counts", "incident_details_untidy", "incident_details_untidy_display",
                                  "incident_details", "resolution_tracking_untidy"])
def test_joins_and_cleaning_run_once(spark, name):
    """A global sort and a union of counts read their input more than once: that is a stored copy."""
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "l_orderkey" not in plan


def test_cleaning_is_not_one_method_too_long_to_compile(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    QUERIES["normalize"](spark, SF_DIR)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_totals_agree(found):
    total = found.count()
    card = run_report("site_scorecard", found, AS_OF, ordered=False)
    assert card.agg(F.sum("total_tickets")).first()[0] == total
    weeks = run_report("workload_trends", found, AS_OF, ordered=False)
    assert weeks.agg(F.sum("new_tickets")).first()[0] == total
    companies = run_report("franchise_overview", found, AS_OF, ordered=False)
    assert companies.agg(F.sum("total_tickets")).first()[0] == total


def test_hotspots_and_green_sites_are_disjoint(found):
    hot = run_report("critical_hotspots", found, AS_OF, ordered=False)
    green = run_report("green_list", found, AS_OF, ordered=False)
    assert hot.join(green, ["site", "company"]).count() == 0


def test_drill_down_is_a_part_of_the_details(found):
    site = found.first()["site"]
    details = run_report("incident_details", found, AS_OF, ordered=False)
    assert sorted(map(str, rows_of(site_drill_down(found, site, AS_OF)))) == sorted(
        map(str, rows_of(details.filter(F.col("site") == site)))
    )


@pytest.mark.parametrize("name", ["critical_hotspots", "site_scorecard", "equipment_analysis",
                                  "franchise_overview", "resolution_tracking", "incident_details",
                                  "workload_trends"])
def test_results_do_not_depend_on_partitions_broadcasts_or_time_zone(spark, found, name):
    expected = rows_of(run_report(name, found, AS_OF))
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.enabled": "false",
                "spark.sql.session.timeZone": "America/New_York"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        shuffled = found.repartition(7, "created")
        assert rows_of(run_report(name, shuffled, AS_OF)) == expected
        shown = rows_of(run_report(name, shuffled, AS_OF, as_text=True))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert shown == rows_of(run_report(name, found, AS_OF, as_text=True))


def test_order_of_reports_follows_the_sort_columns(found):
    rows = run_report("site_scorecard", found, AS_OF).collect()
    keys = [(-r["critical_pct"], -r["avg_mttr_hours"], r["site"], r["company"]) for r in rows]
    assert keys == sorted(keys)
    rows = run_report("incident_details", found, AS_OF).collect()
    assert [r["site"] for r in rows] == sorted(r["site"] for r in rows)


def test_cleaning_twice_changes_nothing(found):
    from ticketscope.operators.normalize import without_derived

    again = normalize(without_derived(found), AS_OF)
    assert sorted(map(str, rows_of(again))) == sorted(map(str, rows_of(found)))
