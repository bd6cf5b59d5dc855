"""One query per operator, over all tickets derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.ticket_views import (
    AS_OF,
    RAW_COLUMNS,
    csv_lines,
    raw_ticket_rows,
    tickets,
    untidy_tickets,
)
from ticketscope.config import EXTENDED_DATE_FORMATS, MALFORMED_COLUMN
from ticketscope.functions.dates import with_times
from ticketscope.operators import options, quality, summary
from ticketscope.operators.filters import TicketFilter, apply_filters, checked_priorities
from ticketscope.operators.normalize import (
    blank_null_tokens,
    normalize,
    rename_columns,
    suggest_mapping,
    without_derived,
)
from ticketscope.operators.rollup import filtered_rollup, sites_of, ticket_rollup
from ticketscope.operators.site_reports import (
    franchise_of,
    green_of,
    hotspot_tickets,
    scorecard_of,
)
from ticketscope.operators.sketches import ERROR_BOUND, distinct_counts, ticket_sketches
from ticketscope.operators.ticket_reports import site_drill_down, with_sample_tickets
from ticketscope.plans.bundle import stored_bundle
from ticketscope.plans.display import hotspot_list
from ticketscope.plans.reports import REPORTS, run_report
from ticketscope.sources.checked import noted, noted_findings
from ticketscope.sources.readers import (
    files_of,
    joined_by_name,
    load_metadata,
    read_tickets,
    tickets_from_csv_text,
    tickets_from_json_text,
)
from ticketscope.sources.scratch import shared_folder
from ticketscope.sources.writers import selected_rows

Query = Callable[[SparkSession, str], DataFrame]

# Reports that need neither category nor description; their ticket view skips two joins.
_SITE_ONLY = (
    "critical_hotspots", "site_scorecard", "green_list", "franchise_overview",
    "resolution_tracking", "workload_trends",
)
_FILTERS = {
    "filter_date_range": TicketFilter(date_from="1997-03-01", date_to="1998-06-30"),
    "filter_inclusive_end": TicketFilter(
        date_from="1997-03-01", date_to="1998-06-30", inclusive_end=True
    ),
    "filter_priority": TicketFilter(priorities=checked_priorities(medium=False, low=False)),
    "filter_company": TicketFilter(company="NATION_7", site="All"),
    "filter_site": TicketFilter(site="Customer#000000017"),
    "filter_category": TicketFilter(category="ECONOMY", subcategory="Brand#2"),
    "filter_status": TicketFilter(resolution_status="Open", priorities=checked_priorities()),
    "filter_preset": TicketFilter.preset("Last 90 Days", "1999-07-15 10:30:00"),
    "filter_year_to_date": TicketFilter.preset("This Year", "1999-07-15 10:30:00"),
}

_CUT_DAYS = TicketFilter(date_from="1997-03-01 06:30:00", date_to="1998-06-30 18:15:00")


def _report(name: str, as_text: bool, untidy: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = (
            untidy_tickets(spark, sf_dir) if untidy
            else tickets(spark, sf_dir, categories=name not in _SITE_ONLY)
        )
        return run_report(name, rows, AS_OF, as_text=as_text)

    return query


def _filter(conditions: TicketFilter) -> Query:
    needs_category = bool(conditions.category or conditions.subcategory)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = apply_filters(tickets(spark, sf_dir, categories=needs_category), conditions)
        return rows.select("number", "site", "company", "priority", "created", "is_resolved")

    return query


def _ticket_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The untidy tickets as CSV text, read like the rows of a file; the text of over-long rows
    shows as a mark."""
    rows = tickets_from_csv_text(csv_lines(spark, sf_dir), RAW_COLUMNS)
    return rows.withColumn("over_long", F.col(MALFORMED_COLUMN).endswith(",one more")).drop(MALFORMED_COLUMN)


def _ticket_load_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_ticket_rows(spark, sf_dir)
    return tickets_from_json_text(rows.select(F.to_json(F.struct(*rows.columns)).alias("line")), RAW_COLUMNS)


def _ticket_load_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw_ticket_rows(spark, sf_dir).createOrReplaceTempView("untidy_ticket_table")
    return read_tickets(spark, "untidy_ticket_table", "table")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blank_null_tokens(raw_ticket_rows(spark, sf_dir))


def _column_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    foreign = _raw(spark, sf_dir).withColumnsRenamed(
        {"Site": "Store", "Priority": "Severity", "Created": "Opened", "Company": "Franchise",
         "Category": "issue_type"}
    )
    return rename_columns(foreign, suggest_mapping(foreign.columns)).select(
        "Site", "Priority", "Created", "Company", "Category", "Number"
    )


def _load_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_metadata(tickets(spark, sf_dir), "loaded/orders.parquet", AS_OF)


def _export_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecard rows of the (site, company) pairs chosen in the hotspot report."""
    rows = tickets(spark, sf_dir, categories=False)
    chosen = run_report("critical_hotspots", rows, AS_OF, ordered=False)
    scorecard = run_report("site_scorecard", rows, AS_OF, ordered=False)
    return selected_rows(scorecard, chosen, ["site", "company"])


def _filtered_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_derived(
        apply_filters(tickets(spark, sf_dir), TicketFilter(priorities=checked_priorities(low=False)))
    )


def _halves(spark: SparkSession, sf_dir: str, categories: bool = False) -> DataFrame:
    """The rollup of two loads read together: tickets by the last digit of their number."""
    rows = tickets(spark, sf_dir, categories)
    even = F.substring("number", -1, 1).isin("0", "2", "4", "6", "8")
    return ticket_rollup(rows.filter(even)).unionByName(ticket_rollup(rows.filter(~even)))


def _on_rollup(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(_halves(spark, sf_dir))


def _rollup_cut_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a range that begins and ends within a day: rollup, and the tickets of two days."""
    rows = tickets(spark, sf_dir, categories=False)
    some = filtered_rollup(_halves(spark, sf_dir), _CUT_DAYS, rows)
    return summary.count_of(sites_of(some))


def _file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per file of a load of two files."""
    rows = spark.read.schema("o_orderkey bigint, c_custkey bigint").parquet(
        f"{sf_dir}/orders.parquet", f"{sf_dir}/customer.parquet"
    )
    # Spark may give a table as a folder of files: these are one file here.
    name = F.regexp_extract("file_path", r"(orders|customer)\.parquet", 0)
    return (
        files_of(rows, ["o_orderkey", "c_custkey"], AS_OF)
        .groupBy(name.alias("file_name"), "load_timestamp", "columns")
        .agg(F.sum("total_records").alias("total_records"))
    )


def _mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads with different headers, one without a category, as one dataset."""
    raw = _raw(spark, sf_dir)
    even = F.col("Row key").cast("bigint") % 2 == 0
    one = raw.filter(even).withColumnsRenamed(
        {"Site": "Store", "Priority": "Severity", "Created": "Opened", "Company": "Franchise"})
    other = raw.filter(~even).withColumnsRenamed({"Site": "branch", "Priority": "urgency", "Company": "owner"})
    return joined_by_name([one, other.drop("Category")]).select(
        "Site", "Priority", "Created", "Company", "Category", "Number"
    )


def _dq_report_noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings about raw rows from what stored tickets keep of them."""
    raw = _raw(spark, sf_dir)
    return noted_findings(normalize(noted(raw), AS_OF), raw)


def _approximate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts, and whether those from merged sketches are within the stated bound."""
    rows = tickets(spark, sf_dir)
    even = F.substring("number", -1, 1).isin("0", "2", "4", "6", "8")
    sketches = ticket_sketches(rows.filter(even)).unionByName(ticket_sketches(rows.filter(~even)))
    exact = summary.dataset_profile(rows).select("processed_records", "sites", "companies", "categories")
    counts = distinct_counts(sketches).withColumnsRenamed(
        {name: f"approximate_{name}" for name in ("sites", "companies", "categories")})
    joined = exact.join(counts, F.col("processed_records") == F.col("rows"))
    return joined.select(
        "processed_records", "sites", "companies", "categories",
        *[
            (F.abs(F.col(f"approximate_{name}") - F.col(name)) <= ERROR_BOUND * F.col(name)).alias(f"{name}_within")
            for name in ("sites", "companies", "categories")
        ],
    )


def _missing_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate(_raw(spark, sf_dir).drop("Company"))


def _parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_times(
        _raw(spark, sf_dir),
        {"Created": "created_time", "Resolved": "resolved_time"},
        EXTENDED_DATE_FORMATS,
    )
    return rows.select(
        F.col("Row key").alias("row_key"),
        F.col("Created").alias("created_text"),
        "created_time",
        "resolved_time",
    )


def _sample_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets(spark, sf_dir, categories=False)
    return with_sample_tickets(run_report("green_list", rows, AS_OF, ordered=False), rows)


def _sample_tickets_untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = untidy_tickets(spark, sf_dir)
    return with_sample_tickets(run_report("green_list", rows, AS_OF, ordered=False), rows)


def _normalized(raw: DataFrame) -> DataFrame:
    return normalize(raw, AS_OF).withColumn("resolution_seconds", F.col("resolution_seconds").cast("double"))


def _active_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines about a filter beside the number of tickets that pass it."""
    conditions = _FILTERS["filter_priority"]
    count = summary.filtered_count(apply_filters(tickets(spark, sf_dir, categories=False), conditions))
    lines = F.array(*map(F.lit, conditions.describe()))
    return count.select(F.explode(lines).alias("filter"), "total_tickets")


def _export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each dataset of the full export has, over its copy of the tickets."""
    frames = stored_bundle(tickets(spark, sf_dir), shared_folder(spark), AS_OF)
    counts = [
        frame.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("dataset"), "row_count")
        for name, frame in frames.items()
    ]
    return reduce(DataFrame.union, counts)


def _malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets_from_csv_text(csv_lines(spark, sf_dir), RAW_COLUMNS)
    return quality.validate(rows).filter(F.col("check_name").isin("record_count", "malformed_rows"))


def _filter_untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date filter over tickets whose source has a column ``created_date`` of its own."""
    rows = apply_filters(untidy_tickets(spark, sf_dir), _FILTERS["filter_date_range"])
    return rows.select("Row key", "number", "site", "created", "created_date")


def _on_untidy(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(untidy_tickets(spark, sf_dir))


def _on_tickets(build: Callable[[DataFrame], DataFrame], categories: bool = False) -> Query:
    return lambda spark, sf_dir: build(tickets(spark, sf_dir, categories))


def _on_raw(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(_raw(spark, sf_dir))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        # Sources and sinks
        "ticket_load": _ticket_load,
        "ticket_load_json": _ticket_load_json,
        "ticket_load_table": _ticket_load_table,
        "column_rename": _column_rename,
        "null_tokens": _raw,
        "load_metadata": _load_metadata,
        "export_selected": _export_selected,
        "filtered_raw": _filtered_raw,
        "summary_sheet": _on_tickets(lambda t: summary.summary_sheet(t, AS_OF)),
        # Data quality
        "dq_required_columns": _missing_company,
        "dq_report": _on_raw(quality.validate),
        "dq_no_rows": _on_raw(lambda r: quality.validate(r.filter("Site = 'no such site'"))),
        "dq_completeness": _on_raw(quality.completeness),
        "dq_unexpected_priority": _on_raw(quality.unexpected_priorities),
        "dq_duplicates": _on_raw(quality.duplicate_numbers),
        "dq_bad_dates": _on_raw(quality.bad_dates),
        "dataset_profile": _on_tickets(summary.dataset_profile, categories=True),
        "date_range": _on_tickets(summary.date_range),
        "dq_malformed_rows": _malformed,
        "detect_date_format": _on_raw(
            lambda r: quality.detect_date_format(r, "Resolved", EXTENDED_DATE_FORMATS)
        ),
        "detect_date_format_found": _on_raw(
            lambda r: quality.detect_date_format(r, "created_date", EXTENDED_DATE_FORMATS)
        ),
        # Cleaning
        "parse_dates": _parse_dates,
        "normalize": _on_raw(_normalized),
        # Options
        "filter_options": _on_tickets(options.filter_options, categories=True),
        "option_search": _on_tickets(
            lambda t: options.search_options(options.filter_options(t), "Nation_1"), categories=True
        ),
        "category_map": _on_tickets(options.category_map, categories=True),
        "subcategories": _on_tickets(lambda t: options.subcategories(t, "ECONOMY"), categories=True),
        "all_subcategories": _on_tickets(options.all_subcategories, categories=True),
        "sites_for_company": _on_tickets(lambda t: options.sites_for_company(t, "NATION_7")),
        # Summaries and ticket lists
        "report_summary": _on_tickets(summary.report_summary),
        "data_summary": _on_tickets(summary.data_summary),
        "data_summary_display": _on_tickets(summary.data_summary_lines),
        "filtered_count": _on_tickets(
            lambda t: summary.filtered_count(apply_filters(t, _FILTERS["filter_year_to_date"]))
        ),
        "hotspot_tickets": _on_tickets(hotspot_tickets),
        "hotspot_tickets_display": _on_tickets(lambda t: hotspot_list(hotspot_tickets(t))),
        "hotspot_tickets_untidy": _on_untidy(hotspot_tickets),
        "site_drill_down": _on_tickets(
            lambda t: site_drill_down(t, "Customer#000000017", AS_OF), categories=True
        ),
        "sample_tickets": _sample_tickets,
        "sample_tickets_untidy": _sample_tickets_untidy,
        "report_summary_untidy": _on_untidy(summary.report_summary),
        "data_summary_untidy": _on_untidy(summary.data_summary),
        "filter_untidy": _filter_untidy,
        "filter_cleared": _filter(TicketFilter()),
        "active_filters": _active_filters,
        "export_counts": _export_counts,
        # From merged rollups and sketches
        "rollup_site_scorecard": _on_rollup(lambda r: scorecard_of(sites_of(r), AS_OF)),
        "rollup_green_list": _on_rollup(lambda r: green_of(sites_of(r), AS_OF)),
        "rollup_franchise_overview": _on_rollup(lambda r: franchise_of(sites_of(r), AS_OF)),
        "rollup_report_summary": _on_rollup(lambda r: summary.summary_of(sites_of(r))),
        "rollup_data_summary": _on_rollup(lambda r: summary.data_summary_of(sites_of(r))),
        "rollup_filtered_count": _on_rollup(
            lambda r: summary.count_of(sites_of(filtered_rollup(r, _FILTERS["filter_year_to_date"])))
        ),
        "rollup_cut_days": _rollup_cut_days,
        "approximate_counts": _approximate_counts,
        "load_metadata_files": _file_metadata,
        "column_rename_mixed": _mixed_headers,
        "dq_report_noted": _dq_report_noted,
    }
    for name in REPORTS:
        found[name] = _report(name, as_text=False)
        found[f"{name}_display"] = _report(name, as_text=True)
        found[f"{name}_untidy"] = _report(name, as_text=False, untidy=True)
        found[f"{name}_untidy_display"] = _report(name, as_text=True, untidy=True)
    for name, conditions in _FILTERS.items():
        found[name] = _filter(conditions)
    return found
