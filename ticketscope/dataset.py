"""A loaded set of tickets with everything that can be asked of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.config import DEFAULT_CONFIG, Config
from ticketscope.operators import options, quality, summary
from ticketscope.operators.filters import TicketFilter, apply_filters
from ticketscope.operators.normalize import normalize, rename_columns, without_derived
from ticketscope.operators.rollup import answers, filtered_rollup, sites_of, ticket_rollup
from ticketscope.operators.site_reports import hotspot_tickets
from ticketscope.operators.sketches import (
    approximate_companies,
    approximate_profile,
    approximate_summary,
    ticket_sketches,
    whole_figures,
)
from ticketscope.operators.ticket_reports import site_drill_down
from ticketscope.plans.bundle import export_everything
from ticketscope.plans.display import hotspot_list, incidents
from ticketscope.plans.reports import run_report, sort_report
from ticketscope.sources.checked import store_checked
from ticketscope.sources.readers import (
    file_metadata,
    load_metadata,
    read_mixed_tickets,
    read_rollup,
    read_stored,
    read_tickets,
)
from ticketscope.sources.writers import store_tickets

_NO_FILTER = TicketFilter()


@dataclass(frozen=True)
class TicketDataset:
    """Raw rows, clean tickets and the moment that counts as "now". Nothing runs until asked."""

    raw: DataFrame
    tickets: DataFrame
    as_of: datetime | str
    config: Config = DEFAULT_CONFIG
    path: str = ""
    rollup: DataFrame | None = None
    sketches: DataFrame | None = None

    @classmethod
    def load(
        cls,
        spark: SparkSession,
        path: str,
        as_of: datetime | str,
        format: str | None = None,
        column_mapping: Mapping[str, str] | None = None,
        config: Config = DEFAULT_CONFIG,
        multiline: bool = True,
        columns: Sequence[str] | None = None,
    ) -> TicketDataset:
        """Read, rename and clean; absent required columns raise ``MissingColumnsError``.

        ``columns`` names the columns of JSON files, which spares reading them once more.
        """
        source = read_tickets(spark, path, format, multiline, columns)
        raw = rename_columns(source, column_mapping or {})
        return cls(raw, normalize(raw, as_of, config), as_of, config, path)

    @classmethod
    def open(
        cls, spark: SparkSession, path: str, as_of: datetime | str, config: Config = DEFAULT_CONFIG
    ) -> TicketDataset:
        """Tickets that ``store`` wrote; they are clean, so raw rows and tickets are the same.

        Reports and figures about sites, companies and weeks then come from the rollup stored beside
        them, unless the conditions ask for a category.
        """
        tickets = read_stored(spark, path, as_of)
        rollup, sketches = read_rollup(spark, path)
        return cls(without_derived(tickets), tickets, as_of, config, path, rollup, sketches)

    @classmethod
    def load_mixed(
        cls,
        spark: SparkSession,
        path: str,
        as_of: datetime | str,
        column_mapping: Mapping[str, str] | None = None,
        config: Config = DEFAULT_CONFIG,
        multiline: bool = True,
    ) -> TicketDataset:
        """Read a folder of CSV files whose headers differ, and clean it as one dataset."""
        raw = read_mixed_tickets(spark, path, column_mapping, multiline)
        return cls(raw, normalize(raw, as_of, config), as_of, config, path)

    def store(self, path: str, mode: str = "errorifexists") -> None:
        """Keep the clean tickets as a table partitioned by day, the way to report many times."""
        store_tickets(self.tickets, path, mode)

    def store_checked(self, path: str, mode: str = "errorifexists") -> DataFrame:
        """``store``, and the findings of ``validation``, with one reading of the source."""
        return store_checked(self.raw, path, self.as_of, self.config, mode)

    def _rollup(self, conditions: TicketFilter) -> DataFrame | None:
        if self.rollup is None or not answers(self.rollup, conditions):
            return None
        return filtered_rollup(self.rollup, conditions, self.tickets)

    def filtered(self, conditions: TicketFilter = _NO_FILTER) -> DataFrame:
        return apply_filters(self.tickets, conditions)

    def report(
        self,
        name: str,
        conditions: TicketFilter = _NO_FILTER,
        ordered: bool = True,
        as_text: bool = False,
    ) -> DataFrame:
        return run_report(
            name, self.filtered(conditions), self.as_of, self.config, ordered, as_text,
            self._rollup(conditions),
        )

    def report_summary(self, conditions: TicketFilter = _NO_FILTER) -> DataFrame:
        rollup = self._rollup(conditions)
        if rollup is None:
            return summary.report_summary(self.filtered(conditions))
        return summary.summary_of(sites_of(rollup))

    def approximate_overview(self) -> DataFrame:
        """``franchise_overview`` with approximate numbers of sites; see ``operators.sketches``."""
        overview = self.report("franchise_overview", ordered=False)
        return sort_report("franchise_overview", approximate_companies(overview, self._sketches()))

    def drill_down(
        self, site: str, conditions: TicketFilter = _NO_FILTER, as_text: bool = False
    ) -> DataFrame:
        rows = site_drill_down(self.filtered(conditions), site, self.as_of, self.config)
        rows = sort_report("incident_details", rows)
        return incidents(rows, self.config) if as_text else rows

    def hotspot_tickets(
        self, conditions: TicketFilter = _NO_FILTER, as_text: bool = False
    ) -> DataFrame:
        """The critical tickets of the sites that have a hotspot, by site and time."""
        rows = hotspot_tickets(self.filtered(conditions), self.config)
        tasks = rows.withColumn("_task", F.spark_partition_id())
        order = [F.col(c).asc_nulls_last() for c in ("site", "created", "number", "company", "_task")]
        rows = tasks.orderBy(*order).drop("_task")
        return hotspot_list(rows) if as_text else rows

    def validation(self) -> DataFrame:
        return quality.validate(self.raw, self.config)

    def filter_options(self) -> DataFrame:
        return options.filter_options(self.tickets).orderBy("field", "value")

    def subcategories(self, category: str = "All") -> DataFrame:
        if category == "All":
            return options.all_subcategories(self.tickets).orderBy("subcategory")
        return options.subcategories(self.tickets, category).orderBy("subcategory")

    def sites(self, company: str = "All") -> DataFrame:
        return options.sites_for_company(self.tickets, company).orderBy("site")

    def summary(self, approx: bool = False) -> DataFrame:
        """``approx`` counts sites and companies by sketches; all else stays exact."""
        if approx:
            rollup = self.rollup if self.rollup is not None else ticket_rollup(self.tickets)
            return approximate_summary(summary.data_summary_of(whole_figures(rollup)), self._sketches())
        if self.rollup is not None:
            return summary.data_summary_of(sites_of(self.rollup))
        return summary.data_summary(self.tickets)

    def profile(self, approx: bool = False) -> DataFrame:
        """Size of the dataset; ``approx`` counts sites, companies and categories by sketches."""
        if approx:
            return approximate_profile(self._sketches(), self.tickets.columns)
        return summary.dataset_profile(self.tickets)

    def _sketches(self) -> DataFrame:
        return self.sketches if self.sketches is not None else ticket_sketches(self.tickets)

    def filtered_count(self, conditions: TicketFilter = _NO_FILTER) -> DataFrame:
        rollup = self._rollup(conditions)
        if rollup is None:
            return summary.filtered_count(self.filtered(conditions))
        return summary.count_of(sites_of(rollup))

    def metadata(self, loaded_at: datetime | str) -> DataFrame:
        return load_metadata(self.tickets, self.path, loaded_at)

    def files(self, loaded_at: datetime | str, format: str | None = None) -> DataFrame:
        """One row per file that the dataset was loaded from."""
        return file_metadata(self.tickets.sparkSession, self.path, loaded_at, format)

    def export_everything(
        self,
        path: str,
        conditions: TicketFilter = _NO_FILTER,
        format: str = "csv",
        mode: str = "errorifexists",
    ) -> dict[str, int]:
        return export_everything(
            self.tickets, path, self.as_of, conditions, self.config, format, mode
        )
