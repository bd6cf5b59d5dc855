"""Approximate distinct counts from mergeable sketches.

A sketch per day and company counts sites, category labels and companies without keeping them. It
is stored beside the tickets and merged on read and over loads, so that distinct counts over any
days cost a few small rows. With the default size a count is off by 1.6 % (one standard
deviation); ``ERROR_BOUND`` is four of them. Exact counts stay the default everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.config import DAY_COLUMN
from ticketscope.functions.numbers import round1
from ticketscope.operators.rollup import MIDNIGHT, merged

LOG_SIZE = 12
ERROR_BOUND = 0.065
SKETCH_KEYS = (DAY_COLUMN, MIDNIGHT, "company")


def ticket_sketches(tickets: DataFrame) -> DataFrame:
    """(day, midnight, company, rows, sites, labels): sketches of the tickets of each group."""
    created = F.col("created")
    midnight = created == created.cast("date").cast("timestamp_ntz")
    label = F.when((F.col("category") != "") & F.col("subcategory").isNotNull(), F.col("category"))
    keyed = tickets.withColumns({DAY_COLUMN: created.cast("date"), MIDNIGHT: midnight})
    return keyed.groupBy(*SKETCH_KEYS).agg(
        F.count(F.lit(1)).alias("rows"),
        F.hll_sketch_agg("site", LOG_SIZE).alias("sites"),
        F.hll_sketch_agg(label, LOG_SIZE).alias("labels"),
    )


def distinct_counts(sketches: DataFrame) -> DataFrame:
    """One row (rows, sites, companies, categories) from the sketches of one or several loads."""
    def count(name: str):
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(name)), F.lit(0))

    return sketches.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"),
        count("sites").alias("sites"),
        F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg("company", LOG_SIZE)), F.lit(0)).alias("companies"),
        count("labels").alias("categories"),
    )


def approximate_profile(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """``dataset_profile`` with approximate counts of sites, companies and categories."""
    return distinct_counts(sketches).select(
        F.col("rows").alias("processed_records"), F.col("rows").alias("raw_records"), "sites", "companies",
        "categories", F.lit(", ".join(columns)).alias("columns"),
    )


def approximate_summary(summary: DataFrame, sketches: DataFrame) -> DataFrame:
    """A data summary whose numbers of sites and companies come from sketches."""
    names = summary.columns
    counts = distinct_counts(sketches).select(
        F.col("sites").alias("unique_sites"), F.col("companies").alias("unique_companies"), F.lit(1).alias("_row")
    )
    exact = summary.drop("unique_sites", "unique_companies").withColumn("_row", F.lit(1))
    return exact.join(counts, "_row").select(names)


def whole_figures(rollup: DataFrame) -> DataFrame:
    """A site rollup of one row without site and company, for summaries that count neither."""
    everything = merged(rollup)
    return everything.withColumns({"site": F.lit(None).cast("string"), "company": F.lit(None).cast("string")})


def approximate_companies(overview: DataFrame, sketches: DataFrame) -> DataFrame:
    """A franchise overview whose numbers of sites come from sketches, and what follows from them."""
    counts = sketches.groupBy("company").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sites")).alias("_sites")
    ).withColumnRenamed("company", "_company")
    joined = overview.join(counts, F.col("company").eqNullSafe(F.col("_company")), "left")
    per_site = round1(F.try_divide(F.col("total_tickets").cast("double"), F.col("_sites")))
    return joined.withColumns({"sites": F.col("_sites"), "tickets_per_site": per_site}).select(overview.columns)
