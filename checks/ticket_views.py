"""Tickets derived from the order tables, which hold no tickets themselves.

``ticket_rows`` is tidy and typed. ``raw_ticket_rows`` is the same tickets as the text cells of
an untidy file: mixed date formats, junk, stray white space, missing cells, repeated numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.operators.normalize import blank_null_tokens, normalize

AS_OF = "2001-12-31 00:00:00"


# The columns used, so that Spark need not open the files to find out.
_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "lineitem": "l_orderkey bigint, l_partkey bigint",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def ticket_rows(spark: SparkSession, sf_dir: str, categories: bool = True) -> DataFrame:
    """One ticket per order; the part of its first line gives category and description.

    ``categories=False`` leaves those columns out, and with them two joins, for queries that use
    neither.
    """
    orders = _table(spark, sf_dir, "orders")
    customers = _table(spark, sf_dir, "customer")
    nations = _table(spark, sf_dir, "nation")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    created = F.expr("timestampadd(MINUTE, o_orderkey % 1440, o_orderdate)")
    resolved = F.expr(
        "timestampadd(MINUTE, o_orderkey % 1440 + cast(floor(o_totalprice) as bigint) % 20160,"
        " o_orderdate)"
    )
    priority = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "1 - Critical")
        .when(F.col("o_orderpriority") == "2-HIGH", "2 - High")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "3 - Medium")
        .when(F.col("o_orderpriority") == "5-LOW", "4 - Low")
        .otherwise(F.col("o_orderpriority"))
    )
    columns = [
        F.col("o_orderkey").alias("order_key"),
        F.concat(F.lit("CS"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("Number"),
        F.col("c_name").alias("Site"),
        F.col("n_name").alias("Company"),
        priority.alias("Priority"),
        created.alias("Created"),
        F.when(F.col("o_orderstatus") != "O", resolved).alias("Resolved"),
    ]
    if categories:
        lines = _table(spark, sf_dir, "lineitem")
        first = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("first_part"))
        parts = _table(spark, sf_dir, "part")
        rows = rows.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(
            parts, F.col("first_part") == F.col("p_partkey"), "left"
        )
        words = F.concat(F.coalesce("p_name", F.lit("")), F.lit(" "))
        columns += [
            F.col("p_type").alias("Category"),
            F.col("p_brand").alias("Subcategory"),
            F.repeat(words, F.expr("cast(1 + o_orderkey % 8 as int)")).alias("Short description"),
        ]
    return rows.select(*columns)


def tickets(spark: SparkSession, sf_dir: str, categories: bool = True) -> DataFrame:
    """``ticket_rows`` through the normal cleaning."""
    return normalize(ticket_rows(spark, sf_dir, categories).drop("order_key"), AS_OF)


def raw_ticket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ticket as untidy text; which blemish a row has follows from its order key."""
    rows = ticket_rows(spark, sf_dir)

    def every(cycle: int, at: int):
        return F.col("order_key") % cycle == at

    def as_day(column: str, pattern: str) -> Column:
        """Date text from its parts: Y M D h m and zero-padded MM DD hh mm."""
        c = F.col(column)
        iso = c.cast("string")
        parts = {
            "Y": F.year(c).cast("string"), "M": F.month(c).cast("string"),
            "D": F.day(c).cast("string"), "h": F.hour(c).cast("string"),
            "N": F.substring(iso, 6, 2), "E": F.substring(iso, 9, 2),
            "m": F.substring(iso, 15, 2), "H": F.substring(iso, 12, 2),
        }
        return F.concat(*[parts.get(x, F.lit(x)) for x in pattern])

    # In some weeks no ticket has a number; in some of these all tickets are open.
    week = F.floor(F.datediff(F.col("Created").cast("date"), F.lit("1970-01-05").cast("date")) / 7)
    no_number, still_open = F.pmod(week, F.lit(23)) < 2, F.pmod(week, F.lit(23)) == 1
    created = (
        F.when(every(20, 0), as_day("Created", "Y-N-E H:m:00"))
        .when(every(20, 1), as_day("Created", "M/D/Y"))
        .when(every(20, 2), as_day("Created", "Y-M-D"))
        .when(every(20, 3), F.lit("not a date"))
        .when(every(20, 4), F.lit(""))
        .when(every(20, 5), as_day("Created", "D/M/Y h:m"))
        .when(every(20, 6), F.lit("2/30/1999 8:00"))
        .when(every(20, 7), as_day("Created", " M/D/Y  h:m\t"))
        .otherwise(as_day("Created", "M/D/Y h:m"))
    )
    resolved = (
        F.when(F.col("Resolved").isNull() | still_open, F.lit(""))
        .when(every(25, 0), F.lit("pending"))
        .otherwise(as_day("Resolved", "M/D/Y h:m"))
    )
    site = (
        F.when(every(50, 0), F.concat(F.lit("\t"), F.col("Site"), F.lit(" \u00a0")))
        .when(every(50, 1), F.lit("N/A"))
        .when(every(50, 2), F.lit(" nan "))
        .otherwise(F.col("Site"))
    )
    paired = F.concat(
        F.lit("CS"),
        F.lpad((F.col("order_key") - F.col("order_key") % 40).cast("string"), 12, "0"),
    )
    number = (
        F.when(every(40, 0) | no_number, F.lit("NULL"))
        .when(every(40, 1) | every(40, 2), paired)
        .otherwise(F.col("Number"))
    )
    priority = (
        F.when(every(30, 0), F.concat(F.col("Priority"), F.lit(" ")))
        .when(every(30, 1), F.lit("P1"))
        .when(every(30, 2), F.lit("n/a"))
        .otherwise(F.col("Priority"))
    )
    category = (
        F.when(every(35, 0), F.lit("nan"))
        .when(every(35, 1), F.lit(" N/A"))
        .otherwise(F.coalesce("Category", F.lit("")))
    )
    description = (
        F.when(every(9, 0), F.concat(F.lit('said "'), F.col("Short description"), F.lit('", left')))
        .when(every(9, 1), F.concat(F.col("Short description"), F.lit("\nsecond line")))
        .otherwise(F.col("Short description"))
    )
    return rows.select(
        site.alias("Site"),
        number.alias("Number"),
        description.alias("Short description"),
        category.alias("Category"),
        F.coalesce("Subcategory", F.lit("")).alias("Subcategory"),
        priority.alias("Priority"),
        created.alias("Created"),
        resolved.alias("Resolved"),
        F.when(every(45, 0), F.lit("NATION_0")).otherwise(F.col("Company")).alias("Company"),
        F.col("order_key").cast("string").alias("Row key"),
        F.when(every(8, 0), as_day("Created", "Y-N-E")).otherwise(as_day("Created", "M/D/Y"))
        .alias("created_date"),
    )


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The untidy tickets as CSV text, some rows with a cell too many."""
    rows = raw_ticket_rows(spark, sf_dir)
    text = F.to_csv(F.struct(*rows.columns), {
        "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    })
    over_long = F.col("Row key").cast("bigint") % 33 == 0
    return rows.select(F.when(over_long, F.concat(text, F.lit(",one more"))).otherwise(text).alias("line"))


RAW_COLUMNS = (
    "Site", "Number", "Short description", "Category", "Subcategory", "Priority", "Created", "Resolved",
    "Company", "Row key", "created_date",
)


def untidy_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The untidy tickets, cleaned."""
    return normalize(blank_null_tokens(raw_ticket_rows(spark, sf_dir)), AS_OF)
