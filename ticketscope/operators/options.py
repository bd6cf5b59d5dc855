"""Values to choose from in filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_pairs(tickets: DataFrame) -> DataFrame:
    """Distinct (category, subcategory); blank categories are left out, blank subcategories kept."""
    return (
        tickets.filter((F.col("category") != "") & F.col("subcategory").isNotNull())
        .select("category", "subcategory")
        .distinct()
    )


def category_map(tickets: DataFrame) -> DataFrame:
    """The category tree: one row per (category, subcategory), sorted."""
    return category_pairs(tickets).orderBy("category", "subcategory")


def filter_options(tickets: DataFrame) -> DataFrame:
    """Distinct values of priority, company, site and category as (field, value) rows.

    One pass over the tickets; repeated values are merged before the shuffle.
    """
    in_map = (F.col("category") != "") & F.col("subcategory").isNotNull()
    fields = ["priority", "company", "site", "category"]
    return (
        tickets.select(
            "priority", "company", "site", F.when(in_map, F.col("category")).alias("category")
        )
        .unpivot([], fields, "field", "value")
        .filter(F.col("value").isNotNull())
        .distinct()
    )


def subcategories(tickets: DataFrame, category: str) -> DataFrame:
    """Subcategories of one category; none if the category is unknown."""
    return category_pairs(tickets.filter(F.col("category") == category)).select("subcategory")


def all_subcategories(tickets: DataFrame) -> DataFrame:
    """Subcategories of all categories."""
    return (
        tickets.filter((F.col("category") != "") & F.col("subcategory").isNotNull())
        .select("subcategory")
        .distinct()
    )


def sites_for_company(tickets: DataFrame, company: str) -> DataFrame:
    """Sites of one company; ``All`` gives every site."""
    chosen = tickets if company == "All" else tickets.filter(F.col("company") == company)
    return chosen.select("site").distinct()


def search_options(options: DataFrame, text: str, column: str = "value") -> DataFrame:
    """Options that contain ``text`` in any letter case; blank or ``all`` keeps everything."""
    wanted = text.lower()
    if wanted in ("", "all"):
        return options
    return options.filter(F.lower(F.col(column)).contains(wanted))
