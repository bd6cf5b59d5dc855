"""Reading raw tickets from files and tables."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ticketscope.config import MALFORMED_COLUMN, ROLLUP_FOLDER, SKETCH_FOLDER, STORED_COLUMNS
from ticketscope.functions.dates import timestamp_literal
from ticketscope.operators.normalize import (
    blank_null_tokens,
    derive,
    rename_columns,
    suggest_mapping,
)

CSV_OPTIONS = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": MALFORMED_COLUMN}
_EXTENSIONS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}


def format_of(path: str) -> str:
    """The file format by extension."""
    extension = os.path.splitext(path.rstrip("/").lower())[1]
    if extension not in _EXTENSIONS:
        raise ValueError(
            f"Unsupported file format {extension!r}. Please use CSV, JSON or Parquet, or name a format."
        )
    return _EXTENSIONS[extension]


def read_tickets(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    multiline: bool = True,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Raw tickets from a path (``csv``, ``json``, ``parquet``) or a catalog ``table``.

    Text formats are read as strings, without guessing types, and cells that mean "missing"
    become NULL. Quoted CSV cells may hold line breaks; if yours do not, set
    ``multiline=False`` so that Spark can split large files (with line breaks, a file is one
    task). All CSV files of a folder must have the same header, else reading fails; a row with more
    cells than the header keeps its whole text in ``MALFORMED_COLUMN``, which ``validate`` counts.
    JSON files are read once more to find their columns unless ``columns`` names them.
    """
    kind = format or format_of(path)
    if kind == "csv":
        return read_csv(spark, path, multiline)
    if kind == "json":
        schema = columns and _text_schema(columns)
        return blank_null_tokens(spark.read.json(path, schema, primitivesAsString=True))
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "table":
        return spark.table(path)
    raise ValueError(f"Unsupported format {kind!r}")


def read_csv(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """Raw tickets from CSV files of one header, as ``read_tickets`` gives them."""
    options = {"header": True, "multiLine": multiline, "encoding": "UTF-8", **CSV_OPTIONS}
    header = spark.read.options(**options).csv(path)
    several = len(header.inputFiles()) > 1
    raw = spark.read.options(
        **options, columnPruning=False, enforceSchema=not several
    ).schema(csv_schema(header.columns)).csv(path)
    return blank_null_tokens(_with_malformed(raw, header.columns))


def _text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(name, StringType()) for name in columns])


def csv_schema(columns: Sequence[str]) -> StructType:
    """Text cells, and the whole row where it has another number of cells than the header."""
    return _text_schema([*columns, MALFORMED_COLUMN])


def _with_malformed(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the whole text of over-long rows only; in short rows cells are just missing."""
    unquoted = F.regexp_replace(MALFORMED_COLUMN, '"[^"]*"', "")
    cells = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1
    return raw.withColumn(MALFORMED_COLUMN, F.when(cells > len(columns), F.col(MALFORMED_COLUMN)))


def tickets_from_csv_text(lines: DataFrame, columns: Sequence[str], line: str = "line") -> DataFrame:
    """Raw tickets from a column that holds one CSV row each, read like the rows of a file."""
    names = (name.replace("`", "``") for name in (*columns, MALFORMED_COLUMN))
    parsed = F.from_csv(line, ", ".join(f"`{name}` string" for name in names), CSV_OPTIONS)
    return blank_null_tokens(_with_malformed(lines.select(parsed.alias("r")).select("r.*"), columns))


def tickets_from_json_text(lines: DataFrame, columns: Sequence[str], line: str = "line") -> DataFrame:
    """Raw tickets from a column that holds one JSON object each."""
    parsed = F.from_json(line, _text_schema(columns), {"primitivesAsString": "true"})
    return blank_null_tokens(lines.select(parsed.alias("r")).select("r.*"))


def read_stored(spark: SparkSession, path: str, as_of: datetime | str) -> DataFrame:
    """Tickets written by ``store_tickets``, with the derived columns as of the given moment."""
    return derive(spark.read.parquet(path).drop(*STORED_COLUMNS), as_of)


def read_rollup(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The rollup and the sketches beside stored tickets; ``None`` for what is not there."""
    found = []
    for folder in (ROLLUP_FOLDER, SKETCH_FOLDER):
        try:
            found.append(spark.read.parquet(f"{path}/{folder}"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found.append(None)
    return found[0], found[1]


def file_metadata(
    spark: SparkSession,
    path: str | Sequence[str],
    loaded_at: datetime | str,
    format: str | None = None,
    multiline: bool = True,
) -> DataFrame:
    """One row per file of a load: path, name, size, modification time, rows, columns.

    Rows are those that ``read_tickets`` makes of the file. Files without rows do not appear; their rows
    count nothing in ``load_metadata`` either.
    """
    paths = [path] if isinstance(path, str) else list(path)
    kind = format or format_of(paths[0])
    if kind == "csv":
        # The row parser sees the whole row: otherwise files that differ in their header would count too.
        options = {"header": True, "multiLine": multiline, "encoding": "UTF-8", **CSV_OPTIONS}
        names = spark.read.options(**options).csv(paths).columns
        rows = spark.read.options(**options, columnPruning=False).schema(csv_schema(names)).csv(paths)
    elif kind == "json":
        rows = spark.read.json(paths, primitivesAsString=True)
        names = rows.columns
    elif kind == "parquet":
        rows = spark.read.parquet(*paths)
        names = rows.columns
    else:
        raise ValueError(f"A {kind} has no files to look at")
    return files_of(rows, names, loaded_at)


def files_of(rows: DataFrame, names: Sequence[str], loaded_at: datetime | str) -> DataFrame:
    """``file_metadata`` of rows as a reader gives them, before any other step."""
    file = F.col("_metadata")
    return (
        rows.groupBy(
            file.getField("file_path").alias("file_path"), file.getField("file_name").alias("file_name"),
            file.getField("file_size").alias("file_size"),
            file.getField("file_modification_time").alias("modified"),
        )
        .agg(F.count(F.lit(1)).alias("total_records"))
        .select(
            "file_path", "file_name", "file_size", "modified",
            timestamp_literal(loaded_at).alias("load_timestamp"), "total_records",
            F.lit(", ".join(names)).alias("columns"),
        )
    )


def read_mixed_tickets(
    spark: SparkSession, path: str, mapping: Mapping[str, str] | None = None, multiline: bool = True
) -> DataFrame:
    """Raw tickets from a folder of CSV files whose headers differ, under standard names.

    Files are grouped by header, by one pass over the beginning of every file. Each group is read like a folder of its own,
    its columns are renamed (``mapping``, and aliases for what that leaves), and the groups are
    joined by name; a column that a group lacks is NULL. Header rows must not hold line breaks. The names of
    the files come to the driver, as they do for every scan.
    """
    lines = spark.read.option("encoding", "UTF-8").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value",
    )
    headers = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "place").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in headers.collect():
        groups.setdefault(row.header.removeprefix("\ufeff").rstrip("\r"), []).append(row.file)
    if not groups:
        raise ValueError(f"No CSV file with a header in {path}")
    return joined_by_name([read_csv(spark, sorted(groups[h]), multiline) for h in sorted(groups)], mapping)


def joined_by_name(parts: Sequence[DataFrame], mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Raw tickets of several headers under standard names; a column that a part lacks is NULL there."""
    found = None
    for part in parts:
        raw = rename_columns(part, mapping or {})
        raw = rename_columns(raw, suggest_mapping(raw.columns))
        found = raw if found is None else found.unionByName(raw, allowMissingColumns=True)
    return found


def load_metadata(tickets: DataFrame, path: str, loaded_at: datetime | str) -> DataFrame:
    """One row about a loaded dataset."""
    return tickets.agg(F.count(F.lit(1)).alias("total_records")).select(
        F.lit(path).alias("file_path"),
        F.lit(os.path.basename(path.rstrip("/"))).alias("file_name"),
        timestamp_literal(loaded_at).alias("load_timestamp"),
        "total_records",
        F.lit(", ".join(tickets.columns)).alias("columns"),
    )
