"""What the operators share: tables, intermediate results, bounded text batches."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ticketscope.sources.scratch import shared_folder, stored  # noqa: F401

BATCH_BYTES = 8 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and keep Arrow batches small.

    A batch is in memory several times: in the JVM, in the worker, and in what is made of it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "ticketscope.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(application)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: dict = {}


def held(kind: str, key: object, make: Callable[[], object]) -> object:
    """The one large object that a worker process keeps between tasks.

    Workers outlive an operator: what another one has left is let go before this one is made.
    """
    if (kind, key) not in _held:
        _held.clear()
        _held[kind, key] = make()
    return _held[kind, key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def groups_of(texts: Sequence[str], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``limit`` characters; a longer text is alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
