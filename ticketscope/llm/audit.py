"""Operator 11: how filters interact in every order, by wide packed counters.

Five filters give every document a mask of those that it fails. What the mask means for each of
the 120 orders and five steps (kept, removed, redundant, the only failure, a good or a toxic
document lost) is written once into a big integer: 3,600 fields of 64 bits. Integers are summed per
part of the corpus, so one addition counts a document in all orders at once; a field overflows only
beyond 2^63 documents. The sums are unpacked into rows at the end.

A text counts as a copy if a smaller doc_id has the same text anywhere in the table; texts are
compared by SHA-256. Only ids, digests and flags are shuffled, never texts. Copies are counted
per (text, part, labels) before a text's rows meet, so a text that very many documents share sends
few rows, and a task sums its documents before it sends one integer per part.

Null texts count as empty, empty texts are copies of each other, a null ``lang`` is the part ''.
Rows that repeat an id count each and are no copies of each other; rows without an id are neither
copies nor originals and have no labels. Several labels of a document count as good or toxic
if one of them does. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import table

FILTERS = "ABCDE"
ORDERS = tuple("".join(order) for order in itertools.permutations(FILTERS))
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
STEPS = len(ORDERS) * len(FILTERS)
FIELD_BYTES = 8
# Parts whose sums a task holds at a time, 29 kB each.
HELD_PARTS = 256
# Ways in which the sums of one part are spread before they become one.
SPREAD = 32

_WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions A to D of a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(_WORD), 0)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def text_mask(text: Column) -> Column:
    """The bits of the failed conditions A (1) to D (8)."""
    bits = [
        F.when(failed, F.lit(1 << FILTERS.index(name))).otherwise(F.lit(0))
        for name, failed in text_failures(text).items()
    ]
    return functools.reduce(lambda a, b: a.bitwiseOR(b), bits)


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): the documents that fail the same filters, counted."""
    text = F.coalesce("text", F.lit(""))
    narrow = documents.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"),
    )
    # Rows without an id match no label; the second key deals them out by reading task.
    narrow = narrow.withColumn("deal", F.when(F.col("doc_id").isNull(), F.spark_partition_id() + 1).otherwise(0))
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    ).withColumn("deal", F.lit(0))
    joined = narrow.join(marked, ["doc_id", "deal"], "left")
    flags = [F.coalesce(name, F.lit(False)).alias(name) for name in ("good", "toxic")]
    same = ["digest", "part", "good", "toxic"]
    by_id = joined.select("doc_id", "deal", "digest", "part", "mask", *flags).groupBy(
        "doc_id", "deal", *same
    ).agg(F.min("mask").alias("mask"), F.count(F.lit(1)).alias("n"))
    by_text = by_id.groupBy(*same).agg(
        F.min("mask").alias("mask"), F.min("doc_id").alias("first"),
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("without"),
        F.min_by("n", "doc_id").alias("firsts"),
    )
    smallest = F.min("first").over(Window.partitionBy("digest"))
    originals = F.coalesce(F.when(F.col("first") == smallest, F.col("firsts")), F.lit(0)) + F.coalesce(
        "without", F.lit(0)
    )
    copies = F.lit(1 << FILTERS.index("E"))
    return by_text.withColumn("originals", originals).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask"), F.col("originals").alias("n")),
            F.struct(F.col("mask").bitwiseOR(copies).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
        )).alias("x"),
    ).select("part", "good", "toxic", "x.*").filter("n > 0")


def outcomes(mask: int, good: bool, toxic: bool) -> np.ndarray:
    """What happens to a document of this mask: (120 orders, 5 steps, 6 outcomes), 0 or 1."""
    found = np.zeros((len(ORDERS), len(FILTERS), len(OUTCOMES)), np.int64)
    for i, order in enumerate(ORDERS):
        there = True
        for step, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails = bool(mask & bit)
            removed = there and fails
            redundant = fails and not there
            there = there and not fails
            found[i, step] = there, removed, redundant, mask == bit, removed and good, removed and toxic
    return found


def packed(counts: np.ndarray) -> int:
    """One integer with a field for each count."""
    return int.from_bytes(counts.astype(f"<u{FIELD_BYTES}").tobytes(), "little")


def unpacked(whole: int) -> np.ndarray:
    data = whole.to_bytes(STEPS * len(OUTCOMES) * FIELD_BYTES, "little")
    return np.frombuffer(data, f"<u{FIELD_BYTES}").reshape(len(ORDERS), len(FILTERS), len(OUTCOMES))


@functools.cache
def wide_counter(mask: int, good: bool, toxic: bool) -> int:
    return packed(outcomes(mask, good, toxic))


def _bytes_of(whole: int) -> bytes:
    return whole.to_bytes((whole.bit_length() + 7) // 8, "little")


def summed_counters(counted: DataFrame) -> DataFrame:
    """(part, total): rows from ``masks`` added up as packed counters, one row per part."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(map(_bytes_of, held.values()), pa.binary())],
                names=["part", "total"],
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "mask", "good", "toxic", "n")]
            for part, mask, good, toxic, n in zip(*columns):
                if part not in held and len(held) >= HELD_PARTS:
                    yield out()
                    held.clear()
                held[part] = held.get(part, 0) + n * wide_counter(mask, good, toxic)
        if held:
            yield out()

    def merge(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(
            int.from_bytes(one, "little")
            for batch in groups for one in batch.column("total").to_pylist()
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.string()), pa.array([_bytes_of(total)], pa.binary())],
            names=["part", "total"],
        )

    kind = "part string, total binary"
    found = counted.select("part", "mask", "good", "toxic", "n").mapInArrow(add, kind)
    spread = F.pmod(F.xxhash64("total"), F.lit(SPREAD)).alias("spread")
    found = found.select("part", "total", spread).groupBy("part", "spread").applyInArrow(merge, kind)
    return found.groupBy("part").applyInArrow(merge, kind)


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see the contract of the columns above.

    ``shapley`` is what the step's filter removes, summed over all orders at whatever step.
    """
    names = [*OUTCOMES, "shapley"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = pa.array([order for order in ORDERS for _ in FILTERS], pa.string())
        steps = pa.array(list(range(1, len(FILTERS) + 1)) * len(ORDERS), pa.int32())
        letters = np.array([[FILTERS.index(name) for name in order] for order in ORDERS])
        for batch in batches:
            for part, total in zip(batch.column("part").to_pylist(), batch.column("total").to_pylist()):
                counts = unpacked(int.from_bytes(total, "little")).astype(np.int64)
                removed = counts[:, :, OUTCOMES.index("removed")]
                share = np.array([removed[letters == i].sum() for i in range(len(FILTERS))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * STEPS, pa.string()), orders, steps]
                    + [pa.array(counts[:, :, i].ravel()) for i in range(len(OUTCOMES))]
                    + [pa.array(share[letters].ravel())],
                    names=["part", "filter_order", "step", *names],
                )

    kinds = ", ".join(f"{name} bigint" for name in names)
    return summed_counters(masks(documents, labels)).mapInArrow(
        unpack, f"part string, filter_order string, step int, {kinds}"
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql_bit(step: str) -> str:
    return f"CAST(pow(2, ascii(substr(filter_order, {step}, 1)) - 65) AS INTEGER)"


_BEFORE = " OR ".join(f"(step > {k} AND mask & {_sql_bit(str(k))} > 0)" for k in range(1, len(FILTERS)))

ORACLE_SQL = f"""
WITH l AS (
    SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), t AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
           min(doc_id) OVER (PARTITION BY text) AS smallest
    FROM t
), m AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN w.doc_id > smallest THEN 16 ELSE 0 END AS mask
    FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), c AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
    FROM m GROUP BY part, mask
), f AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f d ON d.x NOT IN (a.x, b.x, c.x)
        JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
    SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM orders
), x AS (
    SELECT part, filter_order, step, n, good, toxic, mask, {_sql_bit('step')} AS bit,
           mask & {_sql_bit('step')} > 0 AS fails, ({_BEFORE}) AS gone
    FROM c CROSS JOIN steps
), r AS (
    SELECT part, filter_order, step,
           coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS kept,
           coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS removed,
           coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS redundant,
           coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
           coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0) AS toxic_lost
    FROM x GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley
FROM r
"""
