"""Operator 1: near copies by SimHash and meet-in-the-middle ball hashing.

Two fingerprints differ in at most 4 bits exactly if some value differs from each of them in at
most 2. So every fingerprint emits all 2,081 values within 2 bits, the values meet by a shuffle,
and fingerprints that share one are linked. Values that begin with the same bits travel together:
a fingerprint goes once to every beginning within 2 bits of its own, and stands there for all its
values that begin so. The receiving task makes these values, sorts them, verifies the pairs that
collide and returns a spanning forest, not all pairs. A crowded beginning is worked off in slices
of longer beginnings, so that memory stays bounded. The length of the beginning follows from the
number of fingerprints.

Equal fingerprints are one row before anything is shuffled on values, however often they occur.
Where documents and fingerprints get the name of their component, the rows of a fingerprint with very
many documents, or of a component with very many fingerprints, are dealt to many tasks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.llm.common import slices, stored, table
from ticketscope.llm.components import components
from ticketscope.operators.joins import hot_keys, spread_join

RADIUS = 4
SHINGLE = 4
# Values that one group should make, on average, and at most at a time.
GROUP_VALUES = 1 << 21
SLICE_VALUES = 1 << 22


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of the word shingles of a text; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    first, last = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for low in range(0, len(first), 1 << 15):
        spans = zip(first[low:low + (1 << 15)], last[low:low + (1 << 15)])
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * counts > len(first)).tolist()
    return sum(1 << bit for bit in set_bits)


def fingerprints(rows: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) of every row; ``fp`` is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"]
            )

    kind = rows.schema[id_column].dataType.simpleString()
    source = rows.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_column)


@functools.cache
def _masks(width: int, most: int) -> np.ndarray:
    """All numbers of ``width`` bits with at most ``most`` bits set."""
    found = last = np.zeros(1, np.uint64)
    one = np.uint64(1) << np.arange(width, dtype=np.uint64)
    for _ in range(most):
        last = np.unique((last[:, None] | one[None, :]).ravel())
        found = np.union1d(found, last)
    return found


def _collisions(
    prints: np.ndarray, index: np.ndarray, start: int, bits: int, half: int
) -> Iterator[np.ndarray]:
    """Pairs of positions that share a value beginning with the ``bits`` bits of ``start``."""
    width = 64 - bits
    spent = (
        np.bitwise_count((prints >> np.uint64(width)) ^ np.uint64(start))
        if bits else np.zeros(len(prints), np.uint8)
    )
    near = spent <= half
    prints, index, spent = prints[near], index[near], spent[near]
    if len(prints) < 2:
        return
    sizes = [sum(math.comb(width, k) for k in range(half - d + 1)) for d in range(half + 1)]
    if sum(sizes[d] * int((spent == d).sum()) for d in range(half + 1)) > SLICE_VALUES and width > 8:
        for child in (2 * start, 2 * start + 1):
            yield from _collisions(prints, index, child, bits + 1, half)
        return
    low = np.uint64((1 << width) - 1)
    values, owners = [], []
    for d in range(half + 1):
        own = np.flatnonzero(spent == d)
        masks = _masks(width, half - d)
        values.append(((prints[own] & low)[:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(own, len(masks)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    same = np.flatnonzero(value[1:] == value[:-1])
    a, b = owner[same], owner[same + 1]
    a, b = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(a * len(prints) + b)
    a, b = pairs // len(prints), pairs % len(prints)
    close = np.bitwise_count(prints[a] ^ prints[b]) <= 2 * half
    yield np.stack([index[a[close]], index[b[close]]])


def _forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest position in the component of every position."""
    label = np.arange(n)
    a, b = pairs
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def linked_fingerprints(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within ``radius`` bits.

    ``radius`` must be even: then sharing a value within half of it is the same as being near.
    """
    if radius % 2:
        raise ValueError("The radius must be even")
    half = radius // 2
    per_print = sum(math.comb(64, k) for k in range(half + 1))
    total = classes.count() * per_print
    bits = min(30, max(4, math.ceil(math.log2(max(1, total / GROUP_VALUES)))))
    changes = F.array(*[F.lit(int(m)).cast("long") for m in _masks(bits, half)])
    start = F.shiftrightunsigned("fp", 64 - bits)
    sent = classes.select(
        "fp", F.explode(F.transform(changes, lambda m: start.bitwiseXOR(m))).alias("start")
    )

    def run(key: tuple, group: pa.Table) -> pa.Table:
        prints = np.sort(group.column("fp").to_numpy().view(np.uint64))
        found = list(
            _collisions(prints, np.arange(len(prints)), key[0].as_py(), bits, half)
        )
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        root = _forest(len(prints), pairs)
        child = np.flatnonzero(root != np.arange(len(prints)))
        signed = prints.view(np.int64)
        return pa.table({"a": pa.array(signed[child]), "b": pa.array(signed[root[child]])})

    return sent.groupBy("start").applyInArrow(run, "a bigint, b bigint").distinct()


def near_copies(rows: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    Null and empty texts have the fingerprint zero and are linked like any other. Repeated rows
    stay. Rows without an id have a fingerprint and the component's smallest id, NULL if none of
    it has an id. Extra columns are ignored; an empty table gives an empty result.
    """
    count = F.count(F.lit(1)).alias("n")
    found = stored(fingerprints(rows, id_column, text))
    classes = stored(found.groupBy("fp").agg(F.min(id_column).alias("first"), count))
    roots = components(linked_fingerprints(classes))
    members = stored(
        classes.join(roots, F.col("fp") == F.col("node"), "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    )
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id"), count)
    large = hot_keys(smallest, "root", members.count())
    named = stored(
        spread_join(members, smallest.drop("n"), "root", "inner", large).select("fp", "component_id")
    )
    copied = hot_keys(classes, "fp", found.count())
    return spread_join(found, named, "fp", "inner", copied).select(
        id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows without near copies: of every component the document with the smallest id stays.

    Rows that repeat an id count as one document. Rows without an id take no part and stay.
    """
    named = near_copies(rows.filter(F.col(id_column).isNotNull()), id_column)
    kept = named.filter(F.col("component_id") == F.col(id_column)).select(id_column).distinct()
    unique = rows.join(kept, id_column, "left_semi").dropDuplicates([id_column])
    return unique.unionByName(rows.filter(F.col(id_column).isNull())).select(rows.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
