"""Operator 7: token ids in ORC files.

Rows are split by ranges of the id and sorted, encoded, and written as ORC: integers are run-length
encoded, every stripe has row indexes, and the id has a Bloom filter, so that a reader takes the
stripes of a file in parallel and skips those, and the row groups, that cannot hold an id.

Columns of a file: the id, ``part`` (the range the row belongs to, in ascending order),
``first_token`` (ids before it in its range), ``n_tokens`` and ``ids``.

The tokenizers library encodes each distinct pre-token once per worker; texts are cut into
pre-tokens as its own pattern does. Special tokens inside a text are ids of their own, as is the
library's default. A null text counts as empty and holds only the end id. Repeated rows are
written each, in the order of their texts' hash; rows without an id come first. Extra columns are
not written. An empty table gives files without rows.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import groups_of, shared_folder, slices, table
from ticketscope.llm.piece_cache import PieceCache
from ticketscope.llm.pretokenize import cuts, parts

END_ID = 2
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.fpp": "0.01",
}


class LibraryEncoder:
    """Ids of the tokenizers library, looked up by pre-token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added if t["special"]}
        names = sorted(self.special, key=len, reverse=True)
        self.pattern = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.cache = PieceCache(self._resolve)

    def _resolve(self, fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [piece.decode() for piece in fresh]
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        ids = [e.ids for e in found]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for own in ids for i in own), np.int64, int(counts.sum())), counts

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        utf8, offsets, firsts = cuts(texts)
        ids, sizes = self.cache.ids(utf8, offsets)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[firsts]

    def _one(self, text: str) -> np.ndarray:
        found = [np.zeros(0, np.int32)]
        for span in self.pattern.split(text) if self.pattern else [text]:
            if span in self.special:
                found.append(np.array([self.special[span]], np.int32))
            else:
                found += [self._plain([part])[0] for part in parts(span)]
        return np.concatenate(found)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, first id of every text and the total) of groups of texts in order."""
        for start, stop in groups_of(texts):
            group = texts[start:stop]
            if any(len(t) > 1 << 20 or self.pattern and self.pattern.search(t) for t in group):
                own = [self._one(t) for t in group]
                firsts = np.cumsum([0, *map(len, own)])
                yield np.concatenate(own), firsts
            else:
                yield self._plain(group)


@functools.cache
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_token_files(
    rows: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID,
    id_column: str = "doc_id", text: str = "text",
) -> None:
    """Write the ids of every text, with the end id, to ORC files in ascending order of the id."""
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        encoder = _encoder(tokenizer)
        for batch in slices(batches):
            done = 0
            for ids, firsts in encoder.encode(batch.column("text").to_pylist()):
                n = len(firsts) - 1
                ends = firsts + np.arange(n + 1)
                flat = np.empty(len(ids) + n, np.int32)
                last = np.zeros(len(flat), bool)
                last[ends[1:] - 1] = True
                flat[last] = end_id
                flat[~last] = ids
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(done, n),
                     pa.array(np.full(n, part, np.int64)),
                     pa.array(total + ends[:-1]),
                     pa.array(np.diff(ends)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    names=["id", "part", "first_token", "n_tokens", "ids"],
                )
                done += n
                total += int(ends[-1])

    source = rows.select(F.col(id_column).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    ordered = source.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie")
    encoded = ordered.sortWithinPartitions("id", "tie").drop("tie").mapInArrow(
        run, f"id {kind}, part bigint, first_token bigint, n_tokens bigint, ids array<int>"
    )
    options = ORC_OPTIONS | {"orc.bloom.filter.columns": id_column}
    encoded.withColumnRenamed("id", id_column).write.options(**options).orc(folder)


def read_token_files(spark: SparkSession, folder: str, ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with ``ids`` only those, read by stripes that may hold them."""
    rows = spark.read.orc(folder)
    return rows if ids is None else rows.filter(F.col(rows.columns[0]).isin(ids))


def with_start(rows: DataFrame) -> DataFrame:
    """``start``: ids of all rows before it, from the totals of the ranges before its own."""
    totals = rows.groupBy("part").agg(F.max(F.col("first_token") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "part").withColumn("start", F.col("offset") + F.col("first_token"))


def with_crc32(rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, part, first_token, n_tokens, ids_crc32): the checksum of the ids as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column("ids")
            flat, at = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_pylist()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(sums, pa.int64())],
                names=["id", "part", "first_token", "n_tokens", "ids_crc32"],
            )

    kind = rows.schema[id_column].dataType.simpleString()
    source = rows.select(F.col(id_column).alias("id"), "part", "first_token", "n_tokens", "ids")
    found = source.mapInArrow(
        run, f"id {kind}, part bigint, first_token bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return found.withColumnRenamed("id", id_column)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark) + ".orc"
    write_token_files(
        table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json")
    )
    rows = read_token_files(spark, folder)
    starts = with_start(rows.drop("ids")).select("part", "offset").distinct()
    found = with_crc32(rows).join(starts, "part")
    return found.select(
        "doc_id", (F.col("offset") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32"
    )
