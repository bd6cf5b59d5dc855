"""Operator 6: token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch that are not in the cache become one ragged array of symbols.
In every round each sequence finds its pair of lowest rank, and all sequences merge theirs at the
same time (``merging.PairTable``). The symbols that survive are counted.

The special tokens that the file lists are found in a text before anything else and count as one
token each, as the tokenizers library does by default. A null text counts as empty: zero bytes,
zero tokens. Repeated rows are counted each; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.llm.common import groups_of, slices, table
from ticketscope.llm.merging import PairTable
from ticketscope.llm.piece_cache import PieceCache
from ticketscope.llm.pretokenize import cuts, parts

CACHE_ENTRIES = 400_000
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_tokenizer(path: str) -> tuple[PairTable, list[str]]:
    """(merges, special tokens) of a byte-level BPE tokenizer's JSON file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab = spec["model"]["vocab"]
    merges = spec["model"]["merges"]
    pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
    results = np.array([vocab[a + b] for a, b in merges], np.int64)
    byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
    found = PairTable(pairs, np.arange(len(merges)), results, byte_ids)
    return found, [t["content"] for t in spec["added_tokens"] if t["special"]]


@functools.cache
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


class TokenCounter:
    """Counts tokens with a bounded cache of pre-tokens; one per worker process and file."""

    def __init__(self, path: str):
        merges, special = read_tokenizer(path)
        self.cache = PieceCache(lambda words: merges.merge(words, want_symbols=False))
        special = sorted(special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def _plain(self, texts: list[str]) -> np.ndarray:
        utf8, offsets, firsts = cuts(texts)
        _, sizes = self.cache.look_up(utf8, offsets)
        return np.diff(np.concatenate([[0], np.cumsum(sizes)])[firsts])

    def _one(self, text: str) -> int:
        spans = self.special.split(text) if self.special else [text]
        counted = sum(int(self._plain([part]).sum()) for span in spans for part in parts(span))
        return counted + len(spans) - 1

    def count(self, texts: list[str]) -> np.ndarray:
        found = []
        for start, stop in groups_of(texts):
            group = texts[start:stop]
            # Texts with special tokens and very long ones are counted span by span.
            odd = [i for i, t in enumerate(group)
                   if len(t) > 1 << 20 or self.special and self.special.search(t)]
            plain = list(group)
            for i in odd:
                plain[i] = ""
            counts = self._plain(plain)
            for i in odd:
                counts[i] = self._one(group[i])
            found.append(counts)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def token_counts(rows: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text; ``path`` is a tokenizer's JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _counter(path)
        for batch in slices(batches):
            counts = own.count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce("text", F.lit(""))
    source = rows.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = source.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, sf_dir, "documents"), path)
