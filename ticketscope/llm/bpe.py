"""Operator 10: byte-level BPE encoding and decoding.

Texts are cut into pre-tokens by ``pretokenize`` (class arrays and an associative scan, no regular
expression). Distinct pre-tokens are merged once per worker and kept in a bounded cache that is
looked up for a batch at a time. The end of every token in the
text's bytes is kept beside the ids and places the tokens when they are decoded.

A null text counts as empty and an empty text has no tokens. Repeated rows are encoded each, an
empty table gives an empty result, other columns of the input are ignored but for the id.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.llm.common import groups_of, held, slices, table
from ticketscope.llm.merging import PairTable
from ticketscope.llm.piece_cache import PieceCache
from ticketscope.llm.pretokenize import cuts, parts

@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pair_table(ranks: dict[bytes, int]) -> PairTable:
    """All pairs of tokens that are a token together; its id is its rank."""
    found = [
        (ranks[token[:i]], ranks[token[i:]], rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
        and max(ranks[token[:i]], ranks[token[i:]]) < rank
    ]
    made = np.array(found, np.int64).reshape(-1, 3)
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    return PairTable(made[:, :2], made[:, 2], made[:, 2], byte_ids)


class Encoder:
    """Encodes texts with a cache of pre-tokens; one per worker process and file."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.pairs = pair_table(self.ranks)
        self.cache = PieceCache(self._merged)

    def _merged(self, fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens; one that is a token needs no merging."""
        whole = [self.ranks.get(piece, -1) for piece in fresh]
        words = [piece for piece, rank in zip(fresh, whole) if rank < 0]
        symbols, counts = self.pairs.merge(words)
        sizes = np.ones(len(fresh), np.int64)
        merged = np.array(whole, np.int64) < 0
        sizes[merged] = counts
        ids = np.empty(int(sizes.sum()), np.int64)
        place = np.repeat(merged, sizes)
        ids[place] = symbols
        ids[~place] = np.array(whole, np.int64)[~merged]
        return ids, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of every text and the total)."""
        utf8, offsets, firsts = cuts(texts)
        ids, sizes = self.cache.ids(utf8, offsets)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[firsts]

    def encode_any(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``encode`` in steps of bounded size; a very long text is encoded in parts."""
        for start, stop in groups_of(texts):
            group = texts[start:stop]
            if len(group) > 1 or len(group[0]) <= 1 << 20:
                yield self.encode(group)
            else:
                ids = np.concatenate([self.encode([part])[0] for part in parts(group[0])])
                yield ids, np.array([0, len(ids)])


def encoder(path: str) -> Encoder:
    """The worker's encoder, so that its cache outlives a task."""
    return held("bpe", path, lambda: Encoder(path))


@functools.cache
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all tokens in order of id, where each begins and the total)."""
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    return np.frombuffer(b"".join(tokens), np.uint8), starts


def decode_ids(ids: np.ndarray, ends: np.ndarray, path: str) -> bytes:
    """The bytes of tokens whose ends in the result are known. Raises if ends and ids disagree."""
    if not len(ids):
        return b""
    flat, starts = vocabulary(path)
    lengths = starts[ids + 1] - starts[ids]
    if not np.array_equal(np.cumsum(lengths), ends):
        raise ValueError("Token ids and token offsets do not belong together")
    shift = starts[ids] - (ends - lengths)
    out = []
    for low in range(0, len(ids), 1 << 18):
        part = slice(low, low + (1 << 18))
        base = ends[low] - lengths[low]
        index = np.repeat(shift[part], lengths[part]) + np.arange(base, ends[part][-1])
        out.append(flat[index].tobytes())
    return b"".join(out)


def bpe_encode(rows: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>, ends array<long>): tokens of each text and where they end in its bytes.

    ``path`` is a rank file that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        _, starts = vocabulary(path)
        for batch in slices(batches):
            done = 0
            for ids, firsts in own.encode_any(batch.column("text").to_pylist()):
                n = len(firsts) - 1
                ends = np.concatenate([[0], np.cumsum(starts[ids + 1] - starts[ids])])
                local = ends[1:] - np.repeat(ends[firsts[:-1]], np.diff(firsts))
                lists = pa.array(firsts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(done, n),
                     pa.ListArray.from_arrays(lists, pa.array(ids)),
                     pa.ListArray.from_arrays(lists, pa.array(local))],
                    names=["id", "ids", "ends"],
                )
                done += n

    kind = rows.schema[id_column].dataType.simpleString()
    source = rows.select(F.col(id_column).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    found = source.mapInArrow(run, f"id {kind}, ids array<int>, ends array<bigint>")
    return found.withColumnRenamed("id", id_column)


def bpe_decode(rows: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, ids, decoded binary) of rows from ``bpe_encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, ends = batch.column("ids"), batch.column("ends")
            flat, stops = ids.values.to_numpy(), ends.values.to_numpy()
            a, b = ids.offsets.to_pylist(), ends.offsets.to_pylist()
            for low in range(0, len(a) - 1, 64):
                some = range(low, min(low + 64, len(a) - 1))
                texts = [decode_ids(flat[a[i]:a[i + 1]], stops[b[i]:b[i + 1]], path) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(low, len(some)), ids.slice(low, len(some)),
                     pa.array(texts, pa.binary())],
                    names=["id", "ids", "decoded"],
                )

    kind = rows.schema[id_column].dataType.simpleString()
    source = rows.select(F.col(id_column).alias("id"), "ids", "ends")
    found = source.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")
    return found.withColumnRenamed("id", id_column)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and decoded.

    Both in one pass: a worker holds the ids and offsets of one group of texts at a time, and only
    digests leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        _, starts = vocabulary(path)
        for batch in slices(batches, 256):
            counts, coded, decoded = [], [], []
            for ids, firsts in own.encode_any(batch.column("text").to_pylist()):
                for low, high in zip(firsts.tolist(), firsts[1:].tolist()):
                    some = ids[low:high]
                    ends = np.cumsum(starts[some + 1] - starts[some])
                    counts.append(high - low)
                    coded.append(_digest_of_numbers(some))
                    decoded.append(hashlib.sha256(decode_ids(some, ends, path)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()),
                 pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    source = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def _digest_of_numbers(ids: np.ndarray) -> str:
    """SHA-256 of the decimal ids joined by one space."""
    found = hashlib.sha256()
    for low in range(0, len(ids), 1 << 16):
        found.update((" " if low else "").encode())
        found.update(" ".join(map(str, ids[low:low + (1 << 16)].tolist())).encode())
    return found.hexdigest()


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path)
