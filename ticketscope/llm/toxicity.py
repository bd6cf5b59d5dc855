"""Operator 3: toxicity by a weighted lexicon that is matched with Aho-Corasick.

Texts are folded first: lower case, look-alike letters and accents to plain letters, digits and
signs inside words, and one or two at their end, to the letters they stand for; i, l, 1, ! and | become one letter. Entries are
whole words and beginnings of words. Their weights are log odds in a bounded sample of labelled
texts; phrases around an entry that only clean texts have are exceptions and cancel a match. The
sum of a text's weights and the same by its length give the score through a logistic curve.

Null and empty texts have no match and the score of such texts. Without labels of both kinds the
score is 0 for all. Repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import slices, stored, table

# Bound of the sample that is learned from: texts of each label. Entries are as many as it supports.
TRAIN_TEXTS = 4_000
# An entry needs so many toxic texts of the sample, however large it is.
SUPPORT = 4
MIN_WEIGHT = 2.5
# Phrases that are harmless whatever the sample says, as folded words.
EXCEPTIONS: tuple[str, ...] = ()

# Letters of other scripts that look like Latin ones.
_LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "i", "đ": "d",
}
_SIGNS = str.maketrans("013456789@$!|", "oieasgtbgasii")
_HIDDEN = "­​‌‍⁠﻿"
_SIGN_RUN = re.compile(r"[0-9@$!|]+(?=[a-z])")
_LAST_SIGNS = re.compile(r"(?<=[a-z])[0-9@$]{1,2}(?![0-9@$a-z])")
_HAS_SIGN = re.compile(r"[0-9@$!|][a-z]|[a-z][0-9@$]")
_LETTERS = re.compile(r"[^\W\d_]+")


@functools.cache
def _folding() -> dict[int, str | None]:
    found: dict[int, str | None] = {ord(c): None for c in _HIDDEN}
    found[ord("l")] = "i"
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
        plain = unicodedata.normalize("NFKD", chr(code))
        base = "".join(c for c in plain if not unicodedata.combining(c)).lower()
        if base.isascii() and base.isalpha():
            found[code] = base.replace("l", "i")
    found.update({code: None for code in range(0x300, 0x370)})
    found.update({ord(a): b for a, b in _LOOK_ALIKE.items()})
    return found


def _as_letters(match: re.Match) -> str:
    signs, before = match.group(), match.string[match.start() - 1:match.start()]
    inside = before.isalpha() and (len(signs) <= 2)
    leading = not before.isalnum() and len(signs) == 1 and signs not in "!|"
    return signs.translate(_SIGNS) if inside or leading else signs


def fold(text: str) -> list[str]:
    """The words of a text in their folded form."""
    plain = text.lower().translate(_folding())
    if _HAS_SIGN.search(plain):
        plain = _SIGN_RUN.sub(_as_letters, plain)
        plain = _LAST_SIGNS.sub(lambda match: match.group().translate(_SIGNS), plain)
    return _LETTERS.findall(plain)


def entries_of(word: str) -> Iterator[str]:
    """What a word may match: itself (between blanks), and its beginnings (after a blank)."""
    yield f" {word} "
    for n in range(4, min(8, len(word))):
        yield f" {word[:n]}"


@dataclass
class Lexicon:
    """Weights of entries, excepted phrases, and the logistic curve."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)
    key: str = field(default="")

    def __post_init__(self):
        parts = repr((sorted(self.weights.items()), self.exceptions, self.curve)).encode()
        self.key = hashlib.blake2b(parts, digest_size=16).hexdigest()


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.empty = not (lexicon.weights or lexicon.exceptions)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, words: list[str]) -> tuple[str, dict[int, float]]:
        """(the joined words, best weight by the place of a matched word)."""
        joined = f" {' '.join(words)} "
        found: dict[int, float] = {}
        if self.empty:
            return joined, found
        spans = []
        for end, (size, weight) in self.automaton.iter(joined):
            start = end - size + 1
            if weight is None:
                spans.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        for start, end in spans:
            for place in [p for p in found if start <= p < end]:
                del found[place]
        return joined, found

    def measure(self, text: str) -> tuple[float, float]:
        """(log of the sum of weights, log of the same by length)."""
        words = fold(text)
        total = sum(self.hits(words)[1].values())
        return math.log1p(total), math.log1p(100 * total / max(20, len(words)))

    def score(self, text: str) -> float:
        base, by_sum, by_length = self.lexicon.curve
        a, b = self.measure(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, base + by_sum * a + by_length * b))))


_MATCHERS: dict[str, Matcher] = {}


def _matcher(lexicon: Lexicon) -> Matcher:
    if lexicon.key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[lexicon.key] = Matcher(lexicon)
    return _MATCHERS[lexicon.key]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, each: int = TRAIN_TEXTS) -> DataFrame:
    """(text, toxic) of at most ``each`` documents of either label, chosen by a hash of the id.

    The chosen ids are at most twice ``each``, so that the texts are found without a shuffle. Of
    near copies mostly one is used.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    enough = F.lit(False)
    for label, n in counts.items():
        enough |= (F.col("toxic") == label) & (place < int(min(1, 3 * each / n) * (1 << 30)))
    order = Window.partitionBy("toxic").orderBy("place", "doc_id")
    chosen = (
        usable.filter(enough).withColumn("place", place)
        .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each)
        .select("doc_id", "toxic")
    )
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = [_mark(t) for t in batch.column("text").to_pylist()]
            yield batch.append_column("mark", pa.array(marks, pa.int64()))

    marked = found.mapInArrow(run, "text string, toxic int, mark bigint")
    return marked.dropDuplicates(["toxic", "mark"]).select("text", "toxic")


def _mark(text: str) -> int:
    """The smallest hash of five words in a row: near copies mostly share it and count once."""
    words = fold(text)
    if len(words) < 5:
        return xxhash.xxh64_intdigest(" ".join(words)) >> 1
    return min(xxhash.xxh64_intdigest(" ".join(words[i:i + 5])) for i in range(len(words) - 4)) >> 1


def _counted(sample: DataFrame, found: str, count) -> DataFrame:
    """(entry, toxic texts, clean texts) from ``count(text)``, merged per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sums = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                sums[toxic].update(count(text))
            names = list(sums[0].keys() | sums[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([sums[1][x] for x in names], pa.int64()),
                 pa.array([sums[0][x] for x in names], pa.int64())],
                names=[found, "bad", "good"],
            )

    counted = sample.mapInArrow(run, f"{found} string, bad bigint, good bigint")
    return counted.groupBy(found).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def learn(documents: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicon, exceptions and curve from the labelled rows that may be learned from."""
    sample = stored(labelled_sample(documents, labels))
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon({})
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    ranked = (
        _counted(sample, "entry", lambda text: {e for w in set(fold(text)) for e in entries_of(w)})
        .filter(F.col("bad") >= SUPPORT).withColumn("weight", weight)
        .filter(F.col("weight") >= MIN_WEIGHT)
        .orderBy(F.desc(F.col("bad") * F.col("weight")), "entry")
    )
    weights = {r.entry: r.weight for r in ranked.collect()}
    # A longer beginning is of no use where a shorter one weighs as much.
    weights = {
        e: w for e, w in weights.items()
        if not any(weights.get(e[:n], 0) >= w for n in range(5, len(e)))
    }
    plain = Matcher(Lexicon(weights))

    def phrases(text: str) -> set[str]:
        joined, hits = plain.hits(fold(text))
        found = set()
        for place in hits:
            end = joined.index(" ", place + 1)
            word = joined[place + 1:end]
            before, after = joined[:place].rpartition(" ")[2], joined[end + 1:].partition(" ")[0]
            found |= {f"{before} {word}"} if before else set()
            found |= {f"{word} {after}"} if after else set()
        return found

    harmless = (
        _counted(sample, "phrase", phrases).filter((F.col("bad") == 0) & (F.col("good") >= 2))
        .orderBy(F.desc("good"), "phrase")
    )
    exceptions = tuple(sorted({r.phrase for r in harmless.collect()} | set(EXCEPTIONS)))
    return Lexicon(weights, exceptions, _fit(sample, Lexicon(weights, exceptions), labels))


def _fit(sample: DataFrame, lexicon: Lexicon, labels: DataFrame) -> tuple[float, float, float]:
    """The logistic curve, with the texts of either label weighted by how many labels there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(lexicon)
        for batch in slices(batches):
            rows = [matcher.measure(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.float64()) for c in columns] + [batch.column("toxic").cast(pa.int64())],
                names=["a", "b", "toxic"],
            )

    # As many rows as the bounded sample has; sorted, so that sums do not depend on their order.
    rows = sorted(sample.mapInArrow(run, "a double, b double, toxic bigint").collect())
    x = np.array([(1.0, r.a, r.b) for r in rows])
    y = np.array([r.toxic for r in rows], np.float64)
    real = labels.filter(~held_out()).agg(
        F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")
    ).first()
    weight = np.where(y == 1, real.bad / max(1, y.sum()), real.good / max(1, (1 - y).sum()))
    weight *= len(y) / weight.sum()
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 0.01 * beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        step = np.linalg.solve(bend, slope)
        beta -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(round(b, 6)) for b in beta)


def score_texts(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(lexicon)
        for batch in slices(batches):
            scores = [matcher.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    source = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scores = score_texts(documents, learn(documents, table(spark, sf_dir, "labels")))
    return scores.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
