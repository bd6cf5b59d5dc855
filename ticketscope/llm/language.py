"""Operator 5: the language of a text by a linear-chain conditional random field over its words.

A word's features are its letter n-grams up to three with the word's ends, its beginnings and
endings of four letters (affixes), and the word itself (a learned lexicon), hashed to a table of
weights for each language. Transitions between the languages of neighbouring words are learned
with them, by gradient steps on sequences that are spliced from pieces of labelled texts, so that
the model sees switches. Forward-backward gives every word's language probabilities; their sum by
letters gives the language of the text and its share, the score.

Long texts do not slow a batch down: words are put in blocks, the transfer matrices of all blocks
are multiplied side by side, and the blocks of a text are joined in order.

A null text, or one without a letter, has the language ``und`` and score 0, and so has every text
if there is nothing to learn from. Repeated rows are labelled each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ticketscope.llm.common import groups_of, held, slices, table

# Bounds of the labelled sample: texts of each language, and the longest text that is used.
TRAIN_TEXTS = 300
TRAIN_LETTERS = 20_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_BITS = 16
_BLOCK = 32
_CACHE_WORDS = 150_000
_SPLICED, _LENGTH, _EPOCHS, _BATCH, _STEP = 5_000, 64, 3, 250, 0.3


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all words, first feature of every word).

    Numbers below 2**16 are n-grams and affixes, those above are whole words.
    """
    marked = "".join([f"^{w}$" for w in words])
    points = np.frombuffer(marked.encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(points))
    at_start = np.zeros(len(points), bool)
    at_start[ends - sizes] = True
    found, owners = [], []
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, 6):
        step = np.zeros(len(points), np.uint64)
        step[:max(0, len(points) - n + 1)] = points[n - 1:]
        rolled = rolled * np.uint64(0x100000001B3) + step + np.uint64(n)
        fits = left >= n
        if n > 3:  # the end mark counts: beginnings and endings of up to four letters
            fits &= at_start | (left == n)
        number = (rolled[fits] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)
        found.append(number.astype(np.int64))
        owners.append(owner[fits])
    whole = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little") for w in words]
    found.append((np.array(whole, np.int64) & ((1 << _BITS) - 1)) + (1 << _BITS))
    owners.append(np.arange(len(words)))
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return np.concatenate(found)[order], np.concatenate([[0], np.cumsum(counts)])


def _features_in_parts(words: list[str], size: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of many words, with working memory for a part of them."""
    found, counts = [], []
    for low in range(0, len(words), size):
        own, firsts = features(words[low:low + size])
        found.append(own.astype(np.int32))
        counts.append(np.diff(firsts))
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _word_scores(weights: np.ndarray, found: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    sums = np.add.reduceat(weights[found], firsts[:-1], axis=0)
    return sums / np.sqrt(np.diff(firsts))[:, None]


@dataclass
class Model:
    """Weights by feature and language, and transition scores."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    key: str = field(default="")

    def __post_init__(self):
        parts = self.weights.tobytes() + self.transitions.tobytes() + repr(self.languages).encode()
        self.key = hashlib.blake2b(parts, digest_size=16).hexdigest()


def _spliced(texts: list[np.ndarray], labels: np.ndarray, random: np.random.Generator):
    """Sequences of words: whole runs of one text, or runs of several texts after each other."""
    usable = np.flatnonzero([len(t) > 0 for t in texts])
    tokens = np.zeros((_SPLICED, _LENGTH), np.int64)
    truth = np.zeros((_SPLICED, _LENGTH), np.int64)
    for row in range(_SPLICED):
        at = 0
        switching = random.random() < 0.5
        while at < _LENGTH:
            text = usable[random.integers(len(usable))]
            run = int(random.integers(4, 24)) if switching else _LENGTH
            start = int(random.integers(max(1, len(texts[text]) - run + 1)))
            piece = texts[text][start:start + run][:_LENGTH - at]
            tokens[row, at:at + len(piece)] = piece
            truth[row, at:at + len(piece)] = labels[text]
            at += len(piece)
    return tokens, truth


def train(samples: list[tuple[str, str]], seed: int = 5) -> Model:
    """A model from (text, language) pairs."""
    languages = sorted({language for _, language in samples})
    k = len(languages)
    weights = np.zeros((2 << _BITS, k))
    moves = np.zeros((k, k))
    numbers: dict[str, int] = {}
    texts = [
        np.array([numbers.setdefault(w, len(numbers)) for w in words_of(text)], np.int64)
        for text, _ in samples
    ]
    if k < 2 or not numbers:
        return Model(languages, weights.astype(np.float32), moves)
    labels = np.array([languages.index(language) for _, language in samples])
    found, firsts = _features_in_parts(list(numbers))
    scale = 1 / np.sqrt(np.diff(firsts))
    random = np.random.default_rng(seed)
    tokens, truth = _spliced(texts, labels, random)
    squares, move_squares = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    one_hot = np.eye(k)
    for _ in range(_EPOCHS):
        order = random.permutation(_SPLICED)
        for low in range(0, _SPLICED, _BATCH):
            rows = order[low:low + _BATCH]
            used, token = np.unique(tokens[rows], return_inverse=True)
            token = token.reshape(len(rows), _LENGTH)
            spans = [np.arange(a, b) for a, b in zip(firsts[used], firsts[used + 1])]
            own = found[np.concatenate(spans)]
            own_firsts = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
            score = _word_scores(weights, own, own_firsts)[token]
            emission = np.exp(score - score.max(axis=2, keepdims=True))
            move = np.exp(moves - moves.max(axis=1, keepdims=True))
            alpha, beta = np.empty_like(emission), np.ones_like(emission)
            alpha[:, 0] = emission[:, 0]
            for t in range(1, _LENGTH):
                alpha[:, t] = (alpha[:, t - 1] @ move) * emission[:, t]
                alpha[:, t] /= alpha[:, t].sum(axis=1, keepdims=True)
            for t in range(_LENGTH - 2, -1, -1):
                beta[:, t] = (beta[:, t + 1] * emission[:, t + 1]) @ move.T
                beta[:, t] /= beta[:, t].sum(axis=1, keepdims=True)
            posterior = alpha * beta
            posterior /= posterior.sum(axis=2, keepdims=True)
            right = (emission * beta)[:, 1:]
            pair = alpha[:, :-1, :, None] * move * right[:, :, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            real = one_hot[truth[rows]]
            seen = np.einsum("nti,ntj->ij", real[:, :-1], real[:, 1:])
            slope = (pair.sum(axis=(0, 1)) - seen) / len(rows)
            move_squares += slope**2
            moves -= _STEP * slope / np.sqrt(move_squares)
            wrong = (posterior - real).reshape(-1, k)
            for j in range(k):
                by_word = np.bincount(token.ravel(), wrong[:, j], len(used)) * scale[used]
                slope = np.bincount(own, np.repeat(by_word, np.diff(own_firsts)), 2 << _BITS)
                slope /= len(rows)
                squares[:, j] += slope**2
                weights[:, j] -= _STEP * slope / np.sqrt(squares[:, j])
    return Model(languages, weights.astype(np.float32), moves)


class Tagger:
    """Word probabilities of a model, with a bounded cache of word scores."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row of emission scores for each word; a word without a letter has NaN."""
        if len(self.numbers) > _CACHE_WORDS:
            self._forget()
        numbers = self.numbers
        known = list(map(numbers.get, words))
        fresh = list({w for w, n in zip(words, known) if n is None})
        if fresh:
            numbers.update(zip(fresh, range(len(numbers), len(numbers) + len(fresh))))
            added = _word_scores(self.model.weights, *_features_in_parts(fresh)).astype(np.float32)
            added[[not any(map(str.isalpha, w)) for w in fresh]] = np.nan
            self.scores = np.concatenate([self.scores, added])
            known = map(numbers.__getitem__, words)
        return self.scores[np.fromiter(known, np.int64, len(words))]

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Language probabilities of the words of sequences that stand after each other."""
        k = len(self.model.languages)
        move = np.exp(self.model.transitions - self.model.transitions.max(axis=1, keepdims=True))
        blocks = -(-lengths // _BLOCK)
        first_block = np.cumsum(blocks) - blocks
        ends = np.cumsum(lengths)
        inside = np.arange(len(scores)) - np.repeat(ends - lengths, lengths)
        block = np.repeat(first_block, lengths) + inside // _BLOCK
        place = inside % _BLOCK
        total = int(blocks.sum())
        emission = np.ones((_BLOCK, total, k))
        emission[place, block] = np.exp(scores - scores.max(axis=1, keepdims=True))
        real = np.zeros((_BLOCK, total), bool)
        real[place, block] = True
        heads = first_block[blocks > 0]
        short = [np.flatnonzero(~r) for r in real]
        # Row i of a block's product: where each state leads to if the block is entered in i.
        product = np.tile(np.eye(k), (total, 1))
        for t in range(_BLOCK):
            moved = (product @ move).reshape(total, k, k)
            if t == 0:  # the first word of a sequence has no transition
                moved[heads] = np.eye(k)
            moved *= emission[t][:, None, :]
            moved[short[t]] = product.reshape(total, k, k)[short[t]]
            product = moved.reshape(total * k, k)
        product = product.reshape(total, k, k)
        product /= product.sum(axis=(1, 2), keepdims=True)
        entry, leave = np.full((total, k), 1 / k), np.full((total, k), 1 / k)
        for j in range(1, int(blocks.max(initial=0))):
            now = first_block[blocks > j] + j
            entry[now] = np.einsum("ni,nij->nj", entry[now - 1], product[now - 1])
            entry[now] /= entry[now].sum(axis=1, keepdims=True)
        for j in range(2, int(blocks.max(initial=0)) + 1):
            now = (first_block + blocks)[blocks >= j] - j
            leave[now] = np.einsum("nij,nj->ni", product[now + 1], leave[now + 1])
            leave[now] /= leave[now].sum(axis=1, keepdims=True)
        alpha = np.empty_like(emission)
        last = entry
        for t in range(_BLOCK):
            step = last @ move
            if t == 0:
                step[heads] = 1 / k
            step *= emission[t]
            step[short[t]] = last[short[t]]
            alpha[t] = last = step
        last = leave
        for t in range(_BLOCK - 1, -1, -1):
            alpha[t] *= last
            step = (last * emission[t]) @ move.T
            step[short[t]] = last[short[t]]
            last = step
        found = alpha[place, block]
        return found / found.sum(axis=1, keepdims=True)

    def label(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        names, shares = [], []
        for start, stop in groups_of(texts):
            found = [words_of(t) for t in texts[start:stop]]
            words = [w for ws in found for w in ws]
            scores = self.word_scores(words)
            weights = np.fromiter(map(len, words), np.float64, len(words))
            empty = np.isnan(scores).any(axis=1)
            scores = np.where(empty[:, None], 0, scores)
            weights[empty] = 0
            lengths = np.array([len(ws) for ws in found], np.int64)
            text = np.repeat(np.arange(len(found)), lengths)
            by_word = self.posteriors(scores, lengths) * weights[:, None]
            sums = np.stack(
                [np.bincount(text, by_word[:, j], len(found)) for j in range(by_word.shape[1])], axis=1
            )
            totals = sums.sum(axis=1)
            best = sums.argmax(axis=1)
            share = np.divide(sums.max(axis=1), totals, out=np.zeros(len(found)), where=totals > 0)
            shares.append(np.minimum(share, 1.0))
            names += [self.model.languages[b] if n else UNKNOWN for b, n in zip(best, totals > 0)]
        return names, np.concatenate(shares) if shares else np.zeros(0)


def _tagger(model: Model) -> Tagger:
    """The worker's tagger of this model, so that its cache outlives a task."""
    return held("tagger", model.key, lambda: Tagger(model))


def labelled_sample(rows: DataFrame, each: int = TRAIN_TEXTS) -> list[tuple[str, str]]:
    """At most ``each`` texts of every language, chosen by a hash of the id.

    Counts come first, so that only a share of the rows that is likely to do is ranked.
    """
    usable = rows.filter(
        F.col("lang").isNotNull() & (F.length("text") <= TRAIN_LETTERS)
    ).select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    enough = F.lit(False)
    for language, n in counts.items():
        enough |= (F.col("lang") == language) & (place < int(min(1, 3 * each / n) * (1 << 30)))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    ranked = usable.filter(enough).withColumn("place", place).withColumn("n", F.row_number().over(order))
    chosen = ranked.filter(F.col("n") <= each).select("text", "lang").collect()
    return sorted((r.text, r.lang) for r in chosen)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def with_language(
    rows: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score"),
    without: tuple[str, ...] = (),
) -> DataFrame:
    """All rows, with language and score as further columns; columns ``without`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(model)
        for batch in slices(batches):
            found, scores = tagger.label([t or "" for t in batch.column("text").to_pylist()])
            kept = batch.drop_columns(list(without)) if without else batch
            yield kept.append_column(names[0], pa.array(found, pa.string())).append_column(
                names[1], pa.array(scores, pa.float64())
            )

    if not model.languages:
        return rows.drop(*without).withColumns({names[0]: F.lit(UNKNOWN), names[1]: F.lit(0.0)})
    added = [StructField(names[0], StringType()), StructField(names[1], DoubleType())]
    kept = [field for field in rows.schema if field.name not in without]
    return rows.mapInArrow(run, StructType([*kept, *added]))


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    return with_language(rows.select("doc_id", "text"), model, without=("text",))


def learned(rows: DataFrame) -> Model:
    """The model from the rows of documents that may be learned from."""
    return train(labelled_sample(rows.filter(~held_out())))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = identify(documents, learned(documents))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
