"""Operator 9: exact top-k by inner product with a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it, split by ranges of that key and
cut into annuli of at most ``ANNULUS`` vectors. A query first meets the annulus around its own
distance in its own cell, which gives it a k-th score to beat. By the triangle inequality a
vector x of an annulus is at least as far from query q as their distances to the pivot differ, so
that q.x <= (|q|^2 + |x|^2 - gap^2) / 2. The annuli of all cells are expanded in falling order of
this bound, in waves of ``WAVE`` annuli, then four times as many: after each wave the k-th score has
risen, and a query stops where no annulus ahead reaches it. Pivots are a bounded sample that grows
with the cube root of the number of vectors; every row is indexed, and the result is exact.

Components are floor(256 x), at the nearest 64-bit number where they are larger. Vectors that are
null, hold null or not finite components take no part, nor do rows without an id. Scores are exact
up to 38 digits and ranked so; one beyond 64 bits is NULL in the result. Queries meet vectors of their own length. Rows
that repeat id and vector count once. Ties go to the smaller id. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import stored, table

# Least and most pivots of one vector length; the most bounds what is sent to the driver and to tasks.
PIVOTS = 32
MOST_PIVOTS = 4096
ANNULUS = 1024
QUERY_BLOCK = 1024
# Annuli that a query meets in its first wave, and growth from wave to wave.
WAVE = 4
GROWTH = 4
# Tasks that share the annuli of one cell, at most: a cell may hold a large share of all vectors.
SPREAD = 32
SCALE = 256.0


# Scores travel as decimals: inner products of 64-bit components outgrow 64 bits.
SCORE_TYPE = "decimal(38,0)"
_SCORE = pa.decimal128(38, 0)
_MOST = 10**38 - 1


def _whole(vector: F.Column) -> F.Column:
    """Components as 64-bit numbers; NULL for a vector that takes no part."""
    parts = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~broken, parts)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<i8").astype(np.float64).reshape(len(column), dim)


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, vec): whole components as little-endian 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat, at = lists.values.to_numpy(), lists.offsets.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"),
                 pa.array([b - a for a, b in zip(at, at[1:])], pa.int32()),
                 pa.array([flat[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())],
                names=["vec_id", "dim", "vec"],
            )

    found = rows.select("vec_id", _whole(F.col("embedding")).alias("v"))
    found = found.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return found.mapInArrow(run, "vec_id bigint, dim int, vec binary")


def pivot_count(vectors: int) -> int:
    """Twice the cube root of the number of vectors, within the bounds."""
    return min(MOST_PIVOTS, max(PIVOTS, math.ceil(2 * vectors ** (1 / 3))))


def choose_pivots(vectors: DataFrame, n: int = PIVOTS) -> dict[int, np.ndarray]:
    """About ``n`` vectors of each length, chosen by a hash of the id: so many from each of 32 shares."""
    code = F.xxhash64("vec_id")
    order = Window.partitionBy("dim", "share").orderBy(code, "vec_id", "vec")
    ranked = vectors.withColumn("share", F.pmod(code, F.lit(32))).withColumn("n", F.row_number().over(order))
    found: dict[int, list[np.ndarray]] = {}
    for row in ranked.filter(F.col("n") <= math.ceil(n / 32)).collect():
        found.setdefault(row.dim, []).append(np.frombuffer(row.vec, "<i8").astype(np.float64))
    return {dim: np.stack(rows) for dim, rows in found.items()}


def keyed(vectors: DataFrame, pivots: dict[int, np.ndarray], to_all: bool = False) -> DataFrame:
    """Adds the squared length, the nearest pivot and its distance, and with ``to_all`` all distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                x, p = _matrix(own.column("vec"), dim), pivots[dim]
                square = (x * x).sum(axis=1)
                # By differences: large components would drown a small distance otherwise.
                distance = np.stack([np.sqrt(((x - one) ** 2).sum(axis=1)) for one in p], axis=1)
                cell = distance.argmin(axis=1)
                columns = [*own.columns, pa.array(square), pa.array(cell, pa.int32()),
                           pa.array(distance[np.arange(len(x)), cell])]
                names = ["vec_id", "dim", "vec", "square", "cell", "distance"]
                if to_all:
                    lists = pa.array(np.arange(len(x) + 1) * len(p), pa.int32())
                    columns.append(pa.ListArray.from_arrays(lists, pa.array(distance.ravel())))
                    names.append("distances")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = "vec_id bigint, dim int, vec binary, square double, cell int, distance double"
    return vectors.mapInArrow(run, kind + ", distances array<double>" if to_all else kind)


def annuli(vectors: DataFrame, size: int = ANNULUS) -> DataFrame:
    """Rows of at most ``size`` neighbouring vectors of one cell, sorted by distance to its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict | None = None

        def closed() -> pa.RecordBatch:
            nonlocal made
            made += 1
            order = np.argsort(held["ids"], kind="stable")
            vecs = [held["vecs"][i] for i in order]
            row = [base + made, held["dim"], held["cell"], held["low"], held["high"], held["most"],
                   np.array(held["ids"], "<i8")[order].tobytes(), b"".join(vecs)]
            return pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in row[:6]] + [pa.array([v], pa.binary()) for v in row[6:]],
                schema=pa.schema([
                    ("ring", pa.int64()), ("dim", pa.int64()), ("cell", pa.int64()),
                    ("low", pa.float64()), ("high", pa.float64()), ("most", pa.float64()),
                    ("ids", pa.binary()), ("vecs", pa.binary())]),
            )

        before = None
        for batch in batches:
            columns = [batch.column(c).to_pylist()
                       for c in ("dim", "cell", "distance", "square", "vec_id", "vec")]
            for dim, cell, distance, square, vec_id, vec in zip(*columns):
                if (vec_id, vec) == before:
                    continue
                before = vec_id, vec
                if held and (held["dim"] != dim or held["cell"] != cell or len(held["ids"]) >= size):
                    yield closed()
                    held = None
                if held is None:
                    held = {"dim": dim, "cell": cell, "low": distance, "most": 0.0, "ids": [], "vecs": []}
                held["high"], held["most"] = distance, max(held["most"], square)
                held["ids"].append(vec_id)
                held["vecs"].append(vec)
        if held:
            yield closed()

    key = ["dim", "cell", "distance", "vec_id", "vec"]
    ordered = vectors.select(*key, "square").repartitionByRange(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(
        run, "ring bigint, dim bigint, cell bigint, low double, high double, most double,"
             " ids binary, vecs binary"
    )


def best_in(pairs: DataFrame, rings: DataFrame, k: int, blocks: int) -> DataFrame:
    """The best k of each (query, ring) pair that reach the query's ``bar`` (NULL: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                x = np.frombuffer(row["vecs"], "<i8").reshape(len(ids), -1)
                queries = row["queries"]
                q = np.frombuffer(b"".join(a["vec"] for a in queries), "<i8").reshape(len(queries), -1)
                scores = _products(q, x)
                own = np.array([a["query_id"] for a in queries])
                lowest = -_MOST - 1 if scores.dtype == object else np.iinfo(np.int64).min
                bars = [lowest if a["bar"] is None else int(a["bar"]) for a in queries]
                if scores.dtype != object:
                    bars = [min(max(b, lowest), -lowest - 1) for b in bars]
                bar = np.array(bars, scores.dtype)
                allowed = (ids[None, :] != own[:, None]) & (scores >= bar[:, None]).astype(bool)
                # Ids ascend, so that of equal scores the first are the ones to keep.
                scores = np.where(allowed, scores, lowest)
                top = _top(scores, k)
                at, place = np.nonzero(np.take_along_axis(allowed, top, axis=1))
                column = top[at, place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[at]), pa.array([queries[i]["query_key"] for i in at], pa.int64()),
                     pa.array(ids[column]), _decimals(scores[at, column])],
                    names=["query_id", "query_key", "vec_id", "score"],
                )

    block = F.pmod(F.xxhash64("query_id", "query_key"), F.lit(blocks)).alias("block")
    grouped = pairs.groupBy("ring", block).agg(
        F.collect_list(F.struct("query_id", "query_key", "vec", "bar")).alias("queries")
    )
    work = grouped.join(rings.select("ring", "ids", "vecs"), "ring").select("queries", "ids", "vecs")
    return work.mapInArrow(run, "query_id bigint, query_key bigint, vec_id bigint, score decimal(38,0)")


def _decimals(scores: np.ndarray) -> pa.Array:
    if scores.dtype != object:
        return pa.array(scores).cast(_SCORE)
    return pa.array([Decimal(min(max(int(s), -_MOST), _MOST)) for s in scores], _SCORE)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole inner products: by floating point where that is exact."""
    most = np.abs(q.astype(np.float64)).max(initial=0) * np.abs(x.astype(np.float64)).max(initial=0)
    if most * max(1, q.shape[1]) < 2**24:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if most * max(1, q.shape[1]) < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most * max(1, q.shape[1]) < 2**62:
        return q @ x.T
    return q.astype(object) @ x.astype(object).T


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each row, the first ones of equal scores."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    if scores.dtype == object:
        return np.array([sorted(sorted(range(n), key=lambda i: (-row[i], i))[:k]) for row in scores]).reshape(-1, k)
    bar = np.partition(scores, n - k, axis=1)[:, n - k:n - k + 1]
    above = scores > bar
    equal = scores == bar
    room = k - above.sum(axis=1, keepdims=True)
    chosen = above | (equal & (np.cumsum(equal, axis=1) <= room))
    return np.nonzero(chosen)[1].reshape(len(scores), k)


_QUERY = ["query_id", "query_key"]


def _gap() -> F.Column:
    """How far the query's distance to the pivot is outside of the annulus."""
    return F.greatest(F.lit(0.0), F.col("low") - F.col("distance"), F.col("distance") - F.col("high"))


def _reach() -> F.Column:
    """The highest score that a vector of the annulus can have. Margins cover all rounding."""
    sizes = F.col("square") + F.col("most")
    lengths = F.sqrt("square") * F.sqrt("most")
    apart = _gap() * (1 - 1e-9) - 1e-3 - 1e-9 * (F.sqrt("square") + F.sqrt("most") + F.col("distance"))
    bound = F.when(apart > 0, F.least((sizes - apart * apart) / 2, lengths)).otherwise(lengths)
    return bound + 1e-9 * sizes + 1.0


def _meet(queries: DataFrame, outline: DataFrame, spread: int) -> DataFrame:
    """Each row of ``queries`` with the annuli of its ``cell``, shared by ``spread`` tasks."""
    salted = queries.withColumn("salt", F.pmod(F.xxhash64(*_QUERY), F.lit(spread)).cast("int"))
    repeated = outline.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return salted.join(repeated, ["dim", "cell", "salt"]).drop("salt")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The rows of ``found`` with their ``rank``, up to ``k``."""
    order = Window.partitionBy(*_QUERY).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: F.Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k best of all other rows."""
    vectors = quantised(rows)
    pivots = choose_pivots(vectors, pivot_count(rows.count()))
    rings = stored(annuli(keyed(vectors, pivots)))
    queries = stored(
        keyed(vectors.filter(is_query), pivots, to_all=True)
        .withColumnRenamed("vec_id", "query_id").withColumn("query_key", F.xxhash64("vec"))
        .dropDuplicates(_QUERY)
    )
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    spread = min(SPREAD, blocks)
    outline = rings.select("ring", "dim", "cell", "low", "high", "most")
    vecs = queries.select(*_QUERY, "vec")
    own = queries.select(*_QUERY, "dim", "cell", "distance")
    near = stored(
        _meet(own, outline, spread).groupBy(*_QUERY)
        .agg(F.min_by("ring", F.struct(_gap(), "ring")).alias("done"))
    )
    nothing = F.lit(None)
    first = near.select(*_QUERY, F.col("done").alias("ring"), nothing.cast(SCORE_TYPE).alias("bar"))
    found = stored(_best(best_in(first.join(vecs, _QUERY), rings, k, blocks), k))
    state = near.withColumns({"last_reach": nothing.cast("double"), "last_ring": nothing.cast("bigint")})
    take = WAVE
    while True:
        bars = found.filter(F.col("rank") == k).select(*_QUERY, F.col("score").alias("bar"))
        active = state.join(bars, _QUERY, "left").join(queries.drop("vec", "cell", "distance"), _QUERY)
        cells = active.select("*", F.posexplode("distances").alias("cell", "distance")).drop("distances")
        behind = (F.col("reach") > F.col("last_reach")) | (
            (F.col("reach") == F.col("last_reach")) & (F.col("ring") <= F.col("last_ring"))
        )
        ahead = (
            _meet(cells, outline, spread)
            .select(*_QUERY, "done", "ring", "bar", "last_reach", "last_ring", _reach().alias("reach"))
            .filter(F.col("ring") != F.col("done"))
            .filter(F.col("bar").isNull() | (F.col("reach") >= F.col("bar").cast("double")))
            .filter(F.col("last_ring").isNull() | ~behind)
        )
        order = Window.partitionBy(*_QUERY).orderBy(F.desc("reach"), "ring")
        wave = stored(
            ahead.select(*_QUERY, "done", "ring", "bar", "reach", F.row_number().over(order).alias("n"))
            .filter(F.col("n") <= take)
        )
        longest = wave.agg(F.max("n")).first()[0]
        if longest is None:
            break
        pairs = wave.select(*_QUERY, "ring", "bar").join(vecs, _QUERY)
        found = stored(_best(found.drop("rank").union(best_in(pairs, rings, k, blocks)), k))
        if longest < take:
            break
        state = wave.filter(F.col("n") == take).select(
            *_QUERY, "done", F.col("reach").alias("last_reach"), F.col("ring").alias("last_ring")
        )
        take *= GROWTH
    return found.select("query_id", "rank", "vec_id", F.col("score").try_cast("bigint").alias("score"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, vec_id, score,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
