"""Operator 13: embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V are found without forming V. One pass over the stored
vectors gives V Q for a thin matrix Q: every task adds up xc^T (xc Q) of its centred rows xc. A
cycle applies a Chebyshev polynomial of V to the block by its three-term recurrence, a pass per
degree; the polynomial stays small on the unwanted part of the spectrum, from zero to the smallest
Ritz value of the block, and grows fast beyond it. QR and a Rayleigh-Ritz step follow. Cycles end when the
residuals of the wanted pairs certify them; a block that does not get there raises. A last pass
measures the covariance of the whitened values.

Whole components are stored once, in blocks of bounded size, and every pass reads them from the
shared folder, so a lost executor costs a part of one pass. Sums of components are exact (whole
numbers), and so are the deviations. What reaches the driver is a d x block matrix per pass, added
up on the executors first if there are many tasks.

Vectors that are null, empty or hold null or not finite entries take no part. Vectors of different
length are fitted apart, each length on its own rows. Repeated rows count each, rows without an id
are kept. Components whose eigenvalue is zero beside the largest are left out, so that equal
vectors alone give no rows. Components x beyond 64 bits are set to the nearest 64-bit number.
A deviation beyond 64 bits is NULL in ``deviation`` and whole in ``deviation_digits``. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.llm.common import stored, table

COMPONENTS = 8
SCALE, SHIFT = 1024.0, 100_000
# Columns that travel beside the wanted ones: the more, the faster a cycle converges.
GUARDS = 24
BLOCK_BYTES = 2 << 20
# Residual of a certified pair, relative to the largest eigenvalue.
TOLERANCE = 1e-13
# What rounding may leave of a residual; a block that no longer improves is certified up to here.
ROUNDING = 1e-10
LONGEST, CYCLES = 24, 40
# Partial sums of a pass that go to the driver one by one.
DIRECT = 64

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Fit:
    """Mean, eigenvalues and eigenvectors of the vectors of one length."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole(flat: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 as 64-bit numbers, at most what they can hold."""
    scaled = np.floor(SCALE * flat.astype(np.float64))
    safe = np.abs(scaled) < 2.0**62
    found = np.where(safe, scaled, 0.0).astype(np.int64) + SHIFT
    if not safe.all():
        edge = [min(max(int(v) + SHIFT, _LOW), _HIGH) for v in scaled[~safe].tolist()]
        found[~safe] = edge
    return found


def blocks(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(dim, n, ids, x): usable vectors in blocks of at most ``BLOCK_BYTES``.

    ``x`` holds little-endian 64-bit numbers, row after row.
    """

    def close(dim: int, ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        joined = pa.concat_arrays(ids)
        offsets = pa.array([0, len(joined)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([len(joined)], pa.int32()),
             pa.ListArray.from_arrays(offsets, joined),
             pa.array([b"".join(p.tobytes() for p in parts)], pa.binary())],
            names=["dim", "n", "ids", "x"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole components that wait, by length, and their bytes.
        held: dict[int, tuple[list[pa.Array], list[np.ndarray]]] = {}
        size: dict[int, int] = {}
        for batch in batches:
            lists = batch.column("v")
            flat = lists.values.to_numpy(zero_copy_only=False)  # null entries become NaN
            at = lists.offsets.to_numpy()
            lengths = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(at))
            for dim in np.unique(lengths[lengths > 0]).tolist():
                own = np.flatnonzero(lengths == dim)
                step = max(1, BLOCK_BYTES // (8 * dim))
                for low in range(0, len(own), step):
                    some = own[low:low + step]
                    values = flat[at[some][:, None] + np.arange(dim)]
                    usable = np.isfinite(values).all(axis=1)
                    ids, parts = held.setdefault(dim, ([], []))
                    ids.append(batch.column("id").take(pa.array(some[usable])))
                    parts.append(whole(values[usable]))
                    size[dim] = size.get(dim, 0) + parts[-1].nbytes
                    full = [dim] if size[dim] >= BLOCK_BYTES else []
                    for d in (list(held) if sum(size.values()) >= 8 * BLOCK_BYTES else full):
                        if size.pop(d):
                            yield close(d, *held[d])
                        del held[d]
        for dim in held:
            if size[dim]:
                yield close(dim, *held[dim])

    element = rows.schema[vector].dataType.elementType.simpleString()
    values = F.col(vector) if element == "float" else F.col(vector).cast("array<double>")
    usable = rows.select(F.col(id_column).cast("bigint").alias("id"), values.alias("v")).filter("v IS NOT NULL")
    return usable.mapInArrow(run, "dim int, n int, ids array<bigint>, x binary")


def _blocks_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The whole components of every block."""
    for dim, data in zip(batch.column("dim").to_pylist(), batch.column("x")):
        yield np.frombuffer(data.as_buffer(), "<i8").reshape(-1, dim)


def column_sums(stored_blocks: DataFrame) -> tuple[int, list[int]]:
    """(n, exact sum of every component) of blocks of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for batch in batches:
            for x in _blocks_of(batch):
                # 32-bit halves cannot overflow in a block.
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                own = [(a << 32) + b for a, b in zip(high, low)]
                total = own if total is None else [a + b for a, b in zip(total, own)]
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(map(str, total), pa.string())],
                names=["place", "total"],
            )

    n = stored_blocks.agg(F.sum("n")).first()[0]
    found = stored_blocks.select("dim", "x").mapInArrow(run, "place int, total string")
    sums = found.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    return n, [int(r.total) for r in sorted(sums, key=lambda r: r.place)]


def pass_over(
    stored_blocks: DataFrame, mean: np.ndarray, product: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """The sum over all blocks of ``product`` of the block's centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for x in _blocks_of(batch):
                total = total + product(x - mean)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def merge(_: tuple, group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(part.as_buffer()) for part in group.column("part")]
        return pa.table({"part": pa.array([functools.reduce(np.add, parts).tobytes()], pa.binary())})

    source = stored_blocks.select("dim", "x")
    found = source.mapInArrow(run, "part binary")
    if source.rdd.getNumPartitions() > DIRECT:
        spread = F.pmod(F.xxhash64("part"), F.lit(DIRECT))
        found = found.select("part", spread.alias("spread")).groupBy("spread").applyInArrow(merge, "part binary")
    # Sorted, so that the order in which tasks end does not change the sum.
    return functools.reduce(np.add, [np.frombuffer(r.part) for r in sorted(found.collect())])


def covariance_times(stored_blocks: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """V Q by one pass."""
    return pass_over(stored_blocks, mean, lambda xc: xc.T @ (xc @ q)).reshape(q.shape) / n


def chebyshev(
    times: Callable[[np.ndarray], np.ndarray], first: np.ndarray, q: np.ndarray, degree: int,
    bound: float, top: float,
) -> np.ndarray:
    """T_degree of V, mapped so that 0 to ``bound`` lies within [-1, 1], applied to ``q``.

    ``first`` is V q. Scaled by its value at ``top``, so that nothing overflows.
    """
    half = bound / 2
    scale = half / (top - half)
    ratio = scale
    before, now = q, (first - half * q) * (ratio / half)
    for _ in range(2, degree + 1):
        following = 1 / (2 / scale - ratio)
        before, now = now, (times(now) - half * now) * (2 * following / half) - before * (ratio * following)
        ratio = following
    return now


def leading(
    times: Callable[[np.ndarray], np.ndarray], dim: int, trace: float, wanted: int = COMPONENTS,
    guards: int = GUARDS,
) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of V and their vectors; ``times`` gives V Q. Raises if not certified."""
    size = min(dim, wanted + guards)
    wanted = min(wanted, dim)
    if trace <= 0:
        return np.zeros(0), np.zeros((dim, 0))
    q = np.eye(dim) if size == dim else np.linalg.qr(np.random.default_rng(13).normal(size=(dim, size)))[0]
    best = np.inf
    for _ in range(CYCLES):
        image = times(q)
        inner = q.T @ image
        ritz, turn = np.linalg.eigh((inner + inner.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residual = np.linalg.norm(image - q * ritz, axis=0)[:wanted].max() / max(ritz[0], 1e-300)
        if residual <= TOLERANCE or (residual <= ROUNDING and residual > best / 2):
            real = ritz[:wanted] > 1e-12 * trace
            return ritz[:wanted][real], q[:, :wanted][:, real]
        best = min(best, residual)
        bound, top = max(ritz[-1], 1e-12 * ritz[0]), ritz[0]
        # Growth of a degree at the smallest wanted value, from which the degree follows.
        away = max(2 * ritz[wanted - 1] / bound - 1, 1 + 1e-9)
        growth = math.log(away + math.sqrt(away * away - 1))
        degree = min(LONGEST, max(2, math.ceil(math.log(4 * residual / TOLERANCE) / growth)))
        q, _ = np.linalg.qr(chebyshev(times, image, q, degree, bound, top))
    raise RuntimeError(f"The block did not converge: residual {residual:.1e}")


def fit(stored_blocks: DataFrame, dim: int) -> Fit:
    """The fit of all vectors in the blocks, which have one length."""
    n, sums = column_sums(stored_blocks)
    mean = np.array([s / n for s in sums])
    trace = float(pass_over(stored_blocks, mean, lambda xc: np.array([(xc * xc).sum()]))[0] / n)
    values, vectors = leading(
        functools.partial(covariance_times, stored_blocks, mean, n), dim, trace
    )
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[largest, np.arange(len(values))])
    return Fit(n, tuple(sums), values, vectors, trace)


def identity_error(stored_blocks: DataFrame, found: Fit) -> float:
    """Largest entry of the whitened values' covariance minus the identity, by one pass."""
    k, mean = len(found.values), found.mean
    turn = found.vectors / np.sqrt(found.values)

    def product(xc: np.ndarray) -> np.ndarray:
        w = xc @ turn
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    total = pass_over(stored_blocks, mean, product) / found.n
    centre = total[k * k:]
    covariance = total[:k * k].reshape(k, k) - np.outer(centre, centre)
    return float(np.abs(covariance - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """The exact sum over the components of (n x - S)^2 of every row."""
    low = [-(-s // n) for s in sums]  # so that x - low is small
    rest = [n * a - s for a, s in zip(low, sums)]
    exact = max(map(abs, low), default=0) < 1 << 61 and (np.abs(x.astype(np.float64)).max(initial=0) < 2.0**61)
    if exact:
        apart = x - np.array(low, np.int64)
        most = int(np.abs(apart).max(initial=0))
        if (n * most + n) ** 2 * max(1, x.shape[1]) < 1 << 63:
            scaled = apart * n + np.array(rest, np.int64)
            return (scaled * scaled).sum(axis=1).tolist()
        if most**2 * max(1, x.shape[1]) < 1 << 62 and most * n * max(1, x.shape[1]) < 1 << 62:
            # (n a + r)^2 = n^2 a^2 + 2 n a r + r^2, summed over the row
            squares, mixed = (apart * apart).sum(axis=1), apart @ np.array(rest, np.int64)
            constant = sum(r * r for r in rest)
            return [n * n * s + 2 * n * m + constant for s, m in zip(squares.tolist(), mixed.tolist())]
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]


def projected(stored_blocks: DataFrame, found: Fit, error: float) -> DataFrame:
    """The rows of the result for the vectors of one length."""
    turn = found.vectors / np.sqrt(found.values)
    k, mean = len(found.values), found.mean
    explained = (found.values / found.trace).tolist()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, ids in zip(_blocks_of(batch), batch.column("ids")):
                for low in range(0, len(x), 4096):
                    some, own = x[low:low + 4096], ids.values.slice(low, 4096)
                    rows = len(some)
                    apart = deviations(some, found.n, found.sums)
                    short = [d if d <= _HIGH else None for d in apart]
                    each = np.repeat(np.arange(rows), k)
                    yield pa.RecordBatch.from_arrays(
                        [own.take(pa.array(each)),
                         pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                         pa.array(np.full(rows * k, found.n)),
                         pa.array(short, pa.int64()).take(pa.array(each)),
                         pa.array(((some - mean) @ turn).ravel()),
                         pa.array(explained * rows, pa.float64()),
                         pa.array(np.full(rows * k, error)),
                         pa.array(map(str, apart), pa.string()).take(pa.array(each))],
                        names=names,
                    )

    return stored_blocks.select("dim", "ids", "x").mapInArrow(
        run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double,"
             " identity_error double, deviation_digits string"
    )


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits)."""
    made = stored(blocks(rows, id_column, vector))
    result = None
    for (dim,) in sorted(made.select("dim").distinct().collect()):
        own = made.filter(F.col("dim") == dim)
        found = fit(own, dim)
        if not len(found.values):
            continue
        part = projected(own, found, identity_error(own, found))
        result = part if result is None else result.unionByName(part)
    if result is None:
        nothing = Fit(1, (), np.zeros(0), np.zeros((0, 0)), 1.0)
        result = projected(made.limit(0), nothing, 0.0)
    return result.withColumnRenamed("vec_id", id_column)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
