"""Whitening of embeddings by incremental eigendecomposition: partitions apply centred rank-one updates by secular equations with deflation; spectra are combined by further
rank-one updates, a few at a time, and refined by one distributed Rayleigh-Ritz step."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged

#: Entries c become floor(SCALE * c) + ORIGIN. Components that are returned.
SCALE, ORIGIN, COMPONENTS = 64, 1_000_000, 16
#: Rows of which one task makes rank-one updates at a time: they are reduced first to as many rows as there are dimensions, of the same scatter.
BATCH = 1024
#: Partial results that one task combines.
FAN_IN = 16
#: A component whose eigenvalue is below so small a share of the largest has no variance.
FLAT = 1e-13
_EPS = np.finfo(float).eps
_LONG = 2**63 - 1


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + z zᵀ; d ascends strictly and no z is zero.

    Each root of 1 + sum z² / (d - x) is found from the pole that is nearer, by rational interpolation of the poles at both sides, or by halving where that leaves the bracket;
    the vectors belong to the z for which the roots are exact, so they are orthogonal to rounding.
    """
    m = len(d)
    z2 = z * z
    if m == 1:
        return d + z2, np.ones((1, 1))
    i = np.arange(m)
    width = np.append(np.diff(d), z2.sum())
    right = np.zeros(m, bool)
    with np.errstate(all="ignore"):
        middle = 1 + (z2 / (d[None, :] - d[:, None] - width[:, None] / 2)).sum(1)
        right[:-1] = middle[:-1] < 0  # the root lies in the right half of its interval
        origin = i + right
        pole = d[None, :] - d[origin][:, None]
        lo = np.where(right, -width / 2, 0.0)
        hi = np.where(right, 0.0, width / 2)
        if middle[-1] < 0:
            lo[-1], hi[-1] = width[-1] / 2, width[-1]
        x = (lo + hi) / 2
        below = i[None, :] <= i[:, None]
        here, there = pole[i, i], pole[i, np.minimum(i + 1, m - 1)]
        for turn in range(100):
            gap = pole - x[:, None]
            term = z2 / gap
            f = 1 + term.sum(1)
            lo, hi = np.where(f < 0, x, lo), np.where(f > 0, x, hi)
            done = (np.abs(f) <= _EPS * m * (1 + np.abs(term).sum(1))) | (hi - lo <= 2 * _EPS * np.abs(x))
            if done.all():
                break
            slope = term / gap
            left, rest = (slope * below).sum(1), (slope * ~below).sum(1)
            p, q = here - x, there - x
            c = f - p * left - q * rest
            a = (p + q) * f - p * q * (left + rest)
            b = p * q * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = p[-1] + left[-1] * p[-1] ** 2 / (f[-1] - p[-1] * left[-1])
            new = x + step
            bad = ~((new > lo) & (new < hi)) | (turn > 30)
            x = np.where(done, x, np.where(bad, (lo + hi) / 2, new))
        gap = pole - x[:, None]  # d[j] - root[i]
        between = np.where(i[:, None] < i[None, :], d[None, :] - d[:, None], 1.0)
        between[:-1] = np.where(i[:-1, None] < i[None, :], between[:-1], d[1:, None] - d[None, :])
        own = np.sqrt(np.prod(np.abs(gap) / np.abs(between), axis=0)) * np.sign(z)
        vectors = (own[None, :] / gap).T
    return d[origin] + x, vectors / np.linalg.norm(vectors, axis=0)


def rank_one(values: np.ndarray, vectors: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum (values ascending) of vectors diag(values) vectorsᵀ + u uᵀ.

    Deflation: of eigenvalues that are equal to rounding, a reflection leaves one that u meets; those that u does not meet stay.
    """
    z = vectors.T @ u
    size = float(z @ z)
    if size == 0:
        return values, vectors
    vectors = vectors.copy()
    least = 8 * _EPS * max(values[-1], size)
    begins = np.flatnonzero(np.append(True, np.diff(values) > least))
    for s, e in zip(begins.tolist(), [*begins[1:].tolist(), len(values)], strict=True):
        norm = float(np.linalg.norm(z[s:e]))
        if e - s > 1 and norm > 0:
            v = z[s:e].copy()
            v[0] += np.copysign(norm, v[0])
            v /= np.linalg.norm(v)
            vectors[:, s:e] -= 2 * np.outer(vectors[:, s:e] @ v, v)
            z[s + 1 : e], z[s] = 0.0, -np.copysign(norm, z[s])
    met = np.flatnonzero(np.abs(z) * np.sqrt(size) > least)
    if not len(met):
        return values, vectors
    values = values.copy()
    values[met], turn = secular(values[met], z[met])
    vectors[:, met] = vectors[:, met] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, exact sums, mean and the scatter's eigenvalues and eigenvectors of the rows seen so far."""

    def __init__(self, size: int):
        self.n, self.sums, self.mean, self.values, self.vectors = 0, [0] * size, np.zeros(size), np.zeros(size), np.eye(size)

    def _shift(self, n: int, mean: np.ndarray) -> None:
        """Take in n rows about this mean, whose own scatter has been taken in."""
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, np.sqrt(self.n * n / (self.n + n)) * (mean - self.mean))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def add(self, rows: np.ndarray) -> None:
        """Rows (int64) are centred on their own mean; the rows of a triangle of the same scatter update one after the other."""
        x = rows.astype(float)
        mean = x.mean(0)
        for u in np.linalg.qr(x - mean, mode="r"):
            self.values, self.vectors = rank_one(self.values, self.vectors, u)
        self._shift(len(x), mean)
        self.sums = [a + b for a, b in zip(self.sums, exact_sums(rows), strict=True)]

    def join(self, other: Spectrum) -> None:
        """Each eigenvector of the other, by the root of its eigenvalue, is an update."""
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, np.sqrt(value) * vector)
        self._shift(other.n, other.mean)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]


def exact_sums(rows: np.ndarray) -> list[int]:
    """Sums of columns, in Python's integers where those of 64 bits could overflow."""
    most = int(np.abs(rows.astype(float)).max(initial=0)) * len(rows)
    return [int(v) for v in (rows if most < 2**62 else rows.astype(object)).sum(0)]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists of longs as rows of so many entries, less ORIGIN; a shorter list is filled up with entries of zero."""
    n = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(column), size), np.int64)
    out[np.arange(size)[None, :] < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False) - ORIGIN
    return out


def gathered(parts: DataFrame, merge: Callable[[list[dict]], dict]) -> dict | None:
    """The rows of parts (id from 0, other columns) merged, FAN_IN at a time in tasks, to the one that is returned; None if there are none."""
    most = parts.agg(F.max("id")).first()[0]
    if most is None:
        return None
    schema = parts.schema

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["id"])
        return pa.Table.from_pylist([{**merge(rows), "id": rows[0]["id"] // FAN_IN}], schema=table.schema)

    while most > 0:
        old, parts = parts, staged(parts.groupBy(F.floor(F.col("id") / FAN_IN)).applyInArrow(run, schema), "merged")
        drop_staged(old)
        most //= FAN_IN
    out = parts.first().asDict()
    drop_staged(parts)
    return out


_SPECTRUM = "id long, n long, sums array<decimal(38,0)>, mean array<double>, vals array<double>, vecs array<double>"


def _packed(s: Spectrum, at: int) -> dict:
    return {"id": at, "n": s.n, "sums": [Decimal(v) for v in s.sums], "mean": s.mean.tolist(), "vals": s.values.tolist(), "vecs": s.vectors.ravel().tolist()}


def _unpacked(row: dict) -> Spectrum:
    s = Spectrum(len(row["mean"]))
    s.n, s.sums, s.mean, s.values = row["n"], [int(v) for v in row["sums"]], np.array(row["mean"]), np.array(row["vals"])
    s.vectors = np.array(row["vecs"]).reshape(len(s.mean), len(s.mean))
    return s


def _merge_spectra(rows: list[dict]) -> dict:
    whole = _unpacked(rows[0])
    for r in rows[1:]:
        whole.join(_unpacked(r))
    return _packed(whole, 0)


def spectrum(fit: DataFrame, size: int) -> Spectrum | None:
    """Of all rows of fit (x), less ORIGIN: a spectrum for each partition, combined in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum(size)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                s.add(matrix(batch.column(0).slice(k, BATCH), size))
        if s.n:
            types = [pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), *[pa.list_(pa.float64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_packed(s, TaskContext.get().partitionId()).values(), types, strict=True)], names=["id", "n", "sums", "mean", "vals", "vecs"])

    row = gathered(staged(fit.mapInArrow(run, _SPECTRUM), "spectra"), _merge_spectra)
    return None if row is None else _unpacked(row)


def _moments(fit: DataFrame, size: int, project: Callable[[np.ndarray], np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums, and sums of outer products, of the k values that project makes of each row of fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = project(matrix(batch.column(0), size))
            first += y.sum(0)
            second += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([first.tolist()], pa.list_(pa.float64())), pa.array([second.ravel().tolist()], pa.list_(pa.float64()))], names=["id", "first", "second"])

    def merge(rows: list[dict]) -> dict:
        return {"first": np.sum([r["first"] for r in rows], 0).tolist(), "second": np.sum([r["second"] for r in rows], 0).tolist()}

    row = gathered(staged(fit.mapInArrow(run, "id long, first array<double>, second array<double>"), "moments"), merge)
    return np.array(row["first"]), np.array(row["second"]).reshape(k, k)


def differences(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: of Python's integers where those of 64 bits could overflow."""
    bound = n * int(np.abs(rows.astype(float)).max(initial=0)) + max(map(abs, sums), default=0)
    if bound < 2**62:
        return rows * n - np.array(sums, np.int64)
    return rows.astype(object) * n - np.array(sums, object)


def deviations(apart: np.ndarray) -> list[int | None]:
    """Sums of squares of each row; null beyond a long."""
    if apart.dtype != object and apart.shape[1] * float(np.abs(apart.astype(float)).max(initial=0)) ** 2 < 2**62:
        return (apart * apart).sum(1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in apart]
    return [v if v <= _LONG else None for v in exact]


def longs(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """key and x of the rows whose vector is whole: no null and none that is not finite, or too large for a long, in it."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE) + ORIGIN)
    whole = F.forall(F.col(vector), lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < 2.0**62, F.lit(False)))
    return embeddings.where(whole).select(F.col(key).cast("long").alias(key), x.alias("x"))


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each row of embeddings whose vector is whole, and component (at most the number of dimensions).

    Rows whose vector is null, or holds a null, an entry that is not finite or one beyond 2**62 / 64, are left out. Shorter vectors are filled up with zeros to the longest one's length.
    Repeated rows get equal results and stand once in the fit list, however many they are. A component without variance (all of them, where there is one distinct vector) has explained 0
    and a null whitened; it is left out of identity_error, which is null if all are. deviation is null where it exceeds a long. Other columns are not read; an empty table, and vectors of no
    entries, give an empty result. What the driver holds is a few matrices of dimensions by dimensions.
    """
    spark = embeddings.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    rows = longs(embeddings, key, vector)
    schema = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    size = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not size:
        return spark.createDataFrame([], schema)
    padded = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(ORIGIN).cast("long"), F.lit(size) - F.size("x"))))
    fit = staged(padded.select("x").distinct(), "fit")
    whole = spectrum(fit, size)
    n, sums, basis = whole.n, whole.sums, whole.vectors

    def centred(x: np.ndarray) -> np.ndarray:
        return differences(x, n, sums).astype(float) / n

    # Rayleigh-Ritz on the space of all eigenvectors found
    ritz = _moments(fit, size, lambda x: centred(x) @ basis, size)[1] / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    k = min(components, size)
    values, vectors = values[::-1][:k], (basis @ turn)[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    trace = float(np.trace(ritz))
    varied = values > max(FLAT * values[0], 0)
    explained = np.where(varied, values / trace, 0.0) if trace > 0 else np.zeros(k)
    scaled = vectors[:, varied] / np.sqrt(values[varied])
    live = int(varied.sum())
    error = None
    if live:
        first, second = _moments(fit, size, lambda x: centred(x) @ scaled, live)
        error = float(np.abs(second / n - np.outer(first / n, first / n) - np.eye(live)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            apart = differences(matrix(batch.column(1), size), n, sums)
            out = np.zeros((m, k))
            out[:, :live] = apart.astype(float) / n @ scaled  # eigenvalues fall, so those without variance come last
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviations(apart), pa.int64()).take(at),
                    pa.array(out.ravel(), mask=np.tile(np.arange(k) >= live, m)),
                    pa.array(np.tile(explained, m)),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return padded.mapInArrow(run, schema)


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on the 16 leading components, whitened."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
