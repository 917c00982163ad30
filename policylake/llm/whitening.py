"""Whitening of vectors by an incremental eigendecomposition.

Every entry c becomes the integer x = floor(64 c) + 1000000. A task keeps the count, mean and spectrum
(eigenvalues, eigenvectors) of the scatter of its rows. A block of centred rows is first turned by an
orthogonal step (QR) into at most d rows of the same scatter; each of these, and the difference of the
two means, is a rank-one update of the spectrum: eigenpairs that the update leaves alone or that are
equal are deflated, the others come from the roots of the secular equation. Two spectra are combined
the same way, every eigenvector of the second times the root of its eigenvalue being one update;
tasks' spectra meet in a tree of small groups. Last comes one Rayleigh-Ritz step over all rows: the
covariance is projected on the basis found, part by part, and the small matrix diagonalised, so
components are eigenvectors to double precision. Sums, deviations and counts are exact integers.

Rows whose vector is null or holds null or non-finite entries go. Shorter vectors count as ended by
zeros; an empty one is all zeros. |x - 1000000| is at most 2^53 (|c| < 2^47), entries beyond count as that.
Components with an eigenvalue of at most 1e-11 of the largest are constant to double precision and
have no whitened value: there are as many components as the rest, `components` at most, and none for
one row or equal rows. Of equal eigenvalues any basis of their space is given. Repeated rows count as
often as they come. An empty table gives no rows.

The driver holds one d x d matrix, a task one block of rows and a few such matrices; `MOST_DIMENSIONS`
bounds d, longer vectors are refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm.staging import small_batches, staged

SCALE, SHIFT = 64.0, 1_000_000
MOST_DIMENSIONS = 4096
_EPS = np.finfo(float).eps
_FAR = float(1 << 53)


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2_j / (d_j - x) for ascending distinct d, and the matrix d_j - root_i.

    One root lies right of each d_i, below the next. Each is kept as a distance from its nearer pole, so the
    differences are exact to rounding. A step fits the poles left and right of the root by one each
    and falls back to halving the bracket, until the sum is zero to rounding.
    """
    n = len(d)
    gap = np.append(np.diff(d), z2.sum())
    left = np.arange(n)
    middle = (d - d[:, None]) - gap[:, None] / 2
    value = 1 + (z2 / middle).sum(axis=1)
    near = np.where((value >= 0) | (left == n - 1), left, np.minimum(left + 1, n - 1))
    apart = d - d[near][:, None]
    from_left = near == left
    low = np.where(from_left, 0.0, -gap / 2)
    high = np.where(from_left, np.where(left == n - 1, gap, gap / 2), 0.0)
    at = (low + high) / 2
    below = np.tri(n, dtype=bool)
    to_left, to_right = -np.where(from_left, 0.0, gap), np.where(from_left, gap, 0.0)
    for _ in range(80):
        delta = apart - at[:, None]
        term = z2 / delta
        slope = term / delta
        f = 1 + term.sum(axis=1)
        unsettled = np.abs(f) > 4 * _EPS * (1 + np.abs(term).sum(axis=1))
        if not unsettled.any():
            break
        low, high = np.where(f < 0, at, low), np.where(f < 0, high, at)
        a, b = to_left - at, to_right - at
        psi, dpsi = np.where(below, term, 0).sum(axis=1), np.where(below, slope, 0).sum(axis=1)
        phi, dphi = f - 1 - psi, slope.sum(axis=1) - dpsi
        with np.errstate(all="ignore"):
            q, s = dpsi * a * a, dphi * b * b
            c = 1 + psi - dpsi * a + phi - dphi * b
            m, e = c * (a + b) + q + s, a * b * f
            root = np.sqrt(np.maximum(m * m - 4 * c * e, 0))
            step = np.where(m > 0, 2 * e / (m + root), (m - root) / (2 * c))
            step = np.where(left == n - 1, a + q / (1 + psi - dpsi * a), step)
            to = at + step
        to = np.where(np.isfinite(to) & (to > low) & (to < high), to, (low + high) / 2)
        at = np.where(unsettled, to, at)
    delta = apart - at[:, None]
    return d[near] + at, delta


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors (columns) of the matrix plus v v^T."""
    z = vectors.T @ v
    size = max(float(np.abs(values).max(initial=0.0)), float(z @ z))
    if size == 0.0:
        return values, vectors
    tol = 8 * _EPS * size
    vectors = vectors.copy()
    first = 0
    for end in range(1, len(values) + 1):  # equal eigenvalues: reflect all weight into the first
        if end < len(values) and values[end] - values[first] <= tol:
            continue
        if end - first > 1 and (w := z[first:end].copy()).any():
            norm = float(np.linalg.norm(w))
            w[0] += np.copysign(norm, w[0])
            vectors[:, first:end] -= np.outer(vectors[:, first:end] @ w, 2 * w / (w @ w))
            z[first:end] = 0.0
            z[first] = -np.copysign(norm, w[0])
        first = end
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > tol)
    if not len(live):
        return values, vectors
    d, out = values[live], values.copy()
    roots, delta = secular_roots(d, z[live] ** 2)
    pole = d[:, None] - d
    np.fill_diagonal(pole, -1.0)
    weight = np.copysign(np.sqrt(np.abs(np.prod(delta / pole, axis=0))), z[live])  # those for which these roots are exact
    basis = weight / delta
    basis /= np.linalg.norm(basis, axis=1)[:, None]
    out[live] = roots
    vectors[:, live] = vectors[:, live] @ basis.T
    order = np.argsort(out, kind="stable")
    return out[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, exact sums, mean and eigenpairs of the scatter about the mean."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def none(cls, d: int) -> Spectrum:
        return cls(0, [0] * d, np.zeros(d), np.zeros(d), np.eye(d))

    def take(self, n: int, sums: list[int], mean: np.ndarray, rows: np.ndarray) -> None:
        """Add `n` vectors of that mean whose scatter is the sum of rows^T rows."""
        if len(rows) > len(mean):
            rows = np.linalg.qr(rows, mode="r")
        values, vectors = self.values, self.vectors
        for row in rows:
            values, vectors = rank_one(values, vectors, row)
        if self.n:
            values, vectors = rank_one(values, vectors, (mean - self.mean) * np.sqrt(self.n * n / (self.n + n)))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n
        self.sums = [a + b for a, b in zip(self.sums, sums, strict=True)]
        self.values, self.vectors = np.maximum(values, 0.0), vectors

    def add(self, other: Spectrum) -> None:
        held = other.values > 0
        self.take(other.n, other.sums, other.mean, (other.vectors[:, held] * np.sqrt(other.values[held])).T)

    def packed(self) -> tuple[str, bytes]:
        return json.dumps([self.n, self.sums]), np.concatenate([self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def unpacked(cls, head: str, body: bytes) -> Spectrum:
        (n, sums), flat = json.loads(head), np.frombuffer(body)
        d = len(sums)
        return cls(n, sums, flat[:d], flat[d : 2 * d], flat[2 * d :].reshape(d, d))


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows kept, and floor(64 c) of their entries as doubles that are whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = column.flatten()
    entry = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(size)), size)
    kept = ~pc.is_null(column).to_numpy(zero_copy_only=False)
    kept[of[~np.isfinite(entry)]] = False
    with np.errstate(all="ignore"):
        scaled = np.clip(np.floor(entry * SCALE), -_FAR, _FAR)
    if len(size) and (size == d).all():
        return np.flatnonzero(kept), scaled.reshape(len(size), d)[kept]
    wide = np.zeros((len(size), d))
    fine = kept[of]
    wide[of[fine], (np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size))[fine]] = scaled[fine]
    return np.flatnonzero(kept), wide[kept]


def _exact_sums(x: np.ndarray) -> list[int]:
    """Sums by column of whole numbers, with the shift, whatever their size."""
    whole = x.astype(np.int64)
    if np.abs(x).max(initial=0.0) * len(x) >= 1 << 62:
        whole = whole.astype(object)
    return [int(s) + SHIFT * len(x) for s in whole.sum(axis=0)]


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """Rows of a task in blocks of some 2 million numbers."""
    most, held, n = max(256, (1 << 21) // max(d, 1)), [], 0
    for batch in batches:
        _, x = matrix(batch.column("v"), d)
        held.append(x)
        n += len(x)
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


PART = "part long, head string, body binary"


def _one(parts: DataFrame, name: str, joined: Callable[[list[tuple[str, bytes]]], tuple[str, bytes]], fan: int) -> tuple[str, bytes] | None:
    """Parts joined in groups of `fan`, level by level, until one is left."""
    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        head, body = joined(list(zip(pdf["head"], pdf["body"], strict=True)))
        return pd.DataFrame({"part": [int(key[0])], "head": [head], "body": [body]})

    parts = staged(parts, name)
    while parts.limit(2).count() > 1:
        parts = staged(parts.groupBy(F.floor(F.col("part") / fan).cast("long").alias("part")).applyInPandas(merge, PART), name)
    row = parts.first()
    return (row["head"], bytes(row["body"])) if row else None


@dataclass
class Whitening:
    """Fitted model: counts, sums, components (columns, by falling eigenvalue) and checks."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float


def _vectors(rows: DataFrame, column: str, key: str | None = None) -> DataFrame:
    vector = F.col(column).cast("array<double>").alias("v")
    return rows.select(vector) if key is None else rows.select(F.col(key).alias("k"), vector)


def _summed(parts: list[tuple[str, bytes]]) -> tuple[str, bytes]:
    return "", np.sum([np.frombuffer(b) for _, b in parts], axis=0).tobytes()


def _projected(slim: DataFrame, d: int, mean: np.ndarray, basis: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of y and of y y^T over all rows, y the centred row in the basis."""
    m = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m + m * m)
        for x in _blocks(batches, d):
            y = (x - mean) @ basis
            total[:m] += y.sum(axis=0)
            total[m:] += (y.T @ y).ravel()
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([""]), pa.array([total.tobytes()], pa.binary())], ["part", "head", "body"])

    found = _one(slim.mapInArrow(run, PART), "projected", _summed, fan)
    flat = np.frombuffer(found[1]) if found else np.zeros(m + m * m)
    return flat[:m], flat[m:].reshape(m, m)


def fitted(rows: DataFrame, column: str = "embedding", components: int = 32) -> Whitening | None:
    """The whitening of all rows kept; None if there are none."""
    small_batches(rows.sparkSession)
    slim = _vectors(rows, column)
    d = slim.agg(F.max(F.size("v"))).first()[0]
    if d is None:
        return None
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries: at most {MOST_DIMENSIONS}")
    d = max(d, 0)
    fan = int(np.clip((64 << 20) // (8 * d * d + 1), 2, 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Spectrum.none(d)
        for x in _blocks(batches, d):
            mean = x.mean(axis=0)
            here.take(len(x), _exact_sums(x), mean, x - mean)
        if here.n:
            head, body = here.packed()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([head]), pa.array([body], pa.binary())], ["part", "head", "body"])

    def joined(parts: list[tuple[str, bytes]]) -> tuple[str, bytes]:
        whole = Spectrum.unpacked(*parts[0])
        for p in parts[1:]:
            whole.add(Spectrum.unpacked(*p))
        return whole.packed()

    found = _one(slim.mapInArrow(run, PART), "spectra", joined, fan)
    if found is None:
        return None
    first = Spectrum.unpacked(*found)
    n = first.n
    mean = np.array([(s - SHIFT * n) / n for s in first.sums])
    _, ritz = _projected(slim, d, mean, first.vectors, fan)
    values, turn = np.linalg.eigh(ritz / n)
    values, basis = values[::-1], (first.vectors @ turn)[:, ::-1]
    held = int(np.sum(values > 1e-11 * max(values[0], 0.0))) if d else 0
    k = min(held, components)
    values, basis, trace = values[:k], basis[:, :k], float(np.trace(ritz) / n)
    error = 0.0
    if k:
        total, square = _projected(slim, d, mean, basis / np.sqrt(values), fan)
        error = float(np.abs(square / n - np.outer(total / n, total / n) - np.eye(k)).max())
    return Whitening(n, first.sums, mean, values, basis, values / trace if k else values, error)


def _deviation(x: np.ndarray, model: Whitening) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exact; null where 38 digits do not hold it."""
    sums = [s - SHIFT * model.n for s in model.sums]
    most = max([model.n * (int(np.abs(x).max(initial=0.0)) + 1), *map(abs, sums), 1])
    whole = x.astype(np.int64)
    if 4 * most * most * max(len(sums), 1) < 1 << 63:
        return pa.array(((whole * model.n - np.array(sums, np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    t = whole.astype(object) * model.n - np.array(sums, object)
    total = (t * t).sum(axis=1).tolist()
    return pa.array([str(s) if abs(s) < 10**38 else None for s in total], pa.string()).cast(pa.decimal128(38, 0))


def whitened(rows: DataFrame, model: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row for each row kept: its key, `deviation` decimal(38,0), `whitened` values by component."""
    from pyspark.sql.pandas.types import to_arrow_type

    slim = _vectors(rows, column, key)
    kind = slim.schema["k"].dataType
    schema = f"`{key}` {kind.simpleString()}, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    d, basis, arrow = len(model.sums), model.components / np.sqrt(model.values), to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = matrix(batch.column("v"), d)
            y = (x - model.mean) @ basis
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(at)).cast(arrow), _deviation(x, model), values], [key, "deviation", "whitened"])

    return slim.mapInArrow(run, schema)
