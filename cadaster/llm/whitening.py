"""Operator 11: embedding whitening by an incremental eigendecomposition.

Vectors become whole numbers; each distinct vector is fitted once.

1. Each partition keeps count, exact sums, mean, and the eigenvalues and eigenvectors of its scatter about
   the mean. A vector is a centred rank-one update: in the basis of eigenvectors the scatter is a diagonal plus
   rho z z', whose eigenvalues are the roots of a secular equation, one between each two old ones. Components of
   z that are zero to rounding, and of equal eigenvalues all but one (by a rotation), are deflated:
   there nothing changes. Roots are sought relative to the nearer old eigenvalue, and z is computed anew from them, so
   that eigenvectors are orthogonal to rounding.
2. Spectra are combined in a tree, FAN at a time: each eigenpair of the one is a rank-one update of the other,
   and so is the difference of the means. A spectrum is d x d numbers, whatever the number of vectors.
3. Rayleigh-Ritz: one pass over all vectors takes the covariance in the basis found, centred exactly before
   multiplying, and the eigenvectors of that d x d matrix turn the basis to the covariance's own, to double precision.

d, the vectors' length, is small (hundreds); d x d matrices are all that the driver sees.

Edge cases: rows whose vector is null, or holds null, non-finite or (beyond what exact arithmetic holds) entries of 2^33 or
more, are dropped, and so are those of another length than most have (of equally many the longer). Equal vectors
are fitted once, and each of their rows is whitened. A component without variance (a dimension that the others determine, or
fewer vectors than dimensions) whitens to null and is left out of identity_error; where nothing varies, explained and identity_error
are null. Equal eigenvalues come in any order, the same for all rows. A deviation that a long cannot hold is null. Columns
other than the id and the vector are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaster.llm.shared import forget, saved

COMPONENTS = 16
#: Spectra that one task combines.
FAN = 8
#: Entries of this size or more are taken as no numbers.
MOST = 1 << 33
EPS = float(np.finfo(float).eps)
ROUNDS = 60


# --- one symmetric matrix ---------------------------------------------------------------------------


@dataclass
class Spectrum:
    """Count, exact sums, mean, and ascending eigenvalues with the eigenvectors (columns) of the scatter about the mean."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, [0] * d, np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, x: np.ndarray) -> None:
        """One more vector; its exact sum is the caller's."""
        step = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, step, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + step / self.n

    def combine(self, other: Spectrum) -> None:
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        n, step = self.n + other.n, other.mean - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, step, self.n * other.n / n)
        self.mean = self.mean + step * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors of vectors diag(values) vectors' + rho v v', rho > 0."""
    z = v @ vectors
    size = float(np.sqrt(z @ z))
    if not size or not rho:
        return values, vectors
    z, rho = z / size, rho * size * size
    tolerance = 8 * EPS * max(abs(float(values[-1])), rho)
    if rho <= tolerance:
        return values, vectors
    live = np.flatnonzero(rho * np.abs(z) > tolerance)
    if len(live) > 1:
        a, b = live[:-1], live[1:]
        if (np.abs((values[b] - values[a]) * z[a] * z[b]) <= tolerance * (z[a] ** 2 + z[b] ** 2)).any():
            values, vectors, z, live = _rotated(values, vectors, z, live, tolerance)
    if not len(live):
        return values, vectors
    roots, turn = _secular(values[live], z[live], rho)
    values, vectors = values.copy(), vectors.copy()
    vectors[:, live] = vectors[:, live] @ turn
    values[live] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def _rotated(values, vectors, z, live, tolerance):
    """Deflates all but one of neighbours with equal eigenvalues: rotations that put their share of z into the last."""
    values, vectors, z, kept = values.copy(), vectors.copy(), z.copy(), []
    last = live[0]
    for i in live[1:]:
        r = np.hypot(z[last], z[i])
        c, s = z[i] / r, z[last] / r
        if abs((values[i] - values[last]) * c * s) <= tolerance:
            z[last], z[i] = 0.0, r
            vectors[:, last], vectors[:, i] = c * vectors[:, last] - s * vectors[:, i], s * vectors[:, last] + c * vectors[:, i]
            values[last], values[i] = values[last] * c * c + values[i] * s * s, values[last] * s * s + values[i] * c * c
        else:
            kept.append(last)
        last = i
    return values, vectors, z, np.array([*kept, last])


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + rho z z', d strictly ascending, no z zero."""
    k = len(d)
    if k == 1:
        return d + rho * z * z, np.ones((1, 1))
    square = rho * z * z
    gaps = np.append(np.diff(d), square.sum())
    at = np.arange(k)
    middle = 1 + (square[:, None] / (d[:, None] - (d + gaps / 2))).sum(axis=0)
    nearer = (middle < 0) & (at < k - 1)
    base = at + nearer
    # old eigenvalues relative to each root's origin, and the root's bounds
    delta = d[:, None] - d[base]
    low, high = np.where(nearer, -gaps / 2, 0.0), np.where(nearer, 0.0, np.where(at < k - 1, gaps / 2, gaps))
    left, right = delta[at, at], np.append(delta[at[1:], at[:-1]], np.inf)
    below = at[:, None] <= at
    inner = at < k - 1
    tau, done = (low + high) / 2, np.zeros(k, dtype=bool)
    with np.errstate(all="ignore"):
        for _ in range(ROUNDS):
            away = delta - tau
            terms = square[:, None] / away
            slopes = terms / away
            psi, phi = np.where(below, terms, 0).sum(axis=0), np.where(below, 0, terms).sum(axis=0)
            f = 1 + psi + phi
            low, high = np.where(f < 0, tau, low), np.where(f > 0, tau, high)
            done |= np.abs(f) <= 4 * EPS * k * (1 + phi - psi)
            if done.all():
                break
            # each half is taken as a constant and its nearest pole, of the same value and slope
            slope = np.where(below, slopes, 0).sum(axis=0)
            x, y = left - tau, np.where(inner, right - tau, 1.0)
            b, e = slope * x * x, np.where(inner, slopes.sum(axis=0) - slope, 0.0) * y * y
            g = 1 + psi - slope * x + phi - np.where(inner, e / y, 0.0)
            r = np.where(inner, right, 0.0)
            p, q = g * (left + r) + b + e, g * left * r + b * r + e * left
            root = np.sqrt(np.maximum(p * p - 4 * g * q, 0))
            far = p + np.where(p >= 0, root, -root)
            one, two = 2 * q / far, far / (2 * g)
            step = np.where(inner, np.where((one >= low) & (one <= high), one, two), left + b / g)
            step = np.where((step >= low) & (step <= high), step, (low + high) / 2)
            done |= step == tau
            tau = np.where(done, tau, step)
    away = delta - tau
    # z that has these roots exactly, so that the vectors below are orthogonal
    below_row = at[None, :] < at[:, None]
    apart = np.where(below_row, d[None, :] - d[:, None], np.append(d[1:], 0)[None, :] - d[:, None])
    apart[:, -1] = -1.0
    new = np.sqrt(np.abs(np.prod(-away / np.where(apart == 0, 1.0, apart), axis=1)))
    turn = np.copysign(new, z)[:, None] / away
    return d[base] + tau, turn / np.sqrt((turn * turn).sum(axis=0))


# --- over partitions ---------------------------------------------------------------------------------


def _matrix(batch, column: int, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _partials(rows: DataFrame, d: int, start: Callable, take: Callable, give: Callable) -> DataFrame:
    """no, state: what each partition makes of its vectors: take(state, matrix of longs) for each batch, give(state) as numbers."""
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        state, some = start(), False
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                state, some = take(state, _matrix(b.slice(at, 4096), 0, d)), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([give(state)], pa.binary())], names=["no", "state"])

    return rows.select("x").mapInArrow(run, "no long, state binary")


def _combined(partials: DataFrame, join: Callable, name: str) -> bytes | None:
    """The state that a tree of tasks makes of the partitions'."""
    import pandas as pd

    partials = saved(partials, name)
    most = partials.agg(F.max("no")).first()[0]
    if most is None:
        forget(partials)
        return None
    tree = partials

    def run(key, part):
        part = part.sort_values("no")
        state = part["state"].iloc[0]
        for other in part["state"].iloc[1:]:
            state = join(state, other)
        return pd.DataFrame({"no": [key[0]], "state": [state]})

    while most:
        tree, most = tree.groupBy(F.floor(F.col("no") / FAN).alias("up")).applyInPandas(run, "no long, state binary"), most // FAN
    state = bytes(tree.first()["state"])
    forget(partials)
    return state


def _pack(s: Spectrum) -> bytes:
    import pickle

    return pickle.dumps((s.n, s.sums, s.mean, s.values, s.vectors))


def _unpack(raw: bytes) -> Spectrum:
    import pickle

    return Spectrum(*pickle.loads(raw))


def spectrum(fit: DataFrame, d: int) -> Spectrum | None:
    """Count, exact sums and spectrum of all vectors of fit."""

    def take(s: Spectrum, rows: np.ndarray) -> Spectrum:
        # sums of 4096 entries below 2^40 are exact
        s.sums = [a + b for a, b in zip(s.sums, rows.sum(axis=0).tolist(), strict=True)]
        for x in rows.astype(float):
            s.add(x)
        return s

    def join(a: bytes, b: bytes) -> bytes:
        s = _unpack(a)
        s.combine(_unpack(b))
        return _pack(s)

    found = _combined(_partials(fit, d, lambda: Spectrum.empty(d), take, _pack), join, "spectra")
    return None if found is None else _unpack(found)


def away(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n times the rows less the sums, exact: longs, or Python numbers where those could overflow."""
    most = n * int(np.abs(rows).max(initial=0)) + max(abs(s) for s in sums.tolist())
    if most < 1 << 63:
        return rows * n - sums.astype(np.int64)
    return rows.astype(object) * n - sums


def centred(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows less the mean."""
    return (away(rows, n, sums) / n).astype(float)


def _gram(fit: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], width: int, name: str) -> np.ndarray:
    """Sums over fit of the rows that `of` makes, with a one appended, times themselves."""

    def take(total, rows):
        y = np.append(of(rows), np.ones((len(rows), 1)), axis=1)
        return total + y.T @ y

    def join(a, b):
        return (np.frombuffer(a) + np.frombuffer(b)).tobytes()

    raw = _combined(_partials(fit, d, lambda: np.zeros((width + 1, width + 1)), take, lambda t: t.tobytes()), join, name)
    return np.frombuffer(raw).reshape(width + 1, width + 1)


@dataclass
class Whitening:
    """n and sums of the fit list, eigenvectors (columns) and eigenvalues by falling eigenvalue, trace, identity_error."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Whitened rows; without variance nan."""
        with np.errstate(all="ignore"):
            return centred(rows, self.n, self.sums) @ self.vectors / np.sqrt(np.where(self.values > 0, self.values, np.nan))


def whole(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry, a long; null where the vector takes no part."""
    good = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < MOST))
    return F.when(good, F.transform(vector, lambda c: F.floor(F.lit(64.0) * c.cast("double")) + F.lit(1_000_000)))


def usable(rows: DataFrame, id_: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, x of rows that take part, the length of x)"""
    some = rows.select(F.col(id_).alias("vec_id"), whole(F.col(vector)).alias("x")).where("x is not null")
    lengths = some.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths[0] if lengths else 0
    return some.where(F.size("x") == d), d


def fit(x: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """x: a column of whole vectors of length d; None without any, or without a dimension."""
    if not d:
        return None
    once = saved(x.select("x").distinct(), "vectors")
    s = spectrum(once, d)
    if s is None:
        forget(once)
        return None
    sums, n, m = np.array(s.sums, dtype=object), s.n, min(components, d)
    basis = np.linalg.qr(s.vectors)[0]
    inside = _gram(once, d, lambda rows: centred(rows, n, sums) @ basis, d, "ritz")[:d, :d] / n
    values, turn = np.linalg.eigh((inside + inside.T) / 2)
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    values = np.where(values > d * EPS * max(values[0], 0), values, 0.0)
    out = Whitening(n, sums, vectors[:, :m], values[:m], float(np.trace(inside)), None)
    real = np.flatnonzero(out.values > 0)
    if len(real):
        total = _gram(once, d, lambda rows: out.project(rows)[:, real], len(real), "identity")
        mean = total[-1, :-1] / n
        out.identity_error = float(np.abs(total[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(real))).max())
    forget(once)
    return out


def deviations(rows: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - sums)^2; None where a long cannot hold one."""
    off = away(rows, n, sums)
    if rows.shape[1] * int(np.abs(off).max(initial=0)) ** 2 >= 1 << 63:
        off = off.astype(object)
    return [t if t < 1 << 63 else None for t in (off * off).sum(axis=1).tolist()]


def whiten(rows: DataFrame, model: Whitening | None, d: int) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row and component.

    rows: vec_id and x as usable() gives them.
    """
    import pyarrow as pa

    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    m = len(model.values)
    explained = [v / model.trace for v in model.values.tolist()] if model.trace > 0 else [None] * m

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x, k = _matrix(part, 1, d), part.num_rows
                w = model.project(x)
                each = np.repeat(np.arange(k), m)
                columns = [
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, model.n)), pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(each)),
                    pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel())), pa.array(explained * k, pa.float64()), pa.array([model.identity_error] * (k * m), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def whitened(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    x, d = usable(rows, id_, vector)
    return whiten(x, fit(x, d, components), d)
