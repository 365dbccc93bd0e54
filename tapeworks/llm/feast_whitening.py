"""Whitening of embeddings by contour integration (FEAST).

Entries become fixed-point integers, so sums and means are exact and equal vectors are
equal integers. The fit uses each distinct vector once.

* Spark reduces the distinct vectors to their exact sums, then to the centred covariance:
  tasks add up ``Y'Y`` of their rows and a grouping adds the cells. A covariance has the
  square of the dimension in entries, however many vectors there are; it and the like are
  all that reach the driver.
* **Slices.** A tridiagonal form gives the inertia of ``V - s`` and with it the number of
  eigenvalues above any ``s``. Bisection on these counts cuts the upper spectrum into
  intervals with a few eigenvalues each.
* **Contours.** For each interval the spectral projector is a circle integral of the
  resolvent; Gauss nodes turn it into complex shifted solves, one task each. The filtered
  subspace goes through Rayleigh-Ritz and round again until residuals are at rounding
  level. The number of Ritz values in the interval must equal the inertia count; else the
  subspace grows, and an interval that still differs is an error, not a silent miss.
* A last Rayleigh-Ritz over all intervals makes the components orthonormal to rounding.

Defined cases: a vector that is null or holds null or non-finite entries is left out;
so is an empty vector; entries beyond 2^56 in size count as that; vectors of different lengths
are models of their own; repeated rows are all returned but fitted once; a direction
without variance (below 1e-12 of the largest) is no component, so identical vectors
give no rows; a deviation that does not fit a long is null; null ids are kept; an empty
table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import settle

SCALE, SHIFT, LIMIT = 64.0, 1_000_000, 2.0 ** 62
COMPONENTS, NODES, SLICE = 16, 8, 6
NO_VARIANCE = 1e-12


# ---- fixed-point vectors -------------------------------------------------------------------


def fixed_point(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, dim, x): ``floor(64 c) + 1000000`` per entry, little-endian, 32 bits where all fit and else 64."""
    own = vectors.select(F.col(f"`{id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("size(v) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            flat = column.flatten()
            c = flat.to_numpy(zero_copy_only=False)  # null entries are nan
            ends = np.cumsum(column.value_lengths().to_numpy())
            dims = np.diff(ends, prepend=0)
            bad = np.add.reduceat(~np.isfinite(c), ends - dims) if len(ends) else np.zeros(0)
            x = np.floor(np.clip(np.where(np.isfinite(c), c, 0.0) * SCALE, -LIMIT, LIMIT)).astype(np.int64) + SHIFT
            rows, out = [], []
            for k in np.flatnonzero(bad == 0).tolist():
                own_x = x[ends[k] - dims[k]:ends[k]]
                rows.append(k)
                out.append(own_x.astype("<i4" if np.abs(own_x).max() < 2 ** 31 else "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(dims[rows], pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "x"])

    return own.mapInArrow(run, f"vec_id {own.schema['vec_id'].dataType.simpleString()}, dim int, x binary")


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) int64 of the encoded vectors."""
    raw = column.to_pylist()
    if all(len(r) == 4 * dim for r in raw):
        return np.frombuffer(b"".join(raw), "<i4").reshape(-1, dim).astype(np.int64)
    return np.array([np.frombuffer(r, "<i4" if len(r) == 4 * dim else "<i8") for r in raw], np.int64).reshape(-1, dim)


def few_parts(df: DataFrame) -> DataFrame:
    """As many tasks as can run at once and 256 at least: each returns a covariance of its own."""
    return df.coalesce(max(256, df.sparkSession.sparkContext.defaultParallelism))


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, [0] * dim, [0] * dim
        for b in batches:
            x = integers(b.column(0), dim)
            n += len(x)
            high = [a + int(s) for a, s in zip(high, (x >> 32).sum(axis=0))]
            low = [a + int(s) for a, s in zip(low, (x & 0xFFFFFFFF).sum(axis=0))]
        if n:
            sums = [Decimal((h << 32) + v) for h, v in zip(high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(sums, pa.decimal128(38, 0))], names=["i", "n", "s"])

    rows = few_parts(fit.select("x")).mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    sums = {r["i"]: int(r["s"]) for r in rows}
    return (rows[0]["n"] if rows else 0), [sums.get(i, 0) for i in range(dim)]


@dataclass(frozen=True)
class Centre:
    """The exact mean ``sums / n`` as a whole part and the rest."""

    n: int
    sums: list[int]

    @property
    def whole(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, self.whole)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over entries of ``(n x - sums)^2``; None where it does not fit a long."""
        off, rest = x - self.whole, [s - self.n * int(m) for s, m in zip(self.sums, self.whole)]
        most = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 2 ** 63:
            return ((self.n * off - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(o) - r) ** 2 for o, r in zip(row, rest)) for row in off]
        return [v if v < 2 ** 63 else None for v in exact]


def second_moments(fit: DataFrame, dim: int, width: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over vectors of ``r r'`` for ``r = rows_of(x)``, of ``width`` entries."""
    up = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            r = rows_of(integers(b.column(0), dim))
            total += r.T @ r
        yield pa.RecordBatch.from_arrays([pa.array(up[0], pa.int32()), pa.array(up[1], pa.int32()), pa.array(total[up])], names=["i", "j", "v"])

    out = np.zeros((width, width))
    cells = few_parts(fit.select("x")).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    for r in cells.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


# ---- the upper spectrum --------------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix with the eigenvalues of ``v``, by reflections."""
    a = v.copy()
    for k in range(len(a) - 2):
        u = a[k + 1:, k].copy()
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        size = u @ u
        if size > 0:
            p = a[k + 1:, k + 1:] @ u * (2 / size)
            p -= u * (u @ p / size)
            a[k + 1:, k + 1:] -= np.outer(u, p) + np.outer(p, u)
            a[k + 1, k] -= u[0] * 2 * (u @ a[k + 1:, k]) / size
    return np.diag(a).copy(), np.diag(a, -1) ** 2


class Inertia:
    """How many eigenvalues lie at or above a shift, by the signs of the pivots."""

    def __init__(self, v: np.ndarray):
        self.diagonal, self.off = tridiagonal(v)
        reach = np.sqrt(np.concatenate([[0], self.off])) + np.sqrt(np.concatenate([self.off, [0]]))
        self.top = float((self.diagonal + reach).max())

    def at_least(self, shift: float) -> int:
        tiny, pivot, below = 1e-300 + 1e-18 * abs(self.top), 1.0, 0
        for d, e in zip(self.diagonal, np.concatenate([[0], self.off])):
            pivot = d - shift - e / pivot
            if abs(pivot) < tiny:
                pivot = -tiny
            below += pivot < 0
        return len(self.diagonal) - below


def slices(count: Inertia, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals [low, high) that hold the ``wanted`` largest eigenvalues above NO_VARIANCE, with how many each holds; few of them, unless they cannot be told apart."""
    top = count.top * (1 + 1e-9) + 1e-300
    floor = NO_VARIANCE * count.top
    wanted = min(wanted, count.at_least(floor))
    if not wanted:
        return []

    def centred(cut: float, low: float, high: float) -> float:
        """The middle of the gap between eigenvalues in which ``cut`` lies."""
        n, ends = count.at_least(cut), []
        for end in (low, high):
            inside, outside = cut, end
            for _ in range(24):
                middle = (inside + outside) / 2
                inside, outside = (middle, outside) if count.at_least(middle) == n else (inside, middle)
            ends.append(inside)
        return sum(ends) / 2

    def calm(low: float, high: float) -> float:
        """A place between with no eigenvalue close by, if one of these has none."""
        tries = [low + (high - low) * f for f in (0.5, 0.43, 0.57, 0.36, 0.64, 0.3, 0.7)]
        near = 1e-3 * (high - low)
        return centred(next((t for t in tries if count.at_least(t - near) == count.at_least(t + near)), tries[0]), low, high)

    low, high = centred(floor, 0.0, top), top
    if count.at_least(low) > wanted + 4:
        while high - low > 1e-10 * top:
            cut = calm(low, high)
            n = count.at_least(cut)
            low, high = (cut, high) if n >= wanted else (low, cut)
            if wanted <= n <= wanted + 4:
                break
    out, open_ = [], [(low, top)]
    while open_:
        a, b = open_.pop()
        n = count.at_least(a) - count.at_least(b)
        if n > SLICE and b - a > 1e-9 * top:
            cut = calm(a, b)
            open_ += [(a, cut), (cut, b)]
        elif n:
            out.append((a, b, n))
    return out


def filtered(spark: SparkSession, v, contours: list[tuple[float, float]], spaces: list[np.ndarray]) -> list[np.ndarray]:
    """The contour integral of the resolvent applied to each interval's subspace; one task per interval and node."""
    at, weight = np.polynomial.legendre.leggauss(NODES)
    sent = spark.sparkContext.broadcast(spaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                (centre, radius), y = contours[k // NODES], sent.value[k // NODES]
                turn = radius * np.exp(0.5j * np.pi * (1 + at[k % NODES]))
                x = np.linalg.solve((centre + turn) * np.eye(len(y)) - v.value, y)
                part = 0.5 * weight[k % NODES] * (turn * x).real
                yield pa.RecordBatch.from_arrays([pa.array([k // NODES], pa.int32()), pa.array([part.tobytes()])], names=["slice", "part"])

    n = NODES * len(contours)
    out = [np.zeros_like(y) for y in spaces]
    for r in spark.range(0, n, 1, n).mapInArrow(run, "slice int, part binary").collect():
        out[r["slice"]] += np.frombuffer(r["part"]).reshape(out[r["slice"]].shape)
    sent.destroy()
    return out


def ritz(v: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz values, falling, and vectors of ``v`` in ``space``."""
    q = np.linalg.qr(space)[0]
    h = q.T @ v @ q
    values, s = np.linalg.eigh((h + h.T) / 2)
    return values[::-1], (q @ s)[:, ::-1]


def upper_components(spark: SparkSession, v: np.ndarray, wanted: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors as columns; none missed, by inertia."""
    d, size = len(v), np.abs(v).max(initial=0.0)
    if not size:
        return np.zeros(0), np.zeros((d, 0))
    scaled = v / size
    cut = slices(Inertia(scaled), wanted)
    rng, sent = np.random.default_rng(13), spark.sparkContext.broadcast(scaled)
    found: dict[int, np.ndarray] = {}
    spaces = {k: rng.standard_normal((d, min(d, 2 * n + 4))) for k, (_, _, n) in enumerate(cut)}
    worst = dict.fromkeys(spaces, np.inf)
    norm = np.abs(scaled).sum(axis=1).max()
    for turn in range(rounds):
        open_ = [k for k in spaces if k not in found]
        if not open_:
            break
        contours = [((a + b) / 2, max((b - a) / 2, 1e-8 * norm)) for a, b, _ in (cut[k] for k in open_)]
        for k, space in zip(open_, filtered(spark, sent, contours, [spaces[k] for k in open_])):
            values, x = ritz(scaled, space)
            a, b, n = cut[k]
            mine = (values >= a) & (values < b)
            off = np.abs(scaled @ x[:, mine] - x[:, mine] * values[mine]).max(initial=0.0) if mine.sum() == n else np.inf
            if off <= 1e-14 * norm or (off <= 1e-12 * norm and off > worst[k] / 2):  # at rounding level and no longer falling
                found[k] = x[:, mine]
            worst[k] = off
            grow = turn % 6 == 5 and x.shape[1] < d
            spaces[k] = np.hstack([x, rng.standard_normal((d, min(n + 2, d - x.shape[1])))]) if grow else x
    sent.destroy()
    if len(found) < len(cut):
        raise ArithmeticError(f"{len(cut) - len(found)} of {len(cut)} intervals did not reach their inertia counts")
    values, x = ritz(scaled, np.hstack([found[k] for k in range(len(cut))])) if cut else (np.zeros(0), np.zeros((d, 0)))
    return values[:wanted] * size, x[:, :wanted]


# ---- the operator --------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def fit_model(fit: DataFrame, dim: int, components: int = COMPONENTS) -> Model:
    """``fit``: distinct encoded vectors (x) of one length, at least one, settled."""
    centre = Centre(*exact_sums(fit, dim))
    v = second_moments(fit, dim, dim, centre.centred) / centre.n
    values, vectors = upper_components(fit.sparkSession, v, min(components, dim))
    k, model = len(values), Model(centre, values, vectors, float(np.trace(v)), 0.0)
    if not k:
        return model
    with_one = lambda x: np.hstack([model.whiten(x), np.ones((len(x), 1))])  # noqa: E731  for the means
    m = second_moments(fit, dim, k + 1, with_one) / centre.n
    own = m[:k, :k] - np.outer(m[:k, k], m[:k, k])
    return Model(centre, values, vectors, model.trace, float(np.abs(own - np.eye(k)).max()))


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector: vec_id, n, deviation, ``whitened`` (array), ``explained`` (array), identity_error."""
    own = fixed_point(vectors, id, vector)
    fit = settle(own.select("dim", "x").distinct())
    models = {r["dim"]: None for r in fit.select("dim").distinct().collect()}
    models = {dim: fit_model(fit.where(F.col("dim") == dim), dim, components) for dim in models}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                m, part = models[dim], b.filter(pa.array(dims == dim))
                x = integers(part.column(2), dim)
                rows = len(x)
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * len(m.values), pa.int32()), pa.array(a.ravel()))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column(0), "n": pa.array([m.centre.n] * rows, pa.int64()), "deviation": pa.array(m.centre.deviation(x), pa.int64()),
                    "whitened": lists(m.whiten(x)), "explained": lists(np.tile(m.values / m.trace if m.trace else m.values, (rows, 1))), "identity_error": pa.array([m.identity_error] * rows)})

    return own.mapInArrow(run, f"vec_id {own.schema['vec_id'].dataType.simpleString()}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")


def components_of(whitened: DataFrame) -> DataFrame:
    """One row per vector and component, numbered from 1."""
    one = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return whitened.select("vec_id", "n", "deviation", "identity_error", one).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
