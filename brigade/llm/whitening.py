"""Operator 11: embeddings whitened on their leading principal components, found by matrix-free block Lanczos."""

from __future__ import annotations

import decimal
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stash

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_MOST = (1 << 63) - 1


def quantised(rows: DataFrame, *, vector: str = "embedding", key: str = "vec_id", scale: int = 256) -> DataFrame:
    """(vec_id, x, d) of the rows whose vector has neither nulls nor non-finite entries: x is floor(scale * c)
    of each entry, held to the range of a long, and d their number."""
    c = F.col(vector)
    whole = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    x = F.transform(c, lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("long"))
    return rows.where(whole).select(F.col(key).cast("long").alias("vec_id"), x.alias("x"), F.size(c).alias("d"))


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Centre:
    """Deviations of vectors from a mean that is given exactly, as the sum of n vectors."""

    def __init__(self, sums: list[int], n: int):
        self.sums, self.n = sums, n
        self.small = max((abs(s) for s in sums), default=0) < 1 << 61
        self.s = np.array(sums, np.int64) if self.small else np.array(sums, object)

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in whole numbers, as longs where they can't overflow."""
        top = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
        if self.small and top * self.n < 1 << 61:
            return x * np.int64(self.n) - self.s
        return x.astype(object) * self.n - self.s

    def __call__(self, x: np.ndarray) -> np.ndarray:
        dev = self.exact(x)
        if dev.dtype == object:
            return np.array([[float(decimal.Decimal(v) / self.n) for v in row] for row in dev], np.float64).reshape(dev.shape)
        return dev / np.float64(self.n)

    def squares(self, x: np.ndarray) -> list[int]:
        """The exact sum of squares of each vector's n * x - S."""
        dev = self.exact(x)
        if dev.dtype != object:
            top = int(np.abs(dev).max(initial=0))
            if top * top * max(dev.shape[1], 1) <= _MOST:
                return np.einsum("ij,ij->i", dev, dev).tolist()
        return [sum(v * v for v in row) for row in dev.astype(object).tolist()]


def _sums(fit: DataFrame, d: int) -> list[int]:
    """The exact sum of each dimension over the fit list."""

    def run(batches):
        total = [0] * d
        for b in batches:
            x = _matrix(b.column(0), d)
            safe = int(np.abs(x.astype(np.float64)).max(initial=0) + 1) * max(len(x), 1) < 1 << 61
            total = [t + int(v) for t, v in zip(total, x.sum(axis=0) if safe else x.astype(object).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(map(decimal.Decimal, total)), pa.decimal128(38, 0))], names=["i", "s"])

    got = fit.select("x").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()  # a row a dimension
    by = {r.i: int(r.s) for r in got}
    return [by.get(i, 0) for i in range(d)]


def _total(fit: DataFrame, d: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the fit list of the matrices that ``of`` gives for some vectors at once. Tasks add up
    their own, and Spark adds those row by row of the matrix."""

    def run(batches):
        total = None
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = of(_matrix(b.column(0).slice(at, 4096), d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(total[:, j]) for j in range(width))], names=["i", *(f"y{j}" for j in range(width))])

    parts = fit.select("x").mapInArrow(run, ", ".join(["i int", *(f"y{j} double" for j in range(width))]))
    got = parts.groupBy("i").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(width)]).collect()  # a row a dimension
    out = np.zeros((max((r.i for r in got), default=-1) + 1, width))
    for r in got:
        out[r.i] = r[1:]
    return out


def _orthonormal(w: np.ndarray, basis: np.ndarray, least: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, int]:
    """(q, r, fresh): an orthonormal block beside ``basis`` with w = q r up to what is below ``least``.
    Columns that break down are replaced by random directions, as long as the space has any left, whose
    rows in r are zero; fresh counts them."""
    d, b = w.shape
    room = d - basis.shape[1]
    q, r, fresh = np.zeros((d, 0)), np.zeros((0, b)), 0
    for j in range(min(b, room)):
        v, row = w[:, j].copy(), np.zeros((1, b))
        for random in range(20):
            for _ in range(3):
                v -= basis @ (basis.T @ v)
                v -= q @ (q.T @ v)
            size = np.linalg.norm(v)
            if size > (least if not random else 1e-6):
                break
            v = rng.standard_normal(d)
        else:
            break
        v /= size
        fresh += random > 0
        q = np.hstack([q, v[:, None]])
        if not random:
            row[0, j:] = v @ w[:, j:]
        r = np.vstack([r, row])
    return q, r, fresh


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, *, block: int = 16, tolerance: float = 1e-13, most: int = 512, passes: int = 2000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns), falling, the ``k`` largest of a symmetric operator of which
    only the product with a block of vectors is known.

    Every new block is orthogonalised against the whole basis. Where a block breaks down, the search
    goes on with random directions and isn't ended before such were tried. It ends when the residuals of
    all k pairs are below ``tolerance`` of the largest eigenvalue, or the basis is the whole space. At
    ``most`` columns the basis is begun anew from its best vectors. Raises after ``passes`` products.
    """
    rng = np.random.default_rng(seed)
    k, block = min(k, d), min(max(block, k), d)
    most = max(most, 4 * block)
    if not k:
        return np.zeros(0), np.zeros((d, 0))
    start, _, _ = _orthonormal(rng.standard_normal((d, block)), np.zeros((d, 0)), 0.0, rng)
    for _ in range(passes):
        basis, t, q, fresh, coupling = np.zeros((d, 0)), np.zeros((0, 0)), start, 0, None
        while True:
            w = apply(q)
            m, b = basis.shape[1], q.shape[1]
            basis = np.hstack([basis, q])
            wide = np.zeros((m + b, m + b))  # block tridiagonal
            wide[:m, :m] = t
            a = q.T @ w
            wide[m:, m:] = (a + a.T) / 2
            if coupling is not None:
                wide[m:, m - coupling.shape[1] : m] = coupling
                wide[m - coupling.shape[1] : m, m:] = coupling.T
            t = wide
            e, s = np.linalg.eigh(t)
            e, s = e[::-1], s[:, ::-1]
            for _ in range(2):
                w -= basis @ (basis.T @ w)
            scale = max(abs(e[0]), abs(e[-1]), 1e-300)
            q, coupling, broken = _orthonormal(w, basis, 1e-14 * scale, rng)
            residual = np.linalg.norm(coupling @ s[-b:, :k], axis=0) if len(coupling) else np.zeros(k)
            tried, fresh = not broken or fresh, broken
            if not q.shape[1] or (basis.shape[1] >= k and tried and (residual <= tolerance * scale).all()):
                vectors = basis @ s[:, :k]
                h = vectors.T @ apply(vectors)
                values, turn = np.linalg.eigh((h + h.T) / 2)
                return values[::-1], vectors @ turn[:, ::-1]
            if basis.shape[1] + q.shape[1] > most:
                start = np.linalg.qr(basis @ s[:, :block])[0]
                break
    raise ArithmeticError(f"no convergence to {tolerance} of the largest eigenvalue in {passes} starts")


def whiten(rows: DataFrame, *, vector: str = "embedding", key: str = "vec_id", components: int = 4, scale: int = 256, block: int = 16, tolerance: float = 1e-13) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error): each whole vector's
    coordinates on the leading components of the covariance of all distinct ones, over their deviations.

    The covariance is never formed: it is applied to a block of vectors by a pass over the fit list, which
    is kept in the shared folder, and what a pass returns is a row a dimension. Vectors that are null or
    hold null or non-finite entries take no part. Repeated rows count once in the fit and are returned
    each; repeated or null keys too. Vectors of different lengths are spaces with fits of their own.
    Components without variance (one distinct vector, equal entries) are left out, so rows may have fewer
    than ``components``, or none; so have empty vectors. Entries and deviations are held to the range of a
    long. Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    x = quantised(rows, vector=vector, key=key, scale=scale)
    fit = stash(x.select("x", "d").distinct(), "whitening-fit")
    counts = {r.d: r["count"] for r in fit.where("d > 0").groupBy("d").count().collect()}  # a row a length
    models = {d: _fit(fit.where(F.col("d") == d), d, n, components, block, tolerance) for d, n in sorted(counts.items())}
    error = max((m[3] for m in models.values()), default=0.0)
    out = None
    for d, (centre, values, vectors, _, trace) in models.items():
        if len(values):
            part = _project(x.where(F.col("d") == d), d, centre, values, vectors, trace, error)
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def _fit(fit: DataFrame, d: int, n: int, components: int, block: int, tolerance: float):
    """(centre, eigenvalues, eigenvectors, largest entry of the whitened covariance minus the identity, trace)."""
    centre = Centre(_sums(fit, d), n)
    width = min(max(block, components), d)

    def apply(q: np.ndarray) -> np.ndarray:
        def of(x):
            c = centre(x)
            return c.T @ (c @ q)

        return _total(fit, d, q.shape[1], of) / n

    def spread(x):  # deviations are n times too large
        return np.array([[float(sum(centre.squares(x))) / n / n]])

    trace = float(_total(fit, d, 1, spread)[0, 0]) / n
    if trace <= 0:
        return centre, np.zeros(0), np.zeros((d, 0)), 0.0, trace
    values, vectors = block_lanczos(apply, d, components, block=width, tolerance=tolerance)
    keep = values > 1e-13 * d * values[0]
    values, vectors = values[keep], vectors[:, keep]
    scaled = vectors / np.sqrt(values)
    mean = _total(fit, d, 1, lambda x: (centre(x) @ scaled).sum(axis=0)[:, None])[:, 0] / n

    def products(x):
        z = centre(x) @ scaled - mean
        return z.T @ z

    covariance = _total(fit, d, len(values), products) / n
    return centre, values, vectors, float(np.abs(covariance - np.eye(len(values))).max()), trace


def _project(x: DataFrame, d: int, centre: Centre, values, vectors, trace: float, error: float) -> DataFrame:
    scaled, k, shares = vectors / np.sqrt(values), len(values), values / trace

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                m = _matrix(b.column(1), d)
                z = centre(m) @ scaled
                spread = np.array([min(v, _MOST) for v in centre.squares(m)], np.int64)
                ids = b.column(0).take(pa.array(np.repeat(np.arange(len(m)), k)))
                cols = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(m)), np.full(len(m) * k, centre.n, np.int64), np.repeat(spread, k), z.ravel(), np.tile(shares, len(m)), np.full(len(m) * k, error)]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, cols)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return x.select("vec_id", "x").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
