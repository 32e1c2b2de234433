"""Embedding whitening: leading eigenvectors of the covariance by Jacobi-Davidson.

Vectors are first made integers, ``x = floor(64 c) + 1000000``; the fit list holds every distinct x
once (n of them, sums S). The covariance V of the fit list (divisor n, centred before multiplying)
is never formed: every product ``V Q`` for a block Q is one Spark job in which each task multiplies
its centred rows, ``Y^T (Y Q)``, and the partial d x k blocks are summed by an aggregation, so only
d x k numbers reach the driver. On the driver, Jacobi-Davidson: Rayleigh-Ritz on the search space,
a projected correction equation per unconverged Ritz pair solved by a few MINRES steps (all pairs
in lockstep, one distributed product per step), locking of pairs whose residual reaches double
precision, and a restart that keeps the best vectors when the space grows too large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import rows_of, stored

#: Fixed values of the contract: scale and offset of the integer vectors, components returned.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Residual norm, relative to the largest eigenvalue, at which a pair is locked.
TOLERANCE = 1e-12
#: MINRES steps per correction equation; most outer iterations; search space before a restart.
INNER_STEPS, OUTER_STEPS = 4, 60


def integer_vectors(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key, x`` (array<long>) for rows whose vector is sound.

    Rows go whose vector is null, empty, or holds a null or non-finite entry, or an entry whose
    ``64 c`` lies beyond 2^53 (it has no exact long), and rows whose length is not the most common
    one (ties: the longer); a covariance needs one dimension.
    """
    v = F.col(vector).cast("array<double>")
    sound = (v.isNotNull() & (F.size(v) > 0)
             & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < float(1 << 53))))
    rows = embeddings.select(F.col(key).alias("key"), v.alias("v")).filter(sound)
    d = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).select("d").limit(1)
    return rows.join(F.broadcast(d), F.size("v") == F.col("d")).select(
        "key", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"))


class Covariance:
    """Matrix-free products with the covariance of a stored fit list of centred rows."""

    def __init__(self, fit: DataFrame, mean: np.ndarray, n: int):
        self.fit, self.mean, self.n, self.d = fit, mean, n, len(mean)
        self.products = 0

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        mean, k, d = self.mean, q.shape[1], self.d
        self.products += 1

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((d, k))
            for b in batches:
                if b.num_rows:
                    y = rows_of(b.column(0), np.float64) - mean
                    acc += y.T @ (y @ q)
            yield pa.RecordBatch.from_arrays([pa.array([acc.ravel()], pa.list_(pa.float64()))], names=["p"])

        sums = (self.fit.select("x").mapInArrow(part, "p array<double>")
                .select(F.posexplode("p").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect())
        out = np.zeros(d * k)
        for row in sums:
            out[row.i] = row.v
        return out.reshape(d, k) / self.n


def _orthonormal(v: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns of ``v`` made orthonormal to ``against`` and each other (twice), weak ones dropped."""
    for _ in range(2):
        if against.shape[1]:
            v = v - against @ (against.T @ v)
    keep = []
    for j in range(v.shape[1]):
        c = v[:, j]
        for _ in range(2):
            for k in keep:
                c = c - k * (k @ c)
        norm = np.linalg.norm(c)
        if norm > 1e-10:
            keep.append(c / norm)
    return np.stack(keep, axis=1) if keep else np.zeros((v.shape[0], 0))


def _minres(apply, b: np.ndarray, steps: int) -> np.ndarray:
    """MINRES for the columns of ``b`` at once (x0 = 0); ``apply`` maps a block to a block."""
    k = b.shape[1]
    x, w, w2 = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    r1, r2, y = b.copy(), b.copy(), b.copy()
    beta = np.linalg.norm(b, axis=0)
    oldb, dbar, epsln, phibar = np.zeros(k), np.zeros(k), np.zeros(k), beta.copy()
    cs, sn = -np.ones(k), np.zeros(k)
    tiny = np.finfo(float).eps
    for step in range(steps):
        live = beta > tiny * np.maximum(1.0, np.linalg.norm(b, axis=0))
        if not live.any():
            break
        v = np.where(live, y / np.where(live, beta, 1.0), 0.0)
        y = apply(v)
        if step:
            y = y - np.where(oldb > 0, beta / np.where(oldb > 0, oldb, 1.0), 0.0) * r1
        alfa = np.einsum("ij,ij->j", v, y)
        y = y - np.where(live, alfa / np.where(live, beta, 1.0), 0.0) * r2
        r1, r2 = r2, y
        oldb, beta = beta, np.linalg.norm(y, axis=0)
        oldeps = epsln
        delta = cs * dbar + sn * alfa
        gbar = sn * dbar - cs * alfa
        epsln, dbar = sn * beta, -cs * beta
        gamma = np.maximum(np.hypot(gbar, beta), tiny)
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, sn * phibar
        w1, w2 = w2, w
        w = (v - oldeps * w1 - delta * w2) / gamma
        x = x + np.where(live, phi, 0.0) * w
    return x


def leading_eigenpairs(cov: Covariance, m: int, tolerance: float = TOLERANCE, seed: int = 0):
    """The ``m`` largest eigenpairs of ``cov`` (values falling), by Jacobi-Davidson with locking."""
    d = cov.d
    m = min(m, d)
    most = min(d, max(4 * m, m + 8))
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((d, 0)), []
    space = _orthonormal(rng.standard_normal((d, min(d, m + 4))), locked)
    product = cov @ space
    scale = None
    for _ in range(OUTER_STEPS):
        h = space.T @ product
        theta, s = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-theta)
        theta, s = theta[order], s[:, order]
        ritz, aritz = space @ s, product @ s
        resid = aritz - ritz * theta
        scale = scale or max(abs(theta[0]), np.finfo(float).tiny)
        norms = np.linalg.norm(resid, axis=0)
        want = m - len(values)
        # Lock the leading pairs that converged, in order.
        done = 0
        while done < min(want, len(theta)) and (norms[done] <= tolerance * scale or space.shape[1] == d - len(values)):
            done += 1
        if done:
            locked = np.hstack([locked, ritz[:, :done]])
            values += theta[:done].tolist()
            if len(values) >= m:
                break
            space, product = ritz[:, done:], aritz[:, done:]
            theta, ritz, aritz, resid = theta[done:], ritz[:, done:], aritz[:, done:], resid[:, done:]
            want = m - len(values)
            if space.shape[1] == 0:
                space = _orthonormal(rng.standard_normal((d, want)), locked)
                product = cov @ space
                continue
        fix = min(want, space.shape[1])
        u, t, r = ritz[:, :fix], theta[:fix], resid[:, :fix]
        basis = np.hstack([locked, u])

        def project(v):
            return v - basis @ (basis.T @ v)

        def operator(v):
            pv = project(v)
            return project(cov @ pv - pv * t)

        corrections = _minres(operator, -project(r), INNER_STEPS)
        if space.shape[1] >= most:  # restart: keep the leading Ritz vectors
            keep = max(m - len(values), 1) + 4
            space, product = ritz[:, :keep], aritz[:, :keep]
        new = _orthonormal(corrections, np.hstack([locked, space]))[:, :most - space.shape[1]]
        if new.shape[1] == 0:
            new = _orthonormal(rng.standard_normal((d, fix)), np.hstack([locked, space]))
        if new.shape[1]:
            space, product = np.hstack([space, new]), np.hstack([product, cov @ new])
    else:
        raise RuntimeError("Jacobi-Davidson did not converge")
    vectors = locked[:, :m]
    # One sign for all rows: the entry of largest size is positive.
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    return np.array(values[:m]), vectors * np.where(signs == 0, 1, signs)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    big = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if big < (1 << 62) and big * big * x.shape[1] < (1 << 63) - 1:
        s = np.array(sums, dtype=np.int64)
        return (((n * x) - s) ** 2).sum(axis=1).tolist()
    out = []
    for row in x.tolist():
        v = sum((n * a - b) ** 2 for a, b in zip(row, sums))
        out.append(v if v < (1 << 63) else None)
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, dict]:
    """Per sound row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Components are numbered from 1 by falling eigenvalue; only those with a positive eigenvalue
    (above 1e-12 of the largest) are given, so a fit list of one vector, or of equal vectors, gives
    no rows. Whitened is ``(x - S/n)`` projected on the component over the root of its eigenvalue;
    ``identity_error`` is the largest entry of |covariance of whitened over the fit list - I|,
    measured with one more distributed product. Rows with a null vec_id are kept. Empty input or no
    sound row: empty result. Returns the rows and a report (products, eigenvalues).
    """
    spark = embeddings.sparkSession
    rows = stored(integer_vectors(embeddings), "whiten-rows")
    fit = stored(rows.select("x").distinct(), "whiten-fit")
    d_row = rows.select(F.size("x").alias("d")).limit(1).collect()
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if not d_row:
        return spark.createDataFrame([], schema), {"products": 0}
    d = d_row[0].d
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    n = sums[0].n
    total = [0] * d
    for r in sums:
        total[r.i] = int(r.s)
    mean = np.array([s / n for s in total])
    cov = Covariance(fit, mean, n)
    # Exact trace: the deviations of the fit list over n^3.
    def fit_dev(batches):
        for b in batches:
            dev = _deviations(rows_of(b.column(0), np.int64), n, total)
            yield pa.RecordBatch.from_arrays([pa.array([str(v) for v in dev], pa.string())], names=["dev"])
    trace = fit.select("x").mapInArrow(fit_dev, "dev string").agg(
        F.sum(F.col("dev").cast("decimal(38,0)")).alias("t")).first().t
    trace = float(int(trace)) / float(n) ** 3 if trace is not None else 0.0
    if trace <= 0:
        return spark.createDataFrame([], schema), {"products": 0}
    values, vectors = leading_eigenpairs(cov, components)
    keep = values > 1e-12 * max(values[0], 0.0)
    values, vectors = values[keep], vectors[:, keep]
    if not len(values):
        return spark.createDataFrame([], schema), {"products": cov.products}
    scaled = vectors / np.sqrt(values)
    check = scaled.T @ (cov @ scaled)
    error = float(np.abs(check - np.eye(len(values))).max())
    explained = (values / trace).tolist()
    k = len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = rows_of(b.column(1), np.int64)
            white = (x - mean) @ scaled
            dev = _deviations(x, n, total)
            yield pa.RecordBatch.from_arrays([
                pa.array([v for v in b.column(0).to_pylist() for _ in range(k)], pa.int64()),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                pa.array(np.full(b.num_rows * k, n, dtype=np.int64)),
                pa.array([v for v in dev for _ in range(k)], pa.int64()),
                pa.array(white.ravel()),
                pa.array(np.tile(explained, b.num_rows)),
                pa.array(np.full(b.num_rows * k, error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.select(F.col("key").cast("long"), "x").mapInArrow(project, schema)
    return out, {"products": cov.products, "eigenvalues": values.tolist(), "identity_error": error}
