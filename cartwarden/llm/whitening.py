"""Whitening of embeddings: Jacobi-Davidson on the covariance, which only products of the distributed rows touch.

The covariance is never formed. A product is one pass over the rows, centred first: each task sums y (y . w) over its
vectors for a block of directions, Spark sums the tasks' blocks by entry, and the driver holds blocks of d x k numbers,
k at most three times the components and guards. Correction equations of all unconverged pairs are solved together, so a
step of the inner MINRES is one pass as well. Passes are jobs of their own over a written table: a lost executor costs
its tasks only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Entries of this size or more are treated as not finite, so that integers and their sums are exact.
LARGEST = 2.0**31
#: Residuals count as double precision below this part of the largest eigenvalue.
PRECISION = 2e-14
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def fit_list(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x): x = floor(64 c) + 1000000 of each entry, for vectors without a null, NaN, infinite or huge entry.

    A null or empty vector is left out. Vectors of another length than the most frequent one (the longest of those) are
    left out as well. Repeated rows and null keys are kept as rows of their own; other columns are dropped.
    """
    sound = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(LARGEST))  # noqa: E731  (NaN is above all numbers)
    whole: Column = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * 64).cast("long") + F.lit(1_000_000))
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(F.forall(vector, sound)).select(F.col(key), whole.alias("x"))
    rows = written(rows, "whitening-rows")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == lengths[0]["d"]) if lengths else rows


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> list:
    """The sum of part(x of a batch) over all batches, entry by entry; in tasks first, then by a shuffle of the entries."""
    kind = "long" if exact else "double"

    def tasks(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                one = part(_matrix(batch.column(0))).ravel()
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64() if exact else pa.float64()))], ["part"])

    parts = rows.select("x").mapInArrow(tasks, f"part array<{kind}>").select(F.posexplode("part").alias("at", "value"))
    value = F.col("value").cast("decimal(38,0)") if exact else F.col("value")
    found = parts.groupBy("at").agg(F.sum(value).alias("value")).collect()
    return [r["value"] for r in sorted(found, key=lambda r: r["at"])]


class Centred:
    """The rows of a fit list less their mean, to the last bit: y = (x - floor(S / n)) - (S mod n) / n."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        sums = _summed(rows, lambda x: np.append(x.sum(axis=0), len(x)), exact=True)
        self.sums, self.n = [int(s) for s in sums[:-1]], int(sums[-1]) if sums else 0
        self.d = len(self.sums)
        self.whole = np.array([s // self.n for s in self.sums], np.int64) if self.n else np.zeros(0, np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64) if self.n else np.zeros(0, np.int64)

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        whole, rest = self.whole, self.rest / max(self.n, 1)
        return lambda x: (x - whole).astype(np.float64) - rest

    def product(self, block: np.ndarray) -> np.ndarray:
        """V @ block, one pass."""
        centre = self.centre()

        def part(x: np.ndarray) -> np.ndarray:
            y = centre(x)
            return y.T @ (y @ block)

        return np.array(_summed(self.rows, part)).reshape(block.shape) / self.n

    def trace(self) -> float:
        centre = self.centre()
        return float(np.sum(_summed(self.rows, lambda x: (centre(x) ** 2).sum(axis=0))) / self.n)

    def spread(self, transform: np.ndarray) -> np.ndarray:
        """The covariance of the rows under the transform, from the transformed rows themselves."""
        centre, k = self.centre(), transform.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            w = centre(x) @ transform
            return np.vstack([w.T @ w, w.sum(axis=0)])

        found = np.array(_summed(self.rows, part)).reshape(k + 1, k) / self.n
        return found[:k] - np.outer(found[k], found[k])


def _outside(block: np.ndarray, *known: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to the known orthonormal columns (twice, against rounding)."""
    for _ in range(2):
        for q in known:
            block = block - q @ (q.T @ block)
        lengths = np.linalg.norm(block, axis=0)
        block = block[:, lengths > 1e-300] / lengths[lengths > 1e-300]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(s[0], 1e-300)]
        room = block.shape[0] - sum(q.shape[1] for q in known)
        block = block[:, : max(room, 0)]
    return block


def minres(product: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, project: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """A few steps of MINRES for P (A - shift_j) P t_j = right_j, all columns j at once: a step is one product."""
    v_old, v = np.zeros_like(right), project(right)
    beta = np.linalg.norm(v, axis=0)
    alive = beta > 0
    v = np.where(alive, v / np.where(alive, beta, 1), 0)
    eta, c, c_old, s, s_old = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    w, w_old, t, start = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right), beta
    beta = np.zeros_like(beta)
    for _ in range(steps):
        if not alive.any():
            break
        new = project(product(v) - v * shifts)
        alpha = (v * new).sum(axis=0)
        new = new - v * alpha - v_old * beta
        beta_new = np.linalg.norm(new, axis=0)
        r1, r2, r3 = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        r0 = np.hypot(r1, beta_new)
        alive &= r0 > 1e-300
        safe = np.where(alive, r0, 1)
        c_old, s_old, c, s = c, s, np.where(alive, r1 / safe, 1), np.where(alive, beta_new / safe, 0)
        w_old, w = w, (v - w_old * r3 - w * r2) / safe
        t = t + np.where(alive, c * eta, 0) * w
        eta = -s * eta
        v_old, beta = v, beta_new
        alive &= (beta_new > 1e-14 * start) & (np.abs(eta) > 1e-14 * start)
        v = np.where(alive, new / np.where(beta_new > 0, beta_new, 1), 0)
    return t


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, guards: int = 8, inner: int = 4, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the ``wanted`` largest eigenpairs of a symmetric operator that only ``product`` applies.

    Each round takes the Ritz pairs of the subspace, locks those at its head whose residuals have reached double
    precision, and adds the corrections of the others; a full subspace restarts from its best Ritz vectors. At the end
    the residuals of all pairs are taken anew; if one has not held, the search goes on from them. Residuals that stand
    still at the rounding of the products (below 1e-11 of the largest eigenvalue) end the search; above, it is an error.
    """
    wanted = min(wanted, d)
    size = min(d, wanted + guards)
    basis, most = np.linalg.qr(np.random.default_rng(7).standard_normal((d, size)))[0], min(d, 3 * size)
    for _ in range(4):
        locked, values = np.zeros((d, 0)), np.zeros(0)
        basis = _outside(basis)
        images, best, still = product(basis), np.inf, 0
        for _ in range(rounds):
            small = basis.T @ images
            theta, turn = np.linalg.eigh((small + small.T) / 2)
            theta, turn = theta[::-1], turn[:, ::-1]
            basis, images = basis @ turn, images @ turn
            open_ = min(wanted - len(values), basis.shape[1])
            away = images[:, :open_] - basis[:, :open_] * theta[:open_]
            away -= locked @ (locked.T @ away)
            errors, scale = np.linalg.norm(away, axis=0), max(abs(theta[0]), values[0] if len(values) else 0.0)
            complete = basis.shape[1] + len(values) == d
            worst = float(errors.max())
            still = still + 1 if worst > best / 2 and worst < 1e-11 * scale else 0
            best = min(best, worst)
            good = open_ if complete or still >= 3 else int(np.argmin(np.append(errors <= PRECISION * scale, False)))
            locked, values = np.hstack([locked, basis[:, :good]]), np.append(values, theta[:good])
            if len(values) == wanted:
                break
            basis, images, theta, away = basis[:, good:], images[:, good:], theta[good:], away[:, good:]
            if basis.shape[1] > most - (open_ - good):
                basis, images = basis[:, :size], images[:, :size]
            heads = basis[:, : open_ - good]

            def project(t: np.ndarray, heads=heads, locked=locked) -> np.ndarray:
                t = t - locked @ (locked.T @ t)
                return t - heads @ (heads.T @ t)

            found = minres(product, theta[: open_ - good], project, -away, inner)
            more = _outside(np.hstack([found, away]) if not np.any(found) else found, locked, basis)
            if not more.shape[1]:  # corrections that lie within the subspace: a new direction instead
                more = _outside(np.random.default_rng(len(values)).standard_normal((d, size)), locked, basis)
            basis, images = np.hstack([basis, more]), np.hstack([images, product(more)])
        if len(values) == wanted:
            again = product(locked)
            small = locked.T @ again
            theta, turn = np.linalg.eigh((small + small.T) / 2)
            theta, vectors, again = theta[::-1], (locked @ turn)[:, ::-1], (again @ turn)[:, ::-1]
            if np.linalg.norm(again - vectors * theta, axis=0).max() <= max(1e-11, PRECISION) * max(abs(theta[0]), 1e-300):
                return theta, vectors
            basis = vectors
    raise ArithmeticError("the eigenpairs did not reach double precision")


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = 32) -> DataFrame:
    """Each fitted vector's coordinates on the leading eigenvectors, divided by the deviation along them.

    Returns a row per vector of ``fit_list`` and component. Components are numbered from 1 by falling eigenvalue; those
    whose eigenvalue is zero to rounding (equal vectors, one vector, fewer vectors than dimensions) have no whitened
    form and give no rows. An empty table gives no rows. A deviation that doesn't fit a long is null.
    """
    rows = fit_list(df, vector, key)
    fit = Centred(rows)
    trace = fit.trace() if fit.n else 0.0
    if trace <= 0:
        return rows.sparkSession.createDataFrame([], RESULT)
    values, vectors = jacobi_davidson(fit.product, fit.d, most)
    real = values > fit.d * 1e-13 * values[0]
    values, vectors = values[real], vectors[:, real]
    transform, k = vectors / np.sqrt(values), int(real.sum())
    error = float(np.abs(fit.spread(transform) - np.eye(k)).max())
    n, whole, rest, centre, explained = fit.n, fit.whole, fit.rest, fit.centre(), values / trace

    def tasks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column(1))
                w, away = centre(x) @ transform, x - whole
                if float(np.abs(away).max(initial=0) + 1) * n < np.sqrt(2.0**62 / fit_d):
                    deviation = ((away * n - rest) ** 2).sum(axis=1).tolist()
                else:
                    exact = [sum((int(a) * n - int(r)) ** 2 for a, r in zip(row, rest, strict=True)) for row in away]
                    deviation = [e if e < 2**63 else None for e in exact]
                m = len(part)
                index = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(index)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(deviation, pa.int64()).take(pa.array(index)),
                        pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    fit_d = fit.d
    kind = dict(rows.dtypes)[key]
    return rows.select(key, "x").mapInArrow(tasks, RESULT.replace("vec_id long", f"vec_id {kind}"))
