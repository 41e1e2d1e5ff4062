"""Linear solvers: dense per block in numpy, Krylov methods over DataFrames for systems of any size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.session import checkpoint

#: A linear map of vectors (id, v).
Map = Callable[[DataFrame], DataFrame]


def inertia(a: np.ndarray, tol: float = 1e-10) -> tuple[int, int, int]:
    """(positive, negative, zero) eigenvalues of a symmetric matrix."""
    values = np.linalg.eigvalsh(a)
    edge = tol * max(1.0, float(np.abs(values).max(initial=0)))
    return int((values > edge).sum()), int((values < -edge).sum()), int((np.abs(values) <= edge).sum())


def regularized(a: np.ndarray, positive: int, negative: int, start: float = 1e-8, grow: float = 100.0, limit: float = 1e8) -> tuple[np.ndarray, float]:
    """(matrix, how much): a with a growing diagonal, + on the first `positive` rows and - on the others, until its inertia fits."""
    sign = np.concatenate([np.ones(positive), -np.ones(negative)])
    amount = 0.0
    while inertia(a + np.diag(amount * sign))[:2] != (positive, negative):
        amount = max(start, amount * grow)
        if amount > limit:
            raise np.linalg.LinAlgError("no regularisation gives the inertia")
    return a + np.diag(amount * sign), amount


def refined(a: np.ndarray, b: np.ndarray, factor: np.ndarray | None = None, rounds: int = 3) -> np.ndarray:
    """a x = b by a factor of a nearby matrix and iterative refinement."""
    inverse = np.linalg.inv(a if factor is None else factor)
    x = inverse @ b
    for _ in range(rounds):
        x = x + inverse @ (b - a @ x)
    return x


def _combine(alpha: float, x: DataFrame, beta: float, y: DataFrame) -> DataFrame:
    return x.select("id", (alpha * F.col("v")).alias("v")).unionByName(y.select("id", (beta * F.col("v")).alias("v"))).groupBy("id").agg(F.sum("v").alias("v"))


def _dot(x: DataFrame, y: DataFrame) -> float:
    return float(x.join(y.withColumnRenamed("v", "w"), "id").agg(F.sum(F.col("v") * F.col("w"))).first()[0] or 0.0)


def matrix_map(nnz: DataFrame) -> Map:
    """v -> A v of a matrix (row_id, col_id, val)."""
    return lambda x: nnz.join(x.select(F.col("id").alias("col_id"), "v"), "col_id").groupBy(F.col("row_id").alias("id")).agg(F.sum(F.col("val") * F.col("v")).alias("v"))


def conjugate_gradient(a: Map, b: DataFrame, tol: float = 1e-8, limit: int = 200, precondition: Map | None = None) -> tuple[DataFrame, int, float]:
    """(x, iterations, residual) for a symmetric positive map; vectors are written out every round."""
    m = precondition or (lambda r: r)
    x, r = b.select("id", F.lit(0.0).alias("v")), checkpoint(b)
    z = checkpoint(m(r))
    p, rz = z, _dot(r, z)
    goal = tol * max(_dot(b, b) ** 0.5, 1e-300)
    for k in range(limit):
        size = _dot(r, r) ** 0.5
        if size <= goal:
            return x, k, size
        ap = checkpoint(a(p))
        alpha = rz / _dot(p, ap)
        x, r = checkpoint(_combine(1.0, x, alpha, p)), checkpoint(_combine(1.0, r, -alpha, ap))
        z = checkpoint(m(r))
        rz, before = _dot(r, z), rz
        p = checkpoint(_combine(1.0, z, rz / before, p))
    return x, limit, _dot(r, r) ** 0.5


def bicgstab(a: Map, b: DataFrame, tol: float = 1e-8, limit: int = 200, precondition: Map | None = None) -> tuple[DataFrame, int, float]:
    """(x, iterations, residual) for any regular map; stops when a step no longer divides safely."""
    m = precondition or (lambda v: v)
    x, r = b.select("id", F.lit(0.0).alias("v")), checkpoint(b)
    shadow, p = r, r
    rho = _dot(shadow, r)
    goal = tol * max(_dot(b, b) ** 0.5, 1e-300)
    for k in range(limit):
        size = _dot(r, r) ** 0.5
        if size <= goal or abs(rho) < 1e-300:
            return x, k, size
        ph = checkpoint(m(p))
        v = checkpoint(a(ph))
        alpha = rho / _dot(shadow, v)
        s = checkpoint(_combine(1.0, r, -alpha, v))
        sh = checkpoint(m(s))
        t = checkpoint(a(sh))
        tt = _dot(t, t)
        omega = _dot(t, s) / tt if tt else 0.0
        x = checkpoint(_combine(1.0, _combine(1.0, x, alpha, ph), omega, sh))
        r = checkpoint(_combine(1.0, s, -omega, t))
        new = _dot(shadow, r)
        if not omega:
            return x, k + 1, _dot(r, r) ** 0.5
        p = checkpoint(_combine(1.0, r, new / rho * alpha / omega, _combine(1.0, p, -omega, v)))
        rho = new
    return x, limit, _dot(r, r) ** 0.5
