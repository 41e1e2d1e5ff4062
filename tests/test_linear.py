import numpy as np
import pytest
from lp_fixtures import build

from blockloom.operators import linear, presolve
from blockloom.operators.ipm import solve


def test_inertia_and_regularisation():
    a = np.block([[np.eye(2), np.ones((2, 2))], [np.ones((2, 2)), np.zeros((2, 2))]])
    assert linear.inertia(a) == (2, 1, 1)
    fixed, amount = linear.regularized(a, 2, 2)
    assert amount > 0 and linear.inertia(fixed) == (2, 2, 0)
    good, b = a + 3 * np.eye(4), np.arange(4.0)
    assert np.allclose(linear.refined(good, b, good + 1e-3 * np.eye(4)), np.linalg.solve(good, b))


@pytest.mark.parametrize("method", [linear.conjugate_gradient, linear.bicgstab])
def test_krylov(spark, method):
    n = 4
    dense = np.diag(np.arange(2.0, 2 + n)) + 0.5
    nnz = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(n) for j in range(n)], "row_id long, col_id long, val double")
    b = spark.createDataFrame([(i, float(i + 1)) for i in range(n)], "id long, v double")
    x, rounds, residual = method(linear.matrix_map(nnz), b)
    got = np.array([r.v for r in sorted(x.collect(), key=lambda r: r.id)])
    assert rounds <= n + 1 and residual < 1e-6 and np.allclose(got, np.linalg.solve(dense, np.arange(1.0, n + 1)))


def test_nearly_parallel_rows(spark):
    cols = {"x": (0, 1, 0.0, 10.0), "y": (0, 1, 0.0, 10.0), "s": (0, 1, 0.0, 4.0), "t": (0, 2, 1.0, 9.0)}
    rows = [("EQ", 0, {"x": 1, "y": 2, "s": 1}, 6.0, 6.0), ("EQ", 0, {"x": -2, "y": -4, "t": 1}, -5.0, -5.0)]
    p, n = build(spark, cols, rows)
    (pair,) = presolve.nearly_parallel_rows(p).collect()
    assert (pair.row1, pair.row2, pair.col1, pair.col2) == (0, 1, n["s"], n["t"])
    assert abs(pair.slope + 2) < 1e-9 and abs(pair.shift - 7) < 1e-9
    q = presolve.substitute_nearly_parallel(p, presolve.nearly_parallel_rows(p))
    assert abs(solve(q).objective - solve(p).objective) < 1e-4
