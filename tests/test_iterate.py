"""What the solver returns: optimality by residuals and complementarity, and the step functions on small numbers."""

import pytest
from lp_fixtures import build, parallel_equalities, two_scenarios

from blockloom.operators import iterate as I
from blockloom.operators.ipm import solve


@pytest.mark.parametrize(("fixture", "optimum"), [(two_scenarios, 14.0), (parallel_equalities, -12.0)])
def test_solutions_have_duals(spark, fixture, optimum):
    p, _ = fixture(spark)
    s = solve(p, mu_tolerance=1e-9, residual_tolerance=1e-8)
    it = s.iterate
    assert I.unset(it, p).count() == 0
    assert I.not_complementary(it, 1e-5).count() == 0
    assert I.residual_norm(p, it).first()["norm"] < 1e-4
    o = I.objectives(p, it).first()
    assert abs(o["primal"] - optimum) < 1e-3 and abs(o["gap"]) < 1e-3
    assert I.violation(it).first()["violation"] < 1e-6


def test_a_fixed_column_has_the_dual_of_its_reduced_cost(spark):
    p, n = build(spark, {"x": (0, 1, 0.0, None), "y": (0, 5, 2.0, 2.0)}, [("EQ", 0, {"x": 1, "y": 1}, 6.0, 6.0)])
    it = solve(p, mu_tolerance=1e-10).iterate
    y = {r.col_id: r for r in it.cols.collect()}[n["y"]]
    assert y.x == 2.0 and abs(y.gamma - 4.0) < 1e-5 and abs(y.phi) < 1e-5


@pytest.fixture
def small(spark):
    cols = spark.createDataFrame([(0, 1.0, 1.0, 4.0, 0.5, 0.25), (1, 2.0, 2.0, None, 1.0, None)], "col_id long, x double, v double, w double, gamma double, phi double")
    rows = spark.createDataFrame([("INEQ", 0, 3.0, 0.5, None, 2.0, None, 0.5), ("EQ", 0, None, 1.0, None, None, None, None)], "system string, row_id long, s double, y double, t double, u double, lam double, pi double")
    step_cols = spark.createDataFrame([(0, -2.0, -2.0, 2.0, 0.5, -1.0), (1, 1.0, 1.0, None, -4.0, None)], "col_id long, x double, v double, w double, gamma double, phi double")
    step_rows = spark.createDataFrame([("INEQ", 0, 1.0, 0.5, None, -1.0, None, 0.5), ("EQ", 0, None, 1.0, None, None, None, None)], "system string, row_id long, s double, y double, t double, u double, lam double, pi double")
    return I.Iterate(cols, rows), I.Iterate(step_cols, step_rows)


def test_steps(small):
    it, step = small
    assert I.mu(it).first()["mu"] == pytest.approx((0.5 + 1.0 + 2.0 + 1.0) / 4)
    b = I.step_bounds(it, step).first()
    assert (b["primal"], b["dual"]) == (0.5, 0.25)
    found = {r["side"]: r for r in I.blocking(it, step).collect()}
    assert (found["primal"]["family"], found["primal"]["id"], found["dual"]["family"], found["dual"]["id"], found["dual"]["ratio"]) == ("v", 0, "v", 1, 0.25)
    assert I.mu_after(it, step, 0.5, 0.25).first()["mu"] == pytest.approx((0 + 0 + 5 * 0 + 1.5 * 0.625) / 4)
    moved = I.stepped(it, step, 0.5, 0.25)
    assert I.mu(moved).first()["mu"] == pytest.approx(I.mu_after(it, step, 0.5, 0.25).first()["mu"])
    alpha, beta = I.mehrotra_lengths(it, step)
    assert 0.99 * 0.5 <= alpha <= 0.5 and 0.99 * 0.25 <= beta <= 0.25
    best = I.best_weights(I.weight_candidates(it, step, step, 0.0, 4)).first()
    assert (best["primal_weight"], best["primal"], best["dual"]) == (0.0, 0.5, 0.25)


def test_filter_and_probing():
    front = I.filter_add([], 1.0, 5.0)
    front = I.filter_add(front, 2.0, 3.0)
    assert I.filter_add(front, 2.0, 6.0) == front == [(1.0, 5.0), (2.0, 3.0)]
    assert I.filter_add(front, 0.5, 2.0) == [(0.5, 2.0)]
    assert not I.accepted((2.0, 3.0), (3.0, 4.0), 1.0, front)
    assert I.accepted((2.0, 3.0), (0.5, 2.9), 0.0, front)
    assert not I.accepted((0.0, 3.0), (0.0, 3.0 - 1e-9), 1.0, [])
    assert I.probing_factor(1.0, 5.0, 1.0, 2.0) == 1.0
    assert I.probing_factor(1.0, 19.0, 1.0, 2.0) == pytest.approx(0.9995 * 0.5)
    assert I.poor_step(1e-5, False) and not I.poor_step(5e-5, True)
    assert I.predicted_reduction(-2.0, 0.5) == 1.0 and I.centering(2.0, 1.0) == 0.125
