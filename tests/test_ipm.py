import pytest
from lp_fixtures import parallel_equalities, two_scenarios

from blockloom.operators import presolve
from blockloom.operators.ipm import solve


@pytest.mark.parametrize(("fixture", "optimum"), [(two_scenarios, 14.0), (parallel_equalities, -12.0)])
def test_known_optima(spark, fixture, optimum):
    p, _ = fixture(spark)
    s = solve(p, mu_tolerance=1e-7, residual_tolerance=1e-6)
    assert s.status == "optimal" and abs(s.objective - optimum) < 1e-3 and s.iterations <= 25


def test_parallel_rows_go_without_moving_the_optimum(spark):
    p, _ = parallel_equalities(spark)
    assert {(r.kept_row, r.n_rows) for r in presolve.parallel_rows(p.system("EQ")).collect()} == {(0, 2), (7, 2), (9, 2)}
    smaller = presolve.drop_parallel_rows(p)
    assert smaller.rows.where("system = 'EQ'").count() == 14
    assert abs(solve(smaller, mu_tolerance=1e-7, residual_tolerance=1e-6).objective + 12) < 1e-3
