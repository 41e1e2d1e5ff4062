import random

import pytest
from lp_fixtures import build, parallel_equalities, two_scenarios
from pyspark.sql import functions as F

from blockloom.operators import postsolve, presolve, scaling, structure
from blockloom.operators.ipm import solve


@pytest.mark.parametrize(("fixture", "optimum"), [(two_scenarios, 14.0), (parallel_equalities, -12.0)])
def test_presolve_and_back(spark, fixture, optimum):
    p, _ = fixture(spark)
    done = postsolve.presolve(p)
    assert done.problem.cols.count() <= p.cols.count()
    s = solve(done.problem, mu_tolerance=1e-9, residual_tolerance=1e-8)
    assert abs(s.objective - optimum) < 1e-3
    x = postsolve.postsolve(done, s.x)
    assert x.count() == p.cols.count()
    assert postsolve.violations(p, x, 1e-4).count() == 0
    assert abs(p.cols.join(x, "col_id").agg(F.sum(F.col("cost") * F.col("x"))).first()[0] - optimum) < 1e-3


def test_rules(spark):
    cols = {"a": (0, 1, 0.0, 4.0), "b": (0, -1, None, 3.0), "c": (0, 0, 2.0, 2.0), "d": (0, 0, None, None), "e": (0, 0, None, -1.0)}
    rows = [("INEQ", 0, {"a": 2, "b": -1}, None, 5.0), ("INEQ", 0, {"a": -3}, -6.0, None), ("INEQ", 0, {"a": 1, "c": 1}, None, 100.0), ("EQ", 0, {"c": 2, "d": 4}, 8.0, 8.0), ("INEQ", 0, {"a": 1}, 9.0, None)]
    p, n = build(spark, cols, rows)
    act = {(r.system, r.row_id): tuple(r)[2:] for r in presolve.activities(p).collect()}
    assert act[("INEQ", 0)] == (-3.0, 0, 8.0, 1) and act[("EQ", 0)] == (4.0, 1, 4.0, 1)
    status = {(r.system, r.row_id): r.status for r in presolve.row_status(p).collect()}
    assert status == {("INEQ", 0): "needed", ("INEQ", 1): "needed", ("INEQ", 2): "redundant", ("INEQ", 3): "infeasible", ("EQ", 0): "needed"}
    bounds = {r.col_id: (r.lb, r.ub) for r in presolve.singleton_row_bounds(p).collect()}
    assert bounds == {n["a"]: (9.0, 2.0)}
    assert {(r.col_id, r.value) for r in presolve.fixed_columns(p).collect()} == {(n["c"], 2.0)}
    assert {(r.col_id, r.value, r.status) for r in presolve.empty_columns(p).collect()} == {(n["e"], -1.0, "fixed")}
    assert {r.col_id: r.action for r in presolve.singleton_columns(p).collect()}[n["d"]] == "substitute"
    fixed = presolve.fix(p, spark.createDataFrame([(n["c"], 2.0)], "col_id long, value double"))
    assert {(r.system, r.row_id): r.hi for r in fixed.rows.collect()}[("EQ", 0)] == 4.0


def test_scaling_keeps_the_optimum(spark):
    p, _ = two_scenarios(spark)
    r, c = scaling.geometric_mean(p.system("EQ").nnz, rounds=2, fixed=True, equilibrate=True)
    assert all(0.01 < x.s < 100 for x in r.collect())
    ones = p.rows.where("system = 'EQ'").select("row_id").withColumn("s", F.lit(1.0))
    q = scaling.apply(p, ones, c)
    s = solve(q)
    assert abs(s.objective - 14) < 1e-4
    assert abs(scaling.unscale(s.x, c).join(p.cols, "col_id").agg(F.sum(F.col("cost") * F.col("x"))).first()[0] - 14) < 1e-4


def plain_order(blocks, start):
    """Rows that fit into one subtree first, in their order, then the others."""
    last = len(blocks) - 1
    low = [k for k, b in enumerate(start) if b >= 0 and blocks[b] == blocks[min(b + 1, last)]]
    return low + [k for k in range(len(start)) if k not in low]


@pytest.mark.parametrize("seed", range(8))
def test_order_after_split(seed):
    rng = random.Random(seed)
    blocks = sorted(rng.choices(range(4), k=rng.randint(2, 9)))
    start = sorted(rng.choices(range(len(blocks)), k=12)) + [-1] * rng.randint(0, 3)
    order = plain_order(blocks, start)
    up = [k for k, b in enumerate(start) if b < 0 or blocks[b] != blocks[min(b + 1, len(blocks) - 1)]]
    assert structure.order_after_split(blocks, start, len(up)) == order
    with pytest.raises(ValueError):
        structure.order_after_split(blocks, start, len(up) + 1)


def test_a_link_of_the_last_block_goes_down():
    assert structure.order_after_split([0, 1], [0, 1], 1) == [1, 0]


def test_contradicting_parallel_rows_are_infeasible(spark):
    cols = {"x": (0, 1, 0.0, None), "y": (0, 1, 0.0, None)}
    p, _ = build(spark, cols, [("EQ", 0, {"x": 1, "y": 1}, 3.0, 3.0), ("EQ", 0, {"x": 2, "y": 2}, 8.0, 8.0)])
    with pytest.raises(ValueError):
        presolve.drop_parallel_rows(p)
    with pytest.raises(ValueError):
        postsolve.presolve(p)


def test_small_entries_imply_bounds_and_only_worthy_ones_are_taken(spark):
    cols = {"x": (0, 1, 0.0, None), "y": (0, 1, 0.0, 5.0), "z": (0, 1, 0.0, 9.0)}
    p, n = build(spark, cols, [("INEQ", 0, {"x": 1e-4, "y": 1}, None, 2.0), ("INEQ", 0, {"y": 1e-8, "z": 1}, None, 9.0)])
    bounds = {r.col_id: r.ub for r in presolve.implied_bounds(p).collect()}
    assert bounds[n["x"]] == pytest.approx(2e4) and bounds[n["y"]] == pytest.approx(2.0) and bounds[n["z"]] == pytest.approx(9.0)
    assert {r.col_id: r.ub for r in presolve.accepted_bounds(p, presolve.implied_bounds(p)).collect()} == {n["x"]: pytest.approx(2e4), n["y"]: pytest.approx(2.0)}


def test_rows_of_one_id_in_both_systems_are_two_rows(spark):
    nnz = spark.createDataFrame([("EQ", 0, 0, 1000.0, 0, 0), ("INEQ", 0, 1, 0.001, 0, 1)], "system string, row_id long, col_id long, val double, row_block int, col_block int")
    r, _ = scaling.equilibrium(nnz)
    assert {(x.system, x.s) for x in r.collect()} == {("EQ", 0.001), ("INEQ", 1000.0)}
    assert {(x.system, x.kind) for x in structure.row_links(nnz).collect()} == {("EQ", "local"), ("INEQ", "local")}


PARTLY = {"x": (0, 1, 0.0, 10.0), "y": (0, 1, 0.0, 10.0), "s": (0, 1, 0.0, 4.0), "t": (0, 1, 0.0, 4.0)}


@pytest.mark.parametrize("rows", [
    [("EQ", 0, {"x": 1, "y": 2, "s": 1}, 6.0, 6.0), ("EQ", 0, {"x": 2, "y": 4}, 8.0, 8.0)],
    [("EQ", 0, {"x": 1, "y": 2, "s": 1}, 6.0, 6.0), ("INEQ", 0, {"x": -1, "y": -2}, -5.0, -3.0)],
    [("INEQ", 0, {"x": -1, "y": -2, "s": -1}, None, -6.0), ("INEQ", 0, {"x": -2, "y": -4, "t": -2}, None, -12.0)],
])
def test_nearly_parallel_rows_of_all_kinds(spark, rows):
    p, _ = build(spark, PARTLY, rows)
    want = solve(p).objective
    done = postsolve.presolve(p, strengthen=0)
    reduced = solve(done.problem) if done.problem.cols.limit(1).count() else None
    assert abs((reduced.objective if reduced else done.problem.offset) - want) < 1e-4
    assert done.problem.rows.count() < len(rows)
    x = postsolve.postsolve(done, reduced.x if reduced else spark.createDataFrame([], "col_id long, x double"))
    assert x.count() == len(PARTLY) and postsolve.violations(p, x, 1e-4).count() == 0
    assert abs(p.cols.join(x, "col_id").agg(F.sum(F.col("cost") * F.col("x"))).first()[0] - want) < 1e-3
