"""Two small problems with known optima.

Fixed values: entries, sides, bounds and costs of two published test problems for block-structured
solvers, stated plainly so that their published optima hold.
"""

from blockloom.plans.lp import COLS, NNZ, ROWS, Problem


def build(spark, cols, rows):
    """cols: name -> (block, cost, lb, ub); rows: (system, block, {name: value}, lo, hi)."""
    names = {n: k for k, n in enumerate(cols)}
    c = [(names[n], b, float(cost), lb, ub) for n, (b, cost, lb, ub) in cols.items()]
    r, z, count = [], [], {"EQ": 0, "INEQ": 0}
    for system, block, terms, lo, hi in rows:
        k = count[system]
        count[system] += 1
        r.append((system, k, block, lo, hi))
        z += [(system, k, names[n], float(v), block, cols[n][0]) for n, v in terms.items()]
    return Problem(spark.createDataFrame(c, COLS), spark.createDataFrame(r, ROWS), spark.createDataFrame(z, NNZ)), names


def two_scenarios(spark):
    """Optimum 14."""
    cols = {n: (b, 2, 0.0, None) for n, b in [("a0", 0), ("a1", 0), ("p0", 1), ("p1", 1), ("q0", 2), ("q1", 2), ("q2", 2), ("q3", 2)]}
    eq = [(0, {"a0": 2}, 2), (0, {"a1": 7}, 7), (1, {"a0": 2, "p0": 1}, 3), (1, {"a1": 5, "p1": 2}, 7), (2, {"a0": 2}, 2), (2, {"a1": 4, "q1": 3}, 7), (-1, {"a0": 1, "a1": 1, "p0": 1, "p1": 1, "q1": 1, "q3": 1}, 6), (-1, {"a0": 1, "p0": 1, "q2": 1, "q3": 1}, 4)]
    le = [(0, {"a0": 2}, 5), (1, {"a0": 2, "p0": 3}, 5), (2, {"a0": 2, "q0": 3}, 5), (-1, {"a0": 1, "p0": 1, "q0": 1}, 4)]
    return build(spark, cols, [("EQ", b, t, float(v), float(v)) for b, t, v in eq] + [("INEQ", b, t, None, float(v)) for b, t, v in le])


def parallel_equalities(spark):
    """Optimum -12; rows 1, 10 and 11 of the equalities are parallel to others."""
    stage = {5: 1, 6: 1, 7: 1, 8: 2, 9: 2, 10: 2, 11: 3, 12: 3, 13: 3}
    cols = {f"j{k}": (stage.get(k, 0), 0 if k == 1 else 1, -5.0 if k == 2 else None, None) for k in range(1, 14)}
    eq = [
        (0, {2: -6, 3: -4, 4: 2}, -2), (0, {2: 3, 3: 2, 4: -1}, 1), (0, {2: 2, 3: -2, 4: 4}, -2), (0, {2: -1, 3: 0.5, 4: -1}, 0),
        (1, {2: 1, 3: 1, 5: 3, 6: 2, 7: -1}, 0), (1, {5: 2, 6: -2, 7: 4}, -2), (1, {5: -1, 6: 0.5, 7: -1}, 0),
        (2, {8: 3, 9: 2, 10: -1}, 1), (2, {2: 1, 4: 1, 8: 2, 9: -2, 10: 4}, -3), (2, {3: 1, 8: -1, 9: 0.5, 10: -1}, -2), (2, {3: 10, 8: -10, 9: 5, 10: -10}, -20), (2, {8: -30, 9: -20, 10: 10}, -10),
        (3, {11: 3, 12: 2, 13: -1}, 1), (3, {2: 1, 3: -1, 11: 2, 12: -2, 13: 4}, 1), (3, {3: 1, 4: 1, 11: -1, 12: 0.5, 13: -1}, -4),
        (-1, {5: 1, 6: 1, 7: 1, 8: 1, 9: 1}, -4), (-1, {1: 1, 2: 1, 3: 1, 6: 1, 11: 1}, -1),
    ]
    le = [(0, {1: -1}, 0), (0, {2: 1}, 100), (0, {3: 1}, 100), (0, {4: 1}, 100), (1, {5: 1}, 100), (1, {6: 1}, 100), (1, {7: 1}, 100), (2, {8: 1}, 100), (2, {9: 1}, 100), (2, {10: 1}, 100), (3, {13: 1}, 100), (3, {12: 1}, 100), (3, {13: 1}, 100), (-1, {2: 1, 3: 1, 6: 1, 10: 1}, 100), (-1, {2: 1, 6: 1, 9: 1}, 100)]
    name = lambda t: {f"j{k}": v for k, v in t.items()}
    return build(spark, cols, [("EQ", b, name(t), float(v), float(v)) for b, t, v in eq] + [("INEQ", b, name(t), None, float(v)) for b, t, v in le])
