import math

import pytest

import __spark_entry__ as entry
from blockloom.operators import scaling
from blockloom.plans.lp import from_orders

ENTRIES = {(0, 0): 2.0, (0, 1): 900.0, (1, 1): -0.01, (1, 2): 3.0, (2, 0): 7.0, (2, 2): 4000.0, (3, 1): 0.5}


@pytest.fixture
def nnz(spark):
    return spark.createDataFrame([(i, j, v) for (i, j), v in ENTRIES.items()], "row_id long, col_id long, val double")


def test_append_rows_takes_every_row(spark, sf):
    whole = {(r.row_id, r.col_id, r.val) for r in from_orders(spark, sf).nnz.collect()}
    assert max(i for i, _, _ in whole) >= 50
    got = [tuple(r) for r in entry.queries()["append_rows"](spark, sf).collect()]
    assert len(got) == 2 * len(whole) and set(got) == whole | {(i + 1_000_000, j, 2 * v) for i, j, v in whole}


def scaled(r, c):
    out = {}
    for (i, j), v in ENTRIES.items():
        out.setdefault(i, []).append(abs(v) * r[i] * c[j])
    return max(max(v) / min(v) for v in out.values())


def by_rounds(rounds, stops):
    """Geometric-mean factors by the definition, with the ratio test if stops."""
    r, c = {i: 1.0 for i, _ in ENTRIES}, {j: 1.0 for _, j in ENTRIES}
    last = scaled(r, c)
    if stops and last <= 500:
        return r, c
    for _ in range(rounds):
        for mine, other, at in ((r, c, 0), (c, r, 1)):
            for k in mine:
                v = [abs(x) * other[e[1 - at]] for e, x in ENTRIES.items() if e[at] == k]
                mine[k] = 1 / math.sqrt(min(v) * max(v))
        now = scaled(r, c)
        if stops and now > 0.85 * last:
            break
        last = now
    return r, c


def test_geometric_mean_by_its_own_rounds(nnz):
    r, c = scaling.geometric_mean(nnz)
    want = by_rounds(10, True)
    assert {x.row_id: x.s for x in r.collect()} == pytest.approx(want[0]) and {x.col_id: x.s for x in c.collect()} == pytest.approx(want[1])


def test_curtis_reid_by_its_own_rounds(nnz):
    r, c = scaling.curtis_reid(nnz)
    logs = {e: math.log2(abs(v)) for e, v in ENTRIES.items()}
    x, y = {i: 0.0 for i, _ in ENTRIES}, {j: 0.0 for _, j in ENTRIES}
    for _ in range(10):
        for i in x:
            v = [w - y[b] for (a, b), w in logs.items() if a == i]
            x[i] = sum(v) / len(v)
        for j in y:
            v = [w - x[a] for (a, b), w in logs.items() if b == j]
            y[j] = sum(v) / len(v)
    assert {k.row_id: k.s for k in r.collect()} == pytest.approx({i: 2.0**-v for i, v in x.items()})
    assert {k.col_id: k.s for k in c.collect()} == pytest.approx({j: 2.0**-v for j, v in y.items()})
