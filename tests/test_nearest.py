import random

import pytest

import __spark_entry__ as entry
from blockloom.operators import timeseries


def brute(rows, k):
    rows = [r for r in rows if r[1] is not None]
    out = set()
    for i, x in rows:
        near = sorted((abs(x - y), j) for j, y in rows if j != i)[:k]
        out |= {(i, j, d, n + 1) for n, (d, j) in enumerate(near)}
    return out


@pytest.mark.parametrize("together", [20_000, 7])
def test_nearest_like_brute_force(spark, monkeypatch, together):
    """Empty stretches of the axis, many points at one place, ties on both sides, no coordinate."""
    monkeypatch.setattr(timeseries, "RANGE_ROWS", together)
    rng = random.Random(3)
    places = [0.0, 50000.0, -7000.0, *(float(rng.randint(-300, 300)) for _ in range(60)), *[12.0] * 20, None]
    rows = list(enumerate(places))
    rng.shuffle(rows)
    for few in (rows, rows[:2], rows[:1]):
        df = spark.createDataFrame(few, "id long, x double")
        assert {(r.id, r.other, r.distance, r["rank"]) for r in timeseries.nearest_on_axis(df, 3, "x").collect()} == brute(few, 3)


def test_query_ranks_all_points(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_acctbal").collect()]
    want = {(min(i, j), max(i, j)) for i, j, _, _ in brute(rows, 3)}
    assert {tuple(r) for r in entry.queries()["nearest_symmetric"](spark, sf).collect()} == want


@pytest.mark.parametrize("cell", [3.0, 500.0])
def test_nearest_in_the_plane_like_brute_force(spark, cell):
    rng = random.Random(5)
    rows = [(k, rng.uniform(0, 40), rng.uniform(0, 40)) for k in range(40)] + [(100, 4000.0, 0.0), (101, None, 1.0), (102, 1.0, 1.0), (103, 1.0, 1.0)]
    want = set()
    there = [r for r in rows if r[1] is not None]
    for i, x, y in there:
        near = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, a, b in there if j != i)[:3]
        want |= {(i, j, n + 1) for n, (_, j) in enumerate(near)}
    df = spark.createDataFrame(rows, "id long, x double, y double")
    assert {(r.id, r.other, r["rank"]) for r in timeseries.nearest_exact(df, 3, ["x", "y"], cell).collect()} == want
