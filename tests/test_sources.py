import pytest
from lp_fixtures import parallel_equalities, two_scenarios

from blockloom.operators.ipm import solve
from blockloom.plans import lp
from blockloom.sources import blocks, mps, options

TEXT = """* a comment
NAME          SMALL
ROWS
 N  COST
 L  LIM1
 G  LIM2
 E  MYEQN
COLUMNS
    X         COST         1.0   LIM1         1.0
    X         LIM2         1.0
    Y         COST         2.0   LIM1         1.0
    Y         MYEQN       -1.0
    Z         COST        -1.0   MYEQN        1.0
RHS
    RHS       COST       -3.0    LIM1         4.0
    RHS       LIM2         1.0   MYEQN        7.0
    OTHER     LIM1        99.0
RANGES
    RNG       LIM1         2.5
BOUNDS
 UP BND       X            4.0
 LO BND       Y           -1.0
 UP BND       Y            1.0
 FR BND       Z
ENDATA
"""


def test_read(spark, tmp_path):
    (tmp_path / "a.mps").write_text(TEXT)
    p, rows, cols = mps.read(spark, str(tmp_path / "a.mps"))
    assert p.offset == 3.0
    assert [tuple(r) for r in p.cols.orderBy("col_id").collect()] == [(0, 0, 1.0, 0.0, 4.0), (1, 0, 2.0, -1.0, 1.0), (2, 0, -1.0, None, None)]
    assert [tuple(r) for r in p.rows.orderBy("system", "row_id").collect()] == [("EQ", 0, 0, 7.0, 7.0), ("INEQ", 0, 0, 1.5, 4.0), ("INEQ", 1, 0, 1.0, None)]
    assert p.nnz.count() == 5 and rows.count() == 3 and cols.count() == 3


@pytest.mark.parametrize("change", [(" LO BND       Y           -1.0", " LO BND       Y           5.0"), (" FR BND       Z", " UP BND       X            3.0"), ("    OTHER     LIM1        99.0", "    RHS       LIM1        99.0")])
def test_contradictions(spark, tmp_path, change):
    (tmp_path / "b.mps").write_text(TEXT.replace(*change))
    with pytest.raises(mps.MpsError):
        mps.read(spark, str(tmp_path / "b.mps"))


def test_round_trip(spark, tmp_path):
    p, _ = parallel_equalities(spark)
    (tmp_path / "c.mps").write_text("\n".join(r.line for r in mps.text(p).collect()) + "\n")
    q, _, _ = mps.read(spark, str(tmp_path / "c.mps"))
    for table, keys in (("cols", ["col_id", "cost", "lb", "ub"]), ("rows", ["system", "row_id", "lo", "hi"]), ("nnz", ["system", "row_id", "col_id", "val"])):
        a, b = (getattr(x, table).select(*keys).collect() for x in (p, q))
        assert sorted(map(str, a)) == sorted(map(str, b))


def test_parquet_blocks_and_callbacks(spark, tmp_path):
    p, _ = two_scenarios(spark)
    lp.write(p, str(tmp_path / "p"))
    back = lp.read(spark, str(tmp_path / "p"))
    assert lp.read_block(back, 2).nnz.count() == p.nnz.where("row_block = 2").count()
    tables = {n: [tuple(r) for r in getattr(p, n).collect()] for n in ("cols", "rows", "nnz")}
    of = lambda n, at: lambda b: (r for r in tables[n] if max(r[at], 0) == b)
    q = blocks.from_callbacks(spark, 3, of("cols", 1), of("rows", 2), of("nnz", 4))
    assert abs(solve(q).objective - 14) < 1e-4


def test_options(spark, tmp_path):
    (tmp_path / "o").write_text("# all\nROUNDS 5 int\nTOL 1e-3 double // small\nON true bool\n")
    assert options.load(spark, str(tmp_path / "o"), {"ROUNDS": 2, "TOL": 1e-6, "ON": False}) == {"ROUNDS": 5, "TOL": 1e-3, "ON": True}


def test_a_quadratic_objective_is_read_or_refused(spark, tmp_path):
    import pytest

    from blockloom.sources import mps

    path = tmp_path / "q.mps"
    path.write_text("NAME q\nROWS\n N obj\n E r\nCOLUMNS\n x obj 1 r 1\n y r 1\nRHS\n s r 2\nQUADOBJ\n x x 2\n x y -1\nENDATA\n")
    with pytest.raises(mps.MpsError):
        mps.read(spark, str(path))
    p, _, cols = mps.read(spark, str(path), linear=False)
    assert sorted(tuple(r) for r in mps.quadratic(spark, str(path), cols).collect()) == [(0, 0, 2.0), (1, 0, -1.0)]
    x = spark.createDataFrame([(0, 1.5)], "col_id long, x double")
    assert sorted(r.line for r in mps.solution(x, cols).collect()) == ["x 1.5", "y unset"]


def test_a_python_data_source_and_csv_files(spark, tmp_path):
    from blockloom.sources import tables

    p = tables.from_callback(spark, 2, "tests.callback_block:callback_rows")
    assert sorted(tuple(r) for r in p.cols.collect()) == [(0, 0, 1.0, 0.0, None), (1, 1, 2.0, 0.0, None)]
    s = solve(p)
    assert abs(s.objective - 1.5) < 1e-4
    for t in ("cols", "rows", "nnz"):
        getattr(p, t).write.csv(f"{tmp_path}/{t}.csv", header=True)
    q = tables.read_csv(spark, str(tmp_path))
    assert all(sorted(map(tuple, getattr(p, t).collect())) == sorted(map(tuple, getattr(q, t).collect())) for t in ("cols", "rows", "nnz"))
    tables.write_solution(p, s.iterate, s.status, f"{tmp_path}/out")
    assert {r.row_id: round(r.marginal, 4) for r in spark.read.parquet(f"{tmp_path}/out/equations").collect()} == {0: 0.25, 1: 0.5}
    with pytest.raises(ValueError):
        tables.write_solution(p, s.iterate, "infeasible", f"{tmp_path}/no")
    (tmp_path / "s.csv").write_text("t,a,b\n1,2.5,x\n2,,4\n")
    assert sorted(map(tuple, tables.read_series(spark, f"{tmp_path}/s.csv", ["t"]).collect()), key=str) == [("1", "a", 2.5), ("1", "b", None), ("2", "a", None), ("2", "b", 4.0)]
    (tmp_path / "i.txt").write_text("# name blocks\n one  4\n\ntwo 8 9\n")
    assert sorted(map(tuple, tables.read_instances(spark, f"{tmp_path}/i.txt", ["name", "blocks"]).collect())) == [("one", "4"), ("two", "8")]


def test_relaxation_like_plain_python(spark):
    from lp_fixtures import build

    from blockloom.operators.lagrange import relax

    cols = {"x": (0, -3, 0.0, 4.0), "y": (0, -2, 0.0, 5.0), "z": (0, 1, 1.0, 2.0)}
    rows = [("INEQ", 0, {"x": 1, "y": 1}, None, 6.0), ("EQ", 0, {"x": 1, "z": 1}, 4.0, 4.0)]
    p, _ = build(spark, cols, rows)
    got = relax(p, 12, 2.0)
    y, bounds = [0.0, 0.0], []
    for k in range(12):
        r = {"x": -3 - y[0] - y[1], "y": -2 - y[0], "z": 1 - y[1]}
        x = {n: cols[n][2] if r[n] > 0 else cols[n][3] if r[n] < 0 else cols[n][2] for n in cols}
        bounds.append(sum(r[n] * x[n] for n in cols) + y[0] * 6 + y[1] * 4)
        v = [x["x"] + x["y"], x["x"] + x["z"]]
        g = [(6 - v[0]) if y[0] < 0 else -max(v[0] - 6, 0), (4 - v[1]) if y[1] else max(4 - v[1], 0) - max(v[1] - 4, 0)]
        norm = sum(a * a for a in g) ** 0.5
        if not norm:
            break
        y = [min(y[0] + 2 / (k + 1) / norm * g[0], 0.0), y[1] + 2 / (k + 1) / norm * g[1]]
    assert got.bounds == pytest.approx(bounds) and got.bound == pytest.approx(max(bounds))
    assert got.bound <= solve(p).objective + 1e-4
