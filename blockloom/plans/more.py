"""Further named queries: both systems at once, vectors, iterates, matrices, splits and model data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions import tolerance as tol
from blockloom.operators import iterate as I
from blockloom.operators import matrix as M
from blockloom.operators import presolve as P
from blockloom.operators import scaling, structure, timeseries
from blockloom.operators import vector as V
from blockloom.plans.lp import SQL_MIXED, from_orders_mixed
from blockloom.plans.queries import ORACLE, QUERIES, Query, _r, _t, query
from blockloom.sources import tables


def mixed(sql: str):
    """Registers a query whose SQL reads cols, rows and nnz of the mixed problem."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = f"{SQL_MIXED}{sql}"
        return f

    return register


def _point(p) -> DataFrame:
    return p.cols.select("col_id", (F.col("cost") / 1000).alias("x"))


# --- both systems -------------------------------------------------------------------------------


@mixed("SELECT system, row_id, round(sum(val * (cost / 1000)), 6) AS y FROM nnz JOIN cols USING (col_id) GROUP BY system, row_id")
def spmv_mixed(spark, sf):
    p = from_orders_mixed(spark, sf)
    return M.mult(p.nnz, _point(p)).select("system", "row_id", _r("y", 6).alias("y"))


@mixed("SELECT col_id, round(sum(val * (hi / 1000)), 5) AS x FROM nnz JOIN \"rows\" USING (system, row_id) GROUP BY col_id")
def spmv_transposed_mixed(spark, sf):
    p = from_orders_mixed(spark, sf)
    return M.mult_transposed(p.nnz, p.rows.select(*P.KEY, (F.col("hi") / 1000).alias("y"))).select("col_id", _r("x", 5).alias("x"))


@mixed("SELECT system, row_id, round(0.5 * hi - 2 * coalesce(y, 0), 4) AS y FROM \"rows\" LEFT JOIN (SELECT system, row_id, sum(val * (cost / 1000)) AS y FROM nnz JOIN cols USING (col_id) GROUP BY system, row_id) USING (system, row_id)")
def spmv_axpby_mixed(spark, sf):
    p = from_orders_mixed(spark, sf)
    return M.mult_add(p.nnz, _point(p), p.rows.select(*P.KEY, F.col("hi").alias("y")), 0.5, -2.0).select(*P.KEY, _r("y").alias("y"))


@mixed("SELECT 'row' AS side, system, row_id AS id, 1.0 / max(abs(val)) AS s FROM nnz GROUP BY system, row_id UNION ALL SELECT 'column', NULL, col_id, 1.0 / max(abs(val * s)) FROM nnz JOIN (SELECT system, row_id, 1.0 / max(abs(val)) AS s FROM nnz GROUP BY system, row_id) USING (system, row_id) GROUP BY col_id")
def equilibrium_mixed(spark, sf):
    r, c = scaling.equilibrium(from_orders_mixed(spark, sf).nnz)
    return r.select(F.lit("row").alias("side"), "system", F.col("row_id").alias("id"), "s").unionByName(c.select(F.lit("column").alias("side"), F.lit(None).cast("string").alias("system"), F.col("col_id").alias("id"), "s"))


@mixed("""SELECT 'row' AS side, system, row_id AS id, round(s, 9) AS s FROM r UNION ALL
SELECT 'column', NULL, col_id, round(1 / sqrt(min(abs(val * s)) * max(abs(val * s))), 9) FROM nnz JOIN r USING (system, row_id) GROUP BY col_id""".replace("SELECT 'row'", ", r AS (SELECT system, row_id, 1 / sqrt(min(abs(val)) * max(abs(val))) AS s FROM nnz GROUP BY system, row_id) SELECT 'row'", 1))
def geometric_mean_mixed(spark, sf):
    """One round of geometric-mean factors over both systems."""
    r, c = scaling.geometric_mean(from_orders_mixed(spark, sf).nnz, rounds=1, fixed=True)
    return r.select(F.lit("row").alias("side"), "system", F.col("row_id").alias("id"), _r("s", 9).alias("s")).unionByName(c.select(F.lit("column").alias("side"), F.lit(None).cast("string").alias("system"), F.col("col_id").alias("id"), _r("s", 9).alias("s")))


@mixed(""", r AS (SELECT system, row_id, 1.0 / max(abs(val)) AS s FROM nnz GROUP BY system, row_id)
SELECT system, row_id, round(lo * coalesce(s, 1), 9) AS lo, round(hi * coalesce(s, 1), 9) AS hi, round(total, 6) AS total
FROM "rows" LEFT JOIN r USING (system, row_id) LEFT JOIN (SELECT system, row_id, sum(val * s * c) AS total FROM nnz JOIN r USING (system, row_id) JOIN (SELECT col_id, 1.0 / max(abs(val * s)) AS c FROM nnz JOIN r USING (system, row_id) GROUP BY col_id) USING (col_id) GROUP BY 1, 2) USING (system, row_id)""")
def scaled_rows_mixed(spark, sf):
    """Sides and row sums of the problem after equilibrium scaling."""
    p = from_orders_mixed(spark, sf)
    q = scaling.apply(p, *scaling.equilibrium(p.nnz))
    totals = M.row_sums(q.nnz, lambda v: v)
    return q.rows.join(totals, P.KEY, "left").select(*P.KEY, _r("lo", 9).alias("lo"), _r("hi", 9).alias("hi"), _r("total", 6).alias("total"))


_LINKS = """, links AS (SELECT system, row_id, CAST(count(DISTINCT col_block) AS BIGINT) AS n_blocks, min(col_block) AS first_block, max(col_block) AS last_block FROM nnz GROUP BY 1, 2),
kinds AS (SELECT *, CASE WHEN n_blocks = 1 THEN 'local' WHEN n_blocks = 2 AND last_block = first_block + 1 THEN 'two_link' ELSE 'global' END AS kind FROM links)
"""


@mixed(_LINKS + "SELECT system, row_id, n_blocks, kind, CASE WHEN kind = 'two_link' THEN first_block ELSE -1 END AS start_block FROM kinds")
def row_links_mixed(spark, sf):
    return structure.row_links(from_orders_mixed(spark, sf).nnz).select("system", "row_id", "n_blocks", "kind", "start_block")


@mixed(_LINKS + "SELECT system, row_id, row_number() OVER (ORDER BY CASE kind WHEN 'local' THEN 0 WHEN 'two_link' THEN 1 + first_block ELSE 1000000 END, row_id, system) - 1 AS position FROM kinds")
def link_order_mixed(spark, sf):
    return structure.link_order(structure.row_links(from_orders_mixed(spark, sf).nnz)).select("system", "row_id", "position")


@mixed("SELECT system, row_id, 'empty' AS kind FROM \"rows\" ANTI JOIN nnz USING (system, row_id)")
def empty_rows_mixed(spark, sf):
    p = from_orders_mixed(spark, sf)
    return p.rows.select(*P.KEY).join(M.row_counts(p.nnz), P.KEY, "left_anti").withColumn("kind", F.lit("empty"))


@mixed("""SELECT col_id, min(abs(val)) AS least, max(abs(val)) AS most FROM cols LEFT JOIN nnz USING (col_id) GROUP BY col_id""")
def column_extremes(spark, sf):
    return P.column_extremes(from_orders_mixed(spark, sf))


@mixed("""SELECT block, CAST(count(*) FILTER (kind = 'c') AS BIGINT) AS "columns", CAST(count(*) FILTER (kind = 'EQ') AS BIGINT) AS equalities, CAST(count(*) FILTER (kind = 'INEQ') AS BIGINT) AS inequalities
FROM (SELECT block, 'c' AS kind FROM cols UNION ALL SELECT block, system FROM "rows") GROUP BY block""")
def block_sizes_by_kind(spark, sf):
    return I.block_sizes(from_orders_mixed(spark, sf))


# --- bounds ------------------------------------------------------------------------------------------


_ACT = """, act AS (SELECT system, row_id, sum(val * CASE WHEN val > 0 THEN lb ELSE ub END) AS lo_act, count(*) FILTER ((CASE WHEN val > 0 THEN lb ELSE ub END) IS NULL) AS lo_inf FROM nnz JOIN cols USING (col_id) GROUP BY 1, 2),
up AS (SELECT col_id, min((hi - (coalesce(lo_act, 0) - coalesce(val * lb, 0))) / val) AS b FROM nnz JOIN cols USING (col_id) JOIN act USING (system, row_id) JOIN "rows" USING (system, row_id) WHERE val > 0 AND lo_inf - (CASE WHEN lb IS NULL THEN 1 ELSE 0 END) = 0 GROUP BY col_id)
"""


@mixed(_ACT + "SELECT col_id, round(CASE WHEN abs(b) < 1e-8 THEN 0 ELSE b END, 9) AS ub FROM up JOIN cols USING (col_id) WHERE abs(b) < 1e10 AND (ub IS NULL OR ub - b >= 1e-6)")
def accepted_upper_bounds(spark, sf):
    """Upper bounds that rows with positive entries imply and that are worth taking."""
    p = from_orders_mixed(spark, sf)
    positive = p.nnz.where("val > 0")
    # lower sides and negative entries only help lower bounds or are left to the other queries
    only = p.with_(rows=p.rows.withColumn("lo", F.lit(None).cast("double")))
    implied = P.implied_bounds(only)
    return P.accepted_bounds(p, implied.select("col_id", F.lit(None).cast("double").alias("lb"), "ub")).join(positive.select("col_id").distinct(), "col_id", "left_semi").select("col_id", _r("ub", 9).alias("ub"))


# --- iterates ------------------------------------------------------------------------------------------


def _iterate(spark, sf):
    """A point that satisfies nothing exactly, and a step."""
    p = from_orders_mixed(spark, sf)
    bound = lambda c, v: F.when(F.col(c).isNotNull(), v)
    x = F.col("cost") / 1000
    cols = p.cols.select("col_id", x.alias("x"), bound("lb", x - F.col("lb") + 0.5).alias("v"), bound("ub", F.greatest(F.col("ub") - x, F.lit(0.1))).alias("w"), bound("lb", (1 + F.col("col_id") % 5) / 10).alias("gamma"), bound("ub", (1 + F.col("col_id") % 3) / 10).alias("phi"))
    ineq = F.col("system") == "INEQ"
    side = lambda c, v: F.when(ineq & F.col(c).isNotNull(), v)
    y = F.when(ineq, (F.col("row_id") % 7 - 3) / 100).otherwise((F.col("row_id") % 5 - 2) / 100)
    rows = p.rows.select(*P.KEY, F.when(ineq, F.col("hi") / 2).alias("s"), y.alias("y"), side("lo", F.col("hi") / 4).alias("t"), side("hi", F.col("hi") / 2 + 1).alias("u"), side("lo", (1 + F.col("row_id") % 2) / 8).alias("lam"), side("hi", (1 + F.col("row_id") % 4) / 8).alias("pi"))
    half = lambda df, names, key: df.select(*key, *((F.col(n) * (F.col(key[-1]) % 3 - 1.5)).alias(n) for n in names))
    step = I.Iterate(half(cols, ["x", "v", "w", "gamma", "phi"], ["col_id"]), half(rows, ["s", "y", "t", "u", "lam", "pi"], P.KEY))
    return p, I.Iterate(cols, rows), step


_IT = """, ic AS (SELECT col_id, cost / 1000 AS x, CASE WHEN lb IS NOT NULL THEN cost / 1000 - lb + 0.5 END AS v, CASE WHEN ub IS NOT NULL THEN greatest(ub - cost / 1000, 0.1) END AS w,
  CASE WHEN lb IS NOT NULL THEN (1 + col_id % 5) / 10 END AS gamma, CASE WHEN ub IS NOT NULL THEN (1 + col_id % 3) / 10 END AS phi, cost, lb, ub, block FROM cols
), ir AS (SELECT system, row_id, CASE WHEN system = 'INEQ' THEN hi / 2 END AS s, CASE WHEN system = 'INEQ' THEN (row_id % 7 - 3) / 100 ELSE (row_id % 5 - 2) / 100 END AS y,
  CASE WHEN system = 'INEQ' AND lo IS NOT NULL THEN hi / 4 END AS t, CASE WHEN system = 'INEQ' THEN hi / 2 + 1 END AS u,
  CASE WHEN system = 'INEQ' AND lo IS NOT NULL THEN (1 + row_id % 2) / 8 END AS lam, CASE WHEN system = 'INEQ' THEN (1 + row_id % 4) / 8 END AS pi, lo, hi, block FROM "rows"
), g AS (SELECT * FROM (
  SELECT 't' AS family, system, row_id AS id, t AS gap, lam AS dual FROM ir UNION ALL SELECT 'u', system, row_id, u, pi FROM ir
  UNION ALL SELECT 'v', NULL, col_id, v, gamma FROM ic UNION ALL SELECT 'w', NULL, col_id, w, phi FROM ic) WHERE gap IS NOT NULL
), gs AS (SELECT *, gap * (id % 3 - 1.5) AS gap_step, dual * (id % 3 - 1.5) AS dual_step FROM g
), ax AS (SELECT system, row_id, sum(val * cost / 1000) AS value FROM nnz JOIN cols USING (col_id) GROUP BY 1, 2)
"""


@mixed(_IT + "SELECT round(avg(gap * dual), 6) AS mu, round(avg((gap + 0.25 * gap_step) * (dual + 0.5 * dual_step)), 6) AS mu_after FROM gs")
def average_complementarity(spark, sf):
    p, it, step = _iterate(spark, sf)
    return I.mu(it).select(_r("mu", 6).alias("mu")).crossJoin(I.mu_after(it, step, 0.25, 0.5).select(_r("mu", 6).alias("mu_after")))


@mixed(_IT + "SELECT round(avg(gap * dual), 6) AS mu FROM (SELECT gap + 0.25 * gap_step AS gap, dual + 0.5 * dual_step AS dual FROM gs)")
def stepped_complementarity(spark, sf):
    _, it, step = _iterate(spark, sf)
    return I.mu(I.stepped(it, step, 0.25, 0.5)).select(_r("mu", 6).alias("mu"))


@mixed(_IT + "SELECT round(least(1, min(CASE WHEN gap_step < 0 AND gap >= 0 THEN -0.9 * gap / gap_step END)), 9) AS \"primal\", round(least(1, min(CASE WHEN dual_step < 0 AND dual >= 0 THEN -0.9 * dual / dual_step END)), 9) AS \"dual\" FROM gs")
def step_bounds(spark, sf):
    _, it, step = _iterate(spark, sf)
    return I.step_bounds(it, step, 0.9).select(_r("primal", 9).alias("primal"), _r("dual", 9).alias("dual"))


@mixed(_IT + """SELECT side, family, system, id, round(ratio, 9) AS ratio FROM (
  SELECT 'primal' AS side, family, system, id, -gap / gap_step AS ratio FROM gs WHERE gap_step < 0 AND gap >= 0
  UNION ALL SELECT 'dual', family, system, id, -dual / dual_step FROM gs WHERE dual_step < 0 AND dual >= 0) QUALIFY row_number() OVER (PARTITION BY side ORDER BY round(ratio, 9), family, id, system) = 1""")
def blocking_pairs(spark, sf):
    """The first pairs to block; steps are powers of two of the gaps, so equal ratios are equal in full."""
    _, it, step = _iterate(spark, sf)
    exact = lambda df, names, key: df.select(*key, *((F.col(n) * (F.col(key[-1]) % 3 - 1.5)).alias(n) for n in names))
    step = I.Iterate(exact(it.cols, ["x", "v", "w", "gamma", "phi"], ["col_id"]), exact(it.rows, ["s", "y", "t", "u", "lam", "pi"], P.KEY))
    # rounded ratios decide, as in the SQL
    pairs = I.paired(it, step)
    sides = F.array(*(F.struct(F.lit(n).alias("side"), F.when((F.col(f"{c}_step") < 0) & (F.col(c) >= 0), _r(-F.col(c) / F.col(f"{c}_step"), 9)).alias("ratio")) for n, c in (("primal", "gap"), ("dual", "dual"))))
    live = pairs.select("family", "system", "id", F.explode(sides).alias("s")).select("s.side", "s.ratio", "family", "system", "id").where("ratio IS NOT NULL")
    return live.groupBy("side").agg(F.min(F.struct("ratio", "family", "id", "system")).alias("b")).select("side", "b.family", "b.system", "b.id", "b.ratio")


@mixed(_IT + "SELECT greatest(0, -least(min(gap - 200), min(dual - 0.15))) AS violation FROM g")
def iterate_violation(spark, sf):
    _, it, _ = _iterate(spark, sf)
    return I.violation(I.shifted(it, -200.0, -0.15))


@mixed(_IT + "SELECT CAST(count(*) FILTER (abs(gap) < 0.3) AS BIGINT) AS converged, round(coalesce(avg(abs(gap)) FILTER (abs(gap) < 0.3), 0), 9) AS average FROM g")
def converged_gaps(spark, sf):
    _, it, _ = _iterate(spark, sf)
    return I.distance_of_converged(it, 0.3).select("converged", _r("average", 9).alias("average"))


@mixed(_IT + "SELECT round(sum(abs(a)), 3) AS one_norm, round(max(abs(a)), 6) AS inf_norm FROM (SELECT unnest([x, v, w, gamma, phi]) AS a FROM ic UNION ALL SELECT unnest([s, y, t, u, lam, pi]) FROM ir)")
def iterate_norms(spark, sf):
    _, it, _ = _iterate(spark, sf)
    return I.norms(it).select(_r("one_norm", 3).alias("one_norm"), _r("inf_norm", 6).alias("inf_norm"))


@mixed(_IT + "SELECT family, system, id, round(CASE WHEN abs(gap) <= 0.3 THEN gap + 0.05 ELSE gap END, 9) AS gap FROM g WHERE family IN ('v', 'w') OR id % 10 = 0")
def slacks_pushed(spark, sf):
    _, it, _ = _iterate(spark, sf)
    return I.gaps(I.slacks_pushed(it, 0.3, 0.05)).where("family IN ('v', 'w') OR id % 10 = 0").select("family", "system", "id", _r("gap", 9).alias("gap"))


@mixed("SELECT CAST(count(lb) + count(ub) AS BIGINT) AS column_gaps, (SELECT CAST(count(lo) + count(hi) AS BIGINT) FROM \"rows\" WHERE system = 'INEQ') AS row_gaps FROM cols")
def interior_start(spark, sf):
    start = I.gaps(I.interior_start(from_orders_mixed(spark, sf), 10.0, 10.0)).where("gap = 10 AND dual = 10")
    return start.agg(F.count_if(F.col("system").isNull()).alias("column_gaps"), F.count_if(F.col("system") == "INEQ").alias("row_gaps"))


@mixed(_IT + """SELECT col_id, round(cost - coalesce(a, 0) - coalesce(gamma, 0) + coalesce(phi, 0), 6) AS rq, round(x - lb - v, 9) AS rv, round(x - ub + w, 9) AS rw, round(v * gamma, 9) AS rgamma, round(w * phi, 9) AS rphi
FROM ic LEFT JOIN (SELECT col_id, sum(val * y) AS a FROM nnz JOIN ir USING (system, row_id) GROUP BY col_id) USING (col_id)""")
def column_residuals(spark, sf):
    p, it, _ = _iterate(spark, sf)
    return I.column_residuals(p, it).select("col_id", _r("rq", 6).alias("rq"), *(_r(c, 9).alias(c) for c in ("rv", "rw", "rgamma", "rphi")))


@mixed(_IT + """SELECT system, row_id, round(coalesce(value, 0) - CASE WHEN system = 'EQ' THEN lo ELSE s END, 6) AS ra, round(CASE WHEN system = 'INEQ' THEN y - coalesce(lam, 0) + coalesce(pi, 0) END, 9) AS rz,
  round(s - lo - t, 6) AS rt, round(CASE WHEN system = 'INEQ' THEN s - hi + u END, 6) AS ru FROM ir LEFT JOIN ax USING (system, row_id)""")
def row_residuals(spark, sf):
    p, it, _ = _iterate(spark, sf)
    return I.row_residuals(p, it).select(*P.KEY, _r("ra", 6).alias("ra"), _r("rz", 9).alias("rz"), _r("rt", 6).alias("rt"), _r("ru", 6).alias("ru"))


@mixed(_IT + "SELECT round(sum(abs(coalesce(value, 0) - CASE WHEN system = 'EQ' THEN lo ELSE s END)), 2) AS one_norm, round(max(abs(coalesce(value, 0) - CASE WHEN system = 'EQ' THEN lo ELSE s END)), 4) AS inf_norm FROM ir LEFT JOIN ax USING (system, row_id)")
def constraint_violation(spark, sf):
    p, it, _ = _iterate(spark, sf)
    return I.constraint_violation(p, it).select(_r("one_norm", 2).alias("one_norm"), _r("inf_norm").alias("inf_norm"))


@mixed(_IT + """SELECT round((SELECT sum(cost * x) FROM ic), 3) AS "primal", round((SELECT sum(CASE WHEN system = 'EQ' THEN lo * y ELSE coalesce(lo * lam, 0) - coalesce(hi * pi, 0) END) FROM ir) + (SELECT sum(coalesce(lb * gamma, 0) - coalesce(ub * phi, 0)) FROM ic), 3) AS "dual" """)
def objective_values(spark, sf):
    p, it, _ = _iterate(spark, sf)
    return I.objectives(p, it).select(_r("primal", 3).alias("primal"), _r("dual", 3).alias("dual"))


@mixed(_IT + """SELECT round((SELECT sum(cost * x) + sum(x * x) / 2 FROM ic), 3) AS "primal", round((SELECT max(abs(cost + x - coalesce(a, 0) - coalesce(gamma, 0) + coalesce(phi, 0))) FROM ic LEFT JOIN (SELECT col_id, sum(val * y) AS a FROM nnz JOIN ir USING (system, row_id) GROUP BY col_id) USING (col_id)), 6) AS rq""")
def quadratic_cost(spark, sf):
    """The objective and the dual residual with the identity as the quadratic cost."""
    p, it, _ = _iterate(spark, sf)
    q = p.cols.select(F.col("col_id").alias("row_id"), "col_id", F.lit(1.0).alias("val"))
    return I.objectives(p, it, q).select(_r("primal", 3).alias("primal")).crossJoin(I.residual_norm(p, it, q).select(_r("rq", 6).alias("rq")))


@mixed(_IT + "SELECT family, system, id, round(greatest(CASE WHEN gap * dual < 0.5 THEN 0.5 - gap * dual WHEN gap * dual > 8 THEN 8 - gap * dual ELSE 0 END, -8), 6) AS r FROM g WHERE family IN ('v', 'w') OR id % 10 = 0")
def products_projected(spark, sf):
    _, it, _ = _iterate(spark, sf)
    return I.products_projected(it, 0.5, 8.0).where("family IN ('v', 'w') OR id % 10 = 0").select("family", "system", "id", _r("r", 6).alias("r"))


@mixed(_IT + "SELECT family, CAST(count(*) AS BIGINT) AS n, round(min(gap * dual - 0.5), 6) AS least, round(sum(gap * dual - 0.5), 3) AS total FROM g GROUP BY family")
def products_shifted(spark, sf):
    _, it, _ = _iterate(spark, sf)
    return I.products_shifted(it, -0.5).groupBy("family").agg(F.count(F.lit(1)).alias("n"), _r(F.min("r"), 6).alias("least"), _r(F.sum("r"), 3).alias("total"))


@mixed(_IT + "SELECT family, CAST(count(*) AS BIGINT) AS n, round(min(gap * dual), 6) AS least, round(max(gap * dual), 6) AS most, round(avg(gap * dual), 6) AS average FROM g GROUP BY family")
def products_by_family(spark, sf):
    _, it, _ = _iterate(spark, sf)
    return I.products_by_family(it).select("family", "n", *(_r(c, 6).alias(c) for c in ("least", "most", "average")))


@mixed(_IT + "SELECT round((SELECT sum(cost * x * (col_id % 3 - 1.5)) FROM ic) - 0.1 * (SELECT sum(gap_step / gap) FROM gs), 3) AS slope")
def barrier_slope(spark, sf):
    p, it, step = _iterate(spark, sf)
    return I.barrier_slope(p, it, step, 0.1).select(_r("slope", 3).alias("slope"))


@mixed(_IT + """, w AS (SELECT range * 0.25 AS weight FROM range(5)), st AS (SELECT weight, gap, dual, gap_step + weight * gap_step * 0.5 AS a, dual_step - weight * dual_step * 0.25 AS b FROM gs, w)
SELECT weight, round(least(1, min(CASE WHEN a < 0 AND gap >= 0 THEN -gap / a END)), 9) AS "primal", round(least(1, min(CASE WHEN b < 0 AND dual >= 0 THEN -dual / b END)), 9) AS "dual" FROM st GROUP BY weight""")
def weight_candidates(spark, sf):
    _, it, step = _iterate(spark, sf)
    other = I.Iterate(step.cols.withColumns({c: F.col(c) * k for c, k in (("v", 0.5), ("w", 0.5), ("gamma", -0.25), ("phi", -0.25))}), step.rows.withColumns({c: F.col(c) * k for c, k in (("t", 0.5), ("u", 0.5), ("lam", -0.25), ("pi", -0.25))}))
    return I.weight_candidates(it, step, other, 0.0, 4).select("weight", _r("primal", 9).alias("primal"), _r("dual", 9).alias("dual"))


@mixed(_IT + """SELECT 'column' AS what, CAST(NULL AS VARCHAR) AS system, col_id AS id, round((coalesce(gamma / v, 0) + coalesce(phi / w, 0)) * x * (col_id % 3 - 1.5) - coalesce(a, 0), 6) AS r
FROM ic LEFT JOIN (SELECT col_id, sum(val * y * (row_id % 3 - 1.5)) AS a FROM nnz JOIN ir USING (system, row_id) GROUP BY col_id) USING (col_id)
UNION ALL SELECT 'row', system, row_id, round(coalesce(adx, 0) + CASE WHEN system = 'INEQ' THEN y * (row_id % 3 - 1.5) / (coalesce(lam / t, 0) + coalesce(pi / u, 0)) ELSE 0 END, 5)
FROM ir LEFT JOIN (SELECT system, row_id, sum(val * cost / 1000 * (col_id % 3 - 1.5)) AS adx FROM nnz JOIN cols USING (col_id) GROUP BY 1, 2) USING (system, row_id)""")
def newton_residual(spark, sf):
    p, it, step = _iterate(spark, sf)
    cols, rows = I.system_residual(p, it, step)
    return cols.select(F.lit("column").alias("what"), F.lit(None).cast("string").alias("system"), F.col("col_id").alias("id"), _r("r", 6).alias("r")).unionByName(rows.select(F.lit("row").alias("what"), "system", F.col("row_id").alias("id"), _r("r", 5).alias("r")))


# --- the parts of a solution ---------------------------------------------------------------------------


@mixed(_IT + "SELECT round(sum(cost * x), 4) AS objective FROM ic WHERE block = 0")
def first_stage_objective(spark, sf):
    p, it, _ = _iterate(spark, sf)
    return I.first_stage_objective(p, it).select(_r("objective").alias("objective"))


@mixed(_IT + "SELECT block, col_id, x FROM ic WHERE block IN (0, 3)")
def stage_solutions(spark, sf):
    """x of the first stage and of one second stage."""
    p, it, _ = _iterate(spark, sf)
    return I.stage(p, it, 0).withColumn("block", F.lit(0)).unionByName(I.stage(p, it, 3).withColumn("block", F.lit(3))).select("block", "col_id", "x")


@mixed(_IT + "SELECT system, row_id, y AS dual, lam AS low, pi AS high FROM ir")
def row_duals(spark, sf):
    _, it, _ = _iterate(spark, sf)
    out = None
    for system in ("EQ", "INEQ"):
        one = I.duals(it, system).join(I.duals(it, system, "low").withColumnRenamed("dual", "low"), "row_id").join(I.duals(it, system, "high").withColumnRenamed("dual", "high"), "row_id").withColumn("system", F.lit(system))
        out = one if out is None else out.unionByName(one)
    return out.select("system", "row_id", "dual", "low", "high")


@mixed(_IT + "SELECT col_id, round(coalesce(gamma, 0) - coalesce(phi, 0), 9) AS dual, gamma AS low, phi AS high FROM ic")
def variable_bound_duals(spark, sf):
    _, it, _ = _iterate(spark, sf)
    return I.bound_duals(it).join(I.bound_duals(it, "low").withColumnRenamed("dual", "low"), "col_id").join(I.bound_duals(it, "high").withColumnRenamed("dual", "high"), "col_id").select("col_id", _r("dual", 9).alias("dual"), "low", "high")


@mixed(_IT + "SELECT system, row_id, round(coalesce(value, 0), 6) AS value FROM ir LEFT JOIN ax USING (system, row_id)")
def constraint_values(spark, sf):
    p, it, _ = _iterate(spark, sf)
    return I.row_values(p, it.cols).select(*P.KEY, _r("value", 6).alias("value"))


@mixed(_IT + "SELECT 'column' AS what, col_id AS id, round(x - lb, 9) AS low, round(ub - x, 9) AS high FROM ic UNION ALL SELECT 'row', row_id, round(coalesce(value, 0) - lo, 5), round(hi - coalesce(value, 0), 5) FROM ir LEFT JOIN ax USING (system, row_id) WHERE system = 'INEQ'")
def solution_slacks(spark, sf):
    p, it, _ = _iterate(spark, sf)
    cols, rows = I.slacks(p, it)
    return cols.select(F.lit("column").alias("what"), F.col("col_id").alias("id"), _r("low", 9).alias("low"), _r("high", 9).alias("high")).unionByName(rows.select(F.lit("row").alias("what"), F.col("row_id").alias("id"), _r("low", 5).alias("low"), _r("high", 5).alias("high")))


@mixed(_IT + "SELECT family, system, id FROM g WHERE abs(gap * dual) > 50")
def not_complementary(spark, sf):
    _, it, _ = _iterate(spark, sf)
    return I.not_complementary(it, 50.0).select("family", "system", "id")


@mixed(_IT + "SELECT 'column' AS what, col_id AS id FROM ic WHERE col_id % 17 = 0 UNION ALL SELECT system, row_id FROM ir WHERE row_id % 19 = 0")
def unset_values(spark, sf):
    """What lacks a value after a postsolve that forgot some."""
    p, it, _ = _iterate(spark, sf)
    return I.unset(I.Iterate(it.cols.where("col_id % 17 <> 0"), it.rows.withColumn("y", F.when(F.col("row_id") % 19 != 0, F.col("y")))), p)


# --- vectors -----------------------------------------------------------------------------------------------


@query("SELECT id, -a AS negated, CASE WHEN a >= 0 THEN round(sqrt(a), 9) END AS root, 7.5 AS same, CASE WHEN k <> 0 THEN round(a + 2 * b / nullif(k, 0), 9) ELSE a END AS quotient, CASE WHEN k <> 0 THEN a + 3 ELSE a END AS raised, CASE WHEN abs(a) <= 5 AND k <> 0 THEN a + 10 ELSE a END AS pushed FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity - 25 AS a, l_tax AS b, CAST(l_linenumber % 3 AS DOUBLE) AS k FROM lineitem)", lp=False)
def vector_elementwise(spark, sf):
    v = _vector(spark, sf)
    a, b, k = F.col("a"), F.col("b"), F.col("k")
    return v.select("id", V.negate(a).alias("negated"), _r(V.square_root(a), 9).alias("root"), V.set_to_constant(7.5).alias("same"), F.when(k != 0, _r(V.axdzpy(a, 2.0, b, k, k), 9)).otherwise(a).alias("quotient"), V.add_constant(a, 3.0, k).alias("raised"), V.push_away_from_zero(a, 5.0, 10.0, k).alias("pushed"))


def _vector(spark, sf) -> DataFrame:
    return _t(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") - 25).alias("a"), F.col("l_tax").alias("b"), (F.col("l_linenumber") % 3).cast("double").alias("k"))


_VECTOR = "(SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity - 25 AS a, l_tax AS b, CAST(l_linenumber % 3 AS DOUBLE) AS k FROM lineitem)"


@query(f"SELECT g, bool_and(abs(a - 3) > 0.5) AS differ, bool_and(a > 0) AS positive, bool_and(k = 0 OR a > -20) AS selected, bool_and(a = 0) AS zero, bool_and(abs(a - b) <= 20) AS close, CAST(count(DISTINCT a) AS BIGINT) AS kinds, bool_and(a = 0 OR k <> 0) AS pattern FROM (SELECT *, id % 97 AS g FROM {_VECTOR}) GROUP BY g", lp=False)
def vector_predicates(spark, sf):
    v = _vector(spark, sf).withColumn("g", F.col("id") % 97)
    a, b, k = F.col("a"), F.col("b"), F.col("k")
    return v.groupBy("g").agg(V.all_differ(a, 3.0, 0.5).alias("differ"), V.all_positive(a).alias("positive"), V.all_positive(a + 20, k).alias("selected"), V.is_zero(a).alias("zero"), V.all_close(a, b, 20.0).alias("close"), V.count_distinct(a).alias("kinds"), V.matches_pattern(a, k).alias("pattern"))


@query(f"SELECT g, coalesce(sum(a) FILTER (abs(a) <= 3), 0) AS small_sum, CAST(count(*) FILTER (abs(a) <= 3) AS BIGINT) AS small_count, sum(a) AS folded, round(sum(b / nullif(a - 0.5, 0)), 6) AS barrier, round(min(abs(a * b + k)) FILTER (abs(a * b + k) > 0), 9) AS least, round(max(abs(a * b + k)), 9) AS most FROM (SELECT *, id % 97 AS g FROM {_VECTOR}) GROUP BY g", lp=False)
def vector_folds(spark, sf):
    v = _vector(spark, sf).withColumn("g", F.col("id") % 97)
    a, b, k = F.col("a"), F.col("b"), F.col("k")
    total, count = V.sum_and_count_small(a, 3.0)
    least, most = V.extreme_sums(a, b, k, F.lit(1.0))
    return v.groupBy("g").agg(total.alias("small_sum"), count.alias("small_count"), V.fold(a, 0.0, lambda x, y: x + y).alias("folded"), _r(V.barrier_directional(b, a, F.lit(0.5)), 6).alias("barrier"), least.alias("l"), most.alias("m")).select("g", "small_sum", "small_count", "folded", "barrier", _r("l.value", 9).alias("least"), _r("m.value", 9).alias("most"))


@query(f"SELECT g, CASE WHEN lo IS NULL THEN NULL ELSE lo END AS least_ratio, hi AS most_ratio FROM (SELECT id % 97 AS g, round(min(abs(a / nullif(b, 0))) FILTER (abs(a / nullif(b, 0)) > 0), 9) AS lo, round(max(abs(a / nullif(b, 0))) FILTER (abs(a / nullif(b, 0)) > 0), 9) AS hi FROM {_VECTOR} GROUP BY 1)", lp=False)
def vector_extreme_ratios(spark, sf):
    v = _vector(spark, sf).withColumn("g", F.col("id") % 97)
    low, high = V.extreme_pair(F.col("a"), F.col("b"), F.col("id"))
    return v.groupBy("g").agg(low.alias("l"), high.alias("h")).select("g", _r("l.value", 9).alias("least_ratio"), _r(-F.col("h.value"), 9).alias("most_ratio"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS new_id, c_custkey AS id, c_acctbal AS a FROM customer WHERE c_custkey % 3 <> 0", lp=False)
def vector_entries_removed(spark, sf):
    v = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"))
    return V.remove_entries(v, F.col("id") % 3 != 0).select("new_id", "id", "a")


@query(f"SELECT row_number() OVER (ORDER BY k, b, a, id) - 1 AS new_id, id FROM {_VECTOR}", lp=False)
def vector_sorted_by_several(spark, sf):
    return V.positions(_vector(spark, sf), ["k", "b", "a", "id"]).select("new_id", "id")


@query("SELECT id, min(v) AS least, min(owner) FILTER (v = lo) AS least_owner, max(v) AS most, min(owner) FILTER (v = hi) AS most_owner FROM (SELECT l_partkey AS id, l_suppkey AS owner, l_quantity AS v, min(l_quantity) OVER (PARTITION BY l_partkey) AS lo, max(l_quantity) OVER (PARTITION BY l_partkey) AS hi FROM lineitem) GROUP BY id", lp=False)
def least_and_most_owner(spark, sf):
    return M.least_and_most_owner(_t(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("owner"), F.col("l_quantity").alias("v")))


@query("SELECT id, abs(a - b) <= 1e-6 AS eq, a <= b + 1e-6 AS le, a < b - 1e-6 AS lt, (a - b) / greatest(1, abs(a), abs(b)) <= 0.01 AS rel_le, (a - b) / greatest(1, abs(a), abs(b)) < -0.01 AS rel_lt, abs((a - b) / greatest(1, abs(a), abs(b))) <= 0.01 AS rel_eq, abs(a) <= 1e-6 AS zero, round(sqrt(a * a + b * b), 9) AS norm, round(pow(a, 2), 6) AS squared FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS a, l_discount * 500 AS b FROM lineitem)", lp=False)
def comparisons(spark, sf):
    v = _t(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("a"), (F.col("l_discount") * 500).alias("b"))
    a, b, e = F.col("a"), F.col("b"), tol.FEASTOL
    return v.select("id", tol.is_eq(a, b, e).alias("eq"), tol.is_le(a, b, e).alias("le"), tol.is_lt(a, b, e).alias("lt"), tol.is_rel_le(a, b, 0.01).alias("rel_le"), tol.is_rel_lt(a, b, 0.01).alias("rel_lt"), tol.is_rel_eq(a, b, 0.01).alias("rel_eq"), tol.is_zero_feas(a).alias("zero"), _r(tol.euclid(a, b), 9).alias("norm"), _r(F.pow(a, F.lit(2.0)), 6).alias("squared"))


@query("SELECT c_custkey AS id, TRY_CAST(trim(split_part(c_name, '#', 2)) AS DOUBLE) AS number, trim(c_name) = '' AS blank, starts_with(c_name, 'Cust') AS starts, substring(c_name, 1, 12) AS cut FROM customer", lp=False)
def text_checks(spark, sf):
    name = F.col("c_name")
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), tol.as_double(F.element_at(F.concat(F.split(name, "#"), F.array(F.lit(""))), 2)).alias("number"), tol.is_only_spaces(name).alias("blank"), tol.is_left_justified(name, "Cust").alias("starts"), F.substring(name, 1, 12).alias("cut"))


# --- matrices ------------------------------------------------------------------------------------------------


_SMALL = """, small AS (SELECT n_regionkey AS row_id, n_nationkey AS col_id, CAST(length(n_name) AS DOUBLE) AS val FROM nation)"""


def _small(spark, sf) -> DataFrame:
    return _t(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("row_id"), F.col("n_nationkey").cast("long").alias("col_id"), F.length("n_name").cast("double").alias("val"))


_S = "(SELECT CAST(n_regionkey AS BIGINT) AS row_id, CAST(n_nationkey AS BIGINT) AS col_id, CAST(length(n_name) AS DOUBLE) AS val FROM nation)"


@query(f"SELECT 'left' AS part, row_id, col_id, val FROM {_S} WHERE col_id < 7 UNION ALL SELECT 'right', row_id, col_id - 7, val FROM {_S} WHERE col_id >= 7 UNION ALL SELECT 'top', row_id, col_id, val FROM {_S} WHERE row_id < 3 UNION ALL SELECT 'bottom', row_id - 3, col_id, val FROM {_S} WHERE row_id >= 3", lp=False)
def matrix_shaved(spark, sf):
    m = _small(spark, sf)
    left, right = M.shave_left(m, 7)
    top, bottom = M.shave_bottom(m, 2, 5)
    out = None
    for name, part in (("left", left), ("right", right), ("top", top), ("bottom", bottom)):
        one = part.select(F.lit(name).alias("part"), "row_id", "col_id", "val")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT row_id, col_id, val FROM {_S} UNION ALL SELECT 5, col_id, val FROM {_S} WHERE row_id = 2 UNION ALL SELECT row_id, 25, val FROM {_S} WHERE col_id = 4 UNION ALL SELECT row_id, col_id + 100, 2 * val FROM {_S}", lp=False)
def matrix_grown(spark, sf):
    """With one row and one column of its own once more, and its double to the right."""
    m = _small(spark, sf)
    more = M.append_column(M.append_row(m, m, 2, 5), m, 4, 25)
    return M.append_columns(more, M.scalar_mult(m, 2.0), 100)


@query(f"SELECT row_id, col_id, sum(val) AS val FROM (SELECT row_id, col_id, val FROM {_S} WHERE NOT (row_id = 1 AND col_id = 1) AND row_id <> col_id UNION ALL SELECT row_id, col_id, val FROM {_S} WHERE row_id = col_id AND row_id <> 1 UNION ALL SELECT range, range, 0.5 FROM range(2, 6)) GROUP BY 1, 2", lp=False)
def diagonal_raised(spark, sf):
    m = M.remove_entries(_small(spark, sf), _small(spark, sf).where("row_id = 1 AND col_id = 1"))
    return M.diagonal_constant(m, 2, 4, 0.5, add=True)


@query(f"SELECT row_id, col_id, val FROM {_S} WHERE NOT (row_id = col_id AND row_id BETWEEN 1 AND 3) UNION ALL SELECT range, range, 9.0 FROM range(1, 4)", lp=False)
def diagonal_set(spark, sf):
    return M.diagonal_constant(_small(spark, sf), 1, 3, 9.0)


@query(f"SELECT row_id, coalesce(sum(val) FILTER (col_id = 3), 0) AS c0, coalesce(sum(val) FILTER (col_id = 4), 0) AS c1, coalesce(sum(val) FILTER (col_id = 5), 0) AS c2 FROM {_S} WHERE row_id BETWEEN 0 AND 4 AND col_id BETWEEN 3 AND 5 GROUP BY row_id", lp=False)
def dense_rectangle(spark, sf):
    return M.dense(_small(spark, sf), 0, 3, 5, 3)


@query(f"SELECT a.row_id, b.row_id AS col_id, 2 * sum(a.val * b.val) AS val FROM {_S} a JOIN {_S} b USING (col_id) GROUP BY 1, 2", lp=False)
def matrix_product(spark, sf):
    m = _small(spark, sf)
    return M.product(m, M.transpose(m).select("row_id", "col_id", "val"), 2.0)


@query(f"SELECT row_id, col_id, sum(val) AS val FROM (SELECT row_id, col_id, 3 * val AS val FROM {_S} UNION ALL SELECT row_id, col_id, -val FROM {_S} WHERE col_id % 2 = 0) GROUP BY 1, 2", lp=False)
def matrix_combined(spark, sf):
    m = _small(spark, sf)
    return M.combine(m, 3.0, m.where("col_id % 2 = 0"), -1.0)


@query(f"SELECT a.col_id AS row_id, b.col_id, 0.5 * a.val * b.val AS val FROM {_S} a JOIN {_S} b ON a.row_id = 1 AND b.row_id = 1", lp=False)
def outer_product(spark, sf):
    return M.outer(_small(spark, sf).where("row_id = 1").select(F.col("col_id").alias("id"), F.col("val").alias("v")), 0.5)


@query(f"SELECT row_id, col_id, sum(val) AS val FROM (SELECT a.row_id, b.row_id AS col_id, 2 * sum(a.val * b.val) AS val FROM {_S} a JOIN {_S} b ON a.col_id = b.col_id AND a.row_id >= b.row_id GROUP BY 1, 2 UNION ALL SELECT row_id, col_id, 3 * val FROM {_S} WHERE row_id >= col_id) GROUP BY 1, 2", lp=False)
def rank_update(spark, sf):
    m = _small(spark, sf)
    return M.rank_update(m, 3.0, m, 2.0)


@query(f"SELECT 'row' AS side, c.col_id AS id, 1.0 + 2 * coalesce(val, 0) AS value FROM (SELECT DISTINCT col_id FROM {_S}) c LEFT JOIN {_S} s ON s.col_id = c.col_id AND s.row_id = 2 UNION ALL SELECT 'column', r.row_id, 1.0 + 3 * coalesce(val, 0) FROM (SELECT DISTINCT row_id FROM {_S}) r LEFT JOIN {_S} s ON s.row_id = r.row_id AND s.col_id = 4", lp=False)
def axpy_of_row_and_column(spark, sf):
    m = _small(spark, sf)
    ones = m.select("col_id").distinct().withColumn("x", F.lit(1.0)), m.select("row_id").distinct().withColumn("y", F.lit(1.0))
    return M.axpy_row(ones[0], m, 2, 2.0).select(F.lit("row").alias("side"), F.col("col_id").alias("id"), F.col("x").alias("value")).unionByName(M.axpy_column(ones[1], m, 4, 3.0).select(F.lit("column").alias("side"), F.col("row_id").alias("id"), F.col("y").alias("value")))


@query(f"SELECT (SELECT coalesce(sum(val), 0) FROM {_S} WHERE row_id = 1 AND col_id = 2) AS there, (SELECT coalesce(sum(val), 0) FROM {_S} WHERE row_id = 0 AND col_id = 1) AS absent, (SELECT CAST(count(*) AS BIGINT) FROM {_S}) AS n, (SELECT max(abs(val)) FROM {_S}) AS inf_norm, (SELECT min(abs(val)) FROM {_S}) AS least_nonzero, (SELECT sum(val * (1 + row_id)) FROM {_S} WHERE col_id = 6) AS column_product", lp=False)
def matrix_entries(spark, sf):
    m = _small(spark, sf)
    y = m.select("row_id").distinct().withColumn("y", 1.0 + F.col("row_id"))
    one = M.entry(m, 1, 2).withColumnRenamed("val", "there").crossJoin(M.entry(m, 0, 1).withColumnRenamed("val", "absent"))  # single rows
    return one.crossJoin(M.entry_count(m)).crossJoin(M.norms(m)).crossJoin(M.column_times(m, 6, y).select(F.col("x").alias("column_product")))


@query(f"SELECT row_id, col_id, val * (1 + row_id) * (1 + col_id) AS val FROM {_S}", lp=False)
def symmetric_scale(spark, sf):
    m = _small(spark, sf)
    s = spark.range(25).select("id", (1.0 + F.col("id")).alias("s"))
    return M.symmetric_scale(m, s).select("row_id", "col_id", "val")


# --- splits ----------------------------------------------------------------------------------------------------


@mixed(_LINKS + """, c AS (SELECT col_id, count(DISTINCT row_block) AS n FROM nnz GROUP BY 1)
SELECT CASE WHEN kind = 'global' OR n > 2 THEN 'border' ELSE 'inner' END AS part, CAST(count(*) AS BIGINT) AS n, round(sum(val), 3) AS total FROM nnz JOIN kinds USING (system, row_id) JOIN c USING (col_id) GROUP BY 1""")
def border_shaved(spark, sf):
    inner, border = structure.shave_border(from_orders_mixed(spark, sf).nnz)
    both = inner.withColumn("part", F.lit("inner")).unionByName(border.withColumn("part", F.lit("border")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("val"), 3).alias("total"))


@mixed("SELECT CAST(count(*) AS BIGINT) AS n, round(sum(val), 3) AS total FROM nnz")
def border_raised(spark, sf):
    whole = structure.raise_border(*structure.shave_border(from_orders_mixed(spark, sf).nnz))
    return whole.agg(F.count(F.lit(1)).alias("n"), _r(F.sum("val"), 3).alias("total"))


@mixed(_LINKS + "SELECT CAST(first_block * 3 // 8 AS INTEGER) AS subtree, CAST(count(*) FILTER (least(first_block + 1, 7) * 3 // 8 = first_block * 3 // 8) AS BIGINT) AS inside, CAST(count(*) FILTER (least(first_block + 1, 7) * 3 // 8 <> first_block * 3 // 8) AS BIGINT) AS leaving FROM kinds WHERE kind = 'two_link' GROUP BY 1")
def two_links_by_side(spark, sf):
    return structure.two_links_by_side(structure.row_links(from_orders_mixed(spark, sf).nnz), structure.subtree_map(8, 3))


@mixed(_LINKS + """SELECT CAST(block * 3 // 8 AS INTEGER) AS subtree, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(n) AS BIGINT) AS n, CAST(max(own) AS BIGINT) AS own_links FROM (SELECT block, count(*) AS n FROM cols GROUP BY block)
LEFT JOIN (SELECT first_block * 3 // 8 AS tree, count(*) AS own FROM kinds WHERE kind = 'two_link' AND least(first_block + 1, 7) * 3 // 8 = first_block * 3 // 8 GROUP BY 1) ON tree = block * 3 // 8 GROUP BY 1""")
def split_sizes(spark, sf):
    p = from_orders_mixed(spark, sf)
    return structure.split_sizes(structure.block_sizes(p.cols), structure.row_links(p.nnz), structure.subtree_map(8, 3))


@mixed("SELECT col_id, CAST(CASE WHEN col_id % 2 = 0 THEN 0 ELSE count(DISTINCT row_block) END AS BIGINT) AS n_blocks FROM nnz GROUP BY col_id")
def links_reclassified(spark, sf):
    n = from_orders_mixed(spark, sf).nnz
    return structure.reclassified(structure.column_links(n), n.where("col_id % 2 = 0").select("col_id").distinct())


@mixed("SELECT col_id, row_number() OVER (ORDER BY CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE 2 END, col_id) - 1 AS position FROM (SELECT col_id, count(DISTINCT row_block) AS n FROM nnz GROUP BY col_id)")
def linking_columns_last(spark, sf):
    return structure.linking_first_order(structure.column_links(from_orders_mixed(spark, sf).nnz)).select("col_id", "position")


@mixed("SELECT CAST(sum(k * (k + 1) / 2) AS BIGINT) AS n FROM (SELECT row_block, count(DISTINCT col_id) AS k FROM nnz WHERE col_id IN (SELECT col_id FROM nnz GROUP BY 1 HAVING count(DISTINCT row_block) > 1) GROUP BY 1)")
def schur_most_entries(spark, sf):
    return structure.schur_most_entries(from_orders_mixed(spark, sf).nnz)


# --- model data --------------------------------------------------------------------------------------------------


@query("SELECT s_nationkey AS region, l_linenumber AS plant, CAST(count(*) AS BIGINT) AS steps, round(sum(l_quantity), 2) AS output, round(avg(l_discount), 9) AS availability, max(l_quantity) > 0.9 * 50 AS at_capacity, sum(l_quantity) > 400 AS over_cap FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2", lp=False)
def plant_capacity(spark, sf):
    return timeseries.capacity(_plants(spark, sf), 50.0, 400.0, 0.9).select("region", "plant", "steps", _r("output", 2).alias("output"), _r("availability", 9).alias("availability"), "at_capacity", "over_cap")


def _plants(spark, sf) -> DataFrame:
    joined = _t(spark, sf, "lineitem").join(_t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("s_nationkey").alias("region"), F.col("l_linenumber").alias("plant"), F.col("l_quantity").alias("output"), F.col("l_discount").alias("available"), F.col("l_tax").alias("rate"))


@query("SELECT s_nationkey AS region, round(sum(l_quantity * l_tax), 6) AS emission, round(greatest(sum(l_quantity * l_tax) - 100, 0), 6) AS excess, round(sum(l_quantity * l_tax) * 0.8, 6) AS cost FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1", lp=False)
def emissions(spark, sf):
    return timeseries.emissions(_plants(spark, sf), cap=100.0, price=0.8).select("region", _r("emission", 6).alias("emission"), _r("excess", 6).alias("excess"), _r("cost", 6).alias("cost"))


@query("SELECT s_nationkey AS region, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS plants, round(sum(most), 2) AS size FROM (SELECT s_nationkey, l_linenumber, max(l_quantity) AS most FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) GROUP BY 1", lp=False)
def region_size(spark, sf):
    return timeseries.region_size(_plants(spark, sf)).select("region", "plants", _r("size", 2).alias("size"))


@query("SELECT n_nationkey AS plant, r_regionkey AS region FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) JOIN (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1 AS j FROM region) ON i % 5 = j", lp=False)
def plants_by_ordinal(spark, sf):
    plants, regions = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("plant")), _t(spark, sf, "region").select(F.col("r_regionkey").alias("region"))
    return timeseries.mapped_by_ordinal(plants, "plant", regions, "region")


_HOURLY = "SELECT row_number() OVER () AS n, user_id % 20 AS region, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS step, value FROM events"


@query(f"SELECT region, step, round(avg(value), 9) AS average, round(sum(value * 2) / sum(2), 9) AS weighted, round(sum(value * 2), 6) AS total, max(value) AS most FROM ({_HOURLY}) GROUP BY 1, 2", lp=False)
def steps_rolled_up(spark, sf):
    """Sums, plain and weighted averages and maxima of data per model step, by the library's roll-up."""
    d = _t(spark, sf, "events").select((F.col("user_id") % 20).alias("region"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000).alias("step"), F.lit(2.0).alias("overlap"), "value")
    return timeseries.roll_up(d, ["region", "step"], "value", "overlap").select("region", "step", _r("average", 9).alias("average"), _r("weighted", 9).alias("weighted"), _r("total", 6).alias("total"), "most")


# --- sources and orders ----------------------------------------------------------------------------------------------


@mixed("SELECT col_id, block, row_number() OVER (ORDER BY block, col_id) - 1 AS position FROM cols")
def columns_by_stage(spark, sf):
    return tables.column_order(from_orders_mixed(spark, sf).cols, 8).select("col_id", "block", "position")


@mixed("SELECT system, row_id, kind, row_number() OVER (PARTITION BY kind ORDER BY row_id) - 1 AS position FROM (SELECT system, row_id, CASE WHEN block = 7 THEN 'link_' ELSE 'local_' END || lower(system) AS kind FROM \"rows\")")
def rows_by_kind(spark, sf):
    return tables.row_order(from_orders_mixed(spark, sf).rows, 7)


@mixed(", own AS (SELECT * FROM nnz WHERE row_block = 3) SELECT system, row_id, dense_rank() OVER (ORDER BY col_id) - 1 AS col_id, val FROM own")
def one_block_squeezed(spark, sf):
    return tables.squeezed(from_orders_mixed(spark, sf), 3).nnz.select("system", "row_id", "col_id", "val")


@mixed("SELECT system, row_id, hi FROM \"rows\" WHERE block = 5")
def one_block_read(spark, sf):
    """The rows of one block of a problem that was written and read again."""
    import uuid

    from blockloom.plans import lp
    from blockloom.session import checkpoint, shared_folder

    folder = f"{shared_folder(spark)}/problem-{uuid.uuid4().hex}"
    lp.write(from_orders_mixed(spark, sf), folder)
    out = checkpoint(lp.read_block(lp.read(spark, folder), 5).rows.select("system", "row_id", "hi"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


@mixed("SELECT CAST((SELECT count(*) FROM cols) AS BIGINT) AS q, CAST(count(*) FILTER (system = 'EQ') AS BIGINT) AS equalities, CAST(count(*) FILTER (system = 'INEQ') AS BIGINT) AS inequalities FROM nnz")
def entries_by_matrix(spark, sf):
    p = from_orders_mixed(spark, sf)
    return tables.entries_by_matrix(p, p.cols.select(F.col("col_id").alias("row_id"), "col_id", F.lit(1.0).alias("val")))


@mixed("SELECT system, row_id FROM \"rows\" ANTI JOIN (SELECT DISTINCT system, row_id FROM nnz WHERE row_block = col_block) USING (system, row_id)")
def empty_local_rows(spark, sf):
    return tables.empty_local_rows(from_orders_mixed(spark, sf))


@mixed("SELECT col_id, row_number() OVER (ORDER BY CASE WHEN n > 2 THEN 0 WHEN n > 0 THEN 1 ELSE 2 END, col_id) - 1 AS position FROM (SELECT col_id, count(DISTINCT row_block) AS n FROM cols LEFT JOIN nnz USING (col_id) GROUP BY col_id)")
def global_columns_first(spark, sf):
    p = from_orders_mixed(spark, sf)
    links = p.cols.select("col_id").join(structure.column_links(p.nnz), "col_id", "left").fillna({"n_blocks": 0})
    return tables.globals_first(links)


@mixed(_IT + "SELECT system, row_id, round(coalesce(value, 0), 6) AS level, y AS marginal, lo, hi FROM ir LEFT JOIN ax USING (system, row_id)")
def equations_with_duals(spark, sf):
    p, it, _ = _iterate(spark, sf)
    return tables.equations(p, it).withColumn("level", _r("level", 6))


@query("SELECT CAST(n_nationkey AS VARCHAR) || ' ' || CAST(CAST(n_regionkey AS DOUBLE) AS VARCHAR) AS line FROM nation", lp=False)
def vector_lines(spark, sf):
    return tables.vector_lines(_t(spark, sf, "nation").withColumn("v", F.col("n_regionkey").cast("double")), "n_nationkey", "v")


@mixed(""", b AS (SELECT col_id, cost, coalesce(lb, 0) AS lb, coalesce(ub, 10) AS ub FROM cols) SELECT round(sum(CASE WHEN cost > 0 THEN cost * lb ELSE cost * ub END), 3) AS bound FROM b""")
def relaxed_bound(spark, sf):
    """The first bound of a Lagrangian relaxation: all multipliers are 0, every column stands at its cheaper bound."""
    from blockloom.operators.lagrange import relax

    p = from_orders_mixed(spark, sf)
    boxed = p.with_(cols=p.cols.withColumns({"lb": F.coalesce("lb", F.lit(0.0)), "ub": F.coalesce("ub", F.lit(10.0))}))
    return spark.createDataFrame([(round(relax(boxed, 1).bounds[0], 3),)], "bound double")
