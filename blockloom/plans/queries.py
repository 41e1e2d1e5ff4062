"""The named queries over the order tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.functions import tolerance as tol
from blockloom.operators import matrix as M
from blockloom.operators import presolve as P
from blockloom.operators import scaling, structure, timeseries
from blockloom.operators import vector as V
from blockloom.plans.lp import SQL as LP_SQL
from blockloom.plans.lp import from_orders

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, lp: bool = True):
    """Registers a query; its SQL may read cols, rows and nnz if lp."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"{LP_SQL}{sql}" if lp else sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c, digits: int = 4):
    return F.round(c, digits)


def _x(p):
    """A point: x = cost / 1000 of each column."""
    return p.cols.select("col_id", (F.col("cost") / 1000).alias("x"))


# --- products ---------------------------------------------------------------------------------


@query("SELECT row_id, round(sum(val * (cost / 1000)), 4) AS y FROM nnz JOIN cols USING (col_id) GROUP BY row_id")
def spmv(spark, sf):
    p = from_orders(spark, sf)
    return M.mult(p.nnz, _x(p)).select("row_id", _r("y").alias("y"))


@query("SELECT col_id, round(sum(val * (hi / 1000)), 5) AS x FROM nnz JOIN \"rows\" USING (row_id) GROUP BY col_id")
def spmv_transposed(spark, sf):
    p = from_orders(spark, sf)
    return M.mult_transposed(p.nnz, p.rows.select("row_id", (F.col("hi") / 1000).alias("y"))).select("col_id", _r("x", 5).alias("x"))


@query("SELECT r.row_id, round(0.5 * hi - 2.0 * coalesce(ax, 0), 5) AS y FROM \"rows\" r LEFT JOIN (SELECT row_id, sum(val * (cost / 1000)) AS ax FROM nnz JOIN cols USING (col_id) GROUP BY row_id) a ON a.row_id = r.row_id")
def spmv_axpby(spark, sf):
    p = from_orders(spark, sf)
    return M.mult_add(p.nnz, _x(p), p.rows.select("row_id", F.col("hi").alias("y")), 0.5, -2.0).select("row_id", _r("y", 5).alias("y"))


@query("SELECT row_id, round(sum(cost / 1000), 4) AS y FROM nnz JOIN cols USING (col_id) GROUP BY row_id")
def spmv_pattern(spark, sf):
    p = from_orders(spark, sf)
    return M.mult(p.nnz, _x(p), lambda v: F.when(v != 0, 1.0).otherwise(0.0)).select("row_id", _r("y").alias("y"))


@query("SELECT col_id, round(sum(val * hi / 1000 * (row_id % 10 + 1)), 5) AS x FROM nnz JOIN \"rows\" USING (row_id) GROUP BY col_id")
def spmv_transposed_scaled(spark, sf):
    p = from_orders(spark, sf)
    d = p.rows.select("row_id", (F.col("row_id") % 10 + 1).cast("double").alias("d"))
    return M.mult_transposed_scaled(p.nnz, p.rows.select("row_id", (F.col("hi") / 1000).alias("y")), d).select("col_id", _r("x", 5).alias("x"))


def _by_size(spark, sf):
    """Orders by part size: a matrix of 50 columns."""
    p = from_orders(spark, sf)
    size = _t(spark, sf, "part").select(F.col("p_partkey").alias("col_id"), F.col("p_size").cast("long").alias("_s"))
    return p.nnz.join(size, "col_id").groupBy("row_id", F.col("_s").alias("col_id")).agg(F.sum("val").alias("val"))


_SIZE_SQL = ", small AS (SELECT row_id, CAST(p_size AS BIGINT) AS col_id, sum(val) AS val FROM nnz JOIN part ON p_partkey = col_id GROUP BY 1, 2) "


@query(_SIZE_SQL + "SELECT l.col_id AS a, r.col_id AS b, round(sum(l.val * r.val * (l.row_id % 10 + 1)), 2) AS val FROM small l JOIN small r ON l.row_id = r.row_id AND l.col_id <= r.col_id GROUP BY 1, 2")
def gram_scaled(spark, sf):
    a = _by_size(spark, sf)
    d = a.select("row_id").distinct().withColumn("d", (F.col("row_id") % 10 + 1).cast("double"))
    return M.gram(a, d).select("a", "b", _r("val", 2).alias("val"))


@query(_SIZE_SQL + "SELECT l.col_id AS a, r.col_id AS b, round(sum(l.val * r.val / (l.row_id % 10 + 1)), 4) AS val FROM small l JOIN small r ON l.row_id = r.row_id AND l.col_id <= r.col_id GROUP BY 1, 2")
def gram_inverse_scaled(spark, sf):
    a = _by_size(spark, sf)
    d = a.select("row_id").distinct().withColumn("d", (F.col("row_id") % 10 + 1).cast("double"))
    return M.gram(a, d, inverse=True).select("a", "b", _r("val", 4).alias("val"))


@query("SELECT DISTINCT l.col_block AS a, r.col_block AS b FROM nnz l JOIN nnz r ON l.row_id = r.row_id AND l.col_block <= r.col_block")
def gram_pattern(spark, sf):
    p = from_orders(spark, sf)
    return M.gram_pattern(p.nnz.select("row_id", F.col("col_block").alias("col_id")).distinct())


@query("SELECT row_id, col_id, round(val * cost / 1000, 6) AS val FROM nnz JOIN cols USING (col_id)")
def column_scale(spark, sf):
    p = from_orders(spark, sf)
    return M.column_scale(p.nnz, p.cols.select("col_id", F.col("cost").alias("s"))).select("row_id", "col_id", _r(F.col("val") / 1000, 6).alias("val"))


@query("SELECT row_id, col_id, round(val * hi / 1000, 5) AS val FROM nnz JOIN \"rows\" USING (row_id)")
def row_scale(spark, sf):
    p = from_orders(spark, sf)
    return M.row_scale(p.nnz, p.rows.select("row_id", F.col("hi").alias("s"))).select("row_id", "col_id", _r(F.col("val") / 1000, 5).alias("val"))


@query("SELECT round(sqrt(sum(r * r)), 2) AS two_norm, round(max(abs(r)), 4) AS inf_norm FROM (SELECT coalesce(ax, 0) - hi AS r FROM \"rows\" r LEFT JOIN (SELECT row_id, sum(val * (cost / 1000)) AS ax FROM nnz JOIN cols USING (col_id) GROUP BY row_id) a ON a.row_id = r.row_id)")
def residual_norms(spark, sf):
    p = from_orders(spark, sf)
    return M.residual_norms(p.nnz, _x(p), p.rows.select("row_id", F.col("hi").alias("b"))).select(_r("two_norm", 2).alias("two_norm"), _r("inf_norm", 4).alias("inf_norm"))


# --- matrix aggregates and structure -------------------------------------------------------------


@query("SELECT row_id, CAST(count(*) AS BIGINT) AS n, round(sum(abs(val)), 4) AS total FROM nnz GROUP BY row_id")
def row_counts_and_sums(spark, sf):
    n = from_orders(spark, sf).nnz
    return n.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), _r(F.sum(F.abs("val"))).alias("total"))


@query("SELECT col_id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM cols LEFT JOIN (SELECT col_id, count(*) AS n FROM nnz GROUP BY col_id) a USING (col_id)")
def column_counts(spark, sf):
    p = from_orders(spark, sf)
    return p.cols.select("col_id").join(M.column_counts(p.nnz), "col_id", "left").fillna(0, ["n"])


@query("SELECT col_id, round(sum(abs(val)), 4) AS total FROM nnz GROUP BY col_id")
def column_abs_sums(spark, sf):
    return M.column_sums(from_orders(spark, sf).nnz).select("col_id", _r("total").alias("total"))


@query("SELECT row_id, round(min(CASE WHEN abs(val * cost) > 1e-13 THEN abs(val * cost) END), 4) AS least, round(max(abs(val * cost)), 4) AS most FROM nnz JOIN cols USING (col_id) GROUP BY row_id")
def row_extremes_scaled(spark, sf):
    p = from_orders(spark, sf)
    return M.extremes(p.nnz, "row_id", p.cols.select("col_id", F.col("cost").alias("s"))).select("row_id", _r("least").alias("least"), _r("most").alias("most"))


@query("SELECT col_id, min(abs(val)) AS least, max(abs(val)) AS most FROM nnz GROUP BY col_id")
def column_extremes(spark, sf):
    return M.extremes(from_orders(spark, sf).nnz, "col_id")


@query("SELECT max(most / least) AS ratio FROM (SELECT max(abs(val)) AS most, min(abs(val)) AS least FROM nnz GROUP BY row_id)")
def row_ratio(spark, sf):
    return scaling.ratios(from_orders(spark, sf).nnz, "row_id")


@query("SELECT max(most / least) AS ratio FROM (SELECT max(abs(val)) AS most, min(abs(val)) AS least FROM nnz GROUP BY col_id)")
def column_ratio(spark, sf):
    return scaling.ratios(from_orders(spark, sf).nnz, "col_id")


@query("SELECT col_id AS row_id, row_id AS col_id, val FROM nnz")
def transpose(spark, sf):
    return M.transpose(from_orders(spark, sf).nnz.select("row_id", "col_id", "val"))


_SYM_SQL = ", s AS (SELECT greatest(a.col_id, b.col_id) AS row_id, least(a.col_id, b.col_id) AS col_id, sum(a.val) AS val FROM small a JOIN small b ON a.row_id = b.row_id AND a.col_id > b.col_id GROUP BY 1, 2) "


def _symmetric(spark, sf):
    a = _by_size(spark, sf)
    b = a.select("row_id", F.col("col_id").alias("other"))
    return a.join(b, "row_id").where("col_id > other").groupBy(F.col("col_id").alias("row_id"), F.col("other").alias("col_id")).agg(F.sum("val").alias("val"))


@query(_SIZE_SQL + _SYM_SQL + "SELECT row_id, col_id, val FROM s UNION ALL SELECT col_id, row_id, val FROM s WHERE row_id <> col_id")
def symmetrize(spark, sf):
    return M.symmetrize(_symmetric(spark, sf))


@query("SELECT row_id, col_id, val FROM nnz WHERE row_id >= col_id")
def lower_triangle(spark, sf):
    return M.lower_triangle(from_orders(spark, sf).nnz.select("row_id", "col_id", "val"))


@query("SELECT row_id AS id, val FROM nnz WHERE row_id = col_id")
def diagonal(spark, sf):
    return M.diagonal(from_orders(spark, sf).nnz)


@query("SELECT row_id, col_id, sum(val) AS val FROM (SELECT row_id, col_id, val FROM nnz UNION ALL SELECT row_id, 1 AS col_id, 2.0 AS val FROM \"rows\") GROUP BY 1, 2")
def add_entries(spark, sf):
    p = from_orders(spark, sf)
    return M.add_entries(p.nnz, p.rows.select("row_id", F.lit(1).cast("long").alias("col_id"), F.lit(2.0).alias("val")))


@query("SELECT row_id, col_id, val FROM nnz WHERE row_id BETWEEN 100 AND 1099 AND col_id BETWEEN 50 AND 149")
def submatrix(spark, sf):
    return M.block(from_orders(spark, sf).nnz.select("row_id", "col_id", "val"), 100, 50, 1000, 100)


@query("SELECT row_id, col_id, val FROM nnz WHERE row_id NOT IN (SELECT row_id FROM \"rows\" WHERE hi > 200000)")
def clear_rows(spark, sf):
    p = from_orders(spark, sf)
    return M.clear_rows(p.nnz.select("row_id", "col_id", "val"), p.rows.where("hi > 200000").select("row_id"))


@query("SELECT row_id, col_id, val, CAST(dense_rank() OVER (ORDER BY row_id) - 1 AS BIGINT) AS new_id FROM nnz")
def compact_rows(spark, sf):
    return M.compact(from_orders(spark, sf).nnz.select("row_id", "col_id", "val"), "row_id").select("row_id", "col_id", "val", F.col("new_id").cast("long").alias("new_id"))


_LINK_SQL = ", g AS (SELECT row_id, count(DISTINCT col_block) AS n_blocks, min(col_block) AS first_block, max(col_block) AS last_block FROM nnz GROUP BY row_id), links AS (SELECT *, CASE WHEN n_blocks = 1 THEN 'local' WHEN n_blocks = 2 AND last_block = first_block + 1 THEN 'two_link' ELSE 'global' END AS kind, CASE WHEN n_blocks = 2 AND last_block = first_block + 1 THEN first_block ELSE -1 END AS start_block FROM g) "


@query(_LINK_SQL + "SELECT row_id, CAST(n_blocks AS BIGINT) AS n_blocks, first_block, last_block, kind, start_block FROM links")
def row_links(spark, sf):
    return structure.row_links(from_orders(spark, sf).nnz).select("row_id", "n_blocks", "first_block", "last_block", "kind", "start_block")


@query(_LINK_SQL + "SELECT CAST(n_blocks AS BIGINT) AS n_blocks, CAST(count(*) AS BIGINT) AS n FROM links GROUP BY 1")
def row_link_histogram(spark, sf):
    return structure.histogram(structure.row_links(from_orders(spark, sf).nnz))


@query("SELECT CAST(n_blocks AS BIGINT) AS n_blocks, CAST(count(*) AS BIGINT) AS n FROM (SELECT col_id, count(DISTINCT row_block) AS n_blocks FROM nnz GROUP BY col_id) GROUP BY 1")
def column_link_histogram(spark, sf):
    return structure.histogram(structure.column_links(from_orders(spark, sf).nnz))


@query(_LINK_SQL + "SELECT start_block, CAST(count(*) AS BIGINT) AS n FROM links WHERE start_block >= 0 GROUP BY 1")
def two_links_per_block(spark, sf):
    return structure.two_links_per_block(structure.row_links(from_orders(spark, sf).nnz))


@query(_LINK_SQL + "SELECT row_id, CAST(row_number() OVER (ORDER BY CASE kind WHEN 'local' THEN 0 WHEN 'two_link' THEN 1 + start_block ELSE 1000000 END, row_id) - 1 AS BIGINT) AS position FROM links")
def link_order(spark, sf):
    return structure.link_order(structure.row_links(from_orders(spark, sf).nnz)).select("row_id", F.col("position").cast("long").alias("position"))


@query("SELECT row_id, least, most, CASE WHEN stage = CASE WHEN most = 0 THEN 0 WHEN least = most THEN least ELSE 8 END THEN 'ok' ELSE 'misplaced' END AS verdict FROM (SELECT row_id, coalesce(min(CASE WHEN col_block > 0 THEN col_block END), 0) AS least, coalesce(max(CASE WHEN col_block > 0 THEN col_block END), 0) AS most, min(row_block) AS stage FROM nnz GROUP BY row_id)")
def row_stage_check(spark, sf):
    return structure.row_stages(from_orders(spark, sf).nnz, 8).select("row_id", "least", "most", "verdict")


@query(_SIZE_SQL + ", b AS (SELECT DISTINCT CAST(row_id % 8 AS INTEGER) AS row_block, col_id FROM small), l AS (SELECT col_id FROM b GROUP BY col_id HAVING count(*) > 1), t AS (SELECT * FROM b JOIN l USING (col_id)) SELECT DISTINCT x.col_id AS a, y.col_id AS b FROM t x JOIN t y ON x.row_block = y.row_block AND x.col_id <= y.col_id")
def schur_pattern(spark, sf):
    return structure.schur_pattern(_by_size(spark, sf).withColumn("row_block", (F.col("row_id") % 8).cast("int")))


@query("SELECT block, CAST(count(*) AS BIGINT) AS n FROM \"rows\" GROUP BY block")
def block_sizes(spark, sf):
    return structure.block_sizes(from_orders(spark, sf).rows)


# --- scaling ------------------------------------------------------------------------------------


@query(", r AS (SELECT row_id, 1.0 / max(abs(val)) AS s FROM nnz GROUP BY row_id), c AS (SELECT col_id, 1.0 / max(abs(val * s)) AS s FROM nnz JOIN r USING (row_id) GROUP BY col_id) SELECT 'row' AS side, row_id AS id, round(s, 8) AS s FROM r UNION ALL SELECT 'col', col_id, round(s, 8) FROM c")
def equilibrium_factors(spark, sf):
    r, c = scaling.equilibrium(from_orders(spark, sf).nnz)
    return r.select(F.lit("row").alias("side"), F.col("row_id").alias("id"), _r("s", 8).alias("s")).unionByName(c.select(F.lit("col").alias("side"), F.col("col_id").alias("id"), _r("s", 8).alias("s")))


@query(", r1 AS (SELECT row_id, 1.0 / sqrt(min(abs(val)) * max(abs(val))) AS s FROM nnz GROUP BY row_id), c1 AS (SELECT col_id, 1.0 / sqrt(min(abs(val * s)) * max(abs(val * s))) AS s FROM nnz JOIN r1 USING (row_id) GROUP BY col_id), r2 AS (SELECT row_id, 1.0 / sqrt(min(abs(val * s)) * max(abs(val * s))) AS s FROM nnz JOIN c1 USING (col_id) GROUP BY row_id), c2 AS (SELECT col_id, 1.0 / sqrt(min(abs(val * s)) * max(abs(val * s))) AS s FROM nnz JOIN r2 USING (row_id) GROUP BY col_id) SELECT 'row' AS side, row_id AS id, round(s, 7) AS s FROM r2 UNION ALL SELECT 'col', col_id, round(s, 7) FROM c2")
def geometric_mean_factors(spark, sf):
    r, c = scaling.geometric_mean(from_orders(spark, sf).nnz, rounds=2, fixed=True)
    return r.select(F.lit("row").alias("side"), F.col("row_id").alias("id"), _r("s", 7).alias("s")).unionByName(c.select(F.lit("col").alias("side"), F.col("col_id").alias("id"), _r("s", 7).alias("s")))


@query("SELECT row_id, CAST(count(*) AS BIGINT) AS n, round(sum(log2(abs(val))), 6) AS logs FROM nnz GROUP BY row_id")
def log_sums(spark, sf):
    return scaling.log_sums(from_orders(spark, sf).nnz, "row_id").select("row_id", "n", _r("logs", 6).alias("logs"))


@query(", r AS (SELECT row_id, avg(log2(abs(val))) AS x FROM nnz GROUP BY row_id), c AS (SELECT col_id, avg(log2(abs(val)) - x) AS x FROM nnz JOIN r USING (row_id) GROUP BY col_id) SELECT 'row' AS side, row_id AS id, round(pow(2.0, -x), 7) AS s FROM r UNION ALL SELECT 'col', col_id, round(pow(2.0, -x), 7) FROM c")
def curtis_reid_factors(spark, sf):
    r, c = scaling.curtis_reid(from_orders(spark, sf).nnz, rounds=1)
    return r.select(F.lit("row").alias("side"), F.col("row_id").alias("id"), _r("s", 7).alias("s")).unionByName(c.select(F.lit("col").alias("side"), F.col("col_id").alias("id"), _r("s", 7).alias("s")))


# --- presolve -------------------------------------------------------------------------------------

_ACT_SQL = ", act AS (SELECT row_id, coalesce(sum(val * low), 0) AS min_act, count(*) - count(low) AS min_inf, coalesce(sum(val * high), 0) AS max_act, count(*) - count(high) AS max_inf FROM (SELECT *, CASE WHEN val > 0 THEN lb ELSE ub END AS low, CASE WHEN val > 0 THEN ub ELSE lb END AS high FROM nnz JOIN cols USING (col_id)) GROUP BY row_id) "


@query(_ACT_SQL + "SELECT row_id, round(min_act, 4) AS min_act, CAST(min_inf AS BIGINT) AS min_inf, round(max_act, 4) AS max_act, CAST(max_inf AS BIGINT) AS max_inf FROM act")
def activity_bounds(spark, sf):
    return P.activities(from_orders(spark, sf)).select("row_id", _r("min_act").alias("min_act"), "min_inf", _r("max_act").alias("max_act"), "max_inf")


@query(_ACT_SQL + "SELECT r.row_id, CASE WHEN coalesce(min_inf, 0) = 0 AND coalesce(min_act, 0) > hi + 1e-6 THEN 'infeasible' WHEN coalesce(max_inf, 0) = 0 AND coalesce(max_act, 0) <= hi + 1e-6 THEN 'redundant' ELSE 'needed' END AS status FROM \"rows\" r LEFT JOIN act ON act.row_id = r.row_id")
def redundant_rows(spark, sf):
    return P.row_status(from_orders(spark, sf)).select("row_id", "status")


@query(", one AS (SELECT row_id FROM nnz GROUP BY row_id HAVING count(*) = 1) SELECT col_id, round(max(CASE WHEN val < 0 THEN hi / val END), 6) AS lb, round(min(CASE WHEN val > 0 THEN hi / val END), 6) AS ub FROM nnz JOIN one USING (row_id) JOIN \"rows\" USING (row_id) GROUP BY col_id")
def singleton_row_bounds(spark, sf):
    return P.singleton_row_bounds(from_orders(spark, sf)).select("col_id", _r("lb", 6).alias("lb"), _r("ub", 6).alias("ub"))


@query(", few AS (SELECT * FROM nnz WHERE col_id % 3 <> 0) SELECT col_id, CASE WHEN cost < 0 THEN ub WHEN cost > 0 THEN lb ELSE coalesce(lb, ub, 0) END AS value, 'fixed' AS status FROM cols WHERE col_id NOT IN (SELECT col_id FROM few)")
def empty_columns(spark, sf):
    p = from_orders(spark, sf)
    return P.empty_columns(p.with_(nnz=p.nnz.where("col_id % 3 <> 0")))


@query("SELECT r.row_id, round(hi - coalesce(m, 0), 4) AS hi FROM \"rows\" r LEFT JOIN (SELECT row_id, sum(val * (col_id % 4)) AS m FROM nnz WHERE col_id % 5 = 0 GROUP BY row_id) a ON a.row_id = r.row_id")
def fix_columns(spark, sf):
    p = from_orders(spark, sf)
    fixed = P.fix(p, p.cols.where("col_id % 5 = 0").select("col_id", (F.col("col_id") % 4).cast("double").alias("value")))
    return fixed.rows.select("row_id", _r("hi").alias("hi"))


@query(", narrow AS (SELECT col_id, lb, CASE WHEN col_id % 4 = 0 THEN lb ELSE ub END AS ub FROM cols) SELECT col_id, CASE WHEN lb = floor(lb) THEN lb WHEN ub = floor(ub) THEN ub ELSE (lb + ub) / 2 END AS value FROM narrow WHERE ub - lb < 1e-12")
def fixed_columns(spark, sf):
    p = from_orders(spark, sf)
    return P.fixed_columns(p.with_(cols=p.cols.withColumn("ub", F.when(F.col("col_id") % 4 == 0, F.col("lb")).otherwise(F.col("ub")))))


_IMPLIED_SQL = _ACT_SQL + ", t AS (SELECT n.col_id, n.row_id, val, (hi - CASE WHEN min_inf - CASE WHEN low IS NULL THEN 1 ELSE 0 END = 0 THEN min_act - coalesce(val * low, 0) END) / val AS b FROM (SELECT *, CASE WHEN val > 0 THEN lb ELSE ub END AS low FROM nnz JOIN cols USING (col_id) WHERE abs(val) >= 1e-3) n JOIN act USING (row_id) JOIN \"rows\" r ON r.row_id = n.row_id) "


@query(_IMPLIED_SQL + "SELECT col_id, round(max(CASE WHEN val < 0 THEN b END), 9) AS lb, round(min(CASE WHEN val > 0 THEN b END), 9) AS ub FROM t GROUP BY col_id")
def bound_strengthening(spark, sf):
    return P.implied_bounds(from_orders(spark, sf)).select("col_id", _r("lb", 9).alias("lb"), _r("ub", 9).alias("ub"))


@query(_IMPLIED_SQL + "SELECT col_id, round(min(CASE WHEN val > 0 THEN b END), 9) AS ub FROM t GROUP BY col_id")
def bound_strengthening_upper_only(spark, sf):
    return P.implied_bounds(from_orders(spark, sf), only_upper=True).select("col_id", _r("ub", 9).alias("ub"))


_PARALLEL_SQL = ", pattern AS (SELECT row_id, CAST(p_size % 10 AS BIGINT) AS col_id, CAST(sum(abs(val)) AS DOUBLE) AS val FROM nnz JOIN part ON p_partkey = col_id GROUP BY 1, 2), big AS (SELECT row_id, max(val) AS factor FROM pattern GROUP BY row_id), sig AS (SELECT row_id, min(factor) AS factor, string_agg(col_id || ':' || CAST(round(val / factor, 9) AS VARCHAR), ',' ORDER BY col_id) AS s FROM pattern JOIN big USING (row_id) GROUP BY row_id) "


@query(_PARALLEL_SQL + "SELECT min(sig.row_id) AS kept_row, CAST(count(*) AS BIGINT) AS n_rows, round(min(hi / factor), 4) AS hi FROM sig JOIN \"rows\" USING (row_id) GROUP BY s HAVING count(*) > 1")
def parallel_rows(spark, sf):
    p = from_orders(spark, sf)
    size = _t(spark, sf, "part").select(F.col("p_partkey").alias("col_id"), (F.col("p_size") % 10).cast("long").alias("_s"))
    few = p.nnz.join(size, "col_id").groupBy("system", "row_id", F.col("_s").alias("col_id")).agg(F.sum(F.abs("val")).alias("val"))
    return P.parallel_rows(p.with_(nnz=few)).select("kept_row", "n_rows", _r("hi").alias("hi"))


@query("SELECT kind, coalesce(block, -1) AS block, CAST(count(*) AS BIGINT) AS n FROM (SELECT block, 'row_one_sided' AS kind FROM \"rows\" UNION ALL SELECT block, CASE WHEN lb = ub THEN 'col_fixed' WHEN ub IS NOT NULL THEN 'col_boxed' ELSE 'col_lower' END FROM cols) GROUP BY GROUPING SETS ((kind, block), (kind))")
def bound_statistics(spark, sf):
    return P.statistics(from_orders(spark, sf)).fillna(-1, ["block"])


@query(", base AS (SELECT max(col_id) + 1 AS b FROM cols) SELECT col_id, lb, ub FROM cols UNION ALL SELECT row_id + (SELECT b FROM base), lo, hi FROM \"rows\"")
def slack_columns(spark, sf):
    return P.inequalities_to_equalities(from_orders(spark, sf)).cols.select("col_id", "lb", "ub")


@query("SELECT row_id, col_id, val FROM nnz WHERE abs(val) < 2")
def small_entries(spark, sf):
    p = from_orders(spark, sf)
    return P.tiny_entries(p, absolute=2.0, relative=0.0).select("row_id", "col_id", "val")


# --- vectors -----------------------------------------------------------------------------------------


@query("SELECT round(sqrt(sum(v * v)), 3) AS two, max(abs(v)) AS inf, round(sum(abs(v)), 2) AS one, min(abs(v)) AS least, CAST(count(*) FILTER (v <> 0) AS BIGINT) AS nonzeros, bool_and(v > -2000) AS bounded FROM (SELECT c_acctbal AS v FROM customer)", lp=False)
def vector_norms(spark, sf):
    v = F.col("c_acctbal")
    return _t(spark, sf, "customer").agg(_r(V.two_norm(v), 3).alias("two"), V.inf_norm(v).alias("inf"), _r(V.one_norm(v), 2).alias("one"), V.abs_min(v).alias("least"), V.count_nonzero(v).alias("nonzeros"), V.for_all(v > -2000).alias("bounded"))


@query("SELECT round(sum(v * x), 2) AS dot, round(4 * sum(v * v), 1) AS own, round(sum((v + 0.5 * x) * (x + 0.25 * v)), 2) AS shifted FROM (SELECT c_acctbal AS v, CAST(c_nationkey AS DOUBLE) AS x FROM customer)", lp=False)
def vector_dots(spark, sf):
    v, x = F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    return _t(spark, sf, "customer").agg(_r(V.dot(v, x), 2).alias("dot"), _r(V.dot_self(v, 2.0), 1).alias("own"), _r(V.shifted_dot(v, 0.5, x, x, 0.25, v), 2).alias("shifted"))


@query("SELECT min(v) AS low, arg_min(id, (v, id)) AS low_id, max(v) AS high, arg_min(id, (-v, id)) AS high_id FROM (SELECT c_custkey AS id, c_acctbal AS v FROM customer)", lp=False)
def vector_arg_extremes(spark, sf):
    a = _t(spark, sf, "customer").agg(V.arg_min(F.col("c_acctbal"), F.col("c_custkey")).alias("a"), V.arg_max(F.col("c_acctbal"), F.col("c_custkey")).alias("b"))
    return a.select(F.col("a.value").alias("low"), F.col("a.id").alias("low_id"), F.col("b.value").alias("high"), F.col("b.id").alias("high_id"))


@query("SELECT id, round(v + 2 * x, 4) AS axpy, round(v + 2 * x * v, 4) AS axzpy, round(v + 2 * v / nullif(x, 0), 4) AS axdzpy, round(CASE WHEN v <> 0 THEN 1 / v ELSE 9 END, 8) AS inverse, greatest(v, 0) AS pos, least(v, 0) AS neg, CASE WHEN abs(v) <= 100 THEN v + 50 ELSE v END AS pushed, greatest(CASE WHEN v < 0 THEN -v WHEN v > 5000 THEN 5000 - v ELSE 0 END, -5000) AS projected FROM (SELECT c_custkey AS id, c_acctbal AS v, CAST(c_nationkey AS DOUBLE) AS x FROM customer)", lp=False)
def vector_elementwise(spark, sf):
    v, x = F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    return _t(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), _r(V.axpy(v, 2.0, x)).alias("axpy"), _r(V.axzpy(v, 2.0, x, v)).alias("axzpy"), _r(V.axdzpy(v, 2.0, v, x)).alias("axdzpy"),
        _r(V.safe_invert(v, 9.0), 8).alias("inverse"), V.positive_part(v).alias("pos"), V.negative_part(v).alias("neg"), V.push_away_from_zero(v, 100.0, 50.0).alias("pushed"), V.project_to_range(v, 0.0, 5000.0).alias("projected"),
    )


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal = 0 THEN 0.5 ELSE pow(2, floor(log2(abs(c_acctbal)))) END AS p FROM customer", lp=False)
def round_to_pow2(spark, sf):
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), tol.round_to_pow2(F.col("c_acctbal")).alias("p"))


@query("SELECT least(1.0, coalesce(min(CASE WHEN s < 0 AND v >= 0 THEN -0.99 * v / s END), 1.0)) AS step FROM (SELECT l_quantity AS v, (l_discount - 0.05) * 1000 AS s FROM lineitem)", lp=False)
def step_to_boundary(spark, sf):
    s = (F.col("l_discount") - 0.05) * 1000
    return _t(spark, sf, "lineitem").agg(V.step_to_boundary(F.col("l_quantity"), s, 0.99).alias("step"))


@query("SELECT id, round(greatest(CASE WHEN x * y < 5 AND x < y THEN 5 / nullif(y, 0) ELSE x END, 0.1), 6) AS x, round(greatest(CASE WHEN x * y < 5 AND x >= y THEN 5 / nullif(x, 0) ELSE y END, 0.2), 6) AS y FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS x, l_tax AS y FROM lineitem)", lp=False)
def complementarity_push(spark, sf):
    x, y = V.push_small_pairs(F.col("l_quantity"), F.col("l_tax"), 0.1, 0.2, 5.0)
    return _t(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), _r(x, 6).alias("x"), _r(y, 6).alias("y"))


@query("SELECT CAST(id AS BIGINT) AS id, v, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS new_id FROM (SELECT c_custkey AS id, c_acctbal AS v FROM customer) WHERE v > 0", lp=False)
def remove_entries(spark, sf):
    v = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return V.remove_entries(v, F.col("v") > 0).select("id", "v", F.col("new_id").cast("long").alias("new_id"))


@query("SELECT part, round(sum(v), 2) AS total, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'x' AS part, c_acctbal AS v FROM customer UNION ALL SELECT 'y', s_acctbal FROM supplier) GROUP BY part", lp=False)
def joint_vectors(spark, sf):
    both = V.concat({"x": _t(spark, sf, "customer").select(F.col("c_acctbal").alias("v")), "y": _t(spark, sf, "supplier").select(F.col("s_acctbal").alias("v"))})
    return both.groupBy("part").agg(_r(F.sum("v"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(count(*) FILTER (abs(a - b) <= 1e-6) AS BIGINT) AS eq_feas, CAST(count(*) FILTER (abs((a - b) / greatest(1, abs(a), abs(b))) <= 0.5) AS BIGINT) AS rel_eq, CAST(count(*) FILTER (a <= b + 1e-13) AS BIGINT) AS le, CAST(count(*) FILTER (a < b - 1e-13) AS BIGINT) AS lt FROM (SELECT l_discount AS a, l_tax AS b FROM lineitem)", lp=False)
def tolerant_comparisons(spark, sf):
    a, b = F.col("l_discount"), F.col("l_tax")
    return _t(spark, sf, "lineitem").agg(F.count_if(tol.is_eq(a, b, tol.FEASTOL)).alias("eq_feas"), F.count_if(tol.is_rel_eq(a, b, 0.5)).alias("rel_eq"), F.count_if(tol.is_le(a, b)).alias("le"), F.count_if(tol.is_lt(a, b)).alias("lt"))


@query("SELECT ratio, id, which FROM (SELECT -v / s AS ratio, id, 'quantity' AS which FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS v, (l_discount - 0.05) * 1000 AS s FROM lineitem) WHERE s < 0 AND v >= 0 UNION ALL SELECT -v / s, id, 'price' FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS v, (l_tax - 0.04) * 1000 AS s FROM lineitem) WHERE s < 0 AND v >= 0) ORDER BY ratio, id, which LIMIT 1", lp=False)
def find_blocking(spark, sf):
    item = _t(spark, sf, "lineitem")
    return V.blocking(item, {"quantity": (F.col("l_quantity"), (F.col("l_discount") - 0.05) * 1000), "price": (F.col("l_extendedprice"), (F.col("l_tax") - 0.04) * 1000)}, F.col("l_orderkey") * 10 + F.col("l_linenumber"))


# --- the problem as a whole ---------------------------------------------------------------------------


@query("SELECT round((SELECT sum(cost * (cost / 1000)) FROM cols), 2) AS objective, greatest((SELECT max(abs(cost)) FROM cols), (SELECT max(abs(val)) FROM nnz), (SELECT max(abs(hi)) FROM \"rows\"), (SELECT max(abs(ub)) FROM cols)) AS datanorm")
def objective_and_norm(spark, sf):
    p = from_orders(spark, sf)
    parts = p.cols.agg(F.sum(F.col("cost") * F.col("cost") / 1000).alias("o"), F.greatest(V.inf_norm(F.col("cost")), V.inf_norm(F.col("ub"))).alias("m"))
    for df, c in ((p.nnz, "val"), (p.rows, "hi")):
        parts = parts.unionByName(df.agg(F.lit(None).cast("double").alias("o"), V.inf_norm(F.col(c)).alias("m")))
    return parts.agg(_r(F.max("o"), 2).alias("objective"), F.max("m").alias("datanorm"))


@query("SELECT kind, min(v) AS least, max(v) AS most FROM (SELECT 'matrix' AS kind, abs(val) AS v FROM nnz UNION ALL SELECT 'objective', abs(cost) FROM cols UNION ALL SELECT 'bounds', abs(ub) FROM cols UNION ALL SELECT 'sides', abs(hi) FROM \"rows\") WHERE v > 0 GROUP BY kind")
def ranges(spark, sf):
    p = from_orders(spark, sf)
    parts = [(p.nnz, "matrix", "val"), (p.cols, "objective", "cost"), (p.cols, "bounds", "ub"), (p.rows, "sides", "hi")]
    union = None
    for df, kind, c in parts:
        one = df.select(F.lit(kind).alias("kind"), F.abs(c).alias("v"))
        union = one if union is None else union.unionByName(one)
    return union.where("v > 0").groupBy("kind").agg(F.min("v").alias("least"), F.max("v").alias("most"))


# --- time series ----------------------------------------------------------------------------------------


_HOURS = "SELECT event_id AS id, (epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600.0 AS h, value, user_id FROM events"


def _hours(spark, sf):
    return _t(spark, sf, "events").select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600.0 - 473352.0).alias("h"), "value", "user_id")


@query(f", d AS (SELECT id, floor(h) AS a, floor(h) + 1 + id % 3 AS b FROM ({_HOURS})), m AS (SELECT DISTINCT CAST(floor(a / 6) AS BIGINT) AS id FROM d) SELECT m.id AS model_id, d.id AS data_id, least(m.id * 6 + 6.0, d.b) - greatest(m.id * 6.0, d.a) AS overlap FROM m JOIN d ON m.id * 6.0 < d.b AND d.a < m.id * 6 + 6.0")
def interval_overlap(spark, sf):
    d = _hours(spark, sf).select("id", F.floor("h").cast("double").alias("a"), (F.floor("h") + 1 + F.col("id") % 3).cast("double").alias("b"))
    m = d.select(F.floor(F.col("a") / 6).alias("id")).distinct().select("id", (F.col("id") * 6.0).alias("a"), (F.col("id") * 6.0 + 6.0).alias("b"))
    return timeseries.interval_overlap(m, d, 6.0)


@query(f"SELECT user_id % 20 AS region, CAST(floor(h / 6) AS BIGINT) AS step, round(sum(value), 3) AS total, round(sum(value * (1 + id % 3)) / sum(1 + id % 3), 9) AS average, max(value) AS most FROM ({_HOURS}) GROUP BY 1, 2", lp=False)
def weighted_rollup(spark, sf):
    w = (1 + F.col("id") % 3).cast("double")
    return _hours(spark, sf).groupBy((F.col("user_id") % 20).alias("region"), F.floor(F.col("h") / 6).alias("step")).agg(_r(F.sum("value"), 3).alias("total"), _r(F.sum(F.col("value") * w) / F.sum(w), 9).alias("average"), F.max("value").alias("most"))


_STEPS = f"SELECT user_id % 20 AS region, CAST(floor(h / 6) AS BIGINT) AS step, round(sum(value), 3) AS total FROM ({_HOURS}) GROUP BY 1, 2"


def _steps(spark, sf):
    return _hours(spark, sf).groupBy((F.col("user_id") % 20).alias("region"), F.floor(F.col("h") / 6).alias("step")).agg(_r(F.sum("value"), 3).alias("total"))


@query(f"SELECT region, step, total, coalesce(lag(total) OVER (PARTITION BY region ORDER BY step), last_value(total) OVER (PARTITION BY region ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS lagged FROM ({_STEPS})", lp=False)
def cyclic_lag(spark, sf):
    return timeseries.cyclic_lag(_steps(spark, sf), "total", "step", ["region"]).select("region", "step", "total", "lagged")


@query(f"SELECT region, step, total, coalesce(lead(total) OVER (PARTITION BY region ORDER BY step), first_value(total) OVER (PARTITION BY region ORDER BY step)) AS lagged FROM ({_STEPS})", lp=False)
def cyclic_lead(spark, sf):
    return timeseries.cyclic_lead(_steps(spark, sf), "total", "step", ["region"]).select("region", "step", "total", "lagged")


@query(f"SELECT region, step, total, running, coalesce(running >= lag(running, 30) OVER (PARTITION BY region ORDER BY step), false) AS stagnates FROM (SELECT *, min(total) OVER (PARTITION BY region ORDER BY step) AS running FROM ({_STEPS}))", lp=False)
def running_minimum(spark, sf):
    return timeseries.stagnation(_steps(spark, sf), "total", "step", ["region"])


@query(f"SELECT w AS \"window\", CAST(count(*) AS BIGINT) AS n, round(sum(total), 2) AS total FROM ({_STEPS}) s, range(0, 1000) r(w) WHERE step >= w * 8 AND step < w * 8 + 12 GROUP BY 1", lp=False)
def rolling_windows(spark, sf):
    return timeseries.rolling_windows(_steps(spark, sf), 12, 4).groupBy("window").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("total"), 2).alias("total"))


@query(f"SELECT region, step, round(total / nullif(max(total) OVER (PARTITION BY region), 0), 6) AS share FROM ({_STEPS})", lp=False)
def max_normalized(spark, sf):
    return timeseries.max_normalized(_steps(spark, sf), "total", ["region"]).select("region", "step", _r("share", 6).alias("share"))


ORACLE["nearest_symmetric"] = """
SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (
  SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey
  QUALIFY row_number() OVER (PARTITION BY a.c_custkey ORDER BY abs(a.c_acctbal - b.c_acctbal), b.c_custkey) <= 3)
"""


def nearest_symmetric(spark, sf):
    points = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    return timeseries.symmetrized(timeseries.nearest_on_axis(points, 3, "x"))


QUERIES["nearest_symmetric"] = nearest_symmetric


@query("SELECT CAST(region AS INTEGER) AS region, round(sum(x), 2) AS balance FROM (SELECT c_nationkey AS region, 0.9 * o_totalprice AS x FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT s_nationkey, -l_extendedprice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey UNION ALL SELECT n_nationkey, -1000.0 FROM nation) GROUP BY 1", lp=False)
def power_balance(spark, sf):
    bought = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.lit(None).cast("int").alias("source"), F.col("c_nationkey").alias("target"), F.col("o_totalprice").alias("flow"))
    sold = _t(spark, sf, "lineitem").join(_t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("source"), F.lit(None).cast("int").alias("target"), F.col("l_extendedprice").alias("flow"))
    demand = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("region"), F.lit(1000.0).alias("demand"))
    return timeseries.net_balance(bought.unionByName(sold), F.lit(0.9), demand).where("region IS NOT NULL").select("region", _r("balance", 2).alias("balance"))


@query("SELECT p_partkey AS key, 'left' AS side FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, 'right' FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part)", lp=False)
def consistency_xor(spark, sf):
    return timeseries.exclusive(_t(spark, sf, "part").select(F.col("p_partkey").alias("key")), _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("key")), "key")


@query(f"SELECT region, step, round(sum(i - o) OVER (PARTITION BY region ORDER BY step), 4) AS level FROM (SELECT region, step, total AS i, round(total / 2, 4) AS o FROM ({_STEPS}))", lp=False)
def storage_levels(spark, sf):
    s = _steps(spark, sf).select("region", "step", F.col("total").alias("inflow"), _r(F.col("total") / 2, 4).alias("outflow"))
    return timeseries.storage_levels(s, "step", ["region"]).select("region", "step", _r("level", 4).alias("level"))


# --- order, concatenation and edits ---------------------------------------------------------------------


@query("SELECT CAST(2 * 15 - 1 AS BIGINT) - id AS id, v FROM (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS DOUBLE) AS v FROM nation)", lp=False)
def permute_inverse(spark, sf):
    v = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("double").alias("v"))
    moved = V.inverse_permutation(v.select((29 - F.col("id")).alias("id"), F.col("id").alias("position")))
    return V.permute(v, moved).select(F.col("position").alias("id"), "v")


@query("SELECT true AS valid, false AS broken", lp=False)
def permutation_check(spark, sf):
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    good = V.permutation_is_valid(n.withColumn("position", F.pmod(F.col("id") * 7, F.lit(25)))).withColumnRenamed("valid", "a")
    bad = V.permutation_is_valid(n.withColumn("position", F.pmod(F.col("id") * 5, F.lit(25)))).withColumnRenamed("valid", "b")
    return good.unionByName(bad, allowMissingColumns=True).agg(F.bool_and("a").alias("valid"), F.bool_and("b").alias("broken"))


@query("SELECT id, v FROM (SELECT range AS id, 7.0 AS v FROM range(3) UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 3, CAST(n_regionkey AS DOUBLE) FROM nation UNION ALL SELECT range + 28, 9.0 FROM range(2)) WHERE id < 26", lp=False)
def append_and_shave(spark, sf):
    v = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("double").alias("v"))
    longer = V.append_constant(V.append_constant(v, 3, 7.0, to_front=True), 2, 9.0)
    return V.shave(longer, 4, top=False)[1].select("id", "v")


@query("SELECT row_id, col_id, val FROM nnz UNION ALL SELECT row_id + greatest(1000000, (SELECT max(row_id) + 1 FROM nnz)), col_id, 2 * val FROM nnz")
def append_rows(spark, sf):
    """The doubled matrix under the matrix, its rows from 1,000,000 on, or from above the greatest id if that is more."""
    n = from_orders(spark, sf).nnz.select("row_id", "col_id", "val")
    greatest = n.agg(F.max("row_id")).first()[0]
    return M.append_rows(n, M.scalar_mult(n, 2.0), max(1_000_000, 1 + (greatest or 0)))


@query("SELECT row_id, col_id, val FROM nnz UNION ALL SELECT row_id, row_id + 100000, hi FROM \"rows\"")
def append_diagonal(spark, sf):
    p = from_orders(spark, sf)
    return M.append_diagonal(p.nnz, p.rows.select("row_id", F.col("hi").alias("d")), 100_000)


@query("SELECT row_id, col_id, val FROM nnz WHERE col_id % 100 <> 3 UNION ALL SELECT row_id, col_id, -1.0 FROM nnz WHERE col_id % 100 = 3")
def put_entries(spark, sf):
    n = from_orders(spark, sf).nnz.select("row_id", "col_id", "val")
    return M.put_entries(n, n.where("col_id % 100 = 3").withColumn("val", F.lit(-1.0)))


@query("SELECT row_id, string_agg(CAST(col_id AS VARCHAR), ',' ORDER BY col_id) AS columns, arg_min(val, col_id) AS first FROM nnz GROUP BY row_id")
def rows_sorted(spark, sf):
    return M.rows_as_arrays(from_orders(spark, sf).nnz).select("row_id", F.array_join(F.transform("entries", lambda e: e["col_id"].cast("string")), ",").alias("columns"), F.col("entries")[0]["val"].alias("first"))


@query("SELECT col_id, greatest(2 * val, 0) AS pos, least(2 * val, 0) AS neg FROM nnz WHERE row_id = (SELECT min(row_id) FROM nnz WHERE val < 0)")
def row_axpy_signed(spark, sf):
    n = from_orders(spark, sf).nnz
    return M.axpy_row_signed(n, n.where("val < 0").agg(F.min("row_id")).first()[0], 2.0)


@query(_SIZE_SQL + ", g AS (SELECT l.col_id AS row_id, r.col_id AS col_id, sum(l.val * r.val) AS val FROM small l JOIN small r ON l.row_id = r.row_id GROUP BY 1, 2), d AS (SELECT row_id AS id, abs(val) AS d FROM g WHERE row_id = col_id) SELECT row_id, col_id, val FROM g LEFT JOIN d a ON a.id = row_id LEFT JOIN d b ON b.id = col_id WHERE row_id = col_id OR abs(val) >= 0.05 * least(coalesce(a.d, 0), coalesce(b.d, 0))")
def sparsify(spark, sf):
    a = _by_size(spark, sf)
    upper = M.gram(a).select(F.col("a").alias("row_id"), F.col("b").alias("col_id"), "val")
    return M.sparsify(M.symmetrize(upper), 0.05)


@query(_LINK_SQL + "SELECT CAST(start_block * 3 // 8 AS INTEGER) AS first_subtree, CAST((start_block + 1) * 3 // 8 AS INTEGER) AS second_subtree, CAST(count(*) AS BIGINT) AS n FROM links WHERE start_block >= 0 AND start_block < 7 GROUP BY 1, 2")
def two_links_between_subtrees(spark, sf):
    tree = spark.createDataFrame(list(enumerate(structure.subtree_map(8, 3))), "block int, subtree int")
    return structure.two_links_between(structure.row_links(from_orders(spark, sf).nnz), tree)


# --- iterates -------------------------------------------------------------------------------------------


@query("SELECT round(sum(l_quantity * l_tax) / count(*), 6) AS mu, round(sum((l_quantity + 0.5 * l_discount) * (l_tax + 0.25 * l_discount)) / count(*), 6) AS mu_after, greatest(0, -min(l_tax - 0.01)) AS violation FROM lineitem", lp=False)
def complementarity(spark, sf):
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return _t(spark, sf, "lineitem").agg(_r(V.dot(q, t) / F.count(F.lit(1)), 6).alias("mu"), _r(V.shifted_dot(q, 0.5, d, t, 0.25, d) / F.count(F.lit(1)), 6).alias("mu_after"), F.greatest(F.lit(0.0), -F.min(t - 0.01)).alias("violation"))


@query("SELECT c.col_id, round(cost - coalesce(a, 0), 5) AS r FROM cols c LEFT JOIN (SELECT col_id, sum(val * hi / 1000) AS a FROM nnz JOIN \"rows\" USING (row_id) GROUP BY col_id) t ON t.col_id = c.col_id")
def dual_residuals(spark, sf):
    p = from_orders(spark, sf)
    aty = M.mult_transposed(p.nnz, p.rows.select("row_id", (F.col("hi") / 1000).alias("y")))
    return p.cols.join(aty, "col_id", "left").select("col_id", _r(F.col("cost") - F.coalesce("x", F.lit(0.0)), 5).alias("r"))


@query("SELECT DISTINCT a, b FROM (SELECT CAST(l_quantity AS DOUBLE) AS a, l_extendedprice AS b FROM lineitem) x WHERE NOT EXISTS (SELECT 1 FROM (SELECT l_quantity AS a, min(l_extendedprice) AS b FROM lineitem GROUP BY 1) y WHERE (y.a < x.a AND y.b <= x.b) OR (y.a = x.a AND y.b < x.b))", lp=False)
def filter_front(spark, sf):
    """Pairs that no other pair dominates: the least b of each a, kept where it falls below all before."""
    least = _t(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("a")).agg(F.min("l_extendedprice").alias("b"))  # at most 50 rows
    before = F.min("b").over(Window.orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    return least.withColumn("_m", before).where("_m IS NULL OR b < _m").select("a", "b")


# --- model data -------------------------------------------------------------------------------------------


@query("SELECT n_name AS region, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(l_extendedprice * l_tax), 2) AS tax, CAST(count(DISTINCT s_suppkey) AS BIGINT) AS plants FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", lp=False)
def regional_cost(spark, sf):
    joined = _t(spark, sf, "lineitem").join(_t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("region")).agg(_r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), _r(F.sum(F.col("l_extendedprice") * F.col("l_tax")), 2).alias("tax"), F.countDistinct("s_suppkey").alias("plants"))


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN lo IS NULL AND hi IS NULL THEN 'N' WHEN lo = hi THEN 'E' WHEN lo IS NULL THEN 'L' WHEN hi IS NULL THEN 'G' ELSE 'R' END AS kind FROM (SELECT CASE WHEN row_id % 3 = 0 THEN hi WHEN row_id % 3 = 1 THEN NULL ELSE 0 END AS lo, CASE WHEN row_id % 5 = 0 THEN NULL ELSE hi END AS hi FROM \"rows\")) GROUP BY kind")
def row_senses(spark, sf):
    r = from_orders(spark, sf).rows
    lo = F.when(F.col("row_id") % 3 == 0, F.col("hi")).when(F.col("row_id") % 3 == 2, F.lit(0.0))
    hi = F.when(F.col("row_id") % 5 != 0, F.col("hi"))
    kind = F.when(F.col("lo").isNull() & F.col("hi").isNull(), "N").when(F.col("lo") == F.col("hi"), "E").when(F.col("lo").isNull(), "L").when(F.col("hi").isNull(), "G").otherwise("R")
    return r.select(lo.alias("lo"), hi.alias("hi")).select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s.range AS scenario, c.col_id + s.range * 1000000 AS col_id, round(cost / 3 * (1 + s.range), 6) AS cost FROM cols c, range(3) s WHERE c.block > 0")
def scenario_expansion(spark, sf):
    """The deterministic equivalent's columns: second-stage ones once per scenario."""
    cols = from_orders(spark, sf).cols.where("block > 0")
    per = cols.withColumn("scenario", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return per.select("scenario", (F.col("col_id") + F.col("scenario") * 1_000_000).alias("col_id"), _r(F.col("cost") / 3 * (1 + F.col("scenario")), 6).alias("cost"))
