"""Row and column scaling of a problem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators import matrix
from blockloom.plans.lp import Problem
from blockloom.session import checkpoint


def ratios(nnz: DataFrame, by: str, scale: DataFrame | None = None) -> DataFrame:
    """One row, `ratio`: the greatest most/least of the rows or columns."""
    return matrix.extremes(nnz, by, scale).agg(F.max(F.col("most") / F.col("least")).alias("ratio"))


def factors(nnz: DataFrame, by: str, scale: DataFrame | None = None, geometric: bool = False) -> DataFrame:
    """(row_id or col_id, s): 1 / most, or 1 / sqrt(least most)."""
    e = matrix.extremes(nnz, by, scale)
    return e.select(*(matrix.row_key(e) if by == "row_id" else [by]), (1.0 / (F.sqrt(F.col("least") * F.col("most")) if geometric else F.col("most"))).alias("s"))


def equilibrium(nnz: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row factors, column factors): rows to a greatest entry of 1, then columns."""
    r = factors(nnz, "row_id")
    return r, factors(nnz, "col_id", r)


def geometric_mean(nnz: DataFrame, rounds: int = 10, worth: float = 0.15, needed: float = 500.0, equilibrate: bool = False, fixed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Alternating geometric-mean factors.

    They begin only above a ratio of `needed` and stop when a round improves it by less than
    `worth`; fixed always takes all rounds.
    """
    key = matrix.row_key(nnz)
    r = nnz.select(*key).distinct().withColumn("s", F.lit(1.0))
    c = nnz.select("col_id").distinct().withColumn("s", F.lit(1.0))
    last = float(ratios(nnz, "row_id").first()[0] or 1.0) if not fixed else 0.0
    if fixed or last > needed:
        for _ in range(rounds):
            r = checkpoint(factors(nnz, "row_id", c, True))  # the next round begins here, not at the entries
            c = checkpoint(factors(nnz, "col_id", r, True))
            if not fixed:
                now = float(ratios(matrix.row_scale(nnz, r), "row_id", c).first()[0] or 1.0)
                if now > (1 - worth) * last:
                    break
                last = now
    if equilibrate:
        scaled = matrix.column_scale(matrix.row_scale(nnz, r), c)
        er, ec = equilibrium(scaled)
        r = r.join(er.withColumnRenamed("s", "t"), key).select(*key, (F.col("s") * F.col("t")).alias("s"))
        c = c.join(ec.withColumnRenamed("s", "t"), "col_id").select("col_id", (F.col("s") * F.col("t")).alias("s"))
    return r, c


def log_sums(nnz: DataFrame, by: str) -> DataFrame:
    """(id, n, logs): entries and the sum of log2 |a| of each row or column."""
    return nnz.groupBy(*(matrix.row_key(nnz) if by == "row_id" else [by])).agg(F.count(F.lit(1)).alias("n"), F.sum(F.log2(F.abs("val"))).alias("logs"))


def curtis_reid(nnz: DataFrame, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """Factors 2**-x that minimise the squared logs, by alternating exact minimisation."""
    key = matrix.row_key(nnz)
    logs = nnz.select(*key, "col_id", F.log2(F.abs("val")).alias("l"))
    c = logs.select("col_id").distinct().withColumn("x", F.lit(0.0))
    r = None
    for _ in range(rounds):
        r = checkpoint(logs.join(c, "col_id").groupBy(*key).agg(F.avg(F.col("l") - F.col("x")).alias("x")))
        c = checkpoint(logs.join(r, key).groupBy("col_id").agg(F.avg(F.col("l") - F.col("x")).alias("x")))
    power = F.pow(F.lit(2.0), -F.col("x")).alias("s")
    return r.select(*key, power), c.select("col_id", power)


def apply(p: Problem, r: DataFrame, c: DataFrame) -> Problem:
    """Entries by row and column, sides by row, bounds divided by the column's factor, costs times it."""
    s = F.coalesce("s", F.lit(1.0))
    cols = p.cols.join(c, "col_id", "left").withColumns({"cost": F.col("cost") * s, "lb": F.col("lb") / s, "ub": F.col("ub") / s}).drop("s")
    rows = p.rows.join(r, matrix.row_key(p.rows, r), "left").withColumns({"lo": F.col("lo") * s, "hi": F.col("hi") * s}).drop("s")
    return p.with_(cols=cols.select(*p.cols.columns), rows=rows.select(*p.rows.columns), nnz=matrix.column_scale(matrix.row_scale(p.nnz, r), c).select(*p.nnz.columns))


def unscale(x: DataFrame, c: DataFrame) -> DataFrame:
    """(col_id, x) of the scaled problem in the original one."""
    return x.join(c, "col_id", "left").select("col_id", (F.col("x") * F.coalesce("s", F.lit(1.0))).alias("x"))


def unscale_duals(y: DataFrame, r: DataFrame) -> DataFrame:
    """(row key, y) of the scaled problem in the original one."""
    key = matrix.row_key(y, r)
    return y.join(r, key, "left").select(*key, (F.col("y") * F.coalesce("s", F.lit(1.0))).alias("y"))


def unscale_residuals(rows: DataFrame, cols: DataFrame, r: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Residuals (row key, r) and (col_id, r) of the scaled problem in the original one: each divided by its factor."""
    key, s = matrix.row_key(rows, r), F.coalesce("s", F.lit(1.0))
    return rows.join(r.withColumnRenamed("r", "s"), key, "left").select(*key, (F.col("r") / s).alias("r")), cols.join(c, "col_id", "left").select("col_id", (F.col("r") / s).alias("r"))


def scale_objective(p: Problem, factor: float) -> Problem:
    """Costs and offset times a factor."""
    return p.with_(cols=p.cols.withColumn("cost", F.col("cost") * factor), offset=p.offset * factor)


def unscaled_objective(value: float, factor: float) -> float:
    return value / factor


def better_first(nnz: DataFrame) -> str:
    """Which side equilibrium scaling should begin with: that whose ratios are the smaller ones."""
    return "row_id" if float(ratios(nnz, "row_id").first()[0] or 1.0) < float(ratios(nnz, "col_id").first()[0] or 1.0) else "col_id"


def equilibrium_chosen(nnz: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row factors, column factors), beginning with the side that better_first names."""
    if better_first(nnz) == "row_id":
        return equilibrium(nnz)
    c = factors(nnz, "col_id")
    return factors(nnz, "row_id", c), c
