"""Lagrangian relaxation of linking rows, by subgradient steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators import matrix as M
from blockloom.plans.lp import Problem
from blockloom.session import checkpoint

ROW = ["system", "row_id"]


@dataclass
class Relaxed:
    bound: float  # the best lower bound
    bounds: list[float]  # one a round
    multipliers: DataFrame  # system, row_id, y of the best round


def relax(p: Problem, rounds: int = 20, step: float = 1.0) -> Relaxed:
    """Lower bounds of min c'x with all rows relaxed into the objective and x between its bounds.

    What remains falls apart by columns: each stands at the bound that its reduced cost asks
    for.  Round k moves the multipliers by step / (k + 1) along the rows' violations over their
    norm; those of one-sided rows keep their sign.  A column without the bound that its cost
    asks for gives no bound and raises an error.
    """
    y = checkpoint(p.rows.select(*ROW, F.lit(0.0).alias("y")))
    bounds: list[float] = []
    best, kept = float("-inf"), y
    for k in range(rounds):
        aty = M.mult_transposed(p.nnz, y).withColumnRenamed("x", "_a")
        reduced = p.cols.join(aty, "col_id", "left").withColumn("_r", F.col("cost") - F.coalesce("_a", F.lit(0.0)))
        x = checkpoint(reduced.select("col_id", "_r", F.when(F.col("_r") > 0, F.col("lb")).when(F.col("_r") < 0, F.col("ub")).otherwise(F.coalesce("lb", "ub", F.lit(0.0))).alias("x")))
        r = x.agg(F.count_if(F.col("x").isNull()).alias("open"), F.coalesce(F.sum(F.col("_r") * F.col("x")), F.lit(0.0)).alias("value")).first()
        if r["open"]:
            raise ValueError(f"{r['open']} columns have no bound against their reduced cost")
        side = F.when(F.col("y") > 0, F.col("lo")).otherwise(F.col("hi"))
        sides = p.rows.join(y, ROW).agg(F.coalesce(F.sum(F.when(F.col("y") != 0, F.col("y") * side)), F.lit(0.0))).first()[0]
        bound = float(r["value"] + sides + p.offset)
        bounds.append(bound)
        if bound > best:
            best, kept = bound, y
        value = p.rows.join(y, ROW).join(M.mult(p.nnz, x.select("col_id", "x")).withColumnRenamed("y", "_v"), ROW, "left").withColumn("_v", F.coalesce("_v", F.lit(0.0)))
        lacks = F.greatest(F.coalesce(F.col("lo") - F.col("_v"), F.lit(0.0)), F.lit(0.0))  # below the lower side: y grows
        over = F.greatest(F.coalesce(F.col("_v") - F.col("hi"), F.lit(0.0)), F.lit(0.0))
        slack = F.when(F.col("y") > 0, F.col("lo") - F.col("_v")).when(F.col("y") < 0, F.col("hi") - F.col("_v")).otherwise(lacks - over)
        moved = checkpoint(value.withColumn("_g", slack))
        norm = moved.agg(F.sqrt(F.sum(F.col("_g") * F.col("_g")))).first()[0] or 0.0
        if not norm:
            break
        to = F.col("y") + step / (k + 1) / norm * F.col("_g")
        to = F.when(F.col("lo").isNull(), F.least(to, F.lit(0.0))).when(F.col("hi").isNull(), F.greatest(to, F.lit(0.0))).otherwise(to)
        y = checkpoint(moved.select(*ROW, to.alias("y")))
    return Relaxed(best, bounds, kept)
