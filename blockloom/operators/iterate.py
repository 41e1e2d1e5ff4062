"""Primal-dual iterates: residuals, complementarity, steps and the parts of a solution.

    cols(col_id, x, v, w, gamma, phi)                 v, w: gaps to lb and ub, with duals gamma and phi
    rows(system, row_id, s, y, t, u, lam, pi)         t, u: gaps to lo and hi, with duals lam and pi

What belongs to a missing bound is null.  Of an equality row only y is set; of an inequality y
is its dual (lam - pi at a solution) and s its slack, the value that C x should have.  All four
gap families are rows of one table, so a step length or the average complementarity is one
aggregate over it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.operators import matrix as M
from blockloom.plans.lp import Problem

ROW = ["system", "row_id"]
#: Of each family of gaps: its dual, and where both stand.
FAMILIES = {"t": ("lam", "rows"), "u": ("pi", "rows"), "v": ("gamma", "cols"), "w": ("phi", "cols")}


@dataclass(frozen=True)
class Iterate:
    cols: DataFrame
    rows: DataFrame

    def with_(self, **changes) -> Iterate:
        return replace(self, **changes)


def _zero(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


# --- gaps and steps -------------------------------------------------------------------------------


def gaps(it: Iterate) -> DataFrame:
    """family, system, id, gap, dual: all pairs that exist; system is null for columns."""
    def of(df: DataFrame, names: list[str], system: Column, ident: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(n).alias("family"), F.col(n).cast("double").alias("gap"), F.col(FAMILIES[n][0]).cast("double").alias("dual")) for n in names))
        return df.select(system.alias("system"), F.col(ident).cast("long").alias("id"), F.explode(pairs).alias("p")).select("p.family", "system", "id", "p.gap", "p.dual").where("gap IS NOT NULL")

    return of(it.rows, ["t", "u"], F.col("system"), "row_id").unionByName(of(it.cols, ["v", "w"], F.lit(None).cast("string"), "col_id"))


def stepped(it: Iterate, step: Iterate, primal: float, dual: float) -> Iterate:
    """it + primal * (x, s and gaps of step) + dual * (its duals)."""
    def moved(a: DataFrame, b: DataFrame, key: list[str], lengths: dict[str, float]) -> DataFrame:
        other = b.select(*key, *(F.col(c).alias(f"_{c}") for c in lengths))
        return a.join(other, key).select(*key, *((F.col(c) + k * _zero(f"_{c}")).alias(c) for c, k in lengths.items()))

    cols = moved(it.cols, step.cols, ["col_id"], {"x": primal, "v": primal, "w": primal, "gamma": dual, "phi": dual})
    rows = moved(it.rows, step.rows, ROW, {"s": primal, "y": dual, "t": primal, "u": primal, "lam": dual, "pi": dual})
    return Iterate(cols, rows)


def paired(it: Iterate, step: Iterate) -> DataFrame:
    """family, system, id, gap, dual, gap_step, dual_step."""
    s = gaps(step).select("family", F.col("system").alias("_s"), F.col("id").alias("_i"), F.col("family").alias("_f"), F.col("gap").alias("gap_step"), F.col("dual").alias("dual_step")).drop("family")
    g = gaps(it)
    return g.join(s, (g["family"] == s["_f"]) & (g["id"] == s["_i"]) & g["system"].eqNullSafe(s["_s"])).drop("_f", "_i", "_s")


def mu(it: Iterate) -> DataFrame:
    """One row: mu, the average of gap times dual; 0 without gaps."""
    return gaps(it).agg(F.coalesce(F.avg(F.col("gap") * F.col("dual")), F.lit(0.0)).alias("mu"))


def mu_after(it: Iterate, step: Iterate, primal: float, dual: float) -> DataFrame:
    """One row: mu of the stepped iterate."""
    return paired(it, step).agg(F.coalesce(F.avg((F.col("gap") + primal * F.col("gap_step")) * (F.col("dual") + dual * F.col("dual_step"))), F.lit(0.0)).alias("mu"))


def centering(mu_now: float, mu_affine: float) -> float:
    return (mu_affine / mu_now) ** 3 if mu_now else 0.0


def step_bounds(it: Iterate, step: Iterate, fraction: float = 1.0) -> DataFrame:
    """One row: primal and dual, the longest steps of at most 1 that keep gaps and duals at (1 - fraction) or above."""
    ratio = lambda v, d: F.when((F.col(d) < 0) & (F.col(v) >= 0), -fraction * F.col(v) / F.nullif(F.col(d), F.lit(0.0)))
    least = lambda v, d: F.least(F.lit(1.0), F.coalesce(F.min(ratio(v, d)), F.lit(1.0)))
    return paired(it, step).agg(least("gap", "gap_step").alias("primal"), least("dual", "dual_step").alias("dual"))


def blocking(it: Iterate, step: Iterate) -> DataFrame:
    """side, ratio, family, system, id, gap, gap_step, dual, dual_step: what blocks the primal and the dual step first.

    Of equal ratios the first family, then the least id counts.
    """
    p = paired(it, step)
    sides = F.array(*(F.struct(F.lit(n).alias("side"), F.when((F.col(f"{c}_step") < 0) & (F.col(c) >= 0), -F.col(c) / F.nullif(F.col(f"{c}_step"), F.lit(0.0))).alias("ratio")) for n, c in (("primal", "gap"), ("dual", "dual"))))
    own = ["gap", "gap_step", "dual", "dual_step"]
    live = p.select("family", "system", "id", *own, F.explode(sides).alias("s")).select("s.side", "s.ratio", "family", "system", "id", *own).where("ratio IS NOT NULL")
    best = live.groupBy("side").agg(F.min(F.struct("ratio", "family", "id", "system", *own)).alias("b"))
    return best.select("side", "b.ratio", "b.family", "b.system", "b.id", *(f"b.{c}" for c in own))


def mehrotra_lengths(it: Iterate, step: Iterate, factor: float = 0.99, scale: float = 1.0 / (1.0 - 0.995)) -> tuple[float, float]:
    """Primal and dual lengths: to where the blocking pair's product is a share of mu after the whole step, `factor` of it at least."""
    blocked = {r["side"]: r for r in blocking(it, step).collect()}  # two rows
    bound = step_bounds(it, step).first()
    alpha, beta = bound["primal"], bound["dual"]
    target = mu_after(it, step, alpha, beta).first()["mu"] / scale
    out = []
    for side, own, other, length in (("primal", "gap", "dual", beta), ("dual", "dual", "gap", alpha)):
        reach, r = (alpha if side == "primal" else beta), blocked.get(side)
        if r is None or r["ratio"] >= 1:
            out.append(reach)
            continue
        there = r[other] + length * r[f"{other}_step"]
        wished = (target / there - r[own]) / r[f"{own}_step"] if there else reach
        out.append(max(factor * reach, min(wished, reach)))
    return out[0], out[1]


def violation(it: Iterate) -> DataFrame:
    """One row: by how much a gap or dual lies below 0 at most."""
    return gaps(it).agg(F.greatest(F.lit(0.0), -F.coalesce(F.min(F.least("gap", "dual")), F.lit(0.0))).alias("violation"))


def shifted(it: Iterate, primal: float, dual: float) -> Iterate:
    """Constants added to all gaps and to all their duals."""
    return Iterate(
        it.cols.withColumns({c: F.col(c) + k for c, k in (("v", primal), ("w", primal), ("gamma", dual), ("phi", dual))}),
        it.rows.withColumns({c: F.col(c) + k for c, k in (("t", primal), ("u", primal), ("lam", dual), ("pi", dual))}),
    )


def slacks_pushed(it: Iterate, tol: float, amount: float) -> Iterate:
    """Gaps of at most tol grow by amount."""
    up = lambda c: F.when(F.abs(c) <= tol, F.col(c) + amount).otherwise(F.col(c))
    return Iterate(it.cols.withColumns({c: up(c) for c in ("v", "w")}), it.rows.withColumns({c: up(c) for c in ("t", "u")}))


def interior_start(p: Problem, primal: float, dual: float) -> Iterate:
    """x, s and y at 0, every gap and dual that exists at one value."""
    at = lambda bound, value: F.when(F.col(bound).isNotNull(), F.lit(float(value)))
    cols = p.cols.select("col_id", F.lit(0.0).alias("x"), at("lb", primal).alias("v"), at("ub", primal).alias("w"), at("lb", dual).alias("gamma"), at("ub", dual).alias("phi"))
    ineq = F.col("system") == "INEQ"
    side = lambda bound, value: F.when(ineq & F.col(bound).isNotNull(), F.lit(float(value)))
    rows = p.rows.select(*ROW, F.when(ineq, F.lit(0.0)).alias("s"), F.lit(0.0).alias("y"), side("lo", primal).alias("t"), side("hi", primal).alias("u"), side("lo", dual).alias("lam"), side("hi", dual).alias("pi"))
    return Iterate(cols, rows)


def distance_of_converged(it: Iterate, tol: float = 1e-6) -> DataFrame:
    """One row: converged, how many gaps lie below tol, and their average."""
    near = F.abs("gap") < tol
    return gaps(it).agg(F.count_if(near).alias("converged"), F.coalesce(F.avg(F.when(near, F.abs("gap"))), F.lit(0.0)).alias("average"))


def norms(it: Iterate) -> DataFrame:
    """One row: one_norm and inf_norm over x, s, y, gaps and duals."""
    values = it.cols.select(F.explode(F.array("x", "v", "w", "gamma", "phi")).alias("a")).unionAll(it.rows.select(F.explode(F.array("s", "y", "t", "u", "lam", "pi")).alias("a")))
    return values.agg(F.coalesce(F.sum(F.abs("a")), F.lit(0.0)).alias("one_norm"), F.coalesce(F.max(F.abs("a")), F.lit(0.0)).alias("inf_norm"))


# --- residuals ---------------------------------------------------------------------------------------


def row_values(p: Problem, x: DataFrame) -> DataFrame:
    """system, row_id, value of every row at x (col_id, x); 0 of a row without entries."""
    value = M.mult(p.nnz, x.select("col_id", "x"))
    return p.rows.select(*ROW).join(value, ROW, "left").select(*ROW, _zero("y").alias("value"))


def column_residuals(p: Problem, it: Iterate, q: DataFrame | None = None) -> DataFrame:
    """col_id, rq, rv, rw, rgamma, rphi: dual residual, distances of the gaps from what they should be, products.

    q (row_id, col_id, val) is one triangle of the quadratic cost, if there is one.
    """
    aty = M.mult_transposed(p.nnz, it.rows.select(*ROW, "y")).withColumnRenamed("x", "_aty")
    c = p.cols.join(it.cols, "col_id").join(aty, "col_id", "left")
    cost = F.col("cost")
    if q is not None:
        qx = M.mult_symmetric(q, it.cols.select("col_id", "x")).select(F.col("row_id").alias("col_id"), F.col("y").alias("_qx"))
        c, cost = c.join(qx, "col_id", "left"), cost + _zero("_qx")
    return c.select(
        "col_id", (cost - _zero("_aty") - _zero("gamma") + _zero("phi")).alias("rq"),
        (F.col("x") - F.col("lb") - F.col("v")).alias("rv"), (F.col("x") - F.col("ub") + F.col("w")).alias("rw"),
        (F.col("v") * F.col("gamma")).alias("rgamma"), (F.col("w") * F.col("phi")).alias("rphi"),
    )


def row_residuals(p: Problem, it: Iterate) -> DataFrame:
    """system, row_id, ra, rz, rt, ru, rlam, rpi: A x - b or C x - s, the duals' balance, the gaps, products."""
    r = p.rows.join(it.rows, ROW).join(row_values(p, it.cols), ROW)
    eq = F.col("system") == "EQ"
    return r.select(
        *ROW, (F.col("value") - F.when(eq, F.col("lo")).otherwise(F.col("s"))).alias("ra"),
        F.when(~eq, F.col("y") - _zero("lam") + _zero("pi")).alias("rz"),
        (F.col("s") - F.col("lo") - F.col("t")).alias("rt"), (F.col("s") - F.col("hi") + F.col("u")).alias("ru"),
        (F.col("t") * F.col("lam")).alias("rlam"), (F.col("u") * F.col("pi")).alias("rpi"),
    )


def residual_norm(p: Problem, it: Iterate, q: DataFrame | None = None) -> DataFrame:
    """One row: the greatest absolute residual of each kind, and of all but the products."""
    kinds = lambda names: F.array(*(F.struct(F.lit(n).alias("kind"), F.abs(n).alias("a")) for n in names))
    both = column_residuals(p, it, q).select(F.explode(kinds(["rq", "rv", "rw"])).alias("k")).unionAll(row_residuals(p, it).select(F.explode(kinds(["ra", "rz", "rt", "ru"])).alias("k")))
    names = ["rq", "rv", "rw", "ra", "rz", "rt", "ru"]
    by = both.agg(*(F.coalesce(F.max(F.when(F.col("k.kind") == n, F.col("k.a"))), F.lit(0.0)).alias(n) for n in names))
    return by.withColumn("norm", F.greatest(*names))


def constraint_violation(p: Problem, it: Iterate) -> DataFrame:
    """One row: the 1-norm and the greatest size of A x - b and C x - s."""
    return row_residuals(p, it).agg(F.coalesce(F.sum(F.abs("ra")), F.lit(0.0)).alias("one_norm"), F.coalesce(F.max(F.abs("ra")), F.lit(0.0)).alias("inf_norm"))


def objectives(p: Problem, it: Iterate, q: DataFrame | None = None) -> DataFrame:
    """One row: primal c'x + x'Qx / 2 (without the offset), dual, and the gap between them."""
    c = p.cols.join(it.cols, "col_id")
    primal = c.agg(_zero(F.sum(F.col("cost") * F.col("x"))).alias("linear"), _zero(F.sum(_zero(F.col("lb") * F.col("gamma")) - _zero(F.col("ub") * F.col("phi")))).alias("bounds"))
    r = p.rows.join(it.rows, ROW)
    sides = r.agg(_zero(F.sum(F.when(F.col("system") == "EQ", F.col("lo") * F.col("y")).otherwise(_zero(F.col("lo") * F.col("lam")) - _zero(F.col("hi") * F.col("pi"))))).alias("sides"))
    one = primal.crossJoin(sides)  # two single rows
    if q is not None:
        x = it.cols.select("col_id", "x")
        qx = M.mult_symmetric(q, x).select(F.col("row_id").alias("col_id"), F.col("y").alias("_qx"))
        one = one.crossJoin(x.join(qx, "col_id").agg(_zero(F.sum(F.col("x") * F.col("_qx"))).alias("quadratic")))  # another one
    else:
        one = one.withColumn("quadratic", F.lit(0.0))
    out = one.select((F.col("linear") + F.col("quadratic") / 2).alias("primal"), (F.col("sides") + F.col("bounds") - F.col("quadratic") / 2).alias("dual"))
    return out.withColumn("gap", F.col("primal") - F.col("dual"))


def products_projected(it: Iterate, low: float, high: float, add: float = 0.0) -> DataFrame:
    """family, system, id, r: what moves each gap times dual (plus add) into [low, high], but not below -high."""
    from blockloom.operators.vector import project_to_range

    return gaps(it).select("family", "system", "id", project_to_range(F.col("gap") * F.col("dual") + add, low, high).alias("r"))


def products_shifted(it: Iterate, add: float) -> DataFrame:
    """family, system, id, r: gap times dual plus a constant."""
    return gaps(it).select("family", "system", "id", (F.col("gap") * F.col("dual") + add).alias("r"))


def products_by_family(it: Iterate) -> DataFrame:
    """family, n, least, most, average: a report of the products."""
    product = F.col("gap") * F.col("dual")
    return gaps(it).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min(product).alias("least"), F.max(product).alias("most"), F.avg(product).alias("average"))


def system_residual(p: Problem, it: Iterate, step: Iterate, q: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(col_id, r; system, row_id, r): what the reduced Newton system leaves at a step, relative to the iterate's diagonals.

    Columns: D dx - A' dy (- Q) with D = gamma / v + phi / w; rows: A dx (+ dy / (lam / t + pi / u) for inequalities).
    """
    d = _zero(F.col("gamma") / F.col("v")) + _zero(F.col("phi") / F.col("w"))
    aty = M.mult_transposed(p.nnz, step.rows.select(*ROW, "y")).withColumnRenamed("x", "_aty")
    cols = it.cols.join(step.cols.select("col_id", F.col("x").alias("_dx")), "col_id").join(aty, "col_id", "left").select("col_id", (d * F.col("_dx") - _zero("_aty")).alias("r"))
    e = _zero(F.col("lam") / F.col("t")) + _zero(F.col("pi") / F.col("u"))
    rows = it.rows.join(step.rows.select(*ROW, F.col("y").alias("_dy")), ROW).join(row_values(p, step.cols), ROW)
    return cols, rows.select(*ROW, (F.col("value") + F.coalesce(F.when(F.col("system") == "INEQ", F.col("_dy") / F.nullif(e, F.lit(0.0))), F.lit(0.0))).alias("r"))


# --- merit and filter --------------------------------------------------------------------------------


def barrier_slope(p: Problem, it: Iterate, step: Iterate, barrier: float) -> DataFrame:
    """One row: the derivative of c'x - barrier * (sum of log gaps) along the step."""
    linear = p.cols.join(step.cols.select("col_id", "x"), "col_id").agg(_zero(F.sum(F.col("cost") * F.col("x"))).alias("a"))
    logs = paired(it, step).agg(_zero(F.sum(F.col("gap_step") / F.nullif(F.col("gap"), F.lit(0.0)))).alias("b"))
    return linear.crossJoin(logs).select((F.col("a") - barrier * F.col("b")).alias("slope"))  # two single rows


def predicted_reduction(slope: float, length: float) -> float:
    return -length * slope


def dominated(front: list[tuple[float, float]], infeasibility: float, optimality: float) -> bool:
    """Whether some pair of the filter is at least as good in both."""
    return any(a <= infeasibility and b <= optimality for a, b in front)


def filter_add(front: list[tuple[float, float]], infeasibility: float, optimality: float) -> list[tuple[float, float]]:
    """The filter with the pair, without those that it dominates."""
    if dominated(front, infeasibility, optimality):
        return front
    return sorted([f for f in front if not (infeasibility <= f[0] and optimality <= f[1])] + [(infeasibility, optimality)])


def improves(now: tuple[float, float], trial: tuple[float, float], beta: float = 0.999, gamma: float = 0.001) -> bool:
    """Whether the trial lowers infeasibility enough, or the objective against it."""
    return trial[0] <= beta * now[0] or trial[1] <= now[1] - gamma * trial[0]


def accepted(now: tuple[float, float], trial: tuple[float, float], predicted: float, front: list[tuple[float, float]], armijo: float = 1e-4, switch: float = 1e-2) -> bool:
    """A trial point passes the filter; where the predicted reduction outweighs the infeasibility it also has to reduce enough."""
    if dominated(front, *trial):
        return False
    if predicted > 0 and predicted**2.3 > switch * now[0] ** 1.1:
        return now[1] - trial[1] >= armijo * predicted
    return improves(now, trial)


def probing_factor(norm_last: float, norm_probe: float, mu_last: float, mu_probe: float, growth: float = 10.0, share: float = 0.9995) -> float:
    """What a step is shortened by so that neither residual nor mu grows more than `growth` times."""
    out = 1.0
    for last, probe in ((norm_last, norm_probe), (mu_last, mu_probe)):
        allowed = growth * last
        if probe > allowed and probe > last:
            out = min(out, share * (allowed - last) / (probe - last))
    return min(1.0, max(out, 0.0))


def poor_step(length: float, centering_only: bool, least: float = 1e-4) -> bool:
    """Whether a step, already a pure centering one or not, is too short to go on with."""
    return length < (least / 10 if centering_only else least)


def weight_candidates(it: Iterate, predictor: Iterate, corrector: Iterate, least: float, n: int = 10) -> DataFrame:
    """weight, primal, dual: step lengths of predictor + weight * corrector for n + 1 weights from least to 1, in one pass."""
    p = paired(it, predictor)
    c = paired(it, corrector).select("family", "system", "id", F.col("gap_step").alias("_g"), F.col("dual_step").alias("_d"))
    both = p.join(c, (p["family"] == c["family"]) & (p["id"] == c["id"]) & p["system"].eqNullSafe(c["system"])).select(p["gap"], p["dual"], p["gap_step"], p["dual_step"], "_g", "_d")
    weights = F.explode(F.array(*(F.lit(least + (1 - least) * k / n) for k in range(n + 1)))).alias("weight")
    w = both.select("*", weights)

    def least_ratio(v: str, a: str, b: str) -> Column:
        step = F.col(a) + F.col("weight") * F.col(b)
        return F.least(F.lit(1.0), F.coalesce(F.min(F.when((step < 0) & (F.col(v) >= 0), -F.col(v) / F.nullif(step, F.lit(0.0)))), F.lit(1.0)))

    return w.groupBy("weight").agg(least_ratio("gap", "gap_step", "_g").alias("primal"), least_ratio("dual", "dual_step", "_d").alias("dual"))


def best_weights(candidates: DataFrame) -> DataFrame:
    """One row: of the primal and, on its own, of the dual length the greatest and its weight; of equal ones the greatest weight."""
    best = lambda c: F.max(F.struct(F.col(c).alias("length"), F.col("weight").alias("weight")))
    return candidates.agg(best("primal").alias("p"), best("dual").alias("d")).select(F.col("p.weight").alias("primal_weight"), F.col("p.length").alias("primal"), F.col("d.weight").alias("dual_weight"), F.col("d.length").alias("dual"))


# --- the parts of a solution ---------------------------------------------------------------------------


def first_stage_objective(p: Problem, it: Iterate, root: int = 0) -> DataFrame:
    """One row: the cost of the root block's columns."""
    return p.cols.where(F.col("block") == root).join(it.cols.select("col_id", "x"), "col_id").agg(_zero(F.sum(F.col("cost") * F.col("x"))).alias("objective"))


def stage(p: Problem, it: Iterate, block: int) -> DataFrame:
    """col_id, x of one block; block 0 is the first stage."""
    return p.cols.where(F.col("block") == block).select("col_id").join(it.cols.select("col_id", "x"), "col_id")


def duals(it: Iterate, system: str, side: str | None = None) -> DataFrame:
    """row_id, dual of the rows of EQ or INEQ; side low or high gives the part of that side."""
    name = {None: "y", "low": "lam", "high": "pi"}[side]
    return it.rows.where(F.col("system") == system).select("row_id", F.col(name).alias("dual"))


def bound_duals(it: Iterate, side: str | None = None) -> DataFrame:
    """col_id, dual: gamma - phi, or one of them."""
    value = {None: _zero("gamma") - _zero("phi"), "low": F.col("gamma"), "high": F.col("phi")}[side]
    return it.cols.select("col_id", value.alias("dual"))


def slacks(p: Problem, it: Iterate) -> tuple[DataFrame, DataFrame]:
    """(col_id, low, high; row_id, low, high): distances of x from its bounds and of C x from its sides, null without one."""
    cols = p.cols.join(it.cols.select("col_id", "x"), "col_id").select("col_id", (F.col("x") - F.col("lb")).alias("low"), (F.col("ub") - F.col("x")).alias("high"))
    rows = p.rows.where("system = 'INEQ'").join(row_values(p, it.cols), ROW).select("row_id", (F.col("value") - F.col("lo")).alias("low"), (F.col("hi") - F.col("value")).alias("high"))
    return cols, rows


def block_sizes(p: Problem) -> DataFrame:
    """block, columns, equalities, inequalities."""
    c = p.cols.groupBy("block").agg(F.count(F.lit(1)).alias("columns"))
    r = p.rows.groupBy("block").agg(F.count_if(F.col("system") == "EQ").alias("equalities"), F.count_if(F.col("system") == "INEQ").alias("inequalities"))
    return c.join(r, "block", "full").select("block", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("columns", "equalities", "inequalities")))


def not_complementary(it: Iterate, tol: float = 1e-4) -> DataFrame:
    """family, system, id, gap, dual: pairs whose product exceeds tol; empty at a solution."""
    return gaps(it).where(F.abs(F.col("gap") * F.col("dual")) > tol)


def unset(it: Iterate, p: Problem) -> DataFrame:
    """what, id: columns without a value and rows without a dual; empty after a whole postsolve."""
    c = p.cols.select("col_id").join(it.cols.select("col_id", "x"), "col_id", "left").where("x IS NULL OR isnan(x)").select(F.lit("column").alias("what"), F.col("col_id").alias("id"))
    r = p.rows.select(*ROW).join(it.rows.select(*ROW, "y"), ROW, "left").where("y IS NULL OR isnan(y)").select(F.col("system").alias("what"), F.col("row_id").alias("id"))
    return c.unionByName(r)
