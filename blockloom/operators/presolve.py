"""Presolve: rewrites of a problem's rows, columns and nonzeros.

Every rule is declarative and free of order: it reads the state, and ties go to the least id.
A rule returns a new problem and its reductions; `presolve` runs rounds of rules until none
changes anything, and postsolve replays the reductions backwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.tolerance import EPS, FEASTOL
from blockloom.plans.lp import Problem

KEY = ["system", "row_id"]


def activities(p: Problem) -> DataFrame:
    """system, row_id, min_act, min_inf, max_act, max_inf: finite parts of the row activities and their infinite terms."""
    v, lb, ub = F.col("val"), F.col("lb"), F.col("ub")
    low, high = F.when(v > 0, lb).otherwise(ub), F.when(v > 0, ub).otherwise(lb)
    return p.nnz.join(p.cols.select("col_id", "lb", "ub"), "col_id").groupBy(*KEY).agg(
        F.coalesce(F.sum(v * low), F.lit(0.0)).alias("min_act"), F.count_if(low.isNull()).alias("min_inf"),
        F.coalesce(F.sum(v * high), F.lit(0.0)).alias("max_act"), F.count_if(high.isNull()).alias("max_inf"),
    )


def row_status(p: Problem, tol: float = FEASTOL) -> DataFrame:
    """Rows with status: infeasible, redundant, lower_redundant, upper_redundant or needed; empty rows have activity 0."""
    zero = {"min_act": 0.0, "min_inf": 0, "max_act": 0.0, "max_inf": 0}
    r = p.rows.join(activities(p), KEY, "left").fillna(zero)
    low, high = F.col("min_inf") == 0, F.col("max_inf") == 0
    lo, hi, amin, amax = (F.col(c) for c in ("lo", "hi", "min_act", "max_act"))
    infeasible = (low & hi.isNotNull() & (amin > hi + tol)) | (high & lo.isNotNull() & (amax < lo - tol))
    lower = lo.isNull() | (low & (amin >= lo - tol))
    upper = hi.isNull() | (high & (amax <= hi + tol))
    return r.withColumn("status", F.when(F.coalesce(infeasible, F.lit(False)), "infeasible").when(lower & upper, "redundant").when(lower & lo.isNotNull(), "lower_redundant").when(upper & hi.isNotNull(), "upper_redundant").otherwise("needed"))


def drop_redundant_rows(p: Problem) -> tuple[Problem, DataFrame]:
    gone = row_status(p).where("status = 'redundant'").select(*KEY)
    return p.with_(rows=p.rows.join(gone, KEY, "left_anti"), nnz=p.nnz.join(gone, KEY, "left_anti")), gone


def tiny_entries(p: Problem, absolute: float = 1e-10, relative: float = 1e-3) -> DataFrame:
    """Entries too small to matter: |a| below `absolute`, or |a| below `relative` while a (ub - lb) n is below feastol / 100."""
    n = p.nnz.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    joined = p.nnz.join(n, KEY).join(p.cols.select("col_id", "lb", "ub"), "col_id")
    width = F.col("ub") - F.col("lb")
    small = (F.abs("val") < absolute) | ((F.abs("val") < relative) & F.coalesce(F.abs("val") * width * F.col("_n") < FEASTOL * 1e-2, F.lit(False)))
    return joined.where(small).select(*p.nnz.columns, "lb")


def drop_tiny_entries(p: Problem) -> Problem:
    """Without them; the row sides move by what the entries give at the lower bounds."""
    gone = tiny_entries(p)
    moved = gone.groupBy(*KEY).agg(F.sum(F.col("val") * F.coalesce("lb", F.lit(0.0))).alias("_m"))
    shift = F.coalesce("_m", F.lit(0.0))
    rows = p.rows.join(moved, KEY, "left").withColumns({"lo": F.col("lo") - shift, "hi": F.col("hi") - shift}).select(*p.rows.columns)
    return p.with_(nnz=p.nnz.join(gone.select(*KEY, "col_id"), [*KEY, "col_id"], "left_anti"), rows=rows)


def empty_columns(p: Problem) -> DataFrame:
    """col_id, value, status of columns without entries: at the bound that the cost asks for.

    Without cost the value is the lower bound, else the upper, else 0.
    """
    cost, lb, ub = F.col("cost"), F.col("lb"), F.col("ub")
    value = F.when(cost < 0, ub).when(cost > 0, lb).otherwise(F.coalesce(lb, ub, F.lit(0.0)))
    return p.cols.join(p.nnz.select("col_id").distinct(), "col_id", "left_anti").select("col_id", value.alias("value"), F.when(value.isNull(), "unbounded").otherwise("fixed").alias("status"))


def singleton_row_bounds(p: Problem) -> DataFrame:
    """col_id, lb, ub: the tightest bounds that rows with one entry give their columns."""
    one = Window.partitionBy(*KEY)
    single = p.nnz.withColumn("_n", F.count(F.lit(1)).over(one)).where("_n = 1").join(p.rows.select(*KEY, "lo", "hi"), KEY)
    a = F.col("val")
    low, high = F.when(a > 0, F.col("lo") / a).otherwise(F.col("hi") / a), F.when(a > 0, F.col("hi") / a).otherwise(F.col("lo") / a)
    return single.groupBy("col_id").agg(F.max(low).alias("lb"), F.min(high).alias("ub"))


def tighten(cols: DataFrame, bounds: DataFrame) -> DataFrame:
    """Columns with the tighter of their own and the new bounds (col_id, lb, ub); nulls are no bounds."""
    b = bounds.select("col_id", F.col("lb").alias("_l"), F.col("ub").alias("_u"))
    return cols.join(b, "col_id", "left").withColumns({"lb": F.greatest("lb", "_l"), "ub": F.least("ub", "_u")}).select(*cols.columns)


def drop_singleton_rows(p: Problem) -> tuple[Problem, DataFrame]:
    """One pass: their bounds go to the columns, the rows go."""
    gone = p.nnz.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.first("col_id").alias("col_id"), F.first("val").alias("val")).where("_n = 1").drop("_n")
    cols = tighten(p.cols, singleton_row_bounds(p))
    return p.with_(cols=cols, rows=p.rows.join(gone, KEY, "left_anti"), nnz=p.nnz.join(gone, KEY, "left_anti")), gone


def infeasible_bounds(cols: DataFrame, tol: float = FEASTOL) -> DataFrame:
    return cols.where(F.col("lb") > F.col("ub") + tol)


def fixed_columns(p: Problem, tol: float = 1e-12) -> DataFrame:
    """col_id, value: columns whose bounds meet; a whole number where one of the bounds is one."""
    lb, ub = F.col("lb"), F.col("ub")
    value = F.when(lb == F.floor(lb), lb).when(ub == F.floor(ub), ub).otherwise((lb + ub) / 2)
    return p.cols.where(ub - lb < tol).select("col_id", value.alias("value"))


def fix(p: Problem, values: DataFrame) -> Problem:
    """Columns fixed at (col_id, value): sides less a x, the objective's offset plus c x, the columns gone."""
    moved = p.nnz.join(values, "col_id").groupBy(*KEY).agg(F.sum(F.col("val") * F.col("value")).alias("_m"))
    shift = F.coalesce("_m", F.lit(0.0))
    rows = p.rows.join(moved, KEY, "left").withColumns({"lo": F.col("lo") - shift, "hi": F.col("hi") - shift}).select(*p.rows.columns)
    offset = p.cols.join(values, "col_id").agg(F.coalesce(F.sum(F.col("cost") * F.col("value")), F.lit(0.0))).first()[0]
    gone = values.select("col_id")
    return p.with_(cols=p.cols.join(gone, "col_id", "left_anti"), rows=rows, nnz=p.nnz.join(gone, "col_id", "left_anti"), offset=p.offset + offset)


def implied_bounds(p: Problem, least: float = 1e-7, only_upper: bool = False, most: float = 1e12) -> DataFrame:
    """col_id, lb, ub, lb_row, ub_row: the best bounds that rows imply for columns, in one round.

    The own term is taken out of the row's activity.  With only_upper lower bounds are left out,
    as the source's acceptance test has it.  Entries below `least` are skipped, and so are
    bounds beyond `most`.
    """
    a = F.col("val")
    terms = p.nnz.join(p.cols.select("col_id", "lb", "ub"), "col_id").join(activities(p), KEY).join(p.rows.select(*KEY, "lo", "hi"), KEY).where(F.abs("val") >= least)
    low, high = F.when(a > 0, F.col("lb")).otherwise(F.col("ub")), F.when(a > 0, F.col("ub")).otherwise(F.col("lb"))
    rest_min = F.when(F.col("min_inf") - F.when(low.isNull(), 1).otherwise(0) == 0, F.col("min_act") - F.coalesce(a * low, F.lit(0.0)))
    rest_max = F.when(F.col("max_inf") - F.when(high.isNull(), 1).otherwise(0) == 0, F.col("max_act") - F.coalesce(a * high, F.lit(0.0)))
    from_hi, from_lo = (F.col("hi") - rest_min) / a, (F.col("lo") - rest_max) / a
    fits = lambda b: F.when(F.abs(b) <= most, b)
    upper, lower = fits(F.when(a > 0, from_hi).otherwise(from_lo)), fits(F.when(a > 0, from_lo).otherwise(from_hi))
    row = F.col("row_id")
    best = terms.groupBy("col_id").agg(
        F.max(F.when(lower.isNotNull(), F.struct(lower.alias("b"), (-row).alias("r")))).alias("l"),
        F.min(F.when(upper.isNotNull(), F.struct(upper.alias("b"), row.alias("r")))).alias("u"),
    )
    none = F.lit(None)
    return best.select("col_id", (none.cast("double") if only_upper else F.col("l.b")).alias("lb"), F.col("u.b").alias("ub"), (none.cast("long") if only_upper else -F.col("l.r")).alias("lb_row"), F.col("u.r").alias("ub_row"))


def accepted_bounds(p: Problem, implied: DataFrame, most: float = 1e10, worth: float = FEASTOL) -> DataFrame:
    """col_id, lb, ub of the implied bounds that improve a column's own by `worth` and are smaller than `most`; null where not.

    A bound below 1e-8 in size counts as 0.
    """
    near = lambda b: F.when(F.abs(b) < 1e-8, F.lit(0.0)).otherwise(b)
    j = implied.select("col_id", near(F.col("lb")).alias("_l"), near(F.col("ub")).alias("_u")).join(p.cols, "col_id")
    better = lambda new, old, gain: (F.abs(new) < most) & (F.col(old).isNull() | (gain >= worth))
    low = F.when(better(F.col("_l"), "lb", F.col("_l") - F.col("lb")), F.col("_l"))
    high = F.when(better(F.col("_u"), "ub", F.col("ub") - F.col("_u")), F.col("_u"))
    return j.select("col_id", low.alias("lb"), high.alias("ub")).where("lb IS NOT NULL OR ub IS NOT NULL")


def singleton_columns(p: Problem) -> DataFrame:
    """col_id, system, row_id, val, action of columns with one entry.

    substitute: implied free in an equality; drop_row: free of cost and bounds in an
    inequality; fix_lower / fix_upper: cost and entry push to that bound; none otherwise.
    """
    one = p.nnz.groupBy("col_id").agg(F.count(F.lit(1)).alias("_n"), F.first("system").alias("system"), F.first("row_id").alias("row_id"), F.first("val").alias("val")).where("_n = 1").drop("_n")
    r = one.join(p.cols, "col_id").join(p.rows.select(*KEY, "lo", "hi"), KEY)
    imp = implied_bounds(p).select("col_id", F.col("lb").alias("_il"), F.col("ub").alias("_iu"))
    r = r.join(imp, "col_id", "left")
    free = F.coalesce(F.col("lb").isNull() | (F.col("_il") >= F.col("lb") - FEASTOL), F.lit(False)) & F.coalesce(F.col("ub").isNull() | (F.col("_iu") <= F.col("ub") + FEASTOL), F.lit(False))
    unbounded = F.col("lb").isNull() & F.col("ub").isNull()
    a, c = F.col("val"), F.col("cost")
    only_hi, only_lo = F.col("lo").isNull() & F.col("hi").isNotNull(), F.col("hi").isNull() & F.col("lo").isNotNull()
    down = (c >= 0) & ((only_hi & (a > 0)) | (only_lo & (a < 0))) & F.col("lb").isNotNull()
    up = (c <= 0) & ((only_hi & (a < 0)) | (only_lo & (a > 0))) & F.col("ub").isNotNull()
    action = F.when((F.col("system") == "EQ") & free, "substitute").when((F.col("system") == "INEQ") & unbounded & (c == 0), "drop_row").when(down, "fix_lower").when(up, "fix_upper").otherwise("none")
    return r.select("col_id", "system", "row_id", "val", action.alias("action"))


def normalized_rows(p: Problem) -> DataFrame:
    """system, row_id, factor, signature, lo, hi: rows divided by their entry of greatest size, which becomes positive 1.

    Of several such entries the one of the least column counts.  The signature is an order-free
    128-bit hash of the entries and their number, so no row is gathered in one place.
    """
    lead = F.max(F.struct(F.abs("val").alias("m"), (-F.col("col_id")).alias("c"), F.col("val").alias("v")))
    factor = p.nnz.groupBy(*KEY).agg(lead["v"].alias("factor"))
    term = F.round(F.col("val") / F.col("factor"), 9) + F.lit(0.0)
    hashed = [F.hex(F.bit_xor(F.xxhash64(F.lit(k), F.col("col_id"), term))) for k in (1, 2)]
    entries = p.nnz.join(factor, KEY).groupBy(*KEY, "factor").agg(F.concat_ws(":", *hashed, F.count(F.lit(1)).cast("string")).alias("signature"))
    a = entries.join(p.rows.select(*KEY, "lo", "hi"), KEY)
    lo, hi = F.col("lo") / F.col("factor"), F.col("hi") / F.col("factor")
    return a.select(*KEY, "factor", "signature", F.when(F.col("factor") > 0, lo).otherwise(hi).alias("lo"), F.when(F.col("factor") > 0, hi).otherwise(lo).alias("hi"))


def parallel_rows(p: Problem) -> DataFrame:
    """Groups of parallel rows: signature's kept row (equalities first, then the least id), how many, and the common interval.

    kept_row, kept_system, n_rows, lo, hi (scaled by the kept row's greatest entry), feasible.
    """
    order = F.struct(F.when(F.col("system") == "EQ", 0).otherwise(1).alias("o"), F.col("row_id").alias("row_id"), F.col("system").alias("system"))
    g = normalized_rows(p).groupBy("signature").agg(F.count(F.lit(1)).alias("n_rows"), F.min(order).alias("k"), F.max("lo").alias("lo"), F.min("hi").alias("hi")).where("n_rows > 1")
    return g.select(F.col("k.row_id").alias("kept_row"), F.col("k.system").alias("kept_system"), "n_rows", "lo", "hi", F.coalesce(F.col("lo") <= F.col("hi") + EPS, F.lit(True)).alias("feasible"))


def drop_parallel_rows(p: Problem) -> Problem:
    """Only each group's kept row stays, with the common interval in its own scale.  Rows that contradict each other raise an error."""
    if parallel_rows(p).where("NOT feasible").limit(1).count():
        raise ValueError("the problem is infeasible: parallel rows contradict each other")
    rows = normalized_rows(p)
    order = Window.partitionBy("signature").orderBy(F.when(F.col("system") == "EQ", 0).otherwise(1), "row_id")
    whole = Window.partitionBy("signature")
    ranked = rows.withColumns({"_k": F.row_number().over(order), "_n": F.count(F.lit(1)).over(whole), "_lo": F.max("lo").over(whole), "_hi": F.min("hi").over(whole)})
    gone = ranked.where("_k > 1").select(*KEY)
    lo, hi = F.col("_lo") * F.col("factor"), F.col("_hi") * F.col("factor")
    new = ranked.where("_k = 1 AND _n > 1").select(*KEY, F.when(F.col("factor") > 0, lo).otherwise(hi).alias("_a"), F.when(F.col("factor") > 0, hi).otherwise(lo).alias("_b"), F.lit(True).alias("_t"))
    kept = p.rows.join(gone, KEY, "left_anti").join(new, KEY, "left")
    return p.with_(rows=kept.withColumns({"lo": F.when(F.col("_t"), F.col("_a")).otherwise(F.col("lo")), "hi": F.when(F.col("_t"), F.col("_b")).otherwise(F.col("hi"))}).select(*p.rows.columns), nnz=p.nnz.join(gone, KEY, "left_anti"))


def inequalities_to_equalities(p: Problem) -> Problem:
    """C x in [lo, hi] becomes C x - s = 0 with lo <= s <= hi; slack ids follow the greatest column id."""
    base = p.cols.agg(F.coalesce(F.max("col_id"), F.lit(0)) + 1).first()[0]
    ineq = p.rows.where("system = 'INEQ'")
    slack = (F.col("row_id") + base).alias("col_id")
    cols = p.cols.unionByName(ineq.select(slack, "block", F.lit(0.0).alias("cost"), F.col("lo").alias("lb"), F.col("hi").alias("ub")))
    low = p.rows.where("system = 'EQ'").agg(F.coalesce(F.max("row_id"), F.lit(-1)) + 1).first()[0]
    moved = (F.col("row_id") + low).alias("row_id")
    rows = p.rows.where("system = 'EQ'").unionByName(ineq.select(F.lit("EQ").alias("system"), moved, "block", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")))
    nnz = p.nnz.where("system = 'EQ'").unionByName(p.nnz.where("system = 'INEQ'").withColumns({"system": F.lit("EQ"), "row_id": F.col("row_id") + low}))
    nnz = nnz.unionByName(ineq.select(F.lit("EQ").alias("system"), moved, slack, F.lit(-1.0).alias("val"), F.col("block").alias("row_block"), F.col("block").alias("col_block")))
    return p.with_(cols=cols, rows=rows, nnz=nnz)


def statistics(p: Problem) -> DataFrame:
    """block, kind, n: rows by the sides they have and columns by their bounds, with totals where block is null."""
    row_kind = F.when(F.col("lo") == F.col("hi"), "row_equality").when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), "row_ranged").when(F.col("lo").isNotNull() | F.col("hi").isNotNull(), "row_one_sided").otherwise("row_free")
    col_kind = F.when(F.col("lb") == F.col("ub"), "col_fixed").when(F.col("lb").isNotNull() & F.col("ub").isNotNull(), "col_boxed").when(F.col("lb").isNotNull(), "col_lower").when(F.col("ub").isNotNull(), "col_upper").otherwise("col_free")
    both = p.rows.select("block", row_kind.alias("kind")).unionByName(p.cols.select("block", col_kind.alias("kind")))
    return both.rollup("kind", "block").agg(F.count(F.lit(1)).alias("n")).where("kind IS NOT NULL")


def nearly_parallel_rows(p: Problem) -> DataFrame:
    """Equalities that are parallel but for one singleton column each.

    row1, row2, col1, col2, slope, shift: the rows give x2 = slope x1 + shift.  Of each group of
    such rows row1 has the least id; all pairs are told relative to it.
    """
    single = p.nnz.groupBy("col_id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("col_id")
    eq = p.nnz.where("system = 'EQ'")
    alone = eq.join(single, "col_id").groupBy("row_id").agg(F.count(F.lit(1)).alias("_k"), F.first("col_id").alias("col"), F.first("val").alias("a")).where("_k = 1").drop("_k")
    stripped = p.with_(nnz=eq.join(single, "col_id", "left_anti"))
    rows = normalized_rows(stripped).select("row_id", "factor", "signature", "lo").join(alone, "row_id")  # lo is already over the factor
    first = rows.groupBy("signature").agg(F.min(F.struct("row_id", "col", "a", "factor", "lo")).alias("f"))
    pairs = rows.join(first, "signature").where("row_id > f.row_id")
    scaled1, scaled2 = F.col("f.a") / F.col("f.factor"), F.col("a") / F.col("factor")
    return pairs.select(F.col("f.row_id").alias("row1"), F.col("row_id").alias("row2"), F.col("f.col").alias("col1"), F.col("col").alias("col2"), (scaled1 / scaled2).alias("slope"), ((F.col("lo") - F.col("f.lo")) / scaled2).alias("shift"))


def _stripped(p: Problem) -> tuple[DataFrame, DataFrame]:
    """(normalised rows without singleton columns; system, row_id, col, a, k: what such columns a row has)."""
    single = p.nnz.groupBy("col_id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("col_id")
    alone = p.nnz.join(single, "col_id").groupBy(*KEY).agg(F.count(F.lit(1)).alias("k"), F.first("col_id").alias("col"), F.first("val").alias("a"))
    return normalized_rows(p.with_(nnz=p.nnz.join(single, "col_id", "left_anti"))), alone


def columns_of_nearly_parallel(p: Problem) -> DataFrame:
    """system, row_id, col_id, lb, ub: what a parallel row without singleton column tells about the singleton column of an equality.

    The equality f (n x) + a c = b and a row that bounds n x give c an interval: a point if that
    row is an equality, which then has to go; system and row_id name that row, the least of its kind.
    """
    rows, alone = _stripped(p)
    r = rows.join(alone, KEY, "left").withColumn("k", F.coalesce("k", F.lit(0)))
    owner = r.where("system = 'EQ' AND k = 1").groupBy("signature").agg(F.min(F.struct("row_id", "col", "a", "factor", "lo")).alias("o"))
    j = r.where("k = 0").join(owner, "signature")
    scaled = F.col("o.a") / F.col("o.factor")
    at = lambda side: (F.col("o.lo") - F.col(side)) / scaled
    low, high = F.when(scaled > 0, at("hi")).otherwise(at("lo")), F.when(scaled > 0, at("lo")).otherwise(at("hi"))
    return j.select(*KEY, F.col("o.col").alias("col_id"), low.alias("lb"), high.alias("ub"))


def bound_by_nearly_parallel(p: Problem) -> tuple[Problem, DataFrame]:
    """Those intervals become bounds of their columns, the rows that gave them go."""
    told = columns_of_nearly_parallel(p)
    bounds = told.groupBy("col_id").agg(F.max("lb").alias("lb"), F.min("ub").alias("ub"))
    gone = told.select(*KEY)
    return p.with_(cols=tighten(p.cols, bounds), rows=p.rows.join(gone, KEY, "left_anti"), nnz=p.nnz.join(gone, KEY, "left_anti")), told


def nearly_parallel_inequalities(p: Problem) -> DataFrame:
    """Inequalities that are parallel but for one singleton column each, with the same scaled sides, bounds and cost.

    row1, row2, col1, col2, slope: the columns may take values x2 = slope x1 together, so row2
    and col2 can go; row1 has the least id of such a group.
    """
    rows, alone = _stripped(p)
    r = rows.where("system = 'INEQ'").join(alone.where("k = 1"), KEY).join(p.cols.select(F.col("col_id").alias("col"), "cost", "lb", "ub"), "col")
    s = F.col("a") / F.col("factor")
    r = r.withColumn("s", s).withColumns({"_l": F.when(F.col("s") > 0, F.col("lb")).otherwise(F.col("ub")) * F.col("s"), "_u": F.when(F.col("s") > 0, F.col("ub")).otherwise(F.col("lb")) * F.col("s")})
    near = lambda c: F.round(c, 9)
    same = ["signature", near(F.col("lo")).alias("_lo"), near(F.col("hi")).alias("_hi"), near(F.col("_l")).alias("_sl"), near(F.col("_u")).alias("_su"), near(F.col("cost") / F.col("s")).alias("_c")]
    group = r.select("row_id", "col", "s", *same)
    names = ["signature", "_lo", "_hi", "_sl", "_su", "_c"]
    first = group.groupBy(*names).agg(F.min(F.struct("row_id", "col", "s")).alias("f"))
    joined = group.alias("g").join(first.alias("h"), F.expr(" AND ".join(f"g.{n} <=> h.{n}" for n in names))).where("g.row_id > h.f.row_id")
    return joined.select(F.col("h.f.row_id").alias("row1"), F.col("g.row_id").alias("row2"), F.col("h.f.col").alias("col1"), F.col("g.col").alias("col2"), (F.col("h.f.s") / F.col("g.s")).alias("slope"))


def merge_nearly_parallel_inequalities(p: Problem, pairs: DataFrame) -> Problem:
    """Every pair's second row and column go; x1 takes over x2's cost."""
    cost = pairs.join(p.cols.select(F.col("col_id").alias("col2"), F.col("cost").alias("_c")), "col2").groupBy(F.col("col1").alias("col_id")).agg(F.sum(F.col("_c") * F.col("slope")).alias("_d"))
    cols = p.cols.join(pairs.select(F.col("col2").alias("col_id")), "col_id", "left_anti").join(cost, "col_id", "left").withColumn("cost", F.col("cost") + F.coalesce("_d", F.lit(0.0))).select(*p.cols.columns)
    gone = pairs.select(F.lit("INEQ").alias("system"), F.col("row2").alias("row_id"))
    return p.with_(cols=cols, rows=p.rows.join(gone, KEY, "left_anti"), nnz=p.nnz.join(gone, KEY, "left_anti"))


def free_originally(p: Problem, original: DataFrame) -> Problem:
    """Bounds that presolve gave to columns without any in the original table (col_id, lb, ub) go again."""
    free = original.where("lb IS NULL AND ub IS NULL").select("col_id", F.lit(True).alias("_f"))
    none = F.lit(None).cast("double")
    cols = p.cols.join(free, "col_id", "left").withColumns({c: F.when(F.col("_f"), none).otherwise(F.col(c)) for c in ("lb", "ub")})
    return p.with_(cols=cols.select(*p.cols.columns))


def column_extremes(p: Problem) -> DataFrame:
    """col_id, least, most |a| of every column; null without entries."""
    found = p.nnz.groupBy("col_id").agg(F.min(F.abs("val")).alias("least"), F.max(F.abs("val")).alias("most"))
    return p.cols.select("col_id").join(found, "col_id", "left")


def verify_activities(kept: DataFrame, p: Problem, tol: float = FEASTOL) -> DataFrame:
    """system, row_id of rows whose kept activities (as activities() gives them) are not those of the problem; empty if all hold."""
    now = activities(p)
    names = ["min_act", "min_inf", "max_act", "max_inf"]
    j = now.join(kept.select(*KEY, *(F.col(n).alias(f"_{n}") for n in names)), KEY, "full")
    close = [F.abs(F.col(n) - F.col(f"_{n}")) <= tol * F.greatest(F.lit(1.0), F.abs(n)) for n in ("min_act", "max_act")] + [F.col(n) == F.col(f"_{n}") for n in ("min_inf", "max_inf")]
    return j.where(~F.coalesce(close[0] & close[1] & close[2] & close[3], F.lit(False))).select(*KEY)


def verify_counts(kept: DataFrame, p: Problem, by: str) -> DataFrame:
    """Rows (KEY) or columns whose kept number of entries n is not that of the problem; absent ones have 0."""
    key = KEY if by == "row_id" else [by]
    now = p.nnz.groupBy(*key).agg(F.count(F.lit(1)).alias("_now"))
    return now.join(kept.select(*key, "n"), key, "full").where("coalesce(n, 0) <> coalesce(_now, 0)").select(*key)


def finalize(p: Problem) -> Problem:
    """The problem with entries of its rows and columns only."""
    nnz = p.nnz.join(p.cols.select("col_id"), "col_id", "left_semi").join(p.rows.select(*KEY), KEY, "left_semi")
    return p.with_(nnz=nnz)


def substitute_nearly_parallel(p: Problem, pairs: DataFrame) -> Problem:
    """Every pair's second row and column go: x1 takes over x2's cost and bounds, the offset its shift."""
    second = pairs.join(p.cols.select(F.col("col_id").alias("col2"), F.col("cost").alias("_c"), F.col("lb").alias("_l"), F.col("ub").alias("_u")), "col2")
    low, high = (F.col("_l") - F.col("shift")) / F.col("slope"), (F.col("_u") - F.col("shift")) / F.col("slope")
    up = F.col("slope") > 0
    moved = second.groupBy(F.col("col1").alias("col_id")).agg(F.sum(F.col("_c") * F.col("slope")).alias("_d"), F.max(F.when(up, low).otherwise(high)).alias("_lb"), F.min(F.when(up, high).otherwise(low)).alias("_ub"))
    offset = second.agg(F.coalesce(F.sum(F.col("_c") * F.col("shift")), F.lit(0.0))).first()[0]
    cols = p.cols.join(pairs.select(F.col("col2").alias("col_id")), "col_id", "left_anti").join(moved, "col_id", "left")
    cols = cols.withColumns({"cost": F.col("cost") + F.coalesce("_d", F.lit(0.0)), "lb": F.greatest("lb", "_lb"), "ub": F.least("ub", "_ub")}).select(*p.cols.columns)
    gone = pairs.select(F.lit("EQ").alias("system"), F.col("row2").alias("row_id"))
    return p.with_(cols=cols, rows=p.rows.join(gone, KEY, "left_anti"), nnz=p.nnz.join(gone, KEY, "left_anti"), offset=p.offset + offset)
