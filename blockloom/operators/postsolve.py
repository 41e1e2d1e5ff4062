"""Postsolve: an ordered log of reductions, replayed backwards onto a solution.

    reductions(seq, kind, system, row_id, col_id, a, b, c, entries)

Reductions of one round share a seq.  Each kind is undone by one join with the solution so
far; seq groups are replayed in descending order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators import presolve as P
from blockloom.plans.lp import Problem
from blockloom.session import checkpoint

KINDS = (
    "fixed_column", "empty_column", "redundant_row", "singleton_row", "free_column_equality", "bound_tightened", "parallel_row",
    "nearly_parallel_bound", "nearly_parallel_inequality", "nearly_parallel_equality", "inequality_column", "free_column_inequality",
)
SCHEMA = "seq int, kind string, system string, row_id long, col_id long, a double, b double, c double, entries array<struct<col_id:long,val:double>>"


@dataclass
class Presolved:
    problem: Problem
    reductions: DataFrame
    rounds: int


def _log(df: DataFrame, seq: int, kind: str, **columns: str) -> DataFrame:
    """Records from expressions by column name; those not given are null."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [c.split(None, 1)[1] for c in SCHEMA.split(", ")]
    given = {"seq": str(seq), "kind": f"'{kind}'"} | columns
    return df.selectExpr(*(f"CAST({given.get(n, 'NULL')} AS {t}) AS {n}" for n, t in zip(names, types)))


def _stored_rows(p: Problem, gone: DataFrame) -> DataFrame:
    """The rows with their entries, as data for later."""
    entries = p.nnz.join(gone.select(*P.KEY).distinct(), P.KEY, "left_semi").groupBy(*P.KEY).agg(F.array_sort(F.collect_list(F.struct("col_id", "val"))).alias("entries"))
    return p.rows.join(gone.select(*P.KEY).distinct(), P.KEY, "left_semi").join(entries, P.KEY, "left")


def substitutable(p: Problem) -> DataFrame:
    """col_id, system, row_id, val: implied-free singleton columns of equalities, one for each row."""
    one = P.singleton_columns(p).where("action = 'substitute'")
    return one.groupBy(*P.KEY).agg(F.min(F.struct("col_id", "val")).alias("m")).select(*P.KEY, "m.col_id", "m.val")


def substitute(p: Problem, chosen: DataFrame) -> Problem:
    """Each chosen column replaced by its row: costs c_j - c_k a_j / a_k, offset + c_k b / a_k; row and column go."""
    pivot = chosen.join(p.cols.select("col_id", F.col("cost").alias("_ck")), "col_id").join(p.rows.select(*P.KEY, F.col("lo").alias("_b")), P.KEY)
    delta = p.nnz.join(pivot.select(*P.KEY, F.col("col_id").alias("_k"), F.col("val").alias("_ak"), "_ck"), P.KEY).where("col_id <> _k").groupBy("col_id").agg(F.sum(-F.col("_ck") * F.col("val") / F.col("_ak")).alias("_d"))
    offset = pivot.agg(F.coalesce(F.sum(F.col("_ck") * F.col("_b") / F.col("val")), F.lit(0.0))).first()[0]
    cols = p.cols.join(chosen.select("col_id"), "col_id", "left_anti").join(delta, "col_id", "left").withColumn("cost", F.col("cost") + F.coalesce("_d", F.lit(0.0))).select(*p.cols.columns)
    rows = chosen.select(*P.KEY)
    return p.with_(cols=cols, rows=p.rows.join(rows, P.KEY, "left_anti"), nnz=p.nnz.join(rows, P.KEY, "left_anti"), offset=p.offset + offset)


def _written(p: Problem) -> Problem:
    return p.with_(cols=checkpoint(p.cols), rows=checkpoint(p.rows), nnz=checkpoint(p.nnz))


def _feasible(p: Problem) -> None:
    if P.infeasible_bounds(p.cols).limit(1).count():
        raise ValueError("the problem is infeasible")


def _one_a_row(chosen: DataFrame) -> DataFrame:
    """Of several columns of a row that of least id."""
    return chosen.groupBy(*P.KEY).agg(F.min(F.struct("col_id", "val")).alias("m")).select(*P.KEY, "m.col_id", "m.val")


def presolve(p: Problem, max_rounds: int = 10, strengthen: int = 1, parallel: bool = True) -> Presolved:
    """Rounds of all rules until none changes anything.

    Singleton rows, fixed and empty columns, redundant rows, free singleton columns of
    equalities and inequalities, singleton columns that their cost and row push to a bound, in
    the first `strengthen` rounds implied bounds of columns with several entries, with parallel
    also parallel and nearly parallel rows.  An infeasible or unbounded problem raises an error.
    """
    p = _written(p)
    log = p.cols.sparkSession.createDataFrame([], SCHEMA)
    seq = rounds = 0

    def add(records: DataFrame) -> int:
        nonlocal log, seq
        records = checkpoint(records)
        n = records.count()
        if n:
            log = log.unionByName(records)
            seq += 1
        return n

    for _ in range(max_rounds):
        rounds += 1
        changed = 0
        smaller, gone = P.drop_singleton_rows(p)
        if add(_log(_stored_rows(p, gone), seq, "singleton_row", system="system", row_id="row_id", a="lo", b="hi", entries="entries")):
            p, changed = _written(smaller), changed + 1
            _feasible(p)
        if rounds <= strengthen:
            several = p.nnz.groupBy("col_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("col_id")
            better = checkpoint(P.accepted_bounds(p, P.implied_bounds(p).join(several, "col_id", "left_semi")))
            old = better.join(p.cols.select("col_id", F.col("lb").alias("_l"), F.col("ub").alias("_u")), "col_id")
            if add(_log(old, seq, "bound_tightened", col_id="col_id", a="_l", b="_u")):
                p, changed = _written(p.with_(cols=P.tighten(p.cols, better))), changed + 1
                _feasible(p)
        if parallel:
            p, n = _parallel(p, lambda: seq, add)
            changed += n
        fixed = checkpoint(P.fixed_columns(p))
        if add(_log(fixed, seq, "fixed_column", col_id="col_id", a="value")):
            p, changed = _written(P.fix(p, fixed)), changed + 1
        empty = checkpoint(P.empty_columns(p))
        if empty.where("status = 'unbounded'").limit(1).count():
            raise ValueError("the problem is unbounded or infeasible")
        if add(_log(empty, seq, "empty_column", col_id="col_id", a="value")):
            p, changed = _written(P.fix(p, empty.select("col_id", "value"))), changed + 1
        status = checkpoint(P.row_status(p).where("status IN ('infeasible', 'redundant')"))
        if status.where("status = 'infeasible'").limit(1).count():
            raise ValueError("the problem is infeasible")
        if add(_log(_stored_rows(p, status), seq, "redundant_row", system="system", row_id="row_id", a="lo", b="hi", entries="entries")):
            keys = status.select(*P.KEY)
            p, changed = _written(p.with_(rows=p.rows.join(keys, P.KEY, "left_anti"), nnz=p.nnz.join(keys, P.KEY, "left_anti"))), changed + 1
        chosen = checkpoint(substitutable(p))
        stored = _stored_rows(p, chosen).join(chosen.select(*P.KEY, "col_id", "val"), P.KEY)
        if add(_log(stored, seq, "free_column_equality", system="system", row_id="row_id", col_id="col_id", a="lo", b="val", entries="entries")):
            p, changed = _written(substitute(p, chosen)), changed + 1
        pushed = checkpoint(_one_a_row(P.singleton_columns(p).where("action IN ('fix_lower', 'fix_upper')")).join(P.singleton_columns(p).select("col_id", "action"), "col_id").join(p.cols.select("col_id", "lb", "ub"), "col_id").selectExpr("col_id", "system", "row_id", "CASE action WHEN 'fix_lower' THEN lb ELSE ub END AS value"))
        if add(_log(pushed, seq, "inequality_column", system="system", row_id="row_id", col_id="col_id", a="value")):
            p, changed = _written(P.fix(p, pushed.select("col_id", "value"))), changed + 1
        loose = checkpoint(_one_a_row(P.singleton_columns(p).where("action = 'drop_row'")))
        stored = _stored_rows(p, loose).join(loose.select(*P.KEY, "col_id", "val"), P.KEY)
        if add(_log(stored, seq, "free_column_inequality", system="system", row_id="row_id", col_id="col_id", a="lo", b="hi", c="val", entries="entries")):
            gone = loose.select(*P.KEY)
            p, changed = _written(p.with_(cols=p.cols.join(loose.select("col_id"), "col_id", "left_anti"), rows=p.rows.join(gone, P.KEY, "left_anti"), nnz=p.nnz.join(gone, P.KEY, "left_anti"))), changed + 1
        if not changed:
            break
    return Presolved(p, log, rounds)


def _parallel(p: Problem, seq, add) -> tuple[Problem, int]:
    """The rules of parallel and nearly parallel rows, one after another; how many of them changed the problem."""
    changed = 0
    ranked = P.normalized_rows(p)
    kept = ranked.groupBy("signature").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if kept.limit(1).count():
        smaller = _written(P.drop_parallel_rows(p))
        gone = p.rows.join(smaller.rows.select(*P.KEY), P.KEY, "left_anti")
        if add(_log(_stored_rows(p, gone), seq(), "parallel_row", system="system", row_id="row_id", a="lo", b="hi", entries="entries")):
            p, changed = smaller, changed + 1
    smaller, told = P.bound_by_nearly_parallel(p)
    if add(_log(told, seq(), "nearly_parallel_bound", system="system", row_id="row_id", col_id="col_id", a="lb", b="ub")):
        p, changed = _written(smaller), changed + 1
        _feasible(p)
    pairs = checkpoint(P.nearly_parallel_rows(p))
    record = pairs.selectExpr("'EQ' AS system", "row2 AS row_id", "col2 AS col_id", "shift AS a", "array(named_struct('col_id', col1, 'val', slope)) AS entries")
    if add(_log(record, seq(), "nearly_parallel_equality", system="system", row_id="row_id", col_id="col_id", a="a", entries="entries")):
        p, changed = _written(P.substitute_nearly_parallel(p, pairs)), changed + 1
        _feasible(p)
    pairs = checkpoint(P.nearly_parallel_inequalities(p))
    record = pairs.selectExpr("'INEQ' AS system", "row2 AS row_id", "col2 AS col_id", "0.0 AS a", "array(named_struct('col_id', col1, 'val', slope)) AS entries")
    if add(_log(record, seq(), "nearly_parallel_inequality", system="system", row_id="row_id", col_id="col_id", a="a", entries="entries")):
        p, changed = _written(P.merge_nearly_parallel_inequalities(p, pairs)), changed + 1
    return p, changed


def row_values(records: DataFrame, x: DataFrame) -> DataFrame:
    """system, row_id, value: stored rows times x; columns that x lacks count as 0."""
    terms = records.select(*P.KEY, F.explode("entries").alias("e")).select(*P.KEY, "e.col_id", "e.val")
    return terms.join(x, "col_id", "left").groupBy(*P.KEY).agg(F.sum(F.col("val") * F.coalesce("x", F.lit(0.0))).alias("value"))


def postsolve(done: Presolved, x: DataFrame) -> DataFrame:
    """(col_id, x) of the original problem from that of the reduced one."""
    last = done.reductions.agg(F.max("seq")).first()[0]
    for seq in range(-1 if last is None else last, -1, -1):
        records = done.reductions.where(F.col("seq") == seq)
        values = records.where("kind IN ('fixed_column', 'empty_column', 'inequality_column')").select("col_id", F.col("a").alias("x"))
        free = records.where("kind = 'free_column_equality'")
        others = row_values(free, x)
        solved = free.join(others, P.KEY, "left").select("col_id", ((F.col("a") - F.coalesce("value", F.lit(0.0))) / F.col("b")).alias("x"))
        tied = records.where("kind IN ('nearly_parallel_equality', 'nearly_parallel_inequality')").select("col_id", "a", F.col("entries")[0]["col_id"].alias("_c"), F.col("entries")[0]["val"].alias("_s"))
        tied = tied.join(x.select(F.col("col_id").alias("_c"), F.col("x").alias("_x")), "_c").select("col_id", (F.col("_s") * F.col("_x") + F.col("a")).alias("x"))
        loose = records.where("kind = 'free_column_inequality'")
        rest = F.coalesce("value", F.lit(0.0))
        needed = F.greatest(F.coalesce(F.col("a") - rest, F.lit(0.0)), F.lit(0.0)) + F.least(F.coalesce(F.col("b") - rest, F.lit(0.0)), F.lit(0.0))  # what the row lacks to its nearer side
        within = loose.join(row_values(loose, x), P.KEY, "left").select("col_id", (needed / F.col("c")).alias("x"))
        x = checkpoint(x.unionByName(values).unionByName(solved).unionByName(tied).unionByName(within))
    return x


def violations(p: Problem, x: DataFrame, tol: float = 1e-6) -> DataFrame:
    """what, id, by: bounds and sides that x leaves; empty when x is feasible."""
    at = p.cols.join(x, "col_id", "left")
    bound = F.greatest(F.col("lb") - F.col("x"), F.col("x") - F.col("ub"))
    value = p.nnz.join(x, "col_id").groupBy(*P.KEY).agg(F.sum(F.col("val") * F.col("x")).alias("_v"))
    sides = p.rows.join(value, P.KEY, "left").withColumn("_v", F.coalesce("_v", F.lit(0.0)))
    side = F.greatest(F.col("lo") - F.col("_v"), F.col("_v") - F.col("hi"))
    out = at.select(F.lit("column").alias("what"), F.col("col_id").alias("id"), F.when(F.col("x").isNull(), F.lit(float("inf"))).otherwise(bound).alias("by"))
    return out.unionByName(sides.select(F.col("system").alias("what"), F.col("row_id").alias("id"), side.alias("by"))).where(F.col("by") > tol)
