"""Primal-dual interior-point method for block-structured problems.

Root columns and linking rows join blocks that are independent otherwise.  Each block is one
row of a DataFrame that holds its matrices and its part of the iterate; its factor, its share
of the Schur complement and its step are computed where the row is.  Only sums over the
blocks, of the size of the root, reach the driver, which solves the root system.  The iterate
is written to the checkpoint folder after every iteration.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.iterate import ROW, Iterate
from blockloom.operators.presolve import fix, fixed_columns, inequalities_to_equalities
from blockloom.plans.lp import Problem
from blockloom.session import checkpoint

DUAL_REGULAR, PRIMAL_REGULAR = 1e-10, 1e-9
SCHEMA = "block int, data binary"
SUMS = "name string, position int, value double"


@dataclass
class Solution:
    status: str
    objective: float
    iterations: int
    x: DataFrame  # col_id, x
    mu: float
    residual: float
    history: list[tuple[float, float]]
    iterate: Iterate  # x, duals and gaps of the problem as it was given


def _dump(d: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **d)
    return out.getvalue()


def _load(raw: bytes) -> dict:
    with np.load(io.BytesIO(bytes(raw))) as z:
        return {k: z[k] for k in z.files}


def _dense(part: pd.DataFrame, rows: dict, cols: dict) -> np.ndarray:
    out = np.zeros((len(rows), len(cols)))
    for r, c, v in zip(part.row_id, part.col_id, part.val):
        out[rows[r], cols[c]] += v
    return out


def _start(b: dict, scale: float) -> dict:
    """Strictly between the bounds, with equal bound duals."""
    lb, ub = b["lb"], b["ub"]
    low, high = np.isfinite(lb), np.isfinite(ub)
    x = np.where(low & high, (np.where(low, lb, 0) + np.where(high, ub, 0)) / 2, np.where(low, np.where(low, lb, 0) + scale, np.where(high, np.where(high, ub, 0) - scale, 0)))
    return b | {"x": x, "y": np.zeros(len(b["b"])), "g": np.where(low, scale, 0.0), "f": np.where(high, scale, 0.0)}


def _gaps(b: dict):
    v = np.where(np.isfinite(b["lb"]), b["x"] - np.where(np.isfinite(b["lb"]), b["lb"], 0), 1.0)
    w = np.where(np.isfinite(b["ub"]), np.where(np.isfinite(b["ub"]), b["ub"], 0) - b["x"], 1.0)
    return v, w


def _kkt(b: dict) -> np.ndarray:
    v, w = _gaps(b)
    n, m = len(b["x"]), len(b["b"])
    k = np.zeros((n + m, n + m))
    k[:n, :n] = -np.diag(b["g"] / v + b["f"] / w + PRIMAL_REGULAR)
    k[:n, n:], k[n:, :n] = b["A"].T, b["A"]
    k[n:, n:] = DUAL_REGULAR * np.eye(m)
    return k


def _border(b: dict, n0: int, m0: int) -> np.ndarray:
    """Columns: root x, root rows, linking rows."""
    n, m = len(b["x"]), len(b["b"])
    out = np.zeros((n + m, n0 + m0 + len(b["L"])))
    out[:n, n0 + m0 :] = b["L"].T
    out[n:, :n0] = b["T"]
    return out


def _right(b: dict, rd: np.ndarray, rp: np.ndarray, target: float, second: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v, w = _gaps(b)
    rg = np.where(np.isfinite(b["lb"]), target - v * b["g"], 0.0)
    rf = np.where(np.isfinite(b["ub"]), target - w * b["f"], 0.0)
    if second is not None:
        dx, dg, df = second
        rg = rg - np.where(np.isfinite(b["lb"]), dx * dg, 0.0)
        rf = rf + np.where(np.isfinite(b["ub"]), dx * df, 0.0)
    return np.concatenate([rd - rg / v + rf / w, rp]), rg, rf


def _bound_steps(b: dict, dx: np.ndarray, rg: np.ndarray, rf: np.ndarray):
    v, w = _gaps(b)
    dg = np.where(np.isfinite(b["lb"]), (rg - b["g"] * dx) / v, 0.0)
    df = np.where(np.isfinite(b["ub"]), (rf + b["f"] * dx) / w, 0.0)
    return dg, df


def _longest(b: dict, dx: np.ndarray, dg: np.ndarray, df: np.ndarray) -> tuple[float, float]:
    v, w = _gaps(b)
    low, high = np.isfinite(b["lb"]), np.isfinite(b["ub"])
    ratio = lambda a, d, on: float(np.min(np.where(on & (d < 0), -a / np.where(d < 0, d, -1.0), np.inf), initial=np.inf))
    return min(ratio(v, dx, low), ratio(w, -dx, high)), min(ratio(b["g"], dg, low), ratio(b["f"], df, high))


def _pair_sums(b: dict, dx: np.ndarray, dg: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Complementarity after steps (p, d) is s0 + p s1 + d s2 + p d s3; s4 counts the pairs."""
    v, w = _gaps(b)
    low, high = np.isfinite(b["lb"]), np.isfinite(b["ub"])
    return np.array([(v * b["g"])[low].sum() + (w * b["f"])[high].sum(), (dx * b["g"])[low].sum() - (dx * b["f"])[high].sum(), (v * dg)[low].sum() + (w * df)[high].sum(), (dx * dg)[low].sum() - (dx * df)[high].sum(), low.sum() + high.sum()])


class _Step:
    """What one block does in one iteration, given the root's parts of the solutions so far."""

    def __init__(self, b: dict, root_y_link: np.ndarray, root_x: np.ndarray, n0: int, m0: int):
        self.b, self.n = b, len(b["x"])
        self.border = _border(b, n0, m0)
        self.rd = b["c"] - b["A"].T @ b["y"] - b["L"].T @ root_y_link - b["g"] + b["f"]
        self.rp = b["b"] - b["A"] @ b["x"] - b["T"] @ root_x
        self.k = _kkt(b)

    def forward(self, target: float, second=None) -> np.ndarray:
        r, _, _ = _right(self.b, self.rd, self.rp, target, second)
        return self.border.T @ np.linalg.solve(self.k, r)

    def back(self, z: np.ndarray, target: float, second=None):
        r, rg, rf = _right(self.b, self.rd, self.rp, target, second)
        d = np.linalg.solve(self.k, r - self.border @ z)
        dx = d[: self.n]
        return dx, d[self.n :], *_bound_steps(self.b, dx, rg, rf)


def _sum(blocks: DataFrame, f) -> dict[str, np.ndarray]:
    """Sums over the blocks of the named vectors f gives; those named min_... are minima."""

    def run(batches):
        for pdf in batches:
            for raw in pdf.data:
                rows = [(name, k, float(x)) for name, value in f(_load(raw)).items() for k, x in enumerate(np.ravel(value))]
                yield pd.DataFrame(rows, columns=["name", "position", "value"])

    total = blocks.mapInPandas(run, SUMS).groupBy("name", "position").agg(F.sum("value").alias("s"), F.min("value").alias("m")).collect()
    out: dict[str, np.ndarray] = {}
    for r in sorted(total, key=lambda r: (r["name"], r["position"])):
        out.setdefault(r["name"], []).append(r["m"] if r["name"].startswith("min_") else r["s"])
    return {k: np.array(v) for k, v in out.items()}


def _blocks(p: Problem) -> tuple[DataFrame, dict, dict[str, list]]:
    """(child blocks, the root's own data, ids): the root has block 0 columns and rows, linking rows have block -1."""
    root_cols = sorted(map(tuple, p.cols.where("block = 0").select("col_id", "cost", "lb", "ub").collect()))
    root_rows = sorted(map(tuple, p.rows.where("block = 0").select("row_id", "lo").collect()))
    link_rows = sorted(map(tuple, p.rows.where("block = -1").select("row_id", "lo").collect()))
    x0, r0, rl = ({t[0]: k for k, t in enumerate(part)} for part in (root_cols, root_rows, link_rows))
    real = lambda values, absent: np.array([absent if v is None else v for v in values], float)
    own = p.nnz.where("row_block <= 0 AND col_block = 0").select("row_id", "col_id", "val", "row_block").toPandas()
    root = {
        "c": real([t[1] for t in root_cols], 0), "lb": real([t[2] for t in root_cols], -np.inf), "ub": real([t[3] for t in root_cols], np.inf), "b": real([t[1] for t in root_rows], 0),
        "A": _dense(own[own.row_block == 0], r0, x0), "L": _dense(own[own.row_block == -1], rl, x0), "T": np.zeros((len(root_rows), 0)), "bl": real([t[1] for t in link_rows], 0),
    }
    none = "CAST(NULL AS LONG)"
    parts = p.cols.where("block > 0").selectExpr("block", "'col' AS kind", f"{none} AS row_id", "col_id", "cost AS a", "lb AS b", "ub AS c", "0 AS home")
    parts = parts.unionByName(p.rows.where("block > 0").selectExpr("block", "'row' AS kind", "row_id", f"{none} AS col_id", "lo AS a", "CAST(NULL AS DOUBLE) AS b", "CAST(NULL AS DOUBLE) AS c", "0 AS home"))
    parts = parts.unionByName(p.nnz.where("row_block > 0 OR col_block > 0").selectExpr("CASE WHEN row_block > 0 THEN row_block ELSE col_block END AS block", "CASE WHEN row_block = -1 THEN 'link' WHEN col_block = 0 THEN 'root' ELSE 'own' END AS kind", "row_id", "col_id", "val AS a", "CAST(NULL AS DOUBLE) AS b", "CAST(NULL AS DOUBLE) AS c", "row_block AS home"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        cols, rows = (pdf[pdf.kind == k].sort_values(i) for k, i in (("col", "col_id"), ("row", "row_id")))
        xi, ri = {c: k for k, c in enumerate(cols.col_id)}, {r: k for k, r in enumerate(rows.row_id)}
        entries = pdf.rename(columns={"a": "val"})
        data = {
            "ids": cols.col_id.to_numpy(np.int64), "rids": rows.row_id.to_numpy(np.int64), "c": cols.a.to_numpy(float), "lb": cols.b.fillna(-np.inf).to_numpy(float), "ub": cols.c.fillna(np.inf).to_numpy(float), "b": rows.a.to_numpy(float),
            "A": _dense(entries[entries.kind == "own"], ri, xi), "T": _dense(entries[entries.kind == "root"], ri, x0), "L": _dense(entries[entries.kind == "link"], rl, xi),
        }
        return pd.DataFrame({"block": [int(pdf.block.iloc[0])], "data": [_dump(data)]})

    return parts.groupBy("block").applyInPandas(build, SCHEMA), root, {"x0": [t[0] for t in root_cols], "r0": [t[0] for t in root_rows], "rl": [t[0] for t in link_rows]}


def solve(problem: Problem, max_iterations: int = 100, mu_tolerance: float = 1e-8, residual_tolerance: float = 1e-7) -> Solution:
    """Minimises; blocks are numbered from 1, the root is 0 and linking rows have block -1.

    Inequalities get slack columns first, and columns whose bounds meet are substituted.  Row
    ids of equalities and inequalities may overlap.  From the tenth iteration on a problem counts
    as infeasible if its residual and complementarity have grown 1e4 times beyond their best.
    """
    fixed = fixed_columns(problem, 1e-9)
    p = inequalities_to_equalities(fix(problem, fixed))
    p = p.with_(cols=p.cols.withColumn("block", F.greatest("block", F.lit(0))), nnz=p.nnz.withColumn("col_block", F.greatest("col_block", F.lit(0))))
    blocks, root, ids = _blocks(p)
    n0, m0, ml = len(root["c"]), len(root["b"]), len(root["bl"])
    scale = max(1.0, float(np.sqrt(max([1.0, *np.abs(root["b"]), *np.abs(root["bl"]), *np.abs(root["c"])]))))
    root = _start(root, scale)
    yl = np.zeros(ml)
    blocks = checkpoint(_mapped(blocks, lambda b: _start(b, scale)))
    history: list[tuple[float, float]] = []
    status = "max_iterations"
    mu = residual = best = np.inf
    for _ in range(max_iterations + 1):
        x0, y_link = root["x"], yl

        def first(b, x0=x0, y_link=y_link):
            s = _Step(b, y_link, x0, n0, m0)
            return {"schur": s.border.T @ np.linalg.solve(s.k, s.border), "forward": s.forward(0.0), "ty": b["T"].T @ b["y"], "lx": b["L"] @ b["x"], "pairs": _pair_sums(b, 0 * b["x"], 0 * b["x"], 0 * b["x"]), "min_rd": [-np.abs(s.rd).max(initial=0)], "min_rp": [-np.abs(s.rp).max(initial=0)]}

        t = _sum(blocks, first)
        zero = lambda name, n: t.get(name, np.zeros(n))  # noqa: E731, B023
        rd0 = root["c"] - root["A"].T @ root["y"] - root["L"].T @ yl - zero("ty", n0) - root["g"] + root["f"]
        rp0 = root["b"] - root["A"] @ root["x"]
        rl = root["bl"] - root["L"] @ root["x"] - zero("lx", ml)
        pairs = _pair_sums(root, 0 * root["x"], 0 * root["x"], 0 * root["x"]) + zero("pairs", 5)
        mu = pairs[0] / max(pairs[4], 1)
        residual = max(np.abs(r).max(initial=0) for r in (rd0, rp0, rl, zero("min_rd", 1), zero("min_rp", 1)))
        history.append((float(mu), float(residual)))
        if mu <= mu_tolerance and residual <= residual_tolerance * scale * scale:
            status = "optimal"
            break
        merit = float(residual + mu * pairs[4]) / (scale * scale)
        best = min(best, merit)
        if len(history) > 10 and (not np.isfinite(merit) or merit >= max(1e-8, 1e4 * best)):
            status = "infeasible"
            break
        k = np.zeros((n0 + m0 + ml, n0 + m0 + ml))
        k[: n0 + m0, : n0 + m0] = _kkt(root)
        k[:n0, n0 + m0 :], k[n0 + m0 :, :n0] = root["L"].T, root["L"]
        k[n0 + m0 :, n0 + m0 :] = DUAL_REGULAR * np.eye(ml)
        k = k - zero("schur", len(k) ** 2).reshape(k.shape)

        def root_step(forward, target, second=None, k=k, rd0=rd0, rp0=rp0, rl=rl):
            r, rg, rf = _right(root, rd0, rp0, target, second)
            z = np.linalg.solve(k, np.concatenate([r, rl]) - forward) if len(k) else np.zeros(0)
            return z, (z[:n0], z[n0 : n0 + m0], *_bound_steps(root, z[:n0], rg, rf))

        z_aff, d_aff = root_step(zero("forward", len(k)), 0.0)

        def affine(b, z=z_aff, x0=x0, y_link=y_link):
            dx, _, dg, df = _Step(b, y_link, x0, n0, m0).back(z, 0.0)
            a, d = _longest(b, dx, dg, df)
            return {"min_p": [a], "min_d": [d], "pairs": _pair_sums(b, dx, dg, df)}

        t = _sum(blocks, affine)
        dx, _, dg, df = d_aff
        a, d = (min(1.0, own, float(zero(n, 1)[0]) if n in t else np.inf) for own, n in zip(_longest(root, dx, dg, df), ("min_p", "min_d")))
        s = _pair_sums(root, dx, dg, df) + zero("pairs", 5)
        sigma = min(1.0, max(0.0, (s[0] + a * s[1] + d * s[2] + a * d * s[3]) / max(s[0], 1e-300))) ** 3
        target = sigma * mu

        def corrected(b, z=z_aff, target=target, x0=x0, y_link=y_link):
            step = _Step(b, y_link, x0, n0, m0)
            dx, _, dg, df = step.back(z, 0.0)
            return {"forward": step.forward(target, (dx, dg, df))}

        z, d_root = root_step(_sum(blocks, corrected).get("forward", np.zeros(len(k))), target, (dx, dg, df))

        def whole(b, z=z, z_aff=z_aff, target=target, x0=x0, y_link=y_link):
            step = _Step(b, y_link, x0, n0, m0)
            dx, _, dg, df = step.back(z_aff, 0.0)
            return step.back(z, target, (dx, dg, df))

        def lengths(b, whole=whole):
            dx, _, dg, df = whole(b)
            a, d = _longest(b, dx, dg, df)
            return {"min_p": [a], "min_d": [d]}

        t = _sum(blocks, lengths)
        a, d = (min(1.0, 0.9995 * min(own, float(t[n][0]) if n in t else np.inf)) for own, n in zip(_longest(root, d_root[0], d_root[2], d_root[3]), ("min_p", "min_d")))

        def moved(b, whole=whole, a=a, d=d):
            dx, dy, dg, df = whole(b)
            return b | {"x": b["x"] + a * dx, "y": b["y"] + d * dy, "g": b["g"] + d * dg, "f": b["f"] + d * df}

        blocks = checkpoint(_mapped(blocks, moved))
        root = root | {"x": root["x"] + a * d_root[0], "y": root["y"] + d * d_root[1], "g": root["g"] + d * d_root[2], "f": root["f"] + d * d_root[3]}
        yl = yl + d * z[n0 + m0 :]

    spark = problem.cols.sparkSession
    names = ["what", "id", "x", "low", "high"]

    def points(batches):
        for pdf in batches:
            for raw in pdf.data:
                b = _load(raw)
                yield pd.DataFrame({"what": "col", "id": b["ids"], "x": b["x"], "low": b["g"], "high": b["f"]})
                yield pd.DataFrame({"what": "row", "id": b["rids"], "x": b["y"], "low": np.nan, "high": np.nan})

    none = float("nan")
    own = [("col", int(i), float(v), float(g), float(f)) for i, v, g, f in zip(ids["x0"], root["x"], root["g"], root["f"])]
    own += [("row", int(i), float(v), none, none) for i, v in [*zip(ids["r0"], root["y"]), *zip(ids["rl"], yl)]]
    schema = "what string, id long, x double, low double, high double"
    told = checkpoint(blocks.mapInPandas(points, schema).unionByName(spark.createDataFrame(own, schema)).select(*names))
    it = _iterate(problem, fixed, told)
    x = it.cols.select("col_id", "x")
    objective = problem.offset + (problem.cols.join(x, "col_id").agg(F.sum(F.col("cost") * F.col("x"))).first()[0] or 0.0)
    return Solution(status, float(objective), len(history) - 1, x, float(mu), float(residual), history, it)


def _iterate(problem: Problem, fixed: DataFrame, told: DataFrame) -> Iterate:
    """The solver's values by the given problem's own ids; what is a slack column there is a row's s, lam and pi here.

    A column whose bounds meet has the duals that its reduced cost asks for.
    """
    base = problem.cols.join(fixed.select("col_id"), "col_id", "left_anti").agg(F.coalesce(F.max("col_id"), F.lit(0)) + 1).first()[0]
    low = problem.rows.where("system = 'EQ'").agg(F.coalesce(F.max("row_id"), F.lit(-1)) + 1).first()[0]
    cols, rows = told.where("what = 'col'"), told.where("what = 'row'")
    y = rows.where(F.col("id") < low).select(F.lit("EQ").alias("system"), F.col("id").alias("row_id"), F.col("x").alias("y"))
    y = y.unionByName(rows.where(F.col("id") >= low).select(F.lit("INEQ").alias("system"), (F.col("id") - low).alias("row_id"), F.col("x").alias("y")))
    slack = cols.where(F.col("id") >= base).select(F.lit("INEQ").alias("system"), (F.col("id") - base).alias("row_id"), F.col("x").alias("s"), F.col("low").alias("lam"), F.col("high").alias("pi"))
    r = problem.rows.join(y, ROW, "left").join(slack, ROW, "left")
    only = lambda bound, value: F.when(F.col("s").isNotNull() & F.col(bound).isNotNull(), value)
    whole = r.select(*ROW, "s", F.coalesce("y", F.lit(0.0)).alias("y"), only("lo", F.col("s") - F.col("lo")).alias("t"), only("hi", F.col("hi") - F.col("s")).alias("u"), only("lo", F.col("lam")).alias("lam"), only("hi", F.col("pi")).alias("pi"))
    aty = problem.nnz.join(fixed.select("col_id"), "col_id", "left_semi").join(whole.select(*ROW, "y"), ROW).groupBy("col_id").agg(F.sum(F.col("val") * F.col("y")).alias("_aty"))
    reduced = problem.cols.join(fixed, "col_id").join(aty, "col_id", "left").select("col_id", F.col("value").alias("x"), (F.col("cost") - F.coalesce("_aty", F.lit(0.0))).alias("_r"))
    values = cols.where(F.col("id") < base).select(F.col("id").alias("col_id"), "x", F.col("low").alias("g"), F.col("high").alias("f")).join(fixed.select("col_id"), "col_id", "left_anti")
    values = values.unionByName(reduced.select("col_id", "x", F.greatest("_r", F.lit(0.0)).alias("g"), F.greatest(-F.col("_r"), F.lit(0.0)).alias("f")))
    c = problem.cols.join(values, "col_id")
    there = lambda bound, value: F.when(F.col(bound).isNotNull(), value)
    return Iterate(c.select("col_id", "x", there("lb", F.col("x") - F.col("lb")).alias("v"), there("ub", F.col("ub") - F.col("x")).alias("w"), there("lb", F.col("g")).alias("gamma"), there("ub", F.col("f")).alias("phi")), whole)


def _mapped(blocks: DataFrame, f) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"block": pdf.block, "data": [_dump(f(_load(raw))) for raw in pdf.data]})

    return blocks.mapInPandas(run, SCHEMA)
