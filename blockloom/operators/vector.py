"""Element-wise and reducing operators on vectors.

A vector is a column of a DataFrame keyed by an id; two vectors of one length are two columns
(after an equi-join on the id).  A missing bound is null, so an indicator vector of zeros and
ones is the null pattern of its column.  All operators are column expressions and stay inside
generated code; reductions are aggregates and combine on the map side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.tolerance import EPS_ZERO
from blockloom.session import checkpoint

Number = float | int | Column
#: Values that a fold takes at most.
FOLDED = 1_000_000


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def align(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Two vectors by position: the implicit join of all two-vector operators."""
    return left.join(right, key)


# --- element-wise ---------------------------------------------------------------------------


def negate(v: Column) -> Column:
    return -v


def square_root(v: Column) -> Column:
    """Null of a negative entry."""
    return F.when(v >= 0, F.sqrt(v))


def set_to_constant(value: float) -> Column:
    return F.lit(float(value))


def copy_abs(v: Column) -> Column:
    return F.abs(v)


def component_mult(v: Column, x: Column) -> Column:
    return v * x


def component_div(v: Column, x: Column) -> Column:
    """v / x; a division by zero gives null."""
    return v / F.nullif(x, F.lit(0.0))


def axpy(v: Column, alpha: Number, x: Column) -> Column:
    return v + _c(alpha) * x


def axzpy(v: Column, alpha: Number, x: Column, z: Column) -> Column:
    return v + _c(alpha) * x * z


def axdzpy(v: Column, alpha: Number, x: Column, z: Column, select: Column | None = None) -> Column:
    """v + alpha x / z, where select is not zero."""
    out = v + _c(alpha) * x / F.nullif(z, F.lit(0.0))
    return out if select is None else F.when(select != 0, out).otherwise(v)


def add_constant(v: Column, c: Number, select: Column | None = None) -> Column:
    return v + _c(c) if select is None else F.when(select != 0, v + _c(c)).otherwise(v)


def scale(v: Column, alpha: Number) -> Column:
    return v * _c(alpha)


def invert(v: Column) -> Column:
    return F.lit(1.0) / F.nullif(v, F.lit(0.0))


def safe_invert(v: Column, replacement: float) -> Column:
    return F.when(v != 0, 1.0 / F.nullif(v, F.lit(0.0))).otherwise(F.lit(float(replacement)))


def push_away_from_zero(v: Column, tol: float, amount: float, select: Column | None = None) -> Column:
    hit = F.abs(v) <= tol
    return F.when(hit if select is None else hit & (select != 0), v + amount).otherwise(v)


def push_small_pairs(x: Column, y: Column, tol_x: float, tol_y: float, tol_pair: float, select: Column | None = None) -> tuple[Column, Column]:
    """Pairs with x y below tol_pair: the smaller grows to tol_pair / larger, then each to its own tolerance."""
    low = x * y < tol_pair
    a = F.when(low & (x < y), tol_pair / F.nullif(y, F.lit(0.0))).otherwise(x)
    b = F.when(low & (x >= y), tol_pair / F.nullif(x, F.lit(0.0))).otherwise(y)
    a, b = F.greatest(a, F.lit(tol_x)), F.greatest(b, F.lit(tol_y))
    return (a, b) if select is None else (F.when(select != 0, a).otherwise(x), F.when(select != 0, b).otherwise(y))


def project_to_range(v: Column, low: float, high: float) -> Column:
    """What moves v into [low, high], but not below -high."""
    return F.greatest(F.when(v < low, low - v).when(v > high, high - v).otherwise(F.lit(0.0)), F.lit(-high))


def fill_absent(v: Column, value: float) -> Column:
    return F.coalesce(v, F.lit(float(value)))


def select_nonzeros(v: Column, select: Column) -> Column:
    return F.when(select != 0, v).otherwise(F.lit(0.0))


def positive_part(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0))


def negative_part(v: Column) -> Column:
    return F.least(v, F.lit(0.0))


def divide_some(v: Column, d: Column, select: Column) -> Column:
    return F.when(select != 0, v / F.nullif(d, F.lit(0.0))).otherwise(v)


def abs_min_update(acc: Column, v: Column) -> Column:
    return F.least(acc, F.abs(v))


def abs_max_update(acc: Column, v: Column) -> Column:
    return F.greatest(acc, F.abs(v))


# --- reductions -----------------------------------------------------------------------------


def two_norm(v: Column) -> Column:
    return F.sqrt(F.coalesce(F.sum(v * v), F.lit(0.0)))


def inf_norm(v: Column) -> Column:
    """The greatest absolute value; 0 of an empty vector."""
    return F.coalesce(F.max(F.abs(v)), F.lit(0.0))


def one_norm(v: Column) -> Column:
    return F.coalesce(F.sum(F.abs(v)), F.lit(0.0))


def dot(v: Column, x: Column) -> Column:
    return F.sum(v * x)


def dot_self(v: Column, factor: float = 1.0) -> Column:
    return F.lit(factor * factor) * F.sum(v * v)


def scaled_dot_self(v: Column, s: Column) -> Column:
    return F.sum(F.when(s != 0, v * v / F.nullif(s, F.lit(0.0))))


def shifted_dot(v: Column, alpha: Number, s: Column, y: Column, beta: Number, t: Column) -> Column:
    return F.sum((v + _c(alpha) * s) * (y + _c(beta) * t))


def arg_min(v: Column, ident: Column) -> Column:
    """struct(value, id); of equal values the least id."""
    return F.min(F.struct(v.alias("value"), ident.alias("id")))


def arg_max(v: Column, ident: Column) -> Column:
    """struct(value, id); of equal values the least id."""
    best = F.min(F.struct((-v).alias("v"), ident.alias("id")))
    return F.struct((-best["v"]).alias("value"), best["id"].alias("id"))


def abs_min(v: Column) -> Column:
    return F.min(F.abs(v))


def abs_min_nonzero(v: Column, eps: float = EPS_ZERO) -> Column:
    """Null when nothing lies above eps."""
    return F.min(F.when(F.abs(v) > eps, F.abs(v)))


def count_nonzero(v: Column, eps: float = 0.0) -> Column:
    return F.count_if(F.abs(v) > eps)


def sum_and_count_small(v: Column, tol: float) -> tuple[Column, Column]:
    return F.coalesce(F.sum(F.when(F.abs(v) <= tol, v)), F.lit(0.0)), F.count_if(F.abs(v) <= tol)


def for_all(condition: Column) -> Column:
    """True of an empty vector."""
    return F.coalesce(F.bool_and(condition), F.lit(True))


def all_differ(v: Column, value: float, tol: float) -> Column:
    return for_all(F.abs(v - value) > tol)


def all_positive(v: Column, select: Column | None = None) -> Column:
    return for_all(v > 0) if select is None else for_all((select == 0) | (v > 0))


def is_zero(v: Column) -> Column:
    return for_all(v == 0)


def count_distinct(v: Column, eps: float = 0.0) -> Column:
    """How many different values there are, those within one step of eps counted once."""
    return F.countDistinct(F.round(v / eps) if eps else v)


def extreme_sums(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """The pairs with the least and the greatest |a b + c d| that is not zero: structs value, a, b, c, d."""
    value = F.abs(a * b + c * d)
    live = F.when(value > 0, value)
    parts = [a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")]
    return F.min(F.when(live.isNotNull(), F.struct(live.alias("value"), *parts))), F.max(F.when(live.isNotNull(), F.struct(live.alias("value"), *parts)))


def all_close(v: Column, x: Column, tol: float) -> Column:
    return for_all(F.abs(v - x) <= tol)


def matches_pattern(v: Column, select: Column) -> Column:
    return for_all((v == 0) | (select != 0))


def step_to_boundary(v: Column, step: Column, fraction: float = 1.0) -> Column:
    """The longest step of at most 1 that leaves v at (1 - fraction) v or above."""
    return F.least(F.lit(1.0), F.coalesce(F.min(F.when((step < 0) & (v >= 0), -fraction * v / F.nullif(step, F.lit(0.0)))), F.lit(1.0)))


def barrier_directional(v: Column, x: Column, bound: Column) -> Column:
    return F.sum(F.when(bound.isNotNull() & (x != bound), v / F.nullif(x - bound, F.lit(0.0))))


def extreme_pair(a: Column, b: Column, ident: Column) -> tuple[Column, Column]:
    """arg_min and arg_max of |a / b| over pairs whose ratio is not zero."""
    ratio = F.abs(a / F.nullif(b, F.lit(0.0)))
    live = F.when(ratio > 0, ratio)
    return F.min(F.when(live.isNotNull(), F.struct(live.alias("value"), ident.alias("id")))), F.min(F.when(live.isNotNull(), F.struct((-live).alias("value"), ident.alias("id"))))


def fold(v: Column, start: float, step: Callable[[Column, Column], Column]) -> Column:
    """A fold with a user's function over the collected values in ascending order.

    A group of more than FOLDED values raises an error instead of growing in one task.
    """
    values = F.when(F.count(v) <= FOLDED, F.lit(True)).otherwise(F.raise_error(F.lit(f"a fold of more than {FOLDED} values")).cast("boolean"))
    return F.when(values, F.aggregate(F.array_sort(F.collect_list(v)), F.lit(float(start)), step))


def blocking(df: DataFrame, pairs: dict[str, tuple[Column, Column]], ident: Column) -> DataFrame:
    """ratio, id, which: the least of -value/step over falling steps of all families; ties go to the least id."""
    return df.select(F.explode(F.array(*(F.struct(F.when((s < 0) & (v >= 0), -v / F.nullif(s, F.lit(0.0))).alias("ratio"), ident.alias("id"), F.lit(n).alias("which")) for n, (v, s) in pairs.items()))).alias("x")).where("x.ratio IS NOT NULL").agg(F.min("x").alias("x")).select("x.*")


# --- order and position -----------------------------------------------------------------------


def positions(df: DataFrame, keys: list[str], name: str = "new_id", first: int = 0, buckets: int = 64) -> DataFrame:
    """Rows numbered without gaps in ascending order of the keys, without one global sort task.

    Rows are dealt into ranges of all keys and sorted there; the ranges are written once, so
    that every row's place within its range holds, and each range begins after the counts of
    those before.  Rows of equal keys go to one range.
    """
    within = F.monotonically_increasing_id()
    ranged = checkpoint(df.repartitionByRange(buckets, *keys).sortWithinPartitions(*keys).withColumn("_at", within))
    ranged = ranged.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))  # at most `buckets` rows
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    return ranged.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at") + first).drop("_range", "_before", "_at")


def remove_entries(df: DataFrame, keep: Column, ident: str = "id") -> DataFrame:
    """Entries for which keep holds, numbered anew as `new_id`."""
    return positions(df.where(keep), [ident])


def permute(df: DataFrame, permutation: DataFrame, ident: str = "id") -> DataFrame:
    """Entries moved to `position`; permutation has (id, position)."""
    return df.join(permutation, ident)


def inverse_permutation(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col("position").alias("id"), F.col("id").alias("position"))


def permutation_is_valid(permutation: DataFrame) -> DataFrame:
    """One row, `valid`: the positions are 0..n-1, each once."""
    return permutation.agg(F.coalesce((F.count("*") == F.countDistinct("position")) & (F.min("position") == 0) & (F.max("position") == F.count("*") - 1), F.lit(True)).alias("valid"))


def concat(parts: dict[str, DataFrame]) -> DataFrame:
    """Vectors under one another, with `part` to split them again."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("part", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def split(joint: DataFrame, part: str) -> DataFrame:
    return joint.where(F.col("part") == part).drop("part")


def append_constant(df: DataFrame, n: int, value: float, to_front: bool = False) -> DataFrame:
    """n entries of one value before or after the ids 0..len-1."""
    spark = df.sparkSession
    if to_front:
        return spark.range(n).select(F.col("id"), F.lit(float(value)).alias("v")).unionByName(df.select((F.col("id") + n).alias("id"), "v"))
    size = df.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    return df.select("id", "v").unionByName(spark.range(size, size + n).select(F.col("id"), F.lit(float(value)).alias("v")))


def shave(df: DataFrame, n: int, top: bool) -> tuple[DataFrame, DataFrame]:
    """(shaved off, left): the first or last n entries, both with ids from 0."""
    size = df.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    at = n if top else size - n
    first, last = df.where(F.col("id") < at), df.where(F.col("id") >= at).withColumn("id", F.col("id") - at)
    return (first, last) if top else (last, first)
