"""Operators on sparse matrices: DataFrames of (row_id, col_id, val).

Where a matrix also has `system`, rows are told apart by (system, row_id): equalities and
inequalities have ids of their own.

Products are an equi-join on the inner index and a grouped sum; the vector's side is small or
large as the data have it, and Spark chooses how to join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.tolerance import EPS


def row_key(*frames: DataFrame) -> list[str]:
    """What tells rows apart in all of the frames."""
    return ["system", "row_id"] if all("system" in f.columns for f in frames) else ["row_id"]


def mult(nnz: DataFrame, x: DataFrame, transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """(row_id, y): y = A x over rows with entries; x has (col_id, x); transform changes the entries first."""
    value = transform(F.col("val")) if transform else F.col("val")
    return nnz.join(x, "col_id").groupBy(*row_key(nnz)).agg(F.sum(value * F.col("x")).alias("y"))


def mult_transposed(nnz: DataFrame, y: DataFrame, transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """(col_id, x): x = A' y over columns with entries; y has (row_id, y)."""
    value = transform(F.col("val")) if transform else F.col("val")
    return nnz.join(y, row_key(nnz, y)).groupBy("col_id").agg(F.sum(value * F.col("y")).alias("x"))


def mult_add(nnz: DataFrame, x: DataFrame, rows: DataFrame, beta: float, alpha: float) -> DataFrame:
    """(row_id, y): beta y + alpha A x of every row in rows(row_id, y), empty ones included."""
    key = row_key(nnz, rows)
    return rows.join(mult(nnz, x).withColumnRenamed("y", "_ax"), key, "left").select(*key, (beta * F.col("y") + alpha * F.coalesce("_ax", F.lit(0.0))).alias("y"))


def mult_symmetric(lower: DataFrame, x: DataFrame) -> DataFrame:
    """Q x where only one triangle of Q is stored."""
    return mult(symmetrize(lower), x)


def mult_transposed_scaled(nnz: DataFrame, x: DataFrame, d: DataFrame) -> DataFrame:
    """A' D x: x has (row_id, y), d has (row_id, d)."""
    key = row_key(x, d)
    return mult_transposed(nnz, x.join(d, key).select(*key, (F.col("y") * F.col("d")).alias("y")))


def gram(nnz: DataFrame, d: DataFrame | None = None, inverse: bool = False) -> DataFrame:
    """(a, b, val): A' D A, upper triangle; d has (row_id, d), inverse divides by it.

    Pairs form only within a row, so the work is the sum of squared row lengths; group the
    columns first where rows are long.
    """
    key = row_key(nnz)
    left = nnz.select(*key, F.col("col_id").alias("a"), F.col("val").alias("va"))
    right = nnz.select(*key, F.col("col_id").alias("b"), F.col("val").alias("vb"))
    joined = left.join(right, key).where("a <= b")
    value = F.col("va") * F.col("vb")
    if d is not None:
        joined = joined.join(d, row_key(nnz, d))
        value = value / F.nullif(F.col("d"), F.lit(0.0)) if inverse else value * F.col("d")
    return joined.groupBy("a", "b").agg(F.sum(value).alias("val"))


def gram_pattern(nnz: DataFrame) -> DataFrame:
    """(a, b): where A' A may have entries, upper triangle."""
    key = row_key(nnz)
    left, right = nnz.select(*key, F.col("col_id").alias("a")), nnz.select(*key, F.col("col_id").alias("b"))
    return left.join(right, key).where("a <= b").select("a", "b").distinct()


def product_transposed(a: DataFrame, b: DataFrame) -> DataFrame:
    """(r, s, val): A B'."""
    return a.select("col_id", F.col("row_id").alias("r"), F.col("val").alias("va")).join(b.select("col_id", F.col("row_id").alias("s"), F.col("val").alias("vb")), "col_id").groupBy("r", "s").agg(F.sum(F.col("va") * F.col("vb")).alias("val"))


def column_scale(nnz: DataFrame, s: DataFrame) -> DataFrame:
    return nnz.join(s, "col_id").withColumn("val", F.col("val") * F.col("s")).drop("s")


def row_scale(nnz: DataFrame, s: DataFrame) -> DataFrame:
    return nnz.join(s, row_key(nnz, s)).withColumn("val", F.col("val") * F.col("s")).drop("s")


def scalar_mult(nnz: DataFrame, k: float) -> DataFrame:
    return nnz.withColumn("val", F.col("val") * k)


def transpose(nnz: DataFrame) -> DataFrame:
    return nnz.withColumnsRenamed({"row_id": "_r"}).withColumnRenamed("col_id", "row_id").withColumnRenamed("_r", "col_id")


def lower_triangle(nnz: DataFrame) -> DataFrame:
    return nnz.where("row_id >= col_id")


def symmetrize(lower: DataFrame) -> DataFrame:
    """Both triangles from one."""
    return lower.select("row_id", "col_id", "val").unionByName(lower.where("row_id <> col_id").select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "val"))


def diagonal(nnz: DataFrame) -> DataFrame:
    return nnz.where("row_id = col_id").select(F.col("row_id").alias("id"), "val")


def add_entries(nnz: DataFrame, more: DataFrame) -> DataFrame:
    """Entries added where there are some, created where there are none."""
    return nnz.select("row_id", "col_id", "val").unionByName(more.select("row_id", "col_id", "val")).groupBy("row_id", "col_id").agg(F.sum("val").alias("val"))


def put_entries(nnz: DataFrame, more: DataFrame) -> DataFrame:
    """Entries overwritten or created."""
    return nnz.select("row_id", "col_id", "val").join(more, ["row_id", "col_id"], "left_anti").unionByName(more.select("row_id", "col_id", "val"))


def clear_rows(nnz: DataFrame, rows: DataFrame) -> DataFrame:
    return nnz.join(rows, row_key(nnz, rows), "left_anti")


def clear_columns(nnz: DataFrame, cols: DataFrame) -> DataFrame:
    return nnz.join(cols, "col_id", "left_anti")


def block(nnz: DataFrame, row: int, col: int, rows: int, cols: int) -> DataFrame:
    """The rectangle from (row, col) on; its scan reads only matching entries."""
    return nnz.where(F.col("row_id").between(row, row + rows - 1) & F.col("col_id").between(col, col + cols - 1))


def append_rows(nnz: DataFrame, other: DataFrame, n_rows: int) -> DataFrame:
    """other under a matrix of n_rows rows."""
    return nnz.unionByName(other.withColumn("row_id", F.col("row_id") + n_rows))


def append_diagonal(nnz: DataFrame, d: DataFrame, n_cols: int) -> DataFrame:
    """Columns n_cols + row with d(row_id, d) on their diagonal."""
    return nnz.select("row_id", "col_id", "val").unionByName(d.select("row_id", (F.col("row_id") + n_cols).alias("col_id"), F.col("d").alias("val")))


def row_counts(nnz: DataFrame) -> DataFrame:
    return nnz.groupBy(*row_key(nnz)).agg(F.count(F.lit(1)).alias("n"))


def column_counts(nnz: DataFrame) -> DataFrame:
    return nnz.groupBy("col_id").agg(F.count(F.lit(1)).alias("n"))


def row_sums(nnz: DataFrame, transform: Callable[[Column], Column] = F.abs) -> DataFrame:
    return nnz.groupBy(*row_key(nnz)).agg(F.sum(transform(F.col("val"))).alias("total"))


def column_sums(nnz: DataFrame, transform: Callable[[Column], Column] = F.abs) -> DataFrame:
    return nnz.groupBy("col_id").agg(F.sum(transform(F.col("val"))).alias("total"))


def extremes(nnz: DataFrame, by: str, scale: DataFrame | None = None, eps: float = EPS) -> DataFrame:
    """least and most |a s| above eps of each row or column; scale has (the other id, s)."""
    v = F.abs(F.col("val") * F.col("s")) if scale is not None else F.abs("val")
    df = nnz.join(scale, "col_id" if by == "row_id" else row_key(nnz, scale)) if scale is not None else nnz
    return df.groupBy(*(row_key(nnz) if by == "row_id" else [by])).agg(F.min(F.when(v > eps, v)).alias("least"), F.max(v).alias("most"))


def rows_as_arrays(nnz: DataFrame) -> DataFrame:
    """(row_id, entries): a row as its sorted (col_id, val) pairs."""
    return nnz.groupBy(*row_key(nnz)).agg(F.array_sort(F.collect_list(F.struct("col_id", "val"))).alias("entries"))


def row_times(nnz: DataFrame, row: int, x: DataFrame) -> DataFrame:
    return mult(nnz.where(F.col("row_id") == row), x)


def axpy_row_signed(nnz: DataFrame, row: int, alpha: float) -> DataFrame:
    """(col_id, pos, neg): alpha times one row, split by sign."""
    v = alpha * F.col("val")
    return nnz.where(F.col("row_id") == row).select("col_id", F.greatest(v, F.lit(0.0)).alias("pos"), F.least(v, F.lit(0.0)).alias("neg"))


def residual_norms(nnz: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the 2- and inf-norm of A x - b; b has (row_id, b)."""
    r = b.join(mult(nnz, x), row_key(nnz, b), "left").select((F.coalesce("y", F.lit(0.0)) - F.col("b")).alias("r"))
    return r.agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("two_norm"), F.max(F.abs("r")).alias("inf_norm"))


def compact(nnz: DataFrame, by: str) -> DataFrame:
    """Rows or columns without entries dropped: their ids numbered anew from 0, as `new_id`."""
    from blockloom.operators.vector import positions

    key = row_key(nnz) if by == "row_id" else [by]
    ids = positions(nnz.select(*key).distinct(), key)
    return nnz.join(ids, key)


def sparsify(symmetric: DataFrame, threshold: float) -> DataFrame:
    """Entries at least threshold times the diagonal of their row or of their column, and the diagonal."""
    d = symmetric.where("row_id = col_id").select(F.col("row_id").alias("id"), F.abs("val").alias("d"))
    joined = symmetric.join(d.select(F.col("id").alias("row_id"), F.col("d").alias("dr")), "row_id", "left").join(d.select(F.col("id").alias("col_id"), F.col("d").alias("dc")), "col_id", "left")
    keep = (F.col("row_id") == F.col("col_id")) | (F.abs("val") >= threshold * F.least(F.coalesce("dr", F.lit(0.0)), F.coalesce("dc", F.lit(0.0))))
    return joined.where(keep).select("row_id", "col_id", "val")


def append_columns(nnz: DataFrame, other: DataFrame, n_cols: int) -> DataFrame:
    """other to the right of a matrix of n_cols columns."""
    return nnz.unionByName(other.withColumn("col_id", F.col("col_id") + n_cols))


def append_row(nnz: DataFrame, other: DataFrame, row: int, at: int) -> DataFrame:
    """Row `row` of another matrix as row `at`."""
    return nnz.unionByName(other.where(F.col("row_id") == row).withColumn("row_id", F.lit(at).cast("long")))


def append_column(nnz: DataFrame, other: DataFrame, col: int, at: int) -> DataFrame:
    """Column `col` of another matrix as column `at`."""
    return nnz.unionByName(other.where(F.col("col_id") == col).withColumn("col_id", F.lit(at).cast("long")))


def shave_left(nnz: DataFrame, n_cols: int) -> tuple[DataFrame, DataFrame]:
    """(the first n_cols columns, the others numbered from 0)."""
    return nnz.where(F.col("col_id") < n_cols), nnz.where(F.col("col_id") >= n_cols).withColumn("col_id", F.col("col_id") - n_cols)


def shave_bottom(nnz: DataFrame, n_rows: int, total_rows: int) -> tuple[DataFrame, DataFrame]:
    """(the rows above, the last n_rows of total_rows rows numbered from 0)."""
    at = total_rows - n_rows
    return nnz.where(F.col("row_id") < at), nnz.where(F.col("row_id") >= at).withColumn("row_id", F.col("row_id") - at)


def empty_ids(first: int, n: int, nnz: DataFrame, name: str = "row_id") -> DataFrame:
    """n ids from first on: rows or columns without entries exist in their own table only."""
    return nnz.sparkSession.range(first, first + n).select(F.col("id").alias(name))


def entry_count(nnz: DataFrame) -> DataFrame:
    """One row: n."""
    return nnz.agg(F.count(F.lit(1)).alias("n"))


def norms(nnz: DataFrame, tol: float = EPS) -> DataFrame:
    """One row: the greatest |a|, and the least above tol (null without one)."""
    a = F.abs("val")
    return nnz.agg(F.coalesce(F.max(a), F.lit(0.0)).alias("inf_norm"), F.min(F.when(a > tol, a)).alias("least_nonzero"))


def remove_entries(nnz: DataFrame, entries: DataFrame) -> DataFrame:
    """Without the entries at (row_id, col_id)."""
    return nnz.join(entries.select(*row_key(nnz, entries), "col_id"), [*row_key(nnz, entries), "col_id"], "left_anti")


def diagonal_constant(nnz: DataFrame, first: int, length: int, value: float, add: bool = False) -> DataFrame:
    """The diagonal from `first` on set to a value, or raised by it; created where it is absent."""
    more = nnz.sparkSession.range(first, first + length).select(F.col("id").alias("row_id"), F.col("id").alias("col_id"), F.lit(float(value)).alias("val"))
    return add_entries(nnz, more) if add else put_entries(nnz, more)


def dense(nnz: DataFrame, row: int, col: int, rows: int, cols: int) -> DataFrame:
    """(row_id, c0, c1, ...): a small rectangle with zeros written out, rows without entries left out."""
    part = block(nnz, row, col, rows, cols)
    return part.groupBy("row_id").agg(*(F.coalesce(F.sum(F.when(F.col("col_id") == col + k, F.col("val"))), F.lit(0.0)).alias(f"c{k}") for k in range(cols)))


def product(a: DataFrame, b: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(row_id, col_id, val): alpha A B."""
    left = a.select("row_id", F.col("col_id").alias("_k"), F.col("val").alias("_a"))
    right = b.select(F.col("row_id").alias("_k"), "col_id", F.col("val").alias("_b"))
    return left.join(right, "_k").groupBy("row_id", "col_id").agg((alpha * F.sum(F.col("_a") * F.col("_b"))).alias("val"))


def combine(a: DataFrame, alpha: float, b: DataFrame, beta: float) -> DataFrame:
    """(row_id, col_id, val): alpha A + beta B."""
    return add_entries(scalar_mult(a, alpha), scalar_mult(b, beta))


def outer(x: DataFrame, alpha: float) -> DataFrame:
    """(row_id, col_id, val): alpha x x' for a short sparse x (id, v); its square is the size of the result."""
    one = F.lit(0).cast("long")
    return product(x.select(F.col("id").alias("row_id"), one.alias("col_id"), F.col("v").alias("val")), x.select(one.alias("row_id"), F.col("id").alias("col_id"), F.col("v").alias("val")), alpha)


def rank_update(c: DataFrame, beta: float, u: DataFrame, alpha: float, transposed: bool = False) -> DataFrame:
    """(row_id, col_id, val), lower triangle: beta C + alpha U U', or with U' U where transposed."""
    pairs = gram(u if transposed else transpose(u))
    lower = pairs.select(F.col("b").alias("row_id"), F.col("a").alias("col_id"), (alpha * F.col("val")).alias("val"))
    return add_entries(scalar_mult(lower_triangle(c).select("row_id", "col_id", "val"), beta), lower)


def axpy_row(v: DataFrame, nnz: DataFrame, row: int, alpha: float) -> DataFrame:
    """(col_id, x): v + alpha times one row; v has (col_id, x)."""
    r = nnz.where(F.col("row_id") == row).groupBy("col_id").agg(F.sum("val").alias("_a"))
    return v.join(r, "col_id", "left").select("col_id", (F.col("x") + alpha * F.coalesce("_a", F.lit(0.0))).alias("x"))


def axpy_column(v: DataFrame, nnz: DataFrame, col: int, alpha: float) -> DataFrame:
    """(row_id, y): v + alpha times one column; v has (row_id, y)."""
    key = row_key(nnz, v)
    c = nnz.where(F.col("col_id") == col).groupBy(*key).agg(F.sum("val").alias("_a"))
    return v.join(c, key, "left").select(*key, (F.col("y") + alpha * F.coalesce("_a", F.lit(0.0))).alias("y"))


def column_times(nnz: DataFrame, col: int, y: DataFrame) -> DataFrame:
    """One row (col_id, x): one column times y (row_id, y)."""
    return mult_transposed(nnz.where(F.col("col_id") == col), y)


def entry(nnz: DataFrame, row: int, col: int) -> DataFrame:
    """One row: val at (row, col), 0 where nothing stands."""
    return nnz.where((F.col("row_id") == row) & (F.col("col_id") == col)).agg(F.coalesce(F.sum("val"), F.lit(0.0)).alias("val"))


def symmetric_scale(nnz: DataFrame, s: DataFrame) -> DataFrame:
    """S A S; s has (id, s)."""
    return column_scale(nnz.join(s.withColumnRenamed("id", "row_id"), "row_id").withColumn("val", F.col("val") * F.col("s")).drop("s"), s.withColumnRenamed("id", "col_id"))


def least_and_most_owner(values: DataFrame) -> DataFrame:
    """id, least, least_owner, most, most_owner of values (id, owner, v): per position the best value and who has it; of equal ones the least owner."""
    low, high = F.min(F.struct("v", "owner")), F.min(F.struct((-F.col("v")).alias("v"), F.col("owner")))
    return values.groupBy("id").agg(low.alias("l"), high.alias("h")).select("id", F.col("l.v").alias("least"), F.col("l.owner").alias("least_owner"), (-F.col("h.v")).alias("most"), F.col("h.owner").alias("most_owner"))
