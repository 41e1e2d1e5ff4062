"""MPS files, fixed or free, read as DataFrames and written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.plans.lp import Problem

# The sections of a file.
SECTIONS = ("NAME", "OBJSENSE", "ROWS", "COLUMNS", "RHS", "RANGES", "BOUNDS", "QUADOBJ", "QMATRIX", "ENDATA")


class MpsError(ValueError):
    """The file contradicts itself."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line, section, fields: data lines with the section they stand in; comments and blank lines are left out.

    A file is read as one text, so its lines keep their numbers.
    """
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    kept = raw.where((F.trim("text") != "") & ~F.col("text").startswith("*"))
    first = F.upper(F.split(F.trim("text"), r"\s+")[0])
    head = ~F.col("text").startswith(" ") & ~F.col("text").startswith("\t") & first.isin(*SECTIONS)
    marked = kept.withColumn("head", F.when(head, first))
    filled = marked.withColumn("section", F.last("head", ignorenulls=True).over(Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    return filled.where("head IS NULL").select("line", "section", F.split(F.trim("text"), r"\s+").alias("fields"))


def _pairs(data: DataFrame, skip: int) -> DataFrame:
    """line, set, name, value: the one or two (name, value) pairs after the first fields."""
    f = F.col("fields")
    first = F.when(F.size(f) % 2 == skip % 2, f[0]).otherwise(F.lit(""))
    start = F.when(F.size(f) % 2 == skip % 2, F.lit(skip)).otherwise(F.lit(skip - 1))
    rest = F.slice(f, start + 1, F.greatest(F.size(f) - start, F.lit(0)))
    at = F.explode(F.sequence(F.lit(0), F.size("rest") - 1, F.lit(2)))
    return data.select("line", first.alias("set"), rest.alias("rest")).where(F.size("rest") >= 2).withColumn("k", at).select("line", "set", F.col("rest")[F.col("k")].alias("name"), F.col("rest")[F.col("k") + 1].try_cast("double").alias("value"))


def read(spark: SparkSession, path: str, linear: bool = True) -> tuple[Problem, DataFrame, DataFrame]:
    """(problem, row names, column names) of a file; every row and column is in block 0.

    With linear a file with a quadratic objective is refused; quadratic() reads that part.

    The first N row is the objective.  Of right-hand sides, ranges and bounds the first set
    counts.  A side of the objective row is a constant taken off; a maximisation is turned
    round.  Rows without a range have one side; bounds are 0 and none unless they are given.
    """
    data = lines(spark, path).cache()
    f = F.col("fields")
    if linear and data.where("section IN ('QUADOBJ', 'QMATRIX')").limit(1).count():
        raise MpsError("the objective is quadratic")
    rows = data.where("section = 'ROWS'").select("line", F.upper(f[0]).alias("sense"), f[1].alias("name"))
    if rows.groupBy("name").count().where("count > 1").limit(1).count():
        raise MpsError("a row name occurs twice")
    objective = rows.where("sense = 'N'").orderBy("line").limit(1).first()
    objective = objective["name"] if objective else ""
    named = rows.where("sense <> 'N'").withColumn("system", F.when(F.col("sense") == "E", "EQ").otherwise("INEQ"))
    named = named.withColumn("row_id", (F.row_number().over(Window.partitionBy("system").orderBy("line")) - 1).cast("long"))
    sense = data.where("section = 'OBJSENSE'").select(F.upper(f[0]).alias("s")).first()
    sign = -1.0 if sense and sense["s"].startswith("MAX") else 1.0

    columns = data.where("section = 'COLUMNS'").where(~F.array_contains(f, "'MARKER'"))
    entries = columns.select("line", f[0].alias("col"), F.slice(f, F.lit(2), F.size(f)).alias("rest")).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("rest") - 2, F.lit(2)))).select("line", "col", F.col("rest")[F.col("k")].alias("name"), F.col("rest")[F.col("k") + 1].cast("double").alias("val"))
    order = entries.groupBy("col").agg(F.min("line").alias("line"))
    col_names = order.select("col", (F.row_number().over(Window.orderBy("line")) - 1).cast("long").alias("col_id"))
    first_set = lambda df: df.withColumn("_s", F.first("set").over(Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))).where("set = _s")
    rhs = first_set(_pairs(data.where("section = 'RHS'"), 1))
    if rhs.groupBy("name").count().where("count > 1").limit(1).count():
        raise MpsError("a row has two right-hand sides")
    ranges = first_set(_pairs(data.where("section = 'RANGES'"), 1)).select("name", F.col("value").alias("r"))
    b = F.coalesce("value", F.lit(0.0))
    sided = named.join(rhs.select("name", "value"), "name", "left").join(ranges, "name", "left")
    lo = F.when(F.col("sense") == "G", b).when((F.col("sense") == "L") & F.col("r").isNotNull(), b - F.abs("r")).when(F.col("sense") == "E", F.when(F.col("r") < 0, b + F.col("r")).otherwise(b))
    hi = F.when(F.col("sense") == "L", b).when((F.col("sense") == "G") & F.col("r").isNotNull(), b + F.abs("r")).when(F.col("sense") == "E", F.when(F.col("r") > 0, b + F.col("r")).otherwise(b))
    problem_rows = sided.select("system", "row_id", F.lit(0).alias("block"), lo.alias("lo"), hi.alias("hi"))
    nnz = entries.join(named.select("name", "system", "row_id"), "name").join(col_names, "col").where("val <> 0").select("system", "row_id", "col_id", "val", F.lit(0).alias("row_block"), F.lit(0).alias("col_block"))
    cost = entries.where(F.col("name") == objective).groupBy("col").agg((F.sum("val") * sign).alias("cost"))

    bounds = data.where("section = 'BOUNDS'").select("line", F.upper(f[0]).alias("code"), f)
    bare = F.col("code").isin("FR", "MI", "PL", "BV")
    with_set = F.when(bare, F.size("fields") >= 3).otherwise(F.size("fields") >= 4)
    bounds = bounds.select("line", "code", F.when(with_set, F.col("fields")[1]).otherwise("").alias("set"), F.when(with_set, F.col("fields")[2]).otherwise(F.col("fields")[1]).alias("col"), F.when(bare, None).when(with_set, F.try_element_at("fields", F.lit(4))).otherwise(F.try_element_at("fields", F.lit(3))).cast("double").alias("value"))
    bounds = first_set(bounds)
    lower, upper = F.col("code").isin("LO", "FX", "FR", "MI", "BV"), F.col("code").isin("UP", "FX", "FR", "PL", "BV")
    if bounds.groupBy("col").agg(F.count_if(lower).alias("l"), F.count_if(upper).alias("u")).where("l > 1 OR u > 1").limit(1).count():
        raise MpsError("a column's bound is given twice")
    low = F.when(F.col("code") == "BV", 0.0).otherwise(F.col("value"))
    high = F.when(F.col("code") == "BV", 1.0).otherwise(F.col("value"))
    given = bounds.groupBy("col").agg(F.max(F.when(lower, True)).alias("has_l"), F.max(F.when(lower, low)).alias("l"), F.max(F.when(upper, True)).alias("has_u"), F.max(F.when(upper, high)).alias("u"))
    cols = col_names.join(cost, "col", "left").join(given, "col", "left").select("col_id", F.lit(0).alias("block"), F.coalesce("cost", F.lit(0.0)).alias("cost"), F.when(F.col("has_l"), F.col("l")).otherwise(F.lit(0.0)).alias("lb"), F.when(F.col("has_u"), F.col("u")).alias("ub"))
    if cols.where("lb > ub").limit(1).count():
        raise MpsError("a lower bound above its upper bound")
    constant = rhs.where(F.col("name") == objective).agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]
    return Problem(cols, problem_rows, nnz, -constant * sign), named.select("system", "row_id", "name"), col_names


def quadratic(spark: SparkSession, path: str, col_names: DataFrame) -> DataFrame:
    """(row_id, col_id, val): the lower triangle of Q in c'x + x'Qx / 2; col_names has col and col_id.

    QUADOBJ lines give one triangle, QMATRIX lines both; an entry given twice is an error.
    """
    f = F.col("fields")
    q = lines(spark, path).where("section IN ('QUADOBJ', 'QMATRIX')").select(f[0].alias("a"), f[1].alias("b"), f[2].cast("double").alias("val"), "section")
    named = q.join(col_names.select(F.col("col").alias("a"), F.col("col_id").alias("i")), "a").join(col_names.select(F.col("col").alias("b"), F.col("col_id").alias("j")), "b")
    kept = named.where("section = 'QUADOBJ' OR i >= j").select(F.greatest("i", "j").alias("row_id"), F.least("i", "j").alias("col_id"), "val")
    if kept.groupBy("row_id", "col_id").count().where("count > 1").limit(1).count():
        raise MpsError("an entry of the quadratic objective is given twice")
    return kept


def solution(values: DataFrame, names: DataFrame, value: str = "x") -> DataFrame:
    """line: name and value of every named row or column, for write.text(); values and names share an id column."""
    key = [c for c in names.columns if c in values.columns]
    name = next(c for c in names.columns if c not in key)
    return names.join(values, key, "left").select(F.concat_ws(" ", F.col(name), F.coalesce(F.col(value).cast("string"), F.lit("unset"))).alias("line"))


def text(p: Problem, name: str = "problem") -> DataFrame:
    """rank, line: the problem as lines of a free-format file, in order of rank."""
    row = F.concat(F.when(F.col("system") == "EQ", "e").otherwise("i"), F.col("row_id").cast("string"))
    col = F.concat(F.lit("x"), F.col("col_id").cast("string"))
    spark = p.cols.sparkSession
    num = lambda c: F.col(c).cast("string")
    sense = F.when(F.col("system") == "EQ", "E").when(F.col("hi").isNotNull(), "L").otherwise("G")
    side = F.when(F.col("hi").isNotNull() & (F.col("system") != "EQ"), F.col("hi")).otherwise(F.col("lo"))
    parts = [
        spark.createDataFrame([(0, 0, 0, f"NAME {name}"), (1, 0, 0, "ROWS"), (2, 0, 0, " N obj"), (4, 0, 0, "COLUMNS"), (7, 0, 0, "RHS"), (9, 0, 0, "RANGES"), (11, 0, 0, "BOUNDS"), (14, 0, 0, "ENDATA")], "rank int, a long, b long, line string"),
        p.rows.select(F.lit(3), "row_id", F.lit(0), F.concat(F.lit(" "), sense, F.lit(" "), row)),
        p.cols.select(F.lit(5), "col_id", F.lit(-1), F.concat(F.lit(" "), col, F.lit(" obj "), num("cost"))),
        p.nnz.select(F.lit(5), "col_id", "row_id", F.concat(F.lit(" "), col, F.lit(" "), row, F.lit(" "), num("val"))),
        p.rows.where(side.isNotNull()).select(F.lit(8), "row_id", F.lit(0), F.concat(F.lit(" rhs "), row, F.lit(" "), side.cast("string"))),
        p.rows.where("system = 'INEQ' AND lo IS NOT NULL AND hi IS NOT NULL").select(F.lit(10), "row_id", F.lit(0), F.concat(F.lit(" rng "), row, F.lit(" "), (F.col("hi") - F.col("lo")).cast("string"))),
        p.cols.where("lb IS NULL").select(F.lit(12), "col_id", F.lit(0), F.concat(F.lit(" MI bnd "), col)),
        p.cols.where("lb <> 0").select(F.lit(12), "col_id", F.lit(0), F.concat(F.lit(" LO bnd "), col, F.lit(" "), num("lb"))),
        p.cols.where("ub IS NOT NULL").select(F.lit(13), "col_id", F.lit(0), F.concat(F.lit(" UP bnd "), col, F.lit(" "), num("ub"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.orderBy("rank", "a", "b").select("rank", "line")
