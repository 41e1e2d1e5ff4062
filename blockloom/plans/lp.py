"""The canonical problem: columns, rows and nonzeros, and its adapter from the order tables.

    cols(col_id, block, cost, lb, ub)     a missing bound is null
    rows(system, row_id, block, lo, hi)   EQ: lo = hi
    nnz(system, row_id, col_id, val, row_block, col_block)
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLS = "col_id LONG, block INT, cost DOUBLE, lb DOUBLE, ub DOUBLE"
ROWS = "system STRING, row_id LONG, block INT, lo DOUBLE, hi DOUBLE"
NNZ = "system STRING, row_id LONG, col_id LONG, val DOUBLE, row_block INT, col_block INT"


@dataclass(frozen=True)
class Problem:
    cols: DataFrame
    rows: DataFrame
    nnz: DataFrame
    offset: float = 0.0

    def with_(self, **changes) -> Problem:
        return replace(self, **changes)

    def system(self, name: str) -> Problem:
        """Only the rows of EQ or of INEQ."""
        return replace(self, rows=self.rows.where(F.col("system") == name), nnz=self.nnz.where(F.col("system") == name))


def read(spark: SparkSession, path: str) -> Problem:
    """A problem written by write(): one Parquet folder per table."""
    return Problem(*(spark.read.parquet(f"{path}/{t}") for t in ("cols", "rows", "nnz")))


def write(p: Problem, path: str) -> None:
    """The tables as Parquet; nonzeros by row block, so one block is one folder."""
    p.cols.write.parquet(f"{path}/cols")
    p.rows.write.parquet(f"{path}/rows")
    p.nnz.write.partitionBy("row_block").parquet(f"{path}/nnz")


def read_block(p: Problem, block: int) -> Problem:
    """The rows of one block with their nonzeros; on a written problem the scan prunes to its folder."""
    return p.with_(rows=p.rows.where(F.col("block") == block), nnz=p.nnz.where(F.col("row_block") == block))


def from_orders(spark: SparkSession, sf_dir: str) -> Problem:
    """Orders as <= rows, parts as columns, summed quantities as nonzeros.

    Parts whose size divides by 7 have no upper bound; blocks are supplier keys modulo 8 for
    rows and brands' order for columns.
    """
    read_table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    size = F.col("p_size").cast("double")
    cols = read_table("part").select(F.col("p_partkey").alias("col_id"), (F.col("p_partkey") % 8).cast("int").alias("block"), F.col("p_retailprice").alias("cost"), F.lit(0.0).alias("lb"), F.when(F.col("p_size") % 7 != 0, size).alias("ub"))
    rows = read_table("orders").select(F.lit("INEQ").alias("system"), F.col("o_orderkey").alias("row_id"), (F.col("o_orderkey") % 8).cast("int").alias("block"), F.lit(None).cast("double").alias("lo"), F.col("o_totalprice").alias("hi"))
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    summed = read_table("lineitem").groupBy(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id")).agg(F.sum(signed).alias("val"))
    nnz = summed.where("val <> 0").select(F.lit("INEQ").alias("system"), "row_id", "col_id", "val", (F.col("row_id") % 8).cast("int").alias("row_block"), (F.col("col_id") % 8).cast("int").alias("col_block"))
    return Problem(cols, rows, nnz)


#: The same tables in SQL, for checking.
SQL = """
WITH cols AS (
  SELECT p_partkey AS col_id, CAST(p_partkey % 8 AS INTEGER) AS block, p_retailprice AS cost, CAST(0 AS DOUBLE) AS lb,
    CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS ub FROM part
), "rows" AS (
  SELECT 'INEQ' AS system, o_orderkey AS row_id, CAST(o_orderkey % 8 AS INTEGER) AS block, CAST(NULL AS DOUBLE) AS lo, o_totalprice AS hi FROM orders
), nnz AS (
  SELECT 'INEQ' AS system, row_id, col_id, val, CAST(row_id % 8 AS INTEGER) AS row_block, CAST(col_id % 8 AS INTEGER) AS col_block
  FROM (
    SELECT l_orderkey AS row_id, l_partkey AS col_id, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS val
    FROM lineitem GROUP BY 1, 2
  ) WHERE val <> 0
)
"""


def from_orders_mixed(spark: SparkSession, sf_dir: str) -> Problem:
    """The same columns, but orders of even key as equalities and those of odd key as inequalities.

    Either system numbers its rows by half the key, so ids of the two overlap.  Inequalities
    whose id divides by 3 also have a lower side, a tenth of the upper one.
    """
    p = from_orders(spark, sf_dir)
    system = F.when(F.col("row_id") % 2 == 0, "EQ").otherwise("INEQ")
    half = F.floor(F.col("row_id") / 2)
    rows = p.rows.select(system.alias("system"), half.alias("row_id"), "block", "hi")
    low = F.when(F.col("system") == "EQ", F.col("hi")).when(F.col("row_id") % 3 == 0, F.col("hi") / 10)
    nnz = p.nnz.select(system.alias("system"), half.alias("row_id"), "col_id", "val", "row_block", "col_block")
    return p.with_(rows=rows.select("system", "row_id", "block", low.alias("lo"), "hi"), nnz=nnz)


#: The mixed problem in SQL, after the tables of SQL.
SQL_MIXED = SQL.replace('"rows" AS', "one_rows AS").replace("nnz AS", "one_nnz AS") + """, "rows" AS (
  SELECT CASE WHEN row_id % 2 = 0 THEN 'EQ' ELSE 'INEQ' END AS system, row_id // 2 AS row_id, block,
    CASE WHEN row_id % 2 = 0 THEN hi WHEN (row_id // 2) % 3 = 0 THEN hi / 10 END AS lo, hi FROM one_rows
), nnz AS (
  SELECT CASE WHEN row_id % 2 = 0 THEN 'EQ' ELSE 'INEQ' END AS system, row_id // 2 AS row_id, col_id, val, row_block, col_block FROM one_nnz
)
"""
