"""Problems from CSV files and from a Python data source, their order by stage, and solutions written by name."""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from blockloom.operators.iterate import Iterate, row_values
from blockloom.operators.vector import positions
from blockloom.plans.lp import COLS, NNZ, ROWS, Problem

SCHEMAS = {"cols": COLS, "rows": ROWS, "nnz": NNZ}


def read_csv(spark: SparkSession, folder: str) -> Problem:
    """cols.csv, rows.csv and nnz.csv with a header row; an empty field is a missing bound."""
    return Problem(*(spark.read.csv(f"{folder}/{t}.csv", header=True, schema=s, mode="FAILFAST") for t, s in SCHEMAS.items()))


def read_series(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """keys, series, value: a CSV file of one column a series, each number a row of its own."""
    wide = spark.read.csv(path, header=True)
    series = [c for c in wide.columns if c not in keys]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("series"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in series)))
    return wide.select(*keys, pairs.alias("_p")).select(*keys, "_p.series", "_p.value")


def read_instances(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a white-space table without header; lines that begin with # are comments."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    fields = F.split(F.trim("value"), r"\s+")
    return lines.select(*(F.try_element_at(fields, F.lit(k + 1)).alias(c) for k, c in enumerate(columns)))


class _Block(InputPartition):
    def __init__(self, block: int):
        self.block = block


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.blocks, self.table = int(options["blocks"]), options["table"]
        self.module, self.function = options["callback"].split(":")

    def partitions(self) -> list[InputPartition]:
        return [_Block(b) for b in range(self.blocks)]

    def read(self, partition: _Block) -> Iterator[tuple]:
        yield from getattr(import_module(self.module), self.function)(self.table, partition.block)


class BlockSource(DataSource):
    """spark.read.format("blocks") with options blocks, table (cols, rows or nnz) and callback (module:function).

    The function takes (table, block) and yields the block's rows; it is called on the executors,
    one block a partition, and called again where an executor is lost.
    """

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return SCHEMAS[self.options["table"]]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def from_callback(spark: SparkSession, blocks: int, callback: str) -> Problem:
    """A problem from module:function; see BlockSource."""
    spark.dataSource.register(BlockSource)
    return Problem(*(spark.read.format("blocks").options(blocks=blocks, table=t, callback=callback).load() for t in SCHEMAS))


def column_order(cols: DataFrame, blocks: int | None = None) -> DataFrame:
    """col_id, block, position: the root's columns first, then block by block.  With blocks, columns of other blocks are an error."""
    if blocks is not None and cols.where((F.col("block") < 0) | (F.col("block") >= blocks)).limit(1).count():
        raise ValueError("a column of a block that does not exist")
    return positions(cols.select("col_id", "block"), ["block", "col_id"], "position")


def row_order(rows: DataFrame, linking: int) -> DataFrame:
    """system, row_id, kind, position: within each kind, local_eq, local_ineq, link_eq and link_ineq, by id from 0.

    Rows of block `linking` link.  Each kind is numbered on its own, its sort dealt into ranges.
    """
    kind = F.concat(F.when(F.col("block") == linking, "link_").otherwise("local_"), F.lower("system"))
    named = rows.select("system", "row_id", kind.alias("kind"))
    placed = positions(named, ["kind", "row_id"], "_all")
    first = placed.groupBy("kind").agg(F.min("_all").alias("_first"))  # four rows
    return placed.join(F.broadcast(first), "kind").select("system", "row_id", "kind", (F.col("_all") - F.col("_first")).alias("position"))


def squeezed(p: Problem, block: int) -> Problem:
    """One block on its own: its rows, and of the columns those that these touch, numbered from 0 in order of their ids."""
    nnz = p.nnz.where(F.col("row_block") == block)
    ids = positions(nnz.select("col_id").distinct(), ["col_id"], "_new")
    cols = p.cols.join(ids, "col_id").withColumn("col_id", F.col("_new")).select(*p.cols.columns)
    return p.with_(cols=cols, rows=p.rows.where(F.col("block") == block), nnz=nnz.join(ids, "col_id").withColumn("col_id", F.col("_new")).select(*p.nnz.columns))


def entries_by_matrix(p: Problem, q: DataFrame | None = None) -> DataFrame:
    """One row: entries of Q, of the equalities and of the inequalities."""
    n = p.nnz.agg(F.count_if(F.col("system") == "EQ").alias("equalities"), F.count_if(F.col("system") == "INEQ").alias("inequalities"))
    quadratic = q.agg(F.count(F.lit(1)).alias("q")) if q is not None else None
    return n.withColumn("q", F.lit(0).cast("long")).select("q", *n.columns) if quadratic is None else quadratic.crossJoin(n)  # single rows


def empty_local_rows(p: Problem) -> DataFrame:
    """system, row_id of rows without an entry in a column of their own block."""
    own = p.nnz.where("row_block = col_block").select("system", "row_id").distinct()
    return p.rows.select("system", "row_id").join(own, ["system", "row_id"], "left_anti")


def globals_first(links: DataFrame, many: int = 2) -> DataFrame:
    """col_id, position: columns of more than `many` blocks first, those of none last, by id within; links has (col_id, n_blocks)."""
    rank = F.when(F.col("n_blocks") > many, 0).when(F.col("n_blocks") > 0, 1).otherwise(2)
    return positions(links.select("col_id", "n_blocks").withColumn("_rank", rank), ["_rank", "col_id"], "position").select("col_id", "position")


def equations(p: Problem, it: Iterate) -> DataFrame:
    """system, row_id, level, marginal, lo, hi: one table of both systems' rows with values and duals."""
    return p.rows.join(row_values(p, it.cols), ["system", "row_id"]).join(it.rows.select("system", "row_id", "y"), ["system", "row_id"]).select("system", "row_id", F.col("value").alias("level"), F.col("y").alias("marginal"), "lo", "hi")


def write_solution(p: Problem, it: Iterate, status: str, path: str) -> None:
    """Variables (with marginals gamma - phi) and equations as Parquet below a new path; only of an optimal solution."""
    if status != "optimal":
        raise ValueError(f"the solution is not written: {status}")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    it.cols.select("col_id", F.col("x").alias("level"), (zero("gamma") - zero("phi")).alias("marginal")).write.parquet(f"{path}/variables")
    equations(p, it).write.parquet(f"{path}/equations")


def vector_lines(v: DataFrame, ident: str, value: str, offset: int = 0) -> DataFrame:
    """line: `id value` after so many spaces, for printing or write.text."""
    return v.select(F.concat(F.lit(" " * offset), F.col(ident).cast("string"), F.lit(" "), F.coalesce(F.col(value).cast("string"), F.lit("none"))).alias("line"))
