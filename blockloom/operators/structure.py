"""Block structure: which rows and columns link blocks, and how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.matrix import row_key
from blockloom.operators.vector import positions


def row_links(nnz: DataFrame) -> DataFrame:
    """row_id, n_blocks, first_block, last_block, kind, start_block.

    A row of one block is local, of a block and the next one a 2-link that starts at the first,
    of more blocks global.
    """
    g = nnz.groupBy(*row_key(nnz)).agg(F.countDistinct("col_block").alias("n_blocks"), F.min("col_block").alias("first_block"), F.max("col_block").alias("last_block"))
    two = (F.col("n_blocks") == 2) & (F.col("last_block") == F.col("first_block") + 1)
    return g.withColumns({"kind": F.when(F.col("n_blocks") == 1, "local").when(two, "two_link").otherwise("global"), "start_block": F.when(two, F.col("first_block")).otherwise(-1)})


def column_links(nnz: DataFrame) -> DataFrame:
    """col_id, n_blocks: row blocks that touch each column."""
    return nnz.groupBy("col_id").agg(F.countDistinct("row_block").alias("n_blocks"))


def histogram(links: DataFrame) -> DataFrame:
    return links.groupBy("n_blocks").agg(F.count(F.lit(1)).alias("n"))


def two_links_per_block(links: DataFrame) -> DataFrame:
    return links.where("start_block >= 0").groupBy("start_block").agg(F.count(F.lit(1)).alias("n"))


def two_links_between(links: DataFrame, subtree: DataFrame) -> DataFrame:
    """2-links by the subtrees of their two blocks; subtree has (block, subtree)."""
    a = subtree.select(F.col("block").alias("start_block"), F.col("subtree").alias("first_subtree"))
    b = subtree.select((F.col("block") - 1).alias("start_block"), F.col("subtree").alias("second_subtree"))
    return links.where("start_block >= 0").join(a, "start_block").join(b, "start_block").groupBy("first_subtree", "second_subtree").agg(F.count(F.lit(1)).alias("n"))


def subtree_map(blocks: int, subtrees: int):
    """Blocks to subtrees: even contiguous parts whose sizes differ by one at most, spaced out."""
    return [b * subtrees // blocks for b in range(blocks)]


def link_order(links: DataFrame) -> DataFrame:
    """Rows with `position`: local ones, 2-links by start block, globals last; by id within."""
    rank = F.when(F.col("kind") == "local", F.lit(0)).when(F.col("kind") == "two_link", 1 + F.col("start_block")).otherwise(F.lit(1_000_000))
    return positions(links.withColumn("_rank", rank), ["_rank", "row_id", *row_key(links)[:-1]], "position").drop("_rank")


def order_after_split(block_subtree: list[int], start_block: list[int], kept: int) -> list[int]:
    """New order of 2-link rows after a split: own rows of the top last, rows inside a subtree first.

    block_subtree maps blocks to subtrees; a row whose two blocks lie in one subtree goes down
    to it, unless it is not a 2-link (-1); `kept` rows stay above.
    """
    inside = lambda b: b >= 0 and block_subtree[b] == block_subtree[min(b + 1, len(block_subtree) - 1)]  # noqa: E731  one of the last block ends in it
    down = [k for k, b in enumerate(start_block) if inside(b)]
    up = [k for k, b in enumerate(start_block) if not inside(b)]
    if len(up) != kept:
        raise ValueError(f"{len(up)} rows stay above, not {kept}")
    return down + up


def row_stages(nnz: DataFrame, last_stage: int) -> DataFrame:
    """row_id, least, most, verdict: a row may touch the root and one block, or else must link."""
    child = F.when(F.col("col_block") > 0, F.col("col_block"))
    g = nnz.groupBy(*row_key(nnz)).agg(F.coalesce(F.min(child), F.lit(0)).alias("least"), F.coalesce(F.max(child), F.lit(0)).alias("most"), F.first("row_block").alias("stage"))
    wanted = F.when(F.col("most") == 0, F.lit(0)).when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.lit(last_stage))
    return g.withColumn("verdict", F.when(F.col("stage") == wanted, "ok").otherwise("misplaced"))


def schur_pattern(nnz: DataFrame) -> DataFrame:
    """(a, b): pairs of linking columns, a <= b, that some block's rows join."""
    linking = column_links(nnz).where("n_blocks > 1").select("col_id")
    touched = nnz.join(linking, "col_id").select("row_block", "col_id").distinct()
    a, b = touched.select("row_block", F.col("col_id").alias("a")), touched.select("row_block", F.col("col_id").alias("b"))
    return a.join(b, "row_block").where("a <= b").select("a", "b").distinct()


def block_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("block").agg(F.count(F.lit(1)).alias("n"))


def linking_first_order(links: DataFrame) -> DataFrame:
    """Columns with `position`: local ones, those of two blocks, those of more last; by id within. links has (col_id, n_blocks)."""
    rank = F.when(F.col("n_blocks") <= 1, 0).when(F.col("n_blocks") == 2, 1).otherwise(2)
    return positions(links.withColumn("_rank", rank), ["_rank", "col_id"], "position").drop("_rank")


def reclassified(links: DataFrame, single: DataFrame) -> DataFrame:
    """Links after columns of `single` (col_id) count as linking nothing; both of column_links."""
    return links.join(single.select("col_id", F.lit(0).cast("long").alias("_n")), "col_id", "left").select("col_id", F.coalesce("_n", "n_blocks").alias("n_blocks"))


def schur_pattern_of(nnz: DataFrame, first_block: int, last_block: int) -> DataFrame:
    """schur_pattern with the pairs that row blocks first_block..last_block join only."""
    linking = column_links(nnz).where("n_blocks > 1").select("col_id")
    touched = nnz.where(F.col("row_block").between(first_block, last_block)).join(linking, "col_id").select("row_block", "col_id").distinct()
    a, b = touched.select("row_block", F.col("col_id").alias("a")), touched.select("row_block", F.col("col_id").alias("b"))
    return a.join(b, "row_block").where("a <= b").select("a", "b").distinct()


def schur_most_entries(nnz: DataFrame) -> DataFrame:
    """One row: n, an upper bound of the Schur complement's upper triangle: k (k + 1) / 2 summed over the blocks' linking columns."""
    linking = column_links(nnz).where("n_blocks > 1").select("col_id")
    per = nnz.join(linking, "col_id").groupBy("row_block").agg(F.countDistinct("col_id").alias("k"))
    return per.agg(F.coalesce(F.sum((F.col("k") * (F.col("k") + 1) / 2).cast("long")), F.lit(0)).alias("n"))


def with_subtree(df: DataFrame, subtrees: list[int], block: str = "block", name: str = "subtree") -> DataFrame:
    """The table with each block's subtree; a block beyond the map is in none."""
    tree = df.sparkSession.createDataFrame(list(enumerate(subtrees)), f"{block} int, {name} int")
    return df.join(F.broadcast(tree), block, "left")  # as many rows as blocks


def two_links_by_side(links: DataFrame, subtrees: list[int]) -> DataFrame:
    """subtree, inside, leaving: 2-links that start in the subtree and end in it or in another one."""
    own = with_subtree(links.where("start_block >= 0"), subtrees, "start_block", "subtree")
    both = with_subtree(own.withColumn("_next", (F.col("start_block") + 1).cast("int")), subtrees, "_next", "_to")
    stays = F.coalesce(F.col("_to") == F.col("subtree"), F.lit(True))  # one that starts in the last block ends there
    return both.groupBy("subtree").agg(F.count_if(stays).alias("inside"), F.count_if(~stays).alias("leaving"))


def split_sizes(block_sizes: DataFrame, links: DataFrame, subtrees: list[int]) -> DataFrame:
    """subtree, blocks, n, own_links: sizes after a split; 2-links inside a subtree become its own."""
    sizes = with_subtree(block_sizes, subtrees).groupBy("subtree").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n"))
    return sizes.join(two_links_by_side(links, subtrees).select("subtree", F.col("inside").alias("own_links")), "subtree", "left").fillna({"own_links": 0})


def shave_border(nnz: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inner, border): the border has the entries of rows and columns that link more than two blocks."""
    rows = row_links(nnz).where("kind = 'global'").select(*row_key(nnz), F.lit(True).alias("_r"))
    cols = column_links(nnz).where("n_blocks > 2").select("col_id", F.lit(True).alias("_c"))
    marked = nnz.join(rows, row_key(nnz), "left").join(cols, "col_id", "left").withColumn("_b", F.coalesce("_r", "_c", F.lit(False)))
    return marked.where("NOT _b").select(*nnz.columns), marked.where("_b").select(*nnz.columns)


def raise_border(inner: DataFrame, border: DataFrame) -> DataFrame:
    """shave_border undone."""
    return inner.unionByName(border)


def layers(blocks: int, depth: int) -> list[list[int]]:
    """Of each layer from the root down, every block's subtree: depth layers whose widths grow evenly in ratio."""
    widths = [max(1, round(blocks ** ((k + 1) / (depth + 1)))) for k in range(depth)]
    return [subtree_map(blocks, w) for w in widths]


def collapse(df: DataFrame, names: list[str]) -> DataFrame:
    """A split table without its subtree columns."""
    return df.drop(*names)
