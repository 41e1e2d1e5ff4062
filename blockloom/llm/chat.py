"""Chat formatting: of logged snapshots of a conversation, only the longest is rendered.

Each turn adds a hash of its place and content to its conversation's rolling prefix hash, so
two conversations agree on their first k turns exactly if their hashes at k do.  Conversations
whose whole hash is another's proper prefix go by an anti-join, of equal ones the least id
stays, and what remains is rendered.  Long conversations are handled in blocks of turns, which
are cut further where many turns have one number or none, so no group but the whole text of
a conversation is unbounded.  Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.session import checkpoint

#: Turns numbered within one multiple of this are placed together; a part has this many turns.
BLOCK = 1024
#: If those are more than BLOCK, about one in CUT_AT of them cuts the rest.
CUT_AT = 1024
OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
_LANES = ("_h0", "_h1", "_h2", "_h3")
_ORDER = ("turn", "role", "text")


def placed(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, _block, _k, _n of distinct turns: the place (from 1) in the conversation and its length.

    Turns are ordered by number, role and text, nulls first; rows repeated in full count once.
    """
    ident = F.struct(F.col("conv_id").alias("conv_id")).alias("_c")  # equal to another one even where conv_id is null, so plain joins meet and shuffles are shared
    rows = conversations.select(ident, F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    rows = rows.withColumn("_range", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**53))))
    place, drawn = F.struct(*_ORDER), F.pmod(F.xxhash64(*_ORDER), F.lit(CUT_AT)) == 0
    crowded = rows.groupBy("_c", "_range").agg(F.count(F.lit(1)).alias("_many"), F.array_sort(F.collect_list(F.when(drawn, place))).alias("_cuts")).where(F.col("_many") > BLOCK).drop("_many")
    rows = rows.join(crowded, ["_c", "_range"], "left")
    sub = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= place)), F.lit(0))
    rows = rows.withColumn("_block", F.struct("_range", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(sub).alias("sub"))).drop("_cuts", "_range")
    within = Window.partitionBy("_c", "_block").orderBy(*(F.col(c).asc_nulls_first() for c in _ORDER))
    whole = Window.partitionBy("_c")
    numbered = rows.withColumn("_in_block", F.row_number().over(within))
    blocks = rows.groupBy("_c", "_block").agg(F.count(F.lit(1)).alias("_turns"))
    blocks = blocks.select(
        "_c", "_block",
        F.coalesce(F.sum("_turns").over(whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_turns").over(whole).alias("_n"),
    )
    return numbered.join(blocks, ["_c", "_block"]).select("_c", F.col("_c.conv_id").alias("conv_id"), *_ORDER, "_block", (F.col("_before") + F.col("_in_block")).alias("_k"), "_n")


def rolling(turns: DataFrame) -> DataFrame:
    """conv_id, _k, _n and the rolling hash at every place; turns is placed(...)."""
    content = F.sha2(F.concat_ws(":", F.col("_k").cast("string"), F.to_json(F.struct("role", "text"))), 256)
    lanes = turns.select("_c", "_block", "_k", "_n", content.alias("_g")).withColumns({h: F.conv(F.substring("_g", 1 + 8 * k, 8), 16, 10).cast("long") for k, h in enumerate(_LANES)}).drop("_g")
    lanes = checkpoint(lanes)  # numbers only: what follows reads it twice
    running = Window.partitionBy("_c", "_block").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_c").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lanes.groupBy("_c", "_block").agg(*(F.sum(h).alias(h) for h in _LANES))
    sums = sums.select("_c", "_block", *(F.coalesce(F.sum(h).over(earlier), F.lit(0)).alias(f"{h}b") for h in _LANES))
    rolled = lanes.withColumns({h: F.sum(h).over(running) for h in _LANES})
    return rolled.join(sums, ["_c", "_block"]).select(F.col("_c.conv_id").alias("conv_id"), "_k", "_n", *((F.col(h) + F.col(f"{h}b")).alias(h) for h in _LANES))


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id of the conversations that are no proper prefix of another, of equal ones the least (null last)."""
    prefixes = rolled.where("_k < _n").select("_k", *_LANES).distinct()
    ends = rolled.where("_k = _n").groupBy("_k", *_LANES).agg(F.min(F.struct(F.col("conv_id").isNull().alias("_none"), F.col("conv_id"))).alias("_first"))
    return ends.join(prefixes, ["_k", *_LANES], "left_anti").select(F.col("_first.conv_id").alias("conv_id"))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, rendered: the maximal conversations as text.

    A part has BLOCK turns, the last one what is left; a conversation of up to BLOCK turns has one part, 0.
    A null text is rendered as empty and a null role as `unknown`; turns with null ids form
    one conversation.  No rows give no rows; other columns are ignored.
    """
    plain = conversations.select("conv_id", "turn", "role", "text")
    kept = maximal(checkpoint(rolling(placed(plain))))  # read twice
    own = plain.alias("c").join(kept.alias("k"), F.expr("c.conv_id <=> k.conv_id"), "left_semi").select("c.*")
    segment = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit(BETWEEN), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    part = F.floor((F.col("_k") - 1) / BLOCK).cast("int")
    joined = placed(own).groupBy("conv_id", part.alias("part"), "_n").agg(F.array_sort(F.collect_list(F.struct("_k", segment.alias("_segment")))).alias("_all"))
    return joined.select("conv_id", "part", F.col("_n").alias("n_turns"), F.array_join(F.col("_all._segment"), "").alias("rendered"))


def collapse_whole(conversations: DataFrame) -> DataFrame:
    """The same with one row a conversation, at every size: its parts joined as part 0."""
    parts = collapse_and_render(conversations).groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("part", "rendered"))).alias("_all"))
    return parts.select("conv_id", F.lit(0).alias("part"), "n_turns", F.array_join(F.col("_all.rendered"), "").alias("rendered"))


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n, list(coalesce('is ' || role, 'none') || chr(31) || coalesce('is ' || text, 'none') ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
    string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM t GROUP BY conv_id
), once AS (
  SELECT min(conv_id) AS conv_id, min(n) AS n, turns, min(rendered) AS rendered FROM c GROUP BY turns
)
SELECT conv_id, CAST(0 AS INTEGER) AS part, n AS n_turns, rendered FROM once a
WHERE NOT EXISTS (SELECT 1 FROM once b WHERE b.turns[1] = a.turns[1] AND b.n > a.n AND b.turns[1:a.n] = a.turns)
"""
