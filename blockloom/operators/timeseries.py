"""Set-oriented queries of the time-series models: overlaps, roll-ups, cycles, neighbours, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_overlap(model: DataFrame, data: DataFrame, width: float) -> DataFrame:
    """model_id, data_id, overlap: pairs of intervals [a, b) that overlap.

    Both sides have (id, a, b).  They meet by equal buckets of `width`, which should be about
    the longer interval, so no pair is formed that has no bucket in common.
    """
    cell = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1e-9) / width)))
    m = model.where("a < b").select(F.col("id").alias("model_id"), F.col("a").alias("ma"), F.col("b").alias("mb")).withColumn("cell", cell(F.col("ma"), F.col("mb")))
    d = data.where("a < b").select(F.col("id").alias("data_id"), F.col("a").alias("da"), F.col("b").alias("db")).withColumn("cell", cell(F.col("da"), F.col("db")))
    met = m.join(d, "cell").where((F.col("ma") < F.col("db")) & (F.col("da") < F.col("mb")))
    first = F.floor(F.greatest("ma", "da") / width)  # each pair counts in the cell where the overlap begins
    return met.where(F.col("cell") == first).select("model_id", "data_id", (F.least("mb", "db") - F.greatest("ma", "da")).alias("overlap"))


def weighted_sum(values: DataFrame, overlap: DataFrame, key: list[str]) -> DataFrame:
    """(key, model_id, total): values(data_id, key, value) summed with their overlaps."""
    return values.join(overlap, "data_id").groupBy(*key, "model_id").agg(F.sum(F.col("value") * F.col("overlap")).alias("total"))


def weighted_average(values: DataFrame, overlap: DataFrame, key: list[str]) -> DataFrame:
    return values.join(overlap, "data_id").groupBy(*key, "model_id").agg((F.sum(F.col("value") * F.col("overlap")) / F.nullif(F.sum("overlap"), F.lit(0.0))).alias("average"))


def cyclic_lag(df: DataFrame, value: str, order: str, by: list[str], steps: int = 1) -> DataFrame:
    """df with `lagged`: the value `steps` before, going round from the first to the last."""
    w = Window.partitionBy(*by).orderBy(order)
    numbered = df.withColumns({"_k": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    other = numbered.select(*by, F.pmod(F.col("_k") + steps, F.col("_n")).alias("_k"), F.col(value).alias("lagged"))
    return numbered.join(other, [*by, "_k"]).drop("_k", "_n")


def cyclic_lead(df: DataFrame, value: str, order: str, by: list[str], steps: int = 1) -> DataFrame:
    return cyclic_lag(df, value, order, by, -steps)


def running_min(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    return df.withColumn("running", F.min(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def stagnation(df: DataFrame, value: str, order: str, by: list[str], back: int = 30, factor: float = 1.0) -> DataFrame:
    """df with `running` and `stagnates`: the running minimum is no better than factor times that of `back` rows before."""
    out = running_min(df, value, order, by)
    return out.withColumn("stagnates", F.coalesce(F.col("running") >= factor * F.lag("running", back).over(Window.partitionBy(*by).orderBy(order)), F.lit(False)))


def rolling_windows(steps: DataFrame, size: int, overlap: int) -> DataFrame:
    """steps(step from 0) with `window`: windows of `size` steps, each sharing `overlap` with the next."""
    stride = size - overlap
    last = F.floor(F.col("step") / stride)
    first = F.greatest(F.lit(0), F.floor((F.col("step") - size) / stride) + 1)
    return steps.withColumn("window", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


#: Points are ranked along their axis in ranges of about this many, at most RANGES of them.
RANGE_ROWS, RANGES = 20_000, 256


def nearest_on_axis(points: DataFrame, k: int, axis: str) -> DataFrame:
    """(id, other, distance, rank): of each point its k nearest among all others, by one coordinate.

    They are among the k distinct coordinates before and after it in sorted order, and of each
    coordinate among the k + 1 least ids.  The axis is cut into ranges of about equal numbers
    of points; a range also gets the k coordinates before and after it, so no group is
    unbounded.  Ties go to the least id; points without coordinate have no neighbours.
    """
    spark = points.sparkSession
    there = points.where(F.col(axis).isNotNull()).select("id", F.col(axis).cast("double").alias("_x"))
    least = Window.partitionBy("_x").orderBy("id")
    values = there.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k + 1).groupBy("_x").agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    ranges = min(RANGES, 1 + there.count() // RANGE_ROWS)
    cuts = there.agg(F.percentile_approx("_x", [j / ranges for j in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else []
    cuts = sorted(set(cuts or []))
    held = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast("array<double>")
    values = values.withColumn("_range", F.size(F.filter(held, lambda c: c <= F.col("_x"))))
    up, down = (Window.partitionBy("_range").orderBy(o) for o in (F.col("_x").asc(), F.col("_x").desc()))
    edges = values.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)}).where(f"_up <= {k} OR _down <= {k}")
    found = sorted((r["_x"], r["_range"], r["_ids"]) for r in edges.select("_x", "_range", "_ids").collect())  # at most 2 k rows a range
    halo = []
    for j in range(len(cuts) + 1):
        before, after = [r for r in found if r[1] < j], [r for r in found if r[1] > j]
        halo += [(x, ids, j, False) for x, _, ids in [*before[-k:], *after[:k]]]
    own = values.withColumn("_own", F.lit(True))
    both = own.unionByName(spark.createDataFrame(halo, own.select("_x", "_ids", "_range", "_own").schema)) if halo else own
    around = Window.partitionBy("_range").orderBy("_x").rowsBetween(-k, k)
    met = both.withColumn("_near", F.collect_list(F.struct("_x", "_ids")).over(around)).where("_own").select("_x", "_near")
    other = F.flatten(F.transform("_near", lambda v: F.transform(v["_ids"], lambda i: F.struct(F.abs(F.col("_x") - v["_x"]).alias("distance"), i.alias("other")))))
    ranked = there.join(met, "_x").select("id", F.slice(F.array_sort(F.filter(other, lambda o: o["other"] != F.col("id"))), 1, k).alias("_o"))
    return ranked.select("id", F.posexplode("_o").alias("_k", "_e")).select("id", "_e.other", "_e.distance", (F.col("_k") + 1).alias("rank"))


def nearest(points: DataFrame, k: int, axes: list[str], cell: float, rings: int = 1) -> DataFrame:
    """(id, other, distance, rank): of each point its k nearest among those within `rings` cells of `cell` width.

    A point with nearer ones further off, or with fewer than k there, does not get its k
    nearest; nearest_on_axis() has no such bound.

    Points of the same and of neighbouring grid cells meet, so the work follows the density and
    not the square of the number of points.  Ties go to the least id.
    """
    grid = [F.floor(F.col(a) / cell) for a in axes]
    here = points.select("id", *axes, *(g.alias(f"_g{k}") for k, g in enumerate(grid)))
    there = points.select(F.col("id").alias("other"), *(F.col(a).alias(f"_{a}") for a in axes), *(g.alias(f"_h{k}") for k, g in enumerate(grid)))
    for n in range(len(axes)):
        there = there.withColumn(f"_g{n}", F.explode(F.sequence(F.col(f"_h{n}") - rings, F.col(f"_h{n}") + rings)))
    square = sum(((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in axes), F.lit(0.0))
    met = here.join(there, [f"_g{n}" for n in range(len(axes))]).where("id <> other").select("id", "other", F.sqrt(square).alias("distance"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))).where(F.col("rank") <= k)


def symmetrized(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b: pairs of which either counts the other among its nearest."""
    return edges.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def exclusive(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with `side`."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("right")))


def max_normalized(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """df with `share`: the value over its group's greatest."""
    return df.join(df.groupBy(*by).agg(F.max(value).alias("_m")), by).withColumn("share", F.col(value) / F.nullif(F.col("_m"), F.lit(0.0))).drop("_m")


def net_balance(flows: DataFrame, efficiency: Column, demand: DataFrame) -> DataFrame:
    """region, balance: arriving flows times their efficiency, less leaving flows, less demand.

    flows has (source, target, flow), demand (region, demand).
    """
    arriving = flows.select(F.col("target").alias("region"), (F.col("flow") * efficiency).alias("x"))
    leaving = flows.select(F.col("source").alias("region"), (-F.col("flow")).alias("x"))
    return arriving.unionByName(leaving).unionByName(demand.select("region", (-F.col("demand")).alias("x"))).groupBy("region").agg(F.sum("x").alias("balance"))


def storage_levels(df: DataFrame, order: str, by: list[str]) -> DataFrame:
    """df with `level`: the running sum of inflow less outflow."""
    return df.withColumn("level", F.sum(F.col("inflow") - F.col("outflow")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


# --- model data ----------------------------------------------------------------------------------


def roll_up(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Keys, average, weighted, total, most: the plain and the weighted average, the weighted sum and the maximum."""
    v, w = F.col(value), F.col(weight)
    return df.groupBy(*keys).agg(F.avg(v).alias("average"), (F.sum(v * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("weighted"), F.sum(v * w).alias("total"), F.max(v).alias("most"))


def capacity(plants: DataFrame, power: float, yearly: float, near: float = 1.0) -> DataFrame:
    """region, plant, steps, output, availability, at_capacity, over_cap.

    plants has region, plant, output and available of every step; at_capacity says that some
    step exceeds `near` of the power, over_cap that the whole output exceeds the yearly limit.
    """
    return plants.groupBy("region", "plant").agg(
        F.count(F.lit(1)).alias("steps"), F.sum("output").alias("output"), F.avg("available").alias("availability"),
        (F.max("output") > near * power).alias("at_capacity"), (F.sum("output") > yearly).alias("over_cap"),
    )


def emissions(plants: DataFrame, cap: float, price: float) -> DataFrame:
    """region, emission, excess, cost: output times rate, what exceeds the cap, and its price."""
    total = F.sum(F.col("output") * F.col("rate"))
    return plants.groupBy("region").agg(total.alias("emission"), F.greatest(total - cap, F.lit(0.0)).alias("excess"), (total * price).alias("cost"))


def region_size(plants: DataFrame) -> DataFrame:
    """region, plants, size: how many plants a region has and the sum of their greatest outputs."""
    each = plants.groupBy("region", "plant").agg(F.max("output").alias("_m"))
    return each.groupBy("region").agg(F.count(F.lit(1)).alias("plants"), F.sum("_m").alias("size"))


def mapped_by_ordinal(items: DataFrame, item: str, owners: DataFrame, owner: str) -> DataFrame:
    """item, owner: the n-th item belongs to the owner of place n modulo their number."""
    from blockloom.operators.vector import positions

    n = owners.count()
    a = positions(items, [item], "_i").withColumn("_j", F.col("_i") % max(n, 1))
    return a.join(positions(owners, [owner], "_j"), "_j").select(item, owner)


def nearest_exact(points: DataFrame, k: int, axes: list[str], cell: float) -> DataFrame:
    """(id, other, distance, rank): of each point its k nearest among all others; ties go to the least id.

    Points meet those of their own and the neighbouring grid cells.  One whose k-th distance is
    within a cell's width has seen all that could be nearer; the others ask again in a grid of
    cells twice as wide, until the grid is one neighbourhood.  Points without all coordinates
    have no neighbours.
    """
    from functools import reduce

    from blockloom.session import checkpoint

    there = checkpoint(points.select("id", *(F.col(a).cast("double").alias(a) for a in axes)).where(reduce(lambda x, y: x & y, (F.col(a).isNotNull() for a in axes))))
    span = there.agg(F.greatest(*(F.max(a) - F.min(a) for a in axes), F.lit(0.0)) if len(axes) > 1 else F.max(axes[0]) - F.min(axes[0])).first()[0] or 0.0
    asking, out = there, None
    while True:
        place = [F.floor(F.col(a) / cell).alias(f"_{a}") for a in axes]
        around = asking.select("id", *axes, *place)
        for a in axes:
            around = around.withColumn(f"_{a}", F.explode(F.array(*(F.col(f"_{a}") + d for d in (-1, 0, 1)))))
        others = there.select(F.col("id").alias("other"), *(F.col(a).alias(f"{a}_") for a in axes), *place)
        met = around.join(others, [f"_{a}" for a in axes]).where("id <> other")
        squares = reduce(lambda x, y: x + y, ((F.col(a) - F.col(f"{a}_")) * (F.col(a) - F.col(f"{a}_")) for a in axes))
        near = met.select("id", F.struct(F.sqrt(squares).alias("distance"), "other").alias("o")).groupBy("id").agg(F.slice(F.array_sort(F.collect_list("o")), 1, k).alias("_o"))
        near = checkpoint(near.withColumn("_done", (F.size("_o") == k) & (F.col("_o")[F.size("_o") - 1]["distance"] <= cell)))
        last = cell > span
        found = (near if last else near.where("_done")).select("id", F.posexplode("_o").alias("_k", "_e")).select("id", "_e.other", "_e.distance", (F.col("_k") + 1).alias("rank"))
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        asking = checkpoint(asking.join(near.where("_done").select("id"), "id", "left_anti"))
        if not asking.limit(1).count():
            return out
        cell *= 2
