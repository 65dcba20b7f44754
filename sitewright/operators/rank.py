"""Ranks, running totals and rank statistics over whole tables, without a window over all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.sources.tables import saved


def running(df: DataFrame, order: list, values: dict[str, Column]) -> DataFrame:
    """df with, for each value, its sum over all rows before this one in a total order.

    Rows are dealt by ranges of the order; each range sums its own rows, and the totals of the ranges before (one row a
    range) are added. So no task sees all rows, as it would in a window without partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = saved(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = parts.groupBy("_p").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in values.items()])
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_p", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in values])
    local = parts.select("*", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_l_{k}") for k, v in values.items()])
    return local.join(F.broadcast(offsets), "_p").select(*df.columns, *[(F.col(f"_l_{k}") + F.col(f"_o_{k}")).alias(k) for k in values])


def running_within(df: DataFrame, by: list[str], order: list, values: dict[str, Column]) -> DataFrame:
    """df with, for each value, its sum over the rows of its group before this one in a total order. by: columns without nulls.

    Each range sums the rows of each group apart; only a group that goes on from earlier ranges adds what it has there, one
    row a range at most. So values of other groups never enter a sum, and a group may be as large as the table."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = saved(df.repartitionByRange(n, *by, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    ranges = parts.groupBy("_p", *by).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in values.items()])
    group = Window.partitionBy(*by).orderBy("_p")  # one row a range
    offsets = ranges.select("_p", *by, F.row_number().over(group).alias("_n"), *[F.sum(f"_t_{k}").over(group.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_o_{k}") for k in values]).filter("_n > 1").drop("_n")
    before = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select("*", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_l_{k}") for k, v in values.items()])
    return local.join(F.broadcast(offsets), ["_p", *by], "left").select(*df.columns, *[(F.col(f"_l_{k}") + F.coalesce(f"_o_{k}", F.lit(0))).alias(k) for k in values])


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with its place in a total order, from 1."""
    return running(df, order, {name: F.lit(1)}).withColumn(name, F.col(name) + 1)


def ranked_within(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    """df with its place, from 1, among the rows of its group, in a total order. by: columns without nulls.

    The place over all rows, groups one after another, less the place where the group begins: a group may be as large as
    the table, its rows still lie in many ranges."""
    g = running(df, [*by, *order], {"_g": F.lit(1)})
    start = g.groupBy(*by).agg(F.min("_g").alias("_s"))
    return g.join(start, by).select(*df.columns, (F.col("_g") - F.col("_s") + 1).alias(name))


def whole_quantile(values: str, percent: int) -> Column:
    """The percent-th quantile of a column of sorted arrays of whole numbers, between neighbours in proportion, to the nearest
    whole number, halves up; null for an empty array. In whole numbers throughout."""
    last = F.size(values) - 1
    at = F.floor(F.lit(percent) * last / 100).cast("int")
    low, high = F.get(values, at), F.get(values, F.least(last, at + 1))
    return F.floor((low * 100 + (F.lit(percent) * last % 100) * (high - low) + 50) / 100)


def mid_ranks(df: DataFrame, value: str, name: str = "mid") -> DataFrame:
    """df with the mean place of the rows of equal value in ascending order. Equal values are counted before they are ordered.

    Rows meet their places by a shuffle: packed files make a long table look short, and Spark would broadcast all rows."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    places = running(counts, [value], {"_b": F.col("_n")}).select(value, (F.col("_b") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(places.hint("merge"), value)


def auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """(auc): the mid-rank area under the curve; null if a class is absent."""
    counts = df.groupBy(score).agg(F.count("*").alias("_n"), F.sum(y).alias("_y"))
    places = running(counts, [score], {"_b": F.col("_n")})
    t = places.agg(F.sum(F.col("_y") * (F.col("_b") + (F.col("_n") + 1) / 2)).alias("r"), F.sum("_y").alias("p"), F.sum("_n").alias("n"))
    return t.select(F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def captured(df: DataFrame, score: str, y: str, share: float, by: str) -> DataFrame:
    """(by, n, positives, captured): positives in the top share of each group, ties at the cut counted in part.

    A group's rows are summed by score first; a group's distinct scores are what its window sees."""
    s = df.groupBy(by, score).agg(F.count("*").alias("_n"), F.sum(y).alias("_y"))
    w = Window.partitionBy(by).orderBy(F.desc(score))
    up = w.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(by)
    s = s.select(by, "_n", "_y", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_gt"), F.sum("_n").over(all_).alias("_all")).withColumn("_m", F.greatest(F.lit(1), F.ceil(F.col("_all") * F.lit(float(share)))))
    part = F.when(F.col("_gt") >= F.col("_m"), 0.0).when(F.col("_gt") + F.col("_n") <= F.col("_m"), F.col("_y").cast("double")).otherwise(F.col("_y") * (F.col("_m") - F.col("_gt")) / F.col("_n"))
    return s.groupBy(by).agg(F.sum("_n").alias("n"), F.sum("_y").alias("positives"), F.sum(part).alias("captured"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(rho): correlation of mid-ranks; null for fewer than two rows or a constant column."""
    r = mid_ranks(mid_ranks(df.select(a, b), a, "_a"), b, "_b")
    t = r.agg(F.corr("_a", "_b").alias("c"), F.count("*").alias("n"), F.stddev_pop("_a").alias("sa"), F.stddev_pop("_b").alias("sb"))
    return t.select(F.when((F.col("n") > 1) & (F.col("sa") > 0) & (F.col("sb") > 0), F.col("c")).alias("rho"))


def block_spearman(df: DataFrame, a: str, b: str, block: str, draws: list[list]) -> list[float | None]:
    """The rank correlation of a and b for each draw of blocks (a list of blocks, repeats count): as if the rows of each drawn
    block were laid together, a block twice if drawn twice; null for a constant column. Rows without a, b or block don't count.

    No row is repeated. A row's centred mid-rank under a draw is the product of the draw's counts of blocks with a vector: for
    each block, its rows of smaller values and half of those of the same one, less half of the block. So the products of those
    vectors, summed within each block, hold all that a draw needs: as many numbers as blocks to the third power come to the
    driver, whatever the rows and draws. Blocks must be few (64 at most)."""
    rows = df.select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.col(block).alias("_block")).dropna()
    rows = saved(rows.groupBy("_a", "_b", "_block").agg(F.count("*").alias("_n")), "blocks-rows")
    sizes = {r["_block"]: r["n"] for r in rows.groupBy("_block").agg(F.sum("_n").alias("n")).limit(65).collect()}
    if len(sizes) > 64:
        raise ValueError("more than 64 blocks")
    names, size = sorted(sizes), len(sizes)
    if not names:
        return [None] * len(draws)
    for c in ("_a", "_b"):
        counts = rows.groupBy(c).agg(*[F.sum(F.when(F.col("_block") == F.lit(x), F.col("_n")).otherwise(0)).alias(f"_n{i}") for i, x in enumerate(names)])
        before = running(counts, [c], {f"_c{i}": F.col(f"_n{i}") for i in range(len(names))})
        vector = F.array(*[F.col(f"_c{i}") + (F.col(f"_n{i}") - F.lit(sizes[x])) / F.lit(2.0) for i, x in enumerate(names)])
        rows = rows.join(before.select(c, vector.alias(f"{c}_v")).hint("merge"), c)
    places = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    pairs = rows.select("_block", "_n", "_a_v", "_b_v", places.alias("i")).select("*", places.alias("j"))
    at = lambda v, k: F.get(f"_{v}_v", F.col(k))
    sums = pairs.groupBy("_block", "i", "j").agg(*[F.sum(F.col("_n") * at(u, "i") * at(v, "j")).alias(u + v) for u, v in ("ab", "aa", "bb")]).collect()
    moments = {k: np.zeros((size, size, size)) for k in ("ab", "aa", "bb")}
    for r in sums:
        for k in moments:
            moments[k][names.index(r["_block"]), r["i"], r["j"]] = r[k]
    out = []
    for draw in draws:
        w = np.array([draw.count(x) for x in names], float)
        ab, aa, bb = (float(np.einsum("b,bij,i,j", w, moments[k], w, w)) for k in ("ab", "aa", "bb"))
        out.append(ab / (aa * bb) ** 0.5 if aa > 0 and bb > 0 else None)
    return out
