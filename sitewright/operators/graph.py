"""Road networks as edge tables (src, dst, minutes)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.sources.tables import discard, saved


def forward_edges(ways: DataFrame, points: DataFrame, *carried: str) -> DataFrame:
    """(carried, src, dst, metres): consecutive nodes of each way in its own order, without self-loops, with columns of the way."""
    pair = F.explode(F.arrays_zip(F.expr("slice(nodes, 1, greatest(size(nodes) - 1, 0))").alias("a"), F.expr("slice(nodes, 2, greatest(size(nodes) - 1, 0))").alias("b")))
    e = ways.select(*carried, pair.alias("e")).select(*carried, F.col("e.a").alias("src"), F.col("e.b").alias("dst")).filter("src <> dst")
    a, b = points.select(F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay")), points.select(F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return e.join(a, "src").join(b, "dst").select(*carried, "src", "dst", F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))).alias("metres"))


def edges_of_ways(ways: DataFrame, points: DataFrame) -> DataFrame:
    """(way, highway, surface, src, dst, metres): consecutive nodes of each way in both directions, without self-loops.

    Each pair is measured once and then given both directions: a union of two directions would read and join all ways twice."""
    e = forward_edges(ways, points, "way", "highway", "surface")
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return e.select("way", "highway", "surface", "metres", both.alias("e")).select("way", "highway", "surface", "e.src", "e.dst", "metres")


def shortest(edges: DataFrame, sources: DataFrame, cutoff: float, keys: tuple[str, ...] = (), merge: int = 12) -> DataFrame:
    """(keys, v, t, owner): the least time from any source (keys, v, t, owner) to each vertex, up to the cut-off.

    With keys, searches are independent: a source only reaches vertices of its own key, and by edges of that key where edges
    have key columns; so many searches take the rounds of the longest. The frontier of improved vertices moves along its edges in each
    round; ties in time go to the smaller owner. A round writes its frontier alone to the shared folder and reads those
    before it; after so many rounds (merge) they become one table with a row a vertex. Only whether the frontier is empty comes to
    the driver."""
    ks = list(keys)
    own = [k for k in ks if k in edges.columns]
    roads = edges.select(*[F.col(k).alias(f"_{k}") for k in own], "src", "dst", "minutes")
    best = lambda tables: reduce(DataFrame.union, tables).groupBy(*ks, "v").agg(F.min(F.struct("t", "owner")).alias("b")).select(*ks, "v", "b.t", "b.owner")
    front = saved(best([sources.select(*ks, "v", "t", "owner").filter(F.col("t") <= cutoff)]), "front")
    known, none = [front], F.lit(None).cast(_reached_type(front))
    while not front.isEmpty():
        along = (F.col("v") == F.col("src")) if not own else reduce(lambda a, k: a & (F.col(k) == F.col(f"_{k}")), own, F.col("v") == F.col("src"))
        step = front.join(roads, along).select(*ks, F.col("dst").alias("v"), F.struct((F.col("t") + F.col("minutes")).alias("t"), "owner").alias("n"), none.alias("o")).filter(F.col("n.t") <= cutoff)
        old = reduce(DataFrame.union, known).select(*ks, "v", none.alias("n"), F.struct("t", "owner").alias("o"))
        both = step.union(old).groupBy(*ks, "v").agg(F.min("n").alias("n"), F.min("o").alias("o"))
        front = saved(both.filter(F.col("n").isNotNull() & (F.col("o").isNull() | (F.col("n") < F.col("o")))).select(*ks, "v", "n.t", "n.owner"), "front")
        known.append(front)
        if len(known) > merge:
            one = saved(best(known), "reached")
            discard(*known[:-1])  # the last is the frontier of the round to come
            known = [one]
    return best(known)


def _reached_type(front: DataFrame) -> str:
    kinds = dict(front.dtypes)
    return f"struct<t:{kinds['t']},owner:{kinds['owner']}>"


def components(edges: DataFrame) -> DataFrame:
    """(u, root): for every vertex of an edge (u, v), longs, the smallest vertex that it is joined to, itself included.

    Rounds of stars: first all larger neighbours of a vertex go to the smallest of its neighbourhood, then all smaller ones.
    No round has more edges than before, long chains halve, and the rounds are written. They end when every vertex hangs on
    its root. Nulls, self-loops and repeats don't count."""
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v")
    e = saved(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    while True:
        twice = e.groupBy("u").count().filter("count > 1")
        if twice.isEmpty() and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        both = saved(e.union(e.select("v", "u")), "stars-both")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        e = saved(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        down = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        e = saved(down.distinct(), "stars")
    return e.select("u", F.col("v").alias("root")).union(e.select("v", "v").distinct())
