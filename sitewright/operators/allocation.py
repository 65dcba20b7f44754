"""Allocation of production to sites under limits, with nothing lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewright.operators.rank import running_within
from sitewright.sources.tables import discard, saved


def bounded_equal_shares(totals: DataFrame, limits: DataFrame, keys: tuple[str, ...] = ("region",)) -> tuple[DataFrame, DataFrame]:
    """(region, node, share) and (region, assigned, unserved): each region's total in equal shares up to limits. keys: the
    columns that make a region, where many runs are allocated at once.

    A null limit is no bound. In order of limits, the level is what is left after the smaller limits over the nodes from
    here on; the first node whose limit reaches its level sets the level of the region. Nodes get the smaller of limit
    and level; without such a node all limits are full and the rest is unserved. Limits are not negative. Places and sums
    run over ranges (rank.running_within), so a large region is no single task, and limits of other regions never enter a
    region's sums."""
    by = list(keys)
    n = running_within(limits.join(totals, by), by, [F.col("limit").asc_nulls_last(), "node"], {"_i": F.lit(1), "_s": F.coalesce("limit", F.lit(0.0))})
    n = n.join(n.groupBy(*by).agg(F.count("*").alias("_n")), by)
    n = n.withColumn("_level", F.greatest(F.lit(0.0), (F.col("total") - F.col("_s")) / (F.col("_n") - F.col("_i"))))
    levels = n.filter(F.col("limit").isNull() | (F.col("limit") >= F.col("_level"))).groupBy(*by).agg(F.min_by("_level", "_i").alias("_at"))
    shares = n.join(levels, by, "left").select(*by, "node", F.least("limit", "_at").alias("share"))
    sums = shares.groupBy(*by).agg(F.sum("share").alias("assigned"))
    balance = totals.join(sums, by, "left").select(*by, F.coalesce("assigned", F.lit(0.0)).alias("assigned"), F.greatest(F.lit(0.0), F.col("total") - F.coalesce("assigned", F.lit(0.0))).alias("unserved"))
    return shares, balance


def nearest_first(edges: DataFrame, mass: DataFrame, capacity: DataFrame) -> DataFrame:
    """(origin, node, tonnes): edges (origin, node, minutes) taken in order of (minutes, origin, node), each with what its
    origin still has and its node still holds. A null capacity has no bound.

    In each round every origin offers all it has to the first node it has left. Offers that fill a node end its list: whoever comes
    later in the order gets nothing there, as offers by those before can only add to these; so most edges go in the first round.
    Offers that come before all edges of their node by origins that offer elsewhere are settled, many a node and round; the
    edge that is first of all is always one of them."""
    order = ["minutes", "origin"]
    have = saved(mass.filter("mass > 0").select("origin", "mass"), "origins")
    room = saved(capacity.filter("capacity IS NULL OR capacity > 0").select("node", "capacity"), "nodes")
    left = saved(edges.select("origin", "node", "minutes").join(have, "origin", "left_semi").join(room, "node", "left_semi"), "edges")
    done, before = None, Window.partitionBy("node").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda m, o: F.col(m).isNull() | (F.col("minutes") < F.col(m)) | ((F.col("minutes") == F.col(m)) & (F.col("origin") <= F.col(o)))
    while not left.isEmpty():
        least = left.groupBy("origin").agg(F.min("minutes").alias("_m"))
        first = left.join(least, "origin").filter("minutes = _m").groupBy("origin", "minutes").agg(F.min("node").alias("node"))
        offers = first.join(have, "origin").join(room, "node").withColumn("_b", F.coalesce(F.sum("mass").over(before), F.lit(0.0)))
        offers = saved(offers.withColumn("tonnes", F.coalesce(F.greatest(F.lit(0.0), F.least("mass", F.col("capacity") - F.col("_b"))), "mass")), "offers")
        fills = offers.filter("_b < capacity AND _b + mass >= capacity").select("node", F.col("minutes").alias("_fm"), F.col("origin").alias("_fo"))
        open_ = saved(left.join(fills, "node", "left").filter(upto("_fm", "_fo")).select("origin", "node", "minutes"), "edges-open")
        other = open_.join(offers.select("origin", "node"), ["origin", "node"], "left_anti")
        least = other.groupBy("node").agg(F.min("minutes").alias("_m"))
        stops = other.join(least, "node").filter("minutes = _m").groupBy("node").agg(F.min("minutes").alias("_sm"), F.min("origin").alias("_so"))
        now = saved(offers.filter("tonnes > 0").join(stops, "node", "left").filter(upto("_sm", "_so")).select("origin", "node", "tonnes"), "settled")
        done = now if done is None else done.union(now)
        given, taken = now.select("origin", F.col("tonnes").alias("_t")), now.groupBy("node").agg(F.sum("tonnes").alias("_t"))
        old = [have, room, left, offers, open_]
        have = saved(have.join(given, "origin", "left").select("origin", (F.col("mass") - F.coalesce("_t", F.lit(0.0))).alias("mass")).filter("mass > 0"), "origins")
        room = saved(room.join(taken, "node", "left").select("node", (F.col("capacity") - F.coalesce("_t", F.lit(0.0))).alias("capacity")).filter("capacity IS NULL OR capacity > 0"), "nodes")
        rest = open_.join(now, ["origin", "node"], "left_anti").join(have, "origin", "left_semi").join(room, "node", "left_semi")
        left = saved(rest, "edges")
        discard(*old)
    return done if done is not None else edges.select("origin", "node", F.lit(0.0).alias("tonnes")).limit(0)
