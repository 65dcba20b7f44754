"""People in reach of sites, from the time of each building to the site that owns it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checks import small_side


def minute_counts(owners: DataFrame, sites: DataFrame, cutoff: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, site, minute, rural, urban): buildings in reach before each whole minute from 0 to the cut-off, of every site.

    owners: (keys, owner, t, urban), a row a building, t in minutes, null where no site is in reach; sites: (keys, site), the
    sites to show, also those without buildings. Buildings are counted by minute before they move, so a site has at most a
    row a minute, and the running sums within it stay that short. An urban flag that is null counts as rural."""
    ks = list(keys)
    town = F.coalesce(F.col("urban"), F.lit(False))
    inside = owners.filter((F.col("t") >= 0) & (F.col("t") <= cutoff) & F.col("owner").isNotNull())
    n = inside.groupBy(*ks, F.col("owner").alias("site"), (F.floor("t") + 1).cast("int").alias("minute")).agg(F.count_if(~town).alias("_r"), F.count_if(town).alias("_u"))
    every = sites.select(*ks, "site").distinct().withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(cutoff + 1))))
    w = Window.partitionBy(*ks, "site").orderBy("minute")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(w)
    return every.join(n, [*ks, "site", "minute"], "left").select(*ks, "site", "minute", total("_r").alias("rural"), total("_u").alias("urban"))


def people_within(owners: DataFrame, sites: DataFrame, limits: DataFrame, cutoff: int, weight: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, site, columns of limits, rural, urban, weighted): buildings with t <= limit by site, for each row of limits.

    limits: (limit, ...), at most 100,000 rows, as drawn limits of a simulation are; equal ones are asked once. What lies
    before a limit's whole minute comes from minute_counts; buildings are met only by the limits of their own minute, so
    the answer is exact for any limit and no building meets all of them. A limit under 0 reaches nobody, one over the cut-off raises, as
    times beyond it are not known, and a null one has null counts. weighted: rural + weight x urban."""
    ks = list(keys)
    asked = small_side(limits, 100_000)
    own = limits.select("limit").distinct().filter("limit IS NOT NULL")
    own = own.withColumn("_m", F.when(F.col("limit") > cutoff, F.raise_error(F.lit("a limit beyond the search's cut-off")).cast("int")).otherwise(F.greatest(F.floor("limit"), F.lit(0)).cast("int")))
    own = small_side(own, 100_000)
    before = minute_counts(owners, sites, cutoff, keys)
    whole = before.join(own, before["minute"] == own["_m"]).select(*ks, "site", "limit", "rural", "urban")
    town = F.coalesce(F.col("urban"), F.lit(False))
    part = owners.filter((F.col("t") >= 0) & F.col("owner").isNotNull()).withColumn("_m", F.floor("t").cast("int")).join(own, "_m").filter("t <= limit")
    part = part.groupBy(*ks, F.col("owner").alias("site"), "limit").agg(F.count_if(~town).alias("_r"), F.count_if(town).alias("_u"))
    both = whole.join(part, [*ks, "site", "limit"], "left")
    more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    counts = both.select(*ks, "site", "limit", more("rural", "_r"), more("urban", "_u"))
    counts = counts.join(asked, "limit").select(*ks, "site", *limits.columns, "rural", "urban")
    unknown = sites.select(*ks, "site").distinct().join(small_side(limits.filter("limit IS NULL"), 100_000)).select(*ks, "site", *limits.columns, F.lit(None).cast("long").alias("rural"), F.lit(None).cast("long").alias("urban"))
    return counts.unionByName(unknown).withColumn("weighted", F.col("rural") + F.lit(weight) * F.col("urban"))
