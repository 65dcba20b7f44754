"""Queries over model evaluation, field checks and verification of runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewright.functions import draws as dw
from sitewright.functions import rules
from sitewright.functions.geo import distance
from sitewright.operators import evaluation as ev
from sitewright.operators import rank, spatial
from sitewright.operators.shapes import footprint_shape
from sitewright.plans.places import WAY_PIECES, pieces_of, rectangles, urban, way_edges
from sitewright.plans.rankings import UNITS, units
from sitewright.sources.tables import Queries, buildings, node_points, read, saved, sites, sql, ways

QUERIES = Queries()
r6 = lambda c: F.round(c, 6)

#: Features of the cells of a district, their caps, and the baselines that need no training.
FEATURES = ("log_n", "log_big", "log_roof", "edge", "share")
BASELINES = {"people": "n", "roofs": "amax"}

CELL_SQL = "ce AS (SELECT nation % 6 AS block, floor(x / 1000) AS i, floor(y / 1000) AS j, count(*) AS n, count(*) FILTER (roof >= 600) AS big, max(roof) AS amax, min(x) AS mx FROM b GROUP BY ALL), cl AS (SELECT *, ln(1 + n) AS log_n, ln(1 + big) AS log_big, ln(1 + amax) AS log_roof, least(mx / 1000, 15) AS edge, big / CAST(n AS DOUBLE) AS share, CASE WHEN (i * 7 + j * 3) % 5 = 0 OR amax > 900 THEN 1 ELSE 0 END AS y FROM ce)"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """(block, i, j, n, big, amax, features, y): cells of a district with features and a presence label."""
    b = buildings(spark, sf)
    c = b.groupBy((F.col("nation") % 6).alias("block"), F.floor(F.col("x") / 1000).alias("i"), F.floor(F.col("y") / 1000).alias("j")).agg(F.count("*").alias("n"), F.count_if(F.col("roof") >= 600).alias("big"), F.max("roof").alias("amax"), F.min("x").alias("mx"))
    return c.select("block", "i", "j", "n", "big", "amax", F.log1p("n").alias("log_n"), F.log1p("big").alias("log_big"), F.log1p("amax").alias("log_roof"), F.least(F.col("mx") / 1000, F.lit(15.0)).alias("edge"), (F.col("big") / F.col("n")).alias("share"), F.when(((F.col("i") * 7 + F.col("j") * 3) % 5 == 0) | (F.col("amax") > 900), 1).otherwise(0).alias("y"))


#: How far off a major road, the grid and a settlement count, in metres, for cells and for footprints.
CELL_CAPS = {"major": 15000.0, "power": 25000.0, "settlement": 15000.0}
FOOT_CAPS = {"major": 15000.0, "any": 5000.0, "settlement": 15000.0, "power": 25000.0}
#: Kinds of sites that stand for the grid and for settlements, for processing, and for any place of trade.
POWER, SETTLED, PROCESSING, TRADING = (1, 2), (5, 6, 7), (0, 3), (0, 3, 4)
D2 = "sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y))"


def site_layers(spark: SparkSession, sf: str) -> DataFrame:
    """(layer, id, x, y) of the grid's and the settlements' points."""
    layer = F.when(F.col("kind").isin(*POWER), "power").when(F.col("kind").isin(*SETTLED), "settlement")
    return sites(spark, sf).select(layer.alias("layer"), "id", "x", "y").filter("layer IS NOT NULL")


DESIGN = sql("b s wn wt np", "") + WAY_PIECES + """, ub AS (SELECT *, CAST(floor(x / 1000) AS BIGINT) AS i, CAST(floor(y / 1000) AS BIGINT) AS j, count(*) OVER (PARTITION BY floor(x / 2500), floor(y / 2500)) >= 25 AS urban FROM b),
c AS (SELECT i, j, count(*) AS nb, count(*) FILTER (roof >= 200) AS n200, count(*) FILTER (roof >= 600) AS n600, max(roof) AS amax, count(*) FILTER (urban) AS nu FROM ub GROUP BY i, j),
mp AS (SELECT x, y, CAST(floor(x / 1000) AS BIGINT) AS i, CAST(floor(y / 1000) AS BIGINT) AS j, length, highway <> 'track' AS major FROM d JOIN wt USING (way)),
r AS (SELECT i, j, coalesce(sum(length) FILTER (major), 0) / 1000 AS maj, coalesce(sum(length) FILTER (NOT major), 0) / 1000 AS mnr FROM mp GROUP BY i, j),
f AS (SELECT i, j, max(CASE WHEN kind IN (0, 3) THEN 1 ELSE 0 END) AS y, max(CASE WHEN kind IN (0, 3, 4) THEN 1 ELSE 0 END) AS y_any FROM (SELECT *, CAST(floor(x / 1000) AS BIGINT) AS i, CAST(floor(y / 1000) AS BIGINT) AS j FROM (SELECT id, x, y AS y, kind FROM s)) GROUP BY i, j),
u AS (SELECT i, j FROM c UNION SELECT i, j FROM r UNION SELECT i, j FROM f), q AS (SELECT i, j, (i + 0.5::DOUBLE) * 1000 AS x, (j + 0.5::DOUBLE) * 1000 AS y FROM u),
m1 AS (SELECT i, j, min(""" + D2 + """) AS d FROM q JOIN mp p USING (i, j) WHERE major GROUP BY i, j), m2 AS (SELECT q.i, q.j, min(""" + D2 + """) AS d FROM q, mp p WHERE major AND (q.i, q.j) NOT IN (SELECT (i, j) FROM m1 WHERE d <= 500) GROUP BY q.i, q.j),
dm AS (SELECT * FROM m1 WHERE d <= 500 UNION ALL SELECT * FROM m2),
ds AS (SELECT i, j, min(""" + D2 + """) FILTER (kind IN (1, 2)) AS pw, min(""" + D2 + """) FILTER (kind IN (5, 6, 7)) AS st FROM q, s p GROUP BY i, j),
nn AS (SELECT u.i, u.j, sum(c.nb) AS nb_n FROM u JOIN c ON abs(u.i - c.i) <= 2 AND abs(u.j - c.j) <= 2 GROUP BY u.i, u.j)
SELECT u.i, u.j, round(ln(1 + coalesce(nb, 0)), 6) AS log_bld, round(ln(1 + coalesce(nb_n, 0)), 6) AS log_bld_2km, round(ln(1 + coalesce(n200, 0)), 6) AS log_roof200, round(ln(1 + coalesce(n600, 0)), 6) AS log_roof600, round(ln(1 + coalesce(amax, 0)), 6) AS log_roof_max, round(least(coalesce(maj, 0), 5), 4) AS major_road_km, round(ln(1 + coalesce(mnr, 0)), 4) AS log_minor_road_km, round(ln(1 + least(coalesce(dm.d, 15000), 15000) / 1000), 6) AS log_dist_major_road, round(ln(1 + least(coalesce(pw, 25000), 25000) / 1000), 6) AS log_dist_power, round(ln(1 + least(coalesce(st, 15000), 15000) / 1000), 6) AS log_dist_centre, round(coalesce(nu / CAST(nb AS DOUBLE), 0), 6) AS urban_share, coalesce(f.y, 0) AS y, coalesce(y_any, 0) AS y_any
FROM u LEFT JOIN c USING (i, j) LEFT JOIN r USING (i, j) LEFT JOIN f USING (i, j) LEFT JOIN dm USING (i, j) LEFT JOIN ds USING (i, j) LEFT JOIN nn USING (i, j)"""


@QUERIES.add("eva1_siting_design", DESIGN)
def eva1(spark: SparkSession, sf: str) -> DataFrame:
    """The design of the siting model: a row for each cell of 1 km that holds a building, a road or a site, its eleven features
    from buildings, roads, grid and settlements, with distances up to their caps, and two labels of documented sites."""
    at = (F.floor(F.col("x") / 1000).alias("i"), F.floor(F.col("y") / 1000).alias("j"))
    b = urban(buildings(spark, sf), 2500, 25).groupBy(*at).agg(F.count("*").alias("nb"), F.count_if(F.col("roof") >= 200).alias("n200"), F.count_if(F.col("roof") >= 600).alias("n600"), F.max("roof").alias("amax"), F.count_if("urban").alias("nu"))
    pieces = pieces_of(saved(way_edges(spark, sf), "road-edges")).withColumn("major", F.col("highway") != "track").select(*at, "x", "y", "length", "major")
    km = lambda c: F.coalesce(F.sum(F.when(c, F.col("length"))), F.lit(0.0)) / 1000
    own = distance(F.col("x"), F.col("y"), (F.col("i") + 0.5) * 1000, (F.col("j") + 0.5) * 1000)
    r = pieces.groupBy("i", "j").agg(km(F.col("major")).alias("maj"), km(~F.col("major")).alias("mnr"), F.min(F.when(F.col("major"), own)).alias("own"))
    label = lambda kinds: F.max(F.col("kind").isin(*kinds).cast("int"))
    f = sites(spark, sf).groupBy(*at).agg(label(PROCESSING).alias("y"), label(TRADING).alias("y_any"))
    c = saved(b.join(r, ["i", "j"], "full_outer").join(f, ["i", "j"], "full_outer"), "siting-cells")
    centre = c.select(F.struct("i", "j").alias("id"), ((F.col("i") + 0.5) * 1000).alias("x"), ((F.col("j") + 0.5) * 1000).alias("y"))
    caps = {k: v for k, v in CELL_CAPS.items() if k != "major"}
    far = spatial.nearest_layers(centre, site_layers(spark, sf), caps, 500.0).groupBy("id").agg(*[F.coalesce(F.min(F.when(F.col("layer") == k, F.col("d"))), F.lit(v)).alias(k) for k, v in caps.items()]).select("id.i", "id.j", *caps)
    far = far.join(spatial.nearest_from_cells(c.select("i", "j", "own"), pieces.filter("major").select("i", "j", "x", "y"), 1000, CELL_CAPS["major"]), ["i", "j"], "left").withColumn("major", F.coalesce("d", F.lit(CELL_CAPS["major"]))).drop("d")
    n2 = spatial.focal_sum(c.filter("nb IS NOT NULL"), "nb", 2).withColumnRenamed("total", "nb_n")
    x = c.drop("own").join(far, ["i", "j"]).join(n2, ["i", "j"], "left").fillna(0)
    log = lambda name, v, digits=6: F.round(F.log1p(v), digits).alias(name)
    counts = [log("log_bld", "nb"), log("log_bld_2km", "nb_n"), log("log_roof200", "n200"), log("log_roof600", "n600"), log("log_roof_max", "amax")]
    roads = [F.round(F.least("maj", F.lit(5.0)), 4).alias("major_road_km"), log("log_minor_road_km", "mnr", 4)]
    away = [log(f"log_dist_{n}", F.col(k) / 1000) for n, k in (("major_road", "major"), ("power", "power"), ("centre", "settlement"))]
    return x.select("i", "j", *counts, *roads, *away, r6(F.coalesce(F.try_divide("nu", "nb"), F.lit(0.0))).alias("urban_share"), "y", "y_any")


FOOTPRINTS = sql("b s wn wt np", """, fp AS (SELECT id, x, y, CAST(w * h AS DOUBLE) AS area, CAST(2 * (w + h) AS DOUBLE) AS perimeter, greatest(w, h) / CAST(least(w, h) AS DOUBLE) AS elongation FROM (SELECT *, 5 + id % 7 AS w, 4 + id % 5 AS h FROM b)),
nb AS (SELECT p.id, count(*) FILTER (""" + D2 + """ <= 200) - 1 AS n200, count(*) - 1 AS n1000, max(q.area) FILTER (""" + D2 + """ <= 200) AS amax FROM fp p, fp q WHERE """ + D2 + """ <= 1000 GROUP BY p.id),
nd AS (SELECT node AS id, bool_or(highway <> 'track') AS major FROM wn JOIN wt USING (way) GROUP BY node),
dr AS (SELECT p.id, min(""" + D2 + """) FILTER (major) AS dmaj, min(""" + D2 + """) AS dany FROM b p, np q JOIN nd ON nd.id = q.id GROUP BY p.id),
ds AS (SELECT p.id, min(""" + D2 + """) FILTER (q.kind IN (1, 2)) AS pw, min(""" + D2 + """) FILTER (q.kind IN (5, 6, 7)) AS st FROM b p, s q GROUP BY p.id)
SELECT fp.id, round(ln(area), 6) AS log_area, round(ln(perimeter), 6) AS log_perimeter, round(elongation, 6) AS elongation, 1.0::DOUBLE AS rectangularity, round(ln(1 + n200), 6) AS log_near, round(ln(1 + n1000), 6) AS log_around, round(area / amax, 6) AS area_share, round(ln(1 + least(coalesce(dmaj, 15000), 15000)), 6) AS log_major, round(ln(1 + least(coalesce(dany, 5000), 5000)), 6) AS log_road, round(ln(1 + least(coalesce(st, 15000), 15000)), 6) AS log_settlement, round(ln(1 + least(coalesce(pw, 25000), 25000)), 6) AS log_power FROM fp JOIN nb USING (id) JOIN dr USING (id) JOIN ds USING (id)""").replace(" , fp", ", fp")


@QUERIES.add("eva2_footprint_features", FOOTPRINTS)
def eva2(spark: SparkSession, sf: str) -> DataFrame:
    """Eleven features of a footprint: its shape, the footprints around it and its share of the largest near it, and the way
    to a major road, any road, a settlement and the grid, up to their caps. Road points are the nodes of ways."""
    b = buildings(spark, sf)
    shape = saved(footprint_shape(rectangles(b)), "footprint-shapes")
    p = spatial.pairs_within(b, b, 1000).join(shape.select(F.col("id").alias("other"), F.col("area").alias("_a")).hint("merge"), "other")
    close = F.col("d") <= 200
    near = p.groupBy("id").agg((F.count_if(close) - 1).alias("n200"), (F.count("*") - 1).alias("n1000"), F.max(F.when(close, F.col("_a"))).alias("amax"))
    kind = ways(spark, sf).select(F.explode("nodes").alias("id"), (F.col("highway") != "track").alias("major")).groupBy("id").agg(F.bool_or("major").alias("major"))
    layer = F.explode(F.when(F.col("major"), F.array(F.lit("major"), F.lit("any"))).otherwise(F.array(F.lit("any"))))
    points = node_points(spark, sf).join(kind.hint("merge"), "id").select(layer.alias("layer"), "id", "x", "y").union(site_layers(spark, sf))
    far = spatial.nearest_layers(b, points, FOOT_CAPS, 750.0).groupBy("id").agg(*[F.coalesce(F.min(F.when(F.col("layer") == k, F.col("d"))), F.lit(v)).alias(k) for k, v in FOOT_CAPS.items()])
    x = shape.join(near.hint("merge"), "id").join(far.hint("merge"), "id")
    log = lambda name, v: r6(F.log1p(v)).alias(name)
    own = [r6(F.log(F.greatest(F.col(c), F.lit(1e-6)))).alias(n) for n, c in (("log_area", "area"), ("log_perimeter", "perimeter"))]
    away = [log(n, k) for n, k in (("log_major", "major"), ("log_road", "any"), ("log_settlement", "settlement"), ("log_power", "power"))]
    return x.select("id", *own, r6("elongation").alias("elongation"), r6("rectangularity").alias("rectangularity"), log("log_near", "n200"), log("log_around", "n1000"), r6(F.col("area") / F.col("amax")).alias("area_share"), *away)


@QUERIES.add("eva3_standardisation", sql("b", "").rstrip() + ", " + CELL_SQL + ", f AS (SELECT DISTINCT block AS fold FROM cl) SELECT fold, round(avg(log_n), 6) AS mean, round(CASE WHEN stddev_pop(log_n) = 0 THEN 1 ELSE stddev_pop(log_n) END, 6) AS sd, count(*) AS n FROM cl, f WHERE block <> fold GROUP BY fold")
def eva3(spark: SparkSession, sf: str) -> DataFrame:
    """Means and deviations of each fold's training rows, from one sum a block."""
    m = cells(spark, sf).groupBy("block").agg(F.count("*").alias("n"), F.sum("log_n").alias("s"), F.sum(F.col("log_n") * F.col("log_n")).alias("q"))
    f = m.select(F.col("block").alias("fold")).crossJoin(m).filter("block <> fold").groupBy("fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))
    return f.select("fold", r6(mean).alias("mean"), r6(F.when(sd == 0, 1.0).otherwise(sd)).alias("sd"), "n")


@QUERIES.add("eva4_ridge_logistic")
def eva4(spark: SparkSession, sf: str) -> DataFrame:
    c = saved(cells(spark, sf), "cells")
    rows = [(int(f), name, float(round(v, 6))) for f, m in ev.fit_logistic(c, list(FEATURES), "y", "block").items() for name, v in zip(("intercept", *FEATURES), m["beta"])]
    return spark.createDataFrame(rows, "fold int, feature string, coefficient double")


@QUERIES.add("eva5_presence_background")
def eva5(spark: SparkSession, sf: str) -> DataFrame:
    """Positives stacked on all cells as background."""
    c = cells(spark, sf)
    x = saved(c.filter("y = 1").union(c.withColumn("y", F.lit(0))), "stacked")
    m = ev.fit_logistic(x, list(FEATURES), "y", None)[None]
    return spark.createDataFrame([(n, float(round(v, 6))) for n, v in zip(("intercept", *FEATURES), m["beta"])], "feature string, coefficient double")


@QUERIES.add("eva6_single_signals", sql("b", "").rstrip() + ", " + CELL_SQL + " SELECT arm, count(*) AS n, round(CAST(sum(score) AS DOUBLE), 4) AS total FROM (SELECT 'people' AS arm, CAST(n AS DOUBLE) AS score FROM cl UNION ALL SELECT 'roofs', amax FROM cl) GROUP BY arm")
def eva6(spark: SparkSession, sf: str) -> DataFrame:
    return stacked(cells(spark, sf), {a: F.col(c).cast("double") for a, c in BASELINES.items()}).groupBy("arm").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


def stacked(df: DataFrame, arms: dict) -> DataFrame:
    """(block, i, j, y, arm, score): one row for each row and arm."""
    return df.select("block", "i", "j", "y", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), s.alias("score")) for a, s in arms.items()])).alias("a")).select("block", "i", "j", "y", "a.arm", "a.score")


def scored(spark: SparkSession, sf: str, c: DataFrame | None = None) -> DataFrame:
    """Scores of the model by held-out block, the model without roofs, and the baselines."""
    c = c if c is not None else saved(cells(spark, sf), "cells")
    few = [f for f in FEATURES if "roof" not in f]
    model, less = ev.fit_logistic(c, list(FEATURES), "y", "block"), ev.fit_logistic(c, few, "y", "block")
    arms = {"model": ev.score_folds(c, model, list(FEATURES), "block"), "no_roofs": ev.score_folds(c, less, few, "block")}
    return stacked(c, arms | {a: F.col(k).cast("double") for a, k in BASELINES.items()})


def block_captures(s: DataFrame, share: float = 0.1) -> DataFrame:
    """(block, arm, n, positives, captured)."""
    s = s.withColumn("g", F.struct("block", "arm"))
    return rank.captured(s, "score", "y", share, "g").select("g.block", "g.arm", "n", "positives", "captured")


@QUERIES.add("eva7_leave_one_block_out")
def eva7(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("block", "i", "j", "arm", r6("score").alias("score"))


BASE_CAP = sql("b", "").rstrip() + ", " + CELL_SQL + ", u AS (SELECT block, y, CAST(n AS DOUBLE) AS score, 'people' AS arm FROM cl UNION ALL SELECT block, y, amax, 'roofs' FROM cl), o AS (SELECT block, arm, score, count(*) AS n, sum(y) AS p FROM u GROUP BY ALL), q AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY block, arm ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gt, greatest(1, ceil(CAST(0.1 AS DOUBLE) * sum(n) OVER (PARTITION BY block, arm))) AS m FROM o), cap AS (SELECT block, arm, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(CASE WHEN gt >= m THEN 0.0 WHEN gt + n <= m THEN p ELSE p * (m - gt) / n END) AS DOUBLE) AS captured FROM q GROUP BY block, arm)"


def baseline_captures(spark: SparkSession, sf: str) -> DataFrame:
    return block_captures(stacked(cells(spark, sf), {a: F.col(c).cast("double") for a, c in BASELINES.items()}))


@QUERIES.add("eva8_pooled_recall", BASE_CAP + " SELECT arm, round(sum(captured) / sum(positives), 6) AS recall FROM cap WHERE positives > 0 GROUP BY arm")
def eva8(spark: SparkSession, sf: str) -> DataFrame:
    return baseline_captures(spark, sf).filter("positives > 0").groupBy("arm").agg(r6(F.sum("captured") / F.sum("positives")).alias("recall"))


@QUERIES.add("eva9_cluster_bootstrap")
def eva9(spark: SparkSession, sf: str) -> DataFrame:
    b = saved(baseline_captures(spark, sf).filter("positives > 0"), "captures")
    return ev.interval(ev.cluster_bootstrap(b, 2000, 20261011), "recall", ["arm"])


@QUERIES.add("eva10_block_mean_bootstrap")
def eva10(spark: SparkSession, sf: str) -> DataFrame:
    """Paired differences of block means of two arms: interval, and keep if all of it is over 0."""
    b = baseline_captures(spark, sf).filter("positives > 0").select("block", "arm", (F.col("captured") / F.col("positives")).alias("captured"), F.lit(1).alias("positives"))
    d = ev.cluster_bootstrap(saved(b, "captures"), 2000, 407).groupBy("draw").agg((F.max(F.when(F.col("arm") == "people", F.col("recall"))) - F.max(F.when(F.col("arm") == "roofs", F.col("recall")))).alias("margin"))
    return ev.interval(d.withColumn("pair", F.lit("people-roofs")), "margin", ["pair"]).withColumn("keep", F.col("low") > 0)


@QUERIES.add("eva11_verdict")
def eva11(spark: SparkSession, sf: str) -> DataFrame:
    """Gate and verdict of the model against the best baseline, recomputed in each draw."""
    caps = saved(block_captures(scored(spark, sf)).filter("positives > 0"), "captures")
    arm = lambda a: F.max(F.when(F.col("arm") == a, F.col("recall")))
    d = ev.cluster_bootstrap(caps, 2000, 20261011).groupBy("draw").agg((arm("model") - F.greatest(*[arm(a) for a in BASELINES])).alias("margin"))
    i = ev.interval(d.withColumn("k", F.lit(1)), "margin", ["k"])
    n = caps.filter("arm = 'model'").agg(F.sum("positives").alias("positives"), F.count("*").alias("blocks"))
    return n.crossJoin(i).select("positives", "blocks", "low", "high", ev.verdict(F.col("positives"), F.col("blocks"), F.col("low")).alias("verdict"))


@QUERIES.add("eva12_sign_stability")
def eva12(spark: SparkSession, sf: str) -> DataFrame:
    return eva4(spark, sf).filter("feature <> 'intercept'").groupBy("feature").agg(r6(F.avg("coefficient")).alias("mean"), r6(F.avg((F.col("coefficient") > 0).cast("int"))).alias("positive_share"))


def applied(spark: SparkSession, sf: str) -> DataFrame:
    """All cells with probability and percentile by the model of all rows."""
    c = saved(cells(spark, sf), "cells")
    m = ev.margin(ev.fit_logistic(c, list(FEATURES), "y", None)[None], list(FEATURES))
    s = rank.ranked(c.select("block", "i", "j", "y", "amax", F.round(m, 9).alias("m")), [F.desc("m"), "block", "i", "j"])
    n = c.count()
    return s.select("block", "i", "j", "y", "amax", "rank", (1 / (1 + F.exp(-F.col("m")))).alias("p"), (1 - (F.col("rank") - 1) / max(1, n - 1)).alias("percentile"))


@QUERIES.add("eva13_apply_model")
def eva13(spark: SparkSession, sf: str) -> DataFrame:
    a = applied(spark, sf)
    return a.filter("percentile >= 0.8").select("block", "i", "j", "y", r6("p").alias("p"), r6("percentile").alias("percentile"))


@QUERIES.add("eva14_point_percentile")
def eva14(spark: SparkSession, sf: str) -> DataFrame:
    a = applied(spark, sf).groupBy("i", "j").agg(F.max("percentile").alias("percentile"))
    s = sites(spark, sf).select("id", F.floor(F.col("x") / 1000).alias("i"), F.floor(F.col("y") / 1000).alias("j"))
    return s.join(a, ["i", "j"], "left").select("id", r6("percentile").alias("percentile"))


@QUERIES.add("eva15_boosted_challenger")
def eva15(spark: SparkSession, sf: str) -> DataFrame:
    """Gradient-boosted trees of depth 3 in 200 rounds, each block scored by the trees of the others."""
    c = saved(cells(spark, sf), "cells")
    out = None
    for b in ev.fold_rows(c, "block"):
        p = boosted(c, b)
        out = p if out is None else out.union(p)
    return out


def boosted(c: DataFrame, block, rounds: int = 200) -> DataFrame:
    """(block, i, j, y, p) of a block's cells by trees of all other blocks; checkpoints cut the lineage of rounds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(c)
    model = GBTClassifier(featuresCol="x", labelCol="y", maxDepth=3, maxIter=rounds, stepSize=0.05, subsamplingRate=0.8, seed=20261012).fit(x.filter(F.col("block") != F.lit(block)))
    return model.transform(x.filter(F.col("block") == F.lit(block))).select("block", "i", "j", "y", r6(vector_to_array("probability")[1]).alias("p"))


@QUERIES.add("eva16_prior_correction", "SELECT s_suppkey AS id, round(1 / (1 + exp(-((s_suppkey % 9 - 4) - ln(9.0::DOUBLE)))), 6) AS p FROM supplier")
def eva16(spark: SparkSession, sf: str) -> DataFrame:
    """Probability of a margin fitted with balanced classes where there were nine negatives for each positive."""
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), r6(rules.prior_corrected(F.col("s_suppkey") % 9 - 4, F.lit(9.0), F.lit(1.0))).alias("p"))


@QUERIES.add("eva17_brier_and_calibration", f"WITH {UNITS}, t AS (SELECT *, ntile(10) OVER (ORDER BY price, id) AS bin FROM un), g AS (SELECT bin, count(*) AS n, avg(price / 600000) AS p, avg(y) AS o FROM t GROUP BY bin) SELECT round((SELECT avg((price / 600000 - y) * (price / 600000 - y)) FROM un), 8) AS brier, round(sum(n * abs(p - o)) / sum(n), 8) AS ece FROM g")
def eva17(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf).select("id", "y", (F.col("price") / 600000).alias("p"))
    n = u.count()
    size, extra = n // 10, n % 10
    k = F.col("rank") - 1
    bin_ = F.when(k < extra * (size + 1), F.floor(k / (size + 1))).otherwise(extra + F.floor((k - extra * (size + 1)) / max(1, size)))
    g = rank.ranked(u, ["p", "id"]).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("o"))
    return u.agg(F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 8).alias("brier")).crossJoin(g.agg(F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("o"))) / F.sum("n"), 8).alias("ece")))


@QUERIES.add("eva18_adoption_rule", "SELECT s_nationkey AS district, round(avg(CASE WHEN s_acctbal > 4000 THEN 1.0 ELSE 0.0 END) - 0.5, 6) AS gain, CASE WHEN avg(CASE WHEN s_acctbal > 4000 THEN 1.0 ELSE 0.0 END) - 0.5 >= 0.03::DOUBLE AND min(s_acctbal) > 0 AND abs(avg(s_acctbal) - 5000) / 100000 <= 0.01::DOUBLE THEN 'ADOPT' ELSE 'KEEP CURRENT' END AS decision FROM supplier GROUP BY 1")
def eva18(spark: SparkSession, sf: str) -> DataFrame:
    """Three points better, the interval over 0, and calibration no worse by over 0.01: by district, from its balances."""
    g = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("district")).agg((F.avg((F.col("s_acctbal") > 4000).cast("double")) - 0.5).alias("gain"), F.min("s_acctbal").alias("low"), (F.abs(F.avg("s_acctbal") - 5000) / 100000).alias("change"))
    return g.select("district", r6("gain").alias("gain"), rules.adopted(F.col("gain"), F.col("low"), F.col("change")).alias("decision"))


def importance(spark: SparkSession, sf: str, repeats: int = 5) -> DataFrame:
    """(feature, drop): mean loss of area under the curve when a feature is permuted within its block."""
    c = saved(cells(spark, sf), "cells")
    models = ev.fit_logistic(c, list(FEATURES), "y", "block")
    base = rank.auc(c.withColumn("s", F.round(ev.score_folds(c, models, list(FEATURES), "block"), 9)), "s", "y").first()[0]
    rows = []
    for f in FEATURES:
        drops = []
        for rep in range(repeats):
            w = Window.partitionBy("block")
            order = c.withColumn("_a", F.row_number().over(w.orderBy("i", "j")))
            mixed = c.select("block", F.col(f).alias("_v"), F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", "i", "j", F.lit(f"{f}{rep}"))), "i", "j")).alias("_a"))
            x = order.join(mixed, ["block", "_a"]).drop(f).withColumnRenamed("_v", f)
            drops.append(base - rank.auc(x.withColumn("s", F.round(ev.score_folds(x, models, list(FEATURES), "block"), 9)), "s", "y").first()[0])
        rows.append((f, float(round(sum(drops) / repeats, 6))))
    return spark.createDataFrame(rows, "feature string, drop double")


@QUERIES.add("eva19_permutation_importance")
def eva19(spark: SparkSession, sf: str) -> DataFrame:
    return importance(spark, sf)


@QUERIES.add("eva20_importance_agreement", "WITH a AS (SELECT p_size AS f, avg(p_retailprice) AS a, sum(p_partkey % 17) AS b FROM part GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM a) SELECT round(corr(x, y), 6) AS rho FROM r")
def eva20(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("a"), F.sum(F.col("p_partkey") % 17).alias("b"))
    return rank.spearman(a, "a", "b").select(r6("rho").alias("rho"))


@QUERIES.add("eva21_reproduction_gate", "SELECT year(o_orderdate) AS year, count(*) AS n, sum(CASE WHEN abs(o_totalprice - coalesce(v, 0)) <= 1000 THEN 1 ELSE 0 END) = count(*) AS reproduced FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS v FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def eva21(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded totals of orders made again from their lines, before a challenger is scored: by year, whether all are."""
    v = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("v"))
    o = read(spark, sf, "orders").join(v, "o_orderkey", "left")
    return o.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"), F.bool_and(rules.reproduced(F.coalesce("v", F.lit(0.0)), F.col("o_totalprice"), 1000.0)).alias("reproduced"))


BOYCE = f"WITH {UNITS}, l AS (SELECT min(score) AS lo, max(score) AS hi FROM un), w AS (SELECT k, lo + (hi - lo) * 0.05::DOUBLE + (hi - lo) * 0.9::DOUBLE * k / 20 AS c, (hi - lo) * 0.05::DOUBLE AS half FROM l, (SELECT unnest(range(0, 21)) AS k)), e AS (SELECT k, avg(CASE WHEN score >= c - half AND score <= c + half THEN 1.0::DOUBLE ELSE 0 END) AS ex, sum(CASE WHEN score >= c - half AND score <= c + half THEN y ELSE 0 END) / CAST(sum(y) AS DOUBLE) AS pr FROM un, w GROUP BY k)"


@QUERIES.add("eva22_boyce_windows", BOYCE + " SELECT CAST(k AS INTEGER) AS k, round(ex, 6) AS expected, round(pr / ex, 6) AS ratio FROM e WHERE ex > 0")
def eva22(spark: SparkSession, sf: str) -> DataFrame:
    return boyce(units(spark, sf), 20).select("k", r6("ex").alias("expected"), r6("ratio").alias("ratio"))


def boyce(u: DataFrame, windows: int) -> DataFrame:
    """(k, ex, ratio): moving windows a tenth of the score range wide; share of positives over share of all. A window's rows come
    from sums by score, so the range join is between distinct scores and a fixed number of windows."""
    s = u.groupBy("score").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    lim = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("n").alias("all_n"), F.sum("y").alias("all_y"))
    w = lim.select("*", F.explode(F.sequence(F.lit(0), F.lit(windows))).alias("k")).withColumn("half", (F.col("hi") - F.col("lo")) * 0.05)
    w = w.withColumn("c", F.col("lo") + (F.col("hi") - F.col("lo")) * 0.05 + (F.col("hi") - F.col("lo")) * 0.9 * F.col("k") / windows)
    g = s.crossJoin(F.broadcast(w)).filter((F.col("score") >= F.col("c") - F.col("half")) & (F.col("score") <= F.col("c") + F.col("half"))).groupBy("k", "all_n", "all_y").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    return g.select("k", (F.col("n") / F.col("all_n")).alias("ex"), (F.col("y") / F.col("all_y") / (F.col("n") / F.col("all_n"))).alias("ratio"))


@QUERIES.add("eva22_boyce_index", BOYCE.replace("k / 20", "k / 100").replace("range(0, 21)", "range(0, 101)") + ", q AS (SELECT k, round(pr / ex, 9) AS ratio, lag(pr / ex) OVER (ORDER BY k) AS before, pr / ex AS exact FROM e WHERE ex > 0), r AS (SELECT rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS a, rank() OVER (ORDER BY ratio) + (count(*) OVER (PARTITION BY ratio) - 1) / 2.0 AS b FROM q WHERE before IS NULL OR abs(before - exact) > 1e-12) SELECT round(corr(a, b), 6) AS boyce FROM r")
def eva22b(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation of window and ratio, repeats in a row dropped; windows are a fixed number."""
    b = boyce(units(spark, sf), 100).withColumn("before", F.lag("ratio").over(Window.orderBy("k"))).filter("before IS NULL OR abs(before - ratio) > 1e-12")
    return rank.spearman(b.select("k", F.round("ratio", 9).alias("ratio")), "k", "ratio").select(r6("rho").alias("boyce"))


HIND = "h AS (SELECT o_orderkey AS id, o_totalprice AS o, 200000 + (o_custkey % 100) * 1000.0::DOUBLE AS p, year(o_orderdate) AS block FROM orders WHERE o_orderstatus <> 'P'), m AS (SELECT *, rank() OVER (ORDER BY o) + (count(*) OVER (PARTITION BY o) - 1) / 2.0 AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS b, row_number() OVER (ORDER BY o DESC, id) AS ro, row_number() OVER (ORDER BY p DESC, id) AS rp, ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS k FROM h)"
#: Draws of blocks, their seed, and the level of the interval.
BLOCK_DRAWS, BLOCK_SEED, LEVEL = 100, 2311, 0.9
BLOCKS = f"bl AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS i, count(*) OVER () AS nb FROM (SELECT DISTINCT block FROM h)), pk AS (SELECT d, CAST(floor({dw.sql_uniform(str(BLOCK_SEED), 'd * nb + k + 1')} * nb) AS BIGINT) AS i FROM (SELECT DISTINCT nb FROM bl), (SELECT unnest(range(0, {BLOCK_DRAWS})) AS d), (SELECT unnest(range(0, 64)) AS k) WHERE k < nb), wt AS (SELECT d, block, CAST(count(*) AS DOUBLE) AS w FROM pk JOIN bl USING (i) GROUP BY ALL), rk AS (SELECT d, w, sum(w) OVER (PARTITION BY d ORDER BY o) - sum(w) OVER (PARTITION BY d, o) / 2 AS a, sum(w) OVER (PARTITION BY d ORDER BY p) - sum(w) OVER (PARTITION BY d, p) / 2 AS b FROM h JOIN wt USING (block)), dv AS (SELECT d, w, a - sum(w * a) OVER (PARTITION BY d) / sum(w) OVER (PARTITION BY d) AS a, b - sum(w * b) OVER (PARTITION BY d) / sum(w) OVER (PARTITION BY d) AS b FROM rk), rs AS (SELECT d, sum(w * a * b) / nullif(sqrt(sum(w * a * a) * sum(w * b * b)), 0) AS rho FROM dv GROUP BY d)"


@QUERIES.add("eva23_hindcast_metrics", f"WITH {HIND}, {BLOCKS}, ci AS (SELECT count(rho) AS valid_draws, round(quantile_cont(rho, {(1 - LEVEL) / 2}), 6) AS rho_low, round(quantile_cont(rho, {1 - (1 - LEVEL) / 2}), 6) AS rho_high FROM rs) SELECT count(*) AS n, count(DISTINCT block) AS blocks, round(avg(abs(o - p)), 4) AS mae, round(avg(p - o), 4) AS bias, round(sum(p) / sum(o), 6) AS ratio, round(corr(a, b), 6) AS rho, any_value(rho_low) AS rho_low, any_value(rho_high) AS rho_high, any_value(valid_draws) AS valid_draws, round(count(*) FILTER (ro <= k AND rp <= k) / max(k), 6) AS top_recall FROM m, ci")
def eva23(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of predicted volumes, their rank correlation with its interval over draws of whole blocks (years), and how much of
    the fifth with most volume is predicted to be in it."""
    o = read(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("o"), (200000 + (F.col("o_custkey") % 100) * 1000.0).alias("p"), F.year("o_orderdate").alias("block"))
    r = rank.ranked(rank.ranked(o, [F.desc("o"), "id"], "ro"), [F.desc("p"), "id"], "rp").crossJoin(F.broadcast(o.agg(F.ceil(F.count("*") * F.lit(0.2)).alias("k"))))
    top = r.agg(r6(F.count_if((F.col("ro") <= F.col("k")) & (F.col("rp") <= F.col("k"))) / F.max("k")).alias("top_recall"))
    plain = o.agg(F.count("*").alias("n"), F.count_distinct("block").alias("blocks"), F.round(F.avg(F.abs(F.col("o") - F.col("p"))), 4).alias("mae"), F.round(F.avg(F.col("p") - F.col("o")), 4).alias("bias"), r6(F.sum("p") / F.sum("o")).alias("ratio"))
    return plain.crossJoin(rank.spearman(o, "o", "p").select(r6("rho").alias("rho"))).crossJoin(block_interval(o, BLOCK_DRAWS, BLOCK_SEED, LEVEL)).crossJoin(top)


def block_interval(o: DataFrame, draws: int, seed: int, level: float) -> DataFrame:
    """(rho_low, rho_high, valid_draws): the middle share of rank correlations of o and p over draws of as many blocks as there
    are, with repeats. Null bounds below two blocks or without a valid draw."""
    names = sorted(r.block for r in o.dropna(subset=["block"]).select("block").distinct().limit(65).collect())
    chosen = [[names[int(dw.uniform_of(seed, d * len(names) + k + 1) * len(names))] for k in range(len(names))] for d in range(draws)] if len(names) > 1 else []
    rho = [x for x in rank.block_spearman(o, "o", "p", "block", chosen) if x is not None]
    cut = lambda q: round(float(np.quantile(rho, q)), 6) if rho else None
    return o.sparkSession.createDataFrame([(cut((1 - level) / 2), cut(1 - (1 - level) / 2), len(rho))], "rho_low double, rho_high double, valid_draws long")


@QUERIES.add("eva24_label_audit")
def eva24(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled recall of the model on labels as they are, with corrections (each ninth row's label off), and without a block."""
    c = saved(cells(spark, sf), "cells")
    fixed = c.withColumn("y", F.when((F.col("i") + F.col("j")) % 9 == 0, 0).otherwise(F.col("y")))
    out = None
    for name, x in (("as given", c), ("corrected", fixed), ("without block 0", c.filter("block <> 0"))):
        r = block_captures(scored(spark, sf, saved(x, "cells"))).filter("positives > 0 AND arm = 'model'").agg(r6(F.sum("captured") / F.sum("positives")).alias("recall")).select(F.lit(name).alias("scenario"), "recall")
        out = r if out is None else out.union(r)
    return out


@QUERIES.add("eva25_leakage_shares", "SELECT c_mktsegment AS source, round(count(*) FILTER (c_acctbal > 9000) / CAST((SELECT count(*) FROM customer WHERE c_acctbal > 9000) AS DOUBLE), 6) AS positives, round(count(*) FILTER (c_acctbal <= 9000) / CAST((SELECT count(*) FROM customer WHERE c_acctbal <= 9000) AS DOUBLE), 6) AS background FROM customer GROUP BY 1")
def eva25(spark: SparkSession, sf: str) -> DataFrame:
    g = read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("source")).agg(F.count_if(F.col("c_acctbal") > 9000).alias("p"), F.count_if(F.col("c_acctbal") <= 9000).alias("b"))
    return g.crossJoin(g.agg(F.sum("p").alias("all_p"), F.sum("b").alias("all_b"))).select("source", r6(F.col("p") / F.col("all_p")).alias("positives"), r6(F.col("b") / F.col("all_b")).alias("background"))


@QUERIES.add("eva26_captured_by_block", BASE_CAP + " SELECT block, arm, positives, round(captured, 6) AS captured FROM cap")
def eva26(spark: SparkSession, sf: str) -> DataFrame:
    return baseline_captures(spark, sf).select("block", "arm", "positives", r6("captured").alias("captured"))


@QUERIES.add("eva27_complete_cases", "SELECT p_partkey AS id, concat_ws('|', CASE WHEN p_size % 7 = 0 THEN 'size' END, CASE WHEN p_partkey % 4 = 0 THEN 'price' END) AS missing, p_size % 7 <> 0 AND p_partkey % 4 <> 0 AS complete FROM part")
def eva27(spark: SparkSession, sf: str) -> DataFrame:
    missing = F.concat_ws("|", F.when(F.col("p_size") % 7 == 0, "size"), F.when(F.col("p_partkey") % 4 == 0, "price"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), missing.alias("missing"), (missing == "").alias("complete"))


@QUERIES.add("eva28_region_checklist", "WITH g AS (SELECT n_regionkey AS region, count(*) FILTER (c_acctbal > 0) AS pts, count(DISTINCT n_nationkey) AS subs FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT region, concat_ws('|', CASE WHEN pts < 300 THEN 'points' END, CASE WHEN subs < 6 THEN 'sub_districts' END, CASE WHEN region = 4 THEN 'licence' END) AS failed FROM g")
def eva28(spark: SparkSession, sf: str) -> DataFrame:
    j = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = j.groupBy(F.col("n_regionkey").alias("region")).agg(F.count_if(F.col("c_acctbal") > 0).alias("pts"), F.count_distinct("n_nationkey").alias("subs"))
    return g.select("region", F.concat_ws("|", F.when(F.col("pts") < 300, "points"), F.when(F.col("subs") < 6, "sub_districts"), F.when(F.col("region") == 4, "licence")).alias("failed"))


STRATA = ("top", "middle", "lower", "flagged")


@QUERIES.add("ver1_stratified_sample", "WITH p AS (SELECT p_partkey AS id, p_size = 1 AS flag, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, count(*) OVER () AS n FROM part), a AS (SELECT id, 'top' AS stratum, rank FROM p WHERE rank <= 20 ORDER BY sha256('407|top|' || id), id LIMIT 10), b AS (SELECT id, 'middle' AS stratum, rank FROM p WHERE rank > 20 AND rank <= 20 + (n - 19) // 2 ORDER BY sha256('407|middle|' || id), id LIMIT 10), c AS (SELECT id, 'lower' AS stratum, rank FROM p WHERE rank > 20 + (n - 19) // 2 ORDER BY sha256('407|lower|' || id), id LIMIT 10), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), d AS (SELECT id, 'flagged' AS stratum, rank FROM p WHERE flag AND id NOT IN (SELECT id FROM u) ORDER BY sha256('407|flagged|' || id), id LIMIT 5) SELECT * FROM u UNION ALL SELECT * FROM d")
def ver1(spark: SparkSession, sf: str) -> DataFrame:
    """(id, stratum, rank): strata in order, each by the hash of seed, stratum and id, without those chosen before."""
    p = rank.ranked(read(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", (F.col("p_size") == 1).alias("flag")), [F.desc("p_retailprice"), "id"])
    n = p.count()
    middle = 20 + (n - 20 + 1) // 2
    pool = {"top": F.col("rank") <= 20, "middle": (F.col("rank") > 20) & (F.col("rank") <= middle), "lower": F.col("rank") > middle, "flagged": F.col("flag")}
    chosen = None
    for s, quota in zip(STRATA, (10, 10, 10, 5)):
        free = p.filter(pool[s]) if chosen is None else p.filter(pool[s]).join(chosen.select("id"), "id", "left_anti")
        take = free.orderBy(F.sha2(F.concat_ws("|", F.lit("407"), F.lit(s), F.col("id").cast("string")), 256), "id").limit(quota).select("id", F.lit(s).alias("stratum"), "rank")
        chosen = saved(take if chosen is None else chosen.union(take), "sample")
    return chosen


OBS = "ob AS (SELECT conv_id AS site, turn, CASE WHEN turn % 7 = 6 THEN 'declined' WHEN turn % 5 = 4 THEN 'unreachable' ELSE 'completed' END AS contact, CASE WHEN conv_id % 11 = 0 THEN NULL ELSE conv_id % 13 = 0 END AS absent, CASE WHEN turn % 4 = 3 THEN NULL ELSE conv_id % 5 = 0 END AS undocumented, role = 'system' AS negligible FROM conversations), oc AS (SELECT *, CASE WHEN contact <> 'completed' THEN contact WHEN absent IS NULL THEN 'unknown' WHEN absent THEN 'node_absent' WHEN undocumented IS NULL THEN 'unknown' WHEN undocumented THEN 'undocumented_supply' WHEN negligible THEN 'requirement_negligible' ELSE 'confirmed' END AS outcome FROM ob)"


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """(site, turn, contact, outcome): field checks with the first failed or unknown fact, in order, as the outcome."""
    c = read(spark, sf, "conversations")
    contact = F.when(F.col("turn") % 7 == 6, "declined").when(F.col("turn") % 5 == 4, "unreachable").otherwise("completed")
    facts = {"node_absent": F.when(F.col("conv_id") % 11 != 0, F.col("conv_id") % 13 == 0), "undocumented_supply": F.when(F.col("turn") % 4 != 3, F.col("conv_id") % 5 == 0), "requirement_negligible": F.col("role") == "system"}
    return c.select(F.col("conv_id").alias("site"), "turn", "role", contact.alias("contact"), rules.ordered_outcome(contact, facts).alias("outcome"))


@QUERIES.add("ver2_outcome_classes", f"WITH {OBS} SELECT site, turn, outcome FROM oc")
def ver2(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).select("site", "turn", "outcome")


Z2 = 1.959963984540054**2


@QUERIES.add("ver3_group_summary", f"WITH {OBS}, g AS (SELECT turn % 3 AS grp, count(*) AS n, count(*) FILTER (outcome IN ('confirmed', 'node_absent', 'undocumented_supply', 'requirement_negligible')) AS r, count(*) FILTER (outcome = 'confirmed') AS k FROM oc GROUP BY 1) SELECT grp, n, r AS resolved, k AS confirmed, round((k / CAST(r AS DOUBLE) + {Z2!r}::DOUBLE / (2 * r) - sqrt({Z2!r}::DOUBLE) * sqrt(k / CAST(r AS DOUBLE) * (1 - k / CAST(r AS DOUBLE)) / r + {Z2!r}::DOUBLE / (4 * r * r))) / (1 + {Z2!r}::DOUBLE / r), 6) AS low, round(k / CAST(n AS DOUBLE), 6) AS bound_low, round((k + n - r) / CAST(n AS DOUBLE), 6) AS bound_high, CASE WHEN n = r THEN round(k / CAST(n AS DOUBLE), 6) END AS precision_at_k FROM g")
def ver3(spark: SparkSession, sf: str) -> DataFrame:
    done = F.col("outcome").isin("confirmed", "node_absent", "undocumented_supply", "requirement_negligible")
    g = observations(spark, sf).groupBy((F.col("turn") % 3).alias("grp")).agg(F.count("*").alias("n"), F.count_if(done).alias("resolved"), F.count_if(F.col("outcome") == "confirmed").alias("confirmed"))
    k, n, r = F.col("confirmed"), F.col("n"), F.col("resolved")
    return g.select("grp", "n", "resolved", "confirmed", r6(F.when(r > 0, rules.wilson(k, r, -1))).alias("low"), r6(k / n).alias("bound_low"), r6((k + n - r) / n).alias("bound_high"), r6(F.when(n == r, k / n)).alias("precision_at_k"))


@QUERIES.add("ver4_arm_comparison", f"WITH {OBS}, f AS (SELECT site, count(*) FILTER (outcome = 'confirmed') AS k, bool_or(outcome = 'undocumented_supply') AS u, bool_or(outcome = 'requirement_negligible') AS q FROM oc WHERE contact = 'completed' GROUP BY site) SELECT count(*) AS common, count(*) FILTER (k > 0 AND site % 2 = 0) AS arm_a, count(*) FILTER (k > 0 AND site % 3 = 0) AS arm_b, count(*) FILTER (u AND q) AS both_failures FROM f")
def ver4(spark: SparkSession, sf: str) -> DataFrame:
    f = observations(spark, sf).filter("contact = 'completed'").groupBy("site").agg(F.count_if(F.col("outcome") == "confirmed").alias("k"), F.bool_or(F.col("outcome") == "undocumented_supply").alias("u"), F.bool_or(F.col("outcome") == "requirement_negligible").alias("q"))
    return f.agg(F.count("*").alias("common"), F.count_if((F.col("k") > 0) & (F.col("site") % 2 == 0)).alias("arm_a"), F.count_if((F.col("k") > 0) & (F.col("site") % 3 == 0)).alias("arm_b"), F.count_if(F.col("u") & F.col("q")).alias("both_failures"))


@QUERIES.add("ver5_desk_records", f"WITH {OBS} SELECT site, count(*) FILTER (role = 'user') AS desk, count(*) FILTER (role <> 'user') AS phone, count(*) FILTER (turn = 0) AS before_freeze FROM (SELECT conv_id AS site, turn, role FROM conversations) GROUP BY site")
def ver5(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).groupBy("site").agg(F.count_if(F.col("role") == "user").alias("desk"), F.count_if(F.col("role") != "user").alias("phone"), F.count_if(F.col("turn") == 0).alias("before_freeze"))


@QUERIES.add("ver6_record_checks", "SELECT 'unknown_target' AS fault, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'duplicate', count(*) FROM (SELECT 1 FROM conversations GROUP BY conv_id, role, turn HAVING count(*) > 1)")
def ver6(spark: SparkSession, sf: str) -> DataFrame:
    c, s = read(spark, sf, "conversations"), read(spark, sf, "supplier")
    lost = c.join(s, c.conv_id == s.s_suppkey, "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown_target").alias("fault"), "n")
    return lost.union(c.groupBy("conv_id", "role", "turn").agg(F.count("*").alias("k")).filter("k > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate").alias("fault"), "n"))


@QUERIES.add("qua2_run_verification", "SELECT unnest(['conservation', 'over_limit', 'ranks']) AS \"check\", 0::BIGINT AS faults")
def qua2(spark: SparkSession, sf: str) -> DataFrame:
    """(check, faults) of an allocation run: conservation for each region, no node over its limit, ranks without gaps."""
    from sitewright.operators.allocation import bounded_equal_shares
    from sitewright.plans.supply import regions

    totals, limits = regions(spark, sf)
    shares, balance = bounded_equal_shares(totals, limits)
    b = balance.join(totals, "region").agg(F.count_if(F.abs(F.col("assigned") + F.col("unserved") - F.col("total")) > 1e-6).alias("faults")).select(F.lit("conservation").alias("check"), "faults")
    o = shares.join(limits, ["region", "node"]).agg(F.count_if(F.col("share") > F.col("limit") + 1e-9).alias("faults")).select(F.lit("over_limit").alias("check"), "faults")
    r = rank.ranked(shares.filter("share IS NOT NULL"), [F.desc("share"), "node"]).agg(((F.max("rank") != F.count("*")) | (F.count_distinct("rank") != F.count("*"))).cast("long").alias("faults")).select(F.lit("ranks").alias("check"), "faults")
    return b.union(o).union(r)


@QUERIES.add("qua4_bundle_integrity", "SELECT 'nation_region' AS rule, count(*) FILTER (n_regionkey NOT IN (SELECT r_regionkey FROM region)) AS faults FROM nation UNION ALL SELECT 'supplier_nation', count(*) FILTER (s_nationkey NOT IN (SELECT n_nationkey FROM nation)) FROM supplier UNION ALL SELECT 'customer_nation', count(*) FILTER (c_nationkey NOT IN (SELECT n_nationkey FROM nation)) FROM customer UNION ALL SELECT 'line_part', count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part)) FROM lineitem")
def qua4(spark: SparkSession, sf: str) -> DataFrame:
    rules = (("nation_region", "nation", "n_regionkey", "region", "r_regionkey"), ("supplier_nation", "supplier", "s_nationkey", "nation", "n_nationkey"), ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"), ("line_part", "lineitem", "l_partkey", "part", "p_partkey"))
    out = None
    for name, a, ka, b, kb in rules:
        left, right = read(spark, sf, a), read(spark, sf, b)
        r = left.join(right, left[ka] == right[kb], "left_anti").agg(F.count("*").alias("faults")).select(F.lit(name).alias("rule"), "faults")
        out = r if out is None else out.union(r)
    return out


@QUERIES.add("qua5_lineage_trace", "SELECT o_orderkey, o_custkey, n_name, r_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey = 42")
def qua5(spark: SparkSession, sf: str) -> DataFrame:
    """All that one node's figures came from; the filter reaches the scans."""
    o, c, n, r, l = (read(spark, sf, t) for t in ("orders", "customer", "nation", "region", "lineitem"))
    lines = l.filter("l_orderkey = 42").agg(F.count("*").alias("lines"))
    one = o.filter("o_orderkey = 42").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return one.crossJoin(lines).select("o_orderkey", "o_custkey", "n_name", "r_name", "lines")


@QUERIES.add("qua6_package_checks", sql("s", "SELECT 'repeated_id' AS rule, count(*) - count(DISTINCT id) AS faults FROM s UNION ALL SELECT 'outside_coverage', count(*) FILTER (x > 20000) FROM s UNION ALL SELECT 'range', 0::BIGINT"))
def qua6(spark: SparkSession, sf: str) -> DataFrame:
    s = sites(spark, sf)
    one = s.agg((F.count("*") - F.count_distinct("id")).alias("faults")).select(F.lit("repeated_id").alias("rule"), "faults")
    out = s.agg(F.count_if(F.col("x") > 20000).alias("faults")).select(F.lit("outside_coverage").alias("rule"), "faults")
    low, mid, high = F.col("x") * 0.8, F.col("x"), F.col("x") * 1.2
    return one.union(out).union(s.agg(F.count_if((low > mid) | (mid > high)).alias("faults")).select(F.lit("range").alias("rule"), "faults"))
