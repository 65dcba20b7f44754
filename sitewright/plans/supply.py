"""Queries over allocation, energy models, simulation and sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewright.functions import draws as dw
from sitewright.functions import energy as en
from sitewright.functions import rules
from sitewright.functions.geo import distance
from sitewright.operators import rank, spatial
from sitewright.operators.allocation import bounded_equal_shares, nearest_first
from sitewright.operators.stress import MEASURES, stress
from sitewright.sources.tables import Queries, buildings, read, saved, sites, sql

QUERIES = Queries()
r6 = lambda c: F.round(c, 6)

LIMITS = """t AS (SELECT o_custkey // 50 AS region, sum(o_totalprice) / 1000000.0 AS total FROM orders GROUP BY 1), l AS (SELECT p_partkey // 50 AS region, p_partkey AS node, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) / 4 END AS lim FROM part WHERE NOT (p_partkey // 50 % 4 = 0 AND p_size % 7 = 0)),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY region) AS n, coalesce(sum(lim) OVER (PARTITION BY region ORDER BY lim NULLS LAST, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l JOIN t USING (region) WINDOW w AS (PARTITION BY region ORDER BY lim NULLS LAST, node)),
v AS (SELECT *, greatest(0, (total - s) / (n - i + 1)) AS level FROM o), a AS (SELECT region, min_by(level, i) AS lv FROM v WHERE lim IS NULL OR lim >= level GROUP BY region),
sh AS (SELECT region, node, total, CASE WHEN lim IS NULL THEN lv WHEN lv IS NULL THEN lim ELSE least(lim, lv) END AS share FROM v LEFT JOIN a USING (region))"""


def regions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Totals by fifty customers and limits of fifty parts: regions grow in number with the tables. A fourth have no node without a bound."""
    t = read(spark, sf, "orders").groupBy(F.floor(F.col("o_custkey") / 50).alias("region")).agg((F.sum("o_totalprice") / 1000000.0).alias("total"))
    p = read(spark, sf, "part").filter("NOT (floor(p_partkey / 50) % 4 = 0 AND p_size % 7 = 0)")
    return t, p.select(F.floor(F.col("p_partkey") / 50).alias("region"), F.col("p_partkey").alias("node"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 4).alias("limit"))


@QUERIES.add("alo1_bounded_equal_shares", f"WITH {LIMITS} SELECT region, node, round(share, 6) AS share FROM sh")
def alo1(spark: SparkSession, sf: str) -> DataFrame:
    return bounded_equal_shares(*regions(spark, sf))[0].withColumn("share", r6("share"))


LIMIT_P = {"storage_fraction": 0.6, "operating_days": 330.0, "residence_days": 45.0, "processing_fraction": 0.8}


@QUERIES.add("alo2_annual_limit", "SELECT p_partkey AS node, CASE WHEN p_size % 7 <> 0 THEN round(p_retailprice * 0.6::DOUBLE * 330 / (45 * 0.8::DOUBLE), 6) END AS annual FROM part")
def alo2(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("node"), r6(en.annual_limit(F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")), LIMIT_P)).alias("annual"))


@QUERIES.add("alo3_balance", f"WITH {LIMITS} SELECT t.region, count(node) AS nodes, round(coalesce(sum(share), 0), 6) AS assigned, round(greatest(0, any_value(t.total) - coalesce(sum(share), 0)), 6) AS unserved, CASE WHEN any_value(t.total) - coalesce(sum(share), 0) > 1e-9 THEN CASE WHEN count(node) = 0 THEN 'no_candidate' ELSE 'capacity_exhausted' END END AS reason FROM t LEFT JOIN sh ON t.region = sh.region GROUP BY t.region")
def alo3(spark: SparkSession, sf: str) -> DataFrame:
    totals, limits = regions(spark, sf)
    shares, balance = bounded_equal_shares(totals, limits)
    n = shares.groupBy("region").agg(F.count("*").alias("nodes"))
    b = balance.join(n, "region", "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)))
    return b.select("region", "nodes", r6("assigned").alias("assigned"), r6("unserved").alias("unserved"), F.when(F.col("unserved") > 1e-9, F.when(F.col("nodes") == 0, "no_candidate").otherwise("capacity_exhausted")).alias("reason"))


def flows(spark: SparkSession, sf: str, unknown: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Origins (buildings), nodes (sites; a seventh with unknown capacity) and edges within 4 km. unknown: exclude or unbounded."""
    o = buildings(spark, sf).select(F.col("id").alias("origin"), F.round("roof").alias("mass"))
    cap = F.when(F.col("id") % 7 != 0, (2000 + F.col("id") % 13 * 300).cast("double"))
    c = sites(spark, sf).select(F.col("id").alias("node"), cap.alias("capacity"))
    c = c.filter("capacity IS NOT NULL") if unknown == "exclude" else c
    e = spatial.pairs_within(buildings(spark, sf), sites(spark, sf), 4000).select(F.col("id").alias("origin"), F.col("other").alias("node"), F.round(F.col("d") / 66.0, 3).alias("minutes"))
    return e, o, c


@QUERIES.add("alo4_nearest_first")
def alo4(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_first(*flows(spark, sf, "exclude")).select("origin", "node", r6("tonnes").alias("tonnes"))


@QUERIES.add("alo5_balance_reasons")
def alo5(spark: SparkSession, sf: str) -> DataFrame:
    """Per origin what is assigned and why the rest isn't; assigned and unserved sum to the mass."""
    e, o, c = flows(spark, sf, "exclude")
    got = nearest_first(e, o, c).groupBy("origin").agg(F.sum("tonnes").alias("assigned"))
    near = e.groupBy("origin").agg(F.count("*").alias("near"), F.count_if(F.col("node") % 7 != 0).alias("known"))
    b = o.join(got, "origin", "left").join(near, "origin", "left").withColumn("assigned", F.coalesce("assigned", F.lit(0.0))).withColumn("unserved", F.col("mass") - F.coalesce("assigned", F.lit(0.0)))
    reason = F.when(F.col("mass").isNull(), "production_unknown").when(F.col("unserved") <= 0, None).when(F.col("near").isNull(), "no_reachable_candidate").when(F.col("known") == 0, "candidate_capacity_unknown").otherwise("capacity_exhausted")
    return b.select("origin", "mass", "assigned", "unserved", reason.alias("reason"))


@QUERIES.add("alo6_unknown_capacity_policy", sql("s", "SELECT 'exclude_and_flag' AS policy, count(*) FILTER (id % 7 <> 0) AS nodes, count(*) FILTER (id % 7 = 0) AS flagged FROM s UNION ALL SELECT 'unbounded_and_flag', count(*), count(*) FILTER (id % 7 = 0) FROM s"))
def alo6(spark: SparkSession, sf: str) -> DataFrame:
    out = [flows(spark, sf, u)[2].agg(F.count("*").alias("nodes")).select(F.lit(name).alias("policy"), "nodes") for u, name in (("exclude", "exclude_and_flag"), ("unbounded", "unbounded_and_flag"))]
    flagged = sites(spark, sf).agg(F.count_if(F.col("id") % 7 == 0).alias("flagged"))
    return out[0].union(out[1]).crossJoin(flagged)


@QUERIES.add("alo7_origin_mass", "WITH p AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS t FROM orders), n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS parent, n AS origins, round(t / n, 6) AS each_mass, round(t / n * n, 4) AS total FROM p JOIN n ON o_orderkey = l_orderkey")
def alo7(spark: SparkSession, sf: str) -> DataFrame:
    """A parent's mass over its origins by equal fractions; unknown parents stay unknown, and the sum is the parent's."""
    p = read(spark, sf, "orders").select(F.col("o_orderkey").alias("parent"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("t"))
    n = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("parent")).agg(F.count("*").alias("origins"))
    each = F.col("t") / F.col("origins")
    return p.join(n, "parent").select("parent", "origins", r6(each).alias("each_mass"), F.round(each * F.col("origins"), 4).alias("total"))


def _model(name: str, f, extra: str | None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = f(F.col("o_totalprice") * 0.0101010101, en.central(name), F.lit(24.0))
        more = [r6(out[extra]).alias(extra)] if extra else []
        return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), r6(out["kwh_day"]).alias("kwh_day"), r6(out["kw"]).alias("kw"), r6(out["throughput_t_day"]).alias("throughput_t_day"), *more)

    return run


A = "(o_totalprice * 0.0101010101::DOUBLE)"
QUERIES["dom1_potato_storage"] = (_model("potato_storage", en.potato_storage, "stored_t"), f"SELECT o_orderkey AS id, round(k, 6) AS kwh_day, round(k / 16, 6) AS kw, round(i, 6) AS throughput_t_day, round(i * 30, 6) AS stored_t FROM (SELECT *, (i * 1000 * 3.6::DOUBLE * 17 / 3600 + i * 30 * 0.2::DOUBLE) / 2.2::DOUBLE AS k FROM (SELECT *, {A} * 0.2::DOUBLE / 30 AS i FROM orders))")
QUERIES["dom2_milk_cooling"] = (_model("milk_cooling", en.milk_cooling, "litres_day"), f"SELECT o_orderkey AS id, round(k, 6) AS kwh_day, round(k / 10, 6) AS kw, round(g / 1000, 6) AS throughput_t_day, round(g / 1.03::DOUBLE, 6) AS litres_day FROM (SELECT *, g * 3.93::DOUBLE * 28 / 3600 * 1.1::DOUBLE / 2.5::DOUBLE AS k FROM (SELECT *, {A} * 1000 / 365 * 1.25::DOUBLE AS g FROM orders))")
QUERIES["dom3_maize_milling"] = (_model("maize_milling", en.maize_milling, None), f"SELECT o_orderkey AS id, round({A} / 300 * 25, 6) AS kwh_day, round({A} / 300 * 25 / 8, 6) AS kw, round({A} / 300, 6) AS throughput_t_day FROM orders")
QUERIES["dom4_maize_drying"] = (_model("maize_drying", en.maize_drying, None), f"SELECT o_orderkey AS id, round({A} / 2 / 60 * 8, 6) AS kwh_day, round({A} / 2 / 60 * 8 / 12, 6) AS kw, round({A} / 2 / 60, 6) AS throughput_t_day FROM orders")

AERATION = {"processing_fraction": 0.8, "residence_days": 45.0, "operating_days": 330.0, "simultaneous_fraction": 0.7, "airflow_per_tonne": 0.0018, "static_pressure": 600.0, "fan_efficiency": 0.55, "motor_efficiency": 0.9, "auxiliary_power": 2.0, "cycle_hours": 120.0}


@QUERIES.add("dom5_grain_aeration", "SELECT o_orderkey AS id, round(t * 0.8::DOUBLE * 45 / 330, 6) AS inventory_tonnes, round(f, 6) AS fan_kw, round(f + CASE WHEN t > 0 THEN 2 WHEN t <= 0 THEN 0 END, 6) AS electrical_kw, round((f + CASE WHEN t > 0 THEN 2 WHEN t <= 0 THEN 0 END) * 120, 4) AS kwh_cycle FROM (SELECT *, t * 0.8::DOUBLE * 45 / 330 * 0.7::DOUBLE * 0.0018::DOUBLE * 600 / (1000 * 0.55::DOUBLE * 0.9::DOUBLE) AS f FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 10 END AS t FROM orders))")
def dom5(spark: SparkSession, sf: str) -> DataFrame:
    a = en.aeration(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 10), AERATION)
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), *[r6(a[k]).alias(k) for k in ("inventory_tonnes", "fan_kw", "electrical_kw")], F.round(a["kwh_cycle"], 4).alias("kwh_cycle"))


GAPS = "g AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'no_documented_asset' WHEN 1 THEN 'documented_known_capacity' ELSE 'documented_unknown_capacity' END AS state, CASE WHEN o_orderkey % 3 = 1 THEN 250000.0::DOUBLE END AS cap, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS req FROM orders)"


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(k.alias("id"), F.when(k % 3 == 0, "no_documented_asset").when(k % 3 == 1, "documented_known_capacity").otherwise("documented_unknown_capacity").alias("state"), F.when(k % 3 == 1, 250000.0).alias("cap"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("req"))


@QUERIES.add("dom6_supply_gap_scenario", f"WITH {GAPS} SELECT id, round(CASE WHEN cap IS NOT NULL THEN cap - req END, 4) AS margin, CASE WHEN req IS NULL OR state LIKE '%unknown%' THEN 'verify_first' WHEN state LIKE 'no_%' THEN 'undocumented_supply' WHEN cap < req THEN 'undersized' END AS bucket, CASE WHEN req IS NULL THEN 'unknown' WHEN state LIKE '%known_cap%' AND state NOT LIKE '%unknown%' AND cap >= req THEN 'unflagged' ELSE 'flagged' END AS status FROM g")
def dom6(spark: SparkSession, sf: str) -> DataFrame:
    g = en.gap(F.col("state"), F.col("cap"), F.col("req"))
    return gaps(spark, sf).select("id", F.round(g["margin"], 4).alias("margin"), g["bucket"].alias("bucket"), g["status"].alias("status"))


@QUERIES.add("dom6_supply_gap_registry", f"WITH {GAPS} SELECT id, round(CASE WHEN cap IS NOT NULL THEN cap - req END, 4) AS margin, CASE WHEN state LIKE '%unknown%' THEN 'verify_first' WHEN req IS NULL THEN NULL WHEN state LIKE 'no_%' THEN 'undocumented_supply' WHEN cap < req THEN 'undersized' END AS bucket, CASE WHEN state LIKE '%unknown%' THEN 'flagged' WHEN req IS NULL THEN 'unknown' WHEN state LIKE 'no_%' OR cap < req THEN 'flagged' ELSE 'unflagged' END AS status FROM g")
def dom6b(spark: SparkSession, sf: str) -> DataFrame:
    g = en.gap(F.col("state"), F.col("cap"), F.col("req"), None)
    return gaps(spark, sf).select("id", F.round(g["margin"], 4).alias("margin"), g["bucket"].alias("bucket"), g["status"].alias("status"))


@QUERIES.add("dom7_solar_size", "SELECT o_orderkey AS id, round(o_totalprice / (4.2::DOUBLE * 0.75::DOUBLE), 6) AS kwp, round(o_totalprice * 1.4::DOUBLE / (4.2::DOUBLE * 0.75::DOUBLE), 6) AS kwp_p95 FROM orders")
def dom7(spark: SparkSession, sf: str) -> DataFrame:
    size = lambda kwh: kwh / (F.lit(4.2) * F.lit(en.SHARED["pv_performance_ratio"][1]))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), r6(size(F.col("o_totalprice"))).alias("kwp"), r6(size(F.col("o_totalprice") * 1.4)).alias("kwp_p95"))


@QUERIES.add("dom8_demand", "SELECT c_custkey AS id, round(abs(c_acctbal) * 0.26::DOUBLE * 1.0::DOUBLE * 0.15::DOUBLE * [0.8, 0.6, 0.4, 0.3][c_nationkey % 4 + 1]::DOUBLE, 6) AS tonnes FROM customer")
def dom8(spark: SparkSession, sf: str) -> DataFrame:
    """People times tonnes a head, the local factor, the captured share and the kind's multiplier."""
    kind = F.get(F.array(*[F.lit(v) for v in (0.8, 0.6, 0.4, 0.3)]), F.col("c_nationkey") % 4)
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), r6(F.abs("c_acctbal") * 0.26 * 1.0 * 0.15 * kind).alias("tonnes"))


DRIVERS = ["capture_share", "max_travel_min", "local_variation", "cop", "persons_per_building"]
GRIDS = ["grid_near", "grid_mid", "grid_not_mapped", "unknown"]


@QUERIES.add("dom9_question", sql("s", "SELECT id, main, concat_ws('|', CASE WHEN main <> 'volume' THEN 'volume' END, CASE id % 4 WHEN 0 THEN 'connection size and outages' WHEN 1 THEN 'distance to a connection and plans' WHEN 2 THEN 'what powers the site' END, CASE WHEN id % 3 = 0 THEN 'other places nearby' END) AS more FROM (SELECT id, CASE WHEN kind >= 6 THEN 'whether the place exists' ELSE ['volume', 'how far farmers travel', 'local production against the average', 'volume', 'whether buildings are farming homes'][id % 5 + 1] END AS main FROM s)"))
def dom9(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    k = F.col("id")
    q = rules.question(F.col("kind") < 6, at(DRIVERS, k % 5), at(GRIDS, k % 4), F.when(k % 3 == 0, "thin").otherwise("well"))
    return sites(spark, sf).select("id", q.alias("q")).select("id", "q.main", F.concat_ws("|", "q.more").alias("more"))


@QUERIES.add("dom10_evidence_labels", sql("b s near", ", n AS (SELECT other AS id, count(*) AS n FROM near WHERE d < 6000 GROUP BY 1) SELECT s.id, CASE WHEN kind < 6 THEN 'OBSERVED' ELSE 'INFERRED' END AS location, CASE WHEN s.id % 7 = 0 OR n.n IS NULL THEN 'UNKNOWN' ELSE 'ESTIMATED' END AS demand FROM s LEFT JOIN n USING (id)").replace(" , n AS", ", n AS"))
def dom10(spark: SparkSession, sf: str) -> DataFrame:
    """A mapped site is observed; its demand is unknown without people nearby or a figure a head (here missing for a seventh)."""
    people = spatial.nearest(buildings(spark, sf), sites(spark, sf), 6000, 1500).filter("other IS NOT NULL").groupBy(F.col("other").alias("id")).agg(F.count("*").alias("people"))
    s = sites(spark, sf).join(people, "id", "left")
    labels = rules.evidence_labels(F.col("kind") < 6, F.when(F.col("id") % 7 != 0, 0.26), F.col("people"))
    return s.select("id", labels.alias("l")).select("id", "l.*")


@QUERIES.add("dom11_district_production", "WITH d AS (SELECT c_nationkey AS district, n_regionkey AS province, sum(abs(c_acctbal)) AS area, CASE WHEN c_nationkey % 6 <> 0 THEN 1000.0 + c_nationkey * 10 END AS y FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), f AS (SELECT *, coalesce(y, sum(area * y) OVER (PARTITION BY province) / sum(area) FILTER (y IS NOT NULL) OVER (PARTITION BY province)) AS yield FROM d) SELECT district, y IS NULL AS imputed, round(CAST(yield AS DOUBLE), 6) AS yield, round(CAST(area * yield / sum(area * yield) OVER () * 500000 AS DOUBLE), 4) AS tonnes FROM f")
def dom11(spark: SparkSession, sf: str) -> DataFrame:
    """Area times yield as a share of the national total; an unreadable yield takes its province's area-weighted mean."""
    j = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    d = j.groupBy(F.col("c_nationkey").alias("district"), F.col("n_regionkey").alias("province")).agg(F.sum(F.abs("c_acctbal")).alias("area")).withColumn("y", F.when(F.col("district") % 6 != 0, 1000.0 + F.col("district") * 10))
    w = Window.partitionBy("province")
    mean = F.sum(F.col("area") * F.col("y")).over(w) / F.sum(F.when(F.col("y").isNotNull(), F.col("area"))).over(w)
    f = d.withColumn("yield", F.coalesce("y", mean))
    total = f.agg(F.sum(F.col("area") * F.col("yield")).alias("t"))
    return f.crossJoin(F.broadcast(total)).select("district", F.col("y").isNull().alias("imputed"), r6("yield").alias("yield"), F.round(F.col("area") * F.col("yield") / F.col("t") * 500000, 4).alias("tonnes"))


@QUERIES.add("sim1_counter_generator", f"SELECT o_orderkey AS seed, k, {dw.sql_uniform('o_orderkey', 'k')} AS u FROM orders, (SELECT unnest(range(1, 4)) AS k)")
def sim1(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "orders").select(F.col("o_orderkey").alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<long>")).alias("k"))
    return s.withColumn("u", dw.uniform(F.col("seed"), F.col("k")))


TRI = "CASE WHEN u < 1.0 / 3 THEN 60 + sqrt(u * 90 * 30) ELSE 150 - sqrt((1 - u) * 90 * 60) END"


@QUERIES.add("sim2_triangular", f"SELECT seed, round({TRI}, 6) AS v, 4.0::DOUBLE AS fixed FROM (SELECT o_orderkey AS seed, {dw.sql_uniform('o_orderkey', '1')} AS u FROM orders)")
def sim2(spark: SparkSession, sf: str) -> DataFrame:
    u = dw.uniform(F.col("o_orderkey"), F.lit(1))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("seed"), r6(dw.triangular(u, 60, 90, 150)).alias("v"), dw.triangular(u, 4, 4, 4).alias("fixed"))


@QUERIES.add("sim3_local_factor", f"SELECT seed, round(exp(0.35::DOUBLE * z - 0.35::DOUBLE * 0.35::DOUBLE / 2), 6) AS v FROM (SELECT seed, sqrt(-2 * ln(u)) * cos(2 * pi() * w) AS z FROM (SELECT o_orderkey AS seed, {dw.sql_uniform('o_orderkey', '1')} AS u, {dw.sql_uniform('o_orderkey', '2')} AS w FROM orders))")
def sim3(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(k.alias("seed"), r6(dw.local_factor(dw.uniform(k, F.lit(1)), dw.uniform(k, F.lit(2)), F.lit(0.35))).alias("v"))


#: Draws, seed and the added seed of the rainy season.
DRAWS, SEED, RAINY = 300, 20261011, 7919
PARAMS = list(en.MODELS["potato_storage"].items()) + list(en.SHARED.items()) + [("type_mult", (0.4, 0.7, 1.0)), ("persons", (3.5, 4.2, 5.0))]


def draw_table(spark: SparkSession, n: int, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(season, draw, one column a parameter, base): parameters of each draw at fixed places of the season's stream; the
    places of n sites' local factors follow from `base`."""
    stride = len(PARAMS) + 2 * n
    d = spark.range(draws).select(F.col("id").alias("draw")).crossJoin(spark.createDataFrame([("dry", seed), ("rainy", seed + RAINY)], "season string, seed long"))
    u = lambda i: dw.uniform(F.col("seed"), F.col("draw") * stride + i + 1)
    return d.select("season", "draw", "seed", (F.col("draw") * stride + len(PARAMS)).alias("base"), *[dw.triangular(u(i), *v).alias(k) for i, (k, v) in enumerate(PARAMS)])


def tri_sql(i: int, low: float, mode: float, high: float, stride: str) -> str:
    u = dw.sql_uniform("seed", f"draw * {stride} + {i + 1}")
    return f"list_transform([{u}], lambda u: CASE WHEN u < {(mode - low) / (high - low)!r}::DOUBLE THEN {float(low)!r}::DOUBLE + sqrt(u * {float((high - low) * (mode - low))!r}::DOUBLE) ELSE {float(high)!r}::DOUBLE - sqrt((1 - u) * {float((high - low) * (high - mode))!r}::DOUBLE) END)[1]"


@QUERIES.add("sim4_draw_table", "SELECT season, draw, " + ", ".join(f"round({tri_sql(i, *v, f'({len(PARAMS)} + 2 * (SELECT count(*) FROM supplier))')}, 6) AS {k}" for i, (k, v) in enumerate(PARAMS)) + f" FROM (SELECT unnest(range(0, 20)) AS draw), (SELECT unnest(['dry', 'rainy']) AS season, unnest([{SEED}, {SEED + RAINY}]) AS seed)")
def sim4(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "supplier").count()
    return draw_table(spark, n, 20).select("season", "draw", *[r6(k).alias(k) for k, _ in PARAMS])


def site_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """(site, minute, n): buildings of each site that reach it within so many whole minutes on foot, for 60 to 120."""
    near = spatial.nearest(buildings(spark, sf), sites(spark, sf), 60000, 1500)
    t = near.select(F.col("other").alias("site"), F.least(F.lit(121), F.ceil(F.col("d") * 1.3 / (4000 / 60))).cast("int").alias("t")).groupBy("site", "t").agg(F.count("*").alias("k"))
    grid = sites(spark, sf).select(F.col("id").alias("site")).select("site", F.explode(F.sequence(F.lit(60), F.lit(120))).alias("minute"))
    return grid.join(t, "site", "left").groupBy("site", "minute").agg(F.coalesce(F.sum(F.when(F.col("t") <= F.col("minute"), F.col("k"))), F.lit(0)).alias("n"))


def site_draws(spark: SparkSession, sf: str, draws: int = DRAWS) -> DataFrame:
    """(site, i, season, draw, kwh, kw, parameters, local): every site in every draw of the potato model. Draws and seasons
    are a table of fixed size; a site's people come from its counts by minute, joined by the drawn limit."""
    ids = saved(rank.ranked(sites(spark, sf).select(F.col("id").alias("site")), ["site"], "i"), "site-order")
    n = ids.count()
    d = draw_table(spark, n, draws).withColumn("minute", F.floor("max_travel_min").cast("int"))
    x = ids.crossJoin(F.broadcast(d)).join(site_minutes(spark, sf), ["site", "minute"])
    at = F.col("base") + 2 * (F.col("i") - 1)
    local = dw.local_factor(dw.uniform(F.col("seed"), at + 1), dw.uniform(F.col("seed"), at + 2), F.col("local_variation_sd"))
    a = F.col("n") * F.col("persons") * 0.26 * local * F.col("capture_share") * F.col("type_mult")
    out = en.potato_storage(a, {k: F.col(k) for k in en.MODELS["potato_storage"]}, F.lit(24.0))
    return x.select("site", "i", "season", "draw", out["kwh_day"].alias("kwh"), out["kw"].alias("kw"), *[k for k, _ in PARAMS], local.alias("local"))


def simulated(x: DataFrame) -> DataFrame:
    """(site, i, season, draw, kwh, r) of site_draws: ranked within the draw. Only what is asked is written, once, as finding the
    ranges reads the rows too, and each range goes over its rows once."""
    x = saved(x.select("site", "i", "season", "draw", "kwh"), "site-draws")
    return rank.running_within(x, ["season", "draw"], [F.desc("kwh"), "i"], {"r": F.lit(1)}).withColumn("r", F.col("r") + 1)


@QUERIES.add("sim5_monte_carlo_ranks")
def sim5(spark: SparkSession, sf: str) -> DataFrame:
    q = lambda c, *p: F.percentile(c, F.array(*[F.lit(v) for v in p]))
    g = simulated(site_draws(spark, sf)).groupBy("site", "season").agg(r6(F.count_if(F.col("r") <= 10) / float(DRAWS)).alias("p_top"), q("kwh", 0.05, 0.5, 0.95).alias("_k"), q("r", 0.05, 0.95).alias("_r"))
    return g.select("site", "season", "p_top", *[r6(F.get(c, F.lit(at))).alias(name) for name, c, at in (("p5", "_k", 0), ("p50", "_k", 1), ("p95", "_k", 2), ("r5", "_r", 0), ("r95", "_r", 1))])


@QUERIES.add("sim6_joint_group_draws", f"WITH u AS (SELECT draw, {dw.sql_uniform('407', 'draw * 2 + 1')} AS a, {dw.sql_uniform('407', 'draw * 2 + 2')} AS b FROM (SELECT DISTINCT o_orderkey % 500 AS draw FROM orders)) SELECT draw, round({TRI.replace('u', 'a').replace('THEN', 'THEN').replace('sqrt(a', 'sqrt(a')}, 6) AS residence, round({TRI.replace('u', 'a')} / 2, 6) AS airflow, round({TRI.replace('u', 'b')}, 6) AS hours FROM u")
def sim6(spark: SparkSession, sf: str) -> DataFrame:
    """Two parameters of one group share a quantile, another group has its own: one uniform for each draw and group."""
    d = read(spark, sf, "orders").select((F.col("o_orderkey") % 500).alias("draw")).distinct()
    u = lambda g: dw.uniform(F.lit(407), F.col("draw") * 2 + g)
    return d.select("draw", r6(dw.triangular(u(1), 60, 90, 150)).alias("residence"), r6(dw.triangular(u(1), 60, 90, 150) / 2).alias("airflow"), r6(dw.triangular(u(2), 60, 90, 150)).alias("hours"))


CASES = "cs AS (SELECT s_suppkey AS id, draw, tr, se, (1000 + (s_suppkey * 7919 + draw * 31) % 5000) * CASE tr WHEN 'car' THEN 1.0 ELSE 0.7 END * CASE se WHEN 'dry' THEN 1.0 ELSE 0.8 END * CASE WHEN s_suppkey % 9 = 0 AND tr = 'foot' THEN NULL ELSE 1 END AS v FROM supplier, (SELECT unnest(range(0, 30)) AS draw), (SELECT unnest(['car', 'foot']) AS tr), (SELECT unnest(['dry', 'wet']) AS se)), rc AS (SELECT *, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY tr, se, draw ORDER BY v DESC NULLS LAST, id) END AS r FROM cs)"


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """(id, draw, tr, se, v, r): the ensemble of transport, season and draw for each site."""
    c = F.explode(F.array(*[F.struct(F.lit(t).alias("tr"), F.lit(s).alias("se"), F.lit(k * m).alias("k")) for t, k in (("car", 1.0), ("foot", 0.7)) for s, m in (("dry", 1.0), ("wet", 0.8))]))
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("draw")).select("id", "draw", c.alias("c"))
    v = F.when(~((F.col("id") % 9 == 0) & (F.col("c.tr") == "foot")), (1000 + (F.col("id") * 7919 + F.col("draw") * 31) % 5000) * F.col("c.k"))
    x = s.select("id", "draw", "c.tr", "c.se", v.alias("v"))
    return rank.ranked_within(x, ["tr", "se", "draw"], [F.col("v").desc_nulls_last(), "id"], "r").withColumn("r", F.when(F.col("v").isNotNull(), F.col("r")))


@QUERIES.add("sim7_scenario_ensemble", f"WITH {CASES} SELECT tr, se, count(*) AS rows, count(v) AS known, round(CAST(sum(v) AS DOUBLE), 4) AS total FROM rc GROUP BY tr, se")
def sim7(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).groupBy("tr", "se").agg(F.count("*").alias("rows"), F.count("v").alias("known"), F.round(F.sum("v"), 4).alias("total"))


@QUERIES.add("sim8_ensemble_summary", f"WITH {CASES}, k AS (SELECT id, tr, se, count(*) FILTER (r <= 10) / 30.0 AS inc FROM rc GROUP BY ALL), m AS (SELECT id, round(CAST(quantile_cont(CAST(v AS DOUBLE), 0.5) AS DOUBLE), 6) AS median, count(*) FILTER (r <= 10) / 120.0 AS inc FROM rc GROUP BY id) SELECT id, round(CAST(any_value(m.inc) AS DOUBLE), 6) AS inclusion, any_value(median) AS median, CASE WHEN any_value(m.inc) = 0 THEN 'Verify-first' WHEN min(k.inc) >= 0.8 THEN 'Robust' ELSE 'Contested' END AS tier FROM k JOIN m USING (id) GROUP BY id")
def sim8(spark: SparkSession, sf: str) -> DataFrame:
    c = cases(spark, sf)
    k = c.groupBy("id", "tr", "se").agg((F.count_if(F.col("r") <= 10) / 30.0).alias("inc")).groupBy("id").agg(F.min("inc").alias("least"))
    m = c.groupBy("id").agg((F.count_if(F.col("r") <= 10) / 120.0).alias("inclusion"), r6(F.percentile("v", F.lit(0.5))).alias("median"))
    return m.join(k, "id").select("id", r6("inclusion").alias("inclusion"), "median", F.when(F.col("inclusion") == 0, "Verify-first").when(F.col("least") >= 0.8, "Robust").otherwise("Contested").alias("tier"))


@QUERIES.add("sim9_one_factor_cases", f"WITH {CASES} SELECT a.se, a.draw, count(*) FILTER (a.r <= 10 AND (b.r > 10 OR b.r IS NULL)) AS removed, count(*) FILTER (b.r <= 10 AND (a.r > 10 OR a.r IS NULL)) AS added FROM rc a JOIN rc b ON a.id = b.id AND a.draw = b.draw AND a.se = b.se AND a.tr = 'car' AND b.tr = 'foot' GROUP BY a.se, a.draw")
def sim9(spark: SparkSession, sf: str) -> DataFrame:
    c = cases(spark, sf)
    a, b = c.filter("tr = 'car'").select("id", "draw", "se", F.col("r").alias("ra")), c.filter("tr = 'foot'").select("id", "draw", "se", F.col("r").alias("rb"))
    top = lambda x: F.coalesce(F.col(x) <= 10, F.lit(False))
    return a.join(b, ["id", "draw", "se"]).groupBy("se", "draw").agg(F.count_if(top("ra") & ~top("rb")).alias("removed"), F.count_if(top("rb") & ~top("ra")).alias("added"))


def variants() -> list[tuple[str, str, dict]]:
    base = {k: float(v[1]) for k, v in en.MODELS["potato_storage"].items()}
    return [(k, side, base | {k: float(v[0 if side == "low" else 2])}) for k, v in en.MODELS["potato_storage"].items() if k != "run_hours" for side in ("low", "high")]


def swings(spark: SparkSession, sf: str) -> DataFrame:
    """(id, key, low, high, swing): each input at its ends with the others central, a table of fixed size times the sites."""
    table = spark.createDataFrame([(k, side, *q.values()) for k, side, q in variants()], "key string, side string, " + ", ".join(f"{k} double" for k in en.MODELS["potato_storage"]))
    x = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice").crossJoin(F.broadcast(table))
    a = F.col("o_totalprice") * 0.0101010101 * F.col("capture_share")
    out = en.potato_storage(a, {k: F.col(k) for k in en.MODELS["potato_storage"]}, F.lit(24.0))["kwh_day"]
    g = x.select("id", "key", "side", out.alias("v")).groupBy("id", "key").agg(F.max(F.when(F.col("side") == "low", F.col("v"))).alias("low"), F.max(F.when(F.col("side") == "high", F.col("v"))).alias("high"))
    return g.withColumn("swing", F.abs(F.col("high") - F.col("low")))


KWH = "(a * pk / 30 * 1000 * cp * (24 - st) / 3600 + a * pk / 30 * sd * ho) / co"
SHORT = {"capture_share": "cs", "peak_month_fraction": "pk", "storage_days": "sd", "store_temp_c": "st", "cp_kj_per_kg_k": "cp", "holding_kwh_th_per_t_day": "ho", "cop": "co"}
SWING_SQL = "vr AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{side}', " + ", ".join(f"{q[p]!r}::DOUBLE" for p in SHORT) + ")" for k, side, q in variants()) + f") AS t(key, side, {', '.join(SHORT.values())})), sw AS (SELECT id, key, max(v) FILTER (side = 'low') AS low, max(v) FILTER (side = 'high') AS high, abs(max(v) FILTER (side = 'high') - max(v) FILTER (side = 'low')) AS swing FROM (SELECT o_orderkey AS id, key, side, {KWH.replace('a *', '(o_totalprice * 0.0101010101::DOUBLE * cs) *')} AS v FROM orders, vr) GROUP BY id, key)"


@QUERIES.add("sim10_tornado", f"WITH {SWING_SQL} SELECT id, key, round(low, 4) AS low, round(high, 4) AS high, round(swing, 4) AS swing FROM sw")
def sim10(spark: SparkSession, sf: str) -> DataFrame:
    return swings(spark, sf).select("id", "key", *[F.round(c, 4).alias(c) for c in ("low", "high", "swing")])


@QUERIES.add("sim11_rank_sensitivity", "WITH v AS (SELECT key, side, cs FROM (VALUES ('base', 0.15::DOUBLE, 1.0::DOUBLE), ('low', 0.05::DOUBLE, 1.0::DOUBLE), ('local', 0.15::DOUBLE, 0.6::DOUBLE)) AS t(key, cs, k), (SELECT 1 AS side)), x AS (SELECT p_partkey AS id, t.key, row_number() OVER (PARTITION BY t.key ORDER BY p_retailprice * t.cs * CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part) THEN t.k ELSE 1 END DESC, p_partkey) AS r FROM part, (VALUES ('base', 0.15::DOUBLE, 1.0::DOUBLE), ('low', 0.05::DOUBLE, 1.0::DOUBLE), ('local', 0.15::DOUBLE, 0.6::DOUBLE)) AS t(key, cs, k)) SELECT a.id, b.key, b.r AS rank, b.r - a.r AS moved FROM x a JOIN x b USING (id) WHERE a.key = 'base' AND a.r <= 3")
def sim11(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of the three best under each variant, one of which changes a single site."""
    t = spark.createDataFrame([("base", 0.15, 1.0), ("low", 0.05, 1.0), ("local", 0.15, 0.6)], "key string, cs double, k double")
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_retailprice")
    p = p.crossJoin(F.broadcast(p.agg(F.max("id").alias("last")))).crossJoin(F.broadcast(t))
    v = F.col("p_retailprice") * F.col("cs") * F.when(F.col("id") == F.col("last"), F.col("k")).otherwise(1.0)
    x = rank.ranked_within(p.select("id", "key", v.alias("v")), ["key"], [F.desc("v"), "id"], "r").select("id", "key", "r")
    top = x.filter("key = 'base' AND r <= 3").select("id", F.col("r").alias("r0"))
    return x.join(top, "id").select("id", "key", F.col("r").cast("long").alias("rank"), (F.col("r") - F.col("r0")).cast("long").alias("moved"))


@QUERIES.add("sim12_variance_shares")
def sim12(spark: SparkSession, sf: str) -> DataFrame:
    """Order-averaged shares of inputs in the variance of the first site's need: one aggregation gives the cross-products, and
    the projections work on that small matrix. No rank is asked, so none is made."""
    from sitewright.operators.evaluation import variance_shares

    x = site_draws(spark, sf).filter("season = 'dry'")
    first = x.groupBy("site").agg(F.avg("kwh").alias("m")).orderBy(F.desc("m"), "site").limit(1).select("site")
    return variance_shares(x.join(F.broadcast(first), "site"), [k for k, _ in PARAMS if k != "run_hours"] + ["local"], "kwh")


@QUERIES.add("sim13_rank_exits")
def sim13(spark: SparkSession, sf: str) -> DataFrame:
    x = simulated(site_draws(spark, sf).filter("season = 'dry'"))
    top = x.groupBy("site").agg(F.avg("kwh").alias("m"), F.count_if(F.col("r") > 10).alias("outside")).orderBy(F.desc("m"), "site").limit(3)
    return top.select("site", "outside")


#: Percent of known totals and of nodes that are hidden, replicates, and the seed of their picks.
STRESS, REPLICATES, STRESS_SEED = {"production": [10, 25, 50, 75], "location": [10, 25, 50], "facility": [10, 25, 50]}, 20, 1407
NEED = "CASE WHEN share IS NOT NULL THEN share * 0.8::DOUBLE * 45 / 330 * 0.7::DOUBLE * 0.0018::DOUBLE * 600 / (1000 * 0.55::DOUBLE * 0.9::DOUBLE) + CASE WHEN share > 0 THEN 2 ELSE 0 END END"
PICK = "row_number() OVER (PARTITION BY mechanism, percent, rep ORDER BY ('0x' || substr(md5('{seed}:' || mechanism || ':' || percent || ':' || rep || ':' || {key}), 1, 12))::BIGINT, {key}) <= round_even(percent * (SELECT count(*) FROM {rows}) / 100.0::DOUBLE, 0)"
STRESS_SQL = f"""WITH tt AS (SELECT o_custkey // 50 AS region, sum(o_totalprice) / 1000000.0 AS total FROM orders GROUP BY 1), nn AS (SELECT p_partkey // 50 AS region, p_partkey AS node, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) / 4 END AS lim FROM part WHERE NOT (p_partkey // 50 % 4 = 0 AND p_size % 7 = 0)),
runs AS (SELECT 'nothing_hidden' AS mechanism, 0 AS percent, 0 AS rep UNION ALL SELECT mechanism, percent, rep FROM (VALUES {', '.join(f"('{m}', {p})" for m, ps in STRESS.items() for p in ps)}) AS lv(mechanism, percent), (SELECT unnest(range(0, {REPLICATES})) AS rep)),
ht AS (SELECT mechanism, percent, rep, region FROM tt, runs WHERE mechanism = 'production' QUALIFY {PICK.format(seed=STRESS_SEED, key='region', rows='tt')}),
hn AS (SELECT mechanism, percent, rep, node FROM nn, runs WHERE mechanism IN ('location', 'facility') QUALIFY {PICK.format(seed=STRESS_SEED, key='node', rows='nn')}),
tr AS (SELECT * FROM (SELECT * FROM tt, runs) ANTI JOIN ht USING (mechanism, percent, rep, region)),
nr AS (SELECT nn.node, lim, mechanism, percent, rep, CASE WHEN hn.node IS NULL THEN region END AS region FROM nn CROSS JOIN runs LEFT JOIN hn USING (mechanism, percent, rep, node) WHERE NOT (mechanism = 'facility' AND hn.node IS NOT NULL)),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY mechanism, percent, rep, region) AS n, coalesce(sum(lim) OVER (PARTITION BY mechanism, percent, rep, region ORDER BY lim NULLS LAST, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM nr JOIN tr USING (mechanism, percent, rep, region) WINDOW w AS (PARTITION BY mechanism, percent, rep, region ORDER BY lim NULLS LAST, node)),
v AS (SELECT *, greatest(0, (total - s) / (n - i + 1)) AS level FROM o), a AS (SELECT mechanism, percent, rep, region, min_by(level, i) AS lv FROM v WHERE lim IS NULL OR lim >= level GROUP BY ALL),
sh AS (SELECT mechanism, percent, rep, region, node, CASE WHEN lim IS NULL THEN lv WHEN lv IS NULL THEN lim ELSE least(lim, lv) END AS share FROM v LEFT JOIN a USING (mechanism, percent, rep, region)),
kn AS (SELECT mechanism, percent, rep, node, {NEED} AS kw, ht.region IS NOT NULL OR hn.node IS NOT NULL AS gone FROM nr LEFT JOIN (SELECT mechanism, percent, rep, node, share FROM sh) USING (mechanism, percent, rep, node) LEFT JOIN ht USING (mechanism, percent, rep, region) LEFT JOIN hn USING (mechanism, percent, rep, node)),
re AS (SELECT mechanism, percent, rep, max(abs(total - given - greatest(0, total - given))) AS rest FROM (SELECT mechanism, percent, rep, region, any_value(total) AS total, coalesce(sum(share), 0) AS given FROM tr LEFT JOIN (SELECT mechanism, percent, rep, region, share FROM sh) USING (mechanism, percent, rep, region) GROUP BY ALL) GROUP BY ALL),
cu AS (SELECT mechanism, percent, rep, min(kw) AS cut FROM (SELECT * FROM kn WHERE kw IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mechanism, percent, rep ORDER BY kw DESC, node) <= 10) GROUP BY ALL),
tp AS (SELECT kn.*, coalesce(kw >= cut - 1e-9, false) AS top FROM kn LEFT JOIN cu USING (mechanism, percent, rep)), ba AS (SELECT node, kw AS bkw, top AS btop FROM tp WHERE mechanism = 'nothing_hidden'),
ms AS (SELECT mechanism, percent, rep, count(kw) AS ranked, count(*) FILTER (kw IS NULL) AS reported_unknown, count(*) FILTER (kw IS NOT NULL AND gone) AS abstention_violations, coalesce(max(rest), 0) AS max_residual, count(*) FILTER (top) AS top_size, count(*) FILTER (top AND btop) / CAST((SELECT count(*) FILTER (btop) FROM ba) AS DOUBLE) AS retention, count(*) FILTER (top AND btop) / CAST(nullif(count(*) FILTER (btop AND kw IS NOT NULL), 0) AS DOUBLE) AS retention_among_surviving, count(*) FILTER (top AND NOT btop) AS entrants, count(*) FILTER (top AND NOT btop AND kw > bkw + 1e-9) AS entrants_inflated, coalesce(max(CASE WHEN bkw <> 0 THEN kw / bkw END), 1) - 1 AS max_inflation FROM tp JOIN ba USING (node) LEFT JOIN re USING (mechanism, percent, rep) WHERE mechanism <> 'nothing_hidden' GROUP BY ALL),
lo AS (UNPIVOT (SELECT mechanism, percent, rep, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in MEASURES)} FROM ms) ON {', '.join(MEASURES)} INTO NAME measure VALUE v),
li AS (SELECT mechanism, percent, measure, list_sort(list(v)) AS vs, avg(v) AS mean FROM lo GROUP BY ALL)
SELECT mechanism, percent, measure, CAST(len(vs) AS BIGINT) AS runs, round(mean, 6) AS mean, round(vs[least(len(vs), CAST(floor(0.05::DOUBLE * len(vs)) AS BIGINT) + 1)], 6) AS p05, round(vs[least(len(vs), CAST(floor(0.95::DOUBLE * len(vs)) AS BIGINT) + 1)], 6) AS p95, round(vs[1], 6) AS least, round(vs[len(vs)], 6) AS most FROM li"""


@QUERIES.add("sim14_degradation_stress", STRESS_SQL)
def sim14(spark: SparkSession, sf: str) -> DataFrame:
    """Totals, places or whole facilities are hidden, production is allocated and nodes are ranked again, and every run is held
    against the one that hides nothing. All runs are one job."""
    totals, limits = regions(spark, sf)
    s = stress(totals, limits, lambda t: en.aeration(t, AERATION)["electrical_kw"], STRESS, REPLICATES, STRESS_SEED)
    return s.select("mechanism", "percent", "measure", "runs", *[r6(c).alias(c) for c in ("mean", "p05", "p95", "least", "most")])
