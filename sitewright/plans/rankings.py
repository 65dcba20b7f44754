"""Queries over aggregates, ranks and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewright.functions.geo import distance, round_significant
from sitewright.operators import checks, rank, spatial
from sitewright.sources.tables import Queries, buildings, read, sites, sql

QUERIES = Queries()
r6 = lambda c: F.round(c, 6)

UNITS = "un AS (SELECT o_orderkey AS id, o_custkey % 12 AS block, floor(o_totalprice / 1000) AS score, CASE WHEN o_totalprice > 300000 AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS y, o_totalprice AS price FROM orders)"


def units(spark: SparkSession, sf: str) -> DataFrame:
    """(id, block, score, y, price): orders as units to rank, with ties in score."""
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 12).alias("block"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"), F.when((F.col("o_totalprice") > 300000) & (F.col("o_orderkey") % 3 == 0), 1).otherwise(0).alias("y"), F.col("o_totalprice").alias("price"))


def climate(spark: SparkSession, sf: str) -> DataFrame:
    """(day, tmax, rain, sw): a row a day from event values."""
    e = read(spark, sf, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("tmax"), (F.count_if(F.col("event_type") == "error") / 2.0).alias("rain"), (F.avg("value") / 4).alias("sw"))


CLIMATE = "cl AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS tmax, count(*) FILTER (event_type = 'error') / 2.0 AS rain, avg(value) / 4 AS sw FROM events GROUP BY 1)"


@QUERIES.add("src9_climate_days", "SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS tmax, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def src9(spark: SparkSession, sf: str) -> DataFrame:
    """Daily arrays, as a weather service sends them, to a row a day."""
    e = read(spark, sf, "events")
    days = e.groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("tmax"), F.count("*").alias("n"))
    sent = days.groupBy(F.trunc("day", "month").alias("month")).agg(F.sort_array(F.collect_list(F.struct("day", "tmax", "n"))).alias("d")).select(F.col("d.day").alias("time"), F.col("d.tmax").alias("tmax"), F.col("d.n").alias("n"))
    return sent.select(F.explode(F.arrays_zip("time", "tmax", "n")).alias("x")).select(F.col("x.time").alias("day"), r6("x.tmax").alias("tmax"), "x.n")


@QUERIES.add("agg8_monthly_climate", f"WITH {CLIMATE}, m AS (SELECT date_trunc('week', day) AS month, avg(tmax) AS tmax, sum(rain) AS rain, avg(sw) / 3.6 AS sun FROM cl GROUP BY 1) SELECT round(max(tmax), 6) AS hottest, round(avg(tmax), 6) AS mean_tmax, count(*) FILTER (rain >= 100) AS wet_months, round(CAST(sum(rain) AS DOUBLE), 6) AS rain, round(min(sun), 6) AS min_sun, round(avg(sun), 6) AS mean_sun FROM m")
def agg8(spark: SparkSession, sf: str) -> DataFrame:
    """Weeks stand for months, as the days are those of one month."""
    m = climate(spark, sf).groupBy(F.date_trunc("week", "day").alias("month")).agg(F.avg("tmax").alias("tmax"), F.sum("rain").alias("rain"), (F.avg("sw") / 3.6).alias("sun"))
    return m.agg(r6(F.max("tmax")).alias("hottest"), r6(F.avg("tmax")).alias("mean_tmax"), F.count_if(F.col("rain") >= 100).alias("wet_months"), r6(F.sum("rain")).alias("rain"), r6(F.min("sun")).alias("min_sun"), r6(F.avg("sun")).alias("mean_sun"))


@QUERIES.add("agg10_persons_per_building", "WITH p AS (SELECT c_nationkey AS district, least(12.0, greatest(0.5, sum(abs(c_acctbal)) / 1000.0 / count(*))) AS p FROM customer GROUP BY 1) SELECT district, round(p, 6) AS central, round(p * 0.8 / pow(10, floor(log10(p * 0.8)) - 1)) * pow(10, floor(log10(p * 0.8)) - 1) AS low FROM p")
def agg10(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("district")).agg(F.least(F.lit(12.0), F.greatest(F.lit(0.5), F.sum(F.abs("c_acctbal")) / 1000.0 / F.count("*"))).alias("p"))
    return p.select("district", r6("p").alias("central"), round_significant(F.col("p") * 0.8).alias("low"))


@QUERIES.add("agg11_source_shares", "SELECT c_mktsegment AS source, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 6) AS share FROM customer GROUP BY 1")
def agg11(spark: SparkSession, sf: str) -> DataFrame:
    g = read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("source")).agg(F.count("*").alias("n"))
    return g.crossJoin(g.agg(F.sum("n").alias("t"))).select("source", "n", r6(F.col("n") / F.col("t")).alias("share"))


@QUERIES.add("agg12_coverage_class", "WITH d AS (SELECT c_nationkey AS district, count(*) / 16.81 AS density, sum(abs(c_acctbal)) / 100000.0 AS road FROM customer GROUP BY 1) SELECT district, CASE WHEN density >= 4 AND road >= 2.5 THEN 'well' WHEN density >= 2 AND road >= 1 THEN 'partly' ELSE 'thin' END AS coverage FROM d")
def agg12(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("district")).agg((F.count("*") / 16.81).alias("density"), (F.sum(F.abs("c_acctbal")) / 100000.0).alias("road"))
    kind = F.when(F.col("density").isNull() | F.col("road").isNull(), "unknown").when((F.col("density") >= 4) & (F.col("road") >= 2.5), "well").when((F.col("density") >= 2) & (F.col("road") >= 1), "partly").otherwise("thin")
    return d.select("district", kind.alias("coverage"))


@QUERIES.add("agg15_grid_state", sql("s", ", k AS (SELECT a.id, min(sqrt((a.x-s.x)*(a.x-s.x)+(a.y-s.y)*(a.y-s.y))) FILTER (s.kind = 1) AS line, min(sqrt((a.x-s.x)*(a.x-s.x)+(a.y-s.y)*(a.y-s.y))) FILTER (s.kind = 2) AS sub, min(sqrt((a.x-s.x)*(a.x-s.x)+(a.y-s.y)*(a.y-s.y))) FILTER (s.kind = 3) AS gen FROM s a, s WHERE a.kind >= 4 GROUP BY a.id) SELECT id, round(sub, 4) AS substation_m, gen < 2000 AS generator, CASE WHEN least(line, sub) <= 500 THEN 'grid_near' WHEN least(line, sub) <= 5000 THEN 'grid_mid' ELSE 'grid_not_mapped' END AS state FROM k").replace(" , k", ", k"))
def agg15(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds 1 to 3 stand for lines, substations and generators."""
    s = sites(spark, sf)
    mine = s.filter("kind >= 4")
    far = lambda kind, cap, name: spatial.nearest(mine, s.filter(F.col("kind") == kind), cap, 2500).select("id", F.col("d").alias(name))
    k = far(1, 20000, "line").join(far(2, 40000, "sub"), "id").join(far(3, 2000, "gen"), "id")
    near = F.least("line", "sub")
    return k.select("id", F.round("sub", 4).alias("substation_m"), F.col("gen").isNotNull().alias("generator"), F.when(near <= 500, "grid_near").when(near <= 5000, "grid_mid").otherwise("grid_not_mapped").alias("state"))


@QUERIES.add("agg16_weighted_overlap", "SELECT l_suppkey AS unit, CASE WHEN count(*) FILTER (l_linenumber = 7) = 0 THEN round(sum(l_quantity * l_discount), 6) END AS mass, count(*) AS parts FROM lineitem GROUP BY 1")
def agg16(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("l_linenumber") != 7, F.col("l_quantity")) * F.col("l_discount")
    return read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(r6(checks.guarded_sum(v)).alias("mass"), F.count("*").alias("parts"))


@QUERIES.add("agg19_unit_population", "SELECT c_nationkey AS unit, CASE WHEN count(*) FILTER (c_acctbal < -990) = 0 THEN round(sum(c_acctbal), 4) END AS population FROM customer GROUP BY 1")
def agg19(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("unit")).agg(F.round(checks.guarded_sum(F.when(F.col("c_acctbal") >= -990, F.col("c_acctbal"))), 4).alias("population"))


@QUERIES.add("agg20_presence_label", sql("s", "SELECT district AS unit, CASE WHEN count(*) FILTER (kind < 2) > 0 THEN 'documented' WHEN count(*) FILTER (kind = 2) > 0 THEN 'review required' ELSE 'unlabeled' END AS status, coalesce(string_agg(CAST(id AS VARCHAR), '|' ORDER BY id) FILTER (kind < 2), '') AS facilities FROM s GROUP BY district"))
def agg20(spark: SparkSession, sf: str) -> DataFrame:
    g = sites(spark, sf).groupBy(F.col("district").alias("unit")).agg(F.max(F.col("kind") < 2).alias("a"), F.max(F.col("kind") == 2).alias("b"), F.sort_array(F.collect_list(F.when(F.col("kind") < 2, F.col("id")))).alias("f"))
    return g.select("unit", F.when(F.col("a"), "documented").when(F.col("b"), "review required").otherwise("unlabeled").alias("status"), F.concat_ws("|", F.col("f").cast("array<string>")).alias("facilities"))


@QUERIES.add("agg21_cohort_availability", "WITH r AS (SELECT c_custkey AS id, c_nationkey AS block, list_filter([CASE WHEN c_acctbal < 0 THEN 'no_balance' END, CASE WHEN c_custkey % 5 = 0 THEN 'no_road' END], lambda x: x IS NOT NULL) AS reasons FROM customer) SELECT coalesce(reason, 'complete') AS reason, count(*) AS units, count(DISTINCT block) AS blocks FROM (SELECT id, block, unnest(CASE WHEN len(reasons) = 0 THEN [NULL] ELSE reasons END) AS reason FROM r) GROUP BY 1")
def agg21(spark: SparkSession, sf: str) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "no_balance"), F.when(F.col("c_custkey") % 5 == 0, "no_road")))
    r = read(spark, sf, "customer").select("c_nationkey", F.explode_outer(reasons).alias("reason"))
    return r.groupBy(F.coalesce("reason", F.lit("complete")).alias("reason")).agg(F.count("*").alias("units"), F.count_distinct("c_nationkey").alias("blocks"))


@QUERIES.add("agg22_block_counts", "SELECT n_regionkey AS block, count(*) AS units, count(*) FILTER (c_acctbal >= 0) AS complete, count(DISTINCT n_nationkey) AS districts FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def agg22(spark: SparkSession, sf: str) -> DataFrame:
    j = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_regionkey").alias("block")).agg(F.count("*").alias("units"), F.count_if(F.col("c_acctbal") >= 0).alias("complete"), F.count_distinct("n_nationkey").alias("districts"))


@QUERIES.add("agg23_proxy_audit", "SELECT l_suppkey AS region, round(sum(l_discount), 6) AS covered, round(sum(l_quantity * least(l_discount, 1)), 4) AS represented, round(sum(l_quantity * (1 - least(l_discount, 1))), 4) AS outside, max(l_discount) > 1 AS over_covered FROM lineitem GROUP BY 1")
def agg23(spark: SparkSession, sf: str) -> DataFrame:
    share = F.least("l_discount", F.lit(1.0))
    return read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("region")).agg(r6(F.sum("l_discount")).alias("covered"), F.round(F.sum(F.col("l_quantity") * share), 4).alias("represented"), F.round(F.sum(F.col("l_quantity") * (1 - share)), 4).alias("outside"), (F.max("l_discount") > 1).alias("over_covered"))


@QUERIES.add("agg24_control_totals", "SELECT n_nationkey AS district, coalesce(n, 0) AS n, round(CAST(coalesce(t, 0) AS DOUBLE), 4) AS total, coalesce(n = cn AND t = ct, false) AS agrees FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n, sum(CAST(c_acctbal AS DECIMAL(18, 6))) AS t FROM customer GROUP BY 1) a ON a.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS cn, sum(CAST(c_acctbal AS DECIMAL(18, 6))) AS ct FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1) b ON b.k = n_nationkey")
def agg24(spark: SparkSession, sf: str) -> DataFrame:
    """Totals by district against an independent control, that of customers with orders: they agree where all have some. Totals
    are sums of decimals, so they don't depend on the order of rows."""
    c = read(spark, sf, "customer")
    active = c.join(read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    total = lambda df: df.groupBy(F.col("c_nationkey").alias("district")).agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,6)")).alias("total"))
    universe = read(spark, sf, "nation").select(F.col("n_nationkey").alias("district"))
    return checks.against_control(universe, total(c), total(active), "district", 0).select("district", "n", F.round(F.col("total").cast("double"), 4).alias("total"), "agrees")


@QUERIES.add("agg25_national_table", "SELECT CAST(c_nationkey AS VARCHAR) AS district, count(*) AS buildings, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery, round(sum(c_acctbal), 4) AS total FROM customer GROUP BY 1 UNION ALL SELECT 'all', count(*), count(*) FILTER (c_mktsegment = 'BUILDING'), count(*) FILTER (c_mktsegment = 'MACHINERY'), round(sum(c_acctbal), 4) FROM customer")
def agg25(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda s: F.count_if(F.col("c_mktsegment") == s)
    t = read(spark, sf, "customer").rollup("c_nationkey").agg(F.count("*").alias("buildings"), part("BUILDING").alias("building"), part("MACHINERY").alias("machinery"), F.round(F.sum("c_acctbal"), 4).alias("total"), F.grouping("c_nationkey").alias("g"))
    return t.select(F.when(F.col("g") == 1, "all").otherwise(F.col("c_nationkey").cast("string")).alias("district"), "buildings", "building", "machinery", "total")


@QUERIES.add("agg26_evidence_ledger", "SELECT f AS path, l AS label, count(*) AS n FROM (SELECT unnest(['price', 'size']) AS f, unnest([CASE WHEN p_size % 7 = 0 THEN 'UNKNOWN' ELSE 'OBSERVED' END, CASE WHEN p_size % 3 = 0 THEN 'UNKNOWN' ELSE 'ESTIMATED' END]) AS l FROM part) GROUP BY 1, 2")
def agg26(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.array(F.struct(F.lit("price").alias("path"), F.when(F.col("p_size") % 7 == 0, "UNKNOWN").otherwise("OBSERVED").alias("label")), F.struct(F.lit("size").alias("path"), F.when(F.col("p_size") % 3 == 0, "UNKNOWN").otherwise("ESTIMATED").alias("label")))
    return read(spark, sf, "part").select(F.explode(fields).alias("f")).groupBy("f.path", "f.label").agg(F.count("*").alias("n"))


@QUERIES.add("agg27_source_catalogue", "SELECT s_nationkey AS publisher, s_name AS file, length(s_name) AS bytes FROM supplier")
def agg27(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests (a publisher with its files) to a row a file."""
    m = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("publisher")).agg(F.collect_list(F.struct(F.col("s_name").alias("file"), F.length("s_name").cast("long").alias("bytes"))).alias("files"))
    return m.select("publisher", F.inline("files"))


@QUERIES.add("agg28_length_without_links", "SELECT l_returnflag AS class, round(sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity END), 4) AS length FROM lineitem GROUP BY 1")
def agg28(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("class")).agg(F.round(F.sum(F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_quantity"))), 4).alias("length"))


@QUERIES.add("agg29_partial_block_totals", "SELECT c_nationkey AS block, round(sum(o_totalprice), 4) AS observed, round(sum(c_acctbal), 4) AS predicted, count(*) AS matched FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1")
def agg29(spark: SparkSession, sf: str) -> DataFrame:
    j = read(spark, sf, "orders").filter("o_orderstatus <> 'P'").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_nationkey").alias("block")).agg(F.round(F.sum("o_totalprice"), 4).alias("observed"), F.round(F.sum("c_acctbal"), 4).alias("predicted"), F.count("*").alias("matched"))


@QUERIES.add("agg30_area_facts", sql("s", "SELECT count(*) AS sites, count(*) FILTER (kind < 3) AS robust, count(*) FILTER (kind = 7) AS far, round(avg(x), 4) AS mean_x FROM s"))
def agg30(spark: SparkSession, sf: str) -> DataFrame:
    return sites(spark, sf).agg(F.count("*").alias("sites"), F.count_if(F.col("kind") < 3).alias("robust"), F.count_if(F.col("kind") == 7).alias("far"), F.round(F.avg("x"), 4).alias("mean_x"))


@QUERIES.add("agg31_national_context", sql("b s", "SELECT (SELECT count(*) FROM b) AS footprints, (SELECT count(*) FROM s WHERE kind < 6) AS documented"))
def agg31(spark: SparkSession, sf: str) -> DataFrame:
    return buildings(spark, sf).agg(F.count("*").alias("footprints")).crossJoin(sites(spark, sf).filter("kind < 6").agg(F.count("*").alias("documented")))


@QUERIES.add("win1_central_rank", "SELECT p_partkey AS id, CASE WHEN p_size % 7 <> 0 THEN row_number() OVER (ORDER BY p_size % 7 = 0, p_retailprice DESC, p_partkey) END AS rank FROM part")
def win1(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("v"))
    known = rank.ranked(p.filter("v IS NOT NULL"), [F.desc("v"), "id"]).select("id", "rank")
    return known.union(p.filter("v IS NULL").select("id", F.lit(None).cast("long")))


DRAWN = "dr AS (SELECT s_suppkey AS id, draw, CAST((s_suppkey * 7919 + draw * 104729) % 1009 AS DOUBLE) * (1 + s_suppkey % 5) AS v FROM supplier, (SELECT unnest(range(0, 40)) AS draw)), rk AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY v DESC, id) AS r FROM dr)"


def drawn(spark: SparkSession, sf: str) -> DataFrame:
    """(id, draw, v, r): 40 draws of a value for each site, ranked within the draw."""
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    d = s.select("id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("draw"))
    d = d.withColumn("v", ((F.col("id") * 7919 + F.col("draw") * 104729) % 1009).cast("double") * (1 + F.col("id") % 5))
    return rank.ranked_within(d, ["draw"], [F.desc("v"), "id"], "r")


@QUERIES.add("win2_draw_ranks", f"WITH {DRAWN} SELECT id, count(*) FILTER (r <= 10) AS top, CAST(sum(r) AS BIGINT) AS ranks FROM rk GROUP BY id")
def win2(spark: SparkSession, sf: str) -> DataFrame:
    return drawn(spark, sf).groupBy("id").agg(F.count_if(F.col("r") <= 10).alias("top"), F.sum("r").cast("long").alias("ranks"))


TIERS = f"{DRAWN}, g AS (SELECT id, count(*) FILTER (r <= 10) / 40.0 AS p_top, quantile_cont(r, 0.95) - quantile_cont(r, 0.05) AS spread, avg(v) AS m FROM rk GROUP BY id), h AS (SELECT *, row_number() OVER (ORDER BY m DESC, id) AS rank FROM g)"


@QUERIES.add("win3_stability_tier", f"WITH {TIERS} SELECT id, rank, CASE WHEN rank <= 10 THEN CASE WHEN p_top >= 0.8 THEN 'Robust' WHEN p_top >= 0.4 THEN 'Contested' ELSE 'Check first' END END AS tier, CASE WHEN spread <= 1 THEN 'Robust' WHEN spread <= 3 THEN 'Contested' ELSE 'Check first' END AS tier_few FROM h")
def win3(spark: SparkSession, sf: str) -> DataFrame:
    g = drawn(spark, sf).groupBy("id").agg((F.count_if(F.col("r") <= 10) / 40.0).alias("p_top"), (F.percentile("r", F.lit(0.95)) - F.percentile("r", F.lit(0.05))).alias("spread"), F.avg("v").alias("m"))
    g = rank.ranked(g, [F.desc("m"), "id"])
    tier = F.when(F.col("p_top") >= 0.8, "Robust").when(F.col("p_top") >= 0.4, "Contested").otherwise("Check first")
    return g.select("id", "rank", F.when(F.col("rank") <= 10, tier).alias("tier"), F.when(F.col("spread") <= 1, "Robust").when(F.col("spread") <= 3, "Contested").otherwise("Check first").alias("tier_few"))


def _whole_quantile(k: int) -> str:
    return f"(100 * rs[{k} * m // 100 + 1] + {k} * m % 100 * (rs[least(m, {k} * m // 100 + 1) + 1] - rs[{k} * m // 100 + 1]) + 50) // 100"


@QUERIES.add("win4_quantiles", f"WITH {DRAWN}, q AS (SELECT id, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, count(*) - 1 AS m, list_sort(list(r)) AS rs FROM rk GROUP BY id) SELECT id, p5, p50, p95, CAST({_whole_quantile(5)} AS BIGINT) AS rank_low, CAST({_whole_quantile(95)} AS BIGINT) AS rank_high FROM q")
def win4(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of the draws, and those of ranks to the nearest whole one, halves up: in whole numbers, as a half that doubles
    miss by their last bit would go either way."""
    q = lambda p: r6(F.percentile("v", F.lit(p)))
    g = drawn(spark, sf).groupBy("id").agg(q(0.05).alias("p5"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.sort_array(F.collect_list("r")).alias("_r"))
    return g.select("id", "p5", "p50", "p95", rank.whole_quantile("_r", 5).alias("rank_low"), rank.whole_quantile("_r", 95).alias("rank_high"))


@QUERIES.add("win5_area_percentile", f"WITH {UNITS} SELECT id, round(1 - (row_number() OVER (ORDER BY score DESC, id) - 1) / greatest(1, (SELECT count(*) FROM un) - 1), 6) AS percentile FROM un")
def win5(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf)
    n = u.agg(F.count("*").alias("n"))
    return rank.ranked(u.select("id", "score"), [F.desc("score"), "id"]).crossJoin(n).select("id", r6(1 - (F.col("rank") - 1) / F.greatest(F.lit(1), F.col("n") - 1)).alias("percentile"))


CAPTURE = """, o AS (SELECT block, score, count(*) AS n, sum(y) AS p FROM un GROUP BY ALL), q AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY block ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gt, greatest(1, ceil(CAST(0.1 AS DOUBLE) * sum(n) OVER (PARTITION BY block))) AS m FROM o),
cap AS (SELECT block, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS positives, sum(CASE WHEN gt >= m THEN 0.0 WHEN gt + n <= m THEN p ELSE p * (m - gt) / n END) AS captured FROM q GROUP BY block)"""


@QUERIES.add("win6_top_share_capture", f"WITH {UNITS}{CAPTURE} SELECT block, n, positives, round(CAST(captured AS DOUBLE), 6) AS captured FROM cap")
def win6(spark: SparkSession, sf: str) -> DataFrame:
    return rank.captured(units(spark, sf), "score", "y", 0.1, "block").withColumn("captured", r6("captured"))


@QUERIES.add("win7_item_capture", f"WITH {UNITS}{CAPTURE} SELECT un.id, round(CAST(CASE WHEN gt >= m THEN 0.0 WHEN gt + n <= m THEN 1.0 ELSE (m - gt) / n END AS DOUBLE), 6) AS share FROM un JOIN q USING (block, score) WHERE y = 1")
def win7(spark: SparkSession, sf: str) -> DataFrame:
    """Each positive's own part: 1 above its block's cut, 0 below, a share at it."""
    u = units(spark, sf)
    s = u.groupBy("block", "score").agg(F.count("*").alias("n"))
    w = Window.partitionBy("block")
    s = s.select("block", "score", "n", F.coalesce(F.sum("n").over(w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("gt"), F.ceil(F.sum("n").over(w) * 0.1).alias("m"))
    share = F.when(F.col("gt") >= F.col("m"), 0.0).when(F.col("gt") + F.col("n") <= F.col("m"), 1.0).otherwise((F.col("m") - F.col("gt")) / F.col("n"))
    return u.filter("y = 1").join(s, ["block", "score"]).select("id", r6(share).alias("share"))


@QUERIES.add("win8_top_fraction_recall", f"WITH {UNITS}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k FROM un) SELECT count(*) AS units, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(y) FILTER (k <= ceil(CAST(0.2 AS DOUBLE) * (SELECT count(*) FROM un))) AS BIGINT) AS hits FROM r")
def win8(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf).select("id", "score", "y")
    n = u.agg(F.count("*").alias("n"))
    return rank.ranked(u, [F.desc("score"), "id"]).crossJoin(n).agg(F.count("*").alias("units"), F.sum("y").alias("positives"), F.sum(F.when(F.col("rank") <= F.ceil(F.col("n") * F.lit(0.2)), F.col("y"))).alias("hits"))


@QUERIES.add("win9_mid_rank_auc", f"WITH {UNITS}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS m FROM un) SELECT round((sum(m) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 8) AS auc FROM r")
def win9(spark: SparkSession, sf: str) -> DataFrame:
    return rank.auc(units(spark, sf), "score", "y").select(F.round("auc", 8).alias("auc"))


@QUERIES.add("win10_spearman", f"WITH {UNITS}, r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY block) + (count(*) OVER (PARTITION BY block) - 1) / 2.0 AS b FROM un) SELECT round(corr(a, b), 8) AS rho FROM r")
def win10(spark: SparkSession, sf: str) -> DataFrame:
    return rank.spearman(units(spark, sf), "score", "block").select(F.round("rho", 8).alias("rho"))


@QUERIES.add("win11_tie_inclusive_top", f"WITH {UNITS} SELECT id, score FROM un WHERE score >= (SELECT min(score) FROM (SELECT score FROM un ORDER BY score DESC LIMIT 25)) - 1e-9")
def win11(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf)
    cut = u.select("score").orderBy(F.desc("score")).limit(25).agg(F.min("score").alias("cut"))
    return u.crossJoin(F.broadcast(cut)).filter(F.col("score") >= F.col("cut") - 1e-9).select("id", "score")


@QUERIES.add("win12_calibration_deciles", f"WITH {UNITS}, t AS (SELECT *, ntile(10) OVER (ORDER BY price, id) AS bin FROM un) SELECT bin, count(*) AS n, round(avg(price / 600000), 6) AS predicted, round(avg(y), 6) AS observed FROM t GROUP BY bin")
def win12(spark: SparkSession, sf: str) -> DataFrame:
    """Ten bins by order of a prediction, the first ones larger by a row where they don't divide; the bin follows from the rank."""
    u = units(spark, sf)
    t = rank.ranked(u.select("id", "price", "y"), ["price", "id"]).crossJoin(F.broadcast(u.agg(F.count("*").alias("n"))))
    size, extra = F.floor(F.col("n") / 10), F.col("n") % 10
    k = F.col("rank") - 1
    bin_ = F.when(k < extra * (size + 1), F.floor(k / (size + 1))).otherwise(extra + F.floor((k - extra * (size + 1)) / F.greatest(size, F.lit(1))))
    return t.groupBy((bin_ + 1).cast("long").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg(F.col("price") / 600000)).alias("predicted"), r6(F.avg("y")).alias("observed"))


@QUERIES.add("win13_same_name_labels", sql("s", ", g AS (SELECT *, 'K' || kind AS label, count(*) OVER (PARTITION BY kind) AS n, max(x) OVER (PARTITION BY kind) - min(x) OVER (PARTITION BY kind) AS dx, max(y) OVER (PARTITION BY kind) - min(y) OVER (PARTITION BY kind) AS dy FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN dx >= dy THEN x ELSE -y END, id) AS k FROM g) SELECT id, CASE WHEN n = 1 THEN label WHEN n = 2 THEN label || ' (' || CASE WHEN dx >= dy THEN CASE k WHEN 1 THEN 'west' ELSE 'east' END ELSE CASE k WHEN 1 THEN 'north' ELSE 'south' END END || ')' ELSE label || ' (' || k || ' of ' || n || ')' END AS label FROM o").replace(" , g", ", g"))
def win13(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("kind")
    s = sites(spark, sf).withColumn("label", F.concat(F.lit("K"), F.col("kind").cast("string"))).withColumn("n", F.count("*").over(w)).withColumn("wide", (F.max("x").over(w) - F.min("x").over(w)) >= (F.max("y").over(w) - F.min("y").over(w)))
    s = s.withColumn("k", F.row_number().over(w.orderBy(F.when(F.col("wide"), F.col("x")).otherwise(-F.col("y")), "id")))
    side = F.when(F.col("wide"), F.when(F.col("k") == 1, "west").otherwise("east")).otherwise(F.when(F.col("k") == 1, "north").otherwise("south"))
    paren = lambda c: F.concat(F.col("label"), F.lit(" ("), c, F.lit(")"))
    return s.select("id", F.when(F.col("n") == 1, F.col("label")).when(F.col("n") == 2, paren(side)).otherwise(paren(F.concat_ws(" of ", F.col("k").cast("string"), F.col("n").cast("string")))).alias("label"))


@QUERIES.add("win14_look_alikes", f"WITH {UNITS} SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM un WHERE y = 0 AND price >= 150000 QUALIFY rank <= 12")
def win14(spark: SparkSession, sf: str) -> DataFrame:
    top = units(spark, sf).filter("y = 0 AND price >= 150000").orderBy(F.desc("score"), "id").limit(12)
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), "id", "score")


@QUERIES.add("win15_top_reasons", "WITH r AS (SELECT p_partkey AS id, unnest(['size', 'price', 'kind', 'brand']) AS text, unnest([p_size / 50.0 - 0.3, p_retailprice / 2000.0 - 0.5, (p_partkey % 7) / 10.0, (p_partkey % 11) / 20.0 - 0.2]) AS v FROM part) SELECT id, coalesce(string_agg(text, '|' ORDER BY v DESC, text) FILTER (v > 0.05 AND k <= 3), '') AS why FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, text) AS k FROM r) GROUP BY id")
def win15(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda name, v: F.struct((-v).alias("v"), F.lit(name).alias("text"))
    k = F.col("p_partkey")
    parts = F.array(part("size", F.col("p_size") / 50.0 - 0.3), part("price", F.col("p_retailprice") / 2000.0 - 0.5), part("kind", (k % 7) / 10.0), part("brand", (k % 11) / 20.0 - 0.2))
    best = F.slice(F.array_sort(F.filter(parts, lambda p: -p["v"] > 0.05)), 1, 3)
    return read(spark, sf, "part").select(k.alias("id"), F.concat_ws("|", F.transform(best, lambda p: p["text"])).alias("why"))


@QUERIES.add("win16_membership_change", "WITH m AS (SELECT DISTINCT date_trunc('year', o_orderdate) AS snap, o_custkey AS k FROM orders), s AS (SELECT snap, lag(snap) OVER (ORDER BY snap) AS prev FROM (SELECT DISTINCT snap FROM m)) SELECT CAST(year(s.snap) AS INTEGER) AS year, count(*) FILTER (NOT EXISTS (SELECT 1 FROM m p WHERE p.snap = s.prev AND p.k = m.k)) AS added, (SELECT count(*) FROM m p WHERE p.snap = s.prev AND NOT EXISTS (SELECT 1 FROM m q WHERE q.snap = s.snap AND q.k = p.k)) AS removed FROM s JOIN m ON m.snap = s.snap WHERE s.prev IS NOT NULL GROUP BY s.snap, s.prev")
def win16(spark: SparkSession, sf: str) -> DataFrame:
    m = read(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("k")).distinct()
    snaps = m.select("year").distinct()
    order = snaps.select("year", F.lag("year").over(Window.orderBy("year")).alias("prev"), F.lead("year").over(Window.orderBy("year")).alias("next"))
    now = m.join(F.broadcast(order), "year")
    before = m.select(F.col("year").alias("prev"), "k")
    added = now.filter("prev IS NOT NULL").join(before, ["prev", "k"], "left_anti").groupBy("year").agg(F.count("*").alias("added"))
    after = m.select(F.col("year").alias("next"), "k")
    removed = now.filter("next IS NOT NULL").join(after, ["next", "k"], "left_anti").groupBy(F.col("next").alias("year")).agg(F.count("*").alias("removed"))
    return order.filter("prev IS NOT NULL").select("year").join(added, "year", "left").join(removed, "year", "left").select("year", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"))


@QUERIES.add("win17_ensemble_rank", f"WITH {DRAWN}, g AS (SELECT id, count(*) FILTER (r <= 10) / 40.0 AS inclusion, quantile_cont(v, 0.5) AS kw FROM rk GROUP BY id HAVING count(*) FILTER (v > 0) > 0) SELECT id, round(CAST(inclusion AS DOUBLE), 6) AS inclusion, row_number() OVER (ORDER BY inclusion DESC, kw DESC, id) AS rank FROM g")
def win17(spark: SparkSession, sf: str) -> DataFrame:
    g = drawn(spark, sf).groupBy("id").agg((F.count_if(F.col("r") <= 10) / 40.0).alias("inclusion"), F.percentile("v", F.lit(0.5)).alias("kw"), F.count_if(F.col("v") > 0).alias("n")).filter("n > 0")
    return rank.ranked(g, [F.desc("inclusion"), F.desc("kw"), "id"]).select("id", r6("inclusion").alias("inclusion"), "rank")


@QUERIES.add("win18_contiguous_ranks", "SELECT count(*) AS n, true AS contiguous FROM part")
def win18(spark: SparkSession, sf: str) -> DataFrame:
    r = rank.ranked(read(spark, sf, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"])
    return r.agg(F.count("*").alias("n"), ((F.min("rank") == 1) & (F.max("rank") == F.count("*")) & (F.count_distinct("rank") == F.count("*"))).alias("contiguous"))


@QUERIES.add("top1_shortlist", "SELECT o_orderkey AS id, o_totalprice AS v FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top1(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v")).orderBy(F.desc("v"), "id").limit(10)


@QUERIES.add("top2_drivers", "SELECT o_custkey AS site, o_orderkey AS driver, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY abs(o_totalprice - 250000) DESC, o_orderkey) AS INTEGER) AS k FROM orders QUALIFY k <= 6")
def top2(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc(F.abs(F.col("o_totalprice") - 250000)), "o_orderkey")
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("driver"), F.row_number().over(w).alias("k")).filter("k <= 6")


@QUERIES.add("top3_total_order", f"WITH {UNITS} SELECT id, row_number() OVER (ORDER BY score DESC, id) AS pos FROM un")
def top3(spark: SparkSession, sf: str) -> DataFrame:
    return rank.ranked(units(spark, sf).select("id", "score").filter("score IS NOT NULL AND NOT isnan(score)"), [F.desc("score"), "id"], "pos").select("id", "pos")


@QUERIES.add("top4_capped_points", "WITH p AS (SELECT l_suppkey AS site, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem) SELECT site, count(*) AS kept FROM p WHERE k <= 100 OR (k <= 300 AND k % 7 = 0) GROUP BY site")
def top4(spark: SparkSession, sf: str) -> DataFrame:
    """Points shown of a catchment: the first 100, then each seventh up to 300 (a display sample, as its feature)."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("site"), F.row_number().over(w).alias("k")).filter("k <= 100 OR (k <= 300 AND k % 7 = 0)").groupBy("site").agg(F.count("*").alias("kept"))
