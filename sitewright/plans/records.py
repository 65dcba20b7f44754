"""Queries over records: text rules, units, checked joins, sets, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewright.functions import rules
from sitewright.functions import text as tx
from sitewright.functions.geo import round_significant
from sitewright.operators import checks
from sitewright.sources.tables import Queries, buildings, read, saved, sites, sql

QUERIES = Queries()
r6 = lambda c: F.round(c, 6)
lit_list = lambda words: F.array(*[F.lit(w) for w in words])
pick = lambda words, by: F.get(lit_list(words), (by % len(words)).cast("int"))
sql_list = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
sql_pick = lambda words, by: f"{sql_list(words)}[({by}) % {len(words)} + 1]"

#: Names as open maps spell them, and what the rules make of them when no other tag is set.
PLACES = (
    ("Isoko market", "market"), ("Church of Isoko", None), ("Nyabihu milk collection centre", "milk_centre"), ("Moulin du Nord", "mill"), ("Mulindi tea factory", "tea_factory"),
    ("Kigali super market", None), ("Coffee washing station", "coffee_station"), ("Frigo central", "cold_store"), ("Koperative Abahuzamugambi", "cooperative"), ("Post-harvest store", "warehouse"),
    ("Hotel Moulin", None), ("Plain house", None), ("Marché de Ruhengeri", "market"), ("Kawunga flour", "mill"), ("Café du Lac", "coffee_station"), ("Stock Gatsibo", "warehouse"),
)
NAMES = [n for n, _ in PLACES]


def named(spark: SparkSession, sf: str) -> DataFrame:
    s = sites(spark, sf)
    return s.withColumn("label", pick(NAMES, F.col("id")))


@QUERIES.add("txt1_normal_name", "SELECT p_partkey AS id, upper(trim(regexp_replace('  ' || replace(p_name, ' ', '   ') || ' ', '\\s+', ' ', 'g'))) AS key FROM part")
def txt1(spark: SparkSession, sf: str) -> DataFrame:
    spaced = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit(" "))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.normal_name(tx.nfkc(spaced)).alias("key"))


@QUERIES.add("txt2_operator_key", "SELECT p_partkey AS id, regexp_replace(upper(p_name || ' & ' || p_brand), '[^A-Z0-9]', '', 'g') AS key FROM part")
def txt2(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace(tx.normal_name(F.concat("p_name", F.lit(" & "), "p_brand")), r"[^\p{L}\p{N}]", "").alias("key"))


@QUERIES.add("txt3_folded_search_key", sql("s", f"SELECT id, lower(strip_accents({sql_pick(NAMES, 'id')})) AS key FROM s"))
def txt3(spark: SparkSession, sf: str) -> DataFrame:
    return named(spark, sf).select("id", tx.unaccented("label").alias("key"))


@QUERIES.add("txt4_composite_key", "SELECT p_partkey AS id, concat_ws('|', upper(p_name), upper(p_brand), upper(p_type), CAST(p_size AS VARCHAR), CAST(p_partkey AS VARCHAR), 'X') AS key FROM part")
def txt4(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", *[tx.normal_name(F.col(c)) for c in ("p_name", "p_brand", "p_type")], F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), F.lit("X")).alias("key"))


@QUERIES.add("txt5_hashed_id", "SELECT p_partkey AS id, substr(sha256(p_name || '|' || p_partkey), 1, 20) AS hashed FROM part")
def txt5(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.substring(F.sha2(F.concat_ws("|", "p_name", F.col("p_partkey").cast("string")), 256), 1, 20).alias("hashed"))


#: The namespace of stable ids: the one that RFC 4122 gives for URLs, as hex.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


@QUERIES.add("txt6_name_uuid", f"WITH h AS (SELECT s_suppkey AS id, sha1(unhex('{NAMESPACE}') || encode('site/' || s_name)) AS h FROM supplier) SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE ('0x' || substr(h, 17, 1))::BIGINT % 4 WHEN 0 THEN '8' WHEN 1 THEN '9' WHEN 2 THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid, false AS repeated FROM h")
def txt6(spark: SparkSession, sf: str) -> DataFrame:
    """Name-based identity (version 5): SHA-1 of namespace and name, with the version and variant bits set; checked for repeats."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(F.concat(F.lit("site/"), F.col("s_name")), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    rows = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), uuid.alias("uuid"))
    repeats = rows.groupBy("uuid").agg(F.count("*").alias("n"))
    return rows.join(repeats, "uuid").select("id", "uuid", (F.col("n") > 1).alias("repeated"))


@QUERIES.add("txt7_spatial_key", "SELECT n_nationkey AS id, 'XX:nation:2024:' || n_name AS key FROM nation")
def txt7(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.concat_ws(":", F.lit("XX"), F.lit("nation"), F.lit("2024"), "n_name").alias("key"))


KINDS = "[" + ", ".join("NULL" if k is None else f"'{k}'" for _, k in PLACES) + "]"


@QUERIES.add("txt8_feature_kind", sql("s", f"SELECT id, {KINDS}[id % {len(PLACES)} + 1] AS type FROM s"))
def txt8(spark: SparkSession, sf: str) -> DataFrame:
    return named(spark, sf).select("id", tx.feature_kind(F.create_map(F.lit("name"), F.col("label"))).alias("type"))


@QUERIES.add("txt9_lookalikes", sql("s", f"SELECT id FROM s WHERE regexp_matches({sql_pick(NAMES, 'id')}, '{tx.LOOKALIKE}', 'i')"))
def txt9(spark: SparkSession, sf: str) -> DataFrame:
    return named(spark, sf).filter(tx.like(F.col("label"), tx.LOOKALIKE)).select("id")


LISTED = (("food/shop>farmers_market", "market"), ("farmers_market", "market"), ("grain_mill", "mill"), ("warehouse", None), ("professional_service", None), ("dairy_farm_supply", "milk_centre"), ("hotel", None), ("tea_manufacturer", "tea_factory"), ("seed_store", "agro_shop"), ("unknown", None))


@QUERIES.add("txt10_listing_kind", sql("s", "SELECT id, CASE WHEN (id % 10) / 10.0 >= 0.5 THEN [" + ", ".join("NULL" if k is None else f"'{k}'" for _, k in LISTED) + f"][id % {len(LISTED)} + 1] END AS type FROM s"))
def txt10(spark: SparkSession, sf: str) -> DataFrame:
    """Listings with a category, or with a hierarchy whose last step says more than the category."""
    steps = F.split(pick([c for c, _ in LISTED], F.col("id")), "[>]")
    listing = F.to_json(F.struct(F.lit("Plain place").alias("name"), F.get(steps, F.lit(0)).alias("category"), steps.alias("hierarchy"), ((F.col("id") % 10) / 10.0).alias("confidence")))
    p = sites(spark, sf).select("id", F.from_json(listing, "name string, category string, hierarchy array<string>, confidence double").alias("p"))
    return p.select("id", tx.listing_kind(F.col("p.name"), F.col("p.category"), F.col("p.confidence"), F.col("p.hierarchy")).alias("type"))


@QUERIES.add("txt11_selected_tags", "SELECT p_partkey AS id, p_name AS name, CAST(2 AS INTEGER) AS kept FROM part")
def txt11(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.create_map(F.lit("name"), F.col("p_name"), F.lit("shop"), F.col("p_type"), F.lit("colour"), F.lit("red"))
    kept = F.map_filter(tags, lambda k, _: k.isin("name", "operator", "amenity", "shop", "industrial", "product"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), kept.alias("t")).select("id", F.col("t")["name"].alias("name"), F.size("t").alias("kept"))


CODES = list(tx.ROAD_CLASS)


@QUERIES.add("txt12_class_speed", "SELECT p_partkey AS id, m[k] AS highway, CAST(s[m[k]] AS INTEGER) AS kph FROM (SELECT p_partkey, " + sql_pick(CODES, "p_partkey") + " AS k, MAP " + "{" + ", ".join(f"'{a}': '{b}'" for a, b in tx.ROAD_CLASS.items()) + "} AS m, MAP {" + ", ".join(f"'{a}': {b}" for a, b in tx.SPEEDS.items()) + "} AS s FROM part)")
def txt12(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.road_class(pick(CODES, F.col("p_partkey"))).alias("highway"))
    return rows.withColumn("kph", tx.class_speed(F.col("highway")))


SURFACES = ["asphalt", "gravel", "mud", "none", "compacted", "paved", "sand"]
HIGHWAYS = ["primary", "track", "residential", "trunk_link", "path"]


@QUERIES.add("txt13_rain_factor", "SELECT p_partkey AS id, CAST(CASE WHEN s IN ('asphalt', 'paved') THEN 0.9 WHEN s IN ('gravel', 'compacted') THEN 0.7 WHEN s IN ('mud', 'sand') THEN 0.45 WHEN h IN ('primary', 'trunk_link') THEN 0.85 WHEN h IN ('track', 'path') THEN 0.45 ELSE 0.6 END AS DOUBLE) AS factor FROM (SELECT p_partkey, " + sql_pick(SURFACES, "p_partkey") + " AS s, " + sql_pick(HIGHWAYS, "p_size") + " AS h FROM part)")
def txt13(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.rain_factor(pick(HIGHWAYS, F.col("p_size")), pick(SURFACES, F.col("p_partkey"))).alias("factor"))


@QUERIES.add("txt14_speed_limit", "SELECT p_partkey AS id, CAST(CASE p_size % 4 WHEN 0 THEN round(p_size * 1.609344, 6) WHEN 1 THEN p_size WHEN 2 THEN p_size END AS DOUBLE) AS kph FROM part")
def txt14(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("p_size").cast("string"), F.col("p_size") % 4
    limit = F.when(k == 0, F.concat(n, F.lit(" mph"))).when(k == 1, n).when(k == 2, F.concat(n, F.lit(" km/h"))).otherwise("walk")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), r6(tx.speed_limit(limit)).alias("kph"))


#: Ways that a task asks the policy about: they are few bytes but much work, so a file of them is too much for one task.
WAYS_A_TASK = 20_000


@QUERIES.add("txt15_way_policy", """SELECT mode, season, status, count(*) AS n, CAST(round(sum(kph), 4) AS DOUBLE) AS kph FROM (SELECT mode, season, status, CASE WHEN status = 'retained' THEN CASE WHEN p_size % 5 = 0 AND mode <> 'foot' THEN least(speed, 20) ELSE speed END END AS kph FROM (SELECT p_size, mode, season,
CASE h WHEN 'primary' THEN 50 WHEN 'track' THEN 15 WHEN 'path' THEN 5 WHEN 'trunk_link' THEN 40 END * CASE WHEN s = 'asphalt' THEN CASE season WHEN 'dry' THEN 1.0 ELSE 0.9 END WHEN s = 'dirt' THEN CASE season WHEN 'dry' THEN 0.7 END ELSE CASE season WHEN 'dry' THEN 0.8 ELSE 0.5 END END AS speed,
CASE WHEN h = 'canal' THEN 'unconfigured_highway' WHEN p_partkey % 17 = 0 THEN 'unsupported_restriction_review' WHEN p_partkey % 13 = 0 THEN 'access_restricted_or_unresolved' WHEN mode = 'strict' THEN 'access_unknown' WHEN s = 'ice' THEN 'surface_unconfigured' WHEN s = 'dirt' AND season = 'wet' THEN 'scenario_impassable' WHEN mode = 'foot' AND p_partkey % 11 = 0 AND h = 'path' THEN 'pedestrian_oneway_ambiguous' WHEN mode <> 'foot' AND p_partkey % 11 = 0 THEN 'oneway_unresolved' WHEN mode <> 'foot' AND p_size % 7 = 0 AND p_size % 5 <> 0 THEN 'maxspeed_unresolved' ELSE 'retained' END AS status
FROM (SELECT *, ['primary', 'track', 'path', 'trunk_link', 'canal'][p_partkey % 5 + 1] AS h, ['asphalt', 'dirt', 'UNKNOWN', 'ice'][p_partkey % 4 + 1] AS s FROM part), (SELECT unnest(['dry', 'wet']) AS season), (SELECT unnest(['vehicle', 'strict', 'foot']) AS mode))) GROUP BY mode, season, status""")
def txt15(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    pairs = F.array(*[F.struct(F.lit(a).alias("key"), b.alias("value")) for a, b in (
        ("highway", pick(["primary", "track", "path", "trunk_link", "canal"], k)), ("surface", pick(["asphalt", "dirt", "UNKNOWN", "ice"], k)), ("maxweight", F.when(k % 17 == 0, "3")),
        ("access", F.when(k % 13 == 0, "private")), ("oneway", F.when(k % 11 == 0, "reversible")), ("maxspeed", F.when(n % 5 == 0, "20").when(n % 7 == 0, "signals")))])
    tags = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    parts = read(spark, sf, "part").select("p_partkey", "p_size")
    rows = parts.repartition(max(1, -(-parts.count() // WAYS_A_TASK))).select(tags.alias("tags"))
    modes = (("vehicle", {}), ("strict", {"missing_access": "exclude"}), ("foot", {"mode": "foot"}))
    cases = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(s).alias("season"), tx.way_policy(F.col("tags"), s, **how).alias("p")) for m, how in modes for s in ("dry", "wet")])
    each = rows.select(F.explode(cases).alias("x")).select("x.mode", "x.season", "x.p.*")
    return each.groupBy("mode", "season", "status").agg(F.count("*").alias("n"), F.round(F.sum("forward_kph"), 4).alias("kph"))


@QUERIES.add("txt16_published_number", "SELECT l_orderkey, count(*) FILTER (l_linenumber % 3 <> 0) AS known, CAST(round(coalesce(sum(l_quantity) FILTER (l_linenumber % 3 <> 0), 0), 4) AS DOUBLE) AS total FROM lineitem GROUP BY l_orderkey")
def txt16(spark: SparkSession, sf: str) -> DataFrame:
    value = tx.published_number(F.col("l_quantity").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "F"))
    return read(spark, sf, "lineitem").select("l_orderkey", value.alias("v")).groupBy("l_orderkey").agg(F.count("v").alias("known"), F.round(F.coalesce(F.sum("v"), F.lit(0.0)), 4).alias("total"))


@QUERIES.add("txt17_district_of_area", "SELECT c_custkey AS id, n_name AS district FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_custkey % 3 <> 0")
def txt17(spark: SparkSession, sf: str) -> DataFrame:
    """The first part of an address that is a district's name, without the word District; null if none is."""
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation").select(F.col("n_name").alias("district"), F.lower("n_name").alias("key"))
    address = F.when(F.col("c_custkey") % 3 == 0, "Somewhere, Elsewhere").otherwise(F.concat(F.lit("A Village, NATION_"), F.col("c_nationkey").cast("string"), F.lit(" District, XX")))
    parts = c.select(F.col("c_custkey").alias("id"), F.posexplode(F.split(address, ",")).alias("pos", "part")).withColumn("key", F.lower(F.trim(F.regexp_replace("part", r"(?i)\s+district\s*$", ""))))
    return parts.join(n, "key", "left").groupBy("id").agg(F.min_by("district", F.when(F.col("district").isNotNull(), F.col("pos"))).alias("district"))


@QUERIES.add("txt18_significant_digits", "SELECT o_orderkey AS id, round(o_totalprice / pow(10, floor(log10(o_totalprice)) - 1)) * pow(10, floor(log10(o_totalprice)) - 1) AS rounded FROM orders")
def txt18(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), round_significant(F.col("o_totalprice")).alias("rounded"))


@QUERIES.add("txt19_text_search", "SELECT p_partkey AS id, p_name AS name, CAST(row_number() OVER (ORDER BY (p_name = 'red widget') DESC, p_partkey) AS INTEGER) AS pos FROM part WHERE contains(p_name, 'red') QUALIFY pos <= 12")
def txt19(spark: SparkSession, sf: str) -> DataFrame:
    hits = read(spark, sf, "part").filter(F.contains(F.lower("p_name"), F.lit("red"))).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    top = hits.orderBy(F.desc(F.col("name") == "red widget"), "id").limit(12)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc(F.col("name") == "red widget"), "id")))


@QUERIES.add("uni1_unit_dimension", "SELECT p_partkey AS id, (u IN ('t', 'kt') AND d = 'mass') OR (u = 'kW' AND d = 'power') OR (u = 'kWh' AND d = 'energy' AND p_size % 2 = 0) AS consistent FROM (SELECT *, ['t', 'kt', 'kW', 'kWh'][p_partkey % 4 + 1] AS u, ['mass', 'power', 'energy'][p_partkey % 3 + 1] AS d FROM part)")
def uni1(spark: SparkSession, sf: str) -> DataFrame:
    u, d = pick(["t", "kt", "kW", "kWh"], F.col("p_partkey")), pick(["mass", "power", "energy"], F.col("p_partkey"))
    period = F.when(F.col("p_size") % 2 == 0, "year")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), rules.unit_consistent(u, d, period).alias("consistent"))


@QUERIES.add("uni2_kilotonnes", "SELECT o_orderkey AS id, round(o_totalprice * 1000, 4) AS tonnes, true AS checked FROM orders")
def uni2(spark: SparkSession, sf: str) -> DataFrame:
    kt = F.col("o_totalprice")
    t = rules.converted(kt, F.lit("kt"), F.lit("t"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(t, 4).alias("tonnes"), rules.conversion_holds(kt, 1000.0, t).alias("checked"))


@QUERIES.add("uni3_comparable_difference", "SELECT l_orderkey AS id, count(*) AS n, round(sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN l_quantity - l_tax END), 6) AS diff FROM lineitem GROUP BY l_orderkey")
def uni3(spark: SparkSession, sf: str) -> DataFrame:
    """Differences only where units and periods are the same; others are null, not zero."""
    same = ((F.col("l_returnflag"), F.lit("A")), (F.col("l_linestatus"), F.lit("F")))
    l = read(spark, sf, "lineitem").select("l_orderkey", rules.comparable_difference(F.col("l_quantity"), F.col("l_tax"), *same).alias("d"))
    return l.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), r6(F.sum("d")).alias("diff"))


@QUERIES.add("uni4_airflow", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN NULL ELSE round(p_size * 0.000471947443 / 0.0272155422, 8) END AS m3_s_t, CASE WHEN p_size % 3 = 0 THEN 'basis unknown' WHEN p_size % 5 = 0 THEN 'basis differs' END AS reason FROM part")
def uni4(spark: SparkSession, sf: str) -> DataFrame:
    """Cubic feet a minute for a bushel of 60 pounds to cubic metres a second for a tonne; null with a reason on another basis."""
    basis = F.when(F.col("p_size") % 3 == 0, None).when(F.col("p_size") % 5 == 0, "bushel_48lb").otherwise("bushel_60lb")
    flow = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), rules.airflow(F.col("p_size"), basis).alias("f"))
    return flow.select("id", F.round("f.value", 8).alias("m3_s_t"), "f.reason")


@QUERIES.add("uni5_other_crop", "SELECT o_custkey AS id, round(sum(o_totalprice) - sum(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS other FROM orders GROUP BY o_custkey")
def uni5(spark: SparkSession, sf: str) -> DataFrame:
    """All minus one crop by region; null if either is null."""
    o = read(spark, sf, "orders")
    both = o.withColumn("crop", F.when(F.col("o_orderstatus") == "F", "durum").otherwise("rest")).groupBy("o_custkey").pivot("crop", ["durum", "rest"]).agg(F.sum("o_totalprice"))
    total = F.coalesce("durum", F.lit(0.0)) + F.coalesce("rest", F.lit(0.0))
    return both.select(F.col("o_custkey").alias("id"), F.round(total - F.col("durum"), 4).alias("other"))


@QUERIES.add("uni6_evidence", "SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS value, CASE WHEN p_size % 7 = 0 THEN 'UNKNOWN' ELSE 'OBSERVED' END AS label, CASE WHEN p_size % 7 = 0 THEN 'not published' END AS reason, CASE WHEN p_size % 7 = 0 THEN '' ELSE 'a|b' END AS sources FROM part")
def uni6(spark: SparkSession, sf: str) -> DataFrame:
    e = checks.evidence(F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")), "OBSERVED", "not published", "b")
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), e.alias("e"))
    union = F.when(F.size("e.source_ids") > 0, F.array_sort(F.array_union("e.source_ids", F.array(F.lit("a"))))).otherwise(F.col("e.source_ids"))
    return rows.select("id", "e.value", "e.label", F.col("e.missing_reason").alias("reason"), F.concat_ws("|", union).alias("sources"))


@QUERIES.add("uni7_storage_usable", "SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'unknown' WHEN p_size % 5 = 1 THEN 'unresolved' ELSE 'known' END AS state, CASE WHEN p_size % 5 = 0 THEN 'invalid storage' WHEN p_size % 5 = 1 THEN 'zero storage' END AS issue FROM part")
def uni7(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("p_size") % 5 == 0, -1.0).when(F.col("p_size") % 5 == 1, 0.0).otherwise(F.col("p_retailprice"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), rules.storage_state(v).alias("s")).select("id", "s.*")


@QUERIES.add("joi1_checked_many_to_one", "SELECT count(*) AS rows_before, count(*) AS rows_after, count(*) FILTER (c_custkey IS NULL OR c_acctbal < 0) AS unmatched FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def joi1(spark: SparkSession, sf: str) -> DataFrame:
    right = read(spark, sf, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return checks.many_to_one(read(spark, sf, "orders"), right, "o_custkey", audit=True)


@QUERIES.add("joi2_identity_crosswalk", "SELECT s_suppkey AS id, s_nationkey AS district, s_name AS name FROM supplier")
def joi2(spark: SparkSession, sf: str) -> DataFrame:
    """One to one between suppliers and the numbers that their names carry; a row without its partner, on either side, would raise."""
    s = read(spark, sf, "supplier")
    named = s.select(F.regexp_extract("s_name", "([0-9]+)$", 1).cast("long").alias("id"), F.col("s_name").alias("name"))
    return checks.one_to_one(s.select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_nationkey").alias("district")), named, "id")


@QUERIES.add("joi3_name_join", "WITH a AS (SELECT DISTINCT upper(p_name) AS k FROM part WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT upper(p_name) AS k FROM part WHERE p_partkey % 3 = 0) SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'matched' END AS status FROM a FULL JOIN b ON a.k = b.k")
def joi3(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    keys = lambda m: p.filter(F.col("p_partkey") % m == 0).select(tx.normal_name(F.col("p_name")).alias("key")).distinct()
    a, b = keys(2), keys(3)
    mark = lambda df, s: df.withColumn("status", F.lit(s))
    return mark(a.join(b, "key"), "matched").union(mark(a.join(b, "key", "left_anti"), "left_only")).union(mark(b.join(a, "key", "left_anti"), "right_only"))


@QUERIES.add("joi4_reconciliation", "WITH c AS (SELECT p_brand, p_type, p_size, count(*) AS n, min(p_retailprice) AS v FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL) SELECT p_partkey AS id, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, coalesce(n = 1 AND abs(v - p_retailprice) > 0.5, false) AS disagrees FROM part LEFT JOIN c USING (p_brand, p_type, p_size) WHERE p_partkey % 2 = 0")
def joi4(spark: SparkSession, sf: str) -> DataFrame:
    p, keys = read(spark, sf, "part"), ["p_brand", "p_type", "p_size"]
    c = p.filter("p_partkey % 2 = 1").groupBy(*keys).agg(F.count("*").alias("n"), F.min("p_retailprice").alias("v"))
    j = p.filter("p_partkey % 2 = 0").join(c, keys, "left")
    return j.select(F.col("p_partkey").alias("id"), F.when(F.col("n").isNull(), "unmatched").when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("status"), F.coalesce((F.col("n") == 1) & (F.abs(F.col("v") - F.col("p_retailprice")) > 0.5), F.lit(False)).alias("disagrees"))


@QUERIES.add("joi17_per_capita_fallback", "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 99.0::DOUBLE WHEN n_nationkey IS NOT NULL THEN CAST(n_nationkey AS DOUBLE) WHEN c_custkey % 10 < 8 THEN 50.0 END AS per_capita, CASE WHEN c_custkey % 10 = 0 THEN 'user' WHEN n_nationkey IS NOT NULL THEN 'district' WHEN c_custkey % 10 < 8 THEN 'national' ELSE 'UNKNOWN' END AS basis FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 12")
def joi17(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").withColumn("n_nationkey", F.col("c_nationkey"))
    d = read(spark, sf, "nation").filter("n_nationkey < 12").select("n_nationkey", F.col("n_nationkey").cast("double").alias("d"))
    user, nation = F.when(F.col("c_custkey") % 10 == 0, 99.0), F.when(F.col("c_custkey") % 10 < 8, 50.0)
    return c.join(d, "n_nationkey", "left").select(F.col("c_custkey").alias("id"), F.coalesce(user, F.col("d"), nation).alias("per_capita"), F.when(user.isNotNull(), "user").when(F.col("d").isNotNull(), "district").when(nation.isNotNull(), "national").otherwise("UNKNOWN").alias("basis"))


@QUERIES.add("joi18_site_draw_season", sql("s", "SELECT season, count(*) AS n, CAST(sum(id * 31 + draw) AS BIGINT) AS checksum FROM s, (SELECT unnest(range(0, 50)) AS draw), (SELECT unnest(['dry', 'rainy']) AS season) GROUP BY season"))
def joi18(spark: SparkSession, sf: str) -> DataFrame:
    """Every site with each of 50 draws and two seasons: 100 rows a site, so the small side has a fixed size."""
    cases = spark.range(50).select(F.col("id").alias("draw")).crossJoin(spark.createDataFrame([("dry",), ("rainy",)], "season string"))
    return sites(spark, sf).crossJoin(F.broadcast(cases)).groupBy("season").agg(F.count("*").alias("n"), F.sum(F.col("id") * 31 + F.col("draw")).alias("checksum"))


@QUERIES.add("joi19_reference_integrity", "SELECT 'orphan_orders' AS name, count(*) FILTER (c_custkey IS NULL) AS faults FROM orders LEFT JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'orphan_lines', count(*) FILTER (o_orderkey IS NULL) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'repeated_lines', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def joi19(spark: SparkSession, sf: str) -> DataFrame:
    o, c, l = (read(spark, sf, t) for t in ("orders", "customer", "lineitem"))
    count = lambda df, name: df.agg(F.count("*").alias("faults")).select(F.lit(name).alias("name"), "faults")
    return count(o.join(c, o.o_custkey == c.c_custkey, "left_anti"), "orphan_orders").union(count(l.join(o, l.l_orderkey == o.o_orderkey, "left_anti"), "orphan_lines")).union(count(l.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1"), "repeated_lines"))


@QUERIES.add("joi20_node_trace", "SELECT s_suppkey AS id, CASE WHEN n_nationkey IS NULL THEN 'no_region' WHEN p_size % 7 = 0 THEN 'capacity_unknown' WHEN l.q IS NULL THEN 'no_production' ELSE 'complete' END AS status, round(l.q, 4) AS tonnes, CASE WHEN p_size % 7 <> 0 THEN p_size END AS capacity FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN part ON p_partkey = s_suppkey LEFT JOIN (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1 GROUP BY 1) l ON l_suppkey = s_suppkey")
def joi20(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("has"))
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("s_suppkey"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("capacity"))
    l = read(spark, sf, "lineitem").filter("l_returnflag = 'A' AND l_linenumber = 1").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("q"))
    t = read(spark, sf, "supplier").join(n, "s_nationkey", "left").join(p, "s_suppkey", "left").join(l, "s_suppkey", "left")
    return t.select(F.col("s_suppkey").alias("id"), F.when(F.col("has").isNull(), "no_region").when(F.col("capacity").isNull(), "capacity_unknown").when(F.col("q").isNull(), "no_production").otherwise("complete").alias("status"), F.round("q", 4).alias("tonnes"), "capacity")


@QUERIES.add("joi21_group_predictions", "SELECT l_suppkey AS point, count(*) AS members, CASE WHEN count(*) FILTER (l_linenumber = 7) = 0 THEN round(sum(l_quantity), 4) END AS predicted, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS block, concat_ws('|', CASE WHEN count(*) FILTER (l_linenumber = 7) > 0 THEN 'unknown_member' END, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'several_blocks' END) AS reasons FROM lineitem GROUP BY l_suppkey")
def joi21(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("l_linenumber") != 7, F.col("l_quantity"))
    g = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("point")).agg(F.count("*").alias("members"), F.round(checks.guarded_sum(v), 4).alias("predicted"), F.collect_set("l_returnflag").alias("b"))
    one = F.size("b") == 1
    return g.select("point", "members", "predicted", F.when(one, F.get("b", F.lit(0))).alias("block"), F.concat_ws("|", F.when(F.col("predicted").isNull(), "unknown_member"), F.when(~one, "several_blocks")).alias("reasons"))


@QUERIES.add("joi22_label_corrections", sql("s", "SELECT a.id AS correction, count(*) AS hits, max(s.id) AS site FROM s a JOIN s ON a.district = s.district AND abs(a.x + 0.000001 - s.x) <= 0.00001 AND abs(a.y - s.y) <= 0.00001 WHERE a.id % 5 = 0 GROUP BY a.id"))
def joi22(spark: SparkSession, sf: str) -> DataFrame:
    """Corrections by district and place within a tolerance; each must hit one row, which the count shows. Rounded places, and their neighbours, make the join an equi-join."""
    s = sites(spark, sf)
    fix = s.filter("id % 5 = 0").select(F.col("id").alias("correction"), "district", (F.col("x") + 0.000001).alias("cx"), F.col("y").alias("cy"), F.explode(F.array(*[F.floor(F.col("x") * 1000) + d for d in (-1, 0, 1)])).alias("k"))
    return fix.join(s.withColumn("k", F.floor(F.col("x") * 1000)), ["district", "k"]).filter((F.abs(F.col("cx") - F.col("x")) <= 1e-5) & (F.abs(F.col("cy") - F.col("y")) <= 1e-5)).groupBy("correction").agg(F.count("*").alias("hits"), F.max("id").alias("site"))


@QUERIES.add("joi24_semi_anti", "SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def joi24(spark: SparkSession, sf: str) -> DataFrame:
    o, c, l = (read(spark, sf, t) for t in ("orders", "customer", "lineitem"))
    kept = o.join(c.filter("c_mktsegment = 'BUILDING'"), o.o_custkey == c.c_custkey, "left_semi")
    return kept.join(l.filter("l_returnflag = 'R'"), kept.o_orderkey == l.l_orderkey, "left_anti").select(F.col("o_orderkey").alias("id"))


@QUERIES.add("set1_kept_plus_excluded", "SELECT CASE WHEN c_acctbal >= 0 THEN 'kept' ELSE 'negative balance' END AS part, count(*) AS n FROM customer GROUP BY 1")
def set1(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    kept, out = c.filter("c_acctbal >= 0").select(F.lit("kept").alias("part")), c.filter("NOT coalesce(c_acctbal >= 0, false)").select(F.lit("negative balance").alias("part"))
    return kept.union(out).groupBy("part").agg(F.count("*").alias("n"))


TOP = "t AS (SELECT o_orderkey % 20 AS draw, o_custkey AS site, row_number() OVER (PARTITION BY o_orderkey % 20 ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderkey % 20 ORDER BY o_totalprice * (1 + (o_orderkey % 7) / 20.0) DESC, o_orderkey) AS b FROM orders)"


def two_tops(spark: SparkSession, sf: str) -> DataFrame:
    """(draw, before, after): ten best orders of each draw by two scores, as sets."""
    o = read(spark, sf, "orders").withColumn("draw", F.col("o_orderkey") % 20)

    def best(v, name: str) -> DataFrame:  # Spark keeps ten of each draw in each task before it shuffles
        r = F.row_number().over(Window.partitionBy("draw").orderBy(F.desc(v), "o_orderkey"))
        return o.select("draw", "o_orderkey", r.alias("r")).filter("r <= 10").groupBy("draw").agg(F.collect_set("o_orderkey").alias(name))

    return best(F.col("o_totalprice"), "before").join(best(F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 7) / 20.0), "after"), "draw")


TOPS = TOP.replace("o_custkey AS site", "o_orderkey AS site")


@QUERIES.add("set2_top_list_changes", f"WITH {TOPS} SELECT draw, count(*) FILTER (a <= 10 AND b > 10) AS removed, count(*) FILTER (b <= 10 AND a > 10) AS added, count(*) FILTER (a <= 10 OR b <= 10) AS either FROM t GROUP BY draw")
def set2(spark: SparkSession, sf: str) -> DataFrame:
    size = lambda c: F.size(c).cast("long")
    return two_tops(spark, sf).select("draw", size(F.array_except("before", "after")).alias("removed"), size(F.array_except("after", "before")).alias("added"), size(F.array_union("before", "after")).alias("either"))


@QUERIES.add("set3_same_universe", "SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS only_left, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_right")
def set3(spark: SparkSession, sf: str) -> DataFrame:
    a, b = read(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct(), read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return a.exceptAll(b).agg(F.count("*").alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right")))


@QUERIES.add("set4_overlap_with_baseline", f"WITH {TOPS} SELECT draw, count(*) FILTER (a <= 10 AND b <= 10) AS overlap FROM t GROUP BY draw")
def set4(spark: SparkSession, sf: str) -> DataFrame:
    return two_tops(spark, sf).select("draw", F.size(F.array_intersect("before", "after")).cast("long").alias("overlap"))


@QUERIES.add("set5_repeat_audit", "SELECT l_orderkey AS way, l_linenumber AS version, count(*) AS copies, count(DISTINCT (l_partkey, l_suppkey)) AS contents, CASE WHEN count(DISTINCT (l_partkey, l_suppkey)) > 1 THEN 'conflicting' WHEN count(*) > 1 THEN 'identical' ELSE 'single' END AS status FROM lineitem GROUP BY 1, 2")
def set5(spark: SparkSession, sf: str) -> DataFrame:
    print_ = F.sha2(F.concat_ws("|", "l_partkey", "l_suppkey"), 256)
    g = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("way"), F.col("l_linenumber").alias("version")).agg(F.count("*").alias("copies"), F.count_distinct(print_).alias("contents"))
    return g.withColumn("status", F.when(F.col("contents") > 1, "conflicting").when(F.col("copies") > 1, "identical").otherwise("single"))


@QUERIES.add("set6_union_of_places", "SELECT CAST(s_suppkey AS BIGINT) AS id FROM supplier UNION SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")
def set6(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")).union(read(spark, sf, "customer").filter("c_custkey % 3 = 0").select("c_custkey")).dropDuplicates(["id"])


@QUERIES.add("qua1_evidence_rule", "SELECT 'good' AS field, 0::BIGINT AS faults UNION ALL SELECT 'odd', count(*) FILTER (p_size % 10 = 0) FROM part")
def qua1(spark: SparkSession, sf: str) -> DataFrame:
    good = checks.evidence(F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")), "OBSERVED", "not published", "a")
    odd = F.struct(F.lit(None).cast("double").alias("value"), F.when(F.col("p_size") % 10 == 0, "OBSERVED").otherwise("UNKNOWN").alias("label"), F.lit("no figure").alias("missing_reason"))
    return checks.evidence_faults(read(spark, sf, "part").select(good.alias("good"), odd.alias("odd")), ["good", "odd"])


@QUERIES.add("qua3_data_verification", "SELECT 'orders' AS name, count(*) AS n, count(DISTINCT o_orderkey) AS ids, 0::BIGINT AS orphans FROM orders UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_orderkey), count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)) FROM lineitem")
def qua3(spark: SparkSession, sf: str) -> DataFrame:
    o, l = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    a = o.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("ids"), F.lit(0).cast("long").alias("orphans")).select(F.lit("orders").alias("name"), "*")
    known = o.select(F.col("o_orderkey").alias("l_orderkey")).distinct().withColumn("_ok", F.lit(1))
    b = l.join(known, "l_orderkey", "left").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("ids"), F.count_if(F.col("_ok").isNull()).alias("orphans")).select(F.lit("lineitem").alias("name"), "*")
    return a.union(b)
