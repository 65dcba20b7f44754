"""Queries over sources and sinks. Files are written from the given tables to the shared folder and read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewright.functions import geo
from sitewright.functions import text as tx
from sitewright.operators import rank, spatial
from sitewright.sources import files
from sitewright.sources.tables import Queries, buildings, read, saved, shared_folder, sites, sql, zones

QUERIES = Queries()
r6 = lambda c: F.round(c, 6)


def _new(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


@QUERIES.add("src1_pinned_sources")
def src1(spark: SparkSession, sf: str) -> DataFrame:
    """The files of a table against the manifest written with them."""
    path = _new(spark, "nations")
    own = files.write_with_manifest(read(spark, sf, "nation"), path, ["n_nationkey"])
    manifest = own.select("name", "sha256", F.lit(False).alias("restricted"))
    return files.pinned(spark, f"{path}/part-*", manifest).groupBy("status").agg(F.sum("size").alias("bytes"))


@QUERIES.add("src2_registry_geojson", "SELECT s_suppkey AS id, s_name AS name, round(s_suppkey / 100.0, 6)::DOUBLE AS lon, round(-s_suppkey / 200.0, 6)::DOUBLE AS lat FROM supplier")
def src2(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.col("s_suppkey") / 100.0, -F.col("s_suppkey") / 200.0).alias("coordinates")).alias("geometry"))
    texts = s.groupBy("s_nationkey").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.lit("EPSG:4326").alias("crs"), F.collect_list(feature).alias("features"))).alias("text"))
    return files.geojson_features(texts, "text", "id:bigint,name:string").select("id", "name", r6("lon").alias("lon"), r6("lat").alias("lat"))


@QUERIES.add("src3_csv_slice", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def src3(spark: SparkSession, sf: str) -> DataFrame:
    path = _new(spark, "orders")
    read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority").write.option("header", True).csv(path)
    rows = files.csv_rows(spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string, o_orderpriority string", ("o_orderkey", "o_totalprice"))
    return rows.filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_totalprice")


@QUERIES.add("src4_production_csv", "SELECT l_suppkey AS region, l_returnflag AS crop, round(sum(l_quantity), 4) AS tonnes FROM lineitem WHERE l_returnflag IN ('A', 'R') AND year(l_shipdate) = 1998 GROUP BY ALL")
def src4(spark: SparkSession, sf: str) -> DataFrame:
    path = _new(spark, "production")
    read(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("region"), F.col("l_returnflag").alias("crop"), F.lit("t").alias("unit"), F.lit("units").alias("factor"), F.col("l_quantity").alias("value")).write.option("header", True).csv(path)
    rows = files.csv_rows(spark, path, "year int, region bigint, crop string, unit string, factor string, value double", ("year", "value", "unit")).filter("year = 1998 AND crop IN ('A', 'R')")
    return files.checked_units(rows, "unit", "factor", ("t", "units")).filter("unit IS NOT NULL").groupBy("region", "crop").agg(F.round(F.sum("value"), 4).alias("tonnes"))


@QUERIES.add("src5_census_symbols", "SELECT c_custkey AS area, CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS population, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS DOUBLE) END AS dwellings FROM customer")
def src5(spark: SparkSession, sf: str) -> DataFrame:
    """Columns by place, as each value is followed by a column of the same name, Symbols; a symbol makes the value unknown."""
    path, k = _new(spark, "census"), F.col("c_custkey")
    read(spark, sf, "customer").select(k.cast("string"), F.col("c_nationkey").cast("string"), F.when(k % 9 == 0, "F"), k.cast("string"), F.when(k % 4 == 0, "x")).toDF("a", "b", "c", "d", "e").write.csv(path)
    rows = spark.read.schema("a bigint, b string, c string, d string, e string").csv(path)
    rows = rows.groupBy("a").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in "bcde"])
    return rows.select(F.when(F.col("n") == 1, F.col("a")).otherwise(F.raise_error(F.lit("an area repeats"))).alias("area"), tx.published_number(F.col("b"), F.col("c")).alias("population"), tx.published_number(F.col("d"), F.col("e")).alias("dwellings"))


@QUERIES.add("src6_way_json_lines", "SELECT l_orderkey AS way, count(*) AS nodes, CAST(sum(l_partkey) AS BIGINT) AS checksum FROM lineitem GROUP BY 1")
def src6(spark: SparkSession, sf: str) -> DataFrame:
    path = _new(spark, "ways")
    read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("way")).agg(F.collect_list("l_partkey").alias("nodes")).write.json(path)
    w = spark.read.schema("way bigint, nodes array<bigint>").json(path)
    return w.select("way", F.size("nodes").cast("long").alias("nodes"), F.aggregate("nodes", F.lit(0).cast("long"), lambda s, v: s + v).alias("checksum"))


def extract(spark: SparkSession, sf: str) -> DataFrame:
    """Sites as map extracts, a JSON text a district: places by the four rules in turn."""
    s, k = sites(spark, sf), F.col("id") % 4
    x, y = F.col("x") / 100000, F.col("y") / 100000
    pt = lambda a, b: F.struct(a.alias("lon"), b.alias("lat"))
    e = F.struct(F.when(k == 0, "node").otherwise("way").alias("type"), F.col("id"), F.when(k == 0, x).alias("lon"), F.when(k == 0, y).alias("lat"), F.when(k == 1, pt(x, y)).alias("center"), F.when(k == 2, F.array(pt(x - 0.01, y), pt(x + 0.01, y))).alias("geometry"), F.when(k == 3, F.struct((x - 0.01).alias("minlon"), (y - 0.01).alias("minlat"), (x + 0.01).alias("maxlon"), (y + 0.01).alias("maxlat"))).alias("bounds"), F.create_map(F.lit("name"), F.col("name")).alias("tags"))
    return s.groupBy("district").agg(F.to_json(F.struct(F.collect_list(e).alias("elements"))).alias("text"))


@QUERIES.add("src7_map_elements", sql("s", "SELECT id, name, round(x / 100000, 6) AS lon, round(y / 100000, 6) AS lat FROM s"))
def src7(spark: SparkSession, sf: str) -> DataFrame:
    return files.map_elements(extract(spark, sf), "text").select("id", F.col("tags")["name"].alias("name"), r6("lon").alias("lon"), r6("lat").alias("lat"))


@QUERIES.add("src8_compact_buildings", sql("b", "SELECT nation, count(*) AS n, round(sum(x), 4) AS sx, round(sum(y), 4) AS sy, CASE WHEN nation % 3 <> 0 THEN round(sum(roof), 4) END AS roof FROM b GROUP BY nation"))
def src8(spark: SparkSession, sf: str) -> DataFrame:
    """Parallel arrays a district; a third of them lacks an area, so theirs are left out."""
    b = buildings(spark, sf).groupBy("nation").agg(F.collect_list(F.struct("x", "y", "roof")).alias("p"))
    a = b.select("nation", F.flatten(F.transform("p", lambda q: F.array(q["x"], q["y"]))).alias("flat"), F.when(F.col("nation") % 3 != 0, F.col("p.roof")).otherwise(F.slice("p.roof", 2, 1000000)).alias("areas"))
    return files.compact_buildings(a, "flat", "areas", "nation").groupBy("nation").agg(F.count("*").alias("n"), F.round(F.sum("lon"), 4).alias("sx"), F.round(F.sum("lat"), 4).alias("sy"), F.round(F.sum("area"), 4).alias("roof"))


@QUERIES.add("src10_merge_tiles", sql("b", "SELECT source, count(*) AS n, CAST(NULL AS DOUBLE) AS roof FROM b GROUP BY source"))
def src10(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of four tiles together; one has no areas, so none are used."""
    b = buildings(spark, sf)
    parts = [b.filter(F.col("id") % 4 == i).select("id", "source", *([F.col("roof")] if i else [])) for i in range(4)]
    whole = all("roof" in p.columns for p in parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out.withColumn("roof", F.col("roof") if whole else F.lit(None).cast("double"))
    return out.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("roof"), 4).alias("roof"))


@QUERIES.add("src11_single_owner_tile", sql("b", "SELECT id, CAST(floor(x / 4096) AS BIGINT) AS tx, CAST(floor(y / 4096) AS BIGINT) AS ty FROM b"))
def src11(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles overlap by 64 m, so features near an edge come several times; the tile that holds the centre keeps it."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 64) / 4096), F.floor((F.col(c) + 64) / 4096)))
    sent = buildings(spark, sf).select("id", "x", "y", span("x").alias("tx")).select("id", "x", "y", "tx", span("y").alias("ty"))
    cx, cy = F.col("x") - F.col("tx") * 4096, F.col("y") - F.col("ty") * 4096
    return sent.filter((cx >= 0) & (cx < 4096) & (cy >= 0) & (cy < 4096)).select("id", "tx", "ty")


@QUERIES.add("src12_tile_cover", sql("z", ", g AS (SELECT tx, ty, (tx + a / 4.0) * 2000 AS x, (ty + c / 4.0) * 2000 AS y FROM (SELECT unnest(range(0, 11)) AS tx), (SELECT unnest(range(0, 11)) AS ty), (SELECT unnest(range(0, 5)) AS a), (SELECT unnest(range(0, 5)) AS c)) SELECT DISTINCT zone, tx, ty FROM z, g WHERE x >= x0 AND x < x0 + 4100 AND y >= y0 AND y < y0 + 4100 UNION SELECT zone, CAST(floor(px / 2000) AS BIGINT), CAST(floor(py / 2000) AS BIGINT) FROM (SELECT zone, unnest([x0, x0 + 4100, x0, x0 + 4100]) AS px, unnest([y0, y0, y0 + 4100, y0 + 4100]) AS py FROM z)"))
def src12(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of an area: one of their 5 x 5 sample points is inside, or a vertex of the boundary is."""
    e = spatial.edges_of(zones(spark, sf)).filter("NOT hole")
    g = spark.range(11 * 11 * 25).select((F.col("id") % 11).alias("tx"), (F.floor(F.col("id") / 11) % 11).alias("ty"), (F.floor(F.col("id") / 121) % 5).alias("a"), F.floor(F.col("id") / 605).alias("c"))
    p = g.select(F.struct("tx", "ty", "a", "c").alias("id"), ((F.col("tx") + F.col("a") / 4.0) * 2000).alias("x"), ((F.col("ty") + F.col("c") / 4.0) * 2000).alias("y"))
    inside = spatial.points_in_zones(p, e, 2000).select("zone", "id.tx", "id.ty")
    corners = e.select("zone", geo.cell(F.col("x1"), 2000).alias("tx"), geo.cell(F.col("y1"), 2000).alias("ty"))
    return inside.union(corners).distinct()


@QUERIES.add("src13_artifact_manifest", "SELECT count(*) AS rows FROM customer")
def src13(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical JSON rows with a manifest of hashes and row counts; here the rows of all files."""
    return files.write_with_manifest(read(spark, sf, "customer"), _new(spark, "artifact"), ["c_custkey"]).agg(F.sum("rows").alias("rows"))


@QUERIES.add("src14_ranking_csv", "SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank, o_orderkey AS id, o_totalprice AS v FROM orders QUALIFY rank <= 10")
def src14(spark: SparkSession, sf: str) -> DataFrame:
    """The whole ranking as CSV in a fixed column order, and its shortlist read back."""
    path = _new(spark, "ranking")
    r = rank.ranked(read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v")), [F.desc("v"), "id"])
    r.select("rank", "id", "v").repartitionByRange("rank").sortWithinPartitions("rank").write.option("header", True).csv(path)
    return files.csv_rows(spark, path, "rank bigint, id bigint, v double", ("rank", "id", "v")).filter("rank <= 10")


@QUERIES.add("src15_geojson_export", sql("s", "SELECT id, kind, round(x / 100000, 5) AS lon, round(y / 100000, 5) AS lat FROM s"))
def src15(spark: SparkSession, sf: str) -> DataFrame:
    """A feature a line, as GeoJSON text, read back."""
    path, s = _new(spark, "features"), sites(spark, sf)
    f = F.struct(F.lit("Feature").alias("type"), F.struct("id", "kind").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.round(F.col("x") / 100000, 5), F.round(F.col("y") / 100000, 5)).alias("coordinates")).alias("geometry"))
    s.select(F.to_json(f).alias("value")).write.text(path)
    back = spark.read.schema("type string, properties struct<id:bigint,kind:int>, geometry struct<type:string,coordinates:array<double>>").json(path)
    return back.select("properties.id", "properties.kind", F.get("geometry.coordinates", F.lit(0)).alias("lon"), F.get("geometry.coordinates", F.lit(1)).alias("lat"))


@QUERIES.add("src16_season_csv", sql("s", "SELECT season, id, kind FROM s, (SELECT unnest(['dry', 'rainy']) AS season)"))
def src16(spark: SparkSession, sf: str) -> DataFrame:
    path = _new(spark, "seasons")
    sites(spark, sf).select(F.explode(F.array(F.lit("dry"), F.lit("rainy"))).alias("season"), "id", "kind").write.option("header", True).csv(path)
    return files.csv_rows(spark, path, "season string, id bigint, kind int", ("season", "id"))


@QUERIES.add("src17_exclusion_file", "SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN 'kept' ELSE 'excluded' END AS part, CASE WHEN c_acctbal < 0 THEN 'negative balance' END AS reason FROM customer")
def src17(spark: SparkSession, sf: str) -> DataFrame:
    """Kept rows and, with a reason, those left out: one write, a folder each, read back."""
    path, c = _new(spark, "split"), read(spark, sf, "customer")
    ok = F.coalesce(F.col("c_acctbal") >= 0, F.lit(False))
    c.select(F.col("c_custkey").alias("id"), F.when(ok, "kept").otherwise("excluded").alias("part"), F.when(~ok, "negative balance").alias("reason")).write.partitionBy("part").json(path)
    return spark.read.schema("id bigint, reason string, part string").json(path).select("id", "part", "reason")


@QUERIES.add("src20_context_layer", "SELECT DISTINCT l_orderkey AS way, l_linenumber AS version, round((l_partkey * 7351 % 20011) / 111320.0::DOUBLE, 5) AS lon FROM lineitem WHERE l_returnflag = 'A' AND (l_partkey * 7351) % 20011 <= 15000 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1")
def src20(spark: SparkSession, sf: str) -> DataFrame:
    """Major roads once a way and version, inside the domain box, with five decimals."""
    l = read(spark, sf, "lineitem").filter("l_returnflag = 'A'").withColumn("x", (F.col("l_partkey") * 7351) % 20011).filter("x <= 15000")
    one = l.groupBy(F.col("l_orderkey").alias("way"), F.col("l_linenumber").alias("version")).agg(F.min_by("x", F.struct("l_partkey", "l_suppkey")).alias("x"))
    return one.select("way", "version", F.round(F.col("x") / 111320.0, 5).alias("lon"))
