"""Readers and writers: files whose form is checked as they are read, and outputs with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pinned(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(path, size, sha256, status) of the files under path against a manifest (name, sha256, restricted); missing ones too."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("own"))
    j = found.join(manifest, "name", "full_outer")
    status = F.when(F.col("restricted"), "skipped").when(F.col("own").isNull(), "missing").when(F.col("sha256").isNull(), "not listed").when(F.col("own") == F.col("sha256"), "ok").otherwise("mismatch")
    return j.select("name", "size", F.col("own").alias("sha256"), status.alias("status"))


def geojson_features(texts: DataFrame, text: str, properties: str, crs: str = "EPSG:4326") -> DataFrame:
    """A row a feature of FeatureCollections held as text: its properties, lon and lat. Another CRS, or none, raises."""
    kind = f"struct<type:string,crs:string,features:array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:array<double>>>>>"
    c = texts.select(F.from_json(text, kind).alias("c")).select(F.when(F.col("c.crs") == crs, F.col("c.features")).otherwise(F.raise_error(F.lit("the collection's CRS isn't declared as expected"))).alias("f"))
    return c.select(F.explode("f").alias("f")).select("f.properties.*", F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))


def csv_rows(spark: SparkSession, path: str, schema: str, required: tuple[str, ...]) -> DataFrame:
    """A CSV file with a header by a declared schema; the header must hold the required columns."""
    head = spark.read.text(path).limit(1).first()
    names = [] if head is None else [c.strip().strip('"') for c in head[0].split(",")]
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"{path} lacks the columns {missing}")
    fields = {f.name: f for f in T._parse_datatype_string(schema).fields}
    given = T.StructType([fields.get(n, T.StructField(n, T.StringType())) for n in names])
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(given).csv(path).select(*fields)


def checked_units(df: DataFrame, unit: str, factor: str, expected: tuple[str, str]) -> DataFrame:
    """df, where rows of another unit or factor raise."""
    ok = (F.col(unit) == expected[0]) & (F.col(factor) == expected[1])
    return df.withColumn(unit, F.when(ok, F.col(unit)).otherwise(F.raise_error(F.concat(F.lit("another unit: "), F.col(unit), F.lit(" "), F.col(factor)))))


def element_place(e: str) -> Column:
    """lon and lat of a map element: its own, its centre, the mean of its line, or the middle of its bounds."""
    mean = lambda part: F.aggregate(F.col(f"{e}.geometry.{part}"), F.lit(0.0), lambda s, v: s + v) / F.size(f"{e}.geometry")
    line = F.size(f"{e}.geometry") > 0
    lon = F.coalesce(F.col(f"{e}.lon"), F.col(f"{e}.center.lon"), F.when(line, mean("lon")), (F.col(f"{e}.bounds.minlon") + F.col(f"{e}.bounds.maxlon")) / 2)
    lat = F.coalesce(F.col(f"{e}.lat"), F.col(f"{e}.center.lat"), F.when(line, mean("lat")), (F.col(f"{e}.bounds.minlat") + F.col(f"{e}.bounds.maxlat")) / 2)
    return F.struct(lon.alias("lon"), lat.alias("lat"))


ELEMENTS = "struct<elements:array<struct<type:string,id:bigint,lon:double,lat:double,center:struct<lon:double,lat:double>,geometry:array<struct<lon:double,lat:double>>,bounds:struct<minlon:double,minlat:double,maxlon:double,maxlat:double>,tags:map<string,string>>>>"


def map_elements(texts: DataFrame, text: str) -> DataFrame:
    """(type, id, tags, lon, lat) of the elements of map extracts held as JSON text."""
    e = texts.select(F.explode(F.from_json(text, ELEMENTS)["elements"]).alias("e"))
    return e.select("e.type", "e.id", "e.tags", element_place("e").alias("p")).select("type", "id", "tags", "p.lon", "p.lat")


def compact_buildings(df: DataFrame, flat: str, areas: str, key: str) -> DataFrame:
    """(key, pos, lon, lat, area) of flat lon, lat, lon, lat ... arrays; areas count only where their number agrees."""
    n = F.floor(F.size(flat) / 2)
    p = F.explode(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))).alias("pos")
    rows = df.select(key, F.col(flat).alias("_f"), F.when(F.size(areas) == n, F.col(areas)).alias("_a"), p)
    return rows.select(key, "pos", F.get("_f", F.col("pos") * 2).alias("lon"), F.get("_f", F.col("pos") * 2 + 1).alias("lat"), F.get("_a", F.col("pos")).alias("area"))


def write_with_manifest(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Writes df as canonical JSON rows (sorted by key, columns in name order) and returns the manifest (name, sha256, rows, size)
    of the files that came out."""
    spark = df.sparkSession
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).repartitionByRange(*[f"_k{i}" for i in range(len(key))]).sortWithinPartitions(*[f"_k{i}" for i in range(len(key))]).select("value").write.text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    lines = F.size(F.split(F.col("content").cast("string"), "\n")) - 1  # each row ends with a line feed
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), lines.alias("rows"), F.col("length").alias("size"))
