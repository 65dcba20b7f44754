"""Tables that other operators take as inputs, derived from the supplied ones by whole-number arithmetic."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
_own: dict[str, str] = {}
_saved: dict[str, list[str]] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir that all executors share; only a local session may lack the setting."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sitewright-")
    return _own[app]


def saved(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors lose nothing.

    Shuffle files of the write go once it has ended, as nothing reads them again; otherwise they would stay until the
    driver happens to collect garbage, and the disk would hold those of all steps at once. Python gets a few MB of rows at
    a time, as texts may be long. group_rows: so many rows at most stand in memory at once, as the file is written and read;
    Parquet looks at the size of what it holds only after a hundred rows, which may be megabytes each."""
    spark = df.sparkSession
    path, schema = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}"), df.schema
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.options(compression="zstd", **({"parquet.block.row.count.limit": group_rows} if group_rows else {})).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _saved.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(schema).parquet(path)
    out._saved_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables as saved() returned them, once what was made from them is saved itself; those that are gone stay so."""
    for t in tables:
        own = _saved.get(t.sparkSession.sparkContext.applicationId, [])
        if t._saved_at in own:
            own.remove(t._saved_at)
            _delete(t.sparkSession, t._saved_at)


def release(spark: SparkSession) -> None:
    """Deletes all tables of saved() in this session; call it once results are stored."""
    for path in _saved.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


#: Buildings, sites and road nodes in a strip of 20 km; more of them lie in the next strips, 25 km apart, so that places don't get denser.
BUILDINGS, SITES, NODES, STRIP = 15_000, 1_000, 20_000, 25_000.0


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, roof, source, nation)."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (((F.col("c_custkey") * 7919) % 20011) + F.floor(F.col("c_custkey") / BUILDINGS) * STRIP).alias("x"), ((F.col("c_custkey") * 104729) % 20021).cast("double").alias("y"), (F.abs("c_acctbal") / 10).alias("roof"), F.col("c_mktsegment").alias("source"), F.col("c_nationkey").alias("nation"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, kind, district, name)."""
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (((F.col("s_suppkey") * 6151) % 20011) + F.floor(F.col("s_suppkey") / SITES) * STRIP).alias("x"), ((F.col("s_suppkey") * 15013) % 20021).cast("double").alias("y"), (F.col("s_suppkey") % 8).cast("int").alias("kind"), F.col("s_nationkey").alias("district"), F.col("s_name").alias("name"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, region, rings): a square a nation, overlapping its neighbours by 100 m, each seventh with a square hole."""
    n = read(spark, sf_dir, "nation")
    x0, y0 = ((F.col("n_nationkey") % 5) * 4000).cast("double"), (F.floor(F.col("n_nationkey") / 5) * 4000).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = lambda a, b, size, hole: F.struct(F.lit(hole).alias("hole"), F.array(point(a, b), point(a + size, b), point(a + size, b + size), point(a, b + size)).alias("points"))
    outer, inner = ring(x0, y0, 4100, False), ring(x0 + 1000, y0 + 1000, 1000, True)
    return n.select(F.col("n_nationkey").alias("zone"), F.col("n_regionkey").alias("region"), F.when(F.col("n_nationkey") % 7 == 0, F.array(outer, inner)).otherwise(F.array(outer)).alias("rings"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way, highway, surface, nodes): orders of three lines or more as roads over part keys."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")  # repeats count once
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way")).agg(F.sort_array(F.collect_set(line)).alias("_n"), F.min("l_returnflag").alias("_f"), F.min("l_linestatus").alias("_s"))
    highway = F.when(F.col("_f") == "A", "primary").when(F.col("_f") == "N", "tertiary").otherwise("track")
    surface = F.when(F.col("_s") == "F", "asphalt").otherwise("dirt")
    return rows.select("way", highway.alias("highway"), surface.alias("surface"), F.transform("_n", lambda n: n["l_partkey"]).alias("nodes"))


def node_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y) of the road nodes, one a part."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return p.select("id", (((F.col("id") * 7351) % 20011) + F.floor(F.col("id") / NODES) * STRIP).alias("x"), ((F.col("id") * 9293) % 20021).cast("double").alias("y"))


#: The same tables in DuckDB's SQL, by name.
SQL = {
    "b": "b AS (SELECT c_custkey AS id, CAST((c_custkey * 7919) % 20011 + c_custkey // 15000 * 25000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 20021 AS DOUBLE) AS y, abs(c_acctbal) / 10 AS roof, c_mktsegment AS source, c_nationkey AS nation FROM customer)",
    "s": "s AS (SELECT s_suppkey AS id, CAST((s_suppkey * 6151) % 20011 + s_suppkey // 1000 * 25000 AS DOUBLE) AS x, CAST((s_suppkey * 15013) % 20021 AS DOUBLE) AS y, CAST(s_suppkey % 8 AS INTEGER) AS kind, s_nationkey AS district, s_name AS name FROM supplier)",
    "z": "z AS (SELECT n_nationkey AS zone, n_regionkey AS region, CAST((n_nationkey % 5) * 4000 AS DOUBLE) AS x0, CAST((n_nationkey // 5) * 4000 AS DOUBLE) AS y0, n_nationkey % 7 = 0 AS holed FROM nation)",
    "wn": "wn AS (SELECT l_orderkey AS way, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_partkey AS node FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem))",
    "wt": "wt AS (SELECT l_orderkey AS way, CASE min(l_returnflag) WHEN 'A' THEN 'primary' WHEN 'N' THEN 'tertiary' ELSE 'track' END AS highway, CASE min(l_linestatus) WHEN 'F' THEN 'asphalt' ELSE 'dirt' END AS surface FROM lineitem GROUP BY l_orderkey)",
    "np": "np AS (SELECT p_partkey AS id, CAST((p_partkey * 7351) % 20011 + p_partkey // 20000 * 25000 AS DOUBLE) AS x, CAST((p_partkey * 9293) % 20021 AS DOUBLE) AS y FROM part)",
    "iz": "iz AS (SELECT p.id, z.zone FROM b p, z WHERE p.x >= x0 AND p.x < x0 + 4100 AND p.y >= y0 AND p.y < y0 + 4100 AND NOT (holed AND p.x >= x0 + 1000 AND p.x < x0 + 2000 AND p.y >= y0 + 1000 AND p.y < y0 + 2000))",
    "near": "near AS (SELECT id, o.other, o.d FROM (SELECT b.id, min_by(struct_pack(other := s.id, d := sqrt((b.x-s.x)*(b.x-s.x)+(b.y-s.y)*(b.y-s.y))), (sqrt((b.x-s.x)*(b.x-s.x)+(b.y-s.y)*(b.y-s.y)), s.id)) AS o FROM b, s GROUP BY b.id))",
}


def sql(names: str, body: str) -> str:
    """A query over derived tables, named in the order in which they build on each other."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + " " + body


class Queries(dict):
    """Named queries of a module: (function, SQL or None)."""

    def add(self, name: str, text: str | None = None):
        def put(f):
            self[name] = (f, text)
            return f

        return put
