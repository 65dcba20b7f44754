"""Extendible hashing of rows into shards under a byte limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Hash bits, and bits that one round of the directory looks at.
BITS, ROUND = 60, 16


def extendible_shards(rows: DataFrame, limit: int, key: str = "doc_id", size: str = "n_bytes") -> DataFrame:
    """Deals rows out to shards of at most `limit` bytes.

    The directory starts as one bucket; a bucket over the limit splits on the next bit of the key's hash, others stay,
    so a shard is the shortest prefix whose rows fit. Byte totals are summed by 16 bits at a time (65,536 directory
    slots at most a parent), and only rows of slots that are still too large go to the next round.

    Returns (key, size, shard, depth, shard_bytes, shard_rows, oversize): the prefix as a string of bits, its length,
    totals of the shard. Null keys hash as the text 'null'; null sizes count as 0; repeated rows count each time and
    share a shard; rows with one key can't be split: if they alone exceed the limit, their shard has all 60 bits and
    oversize is true. An empty table gives no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    digest = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 15)
    left = written(rows.select(F.col(key), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size), F.conv(digest, 16, 10).cast("long").alias("_h")), "shard-keys")
    placed, done = None, 0
    while True:
        bits = min(ROUND, BITS - done)
        upto = done + bits
        here = left.withColumn("_slot", F.shiftrightunsigned("_h", BITS - upto))
        slots = written(here.groupBy("_slot").agg(F.sum(size).alias("_b"), F.count("*").alias("_n")), "shard-slots")
        depths = slots.select("_slot", "_b", "_n", F.explode(F.sequence(F.lit(done), F.lit(upto))).alias("depth"))
        depths = depths.withColumn("_prefix", F.expr(f"shiftrightunsigned(_slot, {upto} - depth)"))
        totals = depths.groupBy("depth", "_prefix").agg(F.sum("_b").alias("shard_bytes"), F.sum("_n").alias("shard_rows"))
        fits = depths.select("_slot", "depth", "_prefix").join(totals.filter((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)), ["depth", "_prefix"])
        directory = written(fits.groupBy("_slot").agg(F.min(F.struct("depth", "_prefix", "shard_bytes", "shard_rows")).alias("_at")).select("_slot", "_at.*"), "shard-directory")
        found = here.join(directory, "_slot").select(key, size, F.expr("lpad(conv(_prefix, 10, 2), depth, '0')").alias("shard"), "depth", "shard_bytes", "shard_rows")
        placed = found if placed is None else placed.unionByName(found)
        over = slots.join(directory, "_slot", "left_anti").select("_slot")
        if upto == BITS or over.isEmpty():
            return placed.withColumn("oversize", F.col("shard_bytes") > limit)
        left = written(here.join(over, "_slot", "left_semi").drop("_slot"), "shard-keys")
        done = upto


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """Writes docs under path, one folder a shard (shard=bits); rows of one shard meet in one task of bounded size.

    Null keys are one value, null texts are empty, rows with one key share a shard, and columns may have any names: with
    a column named shard the folders are _shard=bits. An empty table writes no folder."""
    rows = docs.select(F.col(key).alias("key"), F.struct("*").alias("row"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).alias("n_bytes"))
    shards = extendible_shards(rows, limit, "key").select(F.col("key").alias("of"), "shard").distinct()
    placed = rows.join(shards, F.col("key").eqNullSafe(F.col("of"))).repartition("shard")
    name = next(n for n in ("shard", "_shard", "_shard_bits") if n.lower() not in map(str.lower, docs.columns))
    placed.select(*[F.col(f"row.`{c}`") for c in docs.columns], F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
