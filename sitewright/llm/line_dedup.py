"""Line deduplication with a sharded minimal perfect hash over the distinct lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, hand_back, key_back, slices, small_batches, small_side, text_key, written

#: Levels of the hash; keys that none of them places are kept in a list. Bits of a level for each key it gets.
LEVELS, SPACE = 24, 1.5
INDEX = "shard int, n int, sizes array<int>, bits binary, tail binary, prints binary, counts binary, firsts binary"
digest = xxhash.xxh3_128_digest


def mix(x: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of keys for one level (multiply and shift, seeds from the level)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(m)
    return x ^ (x >> np.uint64(32))


def keys_of(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """One 64-bit key of both hashes of a line."""
    return h.astype(np.int64).view(np.uint64) ^ (g.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Level sizes, the bits of all levels, the keys that no level places, and each key's slot in 0..n-1.

    A level sets the bits that exactly one of its keys hashes to; the others go to the next level. A key's slot is the
    number of bits set before its own, so that n keys fill n slots.
    """
    sizes, levels, placed, rest = [], [], [], np.arange(len(keys))
    base = 0
    at = np.full(len(keys), -1, np.int64)
    for level in range(LEVELS):
        if not len(rest):
            break
        size = int(len(rest) * SPACE) + 1
        to = (mix(keys[rest], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(to, minlength=size) == 1
        mine = alone[to]
        at[rest[mine]] = base + to[mine]
        levels.append(alone)
        sizes.append(size)
        placed.append(rest[mine])
        rest, base = rest[~mine], base + size
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    before = np.cumsum(bits) - bits
    order = np.argsort(keys[rest], kind="stable")
    slot = np.empty(len(keys), np.int64)
    on = at >= 0
    slot[on] = before[at[on]]
    slot[rest[order]] = int(bits.sum()) + np.arange(len(rest))
    return sizes, bits, keys[rest[order]], slot


class Shard:
    """The index of one shard, opened for probes."""

    def __init__(self, row: dict) -> None:
        self.sizes, self.bits = row["sizes"], np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
        self.before = np.cumsum(self.bits, dtype=np.int64) - self.bits
        self.tail, self.prints = np.frombuffer(row["tail"], np.uint64), np.frombuffer(row["prints"], np.uint32)
        self.counts, self.firsts = np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["firsts"], np.int64)
        self.set = int(self.bits.sum())

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; a key that the index doesn't hold gets some slot, which its fingerprint then refutes."""
        out, rest, base = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + (mix(keys[rest], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[rest[hit]] = self.before[at[hit]]
            rest, base = rest[~hit], base + size
        if len(rest):
            out[rest] = np.minimum(self.set + np.searchsorted(self.tail, keys[rest]), max(0, len(self.prints) - 1))
        return out


def line_hashes(docs: DataFrame, doc_id: str, text: str, shortest: int) -> DataFrame:
    """(_doc, _t, pos, h, g): lines whose key has `shortest` code points at least, with two hashes of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                lines = pc.split_pattern(batch.column(2), "\n")
                size = pc.list_value_length(lines).to_numpy()
                own = np.repeat(np.arange(len(size)), size)
                pos = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
                keys = pc.ascii_lower(pc.ascii_trim(lines.flatten(), characters=" \t\n\x0b\x0c\r"))
                on = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), shortest).to_numpy(zero_copy_only=False))
                both = b"".join(map(digest, keys.take(pa.array(on)).cast(pa.binary()).to_pylist()))
                h, g = np.frombuffer(both, ">i8").reshape(-1, 2).T
                own = pa.array(own[on])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(pos[on].astype(np.int32)), pa.array(h.astype(np.int64)), pa.array(g.astype(np.int32))], names=["_doc", "_t", "pos", "h", "g"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(doc_key(doc_id).alias("_doc"), text_key(body).alias("_t"), body.alias("_text"))
    return rows.mapInArrow(run, "_doc long, _t long, pos int, h long, g int")


def line_index(lines: DataFrame, shard_keys: int = 100_000, shards: int = 64) -> tuple[DataFrame, DataFrame, int]:
    """The index, one row a shard, its directory (shard, copies), and the number of shards.

    Lines are summed before the shuffle to one row a key: smallest document, and count (1 where all lie in one
    document). A shard gets about shard_keys keys, so a task holds a few MB. A shard that more probes than twice the
    mean will ask (a line in a large part of all documents) is given copies, and its probes are dealt out over them.
    """
    keys = lines.groupBy("h", "g").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last"), F.count("*").alias("rows"))
    keys = written(keys.select("h", "g", "first", "rows", F.when(F.col("first") < F.col("last"), F.col("rows")).otherwise(1).alias("count")), "line-keys")
    shards = max(shards, -(-keys.count() // shard_keys))
    keys = keys.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    loads = keys.groupBy("shard").agg(F.sum("rows").alias("rows"))
    mean = loads.agg(F.sum("rows")).first()[0] or 0
    copies = loads.select("shard", F.ceil(F.col("rows") * shards / F.lit(2.0 * max(mean, 1))).cast("int").alias("copies"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h, g = pdf["h"].to_numpy(), pdf["g"].to_numpy()
        sizes, bits, tail, slot = build(keys_of(h, g))
        order = np.empty(len(slot), np.int64)
        order[slot] = np.arange(len(slot))
        put = lambda c, kind: np.minimum(pdf[c].to_numpy()[order], np.iinfo(kind).max).astype(kind).tobytes()
        return pd.DataFrame([{"shard": pdf["shard"].iat[0], "n": len(h), "sizes": sizes, "bits": np.packbits(bits).tobytes(), "tail": tail.tobytes(), "prints": g[order].astype(np.int32).tobytes(), "counts": put("count", np.uint32), "firsts": put("first", np.int64)}])

    return keys.groupBy("shard").applyInPandas(one, INDEX), written(copies, "line-directory"), shards


def probe(lines: DataFrame, index: DataFrame, directory: DataFrame, shards: int) -> DataFrame:
    """(_doc, _t, pos) of the lines that several documents hold and whose first document is another.

    Probes go to their shard's arrays: both are dealt by (shard, copy) and sorted so that arrays come first, and a task
    then streams through them with one shard open at a time.
    """
    directory = small_side(directory, 1 << 20)
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrays = index.join(directory, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    asked = lines.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).join(directory, "shard").withColumn("copy", F.pmod(F.xxhash64("_doc", "pos"), F.col("copies")).cast("int")).drop("copies")
    rows = arrays.unionByName(asked, allowMissingColumns=True).repartition(tasks, "shard", "copy").sortWithinPartitions("shard", "copy", F.col("n").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            heads = np.flatnonzero(t["n"].is_valid().to_numpy())
            cuts = sorted({0, *heads.tolist(), *(heads + 1).tolist(), t.num_rows})
            for a, b in zip(cuts, cuts[1:]):
                part = t.slice(a, b - a)
                if part["n"][0].is_valid:
                    shard = Shard(part.to_pylist()[0])
                    continue
                h, g, doc = (part[c].to_numpy() for c in ("h", "g", "_doc"))
                at = shard.slots(keys_of(h, g))
                drop = (shard.prints[at] == g.astype(np.int32).view(np.uint32)) & (shard.counts[at] >= 2) & (shard.firsts[at] != doc)
                yield pa.RecordBatch.from_arrays([pa.array(part[c].to_numpy()[drop]) for c in ("_doc", "_t", "pos")], names=["_doc", "_t", "pos"])
        hand_back()

    return rows.mapInArrow(run, "_doc long, _t long, pos int")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 10, also: tuple[str, ...] = ()) -> DataFrame:
    """Drops each line whose key is in several documents, except in the one with the smallest id.

    A key is a line without white space at both ends and with A-Z in lower case; keys under `shortest` code points
    stay. Returns (doc_id, n_lines, n_dropped, kept, *also): kept is the remaining lines joined by line feeds. A null
    text is one empty line. A null id counts as one document before all others; rows with one id count as one
    document, so a line that only they share stays; they are told apart by a 64-bit hash of their texts. An empty table
    gives no rows.
    """
    lines = written(line_hashes(docs, doc_id, text, shortest), "line-hashes")
    drops = probe(lines, *line_index(lines)).groupBy("_doc", "_t").agg(F.collect_set("pos").alias("_drop"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*also, doc_key(doc_id).alias("_doc"), text_key(body).alias("_t"), body.alias("_text")).join(drops, ["_doc", "_t"], "left").select(*also, "_doc", "_text", "_drop")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                n, out = batch.num_columns, ([], [], [])
                for text, drop in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()):
                    lines = text.split("\n")
                    if drop:
                        gone = set(drop)
                        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
                    for x, v in zip(out, (len(lines), len(drop or ()), kept if drop else text)):
                        x.append(v)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n - 2)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=[*batch.schema.names[: n - 2], "n_lines", "n_dropped", "kept"])

    out = small_batches(rows).mapInArrow(keep, ", ".join([*(f"`{c}` {kinds[c]}" for c in also), "_doc long", "n_lines long", "n_dropped long", "kept string"]))
    return out.select(key_back("_doc").alias("doc_id"), "n_lines", "n_dropped", "kept", *also)
