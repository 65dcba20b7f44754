"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, doc_key, key_back, slices, small_side, text_key, written
from .components import components

#: Rows up to which a table of one or two numbers a row is broadcast (16 to 24 bytes each in most); beyond it Spark shuffles.
BROADCAST_ROWS = 500_000
#: Parity bits of a shingle set.
PARITY = 1024


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 values (seed 42) of the shingles of so many words, repeats included; fewer words: of the whole sequence."""
    found = text.lower().split()  # bytes: A-Z and ASCII white space alone
    if not found:
        return np.zeros(0, np.uint64)
    whole, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    return np.array([digest(whole[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if over half of the hashes have it; without hashes all are 0."""
    total = np.zeros(64, np.int64)
    hashes = hashes.astype(">u8")
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int) -> int:
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(_doc, fp): fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", 4 << 20):
                fps = np.array([fingerprint((t or "").encode(), words) for t in batch.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["_doc", "fp"])

    return docs.select(doc_key(doc_id).alias("_doc"), F.col(text).cast("string").alias("_text")).mapInArrow(run, "_doc long, fp long")


def ball_masks(radius: int) -> list[int]:
    """XOR masks of all variants within so many bits, as signed numbers."""
    masks = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def ball_links(nodes: DataFrame, radius: int) -> DataFrame:
    """(fp, other): links of at most `radius` bits that keep together what such links connect, of distinct fingerprints fp.

    Each emits all variants within half the radius; two within the radius meet in a variant in the middle. A variant's
    nodes are, for an even radius, all within it of one another, and there are at most as many as variants a node emits, so
    a link from each to the next in order keeps what is connected and no pairs are listed. Links are verified by their
    differing bits."""
    if radius % 2:
        raise ValueError("the radius must be even, so that two halves meet")
    masks = F.explode(F.array(*[F.lit(m) for m in ball_masks(radius // 2)])).alias("mask")
    near = nodes.select("fp", masks).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    pairs = near.withColumn("other", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))).filter(F.col("other").isNotNull())
    return pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius).select("fp", "other").distinct()


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: near-duplicate groups by links of at most `radius` bits.

    Equal fingerprints become one node first, summed before the shuffle; their links are those of ball_links.

    A null text has fingerprint zero, as one without words. A null id counts as the smallest; its component_id is null
    too. Rows with one id share a component only through their fingerprints. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, doc_id, text, words), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("_doc").alias("node")), "fingerprint-nodes")
    links = ball_links(nodes, radius)
    groups = components(links, "fp", "other").select(F.col("id").alias("fp"), "component")
    named = nodes.join(groups, "fp", "left").select("fp", "node", F.coalesce("component", "fp").alias("component"))
    first = named.groupBy("component").agg(F.min("node").alias("component_id"))
    named = written(named.join(first, "component").select("fp", "component_id"), "fingerprint-groups")
    out = rows.join(named, "fp")
    return out.select(key_back("_doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), key_back("component_id").alias("component_id"))


def prefix_size(size: Column, similarity: float) -> Column:
    """How many tokens of a set, in an order all sets share, hold one of each set that similar: without them fewer than similarity * size are left."""
    return (size - F.ceil(size * F.lit(similarity) - 1e-9) + 1).cast("int")


def shingle_rows(docs: DataFrame, doc_id: str, text: str, words: int, similarity: float) -> DataFrame:
    """(_doc, _t, size, d0, d1, fp, prefix) of every row, from its distinct shingle hashes as signed numbers in order:
    their number, a 128-bit hash of the set, its fingerprint, and the smallest ones of prefix_size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", 4 << 20):
                sets = [distinct_shingles(t, words) for t in batch.column(2).to_pylist()]
                size = np.array([len(h) for h in sets], np.int64)
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in sets), ">i8").reshape(-1, 2).astype(np.int64)
                fp = np.array([majority(h.view(np.uint64)) for h in sets], np.uint64).view(np.int64)
                first = np.where(size > 0, size - np.ceil(size * similarity - 1e-9).astype(np.int64) + 1, 0)
                prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(first)].astype(np.int32)), pa.array(np.concatenate([h[:n] for h, n in zip(sets, first)])))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(fp), prefix], names=["_doc", "_t", "size", "d0", "d1", "fp", "prefix"])

    rows = docs.select(doc_key(doc_id).alias("_doc"), text_key(F.col(text)).alias("_t"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, "_doc long, _t long, size long, d0 long, d1 long, fp long, prefix array<long>")


def distinct_shingles(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes((text or "").encode(), words).view(np.int64))


def parity(h: np.ndarray) -> np.ndarray:
    """PARITY bits as signed numbers, each telling whether an odd number of the hashes fall on it."""
    on = np.bincount((h.view(np.uint64) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(on.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, doc_id: str, text: str, words: int, ids: DataFrame, repeats: bool) -> DataFrame:
    """(node, size, hashes, odd): the number of distinct shingles, the `take` smallest hashes in order, and parity bits of all,
    of the rows in ids (node, _doc, _t, take); one row a node. repeats: whether docs may have several rows of one id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", 4 << 20):
                sets = [distinct_shingles(t, words) for t in batch.column(1).to_pylist()]
                parts = [h[:n] for h, n in zip(sets, batch.column(2).to_pylist())]
                hashes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))
                odd = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (PARITY // 64), pa.int32()), pa.array(np.concatenate([parity(h) for h in sets])))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in sets], pa.int64()), hashes, odd], names=["node", "size", "hashes", "odd"])

    rows = docs.select(doc_key(doc_id).alias("_doc"), text_key(F.col(text)).alias("_t"), F.col(text).cast("string").alias("_text"))
    rows = rows.join(small_side(ids, BROADCAST_ROWS), ["_doc", "_t"]).select("node", "_text", "take")
    sets = rows.mapInArrow(run, "node long, size long, hashes array<long>, odd array<long>")
    return written(sets.dropDuplicates(["node"]) if repeats else sets, "shingle-sets")


def rare_prefixes(sets: DataFrame, known: DataFrame, whole: Callable[[DataFrame], DataFrame], similarity: float, hot: int) -> DataFrame:
    """(node, size, pos, token), written: each set's prefix, with places from 0, in an order in which tokens of many sets come
    last, the most frequent at the end.

    sets (node, size, hashes) hold the smallest hashes of each set, more than the prefix where some of those are known
    (token, n) to be of over `hot` sets; what of the further ones is of so many becomes known, too. So a passage that many
    documents share brings them together only where they have little else. Sets whose tokens here are nearly all known ones
    are asked for whole."""
    size = prefix_size(F.col("size"), similarity)
    first = lambda c: F.posexplode(F.slice(c, 1, size)).alias("pos", "token")
    more = sets.filter(F.size("hashes") > size).select(F.explode(F.slice("hashes", size + 1, F.size("hashes"))).alias("token"))
    more = more.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    known = written(known.union(more).groupBy("token").agg(F.max("n").alias("n")), "hot-tokens")
    tokens = small_side(known, BROADCAST_ROWS)
    plain = sets.select("node", "size", first("hashes"))
    moved = written(plain.select("node", "token").join(tokens, "token").select("node").distinct(), "hot-sets")

    def late_of(df: DataFrame) -> DataFrame:
        """(node, late): the known tokens of sets, in their order."""
        rows = df.select("node", F.explode("hashes").alias("token")).join(tokens, "token")
        return rows.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("late"))

    holders = sets.join(small_side(moved, BROADCAST_ROWS), "node", "left_semi")
    changed = holders.join(late_of(holders), "node").select("node", "size", F.array_except("hashes", "late").alias("rare"))
    changed = written(changed, "rare-tokens")
    full = whole(changed.filter(F.size("rare") < size).select("node"))
    late_first = full.join(late_of(full), "node").select("node", "size", first(F.concat(F.array_except("hashes", "late"), "late")))
    kept = sets.join(small_side(moved, BROADCAST_ROWS), "node", "left_anti").select("node", "size", first("hashes"))
    out = written(kept.union(changed.filter(F.size("rare") >= size).select("node", "size", first("rare"))).union(late_first), "rare-prefixes")
    discard(known, moved, changed, full)
    return out


def similar_pairs(pairs: DataFrame, sets: DataFrame, whole: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The pairs (a, b), written, whose shingle sets' common part is at least so large a share of their union.

    Two parity bits differ for a hash that one set alone has, so sets differ in at least as many hashes as their parities
    in bits; only pairs that do not differ in too many have their whole sets made and moved."""
    side = lambda df, c, *more: df.select(F.col("node").alias(c), *[F.col(m).alias(f"_{c}_{m}") for m in more])
    both = pairs.join(side(sets, "a", "size", "odd"), "a").join(side(sets, "b", "size", "odd"), "b")
    bits = F.aggregate(F.zip_with("_a_odd", "_b_odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = both.filter(bits <= (F.col("_a_size") + F.col("_b_size")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6)
    close = written(close.select("a", "b", (F.col("_a_size") + F.col("_b_size")).alias("_sum")), "close-pairs")
    full = whole(close.select(F.col("a").alias("node")).union(close.select("b")).distinct())
    pair = close.join(side(full, "a", "hashes"), "a").join(side(full, "b", "hashes"), "b").withColumn("_common", F.size(F.array_intersect("_a_hashes", "_b_hashes")))
    out = written(pair.filter(F.col("_common") >= F.lit(similarity) * (F.col("_sum") - F.col("_common")) - 1e-9).select("a", "b"), "similar-links")
    discard(close, full)
    return out


def may_reach(similarity: float) -> Column:
    """Whether two sets that share a token, at places pos and _pos, can be so similar.

    Similar sets differ in few tokens. Of those before the shared one, what no other set has before (miss) is one's own, and
    their numbers differ by at least the places; behind it at least the rest of one is longer than that of the other."""
    front = F.greatest(F.col("miss") + F.col("_miss"), F.abs(F.col("pos") - F.col("_pos")))
    back = F.abs((F.col("size") - F.col("pos")) - (F.col("_size") - F.col("_pos")))
    return front + back <= (F.col("size") + F.col("_size")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6


def similar_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 2, hot: int = 64, heads: int = 1) -> DataFrame:
    """(_doc, _t, _row, first) of every row: groups of rows linked by shingle sets of at least the similarity, all links.

    _doc and _t are the id (null: NULL_ID) and the hash of the text, so rows of one id are told apart; _row is a number of
    the row, first the struct (_doc, _row) of the group's first row. Equal sets are one node from the start.

    Balls of fingerprints, as in simhash_groups, bring together the closest sets. At a similarity of 0.8 some ten of 64
    bits differ, far over any radius that a ball can have, so a prefix-filtered set join finds the other links: sets that
    similar share one of the first tokens (a fifth of them and one) of an order common to all sets, rare tokens first.
    Nodes without a common token there have no link. Two nodes that alone share a token are a pair at once. Of each other
    token's nodes, all that are not joined yet are held against one of them, in `heads` turns; where those of a token are not all joined after that, all its pairs that are not joined
    yet are tried. No pair is left out but by a bound (may_reach), so the groups are exact; where many unlike texts share nearly all of their text,
    these pairs grow with the square of their number. Each link is verified by the shingle sets.

    Null texts are empty; documents without words are one group. A null id counts as the smallest. An empty table gives
    no rows; other columns are ignored.
    """
    whole_rows = written(shingle_rows(docs, doc_id, text, words, similarity).withColumn("_row", F.monotonically_increasing_id()), "shingle-prefixes")
    rows = written(whole_rows.drop("prefix"), "shingle-rows")
    firsts = [F.min("_row").alias("node"), F.min(F.struct("_doc", "_row")).alias("first"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("prefix").alias("prefix")]
    whole_nodes = written(whole_rows.groupBy("d0", "d1").agg(*firsts), "shingle-nodes")
    discard(whole_rows)
    nodes = written(whole_nodes.select("d0", "d1", "node", "first"), "shingle-node-names")
    tokens = whole_nodes.select(F.explode("prefix").alias("token"), "node")
    counts = written(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "prefix-counts")
    known = written(counts.filter(F.col("n") > hot), "hot-tokens")
    # tokens that several sets have grow with the documents: dealt by token at any size, and hashed, not sorted
    met = tokens.join(counts.select("token").hint("shuffle_hash"), "token").select("node").distinct()
    many = tokens.join(small_side(known.select("token"), BROADCAST_ROWS), "token").groupBy("node").agg(F.count("*").alias("_hot"))
    keys = rows.select(F.col("_row").alias("node"), "_doc", "_t", "fp", "size").join(met, "node").join(many, "node", "left")
    take = prefix_size(F.col("size"), similarity) + 4 * F.coalesce("_hot", F.lit(0))
    keys = written(keys.select("node", "_doc", "_t", "fp", take.cast("int").alias("take")), "shingle-keys")
    discard(whole_nodes, counts)
    repeats = not rows.groupBy("_doc", "_t").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    sets = shingle_sets(docs, doc_id, text, words, keys.drop("fp"), repeats)

    def whole(ids: DataFrame) -> DataFrame:
        return shingle_sets(docs, doc_id, text, words, keys.join(ids, "node", "left_semi").select("node", "_doc", "_t", F.lit((1 << 31) - 1).alias("take")), repeats)

    whole_sets, tokens = sets, rare_prefixes(sets, known, whole, similarity, hot)
    sets = written(sets.select("node", "size", "odd"), "shingle-parities")
    discard(whole_sets, known)
    shared = written(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token", (F.col("n") == 2).alias("two")), "shared-tokens")
    before = F.row_number().over(Window.partitionBy("node").orderBy("pos")) - 1  # of a node's prefix: bounded by its text
    met = tokens.join(shared.hint("shuffle_hash"), "token").withColumn("miss", F.col("pos") - before)
    met = written(met.select("token", "node", F.col("size").cast("int").alias("size"), F.col("pos").cast("int").alias("pos"), F.col("miss").cast("int").alias("miss"), "two"), "met-prefixes")
    discard(tokens, shared)
    fields = ("size", "pos", "miss")
    ends = met.filter("two").groupBy("token").agg(*[f(F.struct("node", *fields)).alias(n) for f, n in ((F.min, "x"), (F.max, "y"))])
    twos = ends.select("x.*", F.col("y.node").alias("b"), *[F.col(f"y.{c}").alias(f"_{c}") for c in fields]).filter(may_reach(similarity)).select(F.col("node").alias("a"), "b")

    fps = written(keys.groupBy("fp").agg(F.min("node").alias("node")), "fingerprint-nodes")
    of = lambda c: fps.select(F.col("fp").alias(f"_{c}"), F.col("node").alias(c))
    ball = ball_links(fps, radius).select(F.col("fp").alias("_a"), F.col("other").alias("_b")).join(of("a"), "_a").join(of("b"), "_b").select("a", "b")
    near = ball.union(keys.join(fps.withColumnRenamed("node", "b"), "fp").select(F.col("node").alias("a"), "b")).union(twos)
    pair = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    tried = links = None
    tables, open_ = [met], met.filter("NOT two").drop("two")
    for turn in range(heads + 1):
        told = ["component"] if turn else []
        other = open_.select("token", F.col("node").alias("b"), *[F.col(c).alias(f"_{c}") for c in (*fields, *told)])
        if turn < heads:
            best = F.struct(F.lit(0) if turn else F.col("_miss"), F.xxhash64("b", F.lit(turn)))
            one = F.min_by(F.struct(*other.columns[1:]), best).alias("o")
            tables.append(written(other.groupBy("token").agg(one).select("token", "o.*"), "prefix-heads"))
            other = small_side(tables[-1], BROADCAST_ROWS // 4)
        pairs = open_.join(other, "token").filter("node <> b" + " AND component <> _component" * bool(turn)).filter(may_reach(similarity)).select(F.col("node").alias("a"), "b")
        pairs = (pairs if turn else pairs.union(near.filter("a <> b"))).select(*pair).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "similar-candidates")
        tried = pairs if tried is None else tried.union(pairs)
        found = similar_pairs(pairs, sets, whole, similarity)
        links = found if links is None else links.union(found)
        groups = components(links)
        if turn < heads:
            now = open_.select("token", "node", *fields).join(groups, F.col("node") == F.col("id"), "left").select("token", "node", *fields, F.coalesce("component", "node").alias("component"))
            left = written(now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token"), "open-tokens")
            open_ = written(now.join(small_side(left, BROADCAST_ROWS), "token"), "open-prefixes")
            discard(*tables, left)
            tables = [open_]
    met = open_
    discard(met, sets, fps, keys)
    named = nodes.join(groups, F.col("node") == F.col("id"), "left").select("d0", "d1", "first", F.coalesce("component", "node").alias("component"))
    named = written(named, "similar-groups")
    top = named.groupBy("component").agg(F.min("first").alias("first"))
    named = written(named.drop("first").join(top, "component").select("d0", "d1", "first"), "similar-groups")
    return rows.join(named, ["d0", "d1"]).select("_doc", "_t", "_row", "first")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row: the groups of similar_rows, each by the id of its first row."""
    out = similar_rows(docs, doc_id, text, words, similarity)
    return out.select(key_back("_doc").alias("doc_id"), key_back("first._doc").alias("component_id"))
