"""Benchmark decontamination by a prefix-filtered set join; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, doc_key, key_back, small_side, text_key, written

#: Characters of a word: digits, lower-case letters, and all that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows up to which a table made from the benchmark is broadcast, if its bytes allow it too; beyond it Spark shuffles.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, item_id: str, text: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wid, item), (wid, m, k, o, sid) and (sid, k, h, s): windows by item, shingles by window and offset, shingles."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    rows = rows.select("item", "w", F.least(F.size("w"), F.lit(window)).alias("m"))
    rows = rows.select("item", "w", "m", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("m"))).alias("i")).select("item", "m", F.slice("w", F.col("i") + 1, F.col("m")).alias("win")).distinct()
    wins = written(rows.groupBy("win", "m").agg(F.collect_set("item").alias("items")).withColumn("wid", F.monotonically_increasing_id()), "item-windows")
    cut = wins.select("wid", "m", "win", F.least("m", F.lit(shingle)).alias("k"))
    cut = cut.select("wid", "m", "k", "win", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("k"))).alias("o")).select("wid", "m", "k", "o", F.slice("win", F.col("o") + 1, F.col("k")).alias("s"))
    shingles = written(cut.select("s", "k").distinct().withColumn("sid", F.monotonically_increasing_id()).withColumn("h", hash_of(F.col("s"), F.lit(0), None)), "item-shingles")
    return wins.select("wid", F.explode("items").alias("item")), written(cut.join(shingles, ["s", "k"]).select("wid", "m", "k", "o", "sid"), "window-shingles"), shingles


def hash_of(words: Column, at: Column, n: int | None) -> Column:
    """A hash of n words from a place on; of all words where n is None. Both forms agree."""
    return F.xxhash64(words) if n is None else F.xxhash64(*[F.get(words, at + i) for i in range(n)])


def occurrences(docs: DataFrame, shingles: DataFrame, k: int, doc_id: str, text: str, all_docs: bool) -> DataFrame:
    """(_doc, _t, n, i, sid): places in documents where an item shingle of k words stands, verified word by word.

    With all_docs each document also has a row with i = -1, which brings its number of words. The text is read once:
    shingles are made and probed within one stage, and only those that an item has leave it.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(doc_key(doc_id).alias("_doc"), text_key(body).alias("_t"), words_of(body).alias("w"))
    places = F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.size("w") - k))
    rows = rows.select("_doc", "_t", "w", F.explode_outer(places).alias("i"))
    rows = rows.select("_doc", "_t", F.size("w").alias("n"), "i", F.when(F.col("i") >= 0, hash_of(F.col("w"), F.col("i"), k)).alias("h"), F.slice("w", F.greatest("i", F.lit(0)) + 1, F.lit(k)).alias("here"))
    wanted = shingles.filter(F.col("k") == k).select("sid", F.col("h").alias("_h"), "s")
    size = F.aggregate("s", F.lit(16).cast("long"), lambda n, x: n + F.octet_length(x) + 16)
    found = rows.join(small_side(wanted, BROADCAST_ROWS, size), (F.col("h") == F.col("_h")) & (F.col("here") == F.col("s")), "left" if all_docs else "inner")
    return found.filter(F.col("sid").isNotNull() | (F.col("i") < 0)).select("_doc", "_t", "n", "i", "sid")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs.

    A window is `window` consecutive words of an item, or all words of a shorter one; a document's word inside any
    occurrence of a window is hit. The join is prefix-filtered: a window has to be contained whole, so one of its
    shingles must be joined, the rarest by its count in all documents; windows with a shingle that no document has are
    out. A place is a candidate where the shingle's offset leaves the window inside the document (positional and length
    bounds). It is verified by the verified shingles at its first and last place, which between them cover it.

    Null and empty texts have no words; items without words have no windows; null ids count as one value; rows of one id are told apart by a 64-bit hash of their texts; repeated rows
    get a row each; without items or documents the result is clean or empty.
    """
    if window > 2 * shingle:
        raise ValueError("two shingles must cover a window")
    of_item, parts, shingles = item_windows(items, item_id, item_text, window, shingle)
    lengths = [r.k for r in shingles.select("k").distinct().collect()]  # `shingle` values at most
    found = occurrences(docs, shingles, shingle, doc_id, text, True)
    for k in sorted(set(lengths) - {shingle}):
        found = found.unionByName(occurrences(docs, shingles, k, doc_id, text, False))
    found = written(found, "shingle-places")
    places = found.filter(F.col("i") >= 0)
    rarity = places.groupBy("sid").agg(F.count("*").alias("rarity"))
    whole = parts.join(rarity, "sid", "left")
    first, last = F.min_by("sid", "o").alias("first"), F.max_by("sid", "o").alias("last")
    windows = whole.groupBy("wid", "m", "k").agg(F.min(F.struct("rarity", "sid", "o")).alias("rarest"), first, last, F.count("rarity").alias("_have"), F.count("*").alias("_need")).filter("_have = _need")
    windows = small_side(written(windows.select("wid", "m", "k", "rarest.sid", "rarest.o", "first", "last"), "windows"), BROADCAST_ROWS)
    starts = places.join(windows, "sid").withColumn("start", F.col("i") - F.col("o")).filter("start >= 0 AND start + m <= n").select("_doc", "_t", "start", "m", "wid", "first", "last", (F.col("start") + F.col("m") - F.col("k")).alias("stop"))
    at = places.select("_doc", "_t", "i", "sid").distinct()
    hits = starts.join(at.select("_doc", "_t", F.col("i").alias("start"), F.col("sid").alias("first")), ["_doc", "_t", "start", "first"], "left_semi")
    hits = hits.join(at.select("_doc", "_t", F.col("i").alias("stop"), F.col("sid").alias("last")), ["_doc", "_t", "stop", "last"], "left_semi")
    hits = hits.join(small_side(of_item, BROADCAST_ROWS, F.octet_length("item") + 24), "wid").groupBy("_doc", "_t").agg(F.collect_set(F.struct("start", "m")).alias("runs"), F.collect_set("item").alias("ids"))
    hits = hits.select("_doc", "_t", F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["m"] - 1))))).cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array("ids")), 256).alias("items_sha256"))
    out = found.filter(F.col("i") < 0).select("_doc", "_t", F.col("n").cast("long").alias("n_words")).join(hits, ["_doc", "_t"], "left")
    none = F.sha2(F.lit(""), 256)
    return out.select(key_back("_doc").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
