"""From raw documents to training sequences in five stages; each works on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of docs in all but the last. A row travels
as one struct, so columns of docs may have any names. Null texts are empty; null and repeated ids are rows of their own; an
empty table gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm import decontamination, line_dedup, packing, quality, simhash
from sitewright.llm.common import doc_key, small_side, text_key, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, trained on the labels outside the held-out fold, scores 0.3 or more."""
    net = quality.fit(docs, _table(spark, sf_dir, "labels"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0), *rest).alias("row"))
    out = quality.score_quality(rows, net, also=("text", "row")).filter("predicted = 1")
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"row.`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; n_chars follows."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(F.lit(0), *rest).alias("row")), also=("row",))
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept").alias("text"), "n_chars": F.char_length("kept").cast("long").alias("n_chars")}
    return out.select(*[new[c] if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near copies: shingles of five words with a similarity of 0.8 or more, all links.

    Rows are told apart by id and text, so unlike rows with one id, or without, stay; of equal ones one does.
    """
    of_key = [F.bool_or(F.col("_row") == F.col("first._row")).alias("keep"), F.count("*").alias("n")]
    keys = written(simhash.similar_rows(docs).groupBy("_doc", "_t").agg(*of_key), "near-copy-keys")
    keyed = docs.select(doc_key("doc_id").alias("_doc"), text_key(F.col("text")).alias("_t"), F.struct("*").alias("row"))
    kept = keyed.join(small_side(keys.filter("NOT keep").select("_doc", "_t"), simhash.BROADCAST_ROWS), ["_doc", "_t"], "left_anti")
    if not keys.filter("keep AND n > 1").isEmpty():  # equal rows of a kept text
        kept = kept.dropDuplicates(["_doc", "_t"])
    return kept.select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Rows are told apart by id and text."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text", F.struct("*").alias("row"))
    hits = decontamination.decontaminate(keyed, _table(spark, sf_dir, "benchmark"), doc_id="key")
    keys = written(hits.filter("contaminated").select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return keyed.join(keys, "key", "left_anti").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of at most 2,048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pack", pack_sequences),
]
#: SQL can't express the network, the fingerprints or the packing; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
