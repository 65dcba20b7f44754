"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, interleaved, line_dedup, merkle, neighbours, packing, pii, quality, sharding, simhash, suffix_dedup, warc

#: Byte limit of a shard.
SHARD_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved.document_media(table(spark, sf_dir, "documents"))


def pages_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied pages as sequences: how many items and media each has, the characters of its text blocks and their hash."""
    media = F.size(F.filter("items", lambda x: x["kind"] == "media"))
    return interleaved.interleave(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", media.alias("n_media"), *interleaved.text_blocks("items"))


def op2_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit(docs))


def op3_quality_bytecnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"))
    return sharding.extendible_shards(sized, SHARD_BYTES)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=False)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_vectors(table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ENC = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
_LEAF = lambda text: "sha256(concat(" + ", ".join(_ENC(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + "))"
_CRC = "xor(list_reduce(list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(id[i]) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(c, b)), 4294967295), 4294967295)"
_FOLD = "array_to_string(hs[1:pos % 8], ''), {}, array_to_string(hs[pos % 8 + 2:], '')"
SQL = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE i AS (SELECT *, CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang IS NULL THEN '' ELSE 'x' || lang END AS k FROM documents),
l AS (SELECT doc_id, k, {_LEAF("text")} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS now FROM i),
d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS c FROM l),
n AS (SELECT 0 AS level, k, pos, leaf AS h, c FROM d UNION ALL SELECT level + 1, k, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (c + 7) // 8 FROM n WHERE c > 1 GROUP BY level, k, pos // 8, c),
r AS (SELECT level, k, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM n WHERE c > 1 GROUP BY level, k, pos // 8),
s AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS c FROM n WHERE c = 1),
m AS (SELECT 0 AS level, pos, h, c FROM s UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (c + 7) // 8 FROM m WHERE c > 1 GROUP BY level, pos // 8, c),
q AS (SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM m WHERE c > 1 GROUP BY level, pos // 8),
f AS (SELECT 0 AS level, k, doc_id, leaf, pos, pos AS own, coalesce(now, leaf) AS acc, '' AS proof FROM d
  UNION ALL SELECT f.level + 1, k, doc_id, leaf, pos // 8, own, sha256(concat({_FOLD.format("acc")})), concat(proof, {_FOLD.format("''")}) FROM f JOIN r USING (k) WHERE r.level = f.level AND r.run = pos // 8),
e AS (SELECT k, own, arg_max(struct_pack(doc_id := doc_id, leaf := leaf, acc := acc, proof := proof), level) AS v FROM f GROUP BY k, own),
g AS (SELECT 0 AS level, k, own, s.pos, v.acc AS acc, v.proof AS proof FROM e JOIN s USING (k)
  UNION ALL SELECT g.level + 1, k, own, pos // 8, sha256(concat({_FOLD.format("acc")})), concat(proof, {_FOLD.format("''")}) FROM g JOIN q ON q.level = g.level AND q.run = pos // 8),
z AS (SELECT k, own, arg_max(struct_pack(acc := acc, proof := proof), level) AS v FROM g GROUP BY k, own)
SELECT e.v.doc_id AS doc_id, e.v.leaf AS leaf, s.h AS subroot, m.h AS root, sha256(z.v.proof) AS proof_sha256, z.v.acc AS folded_root, z.v.acc = m.h AS verified
FROM e JOIN z USING (k, own) JOIN s USING (k), (SELECT h FROM m WHERE c = 1) m""",
    "op10_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS w FROM (SELECT doc_id, x, unnest(range(0, CAST(length(x) // 2 - 49 AS BIGINT))) AS p FROM d WHERE length(x) >= 100)),
m AS (SELECT w, min(doc_id) AS first FROM g GROUP BY w),
f AS (SELECT g.doc_id, p, lag(p) OVER o AS before, lead(p) OVER o AS after FROM g JOIN m USING (w) WHERE first < g.doc_id WINDOW o AS (PARTITION BY g.doc_id ORDER BY p)),
k AS (SELECT f.*, CASE WHEN before IS NULL THEN substr(x, 1, 2 * p) WHEN p > before + 50 THEN substr(x, 2 * (before + 50) + 1, 2 * (p - before - 50)) ELSE '' END AS kept, CASE WHEN after IS NULL THEN substr(x, 2 * (p + 50) + 1) ELSE '' END AS tail FROM f JOIN d USING (doc_id)),
s AS (SELECT doc_id, CAST(sum(least(50, coalesce(after - p, 50))) AS BIGINT) AS n_removed, count(*) FILTER (before IS NULL OR p > before + 50) AS n_spans, string_agg(kept || tail, '' ORDER BY p) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""",
    "op9_decontaminate": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
j AS (SELECT item_id, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM j)),
dw AS (SELECT doc_id, s, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, (SELECT DISTINCT m FROM iw))),
h AS (SELECT doc_id, s, m, item_id FROM dw JOIN iw USING (m, win)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS pos FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(v, ',' ORDER BY v)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN g USING (doc_id)""",
    "op4_warc_dictionary": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d),
b AS (SELECT *, upper(to_base(('0x' || substr(d, 1, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(d, 11, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(d, 21, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(d, 31, 10))::BIGINT, 32, 8)) AS v FROM p JOIN f USING (d))
SELECT p.page_id, CAST(strlen(b.h) AS BIGINT) AS payload_bytes, translate(b.v, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
CASE WHEN b.first < b.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN b.first < b.page_id THEN b.first END AS refers_to, p.url AS target_uri
FROM b JOIN pages p USING (page_id)""",
    "op5_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first, count(DISTINCT doc_id) AS n FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, coalesce(f.n >= 2 AND f.first <> k.doc_id, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op8_extendible_shards": f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h FROM documents),
e AS (SELECT d.*, depth, h >> (60 - depth) AS p FROM d, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS depth)),
t AS (SELECT depth, p, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM e GROUP BY depth, p),
m AS (SELECT doc_id, min(depth) AS depth FROM e JOIN t USING (depth, p) WHERE shard_bytes <= {SHARD_BYTES} OR depth = 60 GROUP BY doc_id)
SELECT e.doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), depth, '0') END AS shard, depth, shard_bytes, shard_rows, shard_bytes > {SHARD_BYTES} AS oversize
FROM e JOIN m USING (doc_id, depth) JOIN t USING (depth, p)""",
}


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pages_interleaved": pages_interleaved}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
