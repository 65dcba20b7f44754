"""Stages of the pipeline over odd rows, and each one's decisions against its operator."""

import importlib

import pytest
from pyspark.sql import functions as F

pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def table(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def test_stages_keep_columns(spark, table, sf):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == table.columns, name
        assert stage(spark, table.limit(0), sf).collect() == [], name
        assert out.count() <= table.count()
    assert pipeline.STAGES[-1][1](spark, table, sf).count() >= table.count()


CLASHING = "score predicted held_out kept n_lines n_dropped _t _doc _text _row _key key row first fp h size node n_words".split()


def test_stages_keep_clashing_columns(spark, docs, sf):
    """Columns with the names that operators use inside come through with their values."""
    wide = docs
    for c in CLASHING:
        wide = wide.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    narrow = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf)
        assert out.columns == wide.columns, name
        assert stage(spark, wide.limit(0), sf).collect() == [], name
        got, plain = out.collect(), stage(spark, narrow, sf).collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(r.doc_id), str(r.text)) for r in plain), name
        assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in got for c in CLASHING), name
    assert pipeline.STAGES[-1][1](spark, wide, sf).count() == pipeline.STAGES[-1][1](spark, narrow, sf).count()


def test_near_copies_leave_one(spark, table, sf, texts):
    kept = pipeline.drop_near_copies(spark, table, sf)
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 0 and 5 in ids and 2 in ids and 4 not in ids and None in ids  # 5, 6 and 6 are copies; 2 (null), 4 and 8 are without words
    assert len(ids) == len(set(ids))


def test_lines_take_effect(spark, table, sf):
    out = {r.doc_id: (r.text, r.n_chars) for r in pipeline.drop_lines(spark, table, sf).collect()}
    assert out[3] == ("own line three\nshort", 20) and out[1] == ("first line only here", 20)


def test_contaminated_go(spark, table, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    extra = spark.createDataFrame([(99, "before " + item + " after", None, None, None), (None, item, None, None, None)], table.schema)
    ids = [r.doc_id for r in pipeline.drop_contaminated(spark, table.union(extra), sf).collect()]
    assert 99 not in ids and 5 in ids and 12 in ids


def test_run(spark, sf):
    out = pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0 < out.select("doc_id").distinct().count() < docs


def test_rows_of_one_id_are_told_apart(spark, table, sf):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(None, text("a")), (None, text("b")), (None, item), (1, text("c")), (1, text("d")), (1, item + " end"), (2, text("a")), (3, text("d")), (3, text("d"))]
    some = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], table.schema)
    kept = sorted(((r.doc_id, r.text[:3]) for r in pipeline.drop_near_copies(spark, some, sf).collect() if not r.text.startswith(item[:20])), key=str)
    assert kept == sorted([(None, "a0 "), (None, "b0 "), (1, "c0 "), (1, "d0 ")], key=str)
    clean = [(r.doc_id, r.text) for r in pipeline.drop_contaminated(spark, some, sf).collect()]
    assert sorted(clean, key=str) == sorted((p for p in rows if item not in p[1]), key=str)
