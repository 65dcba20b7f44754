"""A worker that packed holds no words once its task has ended."""

import public_tokenizers
import pyarrow as pa

from sitewright.llm import packing


def test_words_are_forgotten_when_a_task_ends(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('the word', id, ' and more') AS text").repartition(8)
    assert packing.token_pieces(docs, path, 2048).count() == 400

    def held(batches):
        for b in batches:
            known = packing.words_of.cache_info().currsize
            yield pa.RecordBatch.from_arrays([pa.array([known]), pa.array([len(packing.words_of(path)) + len(packing.words_of(path).older)])], names=["known", "held"])

    seen = spark.range(0, 64, 1, 16).mapInArrow(held, "known long, held long").collect()
    assert any(r.known for r in seen), "no worker was used again"
    assert not any(r.held for r in seen)
