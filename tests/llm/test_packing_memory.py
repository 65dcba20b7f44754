"""What a worker remembers of words is bounded within a batch too, and ids are the tokenizer's all the same."""

from array import array

import public_tokenizers
from tokenizers import Tokenizer

from sitewright.llm import packing


def test_memory_is_bounded_within_one_batch(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    path = public_tokenizers.path("word_bpe_49k.json")
    known = packing.Words(path)
    monkeypatch.setattr(packing, "words_of", lambda _: known)
    texts = [" ".join(f"the Word{i} x{i}, né{i}" for i in range(400)), "the same the word"]
    got = packing.token_ids([t.encode() for t in texts], path)
    whole = Tokenizer.from_file(path)
    assert [array("I", g).tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(len(m) for m in (known, known.older)) <= 50
