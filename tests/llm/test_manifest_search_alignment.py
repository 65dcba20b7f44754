"""Manifest, nearest neighbours and tokenizer alignment against plain versions."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sitewright.llm import alignment, merkle, neighbours

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def digest(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(level, at):
    """Hash after hash from a list of digests to the one that remains; siblings of place `at` on the way, before and after."""
    path = []
    while len(level) > 1:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        path.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        level, at = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)], at // 8
    return level[0], path


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    of = defaultdict(list)
    for i, text, lang, source, n in rows:
        odd = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        leaf = digest(i, source, lang, n, text)
        now = digest(i, source, lang, n, lower(text)) if odd and text is not None else leaf
        of[lang].append((i is not None, i or 0, leaf, now))
    langs = sorted(of, key=lambda x: (x is not None, (x or "").encode()))
    subroots = []
    for lang in langs:
        of[lang].sort(key=lambda r: r[:3])
        subroots.append(climb([r[2] for r in of[lang]], 0)[0])
    out = []
    for k, lang in enumerate(langs):
        for at, (known, i, leaf, now) in enumerate(of[lang]):
            subroot, path = climb([r[2] for r in of[lang]], at)
            root, more = climb(subroots, k)
            for a, b in path + more:
                now = sha(a + now + b)
            out.append((i if known else None, leaf, subroot, root, sha("".join(a + b for a, b in path + more)), now, now == root))
    return out


def key(r):
    return tuple((x is not None, str(x)) for x in r)


@pytest.fixture(scope="module")
def mixed():
    """Parts of 1 to 1,300 rows (over two blocks), a null one, odd orders, nulls in each column, a repeated row."""
    rng = np.random.default_rng(5)
    sizes = {None: 9, "": 1, "b": 8, "a": 65, "Z": 513, "é": 1300, "aa": 2, "ab": 1, "ac": 3, "ad": 1}
    rows = [(int(i), f"Text {rng.integers(50)} OF {i}", lang, None if i % 5 == 0 else f"s{i % 3}", None if i % 7 == 0 else int(i)) for lang, n in sizes.items() for i in rng.choice(10**6, n, replace=False)]
    return [*rows, (None, None, "a", None, None), (None, "NULL id", "a", "s", 1), (4, "", "b", "s", 0), rows[40], rows[40], (rows[40][0], "same id", *rows[40][2:])]


def test_manifest(spark, mixed, docs, texts, none):
    schema = "doc_id long, text string, lang string, source string, n_chars long, pos int, part string, h string, kids int"
    df = spark.createDataFrame([(*r, 1, "clash", "clash", 2) for r in mixed], schema).repartition(5)
    want = sorted(plain_manifest(mixed), key=key)
    assert sorted((tuple(r) for r in merkle.merkle_manifest(df).collect()), key=key) == want
    assert 0.5 < np.mean([w[-1] for w in want]) < 0.9
    got = merkle.merkle_manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_manifest([(i, t, None, "s", None) for i, t in texts]), key=key)
    assert merkle.merkle_manifest(none).collect() == []


def test_manifest_of_one_row(spark):
    one = spark.createDataFrame([(1, "X", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    leaf = digest(1, "s", "en", 1, "X")
    got = merkle.merkle_manifest(one).first()
    assert (got.leaf, got.subroot, got.root, got.proof_sha256) == (leaf, leaf, leaf, sha(""))


def exact_nearest(rows, k=20):
    """rows: (vec_id, vector); all usable."""
    x = np.array([v for _, v in rows])
    ids = np.array([-(2**63) if i is None else i for i, _ in rows])
    out = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and i % 20 == 0:
            s = (x * np.array(v)).sum(1)
            order = [m for m in np.lexsort((ids, -s)) if m != n][:k]
            out[n] = [(i, r + 1, rows[m][0], float(s[m])) for r, m in enumerate(order)]
    return out


@pytest.mark.parametrize("spread", [0.0, 0.5])
def test_neighbours_recall_and_scores(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(30, size=3000)] + rng.normal(size=(3000, 24))
    x = (x / np.linalg.norm(x, axis=1)[:, None] * np.exp(spread * rng.normal(size=(3000, 1)))).astype(np.float32).astype(float)
    rows = list(enumerate(x.tolist()))
    got = neighbours.nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = spark.createDataFrame([r for v in exact_nearest(rows).values() for r in v], "query_id long, rank int, vec_id long, score double")
    assert neighbours.recall_of(got, want) >= 0.9
    of = defaultdict(list)
    for r in got.collect():
        assert r.vec_id != r.query_id and abs(r.score - (x[r.query_id] * x[r.vec_id]).sum()) < 1e-12
        of[r.query_id].append((r["rank"], -r.score, r.vec_id))
    for v in of.values():
        v.sort()
        assert [a for a, *_ in v] == list(range(1, 21)) and [(s, i) for _, s, i in v] == sorted((s, i) for _, s, i in v)
    assert len(of) == 150


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [1.0, 0.0, 2.0]), (20, [0.0, -3.0, 0.0]), (20, [0.0, -3.0, 0.0]), (3, [1e6, 1.0, 1.0]), (None, [0.5, 0.5, 0.5]), (40, [2.0, 0.0, 0.0])]
    bad = [(60, None), (4, []), (5, [0.0, 0.0, 0.0]), (80, [1.0, nan, 0.0]), (6, [inf, 0.0, 0.0]), (7, [1.0, None, 0.0])]
    schema = "vec_id long, embedding array<double>, uid long, key string, at int, vector string, ask int, rank int"
    df = lambda rows: spark.createDataFrame([(*r, 1, "x", 1, "x", 1, 1) for r in rows], schema)
    short = df([*good, *bad, (41, [3.0])])
    want = [tuple(r) for v in exact_nearest([*good, (41, [3.0, 0.0, 0.0])]).values() for r in v]
    got = [tuple(r) for r in neighbours.nearest_vectors(short).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert neighbours.nearest_vectors(df(bad)).collect() == neighbours.nearest_vectors(df([])).collect() == neighbours.nearest_vectors(df(good[:1])).collect() == []


def test_neighbours_in_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 16)
    monkeypatch.setattr(neighbours, "ASKS", 4)
    rng = np.random.default_rng(1)
    rows = [(i, ([1.0, 0.0, 0.0, 0.0] if i % 3 == 0 else rng.normal(size=4).tolist())) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = neighbours.Index(1, 1, 8, 4, 4, 1.0, max(np.linalg.norm(v) for _, v in rows))  # all buckets: exact
    monkeypatch.setattr(neighbours, "fitted", lambda *a: index)
    want = [tuple(r) for v in exact_nearest(rows, 7).values() for r in v]
    got = [tuple(r) for r in neighbours.nearest_vectors(df, 7).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_pseudo_rotations_keep_lengths_and_two_functions_hash(spark):
    x = np.random.default_rng(0).normal(size=(50, 16))
    y = neighbours.rotated(x, (0, 1), 16)
    assert np.allclose(x @ x.T, y @ y.T) and not np.allclose(x, y)
    index = neighbours.Index(1, 2, 1, 15, 16, 1.0, 10.0)
    u = neighbours.unit(x[:, :15], index, True)
    assert np.array_equal(neighbours.bucket_of(u, index, 0), neighbours.bucket_scores(u, index, 0).argmax(1))


def plain_alignment(rows):
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    chars = alignment.byte_characters()
    count, found = Counter(), []
    for i, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        tokens = [[bytes(chars[c] for c in a.id_to_token(t)) for t in x], [alignment.piece_bytes(b.id_to_piece(t)) for t in y]]
        if not text or any(b"".join(t) != (" " + text).encode() for t in tokens):
            found.append((i, 0, 0, []))
            continue
        ends = [np.cumsum([len(t) for t in ts]).tolist() for ts in tokens]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            until = [es.index(cut, a) + 1 for es, a in zip(ends, at)]
            groups.append((x[at[0] : until[0]], y[at[1] : until[1]]))
            at = until
        count.update({(p, q) for g in groups for p in g[0] for q in g[1]})
        found.append((i, len(x), len(y), groups))
    most = defaultdict(int)
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    out = []
    for i, n_a, n_b, groups in found:
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha(text) if groups else ""))
    return sorted(out, key=key)


ODD = ["<|endoftext|> <s></s> <unk> <0x41>", "a▁b ▁", "x" * 700, " " * 300 + "y", "it's 'S it’s WE'LL", "١٢٣ 12³ ½ ﬁ", "\t\n\r\n  \n", "퟿𝔘𝔫𝔦 日本語テキスト 한국어", "a  b　c", "é é", " lead", "trail  ", "-" * 130 + "=" * 77]


def test_alignment(spark, docs, texts, none, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 2000)  # many chunks
    got = alignment.align_tokenizers(docs, BYTES, PIECES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    short = [t for t in texts if len(t[1] or "") < 10**5]
    df = spark.createDataFrame([*short, *enumerate(ODD, 100)], "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in alignment.align_tokenizers(df, BYTES, PIECES).collect()), key=key) == plain_alignment([*short, *enumerate(ODD, 100)])
    assert sorted((tuple(r) for r in got.collect()), key=key) == plain_alignment(texts)
    assert alignment.align_tokenizers(none, BYTES, PIECES).collect() == []


def test_alignment_trees_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 200)
    rows = [(i, f"word{i % 7} and word{i % 11} more text of number {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    chunks = alignment.aligned_chunks(docs, BYTES, PIECES, "doc_id", "text")
    parts = alignment.chunk_parts(chunks)
    assert chunks.count() >= 9
    index = alignment.pair_index(parts, chunks.count(), fan=2)
    flat = Counter()
    for r in parts.collect():
        flat.update(dict(zip(np.frombuffer(r.pairs, np.uint32).tolist(), np.frombuffer(r.seen, np.uint32).tolist())))
    for width in (1, 5):
        counts = {r.shard: np.frombuffer(r.vector, np.int64) for r in alignment.pair_counts(parts, index, width, fan=2).collect()}
        found = {int(p): int(n) for r in index.collect() for p, n in zip(np.frombuffer(r.own, np.uint32), counts[r.shard])}
        assert found == dict(flat)


def test_wide_groups_are_counted_by_id(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 400).astype(np.uint16), rng.integers(0, 9, 300).astype(np.uint16)
    ga, gb = np.sort(rng.integers(0, 6, 400)), np.sort(rng.integers(0, 6, 300))
    doc = ga // 2
    narrow = alignment.links(a, b, ga, gb, 6, doc)
    monkeypatch.setattr(alignment, "WIDE", 100)
    assert all(np.array_equal(x, y) for x, y in zip(narrow, alignment.links(a, b, ga, gb, 6, doc)))
    with pytest.raises(ValueError):
        alignment.Index({"sizes": [2], "bits": bytes([0b10000000]), "tail": b"", "own": np.array([7], np.uint32).tobytes()}).find(np.array([8], np.uint32))
