"""Each operator against a plain version, over nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict
from html import unescape
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitewright.llm import decontamination, interleaved, line_dedup, packing, pii, quality, registry, sharding, simhash, suffix_dedup, warc
from sitewright.llm.common import small_side
from sitewright.llm.components import components

WORDS = public_tokenizers.path("word_bpe_49k.json")


def rows(df, *columns):
    return sorted(df.select(*columns).collect(), key=lambda r: tuple((x is not None, str(x)) for x in r))


def plain(*rs):
    return sorted(rs, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_media(docs, none, texts):
    def one(i, t):
        b = (t or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        return i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])

    out = interleaved.document_media(docs)
    assert [tuple(r) for r in rows(out, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")] == plain(*(one(*t) for t in texts))
    same = defaultdict(set)
    for r in out.collect():
        same[r.payload_sha256].add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in same.values())
    assert interleaved.document_media(none).collect() == []


def test_media_round_trip():
    for n in (192, 384, 192 * 700):
        payload = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
        assert interleaved.decode_png(interleaved.encode_png(payload)) == payload
    bad = bytearray(interleaved.encode_png(b" " * 192))
    bad[45] ^= 1
    with pytest.raises(ValueError):
        interleaved.decode_png(bytes(bad))


def ni(digest):
    return "ni:///sha-256;" + base64.urlsafe_b64encode(bytes.fromhex(digest)).decode().rstrip("=")


AA, BB, ZZ = "aa" * 32, "bb" * 32, "ff" * 32


def read(html):
    return [(i["position"], i["kind"], i["text"] or i["digest"] or i["source"], i["caption"]) for i in interleaved.parse_items(html)]


def test_interleaved_sequences(spark):
    html = f'<h1>Title</h1><p>one <b>two</b></p><figure><img src="{ni(AA)}" alt="x"><img src="{ni(BB)}"><figcaption>both <i>shown</i></figcaption></figure><script>no</script>tail<img src="{ni(ZZ)}" alt="alone">'
    pages = spark.createDataFrame([(1, html), (2, None), (None, ""), (3, "<p>open <img src='/a.png'"), (4, html)], "id long, html string")
    seq = interleaved.interleave(pages, "id", "html")
    items = {r.id: [(i.position, i.kind, i.text or i.digest, i.caption) for i in r["items"]] for r in seq.collect()}
    assert items[1] == [(0, "text", "Title", None), (1, "text", "one two", None), (2, "media", AA, "both shown"), (3, "media", BB, "both shown"), (4, "text", "tail", None), (5, "media", ZZ, "alone")]
    assert items[2] == [] and items[None] == [] and items[3] == [(0, "text", "open", None)]
    said = {r.id: r for r in seq.select("id", *interleaved.text_blocks("items")).collect()}
    assert (said[1].n_items, said[1].n_chars, said[1].text_sha256) == (6, 16, hashlib.sha256(b"Title\none two\ntail").hexdigest())
    slim = {r.id: r for r in interleaved.interleave(pages, "id", "html", texts=False).collect()}
    assert all(i.text is None for i in slim[1]["items"]) and interleaved.media_references(interleaved.interleave(pages, "id", "html", texts=False), "id").count() == 6
    store = spark.createDataFrame([(AA, 0, bytearray(b"A")), (BB, 0, bytearray(b"B"))], "digest string, salt int, media binary")
    refs = interleaved.media_references(seq, "id")
    whole = {r.id: r["items"] for r in interleaved.assemble(interleaved.resolve(refs, store), seq, "id").collect()}
    for k in (1, 4):
        assert [(i.position, i.kind, bytes(i.media.media) if i.media and i.media.media else None, i.caption) for i in whole[k]][2:] == [(2, "media", b"A", "both shown"), (3, "media", b"B", "both shown"), (4, "text", None, None), (5, "media", None, "alone")]
    assert whole[2] == [] and len(whole) == 5
    twice = interleaved.resolve(refs, store)
    assert len(interleaved.assemble(twice.union(twice), seq, "id").filter("id = 1").first()["items"]) == 6
    none = pages.limit(0)
    assert interleaved.assemble(interleaved.resolve(interleaved.media_references(interleaved.interleave(none, "id", "html"), "id"), store), interleaved.interleave(none, "id", "html"), "id").collect() == []


def test_figures_of_all_forms():
    img = lambda d: f'<img src="{ni(d)}">'
    assert read(f"<figure><figcaption>before</figcaption>{img(AA)}</figure>after") == [(0, "media", AA, "before"), (1, "text", "after", None)]
    assert read(f"<figure>{img(AA)}<figcaption>cap</figure><p>text</p><p>more</p>") == [(0, "media", AA, "cap"), (1, "text", "text", None), (2, "text", "more", None)]
    nested = f"<figure><figcaption>outer</figcaption>{img(AA)}<figure>{img(BB)}<figcaption>inner</figcaption></figure>{img(ZZ)}</figure>end"
    assert read(nested) == [(0, "media", AA, "outer"), (1, "media", BB, "inner"), (2, "media", ZZ, "outer"), (3, "text", "end", None)]
    inside = f"<figure>{img(AA)}<figcaption>one <figure>{img(BB)}<figcaption>two</figcaption></figure> three</figcaption></figure>"
    assert read(inside) == [(0, "media", AA, "one three"), (1, "media", BB, "two")]
    assert read(f"<p>a</p></figure></figcaption>b<figcaption>c</figcaption>{img(AA)}") == [(0, "text", "a", None), (1, "text", "b", None), (2, "text", "c", None), (3, "media", AA, None)]
    assert read(f"<figure>{img(AA)}<figcaption>open <p>to the end") == [(0, "media", AA, "open to the end")]
    assert read("<figure><figcaption>only words</figcaption></figure>") == [(0, "text", "only words", None)]
    assert read('<img src="ni:///sha-256;%%"><img src="/b.png" alt="b"><img>') == [(0, "media", "ni:///sha-256;%%", None), (1, "media", "/b.png", "b")]


def test_media_pages_hold_whole_texts(docs, texts):
    """Every line is a text block of the page, uncut; the media stands behind the first and has it as caption."""
    got = sorted(((r.doc_id, r.n_items, r.position, r.caption, r.n_chars, r.text_sha256) for r in interleaved.document_media(docs).collect()), key=str)
    want = []
    for i, t in texts:
        lines = [" ".join(x.split()) for x in (t or "").split("\n")]
        kept = [x for x in lines if x]
        want.append((i, len(kept) + 1, 1 if lines[0] else 0, lines[0] or None, sum(map(len, kept)), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_assembled_sequences_hold_texts(spark, docs, texts):
    """The assembled items of each document against a plain reading: all lines as text, the media behind the first."""
    got = []
    for r in interleaved.document_sequences(docs.union(docs)).collect():
        assert [i.position for i in r["items"]] == list(range(len(r["items"])))
        got.append((r.doc_id, [(i.kind, i.text, i.caption, i.media.payload_sha256 if i.media else None) for i in r["items"]]))
    want = []
    for i, t in texts * 2:
        b = (t or "").encode()
        lines = [" ".join(x.split()) for x in (t or "").split("\n")]
        digest = hashlib.sha256(b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))).hexdigest()
        items = [("text", x, None, None) for x in lines if x]
        items.insert(1 if lines[0] else 0, ("media", None, lines[0] or None, digest))
        want.append((i, items))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pages_query(spark, sf):
    """Each page's text blocks against a plain reading: tags that end a block cut, others go, hidden parts go."""
    got = {r.page_id: (r.n_items, r.n_media, r.n_chars, r.text_sha256) for r in registry.pages_interleaved(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    block = r"</?(?:p|div|article|section|nav|header|footer|title|h[1-6]|li|ul|ol|table|tr|td|th|blockquote|br|hr|body)(?=[\s>/])[^>]*>"
    for r in rows:
        h = re.sub(r"(?s)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>", "", r.html or "")
        parts = [unescape(re.sub(r"<[!/a-zA-Z][^>]*>", "", x)) for x in re.split(block, h)]
        kept = [y for y in (" ".join(x.split()) for x in parts) if y]
        assert got[r.page_id] == (len(kept), 0, sum(map(len, kept)), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert len(got) == len(rows) > 0


def brute_spans(text):
    def luhn(s):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(s[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_against_patterns():
    rng = np.random.default_rng(5)
    alphabet = list("ab1239.+-@ ()%_é0")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute_spans(text), text
    assert pii.base_spans("0001.2.3.4 256.1.1.1 00000256.1.1.1")[0] == (1, 0, 10)


def test_personal_data(docs, none, texts):
    field = pii.fit(docs)
    out = pii.find_personal_data(docs, field)
    assert out.count() == len(texts)
    want = plain(*((i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t or "")).encode()).hexdigest()) for i, t in texts))
    assert [tuple(r) for r in rows(out, "doc_id", "base_sha256")] == want
    r = out.filter("doc_id = 11").first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and set(pii.spell(pii.base_spans(dict(texts)[11])).split(",")) <= set(r.spans.split(","))
    assert pii.find_personal_data(none, pii.fit(none)).collect() == []


def test_skip_links_carry_labels(spark):
    """A number that stands bare is found where the same number stands whole elsewhere in the document, and only there."""
    rows_ = [(i, f"call +1 (499) 555-{6000 + i} now") for i in range(200)] + [(900 + i, f"code 555-{7000 + i} here") for i in range(60)]
    rows_ += [(5000, "call +1 (499) 555-9999 soon. " + "plain words " * 40 + "again 555-9999 please")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    field = pii.fit(docs)
    text = rows_[-1][1]
    g = pii.graph_of([text], [pii.base_spans(text)])
    with_skip = pii.beliefs(field, g)[-1]
    g.skip.clear()
    alone = pii.beliefs(field, g)[-1]
    assert with_skip[4] > alone[4]


def graph(n, chain, skip, rng):
    return pii.Graph([0] * n, [(i, i + 1) for i in range(n)], rng.integers(0, 4, n).tolist(), (rng.integers(0, 5, n) * (rng.random(n) < 0.3)).tolist(), chain, skip)


def enumerated(field, g):
    """Exact label probabilities by the sum over all labelings."""
    n = len(g.doc)
    total = np.zeros((n, pii.LABELS))
    for labels in product(range(pii.LABELS), repeat=n):
        if any(k and k != y for k, y in zip(g.label, labels)):
            continue
        w = sum(field.unary[s, y] for s, y, k in zip(g.shape, labels, g.label) if not k)
        w += sum(field.chain[labels[i], labels[j]] for i, j in g.chain) + sum(field.skip[labels[i], labels[j]] for i, j in g.skip)
        total[np.arange(n), labels] += np.exp(w)
    return total / total.sum(1, keepdims=True)


def test_beliefs_are_exact_marginals_on_trees_and_close_on_loops():
    rng = np.random.default_rng(31)
    apart = []
    for trial in range(24):
        n = int(rng.integers(1, 7))
        field = pii.Field(rng.normal(0, 1, (4, 5)), *(0.7 * (m + m.T) for m in rng.normal(0, 0.5, (2, 5, 5))))
        edges = [(int(rng.integers(0, i)), i) for i in range(1, n)]  # each token with one before: a tree
        kinds = rng.random(len(edges)) < 0.5
        chain, skip = [e for e, k in zip(edges, kinds) if k], [e for e, k in zip(edges, kinds) if not k]
        g = graph(n, chain, skip, rng)
        assert np.allclose(pii.beliefs(field, g, 200), enumerated(field, g), atol=1e-6)
        if n > 3:
            g.skip.append((0, n - 1))
            apart.append(np.abs(pii.beliefs(field, g, 200) - enumerated(field, g)).max())
    assert len(apart) > 5 and np.mean(apart) < 0.05


def test_added_spans_by_precision_and_recall(spark):
    """Bare numbers whose whole form stands elsewhere in the document are found; other bare numbers are left alone."""
    rng = np.random.default_rng(17)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows_, planted = [], {}
    for i in range(600):
        number = f"555-{rng.integers(1000, 9999)}"
        fill = " ".join(word() for _ in range(int(rng.integers(5, 60))))
        if i % 3 == 0:
            text = f"call +1 (499) {number} now {fill} again {number} {word()}"
            planted[i] = (text.rindex(number), text.rindex(number) + len(number))
        elif i % 3 == 1:
            text = f"item {number} {fill} and {rng.integers(100, 999)}-{rng.integers(1000, 9999)} {word()}"
        else:
            text = f"call +1 (499) {number} now {fill}"
        rows_.append((i, text))
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    hits = extra = 0
    for r in pii.find_personal_data(docs, pii.fit(docs)).collect():
        text = rows_[r.doc_id][1]
        added = set(r.spans.split(",")) - set(pii.spell(pii.base_spans(text)).split(","))
        assert r.n_added == len(added - {""})
        for s in added - {""}:
            kind, a, b = s.split(":")
            good = r.doc_id in planted and kind == "phone" and int(a) <= planted[r.doc_id][0] and planted[r.doc_id][1] <= int(b)
            hits, extra = hits + good, extra + (not good)
    print("added spans: precision", hits / max(1, hits + extra), "recall", hits / len(planted))
    assert hits >= 0.9 * len(planted) and hits >= 0.9 * (hits + extra)


def test_quality(spark, docs, none, texts):
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["the", "river", "house", "walks", "over", "green"], 60)) for _ in range(150)]
    bad = [" ".join(rng.choice(["$$$", "&&&x", "!!", "%%%the", "BUY!!"], 60)) for _ in range(150)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), None) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(d, labels)
    out = quality.score_quality(d, net).toPandas()
    assert out.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]
    held = out[out.held_out]
    assert ((held.doc_id < 150) == (held.predicted == 1)).mean() > 0.95
    every = quality.score_quality(docs, net)
    assert every.count() == len(texts) and every.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.score_quality(none, net).collect() == []
    assert quality.fit(d, labels.limit(0)) is None and quality.score_quality(docs, None).filter("score = 0.5").count() == len(texts)


def small_network(seed, kind="f8"):
    rng = np.random.default_rng(seed)
    return quality.Network(rng.normal(0, 0.5, (256, 8)).astype(kind), rng.normal(0, 0.3, (64, 24)).astype(kind), rng.normal(0, 0.1, 24).astype(kind), rng.normal(0, 0.3, 48).astype(kind), np.array([0.1], kind))


def plain_score(net, text):
    """The score by loops: filter values at every second byte, chunks of four segments from every third, mean and maximum."""
    segments = max(1, -(-len(text) // 64))
    data = text + bytes(segments * 64 - len(text) + 64)
    tops = []
    for lead in range(0, max(1, segments - 1), 3):
        best = [-np.inf] * 24
        for seg in range(lead, min(lead + 4, segments)):
            for at in range(seg * 64, seg * 64 + 64, 2):
                x = np.concatenate([net.embed[c] for c in data[at : at + 8]])
                best = [max(v, float(x @ net.filters[:, k])) for k, v in enumerate(best)]
        tops.append([max(0.0, v + net.bias[k]) for k, v in enumerate(best)])
    features = [sum(t[k] for t in tops) / len(tops) for k in range(24)] + [max(t[k] for t in tops) for k in range(24)]
    return 1 / (1 + np.exp(-(sum(w * x for w, x in zip(net.weight, features)) + net.offset[0])))


def test_quality_scores_against_loops():
    net = small_network(4)
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(0, 256, n, np.uint8)) for n in (0, 1, 63, 64, 65, 128, 200, 256, 257, 700, 1500)] + ["naïve 你好 ".encode() * 40]
    got = quality.score_texts(net, texts)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1.1e-5)


def test_quality_gradients_against_differences():
    """Each parameter's gradient against the change of the loss, over texts of one and of many chunks."""
    net = small_network(8)
    rng = np.random.default_rng(9)
    texts = [bytes(rng.integers(0, 256, n, np.uint8)) for n in (5, 64, 300, 1000, 4000)]
    labels = np.array([1.0, 0, 1, 0, 1])
    _, grads = quality.gradients(net, texts, labels)
    for p, g in zip(net.arrays(), grads):
        assert p.shape == g.shape
        order = np.argsort(-np.abs(g).reshape(-1))
        for k in [*order[:6].tolist(), *rng.integers(0, p.size, 6).tolist()]:
            at, keep = np.unravel_index(k, p.shape), p.reshape(-1)[k]
            p[at] = keep + 1e-6
            up = quality.gradients(net, texts, labels)[0]
            p[at] = keep - 1e-6
            down = quality.gradients(net, texts, labels)[0]
            p[at] = keep
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5 + 1e-3 * abs(g[at])


def test_quality_trains_on_whole_texts_within_bytes(spark, monkeypatch):
    """Whole texts in order of their ids' hashes as long as they fit; one that doesn't is left out, none is cut."""
    texts = {i: chr(97 + i % 26) * (50 + 40 * i) for i in range(40)}
    d = spark.createDataFrame([*texts.items(), (3, texts[3])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = []
    monkeypatch.setattr(quality, "train", lambda t, y: got.append((t, y.tolist())))
    quality.fit(d, labels, most_bytes=9000)
    order = [r[0] for r in labels.filter(~quality.held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    want, room = [], 9000
    for i in order:
        if len(texts[i]) <= room:
            want.append(i)
            room -= len(texts[i])
    want.sort()
    assert got == [([texts[i].encode() for i in want], [float(i % 2) for i in want])] and 3 < len(want) < len(order)


def test_quality_chunks_cover_whole_text():
    """A mark anywhere in a text changes its features: no byte is outside the chunks, and scores don't depend on neighbours."""
    rng = np.random.default_rng(1)
    net = quality.Network(rng.normal(0, 1, (256, 8)).astype("f4"), rng.normal(0, 1, (64, 24)).astype("f4"), np.zeros(24, "f4"), rng.normal(0, 1, 48).astype("f4"), np.zeros(1, "f4"))
    for n in (0, 1, 63, 64, 65, 255, 256, 257, 1000, 5000):
        text = b"a" * n
        assert quality.score_texts(net, [text])[0] == quality.score_texts(net, [b"zz", text, b"", text + b"b"])[1]
    best, _ = quality.convolve(net, np.frombuffer(b"a" * 640, np.uint8))
    for at in range(0, 632, 7):
        other = bytearray(b"a" * 640)
        other[at] = 200
        assert (quality.convolve(net, np.frombuffer(bytes(other), np.uint8))[0] != best).any()


def test_network_gradients_learn_position_free_mark():
    texts = [b"abc " * k + (b"#~" if k % 2 else b"") + b" def" * (60 - k) for k in range(60)]
    net = quality.train(texts, np.array([k % 2 for k in range(60)], np.float32), epochs=60)
    assert ((quality.score_texts(net, texts) > 0.5) == np.array([k % 2 for k in range(60)], bool)).mean() > 0.9


def test_warc(spark):
    html = "<p>same page</p>"
    data = [(3, "http://a/", html), (1, "http://b/ä", html), (2, None, "own"), (4, "u", None), (5, "u", ""), (None, "n", html), (7, "v", "x" * 300_000), (7, "v", "x" * 300_000), (8, "w", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, digest string")
    archives = warc.write_archives(pages)
    out = warc.read_archives(archives)
    key = lambda i: -(2**63) if i is None else i
    firsts = {}
    for i, _, h in data:
        firsts[h or ""] = min(firsts.get(h or "", key(i)), key(i))
    want = []
    for i, _, h in data:
        b, f = (h or "").encode(), firsts[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if f < key(i) else "response", f if f < key(i) and f != key(None) else None))
    assert [tuple(r) for r in rows(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")] == plain(*want)
    assert sorted((r.target_uri for r in out.collect()), key=str) == sorted((u for _, u, _ in data), key=str)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).collect() == []


def test_warc_addresses_and_one_key():
    """Addresses come back as they were, the header line staying ASCII; one key with different payloads keeps both."""
    for url in ("http://a/%20x?y=z#t", "http://ä/ü b\r\nEvil: 1", "", " ", None, "你好"):
        raw = warc.record(1, url, b"body", None, "X")
        fields = dict(x.split(": ", 1) for x in raw.split(b"\r\n\r\n")[0].decode("ascii").split("\r\n")[1:])
        assert warc.address(fields) == url and "Evil" not in fields


def test_warc_one_key_with_different_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "first"), (1, "u", "second"), (2, "u", "second"), (2, "u", "second")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages)).select("page_id", "payload_bytes", "record_type", F.coalesce("refers_to", F.lit(-1)).alias("refers_to")).collect())
    assert got == [(1, 5, "response", -1), (1, 6, "response", -1), (2, 6, "revisit", 1), (2, 6, "revisit", 1)]


def test_warc_dictionary_reaches_over_long_payloads(spark):
    body = "".join(chr(97 + i % 26) for i in range(100_003))
    got = [r[0] for r in spark.createDataFrame([(body,), (body[:16384],), ("",)], "b string").select(warc.spread(F.col("b"), 16384)).collect()]
    starts = [(len(body) - 1024) * i // 15 for i in range(16)]
    assert got == ["".join(body[a : a + 1024] for a in starts), body[:16384], ""] and starts[-1] + 1024 == len(body)


def test_warc_dictionary_frame(spark):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("http://x/").alias("url"), F.concat(F.lit("<html><body><p>a page of the archive number "), F.col("id").cast("string"), F.lit(" with words that recur</p></body></html>")).alias("html"))
    unnamed = warc.write_archives(pages.withColumn("page_id", F.lit(None).cast("long")).repartition(4), archive_bytes=4096).collect()
    assert len({a.archive for a in unnamed}) == len(unnamed) > 4
    archives = warc.write_archives(pages, archive_bytes=4096).collect()
    assert len(archives) > 1 and all(a.data[:4] == b"\x5d\x2a\x4d\x18" for a in archives)
    assert sum(len(list(warc.read_archive(bytes(a.data)))) for a in archives) == 300


def brute_lines(texts):
    key = lambda x: re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x).translate({i: i + 32 for i in range(65, 91)})
    ident = lambda i: -1 if i is None else i
    where = defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            where[key(x)].add(ident(i))
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(where[key(x)]) < 2 or min(where[key(x)]) == ident(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(docs, none, texts):
    assert [tuple(r) for r in rows(line_dedup.dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "kept")] == plain(*brute_lines(texts))
    assert line_dedup.dedup_lines(none).collect() == []


def test_lines_many_shards(spark):
    rng = np.random.default_rng(2)
    texts = [(i, "\n".join(f"line number {rng.integers(0, 400)}" if rng.random() < 0.7 else "very common line" for _ in range(rng.integers(1, 12)))) for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert [tuple(r) for r in rows(line_dedup.dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "kept")] == plain(*brute_lines(texts))


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    h, g = rng.integers(-(2**62), 2**62, n), rng.integers(-(2**31), 2**31 - 1, n)
    sizes, bits, tail, slot = line_dedup.build(line_dedup.keys_of(h, g))
    assert sorted(slot.tolist()) == list(range(n))
    row = {"sizes": sizes, "bits": np.packbits(bits).tobytes(), "tail": tail.tobytes(), "prints": np.zeros(n, np.uint32).tobytes(), "counts": b"", "firsts": b""}
    assert line_dedup.Shard(row).slots(line_dedup.keys_of(h, g)).tolist() == slot.tolist()


def test_minimal_perfect_hash_tail(monkeypatch):
    monkeypatch.setattr(line_dedup, "LEVELS", 1)
    h = np.arange(500) * 7919
    keys = line_dedup.keys_of(h, h)
    sizes, bits, tail, slot = line_dedup.build(keys)
    row = {"sizes": sizes, "bits": np.packbits(bits).tobytes(), "tail": tail.tobytes(), "prints": np.zeros(500, np.uint32).tobytes(), "counts": b"", "firsts": b""}
    assert len(tail) and sorted(slot.tolist()) == list(range(500)) and line_dedup.Shard(row).slots(keys).tolist() == slot.tolist()


def test_packing(docs, none, texts):
    t = Tokenizer.from_file(WORDS)
    out = packing.pack(docs, WORDS).toPandas()
    want = []
    for i, x in texts:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want += [(i, p, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    got = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()]
    assert plain(*got) == plain(*want)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert packing.pack(none, WORDS).collect() == []


def test_token_ids_of_odd_words():
    t = Tokenizer.from_file(WORDS)
    for x in ["It's we'll 'tis O’Neil İstanbul ΣΑΣ ß ẞ café café a\x1cb x y <|endoftext|> z<|endoftext|>z ½ ²3 ﻿ ﬁ 你好 ١٢ \x00 a\x85b ª º", "", "  ", "A.B,C!!--__##@@ 1234 12ab n't 'S 'RE"]:
        assert np.frombuffer(packing.token_ids([x.encode()], WORDS)[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_best_two_fit():
    assert packing.best_two_fit(np.array([60, 35, 20, 19, 4]), 100).max() + 1 == 2  # 60 + 35, then 35's place for 20 + 19
    rng = np.random.default_rng(0)
    for n in (1, 7, 500, 5000):
        lengths = np.minimum(2048, rng.lognormal(6, 1, n).astype(int) + 1)
        bins = packing.best_two_fit(lengths, 2048)
        sums = np.bincount(bins, lengths)
        assert sums.max() <= 2048 and (sums > 0).all() and len(bins) == n
        assert len(sums) <= np.ceil(lengths.sum() / 2048) + 2 + n * (n < 20)


def brute_fingerprint(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, none, texts):
    ident = lambda i: -1 if i is None else i
    fps = [brute_fingerprint(t, 3) for _, t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {g: min(ident(texts[i][0]) for i in range(len(texts)) if group[i] == g) for g in group}
    want = plain(*((i, f"{f:016x}", None if first[g] < 0 else first[g]) for (i, _), f, g in zip(texts, fps, group)))
    assert [tuple(r) for r in rows(simhash.simhash_groups(docs), "doc_id", "fingerprint", "component_id")] == want
    assert simhash.simhash_groups(none).collect() == []


def test_ball_hashing_finds_all_links(spark, monkeypatch):
    """Random fingerprints around centres, against all pairs."""
    rng = np.random.default_rng(9)
    fps = []
    for _ in range(12):
        c = int(rng.integers(0, 2**63))
        for _ in range(25):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.append(x - (1 << 64) if x >> 63 else x)
    table = spark.createDataFrame(list(enumerate(fps)), "_doc long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: table)
    got = {r.doc_id: r.component_id for r in simhash.simhash_groups(None).collect()}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(fps)):
        for b in range(a):
            if bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(len(fps))}


def test_similar_groups_against_all_pairs(spark, none):
    rng = np.random.default_rng(12)
    texts = []
    for c in range(60):
        base = [f"w{rng.integers(0, 400)}" for _ in range(int(rng.integers(30, 200)))]
        for _ in range(int(rng.integers(1, 5))):
            t = list(base)
            for _ in range(int(rng.integers(0, max(1, len(t) // 25)))):
                t[rng.integers(0, len(t))] = f"new{rng.integers(0, 999)}"
            texts.append(" ".join(t))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(texts)) for b in range(a)}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), j in alike.items():
        if j >= 0.8 and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(j >= 0.8 for j in alike.values()) > 40
    assert got == {i: find(i) for i in range(len(texts))}
    assert simhash.similar_groups(none).collect() == []


def test_similar_groups_of_odd_rows(docs, texts):
    got = sorted(((r.doc_id, r.component_id) for r in simhash.similar_groups(docs).collect()), key=str)
    assert len(got) == len(texts) and (6, 5) in got and (4, 2) in got and (8, 2) in got and (None, None) in got and (9, 9) in got and (10, 9) in got


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}


def test_shards(spark, docs, none):
    rng = np.random.default_rng(4)
    sizes = spark.createDataFrame([(i, int(rng.integers(0, 500))) for i in range(500)] + [(None, 7), (1, None), (77, 4000), (77, 5000)], "doc_id long, n_bytes long")
    out = sharding.extendible_shards(sizes, 4000).toPandas()
    assert len(out) == 504
    sums = out.groupby("shard").n_bytes.sum()
    for s, g in out.groupby("shard"):
        assert (g.depth == len(s)).all() and (g.shard_bytes == sums[s]).all() and (g.oversize == (sums[s] > 4000)).all()
        assert sums[s] <= 4000 or len(s) == 60
        if s:  # its parent was too large
            assert out[out.shard.str.startswith(s[:-1])].n_bytes.sum() > 4000
    names = sorted(out.shard.unique())
    assert not any(b.startswith(a) and a != b for a, b in zip(names, names[1:]))
    assert sharding.extendible_shards(none.selectExpr("doc_id", "n_chars AS n_bytes"), 100).collect() == []


def test_written_shards(spark, docs, tmp_path):
    for extra in ([], ["shard"], ["shard", "_shard", "key", "of", "row", "n_bytes"]):
        at = str(tmp_path / f"out{len(extra)}")
        whole = docs.select("*", *[F.lit(7).alias(c) for c in extra])
        sharding.write_shards(whole, at, 500_000)
        folder = {0: "shard", 1: "_shard", 6: "_shard_bits"}[len(extra)]
        got = spark.read.option("basePath", at).parquet(*map(str, (tmp_path / f"out{len(extra)}").glob(f"{folder}=*"))).select(*whole.columns, F.element_at(F.split(F.input_file_name(), f"/{folder}="), -1).alias("at"))
        sized = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"))
        where = {(r.doc_id, r.shard) for r in sharding.extendible_shards(sized, 500_000).collect()}
        size = defaultdict(int)
        for r in got.collect():
            shard = r["at"].split("/")[0].replace("__HIVE_DEFAULT_PARTITION__", "")
            assert (r.doc_id, shard) in where
            size[shard] += len((r.text or "").encode())
        assert rows(got, *whole.columns) == rows(whole, *whole.columns) and len(size) > 1
        over = {r.shard for r in sharding.extendible_shards(sized, 500_000).filter("oversize").collect()}
        assert all(n <= 500_000 for s, n in size.items() if s not in over)
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"), 10)


def test_rows_of_one_id_with_equal_short_hashes(spark):
    """Two texts whose 32-bit hashes are equal, under one id: neither loses what the other does."""
    line = F.concat(F.lit("unique line number "), F.col("id").cast("string"))
    twins = spark.range(400_000).select(line.alias("t")).groupBy(F.hash("t").alias("h")).agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a < b").first()
    df = spark.createDataFrame([(1, twins.a), (5, twins.a), (5, twins.b)], "doc_id long, text string")
    got = line_dedup.dedup_lines(df)
    assert rows(got, "doc_id", "n_dropped", "kept") == plain((1, 0, twins.a), (5, 1, ""), (5, 0, twins.b))
    items = spark.createDataFrame([(1, twins.a)], "item_id long, text string")
    assert rows(decontamination.decontaminate(df, items), "doc_id", "n_hit") == plain((1, 4), (5, 4), (5, 0))


def test_long_rows_are_not_broadcast(spark):
    few = spark.createDataFrame([("x" * 1000,)] * 5, "s string")
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(small_side(few, 5, F.octet_length("s"), 5000)).lower()
    assert "broadcast" not in plan(small_side(few, 5, F.octet_length("s"), 4999)).lower() + plan(small_side(few, 4)).lower()


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    w = words(text)
    hit, who = set(), set()
    for i, t in items:
        v = words(t)
        m = min(10, len(v))
        for s in range(len(v) - m + 1) if m else ():
            for p in range(len(w) - m + 1):
                if w[p : p + m] == v[s : s + m]:
                    hit |= set(range(p, p + m))
                    who.add(str(i))
    return len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, docs, none, texts):
    from tests.llm.conftest import ITEM, LONG

    items = [(1, ITEM), (2, "tiny words"), (20, "Again"), (3, None), (4, "..."), (None, "quick brown fox"), (7, " ".join(LONG.split()[100:140])), (7, ITEM)]
    bench = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, sid string")
    out = decontamination.decontaminate(docs, bench)
    short = [(i, t if t is None or len(t) < 10_000 else t[:4000]) for i, t in texts]
    named = [(str(i) if i is not None else None, t) for i, t in items if i is not None]
    got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()}
    for i, t in short:
        if t is None or len(t) < 4000:
            n, *want = brute_hits(t, named)
            if "quick brown fox" not in (t or ""):
                assert got[(i, n)] == tuple(want), (i, t)
    assert out.count() == len(texts)
    for i in (9, 10):
        assert [v for k, v in got.items() if k[0] == i][0][3]
    assert decontamination.decontaminate(none, bench).collect() == []
    assert decontamination.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_random(spark):
    rng = np.random.default_rng(8)
    word = lambda: "abcd"[rng.integers(0, 4)]
    items = [(i, " ".join(word() for _ in range(rng.integers(0, 16)))) for i in range(12)]
    texts = [(i, " ".join(word() for _ in range(rng.integers(0, 300))) + " " + (items[i % 12][1] if i % 3 == 0 else "")) for i in range(40)]
    out = decontamination.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [tuple(r) for r in rows(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")] == plain(*((i, *brute_hits(t, items)) for i, t in texts))


def brute_repeats(texts):
    order = sorted(range(len(texts)), key=lambda k: -1 if texts[k][0] is None else texts[k][0])
    first = {}
    for k in order:
        i, b = -1 if texts[k][0] is None else texts[k][0], (texts[k][1] or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (-1 if i is None else i):
                gone[p : p + 50] = True
        gone = gone[:-1]
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


REPEATS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats(docs, none, texts):
    assert [tuple(r) for r in rows(suffix_dedup.remove_repeats(docs), *REPEATS)] == plain(*brute_repeats(texts))
    assert suffix_dedup.remove_repeats(none).collect() == []


def test_repeats_over_blocks(spark):
    """Many small partitions, so that copies lie in different blocks; periodic texts give long ties."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abc "), 8))
    shared = ["".join(word() for _ in range(30)) for _ in range(4)]
    texts = []
    for i in range(60):
        parts = [word() * int(rng.integers(1, 30)) if rng.random() < 0.4 else shared[rng.integers(0, 4)][rng.integers(0, 60) : rng.integers(100, 240)] for _ in range(5)]
        texts.append((int(i), "".join(parts)))
    texts.append((70, "ab" * 400))
    texts.append((71, "ab" * 300 + "c" + "ab" * 60))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(13)
    assert [tuple(r) for r in rows(suffix_dedup.remove_repeats(df, keep=False), *REPEATS)] == plain(*brute_repeats(texts))


def test_bucket_order_is_lexicographic():
    rng = np.random.default_rng(3)
    for alphabet in ("ab", "a", "abcdefgh"):
        text = "".join(rng.choice(list(alphabet), 3000)).encode()
        data = np.frombuffer(text + bytes(128), np.uint8)
        rank = suffix_dedup.cover_ranks(data, 50)
        at = rng.permutation(2900)
        order = at[suffix_dedup.sort_bucket(data, at, rank)]
        heads = [text[p : p + 50] for p in order]
        assert heads == sorted(heads)


def exact(texts):
    """Pairs of a similarity of 0.8 or more, and all similarities, by brute force."""
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    return {(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def grouped(spark, texts):
    return {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_similar_pairs_of_repeats_and_short_texts(spark):
    rng = np.random.default_rng(22)
    own = lambda n: " ".join(f"o{rng.integers(0, 10**9)}" for _ in range(n))
    long, short = [], []
    for i in range(12):
        base = own(300)
        long += [base, base + (" " + own(10)) * 40]  # one passage many times: a few shingles more in the set
    for i in range(150):
        n = int(rng.integers(8, 23))
        t = own(n)
        short += [t, t + " " + own(1)]  # n - 4 shingles of n - 3: 0.8 or more
    for texts, least in ((long, 12), (short, 150)):
        close, got = exact(texts), grouped(spark, texts)
        assert len(close) >= least and all(got[a] == got[b] for a, b in close)
        assert len(set(got.values())) == len(texts) // 2


def test_similar_pairs_in_a_template_group(spark):
    """A template's texts, most of a similarity of 0.6 to 0.8, whose parts meet; the pairs inside are found whatever stands before them."""
    rng = np.random.default_rng(21)
    own = lambda n: " ".join(f"o{rng.integers(0, 10**9)}" for _ in range(n))
    body = " ".join(f"w{i}" for i in range(100))
    texts = [f"{body} {own(int(rng.integers(13, 17)))}" for _ in range(600)]
    for i in range(300, 340):
        cut = texts[i].split()
        texts.append(" ".join(cut[:5] + [f"n{i}"] + cut[6:] + [f"z{i}x{k}" for k in range(13)]))
    close, got = exact(texts), grouped(spark, texts)
    assert len(close) >= 40
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in close:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(len(texts))}
