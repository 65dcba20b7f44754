"""Personal data by patterns and a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, key_back, slices, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Labels: none of the kinds, or one of them. Buckets of a token's shape. Characters between tokens that are neighbours.
LABELS, SHAPES, GAP = len(KINDS) + 1, 1024, 2
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match that starts within a run of digits would also start at its first
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"[0-9@][A-Za-z0-9@._%+()-]*")
TOKEN_CHARS = LOCAL | frozenset("@()")
RUN = re.compile(r"(.)\1*", re.S)
SHAPE = str.maketrans({**dict.fromkeys("0123456789", "0"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "a")})


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; each goes from the first local character before an @ that no match has yet, so long runs of
    such characters without @ are never scanned twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, code points, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split(".") if len(x.lstrip("0")) <= 3) and all(len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs of token characters that hold a digit or @, the only ones that can be part of the kinds."""
    out, end = [], 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if a < end:
            continue
        while a > end and text[a - 1] in TOKEN_CHARS:
            a -= 1
        while b - a > 1 and text[b - 1] in ".-(_%":
            b -= 1
        out.append((a, b))
        end = m.end()
    return out


def shape_of(token: str) -> int:
    """A bucket of the token's shape: runs of digits, letters or another character, with lengths up to 9."""
    return zlib.crc32(RUN.sub(lambda r: r[1] + str(min(9, len(r[0]))), token.translate(SHAPE)).encode()) % SHAPES


def likeness(token: str) -> str | None:
    """What similar tokens share: their last seven digits if they have four, else the address around an @."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    return token.lower() if "@" in token else digits[-7:] if len(digits) >= 4 else None


@dataclass
class Graph:
    """Tokens of some documents, edges between neighbours and, skipping what lies between, between similar tokens."""

    doc: list[int]
    span: list[tuple[int, int]]
    shape: list[int]
    label: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph_of(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> Graph:
    g = Graph([], [], [], [], [], [])
    for d, (text, base) in enumerate(zip(texts, spans)):
        last: dict[str, int] = {}
        known = sorted((a, b, k) for k, a, b in base)
        i = 0
        for a, b in tokens(text):
            n = len(g.doc)
            while i < len(known) and known[i][1] <= a:
                i += 1
            g.doc.append(d)
            g.span.append((a, b))
            g.shape.append(shape_of(text[a:b]))
            g.label.append(next((k + 1 for s, e, k in known[i : i + len(KINDS)] if s < b and a < e), 0))
            if n and g.doc[n - 1] == d and a - g.span[n - 1][1] <= GAP:
                g.chain.append((n - 1, n))
            if key := likeness(text[a:b]):
                if key in last:
                    g.skip.append((last[key], n))
                last[key] = n
    return g


@dataclass
class Field:
    """Log potentials: of a label for a shape, and of the labels of neighbours and of similar tokens."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def count_labels(docs: DataFrame, text: str) -> DataFrame:
    """(part, a, b, n): how often shape a has label b, and labels a and b stand at the ends of an edge.

    Where a pattern has one of two similar tokens only, the other's label is what the field is to find out, so such edges
    between similar tokens don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for whole in batches:
            for batch in slices(whole, "_text", 4 << 20):
                texts = [t or "" for t in batch.column(0).to_pylist()]
                g = graph_of(texts, [base_spans(t) for t in texts])
                seen.update(("unary", s, y) for s, y in zip(g.shape, g.label))
                seen.update(("chain", g.label[i], g.label[j]) for i, j in g.chain)
                seen.update(("skip", g.label[i], g.label[j]) for i, j in g.skip if (g.label[i] > 0) == (g.label[j] > 0))
        if seen:
            yield pa.RecordBatch.from_pylist([{"part": p, "a": a, "b": b, "n": n} for (p, a, b), n in seen.items()], schema=pa.schema([("part", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))

    return docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, "part string, a int, b int, n long").groupBy("part", "a", "b").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 4000) -> Field:
    """Piecewise training on a bounded sample: the `most` documents with the smallest hash of their id, whose labels are
    the patterns' own matches. Each potential is the log ratio of how often values meet to how often they would by
    chance, smoothed; the sums that reach the driver are at most 1,024 shapes by five labels."""
    ids = docs.select(F.col(doc_id).alias("_id")).filter("_id IS NOT NULL").orderBy(F.xxhash64("_id"), "_id").limit(most).distinct()
    counts = {"unary": np.zeros((SHAPES, LABELS)), "chain": np.zeros((LABELS, LABELS)), "skip": np.zeros((LABELS, LABELS))}
    for r in count_labels(docs.join(F.broadcast(ids), F.col(doc_id) == F.col("_id"), "left_semi"), text).collect():
        counts[r.part][r.a, r.b] += r.n
    prior = counts["unary"].sum(0) + 0.5
    prior = 0.2 * prior / prior.sum() + 0.8 * np.eye(LABELS)[0]  # a shape that was never seen is none of the kinds, most likely
    u = counts["unary"] + 2 * prior
    unary = np.log(u / u.sum(1, keepdims=True))

    def pair(c: np.ndarray) -> np.ndarray:
        c = c + c.T + 0.5 * (np.eye(LABELS) + 0.1)
        return np.log(c / c.sum() / np.outer(c.sum(1), c.sum(0)) * c.sum() ** 2)

    return Field(unary, pair(counts["chain"]), pair(counts["skip"]))


def beliefs(field: Field, g: Graph, rounds: int = 10) -> np.ndarray:
    """Label probabilities of each token by loopy sum-product over all documents' graphs at once, messages damped by half.
    Tokens of a pattern's match keep its label."""
    n = len(g.doc)
    label = np.array(g.label, np.int64)
    local = field.unary[np.array(g.shape, np.int64)].copy() if n else np.zeros((0, LABELS))
    fixed = label > 0
    local[fixed] = -30.0
    local[fixed, label[fixed]] = 0.0
    edges = np.array(g.chain + g.skip, np.int64).reshape(-1, 2)
    if len(edges):
        source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
        weights = np.concatenate([np.repeat(field.chain[None], len(g.chain), 0), np.repeat(field.skip[None], len(g.skip), 0)])
        weights = np.concatenate([weights, weights.transpose(0, 2, 1)])
        sent = np.zeros((len(source), LABELS))
        total = local
        for _ in range(rounds):
            out = total[source] - sent[back]
            joint = out[:, :, None] + weights
            top = joint.max(1)
            new = top + np.log(np.exp(joint - top[:, None]).sum(1))
            new -= new.max(1, keepdims=True)
            sent = 0.5 * sent + 0.5 * new
            total = local + np.stack([np.bincount(target, sent[:, y], n) for y in range(LABELS)], axis=1)
        local = total
    p = np.exp(local - local.max(1, keepdims=True)) if n else local
    return p / p.sum(1, keepdims=True) if n else p


def added_spans(field: Field, g: Graph, bar: float = 0.5) -> list[tuple[int, int, int, int]]:
    """(document, kind, start, end) of tokens outside the patterns whose likeliest label is a kind; neighbours of one kind join."""
    p = beliefs(field, g)
    linked = {j for _, j in g.chain}
    out: list[tuple[int, int, int, int]] = []
    before = -2
    for i in np.flatnonzero((np.array(g.label, np.int64) == 0) & (p[:, 1:].max(1, initial=0) > bar)).tolist() if g.doc else ():
        kind = int(p[i, 1:].argmax())
        if before == i - 1 and i in linked and out[-1][:2] == (g.doc[i], kind):
            out[-1] = (g.doc[i], kind, out[-1][2], g.span[i][1])
        else:
            out.append((g.doc[i], kind, *g.span[i]))
        before = i
    return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    Counts and base_sha256 are of the patterns' matches; spans also lists what the field adds. Null and empty texts have
    none; null and repeated ids get a row for each row; an empty table gives no rows; offsets are code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", 4 << 20):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                every = [list(b) for b in base]
                for d, k, a, b in added_spans(field, graph_of(texts, base)):
                    every[d].append((k, a, b))
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(spell(b).encode()).hexdigest() for b in base]), pa.array([spell(s) for s in every]), pa.array([len(s) - len(b) for s, b in zip(every, base)], pa.int64())], names=["_doc", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    out = docs.select(doc_key(doc_id).alias("_doc"), F.col(text).cast("string").alias("_text"))
    out = small_batches(out).mapInArrow(run, "_doc long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return out.select(key_back("_doc").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")
