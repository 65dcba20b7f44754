"""Alignment of two tokenizers over a corpus: which of their tokens cover the same bytes, and in how many documents."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, written
from .line_dedup import Shard, build

#: Shards of the index by id of tokenizer A: one holds at most its ids times the vocabulary of B, at any size of the corpus.
SHARDS = 128
#: Bytes of text that one chunk of documents has, unless a single one is longer; links a group may have before they are counted by id.
CHUNK, WIDE = 4 << 20, 4096
#: Rows that a file of chunks, or of arrays of a shard, holds in memory at once, and those of a file of a chunk's pairs by shard.
LARGE, SMALL = 2, 256
#: How the byte-level tokenizer splits a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DOCS = "chunk long, docs array<long>, na array<int>, nb array<int>, a binary, b binary"
PARTS = "chunk long, shard int, pairs binary, seen binary"


def byte_characters() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece: <0xHH> is one byte, U+2581 a space."""
    return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()


@lru_cache(2)
def tokenizers(path_a: str, path_b: str) -> tuple[Callable, Callable, list[bytes], list[bytes]]:
    """Functions from a text to ids, and each id's bytes, of the byte-level BPE in path_a and the pieces in path_b.

    The first splits and merges as the tokenizer's own file says, by a faster library (ids are equal; tests hold them
    against the file's own library); special tokens are plain text for both."""
    import sentencepiece
    import tiktoken

    with open(path_a, encoding="utf-8") as f:
        spec = json.load(f)
    special, chars = {t["content"] for t in spec["added_tokens"]}, byte_characters()
    words = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    ranks = {bytes(chars[c] for c in t): i for t, i in words.items()}
    a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    of_a = [b""] * (1 + max(ranks.values()))
    for t, i in ranks.items():
        of_a[i] = t
    return a.encode_ordinary, b.encode, of_a, [piece_bytes(b.id_to_piece(i)) for i in range(b.get_piece_size())]


def encode(text: str | None, path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of space and text by both tokenizers; none where the text is null or empty or either loses bytes of it."""
    of_a, of_b, bytes_a, bytes_b = tokenizers(path_a, path_b)
    x, y, whole = of_a(" " + text) if text else [], of_b(text) if text else [], (" " + (text or "")).encode()
    on = b"".join(map(bytes_a.__getitem__, x)) == whole == b"".join(map(bytes_b.__getitem__, y))
    return np.array(x if on else [], np.uint16), np.array(y if on else [], np.uint16)


def groups(a: np.ndarray, b: np.ndarray, path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of A and of B, and how many there are. The tokens of several documents follow one another."""
    *_, bytes_a, bytes_b = tokenizers(path_a, path_b)
    ends = [np.cumsum(np.fromiter(map(len, of), np.int64, len(of))[x]) for of, x in ((bytes_a, a), (bytes_b, b))]
    cuts = np.intersect1d(*ends, assume_unique=True)
    return np.searchsorted(cuts, ends[0]), np.searchsorted(cuts, ends[1]), len(cuts)


def links(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, n: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, pair) in order, as document * 2^32 + id of A * 2^16 + id of B, and how often each is linked.

    doc: the document of each token of A. Groups with many links are counted by distinct ids, so they are not listed."""
    in_a, in_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    wide = in_a * in_b > WIDE
    first = np.cumsum(in_b) - in_b
    of = np.flatnonzero(~wide[ga])
    times = in_b[ga[of]]
    inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    key = np.repeat((doc[of].astype(np.int64) << 32) | (a[of].astype(np.int64) << 16), times) | b[np.repeat(first[ga[of]], times) + inside].astype(np.int64)
    found, count = np.unique(key, return_counts=True)
    if not wide.any():
        return found, count
    keys, counts, starts = [found], [count], np.cumsum(in_a) - in_a
    for g in np.flatnonzero(wide):
        x, nx = np.unique(a[starts[g] : starts[g] + in_a[g]], return_counts=True)
        y, ny = np.unique(b[first[g] : first[g] + in_b[g]], return_counts=True)
        keys.append((((int(doc[starts[g]]) << 32) | (x.astype(np.int64) << 16))[:, None] | y.astype(np.int64)).ravel())
        counts.append(np.outer(nx, ny).ravel())
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return found, total


def aligned_chunks(docs: DataFrame, path_a: str, path_b: str, doc_id: str, text: str) -> DataFrame:
    """Chunks of documents: their ids by both tokenizers, and the distinct pairs of the chunk with the documents of each."""

    def chunk(number: int, ids: list, texts: list) -> pa.RecordBatch:
        x, y = zip(*(encode(t, path_a, path_b) for t in texts))
        na, nb = ([len(t) for t in z] for z in (x, y))
        a, b = np.concatenate(x), np.concatenate(y)
        key, _ = links(a, b, *groups(a, b, path_a, path_b), np.repeat(np.arange(len(na)), na))
        pairs, seen = np.unique((key & 0xFFFFFFFF).astype(np.uint32), return_counts=True)
        row = {"chunk": number, "docs": ids, "na": na, "nb": nb, "a": a.tobytes(), "b": b.tobytes(), "pairs": pairs.tobytes(), "seen": seen.astype(np.uint32).tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=kind)

    kind = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("na", pa.list_(pa.int32())), ("nb", pa.list_(pa.int32())), *[(c, pa.binary()) for c in ("a", "b", "pairs", "seen")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for whole in batches:
            for batch in slices(whole, "_text", CHUNK // 4):
                ids += batch.column(0).to_pylist()
                texts += (new := batch.column(1).to_pylist())
                size += sum(len(t or "") + 16 for t in new)
                if size >= CHUNK:
                    yield chunk(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield chunk(number, ids, texts)

    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    return written(rows.mapInArrow(run, DOCS + ", pairs binary, seen binary"), "token-chunks", LARGE)


def by_shard(pairs: np.ndarray) -> list[np.ndarray]:
    """Places of each shard's pairs, in order."""
    shard = (pairs >> np.uint32(16)).astype(np.int64) % SHARDS
    return np.split(np.argsort(shard, kind="stable"), np.cumsum(np.bincount(shard, minlength=SHARDS))[:-1])


def chunk_parts(chunks: DataFrame) -> DataFrame:
    """(chunk, shard, pairs, seen): a chunk's pairs by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, seen = np.frombuffer(row["pairs"], np.uint32), np.frombuffer(row["seen"], np.uint32)
                out = [(row["chunk"], s, pairs[at].tobytes(), seen[at].tobytes()) for s, at in enumerate(by_shard(pairs)) if len(at)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "shard", "pairs", "seen"])

    return written(chunks.select("chunk", "pairs", "seen").mapInArrow(run, PARTS), "token-pairs", SMALL)


def folded(rows: DataFrame, keys: list[str], start: Callable, schema: str, then: list | None = None, tasks: int = 1) -> DataFrame:
    """Rows of each key, in the order of `then`, given one by one to the object that start() makes for a key.

    The object's add(row) and end(key) return lists of result rows. Rows stream, so a key's rows are never in memory at once.
    tasks: so many at least."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                new = tuple(row[k] for k in keys)
                if state is None or new != key:
                    out += state.end(key) if state is not None else []
                    key, state = new, start()
                out += state.add(row)
            yield as_batch(out)
        if state is not None:
            yield as_batch(state.end(key))

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [arrow[c.split()[1]] for c in schema.split(", ")]
    tasks = max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, *(then or [])).mapInArrow(run, schema)


class Union:
    """Distinct pairs of a key's rows."""

    def __init__(self) -> None:
        self.all, self.new, self.n = np.zeros(0, np.uint32), [], 0

    def merge(self) -> None:
        self.all, self.new, self.n = np.unique(np.concatenate([self.all, *self.new])), [], 0

    def add(self, row: dict) -> list:
        self.new.append(np.frombuffer(row["pairs"], np.uint32))
        self.n += len(self.new[-1])
        if self.n > max(1 << 18, len(self.all)):
            self.merge()
        return []

    def end(self, key: tuple) -> list:
        self.merge()
        return [(*key, self.all.tobytes())]


class Index(Shard):
    """A shard's minimal perfect hash with the pair of each slot, so that a hit is verified."""

    def __init__(self, row: dict) -> None:
        self.sizes, self.bits = row["sizes"], np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
        self.before = np.cumsum(self.bits, dtype=np.int64) - self.bits
        self.tail, self.prints = np.frombuffer(row["tail"], np.uint64), np.frombuffer(row["own"], np.uint32)
        self.set = int(self.bits.sum())

    def find(self, pairs: np.ndarray) -> np.ndarray:
        at = self.slots(pairs.astype(np.uint64))
        if not np.array_equal(self.prints[at], pairs):
            raise ValueError("a pair isn't in its shard's index")
        return at


class Vector:
    """A dense vector of counts by slot, from the parts of chunks or from vectors."""

    def __init__(self) -> None:
        self.index = self.sum = None

    def add(self, row: dict) -> list:
        if row["sizes"] is not None:
            self.index = Index(row)
            self.sum = np.zeros(len(self.index.prints), np.int64)
        elif row["pairs"] is not None:  # a chunk's pairs are distinct
            self.sum[self.index.find(np.frombuffer(row["pairs"], np.uint32))] += np.frombuffer(row["seen"], np.uint32)
        else:
            new = np.frombuffer(row["vector"], np.int64)
            self.sum = new.copy() if self.sum is None else self.sum + new
        return []

    def end(self, key: tuple) -> list:
        return [(*key, self.sum.tobytes())]


class Answer:
    """Counts of a chunk's pairs, and whether each is the highest of its id of A, from the arrays of their shard."""

    def __init__(self) -> None:
        self.index = None

    def add(self, row: dict) -> list:
        if row["sizes"] is not None:
            self.index, self.count = Index(row), np.frombuffer(row["vector"], np.int64)
            most = np.zeros(1 << 16, np.int64)
            np.maximum.at(most, self.index.prints >> 16, self.count)
            self.best = self.count == most[self.index.prints >> 16]
            return []
        at = self.index.find(np.frombuffer(row["pairs"], np.uint32))
        return [(row["chunk"], row["shard"], self.count[at].tobytes(), self.best[at].tobytes())]

    def end(self, key: tuple) -> list:
        return []


def pair_index(parts: DataFrame, chunks: int, fan: int = 64) -> DataFrame:
    """(shard, sizes, bits, tail, own), written: the distinct pairs, united in a tree of so many branches a node, and their hash."""
    width, rows = -(-chunks // fan), parts.select("shard", F.col("chunk").alias("sub"), "pairs")
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("sub"), F.lit(max(1, width))).cast("int"))
    while width > 1:
        rows = written(folded(rows, ["shard", "sub"], Union, "shard int, sub int, pairs binary"), "distinct-pairs", LARGE)
        width = -(-width // fan)
        rows = rows.withColumn("sub", F.pmod("sub", F.lit(width)).cast("int"))

    class Built(Union):
        def end(self, key: tuple) -> list:
            self.merge()
            sizes, bits, tail, slot = build(self.all.astype(np.uint64))
            own = np.empty(len(slot), np.uint32)
            own[slot] = self.all
            return [(key[0], sizes, np.packbits(bits).tobytes(), tail.tobytes(), own.tobytes())]

    return written(folded(rows.drop("sub"), ["shard"], Built, "shard int, sizes array<int>, bits binary, tail binary, own binary"), "pair-index", LARGE)


def with_index(rows: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """Rows (shard, sub, ...) and, for each sub, its shard's arrays, to be read before them."""
    copies = index.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return copies.unionByName(rows, allowMissingColumns=True)


def pair_counts(parts: DataFrame, index: DataFrame, width: int, fan: int = 64) -> DataFrame:
    """(shard, sub, vector), written: dense counts by slot, summed in a tree; sub is 0."""
    dealt = with_index(parts.withColumn("sub", F.pmod(F.xxhash64("chunk"), F.lit(width)).cast("int")), index, width).withColumn("vector", F.lit(None).cast("binary"))
    sums = written(folded(dealt, ["shard", "sub"], Vector, "shard int, sub int, vector binary", [F.col("sizes").isNull()]), "count-vectors", LARGE)
    while width > 1:
        width = -(-width // fan)
        rows = sums.select("shard", F.pmod("sub", F.lit(width)).cast("int").alias("sub"), F.lit(None).alias("sizes"), F.lit(None).alias("pairs"), "vector")
        sums, before = written(folded(rows, ["shard", "sub"], Vector, "shard int, sub int, vector binary"), "count-vectors", LARGE), sums
        discard(before)
    return sums


class Documents:
    """Results of a chunk's documents, aligned again and counted by the answers that came before."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.paths, self.answers = (path_a, path_b), {}

    def add(self, row: dict) -> list:
        if row["count"] is not None:
            self.answers[row["shard"]] = np.frombuffer(row["count"], np.int64), np.frombuffer(row["best"], bool)
            return []
        a, b, na, nb = np.frombuffer(row["a"], np.uint16), np.frombuffer(row["b"], np.uint16), np.array(row["na"], np.int64), np.array(row["nb"], np.int64)
        ga, gb, n = groups(a, b, *self.paths)
        doc = np.repeat(np.arange(len(na)), na)
        key, times = links(a, b, ga, gb, n, doc)
        pair = (key & 0xFFFFFFFF).astype(np.uint32)
        pairs = np.unique(pair)
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        for shard, at in enumerate(by_shard(pairs)):
            if len(at):
                count[at], best[at] = self.answers[shard]
        at = np.searchsorted(pairs, pair)
        sums = [np.zeros(len(na), np.int64) for _ in range(3)]
        for s, v in zip(sums, (times, times * best[at], times * count[at])):
            np.add.at(s, key >> 32, v)
        last = np.cumsum(na)
        n_groups = np.diff(np.r_[0, np.r_[0, ga + 1][last]])
        return [(i, *map(int, v), s) for i, *v, s in zip(row["docs"], na, nb, n_groups, *sums, self.digests(a, b, ga, gb, na, nb))]

    @staticmethod
    def digests(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> Iterator[str]:
        """SHA-256 of each document's groups as text: ids by comma, A from B by |, groups by semicolon."""
        ends = lambda g: np.r_[g[1:] != g[:-1], True] if len(g) else np.zeros(0, bool)
        code = np.concatenate([a.astype(np.int64) + ends(ga) * (1 << 16), b.astype(np.int64) + ends(gb) * (2 << 16)])
        code = code[np.argsort(np.concatenate([ga * 2, gb * 2 + 1]), kind="stable")]
        cuts = np.r_[0, np.cumsum(na + nb)].tolist()
        words = id_words()
        for x, y in zip(cuts, cuts[1:]):
            yield hashlib.sha256("".join(map(words.__getitem__, code[x:y].tolist()))[:-1].encode()).hexdigest() if y > x else ""

    def end(self, key: tuple) -> list:
        return []


@lru_cache(1)
def id_words() -> list[str]:
    return [f"{i}{c}" for c in ",|;" for i in range(1 << 16)]


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs.

    Each text is encoded by a byte-level BPE (A, of space and text) and by a piece model (B, which adds the space). Byte
    offsets where tokens of both end cut them into groups; all A-B occurrences within a group are linked. An id pair's count
    is the number of documents (rows) that hold it linked; n_best is the links whose count is the highest that their id
    of A has anywhere, ties included, and count_sum the sum of the links' counts.

    Texts are encoded once, in chunks, which keep ids. A minimal perfect hash over all distinct pairs, in shards by id of A,
    gives each pair a slot; dense vectors of counts by slot are summed in a tree. The second pass sends each chunk's distinct
    pairs to the arrays of their shards, aligns its documents again and looks their counts up. A chunk's pairs are counted
    before they move, so that no token, frequent as it may be, is a key of many rows. Every hit is verified by the slot's pair.

    Null and empty texts, and those of which a tokenizer loses bytes, have no tokens: zeros and ''. Null ids stay null;
    repeated rows are documents of their own; an empty table gives none; other columns are ignored.
    """
    chunks = aligned_chunks(docs, path_a, path_b, doc_id, text)
    parts = chunk_parts(chunks)
    n = chunks.count()
    index = pair_index(parts, n)
    entries, distinct = (t.agg(F.coalesce(F.sum(F.octet_length(c)), F.lit(0))).first()[0] for t, c in ((parts, "pairs"), (index, "own")))
    width = max(1, -(-entries // (4 * max(1, distinct))))  # a vector sums at least about four times as many entries as it has slots
    counts = pair_counts(parts, index, width)
    asked = parts.select("chunk", "shard", "pairs", F.pmod(F.xxhash64("chunk"), F.lit(width)).cast("int").alias("sub"))
    answers = folded(with_index(asked, index.join(counts.drop("sub").hint("merge"), "shard"), width), ["shard", "sub"], Answer, "chunk long, shard int, count binary, best binary", [F.col("sizes").isNull()])
    answers = written(answers, "pair-answers", SMALL)
    discard(parts, index, counts)
    rows = answers.unionByName(chunks.drop("pairs", "seen"), allowMissingColumns=True)
    out = folded(rows, ["chunk"], lambda: Documents(path_a, path_b), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string", [F.col("a").isNotNull()], -(-n // 4))
    out = written(out, "token-alignments")
    discard(chunks, answers)
    return out
