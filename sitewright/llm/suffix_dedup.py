"""Removal of long byte strings that an earlier document has, by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, key_back, slices, written

#: Length of the strings; of the anchor grams inside them, of which each string has LENGTH - GRAM + 1.
LENGTH, GRAM = 50, 24
#: Period and difference cover: any two positions reach the cover together within PERIOD - 1 steps.
PERIOD, COVER = 7, (1, 2, 4)
#: Bytes of text in a block of documents, start positions handled at once, anchors of a hash bucket.
BLOCK, STEP, BUCKET = 4 << 20, 1 << 20, 400_000
HASH_BITS, PLACE_BITS = 40, 24
WORDS = -(-(2 * LENGTH - GRAM) // 8)
SHIFT = [[next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER) for s in range(PERIOD)] for r in range(PERIOD)]
ODD = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64)) for i in range(WORDS)]


def words_at(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The eight bytes from each place (all places, or those given) as big-endian numbers; data has a margin of zeros."""
    view = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    return (view if at is None else view[at]).astype(np.uint64)


def stir(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


class Runs:
    """Runs of start positions of LENGTH-byte strings whose anchor is the same.

    The anchor of a string is the gram in it with the smallest hash, the leftmost of equal ones, so that equal strings
    have equal anchors wherever they stand. first and count give a run's positions, h its anchor's hash, doc its document
    within the block. `data` holds the documents one after another and a margin of zeros.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        last = np.maximum(ends - LENGTH, ends - sizes - 1)  # the last start position of each document
        parts = []
        n = len(data) - 128
        for a in range(0, n, STEP):
            b = min(a + STEP, n)
            w = words_at(data[a : b + 100])
            m = b - a + LENGTH - GRAM
            h = stir(w[:m] * ODD[0] + w[8 : m + 8] * ODD[1] + w[16 : m + 16] * ODD[2]) >> np.uint64(64 - HASH_BITS)
            h = (h << np.uint64(PLACE_BITS)) | np.arange(m, dtype=np.uint64)
            width, span = 1, LENGTH - GRAM + 1
            while 2 * width <= span:
                h = np.minimum(h[:-width], h[width:])
                width *= 2
            if span > width:
                h = np.minimum(h[: b - a], h[span - width : span - width + b - a])
            h = h[: b - a]
            own = np.searchsorted(ends, np.arange(a, b), "right")
            ok = np.arange(a, b) <= last[np.minimum(own, len(ends) - 1)]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            h, own = h[at], own[at]
            new = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]
            lead = np.flatnonzero(new)
            parts.append((at[lead] + a, np.diff(np.r_[lead, len(at)]), h[lead] >> np.uint64(PLACE_BITS), own[lead]))
        join = lambda i, kind: np.concatenate([p[i] for p in parts]).astype(kind) if parts else np.zeros(0, kind)
        self.data, self.first, self.count, self.h, self.doc = data, join(0, np.int64), join(1, np.int64), join(2, np.uint64), join(3, np.int64)

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes by bucket and value, their buckets, each run's place among them, and whether two documents have them."""
        distinct, place = np.unique(self.h, return_inverse=True)
        bucket = distinct % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        to = np.empty(len(order), np.int64)
        to[order] = np.arange(len(order))
        place = to[place] if len(order) else place
        low, high = np.full(len(order), 1 << 40), np.full(len(order), -1)
        np.minimum.at(low, place, self.doc)
        np.maximum.at(high, place, self.doc)
        return distinct[order], bucket[order].astype(np.int64), place, low < high

    def keep(self, on: np.ndarray) -> None:
        self.first, self.count, self.h, self.doc = self.first[on], self.count[on], self.h[on], self.doc[on]


def contexts(data: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bytes that a run's strings cover, as WORDS numbers with zeros past their end."""
    size = count + LENGTH - 1
    out = np.zeros((len(first), WORDS), np.uint64)
    for i in range(WORDS):
        rest = np.clip(size - 8 * i, 0, 8)
        w = words_at(data, np.minimum(first + 8 * i, len(data) - 8))
        cut = ((8 - rest) * 8).astype(np.uint64)
        out[:, i] = np.where(rest > 0, (w >> np.minimum(cut, np.uint64(56))) << np.minimum(cut, np.uint64(56)), 0)
    return out


def first_of_equal(h: np.ndarray, count: np.ndarray, words: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each run the index of the first with the same bytes: smallest document id, then place. Equal hashes are verified."""
    key = h * ODD[0] + count.astype(np.uint64) * ODD[1]
    for i in range(WORDS):
        key = stir(key + words[:, i] * ODD[i])
    order = np.lexsort((place, doc, key))
    lead = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    rep = np.empty(len(order), np.int64)
    rep[order] = np.repeat(order[lead], np.diff(np.r_[lead, len(order)]))
    same = (words == words[rep]).all(1) & (count == count[rep]) & (h == h[rep])
    return np.where(same, rep, np.arange(len(rep)))


def cover_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions by `depth` bytes at least, by doubling within a residue; 0 elsewhere."""
    n = len(text) - 128
    rows = n // PERIOD + 1
    at = np.arange(rows)[None] * PERIOD + np.array(COVER)[:, None]
    rank = np.unique(words_at(text, np.minimum(at, n + 64)) >> np.uint64(8), return_inverse=True)[1].reshape(at.shape).astype(np.int64)
    known = PERIOD
    while known < depth:
        ahead = known // PERIOD
        later = np.zeros_like(rank)
        later[:, : max(0, rows - ahead)] = rank[:, ahead:] + 1
        rank = np.unique(rank * (int(rank.max()) + 2) + later, return_inverse=True)[1].reshape(at.shape).astype(np.int64)
        known *= 2
    out = np.zeros(n + 128, np.int64)
    out[at.reshape(-1)[at.reshape(-1) < n + 128]] = rank.reshape(-1)[at.reshape(-1) < n + 128] + 1
    return out


def sort_bucket(text: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order of the suffixes at the given places, right in their first LENGTH bytes.

    They are sorted by eight bytes. Longer ties are resolved by counting, for each suffix, those of its tie that are
    smaller: two suffixes reach the cover together within their first PERIOD - 1 bytes, and there their ranks decide.
    """
    word = words_at(text, at)
    order = np.argsort(word, kind="stable")
    sorted_word = word[order]
    tie = np.cumsum(np.r_[False, sorted_word[1:] != sorted_word[:-1]])
    alone = np.bincount(tie)[tie] == 1
    less = np.zeros(len(at), np.int64)
    x = np.flatnonzero(~alone)
    place, group = at[order[x]], tie[x]
    residue, top = place % PERIOD, int(rank.max()) + 2
    classes = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    for r in range(PERIOD):
        mine = classes[r]
        for s in range(PERIOD):
            other = classes[s]
            if len(mine) and len(other):
                d = SHIFT[r][s]
                theirs = np.sort(group[other] * top + rank[place[other] + d])
                low = np.searchsorted(theirs, group[mine] * top)
                less[x[mine]] += np.searchsorted(theirs, group[mine] * top + rank[place[mine] + d]) - low
    return order[np.lexsort((less, tie))]


def repeated(text: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the string at each place also is at a place of a smaller document, by suffix buckets of one leading byte."""
    rank = cover_ranks(text, LENGTH)
    out = np.zeros(len(at), bool)
    lead = text[at]
    for byte in np.unique(lead):
        bucket = np.flatnonzero(lead == byte)
        bucket = bucket[sort_bucket(text, at[bucket], rank)]
        place = at[bucket]
        new = np.zeros(len(bucket), bool)
        new[0] = True
        for d in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            w = words_at(text, place + d)
            new[1:] |= w[1:] != w[:-1]
        lead_at = np.flatnonzero(new)
        first = np.minimum.reduceat(doc[bucket], lead_at)
        out[bucket] = np.repeat(first, np.diff(np.r_[lead_at, len(bucket)])) < doc[bucket]
    return out


def blocks_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(block, docs, sizes, data): documents packed into blocks of about BLOCK bytes, compressed, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, press = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in slices(whole, "_text", BLOCK):
                texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_pylist([{"block": number, "raw": sum(map(len, texts)), "docs": batch.column(0).to_numpy().astype(np.int64).tobytes(), "sizes": np.array([len(t) for t in texts], np.int64).tobytes(), "data": press.compress(b"".join(texts))}], schema=pa.schema([("block", pa.int64()), ("raw", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())]))
                number += 1

    rows = docs.select(doc_key(doc_id).alias("_doc"), F.col(text).cast("string").alias("_text"))
    return written(rows.mapInArrow(run, "block long, raw long, docs binary, sizes binary, data binary"), "text-blocks")


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(row["data"])
    return np.frombuffer(raw + bytes(128), np.uint8), np.frombuffer(row["docs"], np.int64), np.frombuffer(row["sizes"], np.int64)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def shared_anchors(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, marks): for each block which of its anchors another document has, a bit each in the order of by_bucket.

    A block sends its distinct hashes only, sorted and as differences, to their buckets."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            data, _, sizes = opened(row)
            h, bucket, _, several = Runs(data, sizes).by_bucket(buckets)
            if not len(h):
                continue
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            out = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)]):
                steps = np.diff(h[a:b] // np.uint64(buckets), prepend=np.uint64(0))
                out.append((int(bucket[a]), row["block"], b - a, steps.astype(np.uint32 if steps.max() < 1 << 32 else np.uint64).tobytes(), np.packbits(several[a:b]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "block", "n", "steps", "several"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.cumsum(np.frombuffer(s, np.uint32 if len(s) == 4 * n else np.uint64).astype(np.uint64)) for s, n in zip(pdf["steps"], pdf["n"])]
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=n) for s, n in zip(pdf["several"], pdf["n"])]).astype(bool)
        _, place, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = count > 1
        shared[place[several]] = True
        ends = np.cumsum(pdf["n"].to_numpy())
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "n": pdf["n"], "bits": [np.packbits(shared[place[e - n : e]]).tobytes() for e, n in zip(ends, pdf["n"])]})

    sent = blocks.select("block", "docs", "sizes", "data").mapInArrow(send, "bucket int, block long, n int, steps binary, several binary")
    marks = sent.groupBy("bucket").applyInPandas(meet, "block long, bucket int, n int, bits binary")
    return written(marks.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "bits"))).alias("marks")), "anchor-marks")


def candidates(row: dict, buckets: int) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
    """A block's runs whose anchor another document has, their ids, context words, and the first run equal to each."""
    data, docs, sizes = opened(row)
    runs = Runs(data, sizes)
    _, _, place, _ = runs.by_bucket(buckets)
    marks = [np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=m["n"]).astype(bool) for m in row["marks"] or ()]
    runs.keep(np.concatenate(marks)[place] if marks else np.zeros(len(runs.h), bool))
    words, doc = contexts(data, runs.first, runs.count), docs[runs.doc] if len(runs.doc) else np.zeros(0, np.int64)
    return runs, doc, words, first_of_equal(runs.h, runs.count, words, doc, runs.first)


def decided(found: DataFrame, buckets: int) -> DataFrame:
    """(block, masks): for each block the positions in its sent runs whose string a smaller document has, as blobs by bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for row in rows_of(batches):
            runs, doc, words, rep = candidates(row, buckets)
            sent = np.flatnonzero(rep == np.arange(len(rep)))
            bucket = (runs.h[sent] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sent, bucket = sent[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            out = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sent)]):
                part = sent[a:b]
                body = words[part].astype(">u8").view(np.uint8).reshape(len(part), -1)
                body = body[np.arange(8 * WORDS) < (runs.count[part] + LENGTH - 1)[:, None]].tobytes()
                out.append((int(bucket[a]), row["block"], b - a, press.compress(part.astype(np.uint32).tobytes()), doc[part].tobytes(), runs.count[part].astype(np.uint8).tobytes(), runs.h[part].tobytes(), press.compress(body)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5))], names=["bucket", "block", "n", "run", "doc", "count", "h", "body"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        n = pdf["n"].to_numpy()
        doc, count, h = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in (("doc", np.int64), ("count", np.uint8), ("h", np.uint64)))
        count = count.astype(np.int64)
        text = np.frombuffer(b"".join(map(unpack, pdf["body"])) + bytes(128), np.uint8)
        first = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
        words = contexts(text, first, count)
        rep = first_of_equal(h, count, words, doc, np.arange(len(doc)))
        own = np.flatnonzero(rep == np.arange(len(rep)))
        del words
        _, place, many = np.unique(h[own], return_inverse=True, return_counts=True)
        own = own[many[place] > 1]  # anchors in one context alone are settled by the smallest document
        mask = np.zeros(len(doc), np.int64)
        if len(own):
            size = count[own] + LENGTH - 1
            ends = np.cumsum(size)
            piece = np.frombuffer(text[np.repeat(first[own] - (ends - size), size) + np.arange(int(ends[-1]))].tobytes() + bytes(128), np.uint8)
            run = np.repeat(np.arange(len(own)), count[own])
            step = np.arange(len(run)) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
            hit = repeated(piece, (ends - size)[run] + step, doc[own][run])
            np.add.at(mask, own[run[hit]], np.int64(1) << step[hit])
        mask = np.where(doc > doc[rep], (np.int64(1) << count) - 1, mask[rep])
        ends = np.cumsum(n)
        return pd.DataFrame({"block": pdf["block"], "run": pdf["run"], "mask": [mask[e - k : e].astype(np.uint32).tobytes() for e, k in zip(ends, n)]})

    sent = found.mapInArrow(send, "bucket int, block long, n int, run binary, doc binary, count binary, h binary, body binary")
    masks = sent.groupBy("bucket").applyInPandas(meet, "block long, run binary, mask binary")
    return masks.groupBy("block").agg(F.collect_list(F.struct("run", "mask")).alias("masks"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """Removes each byte inside a 50-byte string that also starts in a document with a smaller id, judged on the input.

    1. Documents are packed into compressed blocks. 2. A string's anchor is its gram with the smallest hash; blocks send
    their distinct anchors to hash buckets, which answer which of them two documents share. 3. Runs of strings with a
    shared anchor go to the anchor's bucket, equal runs of a block once, with the bytes they cover; all equal strings
    meet there. 4. A bucket (bounded by the number of buckets) settles equal runs by their smallest document and sorts
    the suffixes of the others one leading byte at a time: by eight bytes, then by ranks of the difference-cover sample,
    which are made first; neighbours that share 50 bytes form a group. 5. The answers go back to the blocks.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, with keep, kept (the remaining bytes; they need not be
    UTF-8). Null texts are empty. A null id counts as the smallest; rows with one id are no smaller than one another, so
    none removes the other's bytes. An empty table gives no rows; other columns are ignored.
    """
    blocks = blocks_of(docs, doc_id, text)
    raw = blocks.agg(F.sum("raw")).first()[0] or 0
    buckets = max(64, -(-2 * raw // (LENGTH - GRAM + 2) // BUCKET))
    found = blocks.join(shared_anchors(blocks, buckets), "block", "left")
    masks = written(decided(found.select("block", "docs", "sizes", "data", "marks"), buckets), "removal-masks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            runs, doc, _, rep = candidates(row, buckets)
            mask = np.zeros(len(rep), np.int64)
            for m in row["masks"] or ():
                mask[np.frombuffer(zstandard.ZstdDecompressor().decompress(m["run"]), np.uint32)] = np.frombuffer(m["mask"], np.uint32)
            mask = np.where(doc > doc[rep], (np.int64(1) << runs.count) - 1, mask[rep])
            data, docs_, sizes = opened(row)
            n = len(data) - 128
            edge = np.zeros(n + LENGTH + 1, np.int32)
            for j in range(LENGTH - GRAM + 1):
                at = runs.first[(mask >> j) & 1 == 1] + j
                edge[at] += 1
                edge[at + LENGTH] -= 1
            gone = np.cumsum(edge[:n]) > 0
            ends = np.cumsum(sizes)
            starts = ends - sizes
            total = np.r_[0, np.cumsum(gone)]
            lead = gone & ~np.r_[False, gone[:-1]]
            lead[starts[(sizes > 0)]] = gone[starts[(sizes > 0)]]
            leads = np.r_[0, np.cumsum(lead)]
            left = data[:n][~gone].tobytes()
            kept_ends = ends - total[ends]
            kept_starts = starts - total[starts]
            kept = [left[a:b] for a, b in zip(kept_starts.tolist(), kept_ends.tolist())]
            columns = [pa.array(docs_), pa.array(sizes), pa.array(total[ends] - total[starts], pa.int64()), pa.array(leads[ends] - leads[starts], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if keep else [])], names=["_doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep])

    rows = found.join(masks, "block", "left").select("block", "docs", "sizes", "data", "marks", "masks")
    out = rows.mapInArrow(cut, "_doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)
    return out.select(key_back("_doc").alias("doc_id"), *out.columns[1:])
