"""Packing of tokenized documents into sequences of bounded length by best-two-fit."""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, hand_back, key_back, slices, written

#: Words and pieces of words whose ids a Python worker remembers; as many that were met before those stay until they fill up too.
REMEMBERED = 250_000
#: Fixed values of the vocabulary's form: how it splits lower-case text, and the character that stands for each byte.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
SHOWN = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
BYTES = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}
#: Words of these characters are in normal form C and have no white space, and each character has one lower-case form.
PLAIN = regex.compile("[!-~\u00a1-\u012f]+")


def best_two_fit(lengths: np.ndarray, room: int) -> np.ndarray:
    """A bin number for each length (1 to room), so that no bin's sum is over room.

    A bin is filled greedily, the longest length that fits first. Then its shortest piece is replaced, if the bin has
    more than one and two unpacked pieces sum to more than it without passing the gap it would leave, by the pair with
    the largest sum. Only the number of pieces of each length counts, so a bin costs a few steps over arrays of `room`.
    """
    count = np.bincount(lengths, minlength=room + 1)
    order = np.argsort(lengths, kind="stable")
    next_of = np.concatenate([[0], np.cumsum(count)[:-1]])
    bins = np.empty(len(lengths), np.int64)
    left, number = len(lengths), 0
    below = np.maximum.accumulate(np.where(count > 0, np.arange(room + 1), 0))  # the longest length left up to each

    def take(n: int) -> tuple[int, int]:
        count[n] -= 1
        if not count[n]:
            below[n : below.searchsorted(n, "right")] = below[n - 1]
        return n, int(next_of[n] + count[n])

    def put_back(n: int) -> None:
        count[n] += 1
        if count[n] == 1:
            below[n : max(n, below.searchsorted(n, "left"))] = n

    while left:
        free, held = room, []
        while free and (n := int(below[free])):
            held.append(take(n))
            free -= n
        if free and len(held) > 1:
            small = held[-1][0]
            gap = free + small
            a = np.arange(1, gap // 2 + 1)
            a = a[count[a] > 0]
            if len(a):
                b = below[gap - a]
                b = np.where((b == a) & (count[a] < 2), below[a - 1], b)
                total = np.where(b > 0, a + b, 0)
                best = int(total.argmax())
                if total[best] > small:
                    held.pop()
                    put_back(small)
                    held += [take(int(a[best])), take(int(b[best]))]
        for _, i in held:
            bins[order[i]] = number
        left -= len(held)
        number += 1
    return bins


class Words(dict):
    """Ids of words, each found out when it is first asked for.

    Words of plain characters are lower-cased and split here, and the tokenizer's model gives each piece's ids once; all
    others, and those that may hold a special token, go through the whole tokenizer. A piece is remembered as the word that it is
    by itself. When the memory is full, it becomes the older half and starts again; a word that is found in the older half moves to the
    new one. So what is met often stays, and memory is bounded whatever a batch holds."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        assert sys.byteorder == "little" and array("I").itemsize == 4
        self.tokenizer, self.older = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model

    def ids_of(self, word: bytes) -> bytes:
        s = word.decode()
        low = s.lower()
        if not (word.isascii() and low.isalpha()) and ("<|" in s or not PLAIN.fullmatch(s)):
            return array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()
        if low.isalpha():
            pieces = [low]
        elif low[:-1].isalpha() and low[-1] in ".,":
            pieces = [low[:-1], low[-1]]
        else:
            pieces = PIECE.findall(low)
        if pieces == [s]:
            shown = s if s.isascii() else "".join(BYTES[b] for b in word)
            return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return b"".join([self[p.encode()] for p in pieces])

    def __missing__(self, word: bytes) -> bytes:
        if (ids := self.older.get(word)) is None:
            ids = self.ids_of(word)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.older = {}


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def token_ids(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers.

    The vocabulary drops white space and never joins across it, so ids of a text are those of its words one after the
    other, and a worker remembers the words it has met."""
    known = words_of(path)
    return [b"".join(map(known.__getitem__, t.split())) for t in texts]


def token_pieces(docs: DataFrame, path: str, room: int, doc_id: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, copy): documents as ids and the end id, cut where they pass room.

    A task's words are forgotten when it ends: its worker goes on to other work, and would hold them through all of it."""
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                out = ([], [], [], [], [], [])
                for i, (doc, copy, ids) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), token_ids([(t or "").encode() for t in batch.column(2).to_pylist()], path))):
                    ids += last
                    for piece, at in enumerate(range(0, len(ids), 4 * room)):
                        part = ids[at : at + 4 * room]
                        for c, v in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), copy)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32", "copy"])
        words_of(path).forget()
        hand_back()

    rows = docs.select(doc_key(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, copy long")


def pack(docs: DataFrame, path: str, room: int = 2048, doc_id: str = "doc_id", text: str = "text", group: int = 6144) -> DataFrame:
    """Packs documents into sequences of at most room tokens.

    A document is its ids and then id 0; only documents over room are cut, into pieces of room and a last one. Pieces
    are dealt out evenly into groups of about `group` by a hash, each packed by best-two-fit in a task of its own, so a
    task's size doesn't grow with the table; a group is large enough that the last bins left open count for little.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset). A null or empty text is the end id alone;
    rows with a null or repeated id are packed each; an empty table gives no rows; other columns are ignored.
    """
    pieces = written(token_pieces(docs, path, room, doc_id, text), "token-pieces")
    groups = max(1, round(pieces.count() / group))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32", "copy"], kind="stable", ignore_index=True)
        number = best_two_fit(pdf["length"].to_numpy(), room)
        pdf["sequence_id"] = pdf["group"].to_numpy().astype(np.int64) * (1 << 32) + number
        pdf = pdf.sort_values(["sequence_id", "length"], ascending=[True, False], kind="stable", ignore_index=True)
        ends = pdf["length"].cumsum()
        before = ends - pdf["length"]
        pdf["offset"] = before - before.groupby(pdf["sequence_id"]).transform("min")
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(groups)).cast("int"))
    out = dealt.groupBy("group").applyInPandas(one, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumn("doc_id", key_back("doc_id"))
