"""Interleaved document sequences: ordered text and media references from HTML, media by digest."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Samples in a row of a stored image, and copies over which references to one digest are dealt.
WIDTH, SALTS = 192, 64
PNG = b"\x89PNG\r\n\x1a\n"
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string,source:string>>"
NAMED = "ni:///sha-256;"
#: What is read back of a stored image.
FACTS = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey PNG image with 8 bits a sample whose rows are the payload, width samples each."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of an image by encode_png; a damaged chunk raises."""
    if data[:8] != PNG:
        raise ValueError("not a PNG image")
    at, width, parts = 8, 0, []
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, standard deviation and entropy of the samples, and the mean step from sample to sample."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    values = np.arange(256)
    mean = float((counts * values).sum()) / len(x)
    std = max(0.0, float((counts * values * values).sum()) / len(x) - mean * mean) ** 0.5
    step = float(np.abs(np.diff(x.astype(np.int16))).mean()) if len(x) > 1 else 0.0
    return f"mean={mean:.4f};std={std:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={step:.4f}"


class _Reader(HTMLParser):
    """Text blocks and media references of a page in order; a figure's caption belongs to the media of that figure.

    Figures nest: each has its own media and caption, given to its media when it closes, so the caption may stand before or
    after them. A caption that isn't closed ends with its figure, and a figure that isn't closed with the page. The caption of
    a figure without media is text. Outside of figures a figcaption is a block like others."""

    BLOCKS = frozenset("p div article section nav header footer title figure figcaption h1 h2 h3 h4 h5 h6 li ul ol table tr td th blockquote br hr body".split())
    HIDDEN = frozenset(("script", "style", "template"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.figures: list[dict] = []
        self.hidden = 0

    def into(self) -> list[str] | None:
        """Where words of an open caption go; None where the innermost figure has none open."""
        return self.figures[-1]["said"] if self.figures and self.figures[-1]["open"] else None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.add("text", text=text)

    def add(self, kind: str, **more: str | None) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": None, "digest": None, "caption": None, "source": None} | more)

    def close_figure(self) -> None:
        figure = self.figures.pop()
        said = " ".join("".join(figure["said"]).split())
        for i in figure["media"]:
            self.items[i]["caption"] = said or self.items[i]["caption"]
        if said and not figure["media"]:
            self.add("text", text=said)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in ("img", "audio", "video", "source"):
            at = dict(attrs)
            if source := at.get("src"):
                self.flush()
                if self.figures:
                    self.figures[-1]["media"].append(len(self.items))
                self.add("media", source=source, digest=digest_of(source), caption=at.get("alt") or None)
        elif tag in self.BLOCKS:
            if (said := self.into()) is not None:
                said.append(" ")
            else:
                self.flush()
            if tag == "figure":
                self.figures.append({"media": [], "said": [], "open": False})
            elif tag == "figcaption" and self.figures:
                self.figures[-1]["open"] = True

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS:
            if (said := self.into()) is not None:
                said.append(" ")
            else:
                self.flush()
            if tag == "figcaption" and self.figures:
                self.figures[-1]["open"] = False
            elif tag == "figure" and self.figures:
                self.close_figure()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            said = self.into()
            (self.text if said is None else said).append(data)

    def finish(self) -> list[dict]:
        if re.match("</?[a-zA-Z]", self.rawdata):  # a tag that the page ends in
            self.rawdata = ""
        self.close()
        self.flush()
        while self.figures:
            self.close_figure()
        return self.items


def digest_of(source: str) -> str | None:
    """The hex digest that a source names in the form ni:///sha-256;<base64url> (RFC 6920), or null."""
    if not source.startswith(NAMED):
        return None
    try:
        return base64.urlsafe_b64decode(source[len(NAMED) :] + "=").hex()
    except ValueError:
        return None


def named(digest: Column) -> Column:
    """The source of a hex SHA-256 digest, as digest_of reads it."""
    return F.concat(F.lit(NAMED), F.rtrim(F.translate(F.base64(F.unhex(digest)), "+/=", "-_ ")))


def parse_items(html: str) -> list[dict]:
    reader = _Reader()
    reader.feed(html)
    return reader.finish()


SEQUENCE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("source", pa.string())]))


def interleave(pages: DataFrame, key: str, html: str, texts: bool = True) -> DataFrame:
    """(key, items): each page's text blocks and media references in order, with positions from 0 and captions.

    Without `texts` the items lack their text, where only the references are wanted. Null and empty pages have no items; null
    and repeated keys stay as they are; broken mark-up gives what a browser's tokenizer finds in it; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_html", 4 << 20):
                pages = [parse_items(h or "") for h in batch.column(1).to_pylist()]
                if not texts:
                    pages = [[i | {"text": None} for i in items] for items in pages]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, SEQUENCE)], names=[key, "items"])

    rows = pages.select(F.col(key), F.col(html).cast("string").alias("_html"))
    return small_batches(rows).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, items {ITEMS}")


def text_blocks(items: str) -> list[Column]:
    """n_items, n_chars and text_sha256 of a sequence: its items, the characters of its text blocks, and the hash of those
    joined by line feeds."""
    said = F.transform(F.filter(items, lambda x: x["kind"] == "text"), lambda x: x["text"])
    chars = F.aggregate(said, F.lit(0).cast("long"), lambda n, t: n + F.char_length(t))
    return [F.size(items).alias("n_items"), chars.alias("n_chars"), F.sha2(F.concat_ws("\n", said), 256).alias("text_sha256")]


def media_store(payloads: DataFrame, digest: str, payload: str, near: str | None = None) -> DataFrame:
    """(digest, salt, media, media_bytes): each digest's payload once a salt, stored as an image.

    Equal payloads are merged before the shuffle. A payload that many rows share is kept once for each salt of `near`
    (a column that the references are salted by too), so no task gets all references to it."""
    salt = F.pmod(F.xxhash64(near), F.lit(SALTS)).cast("int") if near else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_payload", 4 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([encode_png(x.as_py()) for x in batch.column(2)], pa.binary())], names=["digest", "salt", "media"])

    rows = payloads.select(F.col(digest).alias("digest"), salt.alias("salt"), F.col(payload).alias("_payload"))
    return small_batches(rows).mapInArrow(run, "digest string, salt int, media binary").groupBy("digest", "salt").agg(F.first("media").alias("media"))


def media_references(sequences: DataFrame, key: str, near: str | None = None) -> DataFrame:
    """(key, position, digest, salt): the media references of interleaved pages that name a digest; near: as in media_store."""
    salt = F.pmod(F.xxhash64(near), F.lit(SALTS)).cast("int") if near else F.lit(0)
    rows = sequences.select(key, salt.alias("salt"), F.explode(F.filter("items", lambda x: x["digest"].isNotNull())).alias("_m"))
    return rows.select(key, "_m.position", "_m.digest", "salt")


def resolve(references: DataFrame, store: DataFrame) -> DataFrame:
    """References with their media by digest; one whose digest the store lacks has null media."""
    return references.join(store, ["digest", "salt"], "left").drop("salt")


def assemble(resolved: DataFrame, sequences: DataFrame, key: str) -> DataFrame:
    """(key, items, ...): interleaved sequences with what was resolved in place, positions and captions as they were.

    resolved has key, position and further columns, which become the struct `media` of the item at that position; null
    where nothing was resolved. Each key must be of one sequence (number rows before if ids repeat); of two resolved rows
    for one place, one counts."""
    columns = [c for c in resolved.columns if c not in (key, "position", "digest")]
    one = resolved.groupBy(key, "position").agg(F.first(F.struct(*columns)).alias("_m"))
    media = one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("position", "_m"))).alias("_media"))
    fields = ("position", "kind", "text", "digest", "caption", "source")
    items = F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in fields], F.try_element_at("_media", x["position"]).alias("media")))
    return sequences.join(media, key, "left").select(key, items.alias("items"), *[c for c in sequences.columns if c not in (key, "items")])


def padded(text: Column, unit: int = WIDTH) -> Column:
    """UTF-8 of a text with spaces up to a positive multiple of unit."""
    body = F.coalesce(text, F.lit(""))
    n = F.octet_length(body)
    return F.encode(F.concat(body, F.repeat(F.lit(" "), F.greatest(F.lit(1), F.ceil(n / unit)).cast("int") * unit - n)), "UTF-8")


def document_page(body: Column, digest: Column) -> Column:
    """A text as a page: a paragraph a line, and after the first one a figure with the media of the digest, which the first
    line captions."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first = F.substring_index(body, "\n", 1)
    rest = F.replace(safe(F.substring(body, F.char_length(first) + 2, F.char_length(body))), F.lit("\n"), F.lit("</p><p>"))
    figure = F.concat(F.lit('<figure><figcaption>'), safe(first), F.lit('</figcaption><img src="'), named(digest), F.lit('"></figure>'))
    return F.concat(F.lit("<article><p>"), safe(first), F.lit("</p>"), figure, F.lit("<p>"), rest, F.lit("</p></article>"))


def document_sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as pages of all their lines with a figure each, whose media is the whole text: parsed to sequences, resolved
    by digest, read back, and put in place again.

    Returns (doc_id, n_bytes, items): all text blocks with their text and the media items in order, each media item with what
    was read back of it: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; null in an item that
    names another digest than its document's. Texts move once, to the tasks of their digest and salt: there the images are made, once
    for equal texts and a salt, and read back, and what was read meets the texts by digest where they lie; pages are parsed after
    that, so neither images nor sequences are shuffled. Null and repeated ids keep a row for each row. A null text is empty,
    and an empty one is 192 spaces; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    about = F.struct(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"))
    digest = F.coalesce(F.sha2(padded(body), 256), F.lit(""))  # never null, so that both sides below read the same rows
    rows = docs.select(digest.alias("digest"), F.pmod(F.xxhash64(about), F.lit(SALTS)).cast("int").alias("salt"), F.struct(about.alias("about"), body.alias("body")).alias("r"))
    rows = small_batches(rows).repartition("digest", "salt")  # whole structs on both sides, so that one shuffle serves both

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "payload", 4 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([encode_png(x.as_py()) for x in batch.column(2)], pa.binary())], names=["digest", "salt", "media"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media", 4 << 20):
                out = ([], [], [], [], [], [])
                for digest, media in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    payload = decode_png(media)
                    if (own := hashlib.sha256(payload).hexdigest()) != digest:
                        raise ValueError("stored media differs from its digest")
                    for c, v in zip(out, (len(payload), own, zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload))):
                        c.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, kinds))], names=["digest", "salt", *FACTS])

    once = rows.groupBy("digest", "salt").agg(F.first("r").alias("r")).select("digest", "salt", padded(F.col("r.body")).alias("payload"))
    stored = once.mapInArrow(store, "digest string, salt int, media binary")
    facts = stored.mapInArrow(read, "digest string, salt int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    found = rows.join(facts.select("digest", "salt", F.struct(*FACTS).alias("facts")), ["digest", "salt"], "left")
    pages = found.select(F.struct("r.about", "digest", "facts").alias("row"), document_page(F.col("r.body"), F.col("digest")).alias("html"))
    fields = ("position", "kind", "text", "digest", "caption", "source")
    items = F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in fields], F.when(x["digest"] == F.col("row.digest"), F.col("row.facts")).alias("media")))
    return interleave(pages, "row", "html").select("row.about.doc_id", "row.about.n_bytes", items.alias("items"))


def document_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, caption,
    n_items, n_chars, text_sha256) of document_sequences: what the assembled sequences say of the media item, its place and
    caption, and of the text blocks in them."""
    shown = F.get(F.filter("items", lambda x: x["kind"] == "media"), F.lit(0)).alias("m")
    return document_sequences(docs, doc_id, text).select("doc_id", "n_bytes", shown, *text_blocks("items")).select("doc_id", "n_bytes", "m.media.*", "m.position", "m.caption", "n_items", "n_chars", "text_sha256")
