"""WARC archives compressed record by record with a Zstandard dictionary of their own."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, doc_key, written

#: Fixed values of the formats: a skippable frame that holds the dictionary, as .warc.zst files lead with, and a date.
SKIPPABLE = 0x184D2A5D
DATE = "2020-01-01T00:00:00Z"
#: Characters that stay in a percent-encoded address, and the extension field with an address that isn't printable ASCII.
PRINTABLE, ORIGINAL = "".join(map(chr, range(33, 127))), "X-Original-URI"


def revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """(key, digest, refers_to) of the pages whose payload a page with a smaller key has; payloads under `least` bytes don't count.

    The digests are written once; the join of pages with the first page of their digest then reads two plain tables, so
    Spark can split a digest that a large part of all pages share.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    seen = written(pages.select(doc_key(key).alias("_key"), F.sha1(body).alias("_sha1"), F.octet_length(body).alias("_n")).filter(F.col("_n") >= least), "warc-digests")
    first = written(seen.groupBy("_sha1").agg(F.min("_key").alias("refers_to"), F.max("_key").alias("_last")).filter("refers_to < _last").drop("_last"), "warc-firsts")
    return seen.join(first, "_sha1").filter("_key > refers_to").select("_key", "_sha1", "refers_to").dropDuplicates(["_key", "_sha1"])


def spread(text: Column, longest: int, pieces: int = 16) -> Column:
    """A text of up to `longest` characters as it is; of a longer one, so many in pieces from its first character to its last."""
    size, n = longest // pieces, F.char_length(text)
    starts = [F.floor((n - size) * i / (pieces - 1)).cast("int") + 1 for i in range(pieces)]
    return F.when(n <= longest, text).otherwise(F.concat(*[F.substring(text, at, F.lit(size)) for at in starts]))


def dictionary(pages: DataFrame, payload: str = "html", key: str = "page_id", samples: int = 400, longest: int = 16384, size: int = 32768) -> bytes:
    """A Zstandard dictionary from a bounded sample of the records that are archived: at most `samples` payloads, those
    with the smallest key hash, of each at most `longest` characters, in pieces spread over all of it. Records are whole;
    how small they get alone depends on it. Too few payloads: no bytes, and records have no dictionary."""
    ids = pages.select(key, F.xxhash64(key, F.length(payload)).alias("_o")).orderBy("_o", key).limit(samples).select(key)
    rows = pages.join(F.broadcast(ids.distinct()), key, "left_semi").select(spread(F.coalesce(F.col(payload), F.lit("")), longest).alias("p")).limit(samples).collect()
    texts = sorted(record(0, "http://example.org/", r.p.encode(), None, "") for r in rows)
    if len(texts) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def target(url: str | None) -> list[str]:
    """Header lines of a page's address: as it is if it is of printable ASCII; else percent-encoded, and as it was in base64.
    A null address has none."""
    if url is None:
        return []
    if re.fullmatch("[!-~]+", url):
        return [f"WARC-Target-URI: {url}"]
    return [f"WARC-Target-URI: {quote(url, safe=PRINTABLE)}", f"{ORIGINAL}: {base64.b64encode(url.encode()).decode()}"]


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head alone."""
    name = lambda x: "null" if x is None or x == NULL_ID else x
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name(page_id)}>", *target(url), f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{name(refers_to)}>"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def address(fields: dict[str, str]) -> str | None:
    """The page's address as it was, by the lines of target."""
    return base64.b64decode(fields[ORIGINAL]).decode() if ORIGINAL in fields else fields.get("WARC-Target-URI")


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, each record decompressed on its own."""
    words, at = b"", 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        n = struct.unpack_from("<I", data, 4)[0]
        words, at = data[8 : 8 + n], 8 + n
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    view = memoryview(data)
    while at < len(data):
        one = reader.decompressobj()
        raw, step = b"", 1 << 16
        while not one.eof:  # small steps, so that what follows the frame isn't copied again and again
            part = view[at : at + step]
            if not part:
                raise ValueError("the archive ends within a record")
            raw += one.decompress(part)
            at += len(part) - len(one.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, archive_bytes: int = 1 << 20) -> DataFrame:
    """A table (archive, records, data): each row one archive of about archive_bytes, valid on its own.

    archive is a name of its own: the task, its archives so far, and the first key. data is the skippable frame with the
    dictionary, then one Zstandard frame a record. Of equal payloads the page with
    the smallest key is a response and the others revisits. Pages with a null payload have an empty one, with a null
    url no address; a null key comes before all others; repeated rows of one page are archived each, all alike.
    An empty table gives no archive.
    """
    words = dictionary(pages, payload, key)
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(doc_key(key).alias("_key"), F.col(url).cast("string").alias("_url"), body.alias("_html"), F.sha1(body).alias("_sha1"))
    rows = rows.join(revisits(pages, key, payload, least), ["_key", "_sha1"], "left").select("_key", "_url", "_html", "refers_to")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        lead = struct.pack("<II", SKIPPABLE, len(words)) + words if words else b""
        out, size, first, done, part = [], 0, None, 0, TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"archive": f"pages-{part:05d}-{done:05d}-{first}", "records": len(out), "data": lead + b"".join(out)}], schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            for k, u, h, r in zip(*(c for c in batch.columns)):
                text = (h.as_py() or "").encode()
                k = k.as_py()
                frame = press.compress(record(k, u.as_py(), text, r.as_py(), digest32(text)))
                first = k if first is None else first
                out.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    yield close()
                    out, size, first, done = [], 0, None, done + 1
        if out:
            yield close()

    return written(rows.mapInArrow(pack, "archive string, records long, data binary"), "warc-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri) of every record, from the stored bytes.

    A response's digest is computed again from its payload, and a difference raises; a revisit has its digest and its
    payload's length from its own headers.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident = lambda x: None if x is None or x.endswith(":null>") else int(x.rsplit(":", 1)[1][:-1])
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())])
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for fields, block in read_archive(data.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if kind == "response" and (len(payload) != n or digest32(payload) != digest):
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
                    rows.append((ident(fields["WARC-Record-ID"]), n, digest, kind, ident(fields.get("WARC-Refers-To")), address(fields)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return archives.select("data").mapInArrow(unpack, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")
