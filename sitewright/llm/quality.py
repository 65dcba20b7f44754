"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, key_back, slices, small_batches

#: Bytes of a filter, of a step, of a segment; segments of a chunk and from one chunk to the next (so that chunks overlap).
WIDTH, STEP, SEGMENT, CHUNK, HOP = 8, 2, 64, 4, 3
#: Numbers of a byte's embedding, and filters.
EMBED, FILTERS = 8, 24
#: Bytes over which the filters run at once.
BLOCK = 128 * SEGMENT * 16


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weight: np.ndarray  # (2 * FILTERS,): for the mean and the maximum over chunks
    offset: np.ndarray  # (1,)

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.weight, self.offset]


def convolve(net: Network, data: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each segment's largest filter values, (segments, FILTERS), of bytes that are whole segments; with `where` also the
    step of each, the first of equal ones."""
    n = len(data) // SEGMENT
    out, at = np.empty((n, FILTERS), net.filters.dtype), np.empty((n, FILTERS), np.uint8) if where else None
    data = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    for a in range(0, n * SEGMENT, BLOCK):
        b = min(a + BLOCK, n * SEGMENT)
        x = net.embed[data[a : b + WIDTH - STEP]].reshape(-1)
        windows = np.lib.stride_tricks.as_strided(x, ((b - a) // STEP, WIDTH * EMBED), (x.itemsize * EMBED * STEP, x.itemsize))
        y = np.ascontiguousarray(windows).reshape(-1, SEGMENT // STEP, WIDTH * EMBED) @ net.filters  # a small product a segment: no threads that wait for the next
        if where:
            at[a // SEGMENT : b // SEGMENT] = y.argmax(1)
        out[a // SEGMENT : b // SEGMENT] = y.max(1)
    return out, at


@dataclass
class Layout:
    """Texts end to end in whole segments, a segment of zeros after each; the segments of each chunk; chunks by text."""

    data: np.ndarray
    chunks: np.ndarray  # (chunks, CHUNK): segments; the last one of a text again where it ends within a chunk
    first: np.ndarray  # each text's first chunk
    count: np.ndarray  # and how many it has
    own: np.ndarray  # each chunk's text


def layout(texts: list[bytes]) -> Layout:
    """The chunks cover a text whole: four segments each, one shared with the next; an empty text is one segment of zeros."""
    size = np.array([len(t) for t in texts], np.int64)
    segments = np.maximum(1, -(-size // SEGMENT))
    ends = np.cumsum(segments + 1)
    starts = ends - segments - 1
    data = np.zeros(int(ends[-1]) * SEGMENT, np.uint8)
    for t, at in zip(texts, starts.tolist()):
        data[at * SEGMENT : at * SEGMENT + len(t)] = np.frombuffer(t, np.uint8)
    n = np.maximum(1, -(-(segments - 1) // HOP))
    first = np.cumsum(n) - n
    own = np.repeat(np.arange(len(texts)), n)
    lead = starts[own] + (np.arange(int(n.sum())) - first[own]) * HOP
    return Layout(data, np.minimum(lead[:, None] + np.arange(CHUNK), (starts + segments - 1)[own][:, None]), first, n, own)


def pool(net: Network, on: Layout, pooled: np.ndarray) -> np.ndarray:
    """A text's features: the mean and the maximum of its chunks."""
    return np.concatenate([np.add.reduceat(pooled, on.first) / on.count[:, None], np.maximum.reduceat(pooled, on.first)], axis=1)


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """A probability for each text, of all its chunks. Filters step by two bytes, so a shift by one changes a score a little."""
    on = layout(texts)
    best, _ = convolve(net, on.data)
    pooled = best[on.chunks[:, 0]]
    for i in range(1, CHUNK):
        np.maximum(pooled, best[on.chunks[:, i]], out=pooled)
    features = pool(net, on, np.maximum(pooled + net.bias, 0))
    z = (features * net.weight).sum(1, dtype=np.float64) + float(net.offset[0])
    return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 5)


def gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean log loss and its gradients by net.arrays(), over all chunks of the texts, pooled as in scoring.

    A maximum passes its gradient to the first of the places that reach it."""
    on = layout(texts)
    best, step = convolve(net, on.data, True)
    values = best[on.chunks]  # (chunks, CHUNK, FILTERS)
    top = values.argmax(1)
    raw = np.take_along_axis(values, top[:, None], 1)[:, 0] + net.bias
    pooled = np.maximum(raw, 0)
    features = pool(net, on, pooled)
    z = features @ net.weight + net.offset[0]
    loss = float(np.mean(np.logaddexp(0, z) - labels * z))
    g = (1 / (1 + np.exp(-z)) - labels) / len(texts)
    back = g[:, None] * net.weight
    most = features[:, FILTERS:]
    hit = np.flatnonzero((pooled == most[on.own]).reshape(-1))
    lead = np.unique(on.own[hit // FILTERS] * FILTERS + hit % FILTERS, return_index=True)[1]  # the first chunk of each text and filter
    d_raw = (back[:, :FILTERS] / on.count[:, None])[on.own]
    text, own = on.own[hit[lead] // FILTERS], hit[lead] % FILTERS
    d_raw[hit[lead] // FILTERS, own] += back[text, FILTERS + own]
    d_raw *= raw > 0
    place = np.take_along_axis(on.chunks, top, 1)  # the segment of each chunk's maximum, (chunks, FILTERS)
    d_best = np.bincount((place * FILTERS + np.arange(FILTERS)).reshape(-1), d_raw.reshape(-1), best.size)
    on_ = np.flatnonzero(d_best)
    filt, seg = on_ % FILTERS, on_ // FILTERS
    order = np.argsort(filt, kind="stable")
    filt, seg, d = filt[order], seg[order], d_best[on_[order]]
    bytes_ = np.concatenate([on.data, np.zeros(WIDTH, np.uint8)])[(seg * SEGMENT + step[seg, filt].astype(np.int64) * STEP)[:, None] + np.arange(WIDTH)]
    x = net.embed[bytes_].reshape(len(filt), WIDTH * EMBED)
    cuts = np.searchsorted(filt, np.arange(FILTERS + 1))
    d_filters = np.stack([np.einsum("i,ij->j", d[a:b], x[a:b]) for a, b in zip(cuts, cuts[1:])], axis=1)
    d_x = (d[:, None] * net.filters.T[filt]).reshape(-1, EMBED)
    d_embed = np.stack([np.bincount(bytes_.reshape(-1), d_x[:, j], 256) for j in range(EMBED)], axis=1)
    return loss, [d_embed, d_filters, d_raw.sum(0), features.T @ g, np.array([g.sum()])]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Fits all parameters by Adam on the log loss of whole texts."""
    rng = np.random.default_rng(seed)
    f = np.float32
    net = Network(rng.normal(0, 0.5, (256, EMBED)).astype(f), rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)).astype(f), np.zeros(FILTERS, f), rng.normal(0, 0.1, 2 * FILTERS).astype(f), np.array([np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))], f))
    moments, step = [[np.zeros_like(p), np.zeros_like(p)] for p in net.arrays()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            _, grads = gradients(net, [texts[i] for i in docs], labels[docs])
            step += 1
            lr = rate * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, d, (m, v) in zip(net.arrays(), grads, moments):
                d = d.astype(f)
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= (lr * m / (np.sqrt(v) + 1e-7)).astype(f)
    return net


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = 2500, most_bytes: int = 48 << 20) -> Network | None:
    """A network from labelled rows outside the held-out fold, whole texts: those of the `most` ids with the smallest hash,
    in that order, as long as all together have at most `most_bytes`; a text that doesn't fit any more is left out, never
    cut. No usable label: None.

    Rows of one id that disagree count by their mean, rounded, and the text with the smallest hash; null labels and ids
    don't count."""
    ids = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(most)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_id"), body.alias("_body")).join(F.broadcast(ids), "_id")
    sizes = rows.groupBy("_id").agg(F.min(F.struct(F.xxhash64("_body").alias("h"), F.octet_length("_body").alias("n"))).alias("t")).select("_id", "t.h", "t.n", F.xxhash64("_id").alias("k")).collect()
    chosen, room = [], most_bytes
    for r in sorted(sizes, key=lambda r: (r.k, r._id)):
        if r.n <= room:
            chosen.append((r._id, r.h))
            room -= r.n
    if not chosen:
        return None
    wanted = docs.sparkSession.createDataFrame(chosen, f"_id {dict(rows.dtypes)['_id']}, _h long")
    found = rows.withColumn("_h", F.xxhash64("_body")).join(F.broadcast(wanted), ["_id", "_h"]).groupBy("_id").agg(F.first("_y").alias("_y"), F.min("_body").alias("_body")).collect()
    found.sort(key=lambda r: r._id)
    return train([r._body.encode() for r in found], np.array([r._y for r in found], np.float32))


def held_out(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_quality(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text", bar: float = 0.3, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted, *also) of every row; the text's bytes are the only input of the score.

    A null text counts as empty; an empty one is a chunk of zeros. Null and repeated ids get a row for each row; without
    a network (no labels) the score is 0.5. held_out: crc32 of the id as text is a multiple of 5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", 2 << 20):
                texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
                score = score_texts(net, texts) if net else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*batch.columns[1 - keep :], pa.array(score)], names=[*batch.schema.names[1 - keep :], "score"])

    keep = int(text in also)  # the text goes through once, whether it is asked for or not
    more = [c for c in also if c != text]
    rows = docs.select(F.col(text).cast("string").alias("_text"), doc_key(doc_id).alias("_doc"), held_out(doc_id).alias("held_out"), *[F.col(c) for c in more])
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes[1 - keep :])
    out = small_batches(rows).mapInArrow(run, f"{kinds}, score double")
    return out.select(key_back("_doc").alias("doc_id"), "held_out", "score", (F.col("score") >= bar).cast("int").alias("predicted"), *[F.col("_text").alias(text) if c == text else F.col(c) for c in also])
