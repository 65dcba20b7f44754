"""Approximate nearest neighbours by cross-polytope hashing with many probes; candidates are ranked exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_key, key_back, written

#: Sampled queries by which the probes are fitted, and rows and queries of one block of exact products.
SAMPLE, ROWS, ASKS = 200, 1024, 512
#: Sampled rows, a quarter of all at most, that tell how near a query's k-th neighbour is at least.
BOUND = 4096


@dataclass
class Index:
    """What hashing needs: tables, hash functions a table, probes a table, numbers of a vector, axes, scales, and the sample's recall."""

    tables: int
    functions: int
    probes: int
    size: int
    axes: int
    scale: float
    longest: float
    recall: float = 1.0
    bound: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def buckets(self) -> int:
        return (2 * self.axes) ** self.functions


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, seed: tuple[int, int], axes: int) -> np.ndarray:
    """A pseudo-rotation: three times random signs and the Hadamard transform; then the first axes."""
    signs = np.random.default_rng([20_483, *seed]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x[:, :axes]


def unit(x: np.ndarray, index: Index, query: bool) -> np.ndarray:
    """Vectors of length one, padded to a power of two, that are the nearer in angle to a query the larger their product with it.

    Rows are divided by the longest one's length, and what is missing to one becomes a further coordinate; queries have none there."""
    x = x / index.scale
    width = 1 << int(index.size).bit_length()  # at least one coordinate more
    out = np.zeros((len(x), width))
    length = np.sqrt((x * x).sum(1))
    out[:, : index.size] = x / (length[:, None] if query else index.longest)
    if not query:
        out[:, index.size] = np.sqrt(np.maximum(0, 1 - (length / index.longest) ** 2))
    return out


def axis_scores(x: np.ndarray, index: Index, table: int, function: int) -> np.ndarray:
    """Products with each signed axis: 2i for the i-th, 2i + 1 for its opposite."""
    y = rotated(x, (table, function), index.axes)
    return np.stack([y, -y], 2).reshape(len(y), 2 * index.axes)


def bucket_of(x: np.ndarray, index: Index, table: int) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for f in range(index.functions):
        at = at * (2 * index.axes) + axis_scores(x, index, table, f).argmax(1)
    return at


def bucket_scores(x: np.ndarray, index: Index, table: int) -> np.ndarray:
    """Each bucket's rank value for queries: the sum of the products with its axes."""
    s = axis_scores(x, index, table, 0)
    for f in range(1, index.functions):
        s = (s[:, :, None] + axis_scores(x, index, table, f)[:, None, :]).reshape(len(x), -1)
    return s


def best_of(queries: np.ndarray, rows: np.ndarray, q_id: np.ndarray, r_id: np.ndarray, r_key: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row place, product) of the k rows nearest to each query but its own row, ties to smaller keys.

    floor: products under it, for each query, are not wanted. One matrix product finds those that may be among them; their products are then summed again one by one, so that a
    pair has the same value in every block."""
    rough = queries @ rows.T
    rough[q_id[:, None] == r_id[None, :]] = -np.inf
    keep = min(k, rough.shape[1])
    if not keep:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    least = np.partition(rough, -keep, 1)[:, -keep]
    least = least if floor is None else np.maximum(least, floor)
    slack = 1e-9 * np.sqrt((queries**2).sum(1) * max((rows**2).sum(1).max(), 1e-300))
    i, j = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
    exact = (queries[i] * rows[j]).sum(1)
    order = np.lexsort((r_id[j], r_key[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    start = np.searchsorted(i, np.arange(len(queries)))
    on = np.arange(len(i)) - start[i] < k
    return i[on], j[on], exact[on]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists of numbers as rows, in double precision; shorter ones end in zeros."""
    out = np.zeros((len(column), size))
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(np.arange(len(column)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def usable(vector: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def true_nearest(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, size: int) -> DataFrame:
    """(query, uid, key, score, vector): the k nearest of all rows to a bounded number of queries, by exact products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 8 * ROWS):
                part = batch.slice(a, 8 * ROWS)
                uid, key = part.column(0).to_numpy(), part.column(1).to_numpy()
                i, j, score = best_of(queries, matrix(part.column(2), size), ids, uid, key, k)
                yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in (ids[i], uid[j], key[j], score)), part.column(2).take(pa.array(j)).cast(pa.list_(pa.float64()))], names=["query", "uid", "key", "score", "vector"])

    near = rows.select("uid", "key", "vector").mapInArrow(run, "query long, uid long, key long, score double, vector array<double>")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "key", "uid")  # k rows a query and batch
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def fitted(rows: DataFrame, asks: DataFrame, k: int, tables: int, axes: int, recall: float) -> Index | None:
    """The index for rows (uid, key, vector): hash functions a table and probes that reach the recall on a sample of queries.

    The sample is the SAMPLE queries with the smallest hash; their true neighbours among all rows are found in one pass. A
    neighbour is found by so many probes as its bucket's best place is in its query's order, over all tables; the probes
    cover the wanted share of all neighbours. One or two functions a table: what needs fewer products and probes."""
    shape = rows.agg(F.max(F.size("vector")).alias("size"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("scale"), F.count("*").alias("n")).first()
    if not shape["n"]:
        return None
    scale = float(shape["scale"])
    longest = rows.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale)))).alias("m")).first()["m"]
    size = int(shape["size"])
    axes = min(axes, 1 << size.bit_length())
    index = Index(tables, 1, 1, size, axes, scale, float(longest))
    if (few := min(BOUND, shape["n"] // 4)) > k:
        some = rows.orderBy(F.xxhash64("uid", F.lit(1)), "uid").limit(few).select("uid", "vector").toPandas()  # BOUND rows at most
        index.bound = some["uid"].to_numpy(), matrix(pa.array([list(map(float, v)) for v in some["vector"]], pa.list_(pa.float64())), size)
    sample = asks.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("uid", "vector").toPandas()  # SAMPLE rows at most
    if not len(sample):
        return index
    ids, queries = sample["uid"].to_numpy(), matrix(pa.array([list(map(float, v)) for v in sample["vector"]], pa.list_(pa.float64())), size)
    near = true_nearest(rows, ids, queries, k, size).select("query", "vector").toPandas()  # SAMPLE * k rows at most
    if not len(near):
        return index
    place = {q: i for i, q in enumerate(ids.tolist())}
    of = np.array([place[q] for q in near["query"]])
    found = unit(matrix(pa.array([list(v) for v in near["vector"]], pa.list_(pa.float64())), size), index, False)
    asked = unit(queries, index, True)
    best = None
    for functions in (1, 2):
        index.functions = functions
        rank = np.full(len(of), index.buckets)
        for t in range(tables):
            mine = bucket_of(found, index, t)
            scores = bucket_scores(asked, index, t)
            for i in range(len(asked)):
                on = of == i
                s = scores[i]
                rank[on] = np.minimum(rank[on], len(s) - np.searchsorted(np.sort(s), s[mine[on]], "right"))
        probes = int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))))]) + 1
        cost = tables * probes * (shape["n"] / index.buckets + 256)
        if best is None or cost < best[0]:
            best = cost, functions, probes, float((rank < probes).mean())
    index.functions, index.probes, index.recall = best[1:]
    return index


def floors(queries: np.ndarray, ids: np.ndarray, index: Index, k: int) -> np.ndarray:
    """For each query a product that k of the sampled rows reach, so that its k nearest do, too."""
    if index.bound is None:
        return np.full(len(queries), -np.inf)
    uid, rows = index.bound
    s = queries @ rows.T
    s[ids[:, None] == uid[None, :]] = -np.inf
    return np.partition(s, -k, 1)[:, -k]


def hashed(rows: DataFrame, index: Index, query: bool, k: int) -> DataFrame:
    """rows with `at`: the bucket of each table, or for queries those of the probes, and with `floor`, null for rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ASKS):
                batch = whole.slice(a, ASKS)
                own = matrix(batch.column(2), index.size)
                x, each = unit(own, index, query), []
                floor = pa.array(floors(own, batch.column(0).to_numpy(), index, k)) if query else pa.nulls(len(own), pa.float64())
                for t in range(index.tables):
                    if query:
                        s = bucket_scores(x, index, t)
                        n = min(index.probes, s.shape[1])
                        each.append(t * index.buckets + np.argpartition(-s, n - 1, 1)[:, :n])
                    else:
                        each.append(t * index.buckets + bucket_of(x, index, t)[:, None])
                at = np.concatenate(each, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * at.shape[1], pa.int32()), pa.array(at.ravel())), floor], names=[*batch.schema.names, "at", "floor"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.select("uid", "key", "vector").mapInArrow(run, f"uid long, key long, vector {kind}, at array<long>, floor double")


def dealt(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """Rows and queries (at: their buckets) in blocks (at, s): each row of a bucket meets each of its queries in one block.

    A bucket's rows and queries are dealt into parts of about ROWS and ASKS, and each part of rows goes with each of queries,
    so that a bucket may hold any share of the table."""
    n = lambda df, name: df.groupBy("at").agg(F.count("*").alias(name))
    flat = lambda df: df.select("uid", "key", "vector", F.explode("at").alias("at"), "floor")
    rows, asks = flat(rows), flat(asks)
    sizes = n(rows, "_r").join(n(asks, "_a"), "at")
    sizes = written(sizes.select("at", F.ceil(F.col("_r") / ROWS).cast("int").alias("_r"), F.ceil(F.col("_a") / ASKS).cast("int").alias("_a")), "bucket-sizes")
    own = lambda c: F.pmod(F.xxhash64("uid", "at"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = rows.join(sizes, "at").withColumn("_i", own("_r")).select("at", (F.col("_i") * F.col("_a")).alias("_i"), each("_a").alias("_j"), "uid", "key", "vector", "floor", F.lit(False).alias("ask"))
    asks = asks.join(sizes, "at").withColumn("_j", own("_a")).select("at", "_a", each("_r").alias("_i"), "_j", "uid", "key", "vector", "floor").select("at", (F.col("_i") * F.col("_a")).alias("_i"), "_j", "uid", "key", "vector", "floor", F.lit(True).alias("ask"))
    return rows.union(asks).select("at", (F.col("_i") + F.col("_j")).alias("s"), "uid", "key", "vector", "floor", "ask")


def block_best(blocks: DataFrame, index: Index, k: int) -> DataFrame:
    """(query, uid, key, score): the k nearest of each query in its blocks; those of one task are merged some blocks at a time."""
    names, most = ["query", "uid", "key", "score"], 1 << 18

    def merged(found: list) -> Iterator[pa.RecordBatch]:
        if sum(len(f[0]) for f in found):
            q, u, c, s = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((u, c, -s, q))  # a pair's products are equal, so its repeats are neighbours here
            q, u, c, s = q[order], u[order], c[order], s[order]
            one = np.r_[True, (q[1:] != q[:-1]) | (u[1:] != u[:-1])]
            q, u, c, s = q[one], u[one], c[one], s[one]
            on = np.arange(len(q)) - np.searchsorted(q, q) < k
            yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (q, u, c, s)], names=names)

    def block(parts: list[pa.RecordBatch]) -> tuple:
        t = pa.Table.from_batches(parts).combine_chunks()
        ask = t["ask"].to_numpy()
        x, uid, key = matrix(t["vector"].chunk(0), index.size), t["uid"].to_numpy(), t["key"].to_numpy()
        i, j, score = best_of(x[ask], x[~ask], uid[ask], uid[~ask], key[~ask], k, t["floor"].to_numpy()[ask])
        return uid[ask][i], uid[~ask][j], key[~ask][j], score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, now, found, n = [], None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (s[1:] != s[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if open_ and (at[a], s[a]) != now:
                    found.append(block(open_))
                    n, open_ = n + len(found[-1][0]), []
                    if n > most:
                        yield from merged(found)
                        found, n = [], 0
                now = at[a], s[a]
                open_.append(batch.slice(a, b - a))
        if open_:
            found.append(block(open_))
        yield from merged(found)

    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(tasks, "at", "s").sortWithinPartitions("at", "s").mapInArrow(run, "query long, uid long, key long, score double")


def nearest_vectors(vectors: DataFrame, k: int = 20, queries: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding", tables: int = 8, axes: int = 64, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k rows found with the largest inner product, nearest first.

    queries: which rows ask (default: vec_id divisible by 20). Each asks all rows but itself; ties go to smaller vec_id.
    Vectors are put on the unit sphere, where the angle orders as the product does, turned by fast pseudo-rotations, a
    number of tables, and assigned to the nearest signed axis. A query probes the buckets nearest to it in each table, as
    many as the sample of fitted() needs for the recall; candidates are ranked by exact products in double precision, within
    blocks of a bucket; a bounded sample of rows tells how near the k-th is at least, and what is farther is not sent on.
    Queries that find fewer than k rows are held against all rows, in blocks.

    Vectors that are null, empty, zero or hold null or non-finite components take no part; shorter ones count as ending
    in zeros. Rows of one id are rows of their own; a null id comes before all others and is no query. Empty table: no rows.
    """
    asking = F.pmod(F.col(vec_id), F.lit(20)) == 0 if queries is None else queries
    rows = vectors.select(doc_key(vec_id).alias("key"), F.col(vector).alias("vector"), F.coalesce(asking, F.lit(False)).alias("ask")).filter(usable(F.col("vector")))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    asks = rows.filter("ask")
    index = fitted(rows, asks, k, tables, axes, recall)
    spark, none = vectors.sparkSession, "query long, uid long, key long, score double"
    if index is None:
        found = spark.createDataFrame([], none)
    else:
        table, probes = written(hashed(rows, index, False, k), "vector-buckets"), written(hashed(asks, index, True, k), "query-buckets")
        found = written(block_best(dealt(table, probes), index, k), "block-neighbours")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "key", "uid")  # k rows a query, table and probe at most
    top = lambda df: df.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = written(top(found), "neighbours")
    if index is not None and (n := min(k, rows.count() - 1)) > 0:
        full = out.groupBy("query").agg(F.count("*").alias("n")).filter(F.col("n") >= n)
        short = written(asks.join(full, F.col("uid") == F.col("query"), "left_anti").select("uid", "key", "vector"), "short-queries")
        if not short.isEmpty():
            one = F.array(F.lit(0).cast("long")).alias("at"), F.lit(float("-inf")).alias("floor")
            exact = block_best(dealt(rows.select("uid", "key", "vector", *one), short.select("*", *one)), index, k)
            out = written(top(out.drop("rank").union(exact)), "neighbours")
    names = asks.select(F.col("uid").alias("query"), F.col("key").alias("_q"))
    return out.join(names, "query").select(key_back("_q").alias("query_id"), "rank", key_back("key").alias("vec_id"), "score")


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query_id, vec_id) that are found."""
    hit = exact.select("query_id", "vec_id").distinct().join(found.select("query_id", "vec_id", F.lit(1).alias("hit")).distinct(), ["query_id", "vec_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0
