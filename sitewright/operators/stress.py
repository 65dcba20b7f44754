"""How a screening holds up when what it knows is hidden: all runs of all mechanisms are rows of one job, told apart by keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.operators.allocation import bounded_equal_shares
from sitewright.operators.rank import ranked_within
from sitewright.sources.tables import saved

#: What tells runs apart: how knowledge is hidden, how many percent of it, and which draw; the run that hides nothing is BASE.
RUN, BASE = ["mechanism", "percent", "rep"], "nothing_hidden"
#: Nodes of a region that are allocated together for all runs; larger regions go by ranges.
LARGE = 5_000
MEASURES = ["ranked", "reported_unknown", "abstention_violations", "max_residual", "top_size", "retention", "retention_among_surviving", "entrants", "entrants_inflated", "max_inflation"]


def runs_of(levels: dict[str, list[int]], replicates: int) -> list[tuple[str, int, int]]:
    return [(m, p, r) for m, ps in levels.items() for p in ps for r in range(replicates)]


def picks(rows: DataFrame, key: str, runs: DataFrame, seed: int) -> DataFrame:
    """(mechanism, percent, rep, key): exactly the run's percent of the rows (halves to the even number), those with the smallest
    hashes of seed, run and key. Places among hashes come from ranges, so a run's rows are no single task."""
    name = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*RUN, key)])
    drawn = rows.select(key).crossJoin(F.broadcast(runs)).withColumn("_h", F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long"))
    placed = ranked_within(drawn, RUN, ["_h", key], "_r")
    n = rows.agg(F.count("*").alias("_n"))
    return placed.crossJoin(F.broadcast(n)).filter(F.col("_r") <= F.bround(F.col("percent") * F.col("_n") / F.lit(100.0))).select(*RUN, key)


def degraded(totals: DataFrame, nodes: DataFrame, levels: dict[str, list[int]], replicates: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Totals (region, total) and nodes (node, region, limit) of every run and of BASE, each with `gone`: hidden in that run.

    production: known totals become null. location: a node stays listed and its region is null, with `gone` set. facility: a
    node isn't there at all. A null total or region was unknown before, and stays so."""
    spark = totals.sparkSession
    schema = "mechanism string, percent int, rep int"
    table = lambda ms: spark.createDataFrame(runs_of({m: levels[m] for m in ms if m in levels}, replicates), schema)
    every = spark.createDataFrame([(BASE, 0, 0), *runs_of(levels, replicates)], schema)
    no_totals = saved(picks(totals.filter("total IS NOT NULL"), "region", table(["production"]), seed), "hidden-totals").withColumn("gone", F.lit(True))
    no_nodes = saved(picks(nodes, "node", table(["location", "facility"]), seed), "hidden-nodes").withColumn("gone", F.lit(True))
    t = totals.crossJoin(F.broadcast(every)).join(no_totals, [*RUN, "region"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    n = nodes.crossJoin(F.broadcast(every)).join(no_nodes, [*RUN, "node"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    t = t.select(*RUN, "region", F.when(~F.col("gone"), F.col("total")).alias("total"), "gone")
    n = n.filter(~((F.col("mechanism") == "facility") & F.col("gone")))
    return t, n.select(*RUN, "node", F.when(~F.col("gone"), F.col("region")).alias("region"), "limit", "gone")


def screened(totals: DataFrame, nodes: DataFrame, need: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Nodes of every run with their need, null where unknown: (run, node, kw, gone), and (run, region, total, assigned,
    unserved) of regions with known totals. `gone` marks a node that is hidden or lies in a region whose total is."""
    known = totals.filter("total IS NOT NULL").select(*RUN, "region", "total")
    by = (*RUN, "region")
    shares, balance = bounded_equal_shares(known, nodes.filter("region IS NOT NULL").select(*by, "node", "limit"), by)
    lost = totals.filter("gone").select(*by, F.lit(True).alias("_lost"))
    n = nodes.join(shares.select(*RUN, "node", "share"), [*RUN, "node"], "left").join(lost, list(by), "left")
    return n.select(*RUN, "node", need(F.col("share")).alias("kw"), (F.col("gone") | F.coalesce("_lost", F.lit(False))).alias("gone")), known.join(balance, list(by))


def measured(nodes: DataFrame, balance: DataFrame, size: int, tolerance: float) -> DataFrame:
    """MEASURES of every run (screened) against BASE.

    The best are all ranked nodes whose need reaches the size-th one's, so ties stay together. Retention is null if nothing
    is ranked in BASE, retention among the surviving if none of its best is ranked. Inflation: need over that in BASE."""
    place = Window.partitionBy(*RUN).orderBy(F.desc("kw"), "node")  # only the first few of a run are kept, in each task
    cut = nodes.filter("kw IS NOT NULL").withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= size).groupBy(*RUN).agg(F.min("kw").alias("_cut"))
    t = nodes.join(cut, RUN, "left").withColumn("top", F.coalesce(F.col("kw") >= F.col("_cut") - tolerance, F.lit(False)))
    base = t.filter(F.col("mechanism") == BASE).select("node", F.col("kw").alias("_kw"), F.col("top").alias("_top"))
    was = F.coalesce("_top", F.lit(False))
    known, enters = F.col("kw").isNotNull(), F.col("top") & ~was
    m = t.filter(F.col("mechanism") != BASE).join(base, "node", "left").groupBy(*RUN).agg(
        F.count("kw").alias("ranked"), F.count_if(~known).alias("reported_unknown"), F.count_if(known & F.col("gone")).alias("abstention_violations"), F.count_if("top").alias("top_size"),
        F.count_if(F.col("top") & was).alias("_kept"), F.count_if(known & was).alias("_surviving"), F.count_if(enters).alias("entrants"),
        F.count_if(enters & F.coalesce(F.col("kw") > F.col("_kw") + tolerance, F.lit(False))).alias("entrants_inflated"),
        (F.coalesce(F.max(F.when(F.col("_kw") != 0, F.col("kw") / F.col("_kw"))), F.lit(1.0)) - 1).alias("max_inflation"),
    )
    rest = balance.groupBy(*RUN).agg(F.max(F.abs(F.col("total") - F.col("assigned") - F.col("unserved"))).alias("_rest"))
    best = base.agg(F.count_if("_top").alias("_best"))
    m = m.join(rest, RUN, "left").crossJoin(F.broadcast(best))
    share = lambda of: F.when(F.col(of) > 0, F.col("_kept") / F.col(of))
    out = {"max_residual": F.coalesce("_rest", F.lit(0.0)), "retention": share("_best"), "retention_among_surviving": share("_surviving")}
    return m.select(*RUN, *[out.get(c, F.col(c)).cast("double").alias(c) for c in MEASURES])


def summary(runs: DataFrame, measures: list[str]) -> DataFrame:
    """(mechanism, percent, measure, runs, mean, p05, p95, least, most) over the replicates that have the measure. A quantile is
    the value at the lower place, from 0: q times the number, cut. As many values a group as there are replicates."""
    long = runs.unpivot(RUN, measures, "measure", "v")
    g = long.groupBy("mechanism", "percent", "measure").agg(F.sort_array(F.collect_list("v")).alias("_v"), F.avg("v").alias("mean"))
    n = F.size("_v")
    at = lambda q: F.get("_v", F.least(n - 1, F.floor(F.lit(q) * n).cast("int")))
    return g.select("mechanism", "percent", "measure", n.cast("long").alias("runs"), "mean", at(0.05).alias("p05"), at(0.95).alias("p95"), F.get("_v", F.lit(0)).alias("least"), F.get("_v", n - 1).alias("most"))


def tasks_for(rows: int) -> int:
    """So many that a task has some 5,000 rows: they are few bytes but much work, as each meets all runs, so Spark would deal too few."""
    return max(1, -(-rows // 5000))


def cuts(rows: DataFrame, key: str, runs: list[tuple[str, int, int]], seed: int) -> list[tuple[bytes, object] | None]:
    """For each run, the last row that picks() would take, as (first six bytes of the hash, key); None if it takes none.

    Hashes are even, so the row lies in a narrow band of them: rows below a run's band are counted, only those inside it are kept
    and ordered. Where the band missed, it grows, up to all hashes."""
    n, spark = rows.count(), rows.sparkSession
    wanted = {r: k for r in runs if (k := round(r[1] * n / 100.0))}
    found, width, top = {}, 8.0, 1 << 48
    name = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*RUN, key)])
    while open_ := [r for r in wanted if r not in found]:
        bands = []
        for r in open_:
            p = wanted[r] / n
            half = width * ((p * (1 - p) / n) ** 0.5 + 1 / n)
            bands.append((*r, wanted[r], max(0, int((p - half) * top)), min(top, int((p + half) * top))))
        drawn = rows.select(key).repartition(tasks_for(n)).crossJoin(F.broadcast(spark.createDataFrame(bands, "mechanism string, percent int, rep int, _k long, _low long, _high long")))
        drawn = drawn.withColumn("_h", F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long")).filter("_h <= _high")
        inside = F.col("_h") >= F.col("_low")
        near = saved(drawn.groupBy(*RUN, "_k", F.when(inside, F.col("_h")).alias("_h"), F.when(inside, F.col(key)).alias(key)).agg(F.count("*").alias("_n")), "stress-band")
        below = near.filter("_h IS NULL").select(*RUN, F.col("_n").alias("_b"))
        order = Window.partitionBy(*RUN).orderBy("_h", key)  # the band of one run, which grows with the root of the rows
        placed = near.filter("_h IS NOT NULL").withColumn("_r", F.row_number().over(order)).join(F.broadcast(below), RUN, "left")
        for r in placed.filter(F.col("_r") == F.col("_k") - F.coalesce("_b", F.lit(0))).select(*RUN, "_h", key).collect():  # one row a run
            found[tuple(r)[:3]] = (int(r["_h"]).to_bytes(6, "big"), r[key])
        width *= 4
    return [found.get(r) for r in runs]


def hidden(keys: list, runs: list[tuple[str, int, int]], last: list[tuple[bytes, object] | None], seed: int) -> np.ndarray:
    """Keys by runs: whether a run picks a key, by the last row that it takes (cuts)."""
    text, out = [str(k).encode() for k in keys], np.zeros((len(keys), len(runs)), bool)
    for j, (r, cut) in enumerate(zip(runs, last)):
        if cut is not None:
            start, (at, key) = md5(":".join(map(str, (seed, *r, ""))).encode()), cut
            for i, t in enumerate(text):
                h = start.copy()
                h.update(t)
                d = h.digest()[:6]
                out[i, j] = d < at or (d == at and keys[i] <= key)
    return out


def shares_of(total: float, limits: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Nodes by runs: shares of a region's total as allocation.bounded_equal_shares has them, NaN where a node isn't there. limits
    in ascending order, inf for none; there: nodes by runs."""
    if not len(limits):
        return np.zeros(there.shape)
    before = lambda x: np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)[:-1]])
    room = np.where(np.isinf(limits), 0.0, limits)[:, None]
    ahead = before(there.astype(float))
    level = np.maximum(0.0, (total - before(np.where(there, room, 0.0))) / np.maximum(there.sum(axis=0) - ahead, 1))
    sets = there & (limits[:, None] >= level)
    at = np.where(sets.any(axis=0), level[sets.argmax(axis=0), np.arange(there.shape[1])], np.inf)
    return np.where(there, np.minimum(limits[:, None], at), np.nan)


def _lists(values: np.ndarray, kind: pa.DataType, nulls: np.ndarray | None = None) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(values.ravel(), kind, mask=None if nulls is None else nulls.ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def by_region(totals: DataFrame, nodes: DataFrame, need: Callable[[Column], Column], levels: dict[str, list[int]], replicates: int, seed: int, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """What degraded() and screened() tell, without a row a run: (kw, state), arrays over all runs, for each node, state being 0
    where it isn't there, 2 where it is hidden and 1 otherwise; and (run, rest), each run's largest residual.

    A region of at most `large` nodes is allocated at once for all runs, in arrays; the nodes of larger ones go through
    screened(), by ranges. Runs that hide totals leave the other regions as in BASE. Place 0 is BASE, the others follow runs_of."""
    spark, runs = totals.sparkSession, runs_of(levels, replicates)
    of_totals, of_nodes = [r for r in runs if r[0] == "production"], [r for r in runs if r[0] != "production"]
    cut_t, cut_n = cuts(totals.filter("total IS NOT NULL"), "region", of_totals, seed), cuts(nodes, "node", of_nodes, seed)
    at_t, at_n = np.array([1 + i for i, r in enumerate(runs) if r[0] == "production"], int), np.array([1 + i for i, r in enumerate(runs) if r[0] != "production"], int)
    gone_is_absent, width = np.array([r[0] == "facility" for r in of_nodes], bool), len(runs) + 1

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("limit", "ascending"), ("node", "ascending")])  # nulls last
        keys, total = [k for k in table["node"].to_pylist() if k is not None], table["total"][0].as_py()
        limits = table["limit"].to_numpy()[: len(keys)].astype(float)
        limits = np.where(np.isnan(limits), np.inf, limits)
        gone = hidden(keys, of_nodes, cut_n, seed)
        there = np.ones((len(keys), width), bool)
        there[:, at_n] = ~gone
        state = np.ones((len(keys), width), np.int8)
        state[:, at_n] = np.where(gone, np.where(gone_is_absent, 0, 2), 1)
        share, rest = np.full((len(keys), width), np.nan), np.full((1, width), np.nan)
        if total is not None:
            lost = np.zeros(width, bool)
            lost[at_t] = hidden([table["region"][0].as_py()], of_totals, cut_t, seed)[0]
            own = np.concatenate([[0], at_n]).astype(int)
            share[:, at_t] = 0.0
            share[:, own] = shares_of(total, limits, there[:, own])
            share[:, at_t] = share[:, :1]
            assigned = np.nansum(share, axis=0)
            rest[0] = np.where(lost, np.nan, np.abs(total - assigned - np.maximum(0.0, total - assigned)))
            share[:, lost], state[:, lost] = np.nan, np.where(state[:, lost] > 0, 2, 0)
        shares = np.vstack([share, rest])
        return pa.table({"of_node": pa.array([True] * len(keys) + [False]), "share": _lists(shares, pa.float64(), np.isnan(shares)), "state": _lists(np.vstack([state, np.zeros((1, width), np.int8)]), pa.int8())})

    big = saved(nodes.filter("region IS NOT NULL").groupBy("region").agg(F.count("*").alias("_n")).filter(F.col("_n") > large).select("region"), "stress-large")
    some = not big.isEmpty()
    small_n, small_t = (nodes.join(big, "region", "left_anti"), totals.join(big, "region", "left_anti")) if some else (nodes, totals)
    known = small_t.filter("total IS NOT NULL")
    both = small_n.select("region", "node", F.col("limit").cast("double").alias("limit")).join(known.select("region", F.col("total").cast("double").alias("total")), "region", "full")
    lone = F.col("total").isNull()  # nodes that nothing is allocated to may be many: they go by hash
    count = nodes.count()
    parts = max(1, -(-count // large))
    both = both.select(F.when(~lone, F.col("region")).alias("region"), "node", "limit", "total", F.when(lone, F.pmod(F.xxhash64("node"), F.lit(parts))).otherwise(-1).alias("part"))
    out = both.repartition(tasks_for(count), "region", "part").groupBy("region", "part").applyInArrow(one, "of_node boolean, share array<double>, state array<tinyint>")
    out = saved(out.select("of_node", F.when(F.col("of_node"), F.transform("share", need)).otherwise(F.col("share")).alias("kw"), "state"), "stress-nodes")
    rest = out.filter("NOT of_node").select(F.posexplode("kw").alias("run", "rest")).groupBy("run").agg(F.max("rest").alias("rest"))
    rows = out.filter("of_node").select("kw", "state")
    if some:
        places = F.broadcast(spark.createDataFrame([(BASE, 0, 0, 0), *[(*r, 1 + i) for i, r in enumerate(runs)]], "mechanism string, percent int, rep int, run int"))
        t, n = degraded(totals, nodes, levels, replicates, seed)
        n, balance = screened(t.join(big, "region", "left_semi"), n.join(nodes.join(big, "region", "left_semi").select("node"), "node", "left_semi"), need)
        of = F.map_from_entries(F.collect_list(F.struct("run", F.struct("kw", "gone"))))
        m = n.join(places, RUN).groupBy("node").agg(of.alias("_m"))
        each = F.sequence(F.lit(0), F.lit(width - 1))
        at = lambda i: F.try_element_at("_m", i)
        rows = rows.union(saved(m.select(F.transform(each, lambda i: at(i)["kw"]).alias("kw"), F.transform(each, lambda i: F.when(at(i).isNull(), 0).when(at(i)["gone"], 2).otherwise(1).cast("tinyint")).alias("state")), "stress-nodes"))
        more = balance.join(places, RUN).groupBy("run").agg(F.max(F.abs(F.col("total") - F.col("assigned") - F.col("unserved"))).alias("rest"))
        rest = rest.union(more).groupBy("run").agg(F.max("rest").alias("rest"))
    return rows, rest


#: What measured_by_run counts, in order; the last is a maximum.
COUNTS = ("ranked", "reported_unknown", "abstention_violations", "top_size", "_kept", "_surviving", "entrants", "entrants_inflated", "_there", "_inflation")


def measured_by_run(rows: DataFrame, rest: DataFrame, runs: list[tuple[str, int, int]], size: int, tolerance: float) -> DataFrame:
    """MEASURES of every run as measured() has them, from by_region(): a batch of nodes counts for all runs at once, so a task sends
    on a few numbers a run and batch, and no node is joined or sorted."""
    spark, width = rows.sparkSession, len(runs) + 1

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                yield _matrix(b.column(0), width).astype(float), _matrix(b.column(1), width)

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.full((size, width), -np.inf)
        for kw, _ in slices(batches):
            held = np.partition(np.vstack([held, np.where(np.isnan(kw), -np.inf, kw)]), -size, axis=0)[-size:]
        run, kw = np.tile(np.arange(width), size), held.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(run[kw > -np.inf], pa.int32()), pa.array(kw[kw > -np.inf])], names=["run", "kw"])

    place = Window.partitionBy("run").orderBy(F.desc("kw"))  # size rows a task
    first = rows.mapInArrow(largest, "run int, kw double").withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= size).groupBy("run").agg(F.min("kw").alias("cut")).collect()
    cut = np.full(width, np.nan)
    for r in first:  # one row a run
        cut[r["run"]] = r["cut"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, most = np.zeros((len(COUNTS) - 1, width), np.int64), np.full(width, -np.inf)
        for kw, state in slices(batches):
            with np.errstate(invalid="ignore", divide="ignore"):
                base, known, top = kw[:, :1], ~np.isnan(kw), kw >= cut - tolerance
                was, there = top[:, :1], state > 0
                enters = top & ~was
                ratio = np.where(known & ~np.isnan(base) & (base != 0), kw / base, -np.inf)
                sums += [x.sum(axis=0) for x in (known, there & ~known, known & (state == 2), top, top & was, known & was, enters, enters & (kw > base + tolerance), there)]
            most = np.maximum(most, ratio.max(axis=0, initial=-np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), *map(pa.array, sums), pa.array(most, mask=np.isneginf(most))], names=["run", *COUNTS])

    m = rows.mapInArrow(count, "run int, " + ", ".join(f"{c} long" for c in COUNTS[:-1]) + f", {COUNTS[-1]} double")
    m = saved(m.groupBy("run").agg(*[F.sum(c).alias(c) for c in COUNTS[:-1]], F.max(COUNTS[-1]).alias(COUNTS[-1])).join(rest, "run", "left"), "stress-runs")
    names = F.broadcast(spark.createDataFrame([(1 + i, *r) for i, r in enumerate(runs)], "run int, mechanism string, percent int, rep int"))
    best = m.filter("run = 0").select(F.col("top_size").alias("_best"))
    m = m.filter("_there > 0").join(names, "run").crossJoin(F.broadcast(best))
    share = lambda of: F.when(F.col(of) > 0, F.col("_kept") / F.col(of))
    out = {"max_residual": F.coalesce("rest", F.lit(0.0)), "retention": share("_best"), "retention_among_surviving": share("_surviving"), "max_inflation": F.coalesce("_inflation", F.lit(1.0)) - 1}
    return m.select(*RUN, *[out.get(c, F.col(c)).cast("double").alias(c) for c in MEASURES])


def stress(totals: DataFrame, nodes: DataFrame, need: Callable[[Column], Column], levels: dict[str, list[int]], replicates: int, seed: int, size: int = 10, tolerance: float = 1e-9) -> DataFrame:
    """The summary of all measures of all runs: degraded, allocated, ranked and compared in one job. Nodes are told apart by
    their id; a region is known by one row of totals."""
    rows, rest = by_region(totals, nodes, need, levels, replicates, seed)
    return summary(measured_by_run(rows, rest, runs_of(levels, replicates), size, tolerance), MEASURES)
