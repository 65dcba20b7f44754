"""Distance and containment joins as equi-joins on cells.

Point tables have columns (id, x, y) in metres. All ties break by the smaller id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.functions.geo import cell, distance
from sitewright.operators.checks import small_side
from sitewright.sources.tables import saved


def _around(points: DataFrame, size: float, columns: list[str]) -> DataFrame:
    """Each point in its own cell and the eight around it."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    at = points.select(*columns, cell(F.col("_x"), size).alias("_ci"), cell(F.col("_y"), size).alias("_cj"), F.explode(steps).alias("_s"))
    return at.select(*columns, (F.col("_ci") + F.col("_s.i")).alias("_i"), (F.col("_cj") + F.col("_s.j")).alias("_j"))


def pairs_within(left: DataFrame, right: DataFrame, radius: float, unlike: str | None = None, reach: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, other, d) of all pairs at most radius apart. The smaller table should be on the right: it is the one dealt to nine cells.

    unlike: a column of both tables; pairs that have the same value in it don't count. reach: a column of left, the farthest that
    the row asks for. carry: columns of right that pairs keep. Points are shuffled by cell: dealt to nine cells and read from packed files they are many more than
    Spark believes, so it must not choose to broadcast them."""
    mark = [F.col(unlike).alias("_mine")] if unlike else []
    theirs = [F.col(unlike).alias("_theirs")] if unlike else []
    far = [F.col(reach).alias("_reach")] if reach else []
    near = _around(right.select(F.col("id").alias("other"), F.col("x").alias("_x"), F.col("y").alias("_y"), *theirs, *carry), radius, ["other", "_x", "_y", *["_theirs"] * len(theirs), *carry])
    mine = left.select("id", "x", "y", *mark, *far, cell(F.col("x"), radius).alias("_i"), cell(F.col("y"), radius).alias("_j"))
    d = distance(F.col("x"), F.col("y"), F.col("_x"), F.col("_y"))
    found = mine.join(near.hint("merge"), ["_i", "_j"])
    found = found.filter("_mine <> _theirs") if unlike else found
    found = found.withColumn("d", d).filter((F.col("d") <= radius) & (F.col("d") <= F.col("_reach") if reach else F.lit(True)))
    return found.select("id", "other", "d", *carry)


def nearest(left: DataFrame, right: DataFrame, cap: float, first: float | None = None, unlike: str | None = None) -> DataFrame:
    """(id, other, d) of every left row: the nearest right point strictly closer than cap, else nulls.

    Rounds of cells of growing size: what a round finds within its size is final, the others go on with twice the size,
    so dense places are settled over small cells and only the rest looks far. Each round writes what it found and what is
    left, so none is computed again; they end at the cap or when nothing is left. unlike: as in pairs_within. The least distance
    comes first, then the least id at that distance: both are one number a row that tasks keep while pairs pass by;
    the least of (distance, id) as one value would make Spark sort all pairs of a task.
    """
    size, found = min(first or cap, cap), None
    more = [unlike] if unlike else []
    rest, right = saved(left.select("id", "x", "y", *more), "nearest-rest"), saved(right.select("id", "x", "y", *more), "nearest-right")
    while True:
        least = saved(pairs_within(rest, right, size, unlike).filter(F.col("d") < cap).groupBy("id").agg(F.min("d").alias("_m")), "nearest-least")
        at = pairs_within(rest.join(least.hint("merge"), "id"), right, size, unlike, "_m")
        best = saved(at.groupBy("id").agg(F.min("other").alias("other"), F.min("d").alias("d")), "nearest-found")
        found = best if found is None else found.unionByName(best)
        if size >= cap:
            break
        rest = saved(rest.join(best.select("id").hint("merge"), "id", "left_anti"), "nearest-rest")
        if rest.isEmpty():
            break
        size = min(2 * size, cap)
    return left.select("id").join(found.hint("merge"), "id", "left")


def nearest_layers(left: DataFrame, right: DataFrame, caps: dict[str, float], first: float) -> DataFrame:
    """(id, layer, other, d): the nearest point of each layer strictly closer than the layer's cap, for every left row and layer
    of caps, else nulls. right: (layer, id, x, y).

    One search for all layers: rounds as in nearest, the least distance first, with the layer in the key, and what is still asked, not the points, is dealt to nine cells;
    a layer whose cap a round has reached goes on no longer, and points of layers that are settled aren't read again."""
    layers = F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), F.lit(float(v)).alias("cap")) for k, v in caps.items()]))
    asked = left.select("id", F.col("x").alias("_x"), F.col("y").alias("_y"), layers.alias("l")).select("id", "_x", "_y", "l.*")
    rest, size, found, open_ = saved(asked, "nearest-rest"), first, [], list(caps)
    points = saved(right.filter(F.col("layer").isin(*caps)).select("layer", F.col("id").alias("other"), "x", "y"), "nearest-right")
    while True:
        near = _around(rest, size, ["id", "layer", "cap", "_x", "_y"])
        at = points.filter(F.col("layer").isin(*open_)).select("layer", "other", "x", "y", cell(F.col("x"), size).alias("_i"), cell(F.col("y"), size).alias("_j"))
        d = distance(F.col("x"), F.col("y"), F.col("_x"), F.col("_y"))
        pairs = lambda asked, most: at.join(asked.hint("merge"), ["layer", "_i", "_j"]).withColumn("d", d).filter((F.col("d") <= size) & (F.col("d") < F.col("cap")) & most)  # noqa: B023, E731
        least = saved(pairs(near, F.lit(True)).groupBy("id", "layer").agg(F.min("d").alias("_m")), "nearest-least")
        near = _around(rest.join(least.hint("merge"), ["id", "layer"]), size, ["id", "layer", "cap", "_m", "_x", "_y"])
        found.append(saved(pairs(near, F.col("d") <= F.col("_m")).groupBy("id", "layer").agg(F.min("other").alias("other"), F.min("d").alias("d")), "nearest-found"))
        rest = saved(rest.filter(F.col("cap") > size).join(found[-1].select("id", "layer").hint("merge"), ["id", "layer"], "left_anti"), "nearest-rest")
        open_ = [r["layer"] for r in rest.select("layer").distinct().collect()]  # no more than caps has
        if not open_:
            return left.select("id", F.explode(F.array(*[F.lit(k) for k in caps])).alias("layer")).join(reduce(DataFrame.union, found).hint("merge"), ["id", "layer"], "left")
        size *= 2


def nearest_from_cells(cells: DataFrame, points: DataFrame, size: float, cap: float) -> DataFrame:
    """(i, j, d): the distance from the centre of each cell (i, j, own) to the nearest point (i, j, x, y) closer than cap; cells
    without one are left out. own: the nearest of the cell's own points, null if it has none; all cells with points must be there.

    Up to half the size, own is the answer. For the others cells say which of them may hold a nearer point: those whose
    centre is no farther than that of the nearest cell with points and a diagonal more. Only points of such cells are
    looked at, once, and they may be many and derived: none is written."""
    half, c = size / 2, lambda k: (F.col(k) + 0.5) * size
    near = cells.filter(F.col("own") <= half).select("i", "j", F.col("own").alias("d"))
    rest = saved(cells.filter(F.col("own").isNull() | (F.col("own") > half)).select("i", "j", "own"), "cells-rest")
    if rest.isEmpty():
        return near.filter(F.col("d") < cap)
    held = cells.filter("own IS NOT NULL").select(F.struct("i", "j").alias("id"), c("i").alias("x"), c("j").alias("y"))
    diagonal = size * 1.4143
    first = nearest(rest.select(F.struct("i", "j").alias("id"), c("i").alias("x"), c("j").alias("y")), held, cap + diagonal, 2 * size).filter("d IS NOT NULL")
    reach = F.floor((F.col("d") + diagonal) / size).cast("long")
    span = lambda k, at: F.explode(F.sequence(F.col(at) - reach, F.col(at) + reach)).alias(k)
    asked = first.select(F.col("id.i").alias("_qi"), F.col("id.j").alias("_qj"), "d").select("_qi", "_qj", "d", span("i", "_qi")).select("_qi", "_qj", "d", "i", span("j", "_qj"))
    asked = asked.filter(distance(F.col("i"), F.col("j"), F.col("_qi"), F.col("_qj")) * size <= F.col("d") + diagonal).select("_qi", "_qj", "i", "j")
    asked = saved(asked.join(cells.filter("own IS NOT NULL").select("i", "j"), ["i", "j"], "left_semi"), "cells-asked")
    d = distance(F.col("x"), F.col("y"), c("_qi"), c("_qj"))
    found = points.join(small_side(asked, 100_000), ["i", "j"]).groupBy("_qi", "_qj").agg(F.min(d).alias("d")).select(F.col("_qi").alias("i"), F.col("_qj").alias("j"), "d")
    return near.union(found).filter(F.col("d") < cap)


def edges_of(zones: DataFrame) -> DataFrame:
    """(zone, ring, hole, x1, y1, x2, y2) of zones (zone, rings: array of struct(hole, points: array of struct(x, y)))."""
    rings = zones.select("zone", F.posexplode("rings").alias("ring", "r")).select("zone", "ring", "r.hole", "r.points")
    later = F.concat(F.slice("points", 2, F.size("points") - 1), F.slice("points", 1, 1))
    pairs = F.explode(F.arrays_zip(F.col("points").alias("a"), later.alias("b")))
    return rings.select("zone", "ring", "hole", pairs.alias("e")).select("zone", "ring", "hole", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def points_in_zones(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """(id, zone) of all points inside zones: even-odd rule, half open on y, in an outer ring and in no hole.

    Zones are dealt to the cells of their bounding box, and edges to the rows of cells they pass through, so that a point
    meets only the edges of its own row of cells: those that a line to its side can cross.
    """
    box = edges.groupBy("zone").agg(*[f(c).alias(n) for f, c, n in ((F.min, "x1", "_x0"), (F.max, "x1", "_x1"), (F.min, "y1", "_y0"), (F.max, "y1", "_y1"))])
    span = lambda a, b: F.explode(F.sequence(cell(F.col(a), size), cell(F.col(b), size)))
    cells = box.select("zone", "_y0", "_y1", span("_x0", "_x1").alias("_i")).select("zone", "_i", span("_y0", "_y1").alias("_j"))
    near = points.select("id", "x", "y", cell(F.col("x"), size).alias("_i"), cell(F.col("y"), size).alias("_j")).join(cells, ["_i", "_j"]).select("id", "x", "y", "zone", "_j")
    rows = F.explode(F.sequence(cell(F.least("y1", "y2"), size), cell(F.greatest("y1", "y2"), size))).alias("_j")
    sides = edges.filter("y1 <> y2").select("zone", "ring", "hole", "x1", "y1", "x2", "y2", rows)
    crosses = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    crossing = F.when((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")), crosses).otherwise(False)
    rings = near.join(sides, ["zone", "_j"]).groupBy("id", "zone", "ring").agg((F.sum(crossing.cast("int")) % 2 == 1).alias("_in"), F.max("hole").alias("hole"))
    return rings.groupBy("id", "zone").agg(F.max(F.col("_in") & ~F.col("hole")).alias("_out"), F.max(F.col("_in") & F.col("hole")).alias("_hole")).filter("_out AND NOT _hole").select("id", "zone")


def match_status(points: DataFrame, found: DataFrame) -> DataFrame:
    """(id, zones, keys, status) of all points (id, province, conflict) by the zones that hold them (id, zone, province).

    A zone of another province than the point's is a province_conflict, a point whose place is in doubt a location_conflict;
    else no zone is unmatched, one matched, several ambiguous. keys: all zones, sorted, joined by bars."""
    own = points.select("id", F.col("province").alias("_own"), "conflict")
    g = found.join(own.select("id", "_own"), "id").groupBy("id").agg(F.sort_array(F.collect_set("zone")).alias("_k"), F.bool_or(F.col("province") != F.col("_own")).alias("_other"))
    n = F.coalesce(F.size("_k"), F.lit(0))
    count = F.when(F.col("_k").isNull(), 0).otherwise(n).cast("long")
    status = F.when(F.coalesce("_other", F.lit(False)), "province_conflict").when(F.coalesce("conflict", F.lit(False)), "location_conflict").when(count == 0, "unmatched").when(count == 1, "matched").otherwise("ambiguous")
    return own.join(g, "id", "left").select("id", count.alias("zones"), F.coalesce(F.concat_ws("|", F.col("_k").cast("array<string>")), F.lit("")).alias("keys"), status.alias("status"))


def unit_of_areas(areas: DataFrame, units: DataFrame, size: float) -> DataFrame:
    """(zone, unit, outside_m2, status, touched) of areas (zone, i, j) over units (unit, i, j), both as cells of one size.

    An area's unit is the one at its inner point, the cell nearest to the mean of its cells. Without one such unit, or with
    over a cell's area outside of it, the area is up for review, and all units it touches are listed."""
    mean = areas.groupBy("zone").agg(F.count("*").alias("_n"), F.sum("i").alias("_si"), F.sum("j").alias("_sj"))
    far = (F.col("i") * F.col("_n") - F.col("_si")) * (F.col("i") * F.col("_n") - F.col("_si")) + (F.col("j") * F.col("_n") - F.col("_sj")) * (F.col("j") * F.col("_n") - F.col("_sj"))
    inner = areas.join(mean, "zone").groupBy("zone", "_n").agg(F.min(F.struct(far.alias("d"), "i", "j")).alias("_p")).select("zone", "_n", "_p.i", "_p.j")
    at = inner.join(units, ["i", "j"], "left").groupBy("zone", "_n").agg(F.count("unit").alias("_c"), F.min("unit").alias("unit"))
    over = areas.join(units, ["i", "j"]).groupBy("zone", "unit").agg(F.count("*").alias("_in"))
    touched = over.groupBy("zone").agg(F.concat_ws("|", F.sort_array(F.collect_list("unit")).cast("array<string>")).alias("_all"))
    one = at.withColumn("unit", F.when(F.col("_c") == 1, F.col("unit"))).join(over, ["zone", "unit"], "left").join(touched, "zone", "left")
    outside = F.when(F.col("_c") == 1, (F.col("_n") - F.coalesce("_in", F.lit(0))) * (size * size))
    clear = F.coalesce(outside <= size * size, F.lit(False))
    return one.select("zone", "unit", outside.alias("outside_m2"), F.when(clear, "matched").otherwise("spatial_review_required").alias("status"), F.when(clear, F.col("unit").cast("string")).otherwise(F.coalesce("_all", F.lit(""))).alias("touched"))


def focal_sum(cells: DataFrame, value: str, reach: int) -> DataFrame:
    """(i, j, total): the sum of value over the square of cells within reach, for each cell that has a neighbour."""
    steps = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    moved = cells.select("i", "j", value, steps.alias("_di")).select((F.col("i") + F.col("_di")).alias("i"), "j", value, steps.alias("_dj"))
    return moved.select("i", (F.col("j") + F.col("_dj")).alias("j"), value).groupBy("i", "j").agg(F.sum(value).alias("total"))


def keep_first(points: DataFrame, radius: float, same) -> DataFrame:
    """Rows left when, in order of ordinal `id`, a row goes if an earlier kept one within radius is `same` (a predicate on
    the columns with prefixes a_, of the row, and b_, of the earlier one, and on their distance d). Rounds settle rows without an undecided earlier neighbour; dominated ones go. The first undecided
    row is settled in each round, so they end."""
    more = [c for c in points.columns if c not in ("id", "x", "y")]
    a = points.select("id", *[F.col(c).alias(f"a_{c}") for c in more])
    b = points.select(F.col("id").alias("other"), *[F.col(c).alias(f"b_{c}") for c in more])
    blocks = saved(pairs_within(points, points, radius).filter("other < id").join(a, "id").join(b, "other").filter(same).select("id", "other"), "keep-blocks")
    state = saved(points.select("id", F.lit(None).cast("boolean").alias("kept")), "keep-state")
    while True:
        seen = blocks.join(state.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.coalesce(F.bool_or("kept"), F.lit(False)).alias("_hit"), F.bool_or(F.col("kept").isNull()).alias("_open"))
        state = saved(state.join(seen, "id", "left").select("id", F.coalesce("kept", F.when(F.col("_hit"), False).when(~F.coalesce("_open", F.lit(False)), True)).alias("kept")), "keep-state")
        if state.filter("kept IS NULL").isEmpty():
            break
    return points.join(state.filter("kept").select("id"), "id", "left_semi")
