"""Roads that tiles cut: vertices at one place become one, and cut ends find the piece that goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.functions.geo import cell, distance
from sitewright.operators.graph import components
from sitewright.sources.tables import saved


def weld(points: DataFrame, reach: float) -> DataFrame:
    """(id, vertex, x, y) of points (id, x, y): those at most reach apart in x and in y, also by way of others, are one vertex,
    which has the smallest id of them and stands where that point does.

    All points of a cell of that size are within reach of each other, so cells are what is joined. Cells side by side are one
    if their nearest rims are; only across corners are places compared, each once however many points it has."""
    at = points.select("id", "x", "y", cell(F.col("x"), reach).alias("i"), cell(F.col("y"), reach).alias("j"))
    box = saved(at.groupBy("i", "j").agg(F.min("id").alias("u"), *[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]), "weld-cells")
    places, links = saved(at.select("i", "j", "x", "y").distinct(), "weld-places"), None
    for di, dj in ((1, 0), (0, 1), (1, 1), (1, -1)):
        b = box.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("u").alias("v"), *[F.col(c).alias(f"b_{c}") for c in ("lo_x", "lo_y", "hi_y")])
        near = box.join(b, ["i", "j"])
        near = near.filter(F.col("b_lo_x") - F.col("hi_x") <= reach) if di else near
        near = near.filter(F.col("b_lo_y") - F.col("hi_y") <= reach) if dj == 1 else near.filter(F.col("lo_y") - F.col("b_hi_y") <= reach) if dj == -1 else near
        if di and dj:
            p = near.select("i", "j", "u", "v").join(places, ["i", "j"])
            q = places.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"))
            near = p.join(q, ["i", "j"]).filter((F.abs(F.col("bx") - F.col("x")) <= reach) & (F.abs(F.col("by") - F.col("y")) <= reach))
        near = near.select("u", "v")
        links = near if links is None else links.union(near)
    roots = components(links)
    own = box.select("i", "j", "u").join(roots, "u", "left").select("i", "j", F.coalesce("root", "u").alias("vertex"))
    welded = at.join(own, ["i", "j"]).select("id", "vertex")
    return welded.join(points.select(F.col("id").alias("vertex"), "x", "y"), "vertex").select("id", "vertex", "x", "y")


def _near(ends: DataFrame, vertices: DataFrame, reach: float) -> DataFrame:
    """(segment, piece, end, v, other, metres): for each end the nearest vertex, nearer than reach, of another piece of its
    segment; ties to the smaller vertex."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = ends.select("segment", "piece", "end", F.col("vertex").alias("v"), "x", "y", cell(F.col("x"), reach).alias("i"), cell(F.col("y"), reach).alias("j"), F.explode(steps).alias("_s"))
    a = a.select("segment", "piece", "end", "v", "x", "y", (F.col("i") + F.col("_s.i")).alias("i"), (F.col("j") + F.col("_s.j")).alias("j"))
    b = vertices.select("segment", F.col("piece").alias("_p"), F.col("vertex").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"), cell(F.col("x"), reach).alias("i"), cell(F.col("y"), reach).alias("j"))
    d = distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    found = a.join(b, ["segment", "i", "j"]).filter("piece <> _p AND v <> other").select("segment", "piece", "end", "v", "other", d.alias("metres")).filter(F.col("metres") < reach)
    return found.groupBy("segment", "piece", "end", "v").agg(F.min(F.struct("metres", "other")).alias("_b")).select("segment", "piece", "end", "v", "_b.other", "_b.metres")


def tile_links(pieces: DataFrame, snap: float = 1.5, end_reach: float = 250.0, vertex_reach: float = 80.0) -> tuple[DataFrame, DataFrame]:
    """Welded vertices (segment, piece, pos, id, vertex, x, y) and links (segment, piece, end, v, other, metres) of pieces
    (segment, piece, pos, id, x, y, end, cut): end is 0 at a piece's first vertex, 1 at its last and null between, cut says
    whether a tile cut it there.

    A cut end is linked to the nearest cut end, nearer than end_reach, of another piece of its segment; without one, to the
    nearest vertex of another piece nearer than vertex_reach. Neither is the vertex that the end is welded to."""
    pieces = saved(pieces, "pieces")  # read a dozen times; making them reads and joins all ways
    w = weld(pieces.select("id", "x", "y"), snap)
    v = saved(pieces.drop("x", "y").join(w, "id"), "welded")
    cut = v.filter("cut AND end IS NOT NULL")
    ends = saved(_near(cut, cut, end_reach), "links-ends")
    rest = cut.join(ends.select("segment", "piece", "end"), ["segment", "piece", "end"], "left_anti")
    return v.select("segment", "piece", "pos", "id", "vertex", "x", "y"), ends.unionByName(_near(rest, v, vertex_reach))
