"""Footprint shape: hull and smallest rotated box."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull by two monotone chains."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts
    out = []
    for run in (pts, pts[::-1]):
        chain: list[np.ndarray] = []
        for p in run:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        out += chain[:-1]
    return np.array(out)


def smallest_box(points: np.ndarray) -> tuple[float, float]:
    """Long and short side of the box of least area, which lies along a side of the hull; (0, 0) for a degenerate shape."""
    h = hull(points)
    if len(h) < 3:
        return 0.0, 0.0
    step = np.roll(h, -1, axis=0) - h
    angle = np.arctan2(step[:, 1], step[:, 0])
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    u, v = c * h[:, 0] + s * h[:, 1], -s * h[:, 0] + c * h[:, 1]
    a, b = np.ptp(u, axis=1), np.ptp(v, axis=1)
    i = int(np.argmin(a * b))
    return float(max(a[i], b[i])), float(min(a[i], b[i]))


def convex_boxes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sure, long, short) of rings of one length (rings x points x 2), all at once: where a ring's points are its hull in order, it is
    sure, and its box is smallest_box's; the others are left at 0."""
    sure, long, short = np.zeros(len(p), bool), np.zeros(len(p)), np.zeros(len(p))
    if p.shape[1] < 3:
        return sure, long, short
    step = np.roll(p, -1, axis=1) - p
    after = np.roll(step, -1, axis=1)
    turn = step[..., 0] * after[..., 1] - step[..., 1] * after[..., 0]
    total = np.arctan2(turn, (step * after).sum(axis=2)).sum(axis=1)
    sure = ((turn > 0).all(axis=1) | (turn < 0).all(axis=1)) & (np.abs(np.abs(total) - 2 * np.pi) < 1e-6)
    if not sure.any():
        return sure, long, short
    h = np.where((turn[sure, :1] < 0)[..., None], p[sure, ::-1], p[sure])
    start = np.lexsort((h[..., 1], h[..., 0]), axis=1)[:, :1]  # hull() begins at the leftmost point, too
    h = np.take_along_axis(h, ((start + np.arange(h.shape[1])) % h.shape[1])[..., None], axis=1)
    step = np.roll(h, -1, axis=1) - h
    angle = np.arctan2(step[..., 1], step[..., 0])
    c, s = np.cos(angle)[..., None], np.sin(angle)[..., None]
    x, y = h[:, None, :, 0], h[:, None, :, 1]
    a, b = np.ptp(c * x + s * y, axis=2), np.ptp(-s * x + c * y, axis=2)
    i = np.argmin(a * b, axis=1)[:, None]
    a, b = np.take_along_axis(a, i, axis=1)[:, 0], np.take_along_axis(b, i, axis=1)[:, 0]
    long[sure], short[sure] = np.maximum(a, b), np.minimum(a, b)
    return sure, long, short


def shapes_of(p: np.ndarray) -> np.ndarray:
    """Area, perimeter, elongation and rectangularity of rings of one length (rings x points x 2)."""
    q = np.roll(p, -1, axis=1)
    area = np.abs((p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]).sum(axis=1)) / 2
    perimeter = np.hypot(q[..., 0] - p[..., 0], q[..., 1] - p[..., 1]).sum(axis=1)
    sure, long, short = convex_boxes(p)
    for i in np.flatnonzero(~sure):
        long[i], short[i] = smallest_box(p[i])
    box = long * short
    return np.column_stack([area, perimeter, np.divide(long, short, out=np.ones(len(p)), where=short > 0), np.divide(area, box, out=np.zeros(len(p)), where=box > 0)])


def footprint_shape(rings: DataFrame) -> DataFrame:
    """(id, area, perimeter, elongation, rectangularity) of rings (id, ring: array of struct(x, y)); degenerate shapes get 1 and 0.

    Rings of one length in a batch are worked on together; only those that aren't convex are looked at one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ring = batch.column(1)
            size = pc.fill_null(pc.list_value_length(ring), 0).to_numpy(zero_copy_only=False)
            at, flat = np.cumsum(size) - size, ring.flatten()
            points = np.column_stack([pc.struct_field(flat, [k]).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y")]).reshape(-1, 2)
            out = np.empty((len(size), 4))
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                out[rows] = shapes_of(points[at[rows][:, None] + np.arange(n)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.T.copy())], names=["id", "area", "perimeter", "elongation", "rectangularity"])

    return rings.select(F.col("id").cast("long").alias("id"), "ring").mapInArrow(run, "id long, area double, perimeter double, elongation double, rectangularity double")
