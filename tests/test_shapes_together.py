"""Shapes of many rings at once against one ring after another."""

import numpy as np
import pytest

from sitewright.operators import shapes


def test_rings_together_as_one_by_one():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 8):
        angle = np.sort(rng.uniform(0, 2 * np.pi, (40, n)), axis=1)
        convex = np.stack([7 * np.cos(angle), 3 * np.sin(angle)], axis=2)
        rings = np.concatenate([convex, convex[:, ::-1], rng.uniform(0, 9, (40, n, 2)), rng.integers(0, 3, (40, n, 2)).astype(float)])
        sure, long, short = shapes.convex_boxes(rings)
        want = np.array([shapes.smallest_box(r) for r in rings]).reshape(-1, 2)
        assert np.allclose(long[sure], want[sure, 0]) and np.allclose(short[sure], want[sure, 1])
        assert n < 3 or sure[:80].mean() > 0.9


def test_convex_rings_are_not_looked_at_one_by_one(monkeypatch):
    monkeypatch.setattr(shapes, "smallest_box", lambda _: pytest.fail("one ring at a time"))
    box = np.array([[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]])
    assert np.allclose(shapes.shapes_of(np.stack([box, box[::-1]])), [[8, 12, 2, 1]] * 2)


def test_pentagram_is_not_taken_for_convex():
    a = np.arange(5) * 4 * np.pi / 5
    star = np.stack([np.cos(a), np.sin(a)], axis=1)[None]
    assert not shapes.convex_boxes(star)[0].any()
