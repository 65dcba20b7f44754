from __future__ import annotations

from sitewright.operators.welding import tile_links


def test_pieces_are_made_once(spark):
    """Making the pieces reads and joins all ways; the links must not do it again for each of their joins."""
    rows = [(1, 0, 0, 8, 0.0, 0.0, 0, False), (1, 0, 1, 9, 100.0, 0.0, 1, True), (1, 1, 0, 12, 90.0, 0.0, 0, True), (1, 1, 1, 13, 200.0, 0.0, 1, False)]
    kind = "segment long, piece int, pos int, id long, x double, y double, end int, cut boolean"
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    links = tile_links(spark.createDataFrame(rows, kind).mapInPandas(counted, kind))[1]
    assert {(r["piece"], r["end"], r["other"]) for r in links.collect()} == {(0, 1, 12), (1, 0, 9)}
    assert seen.value == len(rows)
