from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitewright.operators import rank
from sitewright.plans import supply


def test_ranks_of_draws_move_only_what_is_asked(spark, monkeypatch):
    """Rows of a draw had all parameters of the model with them through the ranges."""
    seen, plain = [], rank.running_within
    monkeypatch.setattr(rank, "running_within", lambda df, *a: seen.append(df.columns) or plain(df, *a))
    x = spark.range(40).select((F.col("id") % 10).alias("site"), (F.col("id") % 10).alias("i"), F.lit("dry").alias("season"), F.floor(F.col("id") / 10).alias("draw"), (F.col("id") * 7 % 13).alias("kwh"), F.lit(1.0).alias("other"))
    got = supply.simulated(x).collect()
    assert seen == [["site", "i", "season", "draw", "kwh"]]
    for d in range(4):
        rows = sorted((r for r in got if r["draw"] == d), key=lambda r: (-r["kwh"], r["i"]))
        assert [r["r"] for r in rows] == list(range(1, 11))


def test_variance_shares_rank_nothing(spark, sf, monkeypatch):
    def fail(*_):
        raise AssertionError("no rank is asked")

    monkeypatch.setattr(rank, "ranked_within", fail)
    monkeypatch.setattr(rank, "running_within", fail)
    assert entry.queries()["sim12_variance_shares"](spark, sf).count() == 15
