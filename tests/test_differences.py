"""Differences of quantities that must be comparable."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitewright.functions.rules import checked_difference

KIND = "a double, b double, ua string, ub string"


def difference(spark, *rows):
    same = (F.col("ua"), F.col("ub"))
    return [r[0] for r in spark.createDataFrame(rows, KIND).select(checked_difference(F.col("a"), F.col("b"), same)).collect()]


def test_comparable_rows(spark):
    assert difference(spark, (5.0, 7.5, "t", "t"), (1.0, 1.0, "kg", "kg")) == [-2.5, 0.0]
    assert difference(spark) == []


@pytest.mark.parametrize("row, why", [((5.0, 1.0, "t", "kg"), "differ"), ((5.0, 1.0, None, None), "differ"), ((None, 1.0, "t", "t"), "unknown"), ((1.0, None, "t", "t"), "unknown"), ((None, None, "t", "kg"), "differ")])
def test_others_raise(spark, row, why):
    with pytest.raises(Exception, match=why):
        difference(spark, (2.0, 1.0, "t", "t"), row)
