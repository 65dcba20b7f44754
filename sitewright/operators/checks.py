"""Checked joins and assertions over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def small_side(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def many_to_one(left: DataFrame, right: DataFrame, key: str, audit: bool = False) -> DataFrame:
    """Every left row with the one right row of its key; a repeated right key raises when rows are read.

    With audit: one row of counts instead (rows before and after, left rows without a match)."""
    once = right.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c != key])
    once = once.withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit(f"{key} is not unique on the right"))).filter("_ok IS NULL")
    joined = left.join(once.drop("_ok"), key, "left")
    if not audit:
        return joined.drop("_n")
    return joined.agg(F.count("*").alias("rows_after"), F.count_if(F.col("_n").isNull()).alias("unmatched")).crossJoin(left.agg(F.count("*").alias("rows_before")))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each left row with its right row by key; a repeated key, or one that the other side lacks, raises when rows are read.

    Null keys have no partner, so they raise too."""
    own = lambda df: [c for c in df.columns if c != key]
    side = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n), *[F.first(c).alias(c) for c in own(df)])
    both = side(left, "_a").join(side(right, "_b"), key, "full_outer")
    ok = F.coalesce((F.col("_a") == 1) & (F.col("_b") == 1), F.lit(False))
    return both.select(F.when(ok, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{key} is not one to one at "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).alias(key), *own(left), *own(right))


def against_control(universe: DataFrame, own: DataFrame, control: DataFrame, key: str, tolerance: float) -> DataFrame:
    """(key, n, total, agrees) of each key of universe: counts and totals (key, n, total) and whether the control's are the same.

    A key that either lacks doesn't agree; its own count and total are then 0."""
    c = control.select(key, F.col("n").alias("_n"), F.col("total").alias("_t"))
    ok = (F.col("n") == F.col("_n")) & (F.abs(F.col("total") - F.col("_t")) <= tolerance)
    both = universe.join(own, key, "left").join(c, key, "left")
    return both.select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce(ok, F.lit(False)).alias("agrees"))


def guarded_sum(value: Column) -> Column:
    """The sum, or null if any value is null."""
    return F.when(F.count_if(value.isNull()) == 0, F.sum(value))


def evidence(value: Column, label: str, reason: str, source: str) -> Column:
    """A value with its label and source, or null as UNKNOWN with its reason."""
    known = value.isNotNull()
    return F.struct(value.alias("value"), F.when(known, label).otherwise("UNKNOWN").alias("label"), F.when(~known, reason).alias("missing_reason"), F.when(known, F.array(F.lit(source))).otherwise(F.array().cast("array<string>")).alias("source_ids"))


def evidence_faults(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, faults): evidence structs in which value, label and reason disagree about whether the value is known."""
    parts = [F.struct(F.lit(c).alias("field"), ((F.col(f"{c}.value").isNull() != (F.col(f"{c}.label") == "UNKNOWN")) | (F.col(f"{c}.value").isNull() != F.col(f"{c}.missing_reason").isNotNull())).alias("bad")) for c in columns]
    return df.select(F.explode(F.array(*parts)).alias("e")).groupBy("e.field").agg(F.count_if("e.bad").alias("faults"))
