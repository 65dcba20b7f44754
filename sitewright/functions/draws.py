"""Seeded draws as pure functions of (seed, position), so that rows draw in parallel and in any order."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the step of the counter generator.
STEP = 0x6D2B79F5
MASK = 2**32


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once; plain nesting would repeat its expression at each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _times(a: Column, b: Column) -> Column:
    """The product of two 32-bit numbers, 32 bits kept, by halves, so that 64-bit numbers never overflow."""
    low, high = a * b.bitwiseAND(0xFFFF), (a * F.shiftright(b, 16)) % 65536
    return (low + high * 65536) % MASK


def uniform(seed: Column, k: Column) -> Column:
    """The k-th number (k from 1) of the counter generator for a seed, from 0 to under 1."""
    first = (seed.cast("long") + k.cast("long") * STEP) % MASK
    second = bound(first, lambda a: bound(a.bitwiseXOR(F.shiftright(a, 15)), lambda x: _times(x, a.bitwiseOR(F.lit(1)))))
    third = bound(second, lambda t: t.bitwiseXOR((t + bound(t.bitwiseXOR(F.shiftright(t, 7)), lambda x: _times(x, t.bitwiseOR(F.lit(61))))) % MASK))
    return bound(third, lambda t: t.bitwiseXOR(F.shiftright(t, 14)) / float(MASK))


def triangular(u: Column, low: float, mode: float, high: float) -> Column:
    """The inverse of the triangular distribution; its mode where the range is empty."""
    if high <= low:
        return F.lit(float(mode))
    cut = (mode - low) / (high - low)
    return bound(u, lambda u: F.when(u < cut, low + F.sqrt(u * ((high - low) * (mode - low)))).otherwise(high - F.sqrt((1 - u) * ((high - low) * (high - mode)))))


def normal(u: Column, v: Column) -> Column:
    return F.sqrt(-2 * F.log(u)) * F.cos(v * (2 * math.pi))


def local_factor(u: Column, v: Column, sd: Column) -> Column:
    """A lognormal factor of mean 1."""
    return F.exp(sd * normal(u, v) - sd * sd / 2)


def sql_uniform(seed: str, k: str) -> str:
    """uniform() in DuckDB's SQL."""
    times = lambda a, b: f"CAST((CAST({a} AS HUGEINT) * ({b})) % {MASK} AS BIGINT)"
    a = f"[({seed} + CAST({k} AS BIGINT) * {STEP}) % {MASK}]"
    t = f"list_transform({a}, lambda a: {times('xor(a, a >> 15)', 'a | 1')})"
    t = f"list_transform({t}, lambda t: xor(t, (t + {times('xor(t, t >> 7)', 't | 61')}) % {MASK}))"
    return f"list_transform({t}, lambda t: xor(t, t >> 14) / {MASK}.0::DOUBLE)[1]"


def uniform_of(seed: int, k: int) -> float:
    """uniform() of plain numbers, for draws of a fixed number."""
    a = (seed + k * STEP) % MASK
    t = ((a ^ (a >> 15)) * (a | 1)) % MASK
    t ^= (t + ((t ^ (t >> 7)) * (t | 61)) % MASK) % MASK
    return (t ^ (t >> 14)) / MASK
