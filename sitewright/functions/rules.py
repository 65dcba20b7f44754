"""Rules on columns: units, evidence, decisions and outcomes. Unknown stays null, with a reason where one is asked for."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What units measure; square metres etc. aren't used.
DIMENSIONS = {"t": "mass", "kt": "mass", "kW": "power", "kWh": "energy"}
#: Cubic metres a second of a cubic foot a minute; tonnes of a bushel of 60 pounds.
CFM, BUSHEL = 0.000471947443, 0.0272155422
#: How much better a challenger must be, and how much worse its calibration may be.
LEAST_GAIN, CALIBRATION_LOSS = 0.03, 0.01
#: Drivers whose uncertainty a question on volume settles, and questions by driver and by grid state.
VOLUME_DRIVERS = ("capture_share", "peak_month_fraction", "peak_factor", "type_mult", "storage_days", "operating_days", "harvest_window_days")
DRIVER_QUESTIONS = {"local_variation": "local production against the average", "max_travel_min": "how far farmers travel", "persons_per_building": "whether buildings are farming homes"}
GRID_QUESTIONS = {"grid_near": "connection size and outages", "grid_mid": "distance to a connection and plans", "grid_not_mapped": "what powers the site"}


def unit_consistent(unit: Column, dimension: Column, period: Column) -> Column:
    """Whether a unit measures its dimension; energy and flow need a period. An unlisted unit is null."""
    of = F.try_element_at(F.create_map(*[F.lit(x) for kv in DIMENSIONS.items() for x in kv]), unit)
    return (of == dimension) & (~dimension.isin("energy", "flow") | period.isNotNull())


def converted(amount: Column, unit: Column, to: Column) -> Column:
    """Tonnes and kilotonnes into one another; null for other units or a null amount."""
    factor = F.when(unit == to, 1.0).when((unit == "kt") & (to == "t"), 1000.0).when((unit == "t") & (to == "kt"), 0.001)
    return F.when(unit.isin("t", "kt") & to.isin("t", "kt"), amount * factor)


def conversion_holds(amount: Column, factor: float, result: Column, tolerance: float = 1e-12) -> Column:
    """Whether a result is the amount times the factor, up to a relative tolerance."""
    return F.abs(result - amount * factor) <= tolerance * F.abs(amount * factor)


def comparable_difference(a: Column, b: Column, *same: tuple[Column, Column]) -> Column:
    """a - b where all pairs of attributes (dimension, unit, period) are the same and known; else null, never zero."""
    ok = F.lit(True)
    for x, y in same:
        ok = ok & (x == y)
    return F.when(ok, a - b)


def checked_difference(a: Column, b: Column, *same: tuple[Column, Column]) -> Column:
    """As comparable_difference, but rows that can't be compared raise when they are read: attributes that differ or are null,
    and operands that are null."""
    alike = F.lit(True)
    for x, y in same:
        alike = alike & F.coalesce(x == y, F.lit(False))
    known = a.isNotNull() & b.isNotNull()
    fault = F.when(~alike, "dimension, unit or period differ").when(~known, "an operand is unknown")
    return F.when(alike & known, a - b).otherwise(F.raise_error(fault).cast("double"))


def airflow(cfm_per_bushel: Column, basis: Column) -> Column:
    """A struct (value, reason): cubic metres a second for a tonne where the basis is a bushel of 60 pounds."""
    known = F.coalesce(basis == "bushel_60lb", F.lit(False)) & cfm_per_bushel.isNotNull()
    why = F.when(cfm_per_bushel.isNull(), "value unknown").when(basis.isNull(), "basis unknown").when(~known, "basis differs")
    return F.struct(F.when(known, cfm_per_bushel * CFM / BUSHEL).alias("value"), why.alias("reason"))


def storage_state(value: Column) -> Column:
    """A struct (state, issue): a figure that is null, not a number or negative is unknown; zero is known, what it means isn't."""
    bad = value.isNull() | F.isnan(value) | (value < 0)
    return F.struct(F.when(bad, "unknown").when(value == 0, "unresolved").otherwise("known").alias("state"), F.when(bad, "invalid storage").when(value == 0, "zero storage").alias("issue"))


def adopted(gain: Column, low: Column, calibration_change: Column) -> Column:
    """ADOPT where the gain is large enough, all of its interval is over zero and calibration isn't worse by too much."""
    ok = (gain >= LEAST_GAIN) & (low > 0) & (calibration_change <= CALIBRATION_LOSS)
    return F.when(F.coalesce(ok, F.lit(False)), "ADOPT").otherwise("KEEP CURRENT")


def reproduced(found: Column, recorded: Column, tolerance: float) -> Column:
    """Whether a figure made again is the recorded one; an unknown figure isn't."""
    return F.coalesce(F.abs(found - recorded) <= tolerance, F.lit(False))


def prior_corrected(margin: Column, negatives: Column, positives: Column) -> Column:
    """The probability of a margin that was fitted with both classes of equal weight."""
    return 1 / (1 + F.exp(-(margin - F.log(negatives / positives))))


def question(documented: Column, driver: Column, grid: Column, coverage: Column) -> Column:
    """A struct (main, more): what to ask at a site first, and up to three further questions in order."""
    main = F.when(~documented, "whether the place exists").when(driver.isin(*VOLUME_DRIVERS), "volume")
    by_driver = F.try_element_at(F.create_map(*[F.lit(x) for kv in DRIVER_QUESTIONS.items() for x in kv]), driver)
    main = F.coalesce(main, by_driver, F.lit("volume"))
    by_grid = F.try_element_at(F.create_map(*[F.lit(x) for kv in GRID_QUESTIONS.items() for x in kv]), grid)
    more = F.array(F.when(main != "volume", "volume"), by_grid, F.when(coverage == "thin", "other places nearby"))
    return F.struct(main.alias("main"), F.slice(F.array_compact(more), 1, 3).alias("more"))


def evidence_labels(documented: Column, per_capita: Column, people: Column) -> Column:
    """A struct (location, demand): a mapped place is observed, another inferred; demand is unknown without its inputs."""
    known = per_capita.isNotNull() & people.isNotNull()
    return F.struct(F.when(documented, "OBSERVED").otherwise("INFERRED").alias("location"), F.when(known, "ESTIMATED").otherwise("UNKNOWN").alias("demand"))


def ordered_outcome(contact: Column, facts: dict[str, Column]) -> Column:
    """The outcome of a field check: the contact's status unless completed; then the first fact that is unknown or true."""
    out = F.when(contact != "completed", contact)
    for name, fact in facts.items():
        out = out.when(fact.isNull(), "unknown").when(fact, name)
    return out.otherwise("confirmed")


def wilson(k: Column, n: Column, sign: int) -> Column:
    """An end of the 95 % Wilson interval of k in n: sign -1 for the lower, 1 for the upper."""
    z2 = 1.959963984540054**2
    p = k / n
    return (p + z2 / (2 * n) + sign * math.sqrt(z2) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
