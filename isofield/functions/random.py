"""Random numbers that depend on nothing but their counters.

A state is (previous * 48271) mod 2147483647 over the mixed counters, in whole numbers, so that any engine gives the same and a
recomputed task draws the same again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS, FACTOR = 2147483647, 48271


def state(seed: int, *counters: Column) -> Column:
    """A whole number from 1 to 2147483646 for a seed and counters (each below 2**31)."""
    s = F.lit(seed % (MODULUS - 1) + 1).cast("bigint")
    for c in counters:
        s = F.pmod((s + F.pmod(c.cast("bigint"), F.lit(MODULUS))) * FACTOR, F.lit(MODULUS)).cast("bigint")
        s = F.pmod((s + 1) * FACTOR, F.lit(MODULUS)).cast("bigint")
    return F.greatest(s, F.lit(1).cast("bigint"))


def state_sql(seed: int, *counters: str) -> str:
    s = str(seed % (MODULUS - 1) + 1)
    for c in counters:
        s = f"((((({s}) + ({c}) % {MODULUS}) * {FACTOR}) % {MODULUS} + 1) * {FACTOR} % {MODULUS})"
    return f"greatest(({s})::BIGINT, 1)"


def uniform(seed: int, *counters: Column) -> Column:
    """A double in (0, 1)."""
    return state(seed, *counters) / float(MODULUS)
