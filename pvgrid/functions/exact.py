"""Order-independent sums and null-propagating extremes.

A sum of doubles depends on the order in which partitions arrive, so a retried task
can move a value across a threshold. Addends are therefore counted in whole
millionths (``bigint``): sums are exact, repeatable and stay inside code generation.

Range: NaN and infinite values count as missing. A finite addend of 9.2e12 or more in
size raises an error, and a sum that leaves the range of ``bigint`` (9.2e12 again) is
null, with ANSI mode on or off; :func:`wide_sum` has no such limit on the sum. What is
below half a millionth counts as zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLION = 1e6
LIMIT = 9.2e12


def micro(x: Column) -> Column:
    """Value in whole millionths, halves rounded up; NaN and infinite values count as missing."""
    x = x.cast("double")
    size = F.abs(x)
    too_large = F.raise_error(F.concat(F.lit("value beyond 9.2e12 can't be added exactly: "), x.cast("string")))
    return (F.when(size < F.lit(LIMIT), F.floor(x * F.lit(MILLION) + F.lit(0.5)))
            .when(size < F.lit(float("inf")), too_large.cast("bigint")))


def micro_sum(x: Column) -> Column:
    """Sum in whole millionths, null beyond the range of ``bigint``."""
    return F.try_sum(micro(x))


def exact_sum(x: Column, scale: float = 1.0) -> Column:
    """Sum to six decimals, divided by ``scale``."""
    return micro_sum(x) / F.lit(MILLION * scale)


def exact_avg(x: Column) -> Column:
    """Mean of the values rounded to six decimals; null for no values."""
    return F.try_divide(micro_sum(x) / F.lit(MILLION), F.count(micro(x)))


def wide_sum(x: Column) -> Column:
    """Like :func:`exact_sum` for fleet-wide groups that could overflow a ``bigint``."""
    return F.sum(micro(x).cast("decimal(19,0)")).cast("double") / F.lit(MILLION)


def wide_avg(x: Column) -> Column:
    return F.try_divide(wide_sum(x), F.count(micro(x)))


def quantise(x: Column, digits: int = 6) -> Column:
    """Round to a number of decimals, halves up, without leaving ``double``.

    Values too large to have that many decimals are returned as they are.
    """
    scale = float(10**digits)
    scaled = x * F.lit(scale)
    return (F.when(F.abs(scaled) < F.lit(2.0**53), F.floor(scaled + F.lit(0.5)) / F.lit(scale))
            .otherwise(x))


def rounded_sum(x: Column, digits: int = 6) -> Column:
    """Sum of doubles without a known range (such as estimates), rounded at the end."""
    return quantise(F.sum(x), digits)


def _all_set(cols: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def strict_greatest(*cols: Column) -> Column:
    """Greatest value, null as soon as one input is null."""
    return F.when(_all_set(cols), F.greatest(*cols))


def strict_least(*cols: Column) -> Column:
    """Least value, null as soon as one input is null."""
    return F.when(_all_set(cols), F.least(*cols))


def count_positive(x: Column) -> Column:
    """Number of rows where the value is above zero (0, not null, for none)."""
    return F.sum(F.when(x > 0, 1).otherwise(0))
