"""Shaping of series for reports: totals, periods and energy to power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvgrid.functions.previous import with_previous


def add_total_group(df: DataFrame, time: str, group: str, totals: dict[str, Column],
                    label: str = "All") -> DataFrame:
    """Append a group with one aggregate per attribute and time."""
    total = df.groupBy(time).agg(*[e.alias(n) for n, e in totals.items()])
    rows = df.select(time, F.col(group).cast("string").alias(group), *totals)
    return rows.unionByName(total.withColumn(group, F.lit(label)).select(time, group, *totals))


def period_index(df: DataFrame, time: str, period_seconds: int, latest: int | None = None) -> DataFrame:
    """Number each row's period counted back from the latest time, which is in period 1.

    ``latest`` (seconds since 1970) saves the pass that finds the latest time.
    """
    last = df.agg(F.max(F.unix_timestamp(time))).scalar() if latest is None else F.lit(latest)
    back = (last + F.lit(period_seconds) - F.unix_timestamp(time)) / F.lit(period_seconds)
    return df.withColumn("num_periods", F.floor(back))


def period_series(df: DataFrame, time: str, group: str, attributes: tuple[str, ...],
                  period_seconds: int = 86400, latest: int | None = None) -> DataFrame:
    """Ordered lists of times and attributes per period and group.

    For site rows (one per group and time) a list is as long as a period has samples,
    288 for a day.
    """
    rows = period_index(df, time, period_seconds, latest)
    entries = F.array_sort(F.collect_list(F.struct(time, *attributes)))
    lists = rows.groupBy("num_periods", group).agg(entries.alias("_e"))
    return lists.select("num_periods", group,
                        *[F.col("_e")[c].alias(c) for c in (time, *attributes)])


def sampling_steps(df: DataFrame, group: str, time: str) -> DataFrame:
    """Most frequent step in seconds per group, and whether steps are mixed."""
    times = with_previous(df.select(group, time).distinct(), (group,), time, {"_before_time": time})
    steps = times.withColumn("step", F.unix_timestamp(time) - F.unix_timestamp("_before_time"))
    counts = steps.where(F.col("step").isNotNull()).groupBy(group, "step").agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(
        F.max_by("step", F.struct("n", -F.col("step"))).alias("step_seconds"),
        (F.count("*") > 1).alias("mixed_steps"))


def energy_to_power(df: DataFrame, group: str, time: str, attributes: tuple[str, ...],
                    to_mega: bool = False) -> DataFrame:
    """Multiply energies by the steps per hour; ``mixed_steps`` warns of uneven sampling."""
    rows = df.join(sampling_steps(df, group, time), group)
    factor = F.floor(F.lit(3600) / F.col("step_seconds"))
    scale = F.lit(1000.0 if to_mega else 1.0)
    return rows.withColumns({a: F.col(a) * factor / scale for a in attributes})
