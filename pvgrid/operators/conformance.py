"""Volt-watt and volt-var conformance per site and day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvgrid.functions.curves import TOLERANCE, apparent_power, voltwatt_limit
from pvgrid.functions.exact import count_positive, exact_sum, rounded_sum, strict_greatest, strict_least
from pvgrid.functions.localtime import calendar, day_night
from pvgrid.operators.response import response_bands
from pvgrid.operators.site import high_voltage

# Impact limits between the volt-var classes.
IMPACT_LIMITS = (-0.1, 0.1, 0.9, 1.1)
VOLTVAR_CLASSES = ("Q_adverse", "Q_inactive", "Q_minor_deviation", "Q_major_deficit", "Q_major_surplus")
RED_CLASSES = ("Q_adverse", "Q_inactive", "Q_major_deficit")


def _voltwatt_rows(site: DataFrame, tolerance: float) -> DataFrame:
    s = F.col("ac_capacity_kw")
    limit = voltwatt_limit(F.col("V"), s) + F.lit(tolerance) * s
    return (high_voltage(site)
            .withColumn("P_limit", limit)
            .withColumn("excess", strict_greatest(F.lit(0.0), F.col("P_kW") - F.col("P_limit"))))


def voltwatt_conformance(site: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Daily sum and count of power above the volt-watt limit while V > 253."""
    rows = _voltwatt_rows(site, tolerance).withColumns(calendar(F.col("t_stamp")))
    return rows.groupBy("year", "month", "day", "site_id").agg(
        exact_sum(F.col("P_kW")).alias("P_kW_sum"),
        exact_sum(F.col("excess")).alias("nonconformance_voltwatt_sum"),
        count_positive(F.col("excess")).alias("nonconformance_voltwatt_count"),
        F.count("excess").alias("total_count"))


def _with_uncurtailed(site: DataFrame, uncurtailed: DataFrame) -> DataFrame:
    return site.join(uncurtailed.select("site_id", "t_stamp", "uncurtailed_P"),
                     ["site_id", "t_stamp"], "left")


def _voltwatt_tested(site: DataFrame, uncurtailed: DataFrame, tolerance: float) -> DataFrame:
    rows = _with_uncurtailed(_voltwatt_rows(site, tolerance), uncurtailed)
    u = F.col("uncurtailed_P")
    return rows.withColumns({
        "tested": (u > F.col("P_limit")) | u.isNull(),
        "curtailed": (u > F.col("P_limit")) & (F.col("P_kW") < F.col("P_limit")),
    })


def voltwatt_conformance_ghi(site: DataFrame, uncurtailed: DataFrame,
                             tolerance: float = TOLERANCE) -> DataFrame:
    """Volt-watt conformance counting only rows where the response could be tested.

    A row whose estimated uncurtailed power stays under the limit says nothing about
    the inverter: its excess is null and it does not enter ``total_count``.
    """
    rows = _voltwatt_tested(site, uncurtailed, tolerance).withColumns({
        "nonconf": F.when(F.col("tested"), F.col("excess")),
        "curtailment": F.when(F.col("curtailed"), F.col("uncurtailed_P") - F.col("P_kW")),
        **calendar(F.col("t_stamp"))})
    return rows.groupBy("year", "month", "day", "site_id").agg(
        exact_sum(F.col("P_kW")).alias("P_kW_sum"),
        exact_sum(F.col("nonconf")).alias("nonconformance_voltwattghi_sum"),
        rounded_sum(F.col("curtailment")).alias("curtailment_voltwattghi_sum"),
        count_positive(F.col("nonconf")).alias("nonconformance_voltwattghi_count"),
        count_positive(F.col("curtailment")).alias("curtailment_voltwattghi_count"),
        F.count("nonconf").alias("total_count"))


def voltwatt_low_irradiance_rows(site: DataFrame, uncurtailed: DataFrame,
                                 tolerance: float = TOLERANCE) -> DataFrame:
    """High-voltage rows without excess where even uncurtailed power is under the limit."""
    rows = _with_uncurtailed(_voltwatt_rows(site, tolerance), uncurtailed)
    return (rows.where((F.col("uncurtailed_P") < F.col("P_limit")) & (F.col("excess") == 0))
            .select("site_id", "t_stamp", "P_kW", "uncurtailed_P", "V", "ac_capacity_kw", "P_limit"))


def voltwatt_curtailment(site: DataFrame, uncurtailed: DataFrame,
                         tolerance: float = TOLERANCE) -> DataFrame:
    """Excess and curtailed power over tested rows only; no curtailment counts as 0."""
    rows = _voltwatt_tested(site, uncurtailed, tolerance).where("tested").withColumns({
        "curtailment": F.when(F.col("curtailed"), F.col("uncurtailed_P") - F.col("P_kW")).otherwise(F.lit(0.0)),
        **calendar(F.col("t_stamp"))})
    return rows.groupBy("year", "month", "day", "site_id").agg(
        exact_sum(F.col("excess")).alias("nonconformance_voltwattghi_sum"),
        rounded_sum(F.col("curtailment")).alias("curtailment_voltwattghi_sum"),
        count_positive(F.col("excess")).alias("nonconformance_voltwattghi_count"),
        count_positive(F.col("curtailment")).alias("curtailment_voltwattghi_count"),
        F.count("excess").alias("total_count"))


def _total(names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(n) for n in names])


def voltvar_deviation(site: DataFrame, tolerance: float = TOLERANCE,
                      surplus_is_nonconformant: bool = True) -> DataFrame:
    """Response bands plus the five deviation classes and their sum ``deviation``.

    Every row outside the band falls in exactly one class by its impact; the class
    holds the distance to the nearer bound. With ``surplus_is_nonconformant=False``
    rows above the surplus limit count as conformant.
    """
    rows = response_bands(site, tolerance)
    q, lo, hi, impact = (F.col(c) for c in ("Q_kvar", "Q_min", "Q_max", "Q_impact"))
    l1, l2, l3, l4 = IMPACT_LIMITS
    inside = {
        "Q_adverse": impact < l1,
        "Q_inactive": (impact >= l1) & (impact <= l2),
        "Q_minor_deviation": (impact > l2) & (impact < l3),
        "Q_major_deficit": (impact >= l3) & (impact <= l4),
        "Q_major_surplus": (impact > l4) & F.lit(surplus_is_nonconformant),
    }
    rows = rows.withColumns({
        "outside": (q < lo) | (q > hi),
        "distance": strict_least(F.abs(q - lo), F.abs(q - hi))})
    rows = rows.withColumns({
        name: F.when(F.col("outside") & cond, F.col("distance")).otherwise(F.lit(0.0))
        for name, cond in inside.items()})
    return rows.withColumn("deviation", _total(VOLTVAR_CLASSES))


def voltvar_curtailment(p: Column, q: Column, v: Column, s_99: Column, uncurtailed: Column,
                        voltwatt_v: float = 253) -> Column:
    """Power lost to reactive duty: the inverter is at its rating below the volt-watt range."""
    return F.when((v <= voltwatt_v) & (apparent_power(p, q) >= s_99), uncurtailed - p)


def voltvar_conformance(site: DataFrame, uncurtailed: DataFrame | None = None,
                        tolerance: float = TOLERANCE, day_rule: str = "utc_20_7") -> DataFrame:
    """Daily deviation sums and counts by class, split into day and night."""
    rows = voltvar_deviation(site, tolerance)
    if uncurtailed is None:
        rows = rows.withColumn("uncurtailed_P", F.lit(None).cast("double"))
    else:
        rows = _with_uncurtailed(rows, uncurtailed)
    rows = rows.withColumns({
        "curtailment_voltvar": voltvar_curtailment(
            F.col("P_kW"), F.col("Q_kvar"), F.col("V"), F.col("S_99"), F.col("uncurtailed_P")),
        "day_night": day_night(F.col("t_stamp"), day_rule),
        "nonconformance_voltvar": F.col("deviation"),
        **calendar(F.col("t_stamp"))})
    measures = ("nonconformance_voltvar", *VOLTVAR_CLASSES)
    return rows.groupBy("year", "month", "day", "day_night", "site_id").agg(
        exact_sum(F.col("P_kW")).alias("P_kW_sum"),
        *[exact_sum(F.col(m)).alias(f"{m}_sum") for m in measures],
        rounded_sum(F.col("curtailment_voltvar")).alias("curtailment_voltvar_sum"),
        *[count_positive(F.col(m)).alias(f"{m}_count") for m in (*measures, "curtailment_voltvar")],
        F.count("nonconformance_voltvar").alias("total_count"))


def voltvar_red_columns() -> dict[str, Column]:
    """Sum and count of the classes that harm the grid, of daily conformance rows."""
    return {f"nonconformance_voltvar_red_{kind}": _total(tuple(f"{c}_{kind}" for c in RED_CLASSES)) for kind in ("sum", "count")}


def voltvar_red(conformance: DataFrame) -> DataFrame:
    """Add sum and count of the classes that harm the grid."""
    return conformance.withColumns(voltvar_red_columns())


def _directions() -> dict[str, Column]:
    q, lo, hi = F.col("Q_kvar"), F.col("Q_min"), F.col("Q_max")
    return {
        "extra_absorb": F.when((q < 0) & (q < lo), lo - q),
        "deficit_absorb": F.when((q < 0) & (q > hi), q - hi),
        "extra_supply": F.when((q > 0) & (q > hi), q - hi),
        "deficit_supply": F.when((q > 0) & (q < lo), lo - q),
    }


def _class_report(rows: DataFrame, names: list[str], day_rule: str) -> DataFrame:
    rows = rows.withColumn("noncompliance_voltvar", _total(tuple(names)))
    rows = rows.withColumns({"day_night": day_night(F.col("t_stamp"), day_rule),
                             **calendar(F.col("t_stamp"))})
    return rows.groupBy("year", "month", "day", "day_night", "site_id").agg(
        count_positive(F.col("noncompliance_voltvar")).alias("noncompliance_voltvar_count"),
        exact_sum(F.col("noncompliance_voltvar")).alias("noncompliance_voltvar_sum"),
        *[exact_sum(F.col(n)).alias(f"Q_{n}") for n in names],
        *[count_positive(F.col(n)).alias(f"Q_{n}_count") for n in names],
        F.count("noncompliance_voltvar").alias("total_count"))


def voltvar_direction_classes(site: DataFrame, tolerance: float = TOLERANCE,
                              day_rule: str = "local_9_16") -> DataFrame:
    """Deviation split by direction: extra or deficit, absorbing or supplying."""
    parts = {n: F.coalesce(c, F.lit(0.0)) for n, c in _directions().items()}
    return _class_report(response_bands(site, tolerance).withColumns(parts), list(parts), day_rule)


def voltvar_direction_severity_classes(site: DataFrame, tolerance: float = TOLERANCE,
                                       adverse: float = -0.5, beneficial: float = 1.25,
                                       day_rule: str = "local_9_16") -> DataFrame:
    """Direction classes split again by impact: adverse or beneficial, high or low."""
    impact = F.col("Q_impact")
    severity = {
        "adv_high": impact < adverse,
        "adv_low": (impact >= adverse) & (impact < 0),
        "ben_low": (impact >= 0) & (impact < beneficial),
        "ben_high": impact >= beneficial,
    }
    parts = {f"{direction}_{level}": F.when(cond, amount).otherwise(F.lit(0.0))
             for direction, amount in _directions().items() for level, cond in severity.items()}
    parts = {n: F.coalesce(c, F.lit(0.0)) for n, c in parts.items()}
    return _class_report(response_bands(site, tolerance).withColumns(parts), list(parts), day_rule)


def conformant_site_count(conformance: DataFrame, prefix: str = "nonconformance_voltvar",
                          threshold: float = 0.1) -> DataFrame:
    """Number of sites whose share of deviating rows is at most ``threshold``."""
    site = conformance.groupBy("site_id").agg(
        F.sum(f"{prefix}_count").alias("n"), F.sum("total_count").alias("total"))
    share = F.try_divide(F.col("n").cast("double"), F.col("total").cast("double"))
    return site.where(share <= threshold).agg(F.count("*").alias("n_sites"))


def fully_conformant_days(conformance: DataFrame, count_column: str, min_rows: int = 5) -> DataFrame:
    """Site-days with more than ``min_rows`` observations and no deviation."""
    return conformance.where((F.col("total_count") > min_rows) & (F.col(count_column) == 0))
