"""Fleet reports by manufacturer, network, install date and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvgrid.functions.curves import apparent_power, power_factor
from pvgrid.functions.exact import exact_avg, quantise, wide_avg
from pvgrid.functions.quantiles import group_quantiles
from pvgrid.operators.site import circuit_readings, site_power

# Manufacturer spellings and network operators in scope.
MANUFACTURERS = ("SolarEdge", "Fronius", "SMA", "GoodWe", "Solax", "Sungrow", "Solis", "Solaredge",
                 "Goodwe", "SolaX", "SolaX Power")
NETWORKS = ("Energex", "Ergon", "Ausgrid", "SAPN")
SPELLINGS = {"Goodwe": "GoodWe", "Solaredge": "SolarEdge", "SolaX Power": "SolaX"}


def oem_name(manufacturer: Column) -> Column:
    """Manufacturer with the known misspellings put right."""
    name = manufacturer
    for wrong, right in SPELLINGS.items():
        name = F.when(manufacturer == wrong, right).otherwise(name)
    return name


def _visible(meta: DataFrame) -> DataFrame:
    return meta.where(F.col("manufacturer").isin(*MANUFACTURERS) & F.col("dnsp_name").isin(*NETWORKS))


def oem_sites(meta: DataFrame) -> DataFrame:
    """Distinct sites with state, network and normalised manufacturer."""
    return _visible(meta).select("site_id", "state", "dnsp_name",
                                 oem_name(F.col("manufacturer")).alias("OEM")).distinct()


def oem_counts(meta: DataFrame) -> DataFrame:
    """Sites per state, network and manufacturer as spelt in the metadata."""
    return (_visible(meta).groupBy("state", "dnsp_name", "manufacturer")
            .agg(F.countDistinct("site_id").alias("n_sites")))


def oem_install_quarter_rate(conformance: DataFrame, meta: DataFrame, threshold: float = 0.1,
                             since: str = "2024-01-01") -> DataFrame:
    """Conformant and deviating sites per manufacturer and install quarter.

    A quarter is listed when at least one of its sites deviates; generic and unnamed
    manufacturers are left out. Both counts come from one conditional aggregation, so
    sites of a group are never paired with each other.
    """
    quarter = F.concat(F.year("pv_install_date").cast("string"), F.lit("-Q"),
                       F.quarter("pv_install_date").cast("string"))
    installs = (meta.where(F.col("pv_install_date") >= F.lit(since).cast("date"))
                .groupBy("site_id").agg(F.min("manufacturer").alias("OEM"),
                                        F.min(quarter).alias("install_date")))
    sites = conformance.groupBy("site_id").agg(
        F.sum("nonconformance_voltvar_red_count").alias("n"), F.sum("total_count").alias("total"))
    share = F.try_divide(F.col("n").cast("double"), F.col("total").cast("double"))
    rated = sites.join(installs, "site_id").withColumn("share", share)
    groups = rated.groupBy("OEM", "install_date").agg(
        F.count(F.when(F.col("share") <= threshold, 1)).alias("num_conf_sites"),
        F.count(F.when(F.col("share") > threshold, 1)).alias("num_nonconf_sites"))
    conf, nonconf = F.col("num_conf_sites"), F.col("num_nonconf_sites")
    return (groups.where((nonconf > 0) & (F.col("OEM") != "Generic Inverter"))
            .withColumn("nonconf_install_ratio_pct",
                        nonconf.cast("double") / (conf + nonconf).cast("double") * 100))


def state_voltage(ts: DataFrame, meta: DataFrame, v_lo: float = 180, v_hi: float = 265) -> DataFrame:
    """Daytime voltage per state: mean and 1/50/99 % of the site means per time stamp."""
    hour = F.hour("t_stamp")
    rows = circuit_readings(ts.where(hour.between(0, 6) | hour.between(22, 23)), meta, ("state",),
                            v_lo=v_lo, v_hi=v_hi, inclusive=True, meta_pv_only=False)
    site = rows.groupBy("site_id", "state", "t_stamp").agg(exact_avg(F.col("voltage")).alias("V"))
    return site.groupBy("state").agg(
        F.count("*").alias("n"), wide_avg(F.col("V")).alias("V_mean"), group_quantiles(F.col("V"), (0.01, 0.5, 0.99)).alias("_v")).select(
        "state", "n", "V_mean", *[F.get("_v", F.lit(k)).alias(name) for k, name in enumerate(("V_01", "V_50", "V_99"))])


def site_profile(ts: DataFrame, meta: DataFrame, v_lo: float = 0, v_hi: float = 300) -> DataFrame:
    """Voltage, power and power-factor profile per site.

    S_99 is the 99 % quantile of apparent power; power factors come from rows above a
    fifth of the rating with the voltage outside the 220-240 V dead band.
    """
    site = site_power(ts, meta, v_lo=v_lo, v_hi=v_hi)
    p, q, v = F.col("P_kW"), F.col("Q_kvar"), F.col("V")
    responsive = (p > F.lit(0.2) * F.col("ac_capacity_kw")) & ((v > 240) | (v < 220))
    site = site.withColumns({
        "S": apparent_power(p, q),
        "PF": F.when(responsive, quantise(power_factor(p, q)))})
    quantiles = {"S": {"S_99": 0.99}, "PF": {"pf_01": 0.01}, "V": {"v_01": 0.01, "v_05": 0.05, "v_95": 0.95, "v_99": 0.99}}
    found = site.groupBy("site_id").agg(
        *[group_quantiles(F.col(c), names.values()).alias(f"_{c}") for c, names in quantiles.items()],
        exact_avg(F.col("PF")).alias("avg_pf"),
        F.min("t_stamp").alias("min_time"), F.max("t_stamp").alias("max_time"))
    return found.select("site_id", *[F.get(f"_{c}", F.lit(k)).alias(n) for c, names in quantiles.items() for k, n in enumerate(names)],
                        "avg_pf", "min_time", "max_time")
