"""From circuit readings to one row per site and time stamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvgrid.functions.curves import apparent_power
from pvgrid.functions.exact import exact_avg, exact_sum, micro, micro_sum

STEPS_PER_HOUR = 12


def scrub_voltage(df: DataFrame, lo: float, hi: float, column: str = "voltage",
                  drop: bool = False) -> DataFrame:
    """Voltages outside [lo, hi] become null, or their rows are dropped."""
    inside = F.col(column).between(lo, hi)
    return df.where(inside) if drop else df.withColumn(column, F.when(inside, F.col(column)))


def voltage_bounds(v: Column, lo: float | None, hi: float | None, inclusive: bool) -> Column:
    cond = F.lit(True)
    if lo is not None:
        cond = (v >= lo) if inclusive else (v > lo)
    if hi is not None:
        cond = cond & ((v <= hi) if inclusive else (v < hi))
    return cond


def circuit_readings(ts: DataFrame, meta: DataFrame, columns: tuple[str, ...], *, v_lo=0, v_hi=300,
                     inclusive: bool = False, pv_only: bool = True,
                     meta_pv_only: bool = True) -> DataFrame:
    """Telemetry inside the voltage bounds with the chosen metadata columns.

    The metadata projection is made distinct first so that no reading is multiplied.
    No broadcast hint: the optimiser broadcasts the metadata while it is below the
    session threshold and otherwise shuffles, with skewed circuits split at run time.
    """
    cond = voltage_bounds(F.col("voltage"), v_lo, v_hi, inclusive)
    if pv_only:
        cond = cond & F.col("is_pv")
    readings = ts.where(cond).select("circuit_id", "t_stamp", "power", "energy_reactive", "voltage")
    if pv_only and meta_pv_only:
        meta = meta.where(F.col("is_pv"))
    keys = meta.select("circuit_id", "site_id", "circuit_polarity", *columns).distinct()
    return readings.join(keys, "circuit_id")


def site_power(ts: DataFrame, meta: DataFrame, *, v_lo: float | None = 0, v_hi: float | None = 300,
               inclusive: bool = False, v_agg: str = "avg", capacity: str = "max",
               cell: bool = False, scrub_after: tuple[float, float] | None = None,
               pv_only: bool = True, meta_pv_only: bool = True, tasks: int | None = None) -> DataFrame:
    """Site totals per time stamp: P_kW, Q_kvar, V, ac_capacity_kw, S_99.

    v_agg       "avg" or "max" of the circuit voltages
    capacity    "max" (one row per site and time), "avg", or "key" (capacity is part
                of the group, as in the trip and sustained-operation analyses)
    cell        keep the grid cell of the site as latitude and longitude, so that later
                joins with the grid need no further look-up by site
    scrub_after bounds tested on the aggregated voltage instead of on readings
    tasks       deal the readings by site and time to so many tasks first, instead of combining them
                before the shuffle; the result is dealt the same way

    Totals are exact to 1e-6 W. The shuffle key is (site, time), so a site holding a
    large share of the readings is spread over all tasks and combined before the
    shuffle. Few readings share a site and time, so combining first keeps nearly as many
    groups as readings in memory, of as much input as a task reads; with ``tasks`` a task
    holds the groups of its own share only.
    """
    where = ("n_lat", "n_long") if cell else ()
    rows = circuit_readings(ts, meta, ("ac_capacity_kw", "S_99", *where), v_lo=v_lo, v_hi=v_hi,
                            inclusive=inclusive, pv_only=pv_only, meta_pv_only=meta_pv_only)
    pol = F.col("circuit_polarity")
    keys = ["site_id", "t_stamp"] + (["ac_capacity_kw"] if capacity == "key" else [])
    place = []
    if cell:
        rows = rows.withColumnsRenamed({"n_lat": "latitude", "n_long": "longitude"})
        place = ["latitude", "longitude"]
    volts = exact_avg(F.col("voltage")) if v_agg == "avg" else F.max(micro(F.col("voltage"))) / F.lit(1e6)
    aggs = [
        exact_sum(F.col("power") * pol, 1000.0).alias("P_kW"),
        (micro_sum(F.col("energy_reactive") * pol) * STEPS_PER_HOUR / F.lit(1e9)).alias("Q_kvar"),
        volts.alias("V"),
    ]
    if capacity == "max":
        aggs.append(F.max("ac_capacity_kw").alias("ac_capacity_kw"))
    elif capacity == "avg":
        aggs.append(exact_avg(F.col("ac_capacity_kw")).alias("ac_capacity_kw"))
    aggs.append(F.max("S_99").alias("S_99"))
    if tasks:
        rows = rows.repartition(tasks, "site_id", "t_stamp")
    out = rows.groupBy(*keys, *place).agg(*aggs)
    if scrub_after is not None:
        out = out.where(F.col("V").between(*scrub_after))
    return out.select("site_id", "t_stamp", "P_kW", "Q_kvar", "V", "ac_capacity_kw", "S_99", *place)


def site_power_by_role(ts: DataFrame, meta: DataFrame, *, v_lo: float = 0, v_hi: float = 300) -> DataFrame:
    """Per site and time: V, P_pv, P_net and P_other; a role without circuits is null.

    V is the mean of the role means, so readings are first combined per role. ``_`` in
    the PV pattern is a LIKE wildcard.
    """
    rows = circuit_readings(ts, meta, ("circuit_type", "ac_capacity_kw"), v_lo=v_lo, v_hi=v_hi,
                            pv_only=False)
    role = rows.groupBy("site_id", "t_stamp", "circuit_type", "ac_capacity_kw").agg(
        micro_sum(F.col("power") * F.col("circuit_polarity")).alias("P_micro"),
        exact_avg(F.col("voltage")).alias("V"))
    is_pv = F.col("circuit_type").like("pv_%")
    is_net = F.col("circuit_type") == "ac_load_net"

    def total(cond: Column) -> Column:
        return F.try_sum(F.when(cond, F.col("P_micro"))) / F.lit(1e9)

    return role.groupBy("site_id", "t_stamp", "ac_capacity_kw").agg(
        exact_avg(F.col("V")).alias("V"),
        total(is_pv).alias("P_pv"),
        total(is_net).alias("P_net"),
        total(~is_pv & ~is_net).alias("P_other"))


def normalise(site: DataFrame, by: str = "S_99") -> DataFrame:
    """P, Q and S per unit of ``S_99`` (default) or ``ac_capacity_kw``."""
    p = F.try_divide(F.col("P_kW"), F.col(by))
    q = F.try_divide(F.col("Q_kvar"), F.col(by))
    return site.withColumns({
        "P_kw_norm": p, "Q_kvar_norm": q, "S_norm": apparent_power(p, q)})


def high_voltage(site: DataFrame, above: float = 253) -> DataFrame:
    """Rows whose site voltage, after aggregation, is above the limit."""
    return site.where(F.col("V") > above)
