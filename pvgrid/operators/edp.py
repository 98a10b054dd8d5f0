"""Second data set: conformance of site CSVs, trip events, gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvgrid.functions.curves import apparent_power, voltvar_q, voltwatt_limit
from pvgrid.functions.exact import exact_avg, exact_sum, micro_sum, strict_greatest
from pvgrid.functions.previous import with_previous
from pvgrid.session import stage


def edp_site_rating(sites: DataFrame, postcodes: DataFrame, state: str = "SA") -> DataFrame:
    """Rating per site and postcode: inverter rating times count, summed over inverters."""
    rows = (sites.where(F.col("state") == state)
            .join(postcodes.select("edp_site_id", "postcode"), "edp_site_id", "left"))
    rating = F.col("inverter_ac_rating_kw") * F.coalesce(F.col("inverter_count"), F.lit(1))
    return (rows.where(F.col("postcode").isNotNull()).groupBy("edp_site_id", "postcode")
            .agg(exact_sum(rating).alias("Srated")))


def _set_point(v: Column, s: Column, missing_voltage: str) -> Column:
    if missing_voltage == "null":
        return voltvar_q(v, s)
    if missing_voltage == "absorb":
        return F.when(v.isNull(), s * F.lit(-0.6)).otherwise(voltvar_q(v, s))
    raise ValueError(f"unknown treatment {missing_voltage!r}")


def process_edp(readings: DataFrame, ratings: DataFrame, offset_minutes: int = 570,
                band: float = 0.05, missing_voltage: str = "null") -> DataFrame:
    """Site rows with power, limits and deviations; local times become UTC.

    ``missing_voltage`` says what the reactive set-point is without a voltage: "null"
    (unknown, so no deviation either) or "absorb" (the last step of the curve, -0.6 S, where
    comparisons that all fail end; such rows then count as deviating).

    P_noncomp is the power above the volt-watt limit, Q_noncomp the distance between the
    set-point error and the band (positive inside the band too). ``wrong_on_maxP`` marks
    sites that ever exceed their rating. Rows without rating or postcode are left out.
    """
    volts = F.when(F.col("voltage_avg") <= 300, F.col("voltage_avg"))
    rows = (readings.where(F.col("circuit_label") == "pv_site_net")
            .withColumns({"voltage_avg": volts,
                          "time": F.timestamp_add("MINUTE", F.lit(-offset_minutes), F.col("datetime"))})
            .join(ratings, "edp_site_id"))
    site = rows.groupBy("time", "edp_site_id", "postcode", "Srated").agg(
        (F.coalesce(micro_sum(F.col("real_energy")), F.lit(0)) * 12 / F.lit(1e9)).alias("active_power"),
        (F.coalesce(micro_sum(F.col("reactive_energy")), F.lit(0)) * 12 / F.lit(1e9)).alias("reactive_power"),
        F.coalesce(exact_sum(F.col("current_avg")), F.lit(0.0)).alias("current_avg"),
        exact_avg(F.col("voltage_avg")).alias("voltage_avg"))
    s, p, q, v = (F.col(c) for c in ("Srated", "active_power", "reactive_power", "voltage_avg"))
    site = site.withColumns({
        "apparent_power": apparent_power(p, q),
        "P_threshold": voltwatt_limit(v, s),
        "Q_voltvar": _set_point(v, s, missing_voltage)})
    margin = s * F.lit(band)
    site = site.withColumns({
        "P_noncomp": strict_greatest(p - F.col("P_threshold"), F.lit(0.0)),
        "Q_voltvar_max": F.col("Q_voltvar") + margin,
        "Q_voltvar_min": F.col("Q_voltvar") - margin,
        "Q_noncomp": F.abs(F.abs(q - F.col("Q_voltvar")) - margin)})
    site = stage(site, "edp-rows")  # read for the flag and for the rows
    ever = site.groupBy("edp_site_id").agg(F.max(F.col("active_power") > F.col("Srated")).alias("wrong_on_maxP"))
    return site.join(ever, "edp_site_id").select(*site.columns, "wrong_on_maxP")


def reactive_ranking(edp: DataFrame) -> DataFrame:
    """Sites by reactive deviation in kvarh, largest first."""
    return (edp.groupBy("edp_site_id").agg((exact_sum(F.col("Q_noncomp")) / 12).alias("Q_noncomp"),
                                           F.bool_or("wrong_on_maxP").alias("wrong_on_maxP"))
            .where(F.col("Q_noncomp") > 0).orderBy(F.col("Q_noncomp").desc(), "edp_site_id"))


def active_ranking(edp: DataFrame, above_v: float | None = None) -> DataFrame:
    """Sites by active deviation, over all rows or those above a voltage."""
    rows = edp if above_v is None else edp.where(F.col("voltage_avg") > above_v)
    return (rows.groupBy("edp_site_id").agg(exact_sum(F.col("P_noncomp")).alias("P_noncomp"),
                                            F.bool_or("wrong_on_maxP").alias("wrong_on_maxP"))
            .orderBy(F.col("P_noncomp").desc(), "edp_site_id"))


def trip_events(edp: DataFrame, loose: bool = False) -> DataFrame:
    """Rows where power falls to zero at high voltage.

    Rows are one per site and time. The drop is rounded half to even, as a whole kW.
    """
    rows = with_previous(edp, ("edp_site_id",), "time", {"_before_power": "active_power"})
    rows = rows.withColumn("DP", F.col("active_power") - F.col("_before_power")).drop("_before_power")
    rows = rows.withColumn("DP_r", F.bround(F.when(F.col("DP").isNotNull(), F.least(F.col("DP"), F.lit(0.0)))))
    p, v, drop = F.col("active_power"), F.col("voltage_avg"), F.col("DP_r")
    if loose:
        return rows.where((drop < -1) & (p < 0.1) & (p >= -0.05) & (v > 250))
    return rows.where((drop <= -1) & (p < 0.05) & (p >= -0.05) & (v >= 258))


def interpolate_time(df: DataFrame, keys: tuple[str, ...], time: str, values: tuple[str, ...],
                     tie: tuple[str, ...] = ()) -> DataFrame:
    """Fill the first missing value of every gap by time-weighted interpolation.

    After the last known value the fill holds it; before the first nothing is filled.
    ``keys`` name one series (postcode and site for a fleet); ``tie`` orders equal times.
    Series are cut into days: a window covers one series and day, and what a day needs from
    its neighbours (the row before it, the first known value after it) comes from a
    one-row summary per day. The input is computed once and staged.
    """
    df = stage(df.withColumn("_chunk", F.to_date(time)), "gaps")
    chunk_keys = [*keys, "_chunk"]
    order = Window.partitionBy(*chunk_keys).orderBy(time, *tie)
    backwards = (Window.partitionBy(*chunk_keys)
                 .orderBy(F.col(time).desc(), *[F.col(c).desc() for c in tie])
                 .rowsBetween(Window.unboundedPreceding, -1))
    place = F.struct(time, *tie)
    summary = {"_end_t": F.max_by(time, place)}
    for c in values:
        known = F.when(F.col(c).isNotNull(), place)
        summary[f"_end_{c}"] = F.max_by(F.struct(F.col(c)), place)
        summary[f"_first_{c}"] = F.min_by(F.struct(F.col(time).alias("t"), F.col(c).alias("v")), known)
    days = df.groupBy(*chunk_keys).agg(*[e.alias(n) for n, e in summary.items()])
    by_day = Window.partitionBy(*keys).orderBy("_chunk")
    later = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = {"_before_t": F.lag("_end_t").over(by_day)}
    for c in values:
        carried[f"_before_{c}"] = F.lag(f"_end_{c}").over(by_day)[c]
        carried[f"_after_{c}"] = F.last(f"_first_{c}", ignorenulls=True).over(later)
    days = days.select(*chunk_keys, *[e.alias(n) for n, e in carried.items()])

    windowed = {"_first_row": F.row_number().over(order) == 1, "_lag_t": F.lag(time).over(order)}
    for c in values:
        windowed[f"_lag_{c}"] = F.lag(c).over(order)
        windowed[f"_next_{c}"] = F.last(
            F.when(F.col(c).isNotNull(), F.struct(F.col(time).alias("t"), F.col(c).alias("v"))),
            ignorenulls=True).over(backwards)
    rows = df.withColumns(windowed).join(days, chunk_keys)
    first = F.col("_first_row")
    prev_t = F.when(first, F.col("_before_t")).otherwise(F.col("_lag_t"))
    filled = {}
    for c in values:
        prev = F.when(first, F.col(f"_before_{c}")).otherwise(F.col(f"_lag_{c}"))
        nxt = F.coalesce(F.col(f"_next_{c}"), F.col(f"_after_{c}"))
        seconds = F.unix_timestamp(F.col(time)) - F.unix_timestamp(prev_t)
        total = F.unix_timestamp(nxt["t"]) - F.unix_timestamp(prev_t)
        linear = prev + (nxt["v"] - prev) * F.try_divide(seconds.cast("double"), total.cast("double"))
        fill = F.when(nxt.isNull(), prev).otherwise(F.coalesce(linear, prev))
        filled[c] = F.when(F.col(c).isNull() & prev.isNotNull(), fill).otherwise(F.col(c))
    return rows.withColumns(filled).select(*[c for c in df.columns if c != "_chunk"])


def fill_with_irradiance(edp: DataFrame, irradiance: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Site rows next to their postcode's irradiance, gaps of all ``values`` filled per postcode and site.

    ``irradiance`` has one row per time and postcode; its times are coarser, so most site
    rows have none until the first one of a gap is interpolated.
    """
    joined = edp.join(irradiance, ["time", "postcode"], "left")
    return interpolate_time(joined, ("postcode", "edp_site_id"), "time", values)


def multi_circuit_sites(readings: DataFrame) -> DataFrame:
    """First reading of every PV circuit of the sites that have more than one."""
    columns = [c for c in readings.columns if c not in ("edp_site_id", "edp_circuit_label")]
    first = (readings.where(F.col("circuit_label") == "pv_site_net")
             .groupBy("edp_site_id", "edp_circuit_label")
             .agg(F.min(F.struct("datetime", *[c for c in columns if c != "datetime"])).alias("r"))
             .select("edp_site_id", "edp_circuit_label", "r.*"))
    counts = first.groupBy("edp_site_id").agg(F.count("edp_device_and_circuit").alias("count_circuits"))
    return first.join(counts.where(F.col("count_circuits") > 1), "edp_site_id")


def voltwatt_violations(edp: DataFrame) -> DataFrame:
    return edp.where((F.col("P_noncomp") > 0) & (F.col("voltage_avg") > 250))


def voltvar_violations(edp: DataFrame) -> DataFrame:
    return edp.where((F.col("Q_noncomp") > 0.2) & (F.col("voltage_avg") > 250) & (F.col("reactive_power") < -0.5))
