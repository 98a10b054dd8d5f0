"""Telemetry, metadata, irradiance and weather as views over the driver tables.

Every view is a row-wise projection (plus a distinct for the solar grid): no window, no
numbering, so a supplier holding a third of all lines costs nothing extra. Definitions
are plain arithmetic that DuckDB evaluates to the same values; the SQL text of the same
views is in :mod:`pvgrid.plans.sql_views`.

Layout of the readings: a line of a supplier (= site) falls into one of 1080 places:
3 circuits x 30 samples x 12 local days, six days from 1 January and six from
28 February 2024. Two lines in one place are a duplicate reading, an empty place is a
missing one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvgrid.functions.exact import exact_avg

PLACES, CIRCUITS, SAMPLES, DAYS = 1080, 3, 30, 12
START = "2023-12-31 22:00:00"
GRID_CELLS = 25

# Fixed values of the metadata views.
STATES = ("NSW", "QLD", "SA", "VIC", "WA")
NETWORKS = ("Energex", "Ergon", "Ausgrid", "SAPN", "Jemena", "CitiPower")
MAKERS = ("SolarEdge", "Fronius", "SMA", "GoodWe", "Sungrow", "Solaredge", "Goodwe", "SolaX Power",
          "SolaX", "Generic Inverter", "Enphase")


# Declared schemas: reading starts without a job that opens file footers.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: str) -> Column:
    """Element of a fixed list at a 0-based position given as SQL text."""
    listed = ", ".join(f"'{v}'" for v in values)
    return F.expr(f"element_at(array({listed}), cast({index} + 1 as int))")


def sample_time(day: Column, k: Column) -> Column:
    """Time of sample k of a day: two stretches of 75 minutes, the second eight hours later."""
    minutes = ((day + F.when(day >= 6, 52).otherwise(0)) * 1440 + k * 5
               + F.when(k >= 15, 480).otherwise(0))
    return F.timestamp_add("MINUTE", minutes.cast("int"), F.lit(START).cast("timestamp"))


def capacity(site: Column) -> Column:
    return (F.lit(4) + site % 3 * 2).cast("double")


def bell(k: Column) -> Column:
    return F.lit(1.0) - F.abs(k - 15).cast("double") / F.lit(20.0)


def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = ((F.col("l_orderkey") * 3 + F.col("l_linenumber") * 401 + F.col("l_partkey") * 7) % PLACES)
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site_id"), F.col("l_orderkey").alias("okey"), place.alias("place"),
        F.col("l_quantity").alias("q"), F.col("l_discount").alias("dsc"), F.col("l_tax").alias("tax"))
    lines = lines.withColumns({"slot": F.col("place") % CIRCUITS,
                               "tick": F.floor(F.col("place") / CIRCUITS)})
    return lines.withColumns({"d": F.floor(F.col("tick") / SAMPLES), "k": F.col("tick") % SAMPLES})


def ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings: two PV circuits (the second with reversed polarity) and one load circuit.

    Every tenth site has a flat afternoon stretch, every sixth runs at low voltage; a few
    voltages are missing, negative or far too high.
    """
    rows = placed_lines(spark, sf_dir)
    site, slot, k = F.col("site_id"), F.col("slot"), F.col("k")
    cap = capacity(site)
    sign = F.when(slot == 1, -1.0).otherwise(1.0)
    flat = (site % 10 == 0) & (k >= 20)
    pv_power = F.when(flat, cap * 450.0).otherwise(
        cap * 500.0 * bell(k) * (F.lit(0.55) + F.col("dsc") * 6.0))
    load_power = cap * 1000.0 * (F.col("dsc") * 8.0 - F.lit(0.3))
    volts = F.when(site % 6 == 0, 204.0).otherwise(236.0) + F.lit(0.6) * F.col("q")
    okey = F.col("okey")
    return rows.select(
        site.alias("device_id"),
        (site * 10 + slot).alias("circuit_id"),
        sample_time(F.col("d"), k).alias("t_stamp"),
        (slot < 2).alias("is_pv"),
        F.when(slot < 2, sign * pv_power).otherwise(load_power).alias("power"),
        (sign * cap * 1000.0 / F.lit(24.0) * (F.lit(0.2) - F.col("tax") * 10.0)).alias("energy_reactive"),
        F.when(okey % 83 == 0, F.lit(None).cast("double")).when(okey % 89 == 0, -5.0)
        .when(okey % 97 == 0, 310.0).otherwise(volts).alias("voltage"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per circuit with the enriched site columns."""
    s = F.col("s_suppkey")
    nation = F.col("s_nationkey")
    rows = table(spark, sf_dir, "supplier").withColumn(
        "slot", F.explode(F.array(*[F.lit(i) for i in range(CIRCUITS)])))
    slot = F.col("slot")
    load = F.when(s % 4 == 0, "load_hot_water").otherwise("ac_load_net")
    pv = F.when(s % 2 == 0, "pv_site_net").otherwise("pv_inverter")
    install = F.date_add(F.lit("2023-10-01").cast("date"), (s % 40 * 20).cast("int"))
    return rows.select(
        s.alias("site_id"), s.alias("device_id"), (s * 10 + slot).alias("circuit_id"),
        F.when(slot == 1, -1).otherwise(1).alias("circuit_polarity"),
        F.when(slot < 2, pv).otherwise(load).alias("circuit_type"), (slot < 2).alias("is_pv"),
        capacity(s).alias("ac_capacity_kw"), (F.lit(0.95) * capacity(s)).alias("S_99"),
        (-(F.lit(10) + s % GRID_CELLS)).cast("double").alias("n_lat"),
        (F.lit(120) + s % GRID_CELLS).cast("double").alias("n_long"),
        pick(STATES, "s_nationkey % 5").alias("state"), pick(NETWORKS, "s_suppkey % 6").alias("dnsp_name"),
        F.when(s % 13 == 0, F.lit(None).cast("string")).otherwise(pick(MAKERS, "s_suppkey % 11")).alias("manufacturer"),
        F.when(s % 17 == 0, F.lit(None).cast("date")).otherwise(install).alias("pv_install_date"),
        F.when(s % 19 == 0, F.lit(None).cast("int")).otherwise(F.lit(2000) + nation).alias("postcode"),
        (F.lit(0.9) + (s % 10).cast("double") / F.lit(100.0)).alias("pf_01"),
        F.lit(5.0).alias("export_limit_kw"), (s % 10 == 0).alias("flex_export_detected"))


def metered_circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fleet where only sites with a large account have a load circuit, so sites differ in their number of circuits."""
    large = (table(spark, sf_dir, "supplier").where("s_acctbal >= 4500")
             .select(F.col("s_suppkey").alias("site_id"), F.lit(True).alias("large")))
    rows = meta(spark, sf_dir)
    return rows.join(large, "site_id", "left").where("is_pv OR large").select(*rows.columns)


def in_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a balance of zero or more: the sites that other tables know."""
    return table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("site_id"))


def solar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10-minute grid rows, several orders reporting the same cell and time."""
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % GRID_CELLS).alias("c"),
        ((F.col("o_orderkey") * 7 + F.floor(F.col("o_custkey") / GRID_CELLS)) % (DAYS * SAMPLES // 2)).alias("p"))
    rows = rows.withColumns({"d": F.floor(F.col("p") / 15), "k": F.col("p") % 15 * 2})
    c, d, k = F.col("c"), F.col("d"), F.col("k")
    ghi = F.lit(900.0) * bell(k) * (F.lit(0.5) + F.lit(0.05) * ((c * 7 + d * 3 + k) % 10).cast("double"))
    cloud = F.when((c + d) % 5 == 0, 0).otherwise((c + d * 5 + k % 3) % 6 + F.when(c % 5 == 4, 3).otherwise(0))
    return rows.select(
        sample_time(d, k).alias("time"),
        (-(F.lit(10) + c)).cast("double").alias("latitude"), (F.lit(120) + c).cast("double").alias("longitude"),
        F.when((c * d + k) % 37 == 0, F.lit(None).cast("double")).otherwise(ghi).alias("GHI"),
        cloud.cast("int").alias("cloud_type"), (F.lit(2000) + c).cast("int").alias("postcode"))


def edp_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same readings as the second data set lays them out: local time and energies."""
    rows = ts(spark, sf_dir)
    slot = F.col("circuit_id") % 10
    site = F.floor(F.col("circuit_id") / 10)
    sign = F.when(slot == 1, -1.0).otherwise(1.0)
    return rows.select(
        F.concat(F.lit("S"), site.cast("string")).alias("edp_site_id"),
        F.concat(F.lit("C"), slot.cast("string")).alias("edp_circuit_label"),
        F.concat(F.lit("D"), F.col("circuit_id").cast("string")).alias("edp_device_and_circuit"),
        F.when(slot < 2, "pv_site_net").otherwise("ac_load_net").alias("circuit_label"),
        F.timestamp_add("MINUTE", F.lit(630), F.col("t_stamp")).alias("datetime"),
        (sign * F.col("power") / F.lit(12.0)).alias("real_energy"),
        (sign * F.col("energy_reactive")).alias("reactive_energy"),
        (F.col("power") / F.lit(240.0)).alias("current_avg"), F.col("voltage").alias("voltage_avg"))


def quiet_spells(edp: DataFrame) -> DataFrame:
    """Site rows of the second data set with power near zero at every seventh sample."""
    quiet = F.pmod(F.unix_timestamp("time") / 300, F.lit(7)) == 0
    return edp.withColumn("active_power", F.when(quiet, F.lit(0.02)).otherwise(F.col("active_power")))


def power_gaps(edp: DataFrame) -> DataFrame:
    """Site rows of the second data set without power at two samples in five."""
    missing = F.pmod(F.unix_timestamp("time") / 300, F.lit(5)) < 2
    return edp.select("time", "edp_site_id", "postcode", F.when(~missing, F.col("active_power")).alias("active_power"), "voltage_avg")


def edp_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inverters per site, some without a count; two sites in three are in SA."""
    s = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").withColumn("unit", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(
        F.concat(F.lit("S"), s.cast("string")).alias("edp_site_id"),
        F.when(s % 3 == 0, "VIC").otherwise("SA").alias("state"),
        (F.lit(1) + s % 3).cast("double").alias("inverter_ac_rating_kw"),
        F.when((s + F.col("unit")) % 4 == 0, F.lit(None).cast("int")).otherwise((1 + s % 2).cast("int")).alias("inverter_count"))


def edp_postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(
        F.concat(F.lit("S"), s.cast("string")).alias("edp_site_id"),
        (F.lit(5000) + F.col("s_nationkey")).cast("int").alias("postcode"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per customer; positions in sixteenths of a degree, some shared."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        c.alias("point_id"),
        (F.lit(-40.0) + (c * 37 % 400).cast("double") / F.lit(16.0)).alias("latitude"),
        (F.lit(115.0) + (c * 91 % 560).cast("double") / F.lit(16.0)).alias("longitude"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weather station per supplier, every third one inside a small crowded area."""
    s = F.col("s_suppkey")
    crowded = s % 3 == 0
    return table(spark, sf_dir, "supplier").select(
        s.alias("station_number"),
        F.when(crowded, F.lit(-33.0) + (s * 7 % 64).cast("double") / F.lit(1024.0))
        .otherwise(F.lit(-40.0) + (s * 53 % 200).cast("double") / F.lit(8.0)).alias("latitude"),
        F.when(crowded, F.lit(151.0) + (s * 11 % 64).cast("double") / F.lit(1024.0))
        .otherwise(F.lit(115.0) + (s * 29 % 280).cast("double") / F.lit(8.0)).alias("longitude"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle, a triangle, and a square with a hole and an island per nation; a row per ring."""
    n = F.col("n_nationkey")
    x0 = (F.lit(115.0) + (n * 7 % 25).cast("double") + F.lit(0.25))
    y0 = (F.lit(-40.0) + (n % 25).cast("double") + F.lit(0.25))

    def ring(*offsets: tuple[float, float]) -> Column:
        return F.array(*[F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y")) for dx, dy in offsets])

    rows = table(spark, sf_dir, "nation")
    rect = rows.select((n * 3).cast("bigint").alias("region_id"),
                       ring((0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)).alias("vertices"))
    tri = rows.select((n * 3 + 1).cast("bigint").alias("region_id"),
                      ring((4.0, 0.0), (6.0, 0.0), (4.0, 2.0)).alias("vertices"))
    parts = (ring((8.0, 0.0), (11.0, 0.0), (11.0, 3.0), (8.0, 3.0)), ring((9.0, 1.0), (9.0, 2.0), (10.0, 2.0), (10.0, 1.0)),
             ring((12.0, 0.0), (13.0, 0.0), (13.0, 1.0), (12.0, 1.0)))
    several = rows.select((n * 3 + 2).cast("bigint").alias("region_id"), F.explode(F.array(*parts)).alias("vertices"))
    return rect.unionByName(tri).unionByName(several)


def air_temperature(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    """Hourly readings of one of two state tables, one reading per order."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    minutes = (k * 60 % 525600).cast("int")
    return table(spark, sf_dir, "orders").where(k % 2 == parity).select(
        (cust % 40).alias("station_number"),
        F.timestamp_add("MINUTE", minutes, F.lit("2024-01-01").cast("timestamp")).alias("datetime"),
        (F.lit(10.0) + (k * 13 % 300).cast("double") / F.lit(10.0)).alias("air_temperature_in_degrees_c"))


def site_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        s.alias("site_id"), (s % 40).alias("station_1"), ((s + 7) % 40).alias("station_2"),
        ((s + 15) % 40).alias("station_3"))


def daily_ghi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irradiance per station and half hour: a daily ramp, disturbed by the event stream on odd days."""
    step = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 1800) * 1800)
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("station"), step.alias("time"), "value")
    noise = rows.groupBy("station", "time").agg(exact_avg(F.col("value")).alias("noise"))
    half_hour = F.floor((F.unix_timestamp("time") % 86400) / 1800)
    calm = F.dayofmonth("time") % 2 == 0
    return noise.select(
        "station", "time", F.to_date("time").alias("date"),
        (F.lit(200.0) + (F.lit(24) - F.abs(half_hour - 24)) * F.lit(20.0)
         + F.col("noise") * F.when(calm, 0.05).otherwise(1.0)).alias("ghi_mean"))


def clear_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual labels per station and day of the event stream."""
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("station"), F.to_date("ts").alias("date")).distinct()
    n = F.dayofmonth("date") + F.col("station")
    return rows.select("station", "date", (n % 3 == 0).alias("is_clear"), (n % 5 == 0).alias("unsure"))
