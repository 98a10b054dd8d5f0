"""Registered queries: tables written by the library and read back with partition filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvgrid.operators import conformance, sequences
from pvgrid.operators.conformance import voltvar_red_columns
from pvgrid.operators.site import site_power
from pvgrid.plans import views
from pvgrid.plans.conformance_queries import (BANDS, BASE, DEVIATION, FLEX_ROWS, FLEX_SITE, RED, SITE, VOLTVAR, VOLTVAR_ROWS, VOLTWATT,
                                              VOLTWATT_DAILY, canonical_site, flex_site, voltvar)
from pvgrid.plans.estimator_queries import ALL_U, CHAIN, SOLAR_BASE, all_uncurtailed
from pvgrid.plans.registry import register
from pvgrid.plans.sql_views import with_views
from pvgrid.session import staged_name, staged_path
from pvgrid.sources.edp import EDP_SCHEMA, read_edp
from pvgrid.sources.metadata import read_address_points, site_meta
from pvgrid.sources.metrology import read_metrology
from pvgrid.sources.sinks import (continue_conformance, create_result_table, export_csv, export_parquet, register_result,
                                  write_conformance)
from pvgrid.sources.tables import update_table

VOLTWATT_SCHEMA = ("day bigint, site_id bigint, P_kW_sum double, nonconformance_voltwatt_sum double, "
                   "nonconformance_voltwatt_count bigint, total_count bigint, year bigint, month bigint")


@register("metrology_month", with_views(
    "SELECT circuit_id, t_stamp, power, energy_reactive, voltage FROM ts "
    "WHERE is_pv AND year(t_stamp) = 2024 AND month(t_stamp) = 2", views=("placed", "ts")))
def _metrology(spark, sf_dir):
    """Readings laid out by year, month and is_pv; one month of PV circuits read from them."""
    path = staged_path(spark, "metrology")
    t = F.col("t_stamp")
    write_conformance(views.ts(spark, sf_dir).withColumns({"year": F.year(t), "month": F.month(t)}), path, ("year", "month", "is_pv"))
    rows = read_metrology(spark, path, year=2024, month=2, is_pv=True)
    return rows.select("circuit_id", "t_stamp", "power", "energy_reactive", "voltage")


SITE_COLUMNS = ("state", "dnsp_name", "ac_capacity_kw")


@register("circuits_with_site", with_views(
    "SELECT c.circuit_id, c.site_id, circuit_type, s.state, s.dnsp_name, s.ac_capacity_kw FROM meta c LEFT JOIN "
    "(SELECT DISTINCT site_id, state, dnsp_name, ac_capacity_kw FROM meta JOIN supplier ON s_suppkey = site_id WHERE s_acctbal >= 0) s "
    "ON s.site_id = c.site_id", views=("meta",)))
def _circuits(spark, sf_dir):
    """Circuits next to their site's columns; sites in debt are not in the site table."""
    meta = views.meta(spark, sf_dir)
    sites = meta.join(views.in_credit(spark, sf_dir), "site_id").select("site_id", *SITE_COLUMNS).distinct()
    return site_meta(sites, meta.select("circuit_id", "site_id", "circuit_type")).select(
        "circuit_id", "site_id", "circuit_type", *SITE_COLUMNS)


@register("conformance_month", with_views(
    "SELECT site_id, t_stamp, P_kW, V, year(t_stamp) AS year, month(t_stamp) AS month FROM site "
    "WHERE year(t_stamp) = 2024 AND month(t_stamp) = 1", SITE, views=BASE))
def _conformance_month(spark, sf_dir):
    """Site rows written by month twice, the second run replacing the first; one month read back."""
    path = staged_path(spark, "conformance")
    t = F.col("t_stamp")
    rows = canonical_site(spark, sf_dir).select("site_id", "t_stamp", "P_kW", "V", F.year(t).alias("year"), F.month(t).alias("month"))
    for _ in range(2):
        write_conformance(rows, path)
    return spark.read.schema(rows.schema).parquet(path).where("year = 2024 AND month = 1")


@register("uncurtailed_table_month", with_views("SELECT * FROM all_u WHERE year = 2024 AND month = 2", *CHAIN, ALL_U, views=SOLAR_BASE))
def _uncurtailed_table(spark, sf_dir):
    """The estimates as a result table by month, sorted by site, then rebuilt from itself; one month read from it."""
    name, path = staged_name(spark, "uncurtailed"), staged_path(spark, "uncurtailed")
    table = create_result_table(all_uncurtailed(spark, sf_dir), name, ("year", "month"), ("site_id",), path=path)
    table = create_result_table(table, name, ("year", "month"), ("site_id",), path=path)
    return table.where("year = 2024 AND month = 2")


@register("voltvar_red_update", with_views("SELECT * FROM red", SITE, BANDS, DEVIATION, VOLTVAR_ROWS, VOLTVAR, RED, views=BASE))
def _red_update(spark, sf_dir):
    """Conformance as a stored table, its red columns added by an update of the stored rows."""
    name = staged_name(spark, "conformance_voltvar")
    create_result_table(voltvar(spark, sf_dir), name, ("year", "month"), ("site_id",), path=staged_path(spark, "conformance"))
    update_table(spark, name, voltvar_red_columns())
    return spark.table(name)


FLAG_COLUMNS = ("circuit_id", "site_id", "circuit_type", "ac_capacity_kw", "state")
FLAGGED = (f"SELECT {', '.join(FLAG_COLUMNS)}, site_id IN (SELECT site_id FROM fx GROUP BY site_id, day "
           "HAVING MIN(spread) < 0.004e0) AS flex_export_detected FROM meta m")


@register("flex_flag_update", with_views(FLAGGED, FLEX_SITE, FLEX_ROWS, views=BASE))
def _flag_update(spark, sf_dir):
    """Circuits stored by state; the flag of flexible export is set anew, which rewrites the states where it changes."""
    name = staged_name(spark, "meta_flagged")
    rows = views.meta(spark, sf_dir).select(*FLAG_COLUMNS, "flex_export_detected")
    create_result_table(rows, name, ("state",), ("site_id",), path=staged_path(spark, "meta"))
    sites = sequences.flex_export_sites(flex_site(spark, sf_dir)).select("site_id")
    update_table(spark, name, {"flex_export_detected": F.col("matched")}, sites, ["site_id"])
    return spark.table(name)


@register("voltwatt_new_months", with_views("SELECT * FROM vw_daily", SITE, VOLTWATT, VOLTWATT_DAILY, views=BASE))
def _new_months(spark, sf_dir):
    """Daily volt-watt conformance, continued: the months up to January first, then those that are missing."""
    path, readings = staged_path(spark, "conformance_voltwatt"), staged_path(spark, "metrology")
    t = F.col("t_stamp")
    write_conformance(views.ts(spark, sf_dir).withColumns({"year": F.year(t), "month": F.month(t)}), readings, ("year", "month", "is_pv"))
    rows = read_metrology(spark, readings)
    meta = views.meta(spark, sf_dir)
    for known in (rows.where("year < 2024 OR month = 1"), rows):
        continue_conformance(known, path, lambda part: conformance.voltwatt_conformance(site_power(part, meta)))
    return spark.read.schema(VOLTWATT_SCHEMA).parquet(path)


@register("external_table_month", with_views(
    "SELECT site_id, t_stamp, P_kW, V, year(t_stamp) AS year, month(t_stamp) AS month FROM site "
    "WHERE year(t_stamp) = 2024 AND month(t_stamp) = 3", SITE, views=BASE))
def _external(spark, sf_dir):
    """Site rows written by month and registered as an external table; one month read by name."""
    path, t = staged_path(spark, "external"), F.col("t_stamp")
    rows = canonical_site(spark, sf_dir).select("site_id", "t_stamp", "P_kW", "V", F.year(t).alias("year"), F.month(t).alias("month"))
    write_conformance(rows, path)
    return register_result(spark, staged_name(spark, "external"), path).where("year = 2024 AND month = 3")


@register("exported_circuits", with_views(
    "SELECT circuit_id, site_id, circuit_type, state, postcode, ac_capacity_kw FROM meta", views=("meta",)))
def _exports(spark, sf_dir):
    """Circuits written as CSV and as Parquet, and what both files agree on."""
    rows = views.meta(spark, sf_dir).select("circuit_id", "site_id", "circuit_type", "state", F.col("postcode").cast("bigint").alias("postcode"),
                                            "ac_capacity_kw")
    text, binary = staged_path(spark, "export-csv"), staged_path(spark, "export-parquet")
    export_csv(rows, text)
    export_parquet(rows, binary)
    read = spark.read.schema(rows.schema).option("header", True).csv(text)
    return read.intersectAll(spark.read.schema(rows.schema).parquet(binary))


@register("edp_files", with_views("SELECT * FROM edp_readings", views=("placed", "ts", "edp_readings")))
def _edp_files(spark, sf_dir):
    """The second data set as CSV files by site, read back with the declared columns."""
    rows = views.edp_readings(spark, sf_dir)
    path = staged_path(spark, "edp")
    wide = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c)
                         for c in (field.split()[0] for field in EDP_SCHEMA.split(", "))])
    wide.withColumn("file", F.col("edp_site_id")).repartition("file").write.partitionBy("file").option("header", True).csv(path)
    return read_edp(spark, f"{path}/file=*").select(*rows.columns)


@register("address_points", with_views(
    "SELECT DISTINCT latitude, longitude, point_id % 90 + 5000 AS postcode FROM locations", views=("locations",)))
def _address_points(spark, sf_dir):
    """Points and their postcodes as two piped text files, read back as one table of distinct places."""
    rows = views.locations(spark, sf_dir)
    points, details = staged_path(spark, "points"), staged_path(spark, "details")
    pid = F.concat(F.lit("P"), F.col("point_id").cast("string")).alias("STREET_LOCALITY_PID")

    def write(df, path):
        df.write.option("header", True).option("sep", "|").csv(path)

    write(rows.select(pid, F.col("longitude").alias("LONGITUDE"), F.col("latitude").alias("LATITUDE"), F.lit(None).cast("string").alias("NOTE")), points)
    write(rows.select(pid, (F.col("point_id") % 90 + 5000).alias("POSTCODE")), details)
    return read_address_points(spark, points, details).distinct()
