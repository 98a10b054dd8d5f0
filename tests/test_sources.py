from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pvgrid.sources import edp, metadata, metrology, sinks


@pytest.fixture(scope="module")
def telemetry_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("telemetry") / "ts")
    names = [c.split()[0] for c in metrology.TELEMETRY_SCHEMA.split(", ")]
    rows = spark.range(48).select(
        *[F.col("id").cast("double").alias(n) if n not in ("device_id", "circuit_id", "t_stamp")
          else (F.col("id") if n != "t_stamp" else F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")).alias(n)
          for n in names],
        (F.lit(2024) + F.col("id") % 2).cast("int").alias("year"),
        (F.col("id") % 3 + 1).cast("int").alias("month"), (F.col("id") % 4 < 3).alias("is_pv"))
    rows.write.partitionBy("year", "month", "is_pv").parquet(path)
    return path


def test_partition_filters_prune_files(spark, telemetry_path):
    df = metrology.read_metrology(spark, telemetry_path, year=2024, month=[1, 2], is_pv=True)
    assert df.count() == sum(1 for i in range(48) if i % 2 == 0 and i % 3 in (0, 1) and i % 4 < 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    filters = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "year#" in filters and "month#" in filters and "is_pv#" in filters
    assert "DataFilters: []" in scan


def test_recursive_scan_has_no_partition_columns(spark, telemetry_path):
    df = metrology.read_metrology(spark, telemetry_path, recursive=True)
    assert df.count() == 48 and "month" not in df.columns
    with pytest.raises(ValueError):
        metrology.read_metrology(spark, telemetry_path, year=2024, recursive=True)


def test_site_meta_keeps_circuits_without_site(spark):
    circuits = spark.createDataFrame([(1, 10), (2, 20)], "site_id bigint, circuit_id bigint")
    sites = spark.createDataFrame([(1, "NSW")], "site_id bigint, state string")
    rows = metadata.site_meta(sites, circuits).orderBy("circuit_id").collect()
    assert [(r.circuit_id, r.state) for r in rows] == [(10, "NSW"), (20, None)]


def test_read_edp_reads_all_site_files(spark, tmp_path):
    header = ("edp_site_id,edp_circuit_label,edp_device_and_circuit,circuit_label,datetime,real_energy,"
              "reactive_energy,current_avg,current_min,current_max,voltage_avg,voltage_min,voltage_max\n")
    line = "{s},C,D,pv_site_net,2023-01-01 10:00:00,1.5,0.5,1,0,2,240,239,241\n"
    (tmp_path / "SA_site_edp_2023_S1.csv").write_text(header + line.format(s="S1"))
    (tmp_path / "SA_site_edp_2023_S2.csv").write_text(header + line.format(s="S2") * 2)
    (tmp_path / "SA_site_edp_2023_S3.csv").write_text("")
    df = edp.read_edp(spark, f"{tmp_path}/SA_site_edp_2023_S*.csv")
    assert {r.edp_site_id: r["count"] for r in df.groupBy("edp_site_id").count().collect()} == {"S1": 1, "S2": 2}


def test_read_address_points(spark, tmp_path):
    (tmp_path / "points.psv").write_text(
        "STREET_LOCALITY_PID|LONGITUDE|LATITUDE|NOTE\nA|138.5|-34.9|\nB|138.6|-34.8|x\nC|138.7|-34.7|y\n")
    (tmp_path / "details.psv").write_text(
        "STREET_LOCALITY_PID|POSTCODE|FLAT\nA|5000|\nA|5000|1\nA|5001|2\nB|5002|3\n")
    rows = metadata.read_address_points(spark, str(tmp_path / "points.psv"), str(tmp_path / "details.psv"))
    assert sorted((r.latitude, r.longitude, r.postcode) for r in rows.collect()) == [
        (-34.9, 138.5, 5000), (-34.9, 138.5, 5001), (-34.8, 138.6, 5002)]


def test_columns_with_nulls_are_dropped(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "i int, s string, t string")
    assert metadata.without_null_columns(df).columns == ["i", "t"]


def result(spark, value, months=(1, 2)):
    return spark.createDataFrame([(2024, m, s, float(value)) for m in months for s in range(5)],
                                 "year int, month int, site_id bigint, v double")


def test_monthly_write_replaces_only_its_months(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_conformance(result(spark, 1), path)
    sinks.write_conformance(result(spark, 2, months=(2,)), path)
    sinks.write_conformance(result(spark, 2, months=(2,)), path)
    got = {(r.month, r.v): r["count"] for r in spark.read.parquet(path).groupBy("month", "v").count().collect()}
    assert got == {(1, 1.0): 5, (2, 2.0): 5}


def test_managed_and_external_tables(spark, tmp_path):
    table = sinks.create_result_table(result(spark, 1), "conf_managed", ["year", "month"], ["site_id"])
    assert table.count() == 10
    assert sinks.create_result_table(result(spark, 3, (4,)), "conf_managed", ["year"], ["site_id"]).count() == 5
    path = str(tmp_path / "ext")
    sinks.write_conformance(result(spark, 1), path)
    assert sinks.register_result(spark, "conf_external", path).where("month = 2").count() == 5
    spark.sql("DROP TABLE conf_managed")
    spark.sql("DROP TABLE conf_external")


def test_exports(spark, tmp_path):
    sinks.export_csv(result(spark, 1), str(tmp_path / "csv"))
    sinks.export_parquet(result(spark, 1), str(tmp_path / "parquet"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 10
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 10


def test_with_flag(spark):
    df = sinks.with_flag(result(spark, 1), "early", F.col("month") == 1)
    assert df.where("early").count() == 5


HEADER = ("edp_site_id,edp_circuit_label,edp_device_and_circuit,circuit_label,datetime,real_energy,"
          "reactive_energy,current_avg,current_min,current_max,voltage_avg,voltage_min,voltage_max")
GOOD = "{s},C,D,pv_site_net,2023-01-01 10:{m:02d}:00,1.5,0.5,1,0,2,240,239,241"


def test_broken_lines_are_set_aside(spark, tmp_path):
    def write(site, lines):
        (tmp_path / f"{site}.csv").write_text("\n".join(lines) + "\n" if lines else "")

    write("S1", [HEADER] + [GOOD.format(s="S1", m=m) for m in range(30)])
    write("S2", [])                                                                     # empty
    write("S3", [HEADER])                                                               # no rows
    turned = [",".join(reversed(x.split(","))) for x in (HEADER, GOOD.format(s="S4", m=1), GOOD.format(s="S4", m=2))]
    write("S4", turned)                                                                 # columns in another order
    cut, text, wide = GOOD.format(s="S5", m=1)[:40], GOOD.format(s="S5", m=2).replace("240", "x40"), GOOD.format(s="S5", m=3) + ",9"
    write("S5", [HEADER, cut, text, GOOD.format(s="S5", m=4), wide, ""])
    write("S6", ["a,b,c", "1,2,3"])                                                     # not such a file
    found = edp.read_edp_checked(spark, f"{tmp_path}/*.csv", max_broken=0.2)
    assert {r.edp_site_id: r["count"] for r in found.rows.groupBy("edp_site_id").count().collect()} == {"S1": 30, "S4": 2, "S5": 1}
    assert found.rows.where("edp_site_id = 'S4' AND voltage_avg = 240 AND real_energy = 1.5 AND minute(datetime) IN (1, 2)").count() == 2
    assert sorted(r.line for r in found.broken.collect()) == sorted([cut, text, wide, "a,b,c", "1,2,3"])
    report = {r.file[-6:-4]: (r.n_rows, r.n_broken) for r in found.report.collect()}
    assert report == {"S1": (30, 0), "S4": (2, 0), "S5": (1, 3), "S6": (0, 2)}
    with pytest.raises(ValueError, match="5 of 38 lines are broken.*S5.csv"):
        edp.read_edp_checked(spark, f"{tmp_path}/*.csv")
    assert edp.read_edp_checked(spark, f"{tmp_path}/S2.csv").rows.count() == 0
