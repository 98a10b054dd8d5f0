"""Stored tables: switched, updated in part, continued by month; what fails changes nothing."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pvgrid.sources import sinks, tables

COLUMNS = "year int, month int, site_id bigint, v double"


def rows(spark, value=1.0, months=(1, 2, 3), sites=6):
    return spark.createDataFrame([(2024, m, s, value * s + m) for m in months for s in range(sites)], COLUMNS)


def seen(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture
def name(spark):
    table = f"t_{os.urandom(6).hex()}"
    yield table
    spark.sql(f"DROP TABLE IF EXISTS {table}")


@pytest.mark.parametrize("partitions", [[], ["year", "month"]])
def test_a_table_is_rebuilt_from_itself(spark, tmp_path, name, partitions):
    root = str(tmp_path / "t")
    tables.replace_table(rows(spark), name, partitions, ["site_id"], root)
    before = tables._details(spark, name)["Location"]
    tables.replace_table(spark.table(name).withColumn("v", F.col("v") * 10), name, partitions, ["site_id"], root)
    assert seen(spark.table(name), "month", "site_id", "v") == seen(rows(spark).withColumn("v", F.col("v") * 10), "month", "site_id", "v")
    assert seen(spark.read.parquet(before), "v") == seen(rows(spark), "v")              # whoever reads the old files goes on
    tables.replace_table(spark.table(name).withColumn("w", F.lit("x")), name, partitions, (), root)
    assert spark.table(name).where("w = 'x' AND month = 2").count() == 6
    assert len([f for f in os.listdir(root) if "version" in f]) == 2   # this one and the one before


@pytest.mark.parametrize("partitions", [[], ["month"]])
def test_a_failed_rebuild_leaves_the_old_rows(spark, tmp_path, name, partitions):
    tables.replace_table(rows(spark), name, partitions, path=str(tmp_path / "t"))
    failing = spark.table(name).withColumn("v", F.when(F.col("site_id") < 5, F.col("v")).otherwise(F.raise_error(F.lit("no")).cast("double")))
    with pytest.raises(Exception, match="no"):
        tables.replace_table(failing, name, partitions, path=str(tmp_path / "t"))
    spark.catalog.refreshTable(name)
    assert seen(spark.table(name), "month", "site_id", "v") == seen(rows(spark), "month", "site_id", "v")


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def locations(spark, name):
    return {f for f in (r[0] for r in spark.table(name).select(F.col("_metadata.file_path")).distinct().collect())}


def test_update_rewrites_only_touched_partitions(spark, tmp_path, name):
    root = str(tmp_path / "t")
    tables.replace_table(rows(spark), name, ["year", "month"], path=root)
    before, at = locations(spark, name), files(root)
    n = tables.update_table(spark, name, {"v": F.when((F.col("month") == 2) & (F.col("site_id") == 4), -1.0).otherwise(F.col("v"))})
    assert n == 1
    after = locations(spark, name)
    assert {f for f in before if "month=2" not in f} == {f for f in after if "month=2" not in f}
    assert not {f for f in before if "month=2" in f} & after
    assert all(files(root)[f] == t for f, t in at.items())
    want = [(m, s, -1.0 if (m, s) == (2, 4) else float(s + m)) for m in (1, 2, 3) for s in range(6)]
    assert seen(spark.table(name), "month", "site_id", "v") == want
    assert spark.table(name).where("month = 2").count() == 6
    assert tables.update_table(spark, name, {"v": F.col("v")}) == 0 and locations(spark, name) == after
    # twice the same partition; then what nobody reads goes
    assert tables.update_table(spark, name, {"v": F.when(F.col("month") == 2, 5.0).otherwise(F.col("v"))}) == 1
    tables.tidy_table(spark, name)
    assert len([f for f in os.listdir(tables._details(spark, name)["Location"].removeprefix("file:")) if f.startswith("_update")]) == 1
    assert seen(spark.table(name).where("month = 2"), "v") == [(5.0,)] * 6


def test_update_adds_columns_and_uses_keys(spark, tmp_path, name):
    tables.replace_table(rows(spark), name, ["year", "month"], path=str(tmp_path / "t"))
    flagged = spark.createDataFrame([(2,), (4,), (4,), (99,)], "site_id bigint")
    assert tables.update_table(spark, name, {"flex": F.col("matched"), "red": F.col("v") + 1}, flagged, ["site_id"]) == 3
    got = spark.table(name)
    assert got.columns[-2:] == ["year", "month"]
    assert seen(got.where("flex"), "site_id", "red") == [(s, float(s + m + 1)) for s in (2, 4) for m in (1, 2, 3)]
    assert got.where("NOT flex").count() == 12
    # one partition gets a new column, the others read null
    assert tables.update_table(spark, name, {"note": F.when(F.col("month") == 1, "x")}) == 1
    assert seen(spark.table(name).where("note IS NULL"), "month")[0] == (2,) and spark.table(name).where("note = 'x'").count() == 6


def test_update_of_a_table_without_partitions(spark, tmp_path, name):
    tables.replace_table(rows(spark), name, path=str(tmp_path / "t"))
    assert tables.update_table(spark, name, {"v": F.col("v")}) == 0
    assert tables.update_table(spark, name, {"flag": F.col("site_id") > 2}) == 1
    assert spark.table(name).where("flag").count() == 9


def test_failed_update_changes_nothing(spark, tmp_path, name):
    tables.replace_table(rows(spark), name, ["year", "month"], path=str(tmp_path / "t"))
    before = locations(spark, name)
    wrong = F.when(F.col("site_id") < 5, F.lit(1.0)).otherwise(F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        tables.update_table(spark, name, {"v": wrong, "w": F.lit(1)})
    assert locations(spark, name) == before and "w" not in spark.table(name).columns
    with pytest.raises(ValueError):
        tables.update_table(spark, name, {"month": F.lit(1)})


def test_update_of_partitions_with_awkward_values(spark, tmp_path, name):
    df = spark.createDataFrame([("a b/c:d'e", True, 1), ("plain", False, 2)], "k string, is_pv boolean, v int")
    tables.replace_table(df, name, ["k", "is_pv"], path=str(tmp_path / "t"))
    assert tables.update_table(spark, name, {"v": F.when(F.col("is_pv"), 7).otherwise(F.col("v"))}) == 1
    assert seen(spark.table(name), "k", "is_pv", "v") == [("a b/c:d'e", True, 7), ("plain", False, 2)]


def source(spark, tmp_path, months):
    path = str(tmp_path / "source")
    rows(spark, months=months).write.mode("overwrite").partitionBy("year", "month").parquet(path)
    return spark.read.parquet(path)


def test_only_missing_months_are_scanned(spark, tmp_path):
    out, scanned = str(tmp_path / "out"), []

    def build(df):
        scanned.append(sorted(r.month for r in df.select("month").distinct().collect()))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [(" in plan or "PartitionFilters: [" in plan and "month#" in plan.split("PartitionFilters: [")[1].split("]")[0]
        return df.where("month <> 3").groupBy("year", "month", "site_id").agg(F.sum("v").alias("v"))

    assert sinks.continue_conformance(source(spark, tmp_path, (1, 2)), out, build) == [(2024, 1), (2024, 2)]
    assert sinks.continue_conformance(source(spark, tmp_path, (1, 2)), out, build) == []
    assert sinks.continue_conformance(source(spark, tmp_path, (1, 2, 3, 4)), out, build) == [(2024, 3), (2024, 4)]
    assert scanned == [[1, 2], [3, 4]]
    assert seen(tables.finished_months(spark, out), "month", "rows") == [(1, 6), (2, 6), (3, 0), (4, 6)]  # month 3 has no rows
    assert spark.read.parquet(out).count() == 18
    assert sinks.continue_conformance(source(spark, tmp_path, (1, 2, 3, 4)), out, build, again=[(2024, 2)]) == [(2024, 2)]
    assert spark.read.parquet(out).count() == 18


def test_a_failed_month_is_built_by_the_next_run(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="no"):
        sinks.continue_conformance(source(spark, tmp_path, (1, 2)), out, lambda df: df.withColumn("v", F.raise_error(F.lit("no")).cast("double")))
    assert tables.finished_months(spark, out).collect() == []
    assert sinks.continue_conformance(source(spark, tmp_path, (1, 2)), out, lambda df: df) == [(2024, 1), (2024, 2)]
    assert spark.read.parquet(out).count() == 12
