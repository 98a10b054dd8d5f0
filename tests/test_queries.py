"""Every registered query against its SQL twin, and the same on skewed data."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from pvgrid.plans.queries import QUERIES, SQL
from pvgrid.plans.views import table
from pvgrid.session import release

EMPTY = "no rows"
# Reports that list nothing on the smallest tables, and a regression through two points there.
MAY_BE_EMPTY = ("fully_conformant_days", "flex_export_sites", "flex_export_rows", "clear_day_series", "estimate_sanity",
                "poorly_covered_sites", "duplicate_rows", "nearest_point_within")
DEGENERATE = ("peak_power_regression", "peak_power_regression_quality")

SKEW_CHECKED = (
    "site_power", "voltwatt_conformance", "voltvar_conformance", "anti_islanding_conformance", "flex_export_sites",
    "zero_export_high_voltage", "exposure_share", "duplicate_readings", "sampling_interval", "circuit_coverage",
    "structured_data", "process_edp", "interpolate_time", "energy_to_power", "nearest_point",
)


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in DEGENERATE])
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert difference(QUERIES[name](spark, sf_dir), duck, SQL[name]) == (EMPTY if name in MAY_BE_EMPTY else None)
    release(spark)


@pytest.mark.parametrize("name", MAY_BE_EMPTY + DEGENERATE)
def test_query_matches_sql_on_larger_tables(spark, sf_dir, name):
    larger = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    if not os.path.isdir(larger):
        pytest.skip(f"no test data at {larger}")
    assert difference(QUERIES[name](spark, larger), connect(larger), SQL[name]) is None
    release(spark)


def test_ordered_reports_are_in_order(spark, sf_dir):
    for name, column in (("circuits_by_postcode", "n"), ("negative_voltages", "n_outliers"), ("sampling_interval", "min_diff_seconds"),
                         ("clear_period_counts", "num_clear_days"), ("edp_reactive_ranking", "Q_noncomp"),
                         ("edp_active_ranking", "P_noncomp")):
        values = [r[column] for r in QUERIES[name](spark, sf_dir).collect()]
        known = [v for v in values if v is not None]
        assert known == sorted(known, reverse=True) and values[:len(known)] == known, name


@pytest.fixture(scope="module")
def skewed(spark, sf_dir, tmp_path_factory):
    """The tables with a third of all lines on one supplier and a third of all orders on one customer."""
    out = str(tmp_path_factory.mktemp("skewed"))
    for file in os.listdir(sf_dir):
        if file.split(".")[0] in ("nation", "supplier", "customer", "events"):
            shutil.copy(f"{sf_dir}/{file}", f"{out}/{file}")
    hot = F.col("l_linenumber") % 3 == 0
    lines = table(spark, sf_dir, "lineitem").withColumn("l_suppkey", F.when(hot, 3).otherwise(F.col("l_suppkey")).cast("bigint"))
    lines.toPandas().to_parquet(f"{out}/lineitem.parquet")
    orders = table(spark, sf_dir, "orders").withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 7).otherwise(F.col("o_custkey")).cast("bigint"))
    orders.toPandas().to_parquet(f"{out}/orders.parquet")
    return out


@pytest.mark.parametrize("name", SKEW_CHECKED)
def test_query_matches_sql_on_skewed_tables(spark, skewed, name):
    con = connect(skewed)
    assert difference(QUERIES[name](spark, skewed), con, SQL[name]) == (EMPTY if name in MAY_BE_EMPTY else None)
    release(spark)


@pytest.mark.parametrize("name", ("voltvar_conformance", "structured_data", "deadband_irradiance_coverage"))
def test_query_needs_no_broadcast(spark, sf_dir, duck, name):
    """Beyond the broadcast threshold the plans fall back to shuffled joins with the same rows."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert difference(QUERIES[name](spark, sf_dir), duck, SQL[name]) is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
