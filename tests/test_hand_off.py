"""The chain's stored tables: written once, joined without a shuffle, gone after release."""

from __future__ import annotations

import shutil

from compare import connect, difference
from pvgrid.plans.estimator_queries import hand_off
from pvgrid.plans.queries import QUERIES, SQL
from pvgrid.session import release, stage_bucketed

REPORTS = ("voltwatt_conformance_ghi", "voltwatt_curtailment", "voltwatt_low_irradiance_rows", "voltvar_conformance_curtailment",
           "estimate_sanity", "estimates_below_measured")


def names(spark):
    return {r.tableName for r in spark.sql("SHOW TABLES").collect()}


def test_reports_share_tables_that_are_written_once(spark, sf_dir):
    release(spark)
    before, duck = names(spark), connect(sf_dir)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in REPORTS:
            df = QUERIES[name](spark, sf_dir)
            if name in REPORTS[:4]:
                plan = df._jdf.queryExecution().executedPlan().toString()
                join = plan[plan.index("SortMergeJoin"):]
                assert "Exchange" not in join and "Bucketed: true" in join, name
            assert difference(df, duck, SQL[name]) in (None, "no rows"), name
        assert len(names(spark) - before) == 3   # site rows and both tables of estimates
        assert hand_off(spark, sf_dir) is hand_off(spark, sf_dir)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    release(spark)
    assert names(spark) == before


def test_a_large_site_fills_no_bucket(spark):
    rows = spark.range(30_000).selectExpr("IF(id % 3 = 0, 7, id % 50) AS site_id", "timestamp_seconds(id * 300) AS t_stamp")
    table = stage_bucketed(rows, "rows", ("site_id", "t_stamp"))
    sizes = [r["count"] for r in table.selectExpr("_metadata.file_path AS f").groupBy("f").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1.2 * 30_000 / len(sizes)
    release(spark)


def test_tables_somebody_deleted_are_made_again(spark, sf_dir):
    release(spark)
    duck, name = connect(sf_dir), "estimates_below_measured"
    first = hand_off(spark, sf_dir)
    assert difference(QUERIES[name](spark, sf_dir), duck, SQL[name]) is None and hand_off(spark, sf_dir) is first
    shutil.rmtree(first._paths[-1])
    assert difference(QUERIES[name](spark, sf_dir), duck, SQL[name]) is None and hand_off(spark, sf_dir) is not first
    release(spark)
