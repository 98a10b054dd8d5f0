"""What the stored chain shuffles and holds at once, so that neither grows faster than its input."""

from __future__ import annotations

import datetime as dt
import re

from pvgrid.operators import clearsky
from pvgrid.operators.site import site_power
from pvgrid.plans import chain, estimator_queries, views
from pvgrid.session import LISTING_TASKS, buckets_for, release, stage_bucketed, tasks_for
from pvgrid.sources.edp import EDP_SCHEMA, read_edp
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
READINGS = "circuit_id bigint, t_stamp timestamp, is_pv boolean, power double, energy_reactive double, voltage double"
META = ("site_id bigint, circuit_id bigint, circuit_polarity int, ac_capacity_kw double, S_99 double, is_pv boolean, "
        "n_lat double, n_long double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark):
    """Site 1 with two circuits, one reading twice, and a circuit listed in two cells."""
    meta = spark.createDataFrame([(1, 10, 1, 5.0, 4.0, True, -10.0, 120.0), (1, 11, -1, 6.0, 4.0, True, -10.0, 120.0),
                                  (2, 20, 1, 3.0, 2.0, True, -11.0, 121.0), (2, 20, 1, 3.0, 2.0, True, -12.0, 122.0)], META)
    rows = [(c, T0 + dt.timedelta(minutes=5 * i), True, 100.0 * i, 1.0, None if i == 3 else 240.0 + i)
            for c in (10, 11, 20) for i in range(40)]
    return spark.createDataFrame(rows + rows[:5], READINGS), meta


def test_dealt_readings_give_the_same_rows(spark):
    ts, meta = tables(spark)
    plain, dealt = site_power(ts, meta, cell=True), site_power(ts, meta, cell=True, tasks=7)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.collect())) and dealt.count() == 39 * 3
    assert dealt.rdd.getNumPartitions() == 7


def test_readings_are_shuffled_once_on_their_way_to_a_bucket(spark):
    """Combined by site and time in the task that writes the bucket, not in the tasks that read."""
    ts, meta = tables(spark)
    rows = site_power(ts, meta, cell=True, tasks=8)
    text = plan(rows.repartition(8, *chain.READING))
    assert text.count("hashpartitioning(site_id#") == 1
    above = text[:text.index("hashpartitioning(site_id#")]
    assert above.count("HashAggregate") == 2
    assert stage_bucketed(rows, "rows", chain.READING, buckets=8).count() == 39 * 3
    release(spark)


def test_tasks_and_buckets_grow_with_the_rows(spark):
    small, large = spark.range(1000), spark.range(1 << 30)   # 8 GB
    assert tasks_for(small) == spark.sparkContext.defaultParallelism and tasks_for(large) == 257
    assert buckets_for(small) == max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))) and buckets_for(large) == 257
    unknown = small.rdd.map(lambda r: (r.id,)).toDF("id bigint")
    assert tasks_for(unknown) == spark.sparkContext.defaultParallelism


def test_site_rows_meet_the_grid_without_a_shuffle(spark, monkeypatch):
    """The optimiser doesn't know how large a distinct grid is; stored, it is small enough to be sent to the rows."""
    staged = {}

    def stage(df, name, keep=clearsky.stage):
        staged[name] = plan(df)
        return keep(df, name)

    monkeypatch.setattr(clearsky, "stage", stage)
    ts, meta = tables(spark)
    sun = spark.createDataFrame([(T0 + dt.timedelta(minutes=10 * i), -10.0, 120.0, 500.0, 0) for i in range(20)],
                                "time timestamp, latitude double, longitude double, GHI double, cloud_type int")
    out = clearsky.structured_data(site_power(ts, meta, cell=True, tasks=4), clearsky.grid_of_sites(sun, clearsky.site_cells(meta)))
    assert {r.site_id for r in out.collect()} == {1} and out.count() == 39
    assert "BroadcastHashJoin" in staged["lit-rows"] and staged["lit-rows"].count("hashpartitioning(latitude") == 0
    assert re.search(r"BroadcastHashJoin \[.*LeftSemi, BuildRight", plan(out)) and "SortMergeJoin [latitude" not in plan(out)
    release(spark)


def test_chain_stores_only_columns_it_reads(spark, sf_dir):
    release(spark)
    fitted = estimator_queries.fitted(spark, sf_dir)
    assert set(fitted.structured.columns) == set(chain.STRUCTURED)
    assert set(fitted.labelled.columns) == {*chain.LABELLED, "day_type"}
    release(spark)


def test_estimator_readings_are_dealt_by_site_and_time(spark, sf_dir):
    rows = estimator_queries.eligible_site(spark, sf_dir)
    assert rows.rdd.getNumPartitions() == tasks_for(views.ts(spark, sf_dir))
    assert rows.groupBy("site_id", "t_stamp").count().where(F.col("count") > 1).count() == 0


def test_listing_many_folders_takes_few_tasks(spark, tmp_path):
    most = max(LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism)
    header = ",".join(c.split()[0] for c in EDP_SCHEMA.split(", "))
    for i in range(most + 40):
        (tmp_path / f"file=S{i}").mkdir()
        (tmp_path / f"file=S{i}" / "part.csv").write_text(f"{header}\nS{i},C0,D0,pv_site_net,2024-01-01T00:00:00Z{',1.0' * 8}\n")
    spark.sparkContext.setJobGroup("listing", "listing")
    rows = read_edp(spark, f"{tmp_path}/file=*")
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= most
    assert rows.select("edp_site_id").distinct().count() == most + 40
