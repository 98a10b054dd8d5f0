"""Runs of line hashes: their number of buckets and batches follow the data, and a failure leaves no table behind."""

from __future__ import annotations

import pytest

from pvgrid.llm import linedup

from .cases import frame


def tables(spark):
    return [r.tableName for r in spark.sql("SHOW TABLES").collect() if r.tableName.startswith("line_run")]


def test_more_rows_make_more_buckets_and_batches(spark, monkeypatch):
    want = sorted(tuple(r) for r in linedup.drop_repeated_lines(frame(spark)).select("n_lines", "n_dropped", "kept_sha256").collect())
    seen, batches, init, add = [], [], linedup.LevelledRuns.__init__, linedup.LevelledRuns.add
    monkeypatch.setattr(linedup, "BUCKET_ROWS", 5)
    monkeypatch.setattr(linedup, "BATCH_DOCS", 10)
    monkeypatch.setattr(linedup.LevelledRuns, "__init__", lambda self, *a: (init(self, *a), seen.append(self.buckets))[0])
    monkeypatch.setattr(linedup.LevelledRuns, "add", lambda self, batch: (batches.append(1), add(self, batch))[1])
    df = frame(spark)
    got = sorted(tuple(r) for r in linedup.drop_repeated_lines(df).select("n_lines", "n_dropped", "kept_sha256").collect())
    assert got == want and len(batches) == -(-df.count() // 10) > linedup.BATCHES
    assert seen[0] > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_failure_leaves_no_runs(spark, monkeypatch):
    def fail(self, min_docs):
        raise RuntimeError("stopped")

    monkeypatch.setattr(linedup.LevelledRuns, "totals", fail)
    with pytest.raises(RuntimeError, match="stopped"):
        linedup.drop_repeated_lines(frame(spark))
    assert tables(spark) == []
