"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at both ends, in lower case A-Z. Keys of at least
``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except those in the
largest document id that holds them.

Keys are 128-bit hashes (XXH3). Documents come in batches. A batch is summed to (hash, documents, largest
id) and merge-anti-joined with the sorted runs written so far: unknown hashes become a new run of level 0,
known ones are appended to the recurrences. Runs are tables bucketed and sorted by hash, so neither side of
the merge moves or sorts a run again. When a level has ``fan_out`` runs they are compacted into one run of
the next level. Runs never share a hash, so a hash totals its one run entry and its recurrences.

Lines to drop are looked up per document: if the hashes that repeat number at most ``max_lookup``, they are
broadcast and the texts are read once without a shuffle; beyond that the (document, hash) pairs are joined
with them and the sets go to the documents by id. Both ways give the same rows.

Defined cases: a null or empty text is one empty line; a line counts once per document row; rows that repeat
a document id are documents of their own, and all of them count as the largest id if theirs is; a null id is
below all others, and where all holders have a null id nothing is dropped; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvgrid.llm.common import map_batches, stage
from pvgrid.session import staged_path

MIN_CHARS = 40
MIN_DOCS = 5
#: Documents of a batch, and the least number of batches.
BATCH_DOCS = 50_000_000
BATCHES = 4
#: Hashes of a bucket of a run, about.
BUCKET_ROWS = 4_000_000
FAN_OUT = 3
MAX_LOOKUP = 200_000

_WHITE = " \t\n\x0b\x0c\r"
_lookups: dict[str, dict] = {}


def line_hash(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """Hash of the line's key, or None for a short one."""
    key = line.strip(_WHITE)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, hi, lo) for every distinct long line of every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    schema = T.StructType([rows.schema[0], T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())])

    def make():
        def work(batch):
            found = [sorted({h for line in (t.as_py() or "").split("\n") if (h := line_hash(line, min_chars))})
                     for t in batch[1]]
            pair = np.frombuffer(b"".join(h for hs in found for h in hs), ">i8").astype(np.int64).reshape(-1, 2)
            at = np.repeat(np.arange(len(found)), [len(hs) for hs in found])
            return [batch[0].take(at), pair[:, 0], pair[:, 1]]
        return work

    return map_batches(rows, schema, make)


class LevelledRuns:
    """Sorted runs of (hi, lo, docs, last) with disjoint hashes, and the recurrences of known hashes."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT, buckets: int | None = None):
        self.spark = spark
        self.fan_out = fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))  # of all runs, so that they join without a shuffle
        self.levels: list[list[str]] = [[]]
        self.recurrences: list[DataFrame] = []
        self.names: list[str] = []

    def close(self) -> None:
        """Take the runs out of the catalog; their files go with :func:`pvgrid.session.release`."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in reversed(self.levels) for name in level]

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (run.repartition(self.buckets, "hi", "lo").write.bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo")
         .option("path", staged_path(self.spark, "line-run")).saveAsTable(name))
        self.names.append(name)
        return name

    def add(self, batch: DataFrame) -> None:
        """Take a batch of (hi, lo, docs, last), one row per hash."""
        batch = stage(batch, "line-batch") if any(self.levels) else batch
        fresh = batch
        for run in self.tables():
            fresh = fresh.join(run.hint("merge"), ["hi", "lo"], "left_anti")
            self.recurrences.append(batch.join(run.select("hi", "lo").hint("merge"), ["hi", "lo"], "left_semi"))
        self.levels[0].append(self._write(fresh))
        self._compact()

    def _compact(self) -> None:
        for depth, level in enumerate(self.levels):
            if len(level) >= self.fan_out:
                merged = self.spark.table(level[0])
                for name in level[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(self._write(merged))
                level.clear()

    def totals(self, min_docs: int) -> DataFrame:
        """(hi, lo, docs, last) of the hashes held by at least ``min_docs`` documents."""
        entries = self.tables()
        total = entries[0]
        for run in entries[1:]:
            total = total.unionByName(run)
        again = None
        for part in self.recurrences:
            again = part if again is None else again.unionByName(part)
        if again is None:
            return total.where(F.col("docs") >= min_docs)
        again = again.groupBy("hi", "lo").agg(F.sum("docs").alias("more"), F.max("last").alias("late"))
        return (total.join(again, ["hi", "lo"], "left")
                .select("hi", "lo", (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"),
                        F.greatest("last", "late").alias("last"))
                .where(F.col("docs") >= min_docs))


def repeated_lines(hashes: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES,
                   fan_out: int = FAN_OUT) -> DataFrame:
    """(hi, lo, docs, last) of repeated lines, from (id, hi, lo, batch) read batch by batch."""
    spark = hashes.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = LevelledRuns(spark, fan_out, max(least, -(-hashes.count() // BUCKET_ROWS)))
    try:
        for k in range(batches):
            runs.add(hashes.where(F.col("batch") == k).groupBy("hi", "lo")
                     .agg(F.count("*").alias("docs"), F.max("id").alias("last")))
        return stage(runs.totals(min_docs), "repeated-lines")
    finally:
        runs.close()


def _rewrite(text: str | None, keep) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    kept = [line for line in lines if keep(line)]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def _lookup(key: str, rows) -> dict:
    if key not in _lookups:
        _lookups.clear()
        hashes, last = rows.value
        _lookups[key] = {hashes[i * 16:i * 16 + 16]: x for i, x in enumerate(last)}
    return _lookups[key]


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None,
                        fan_out: int = FAN_OUT, max_lookup: int = MAX_LOOKUP) -> DataFrame:
    """One row per document: n_lines, n_dropped, kept_sha256 and the text that is left."""
    spark = docs.sparkSession
    batches = batches or max(BATCHES, -(-docs.count() // BATCH_DOCS))
    of_batch = F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")
    path = staged_path(spark, "line-hashes")
    line_hashes(docs, id_col, text_col, min_chars).withColumn("batch", of_batch).write.partitionBy("batch").parquet(path)
    hashes = spark.read.schema("id " + docs.schema[id_col].dataType.simpleString()
                               + ", hi long, lo long, batch int").parquet(path)
    repeated = repeated_lines(hashes, min_docs, batches, fan_out).where("last IS NOT NULL")
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = T.StructType([rows.schema[0], T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType()),
                           T.StructField("text", T.StringType())])

    def report(ids, texts, keep_of):
        found = [_rewrite(t, keep_of(i, k)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return [[f[0] for f in found], [f[1] for f in found],
                [hashlib.sha256(f[2].encode()).hexdigest() for f in found], [f[2] for f in found]]

    if repeated.count() <= max_lookup:
        found = repeated.select("hi", "lo", "last").toArrow()
        pairs = np.column_stack([found["hi"].to_numpy(), found["lo"].to_numpy()]).astype(">i8").tobytes()
        key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast((pairs, found["last"].to_pylist()))

        def make():
            last = _lookup(key, shared)

            def work(batch):
                def keep_of(i, _):
                    def keep(line):
                        h = line_hash(line, min_chars)
                        return h is None or last.get(h, i) == i
                    return keep
                return [batch[0], *report(batch[0].to_pylist(), batch[1].to_pylist(), keep_of)]
            return work

        return map_batches(rows, schema, make)

    drop = (hashes.join(repeated.select("hi", "lo", "last"), ["hi", "lo"])
            .where(~F.col("id").eqNullSafe(F.col("last"))).groupBy("id")
            .agg(F.collect_set(F.struct("hi", "lo")).alias("_drop")))
    joined = rows.join(drop, rows[id_col].eqNullSafe(drop["id"]), "left").select(id_col, "_text", "_drop")

    def make_joined():
        def work(batch):
            sets = [{np.array([x["hi"], x["lo"]], ">i8").tobytes() for x in s or ()} for s in batch[2].to_pylist()]

            def keep_of(_, k):
                return lambda line: not sets[k] or line_hash(line, min_chars) not in sets[k]
            return [batch[0], *report(batch[0].to_pylist(), batch[1].to_pylist(), keep_of)]
        return work

    return map_batches(joined, schema, make_joined)
