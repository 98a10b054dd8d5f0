"""Session settings and staged intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan relies on. Time stamps are UTC by convention, so the
# session zone must be UTC whatever the cluster default is.
RUNTIME = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Parquet files unpack to several times their size; judge broadcasts by the latter.
    "spark.sql.sources.fileCompressionFactor": "4.0",
}

#: Least number of tasks that list folders; four a core where there are more cores. Spark would start one for every folder,
#: up to 10 000, and each unpacks the Hadoop settings before it lists anything.
LISTING_TASKS = 64

# Settings only a new session can take: plan building without a stack trace per column.
AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str = "pvgrid", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; dots in extra settings are written as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **AT_START}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession, scratch: str | None = None) -> SparkSession:
    """Apply the runtime settings to a session somebody else created.

    ``scratch`` becomes the shared folder for staged tables. Without it the session's
    ``spark.checkpoint.dir`` holds; only where that is unset too, in a local session, a
    temporary folder is set, which goes when Python ends.
    """
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism",
                   str(max(LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism)))
    if scratch:
        spark.conf.set("spark.checkpoint.dir", scratch)
    elif not _shared_folder(spark) and spark.sparkContext.master.startswith("local["):
        own = tempfile.mkdtemp(prefix="pvgrid-stage-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", own)
    return spark


def _shared_folder(spark: SparkSession) -> str | None:
    return (spark.sparkContext.getConf().get("spark.checkpoint.dir")
            or spark.conf.get("spark.checkpoint.dir", None))


def staging_root(spark: SparkSession, root: str | None = None) -> str:
    """Folder for staged tables: ``root`` or the session's ``spark.checkpoint.dir``.

    There is no default: driver and executors of a cluster share no machine-local folder.
    """
    root = root or _shared_folder(spark)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach, or pass a root")
    return root.rstrip("/")


_staged: list[tuple[str, str]] = []


def staged_path(spark: SparkSession, name: str, root: str | None = None) -> str:
    """A new path for a staged table, to be written by the caller; :func:`release` deletes it."""
    path = f"{staging_root(spark, root)}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark.sparkContext.applicationId, path))
    return path


def stage(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where a relation feeds several later steps: the input is scanned and
    shuffled once, the lineage is cut, later steps read only their columns, and a
    lost executor costs no recomputation. :func:`release` deletes what was staged.
    """
    spark = df.sparkSession
    path = staged_path(spark, name, root)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_named: list[tuple[str, str]] = []
_kept: dict[tuple[str, ...], object] = {}


def staged_name(spark: SparkSession, name: str) -> str:
    """A new name for a table of the catalog; :func:`release` drops it."""
    table = f"{name}_{uuid.uuid4().hex}"
    _named.append((spark.sparkContext.applicationId, table))
    return table


#: Megabytes of rows, by the optimiser's estimate, that one task should combine or sort in memory.
TASK_MB = 32
#: Estimates beyond this (in bytes) only say that the size is unknown.
UNKNOWN_SIZE = 1 << 50


def tasks_for(df: DataFrame) -> int:
    """How many tasks ``df``'s rows should be dealt to, so that a task's share doesn't grow with the input; one per core at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = size // (TASK_MB << 20) + 1 if size < UNKNOWN_SIZE else 0
    return max(df.sparkSession.sparkContext.defaultParallelism, wanted)


def buckets_for(df: DataFrame) -> int:
    """How many buckets ``df``'s rows should be dealt to: the session's shuffle partitions, more where the input needs more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks_for(df))


def stage_bucketed(df: DataFrame, name: str, keys: Sequence[str], root: str | None = None, buckets: int | None = None) -> DataFrame:
    """Like :func:`stage`, dealt to buckets by ``keys`` and sorted by them.

    Joins of tables staged with the same keys and number of buckets, on all keys, need no shuffle. There are as many
    buckets as the session has shuffle partitions unless ``buckets`` says otherwise, each written by one task.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = staged_name(spark, name)
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", staged_path(spark, name, root)).saveAsTable(table))
    return spark.table(table)


def kept(spark: SparkSession, key: tuple[str, ...], make: Callable[[], object]) -> object:
    """``make()``, made once by an application for every key until :func:`release`: staged tables several reports read."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget(spark: SparkSession, key: tuple[str, ...]) -> None:
    """Have :func:`kept` make a value anew."""
    _kept.pop((spark.sparkContext.applicationId, *key), None)


def staged_paths(spark: SparkSession) -> list[str]:
    """Where this application has staged tables, in the order of their making."""
    return [path for owner, path in _staged if owner == spark.sparkContext.applicationId]


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def release(spark: SparkSession) -> int:
    """Delete the tables this application has staged; returns how many there were.

    Call it when the results that read them have been written or collected.
    """
    app = spark.sparkContext.applicationId
    for key in [key for key in _kept if key[0] == app]:
        del _kept[key]
    for owner, table in _named:
        if owner == app:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    _named[:] = [entry for entry in _named if entry[0] != app]
    mine = [path for owner, path in _staged if owner == app]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in mine:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    _staged[:] = [entry for entry in _staged if entry[0] != app]
    return len(mine)
