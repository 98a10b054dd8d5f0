"""Stored tables that are replaced, updated and continued without ever being in pieces.

A table's files lie in folders below one root, and the catalog says which of them it reads: one folder for the table,
or one for each of its partitions. New files are written to a new folder first; only then is the catalog pointed to it.
So a run that fails changes nothing, a table may be rebuilt from its own rows, and whoever reads the old files goes on
reading them. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the finished months inside a result folder; readers skip names that start with an underscore.
LEDGER = "_ledger"
#: Folders of updated partitions inside a table's folder.
UPDATE = "_update-"


def spread(df: DataFrame, partitions: Sequence[str], files: int = 16) -> list[Column]:
    """A further key that deals the rows of a partition to several tasks."""
    keys = [c for c in df.columns if c in ("site_id", "circuit_id") and c not in partitions]
    return [F.pmod(F.hash(*keys), F.lit(files))] if keys else []


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _details(spark: SparkSession, name: str, partition: str = "") -> dict[str, str]:
    """What the catalog says of a table, or of a partition; columns may have any names and come before it."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name} {partition}").collect()
    start = next(k for k, r in enumerate(rows) if r["col_name"].startswith("# Detailed"))
    return {r["col_name"]: r["data_type"] for r in reversed(rows[start:])}  # of a partition and its table, the partition's


def partition_columns(spark: SparkSession, name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(name) if c.isPartition]


def _root(spark: SparkSession, name: str) -> str:
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/{name.replace('`', '')}.versions"


def _write(df: DataFrame, folder: str, partitions: Sequence[str], sort: Sequence[str]) -> None:
    if partitions:
        df = df.repartition(*[F.col(c) for c in partitions], *spread(df, partitions))
    if sort:
        df = df.sortWithinPartitions(*partitions, *sort)
    writer = df.write
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(folder)


def _create(spark: SparkSession, name: str, schema: T.StructType, partitions: Sequence[str], folder: str) -> None:
    fields = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    by = f"PARTITIONED BY ({', '.join(map(_quoted, partitions))})" if partitions else ""
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet {by} LOCATION '{folder}'")
    if partitions:
        spark.sql(f"MSCK REPAIR TABLE {name}")


def _fields(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema]


def replace_table(df: DataFrame, name: str, partitions: Sequence[str] = (), sort: Sequence[str] = (),
                  path: str | None = None) -> DataFrame:
    """Build the table ``name`` from ``df``, or put ``df`` in its place.

    The rows are written to a new folder below ``path`` (else below the warehouse), then the table is pointed to it. A
    table with the same columns and no partitions is moved in one step, any other is made under another name, which
    then takes the place of the old one. The files of the version before stay for readers; older ones are deleted.
    ``df`` may read the table itself. The table is external: dropping it leaves the files.
    """
    spark = df.sparkSession
    root = (path or _root(spark, name)).rstrip("/")
    prefix = f"{name.rsplit('.', 1)[-1].strip('`')}-version-"
    folder = f"{root}/{prefix}{uuid.uuid4().hex}"
    schema = T.StructType([*(f for f in df.schema if f.name not in partitions), *(df.schema[c] for c in partitions)])
    _write(df, folder, partitions, sort)
    before = None
    if spark.catalog.tableExists(name):
        before = _details(spark, name).get("Location")
        if not partitions and not partition_columns(spark, name) and _fields(spark.table(name).schema) == _fields(schema):
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
            spark.catalog.refreshTable(name)
            _keep_only(spark, root, prefix, [folder, before])
            return spark.table(name)
        parts = name.split(".")
        fresh = ".".join([*parts[:-1], f"fresh_{uuid.uuid4().hex}"])
        _create(spark, fresh, schema, partitions, folder)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    else:
        _create(spark, name, schema, partitions, folder)
    _keep_only(spark, root, prefix, [folder, before])
    return spark.table(name)


def _folders(spark: SparkSession, root: str) -> list:
    """Hadoop paths of the folders right below ``root``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(fs, s.getPath()) for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []


def _keep_only(spark: SparkSession, root: str, prefix: str, wanted: Iterable[str | None]) -> None:
    """Delete folders of a prefix that none of the wanted ones is or lies in."""
    names = {part for w in wanted if w for part in w.rstrip("/").split("/")}
    for fs, folder in _folders(spark, root):
        if folder.getName().startswith(prefix) and folder.getName() not in names:
            fs.delete(folder, True)


def _spec(columns: Sequence[str], values: Sequence[str]) -> str:
    """A partition in SQL."""
    texts = ("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return ", ".join(f"{_quoted(c)} = {t}" for c, t in zip(columns, texts, strict=True))


def _any_of(rows: Sequence[Row], columns: Sequence[str]) -> Column:
    """Whether the partition columns have one of the given values; prunes the scan."""
    def same(row: Row) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c) == F.lit(row[c]) for c in columns])

    return reduce(lambda a, b: a | b, [same(r) for r in rows])


def update_table(spark: SparkSession, name: str, values: dict[str, Column], keys: DataFrame | None = None,
                 on: Sequence[str] = ()) -> int:
    """Set columns of a stored table, by copy on write; returns the number of partitions rewritten.

    ``values`` are expressions of the table's columns, by name of an old or new column. With ``keys`` they may also use
    ``matched``, whether the row's ``on`` columns are among the keys, which takes a join and no list in the plan.

    One scan of the columns the expressions use finds the partitions with a row whose value changes. Only these are
    read whole and written, to a new folder, and at the end each is pointed to its new files; all other files
    stay as they are. New columns are null where nothing was rewritten. A table without partitions is rewritten whole,
    and not at all if no value changes.
    """
    table = spark.table(name)
    partitions = partition_columns(spark, name)
    if set(values) & set(partitions):
        raise ValueError("partition columns can't be updated")
    added = [c for c in values if c not in table.columns]
    rows = table
    if keys is not None:
        known = keys.select(*on).distinct().withColumn("matched", F.lit(True))
        rows = table.join(known, list(on), "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    new = rows.withColumns({f"_new_{c}": v for c, v in values.items()})
    changes = [~F.col(f"_new_{c}").eqNullSafe(F.lit(None) if c in added else F.col(c)) for c in values]
    changed = new.where(reduce(lambda a, b: a | b, changes))
    renamed = new.select(*[F.col(f"_new_{c}").alias(c) if c in values else F.col(c) for c in [*table.columns, *added]])
    schema = renamed.schema
    if not partitions:
        if changed.isEmpty():
            return 0
        replace_table(renamed, name, path=_details(spark, name)["Location"].rsplit("/", 1)[0])
        return 1
    as_text = [F.col(c).cast("string").alias(f"_text_{c}") for c in partitions]
    touched = changed.select(*partitions, *as_text).distinct().collect()  # a row per partition
    if not touched:
        return 0
    if any(r[c] is None for r in touched for c in partitions):
        raise ValueError("rows without a partition value can't be updated")
    folder = f"{_details(spark, name)['Location'].rstrip('/')}/{UPDATE}{uuid.uuid4().hex}"
    _write(renamed.where(_any_of(touched, partitions)), folder, partitions, ())
    written = {_values_of(place, partitions): place for place in _leaves(spark, folder, len(partitions))}
    if added:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'{_quoted(c)} {schema[c].dataType.simpleString()}' for c in added)})")
    for row in touched:
        spec = tuple(row[f"_text_{c}"] for c in partitions)
        spark.sql(f"ALTER TABLE {name} PARTITION ({_spec(partitions, spec)}) SET LOCATION '{written[spec]}'")
    spark.catalog.refreshTable(name)
    return len(touched)


def _leaves(spark: SparkSession, folder: str, depth: int) -> list[str]:
    found = [p.toString() for _, p in _folders(spark, folder) if "=" in p.getName()]
    return found if depth == 1 else [q for p in found for q in _leaves(spark, p, depth - 1)]


def _values_of(path: str, partitions: Sequence[str]) -> tuple[str, ...]:
    return tuple(unquote(part.split("=", 1)[1]) for part in path.split("/")[-len(partitions):])


def tidy_table(spark: SparkSession, name: str) -> None:
    """Delete the folders of earlier updates that no partition of the table reads any more."""
    home = _details(spark, name)["Location"].rstrip("/")
    partitions = partition_columns(spark, name)
    specs = [_spec(partitions, _values_of(r[0], partitions)) for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    _keep_only(spark, home, UPDATE, [_details(spark, name, f"PARTITION ({spec})")["Location"] for spec in specs])


def finished_months(spark: SparkSession, path: str) -> DataFrame:
    """(year, month, rows) of the months a result folder is finished with."""
    schema = "year bigint, month bigint, rows bigint, finished timestamp"
    known = any(p.getName() == LEDGER for _, p in _folders(spark, path))
    entries = spark.read.schema(schema).parquet(f"{path}/{LEDGER}") if known else spark.createDataFrame([], schema)
    return entries.groupBy("year", "month").agg(F.max_by("rows", "finished").alias("rows"))


def write_new_months(source: DataFrame, path: str, build: Callable[[DataFrame], DataFrame],
                     write: Callable[[DataFrame, str], None], again: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Continue a monthly result: build and write the months of ``source`` not finished yet; returns them.

    ``source`` is partitioned by year and month; of it only the missing months are scanned. ``build`` makes result
    rows with year and month, ``write`` replaces their months below ``path``. A month is entered in the ledger after
    its rows are written, also when it has none, so a run that fails is made up for by the next one. ``again`` names
    finished months to build anew.
    """
    spark = source.sparkSession
    months = source.select(F.col("year").cast("bigint"), F.col("month").cast("bigint")).where("year IS NOT NULL AND month IS NOT NULL").distinct()
    done = finished_months(spark, path)
    if again:
        done = done.join(spark.createDataFrame(list(again), "year bigint, month bigint"), ["year", "month"], "left_anti")
    missing = months.join(done, ["year", "month"], "left_anti").orderBy("year", "month").collect()  # a row per month
    if not missing:
        return []
    rows = build(source.where(_any_of(missing, ("year", "month"))))
    write(rows, path)
    stored = spark.read.schema(rows.schema).parquet(path).where(_any_of(missing, ("year", "month")))
    counts = stored.groupBy(F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month")).agg(F.count("*").alias("rows"))
    wanted = spark.createDataFrame(missing, "year bigint, month bigint")
    (wanted.join(counts, ["year", "month"], "left").select("year", "month", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"),
                                                             F.current_timestamp().alias("finished"))
     .coalesce(1).write.mode("append").parquet(f"{path}/{LEDGER}"))
    return [(r["year"], r["month"]) for r in missing]
