"""Second data set: one CSV per site with energy per 5-minute step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvgrid.session import stage

EDP_SCHEMA = (
    "edp_site_id string, edp_circuit_label string, edp_device_and_circuit string, "
    "circuit_label string, datetime timestamp, real_energy double, reactive_energy double, "
    "current_avg double, current_min double, current_max double, "
    "voltage_avg double, voltage_min double, voltage_max double"
)


def read_edp(spark: SparkSession, path: str, schema: str = EDP_SCHEMA) -> DataFrame:
    """All site files matching a glob as one table; empty files contribute no rows."""
    return (spark.read.schema(schema).option("header", True)
            .option("enforceSchema", False).csv(path))


@dataclass
class CheckedFiles:
    """Rows that could be read, lines that couldn't (file, line), and (file, n_rows, n_broken) per file with a line."""

    rows: DataFrame
    broken: DataFrame
    report: DataFrame


def read_edp_checked(spark: SparkSession, path: str, schema: str = EDP_SCHEMA, max_broken: float = 0.01,
                     max_orders: int = 20) -> CheckedFiles:
    """All site files matching a glob, with broken lines set aside; too many of them fail the run.

    A file's columns may stand in any order, named by its header. A line is broken if it has another number of
    fields, a value that isn't of its column's type, or stands in a file without a header of these columns; so a
    cut or mixed-up line becomes neither a row of nulls nor an error in the middle of a job. More than
    ``max_broken`` of all lines raise an error that names the worst files. Fields hold no line ends. The parsed lines are
    staged, so files are read once for headers (first lines only are kept) and once for rows.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    types = dict(c.split() for c in schema.split(", "))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    fields = F.transform(F.split(F.regexp_replace("line", "^\\ufeff|\\r$|\"", ""), ","), F.trim)
    is_header = F.array_sort(fields) == F.array(*[F.lit(n) for n in sorted(names)])
    headers = stage(lines.where(is_header).groupBy("file").agg(F.min(F.concat_ws(",", fields)).alias("order")), "headers")
    orders = [r["order"] for r in headers.select("order").distinct().limit(max_orders + 1).collect()]
    if len(orders) > max_orders:
        raise ValueError(f"more than {max_orders} orders of columns below {path}")
    parsed = F.lit(None).cast(", ".join(f"{n}: {types[n]}" for n in names).join(("struct<", ", _broken: string>")))
    for order in orders:
        given = ", ".join(f"{n} {types[n]}" for n in order.split(","))
        row = F.from_csv("line", f"{given}, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
        parsed = F.when(F.col("order") == order, F.struct(*[row[n].alias(n) for n in names], row["_broken"].alias("_broken"))).otherwise(parsed)
    found = stage(lines.where(~is_header & (F.trim("line") != "")).join(headers, "file", "left")
                  .select("file", "line", parsed.alias("row")), "edp-lines")
    ok = F.col("row").isNotNull() & F.col("row._broken").isNull()
    report = stage(found.groupBy("file").agg(F.count_if(ok).alias("n_rows"), F.count_if(~ok).alias("n_broken")), "edp-report")
    total, bad = report.agg(F.coalesce(F.sum(F.col("n_rows") + F.col("n_broken")), F.lit(0)), F.coalesce(F.sum("n_broken"), F.lit(0))).first()
    if bad > max_broken * total:
        worst = report.orderBy(F.desc("n_broken"), "file").limit(3).collect()
        raise ValueError(f"{bad} of {total} lines are broken, most in " + ", ".join(f"{r.file} ({r.n_broken})" for r in worst))
    return CheckedFiles(found.where(ok).select("row.*").drop("_broken"), found.where(~ok).select("file", "line"), report)
