"""A global row number that no single task has to produce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvgrid.session import stage


def global_ordinal(df: DataFrame, *order: Column, name: str = "ordinal") -> DataFrame:
    """Number rows 0, 1, 2 ... in the given order.

    A distributed range sort gives each row its sorted partition and its place in it;
    only the row count per partition is summed up globally. The sorted rows are staged
    so that both steps see the same partitions.
    """
    place = F.monotonically_increasing_id()
    rows = stage(df.orderBy(*order).withColumn("_place", place), "ordinal").withColumns({
        "_part": F.shiftright("_place", 33),
        "_row": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("_part").agg(F.count("*").alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return (rows.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_row"))
            .drop("_place", "_part", "_row", "_start"))
