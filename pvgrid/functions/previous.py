"""The rows before a row of a series, without a task that sees the whole series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvgrid.session import stage


def with_lagged(rows: DataFrame, keys: Sequence[str], chunk: tuple[str, Column], order: Sequence[str], columns: Sequence[str], k: int) -> DataFrame:
    """Add ``_before``, an array of the values of the ``k`` rows before, nearest first; null where there is none.

    A series is cut into chunks, a column by name and definition, that grow with ``order``. A window covers one chunk; what its first rows need from
    the chunks before is a halo of at most ``k`` rows, carried from a summary of ``k`` rows per chunk. The input is
    computed once and staged; both steps read the staged rows.
    """
    cut, value = chunk
    part = [*keys, cut]
    rows = stage(rows.withColumn(cut, value), "series")
    entry = F.struct(*[F.col(c) for c in columns])
    end = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    tails = (rows.select(*part, *dict.fromkeys([*order, *columns])).withColumn("_from_end", F.row_number().over(end))
             .where(F.col("_from_end") <= k).groupBy(*part)
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("_from_end", entry.alias("e")))), lambda x: x["e"]).alias("_tail")))
    # a chunk has a row at least, so k chunks are enough
    past = Window.partitionBy(*keys).orderBy(F.col(cut)).rowsBetween(-k, -1)
    halo = F.slice(F.flatten(F.reverse(F.collect_list("_tail").over(past))), 1, k)
    halos = tails.select(*[F.col(c).alias(f"_of_{c}") for c in part], halo.alias("_halo"))
    inside = Window.partitionBy(*part).orderBy(*order)
    rows = rows.withColumns({"_place": F.row_number().over(inside), **{f"_lag_{i}": F.lag(entry, i).over(inside) for i in range(1, k + 1)}})
    same = [rows[c].eqNullSafe(halos[f"_of_{c}"]) for c in part]
    before = F.array(*[F.when(F.col("_place") > i, F.col(f"_lag_{i}")).otherwise(F.get("_halo", F.lit(i) - F.col("_place")))
                       for i in range(1, k + 1)])
    return (rows.join(halos, same).withColumn("_before", before)
            .drop(cut, "_place", "_halo", *[f"_lag_{i}" for i in range(1, k + 1)], *[f"_of_{c}" for c in part]))


def with_previous(rows: DataFrame, keys: tuple[str, ...], time: str, columns: dict[str, str]) -> DataFrame:
    """Add values of the row before, by time, in the same series; null for the first row.

    ``columns`` maps new names to columns. Rows are one per series and time. The chunks of :func:`with_lagged` are days.
    """
    rows = with_lagged(rows, keys, ("_day", F.to_date(time)), (time,), tuple(dict.fromkeys(columns.values())), 1)
    return rows.withColumns({n: F.get("_before", F.lit(0))[c] for n, c in columns.items()}).drop("_before")
