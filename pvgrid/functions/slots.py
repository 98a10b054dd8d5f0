"""Exact numbers of different time stamps in a calendar month, from bitmaps of five-minute slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_MICROS = 300_000_000


def distinct_times(t: Column, where: Column | None = None) -> Column:
    """Number of different time stamps, all of one month, that meet a condition; an aggregate.

    A month has at most 8928 slots of five minutes, one bit each, so the distinct times of a group are one bitmap that
    tasks combine: no shuffle of time stamps. Times off the grid, which there should be few of, are kept as a set, so
    the number is exact for any times.
    """
    where = t.isNotNull() if where is None else F.coalesce(where, F.lit(False)) & t.isNotNull()
    micros = F.unix_micros(t)
    on_grid = micros % SLOT_MICROS == 0
    slot = ((micros - F.unix_micros(F.date_trunc("month", t))) / SLOT_MICROS).cast("long")
    # bit positions are those of numbers from 1 on
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.when(where & on_grid, slot + 1)))
    return F.bitmap_count(bits) + F.size(F.collect_set(F.when(where & ~on_grid, micros)))
