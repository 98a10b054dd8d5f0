"""Discrete quantiles over groups and over short sliding frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

ACCURACY = 10000


def group_quantile(x: Column, p: float) -> Column:
    """Mergeable quantile sketch: bounded memory per group, exact for small groups."""
    return F.percentile_approx(x, F.lit(p), F.lit(ACCURACY))


def group_quantiles(x: Column, ps: Iterable[float]) -> Column:
    """Several quantiles from one sketch, as an array in the order of ``ps``."""
    return F.percentile_approx(x, F.array(*[F.lit(float(p)) for p in ps]), F.lit(ACCURACY))


def frame_quantile(x: Column, ordered: WindowSpec, p: float = 0.6, before: int = 3, after: int = 3) -> Column:
    """Quantile over the rows ``before`` .. ``after`` of the current row, nulls ignored.

    The frame is an array of neighbours that is sorted per row: plain expressions over
    one window, no sketch. The value is the least one that at least ``p`` of the frame's
    values don't exceed.
    """
    frame = F.array(*[F.lag(x, -k).over(ordered) if k < 0 else F.lead(x, k).over(ordered) if k else x
                      for k in range(-before, after + 1)])
    known = F.array_sort(F.filter(frame, lambda v: v.isNotNull()))
    return F.get(known, F.greatest(F.ceil(F.size(known) * F.lit(p)) - 1, F.lit(0)).cast("int"))
