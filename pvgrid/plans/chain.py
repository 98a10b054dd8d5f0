"""The estimator chain: from structured rows to a model and the sites it may be used for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from typing import TypeVar

from pyspark.sql import DataFrame

from pvgrid.operators import estimator
from pvgrid.operators.site import site_power
from pvgrid.session import buckets_for, path_exists, stage, stage_bucketed, staged_paths

T = TypeVar("T")


@dataclass
class Fitted:
    """Staged structured rows, their labelled training rows and the model fitted on them."""

    structured: DataFrame
    labelled: DataFrame
    model: DataFrame

    def accepted_sites(self, limit: float = 50) -> DataFrame:
        """Sites whose error stays below the limit on training and validation days."""
        return estimator.acceptable_sites(estimator.model_metrics(self.labelled, self.model), limit)

    def all_uncurtailed(self) -> DataFrame:
        return estimator.all_uncurtailed(self.structured, self.model, self.accepted_sites())

    def voltwatt_uncurtailed(self) -> DataFrame:
        return estimator.voltwatt_uncurtailed(self.structured, self.model, self.accepted_sites())


#: What a stored row is found by. A site's rows are dealt to all buckets, so a large site fills none of them.
READING = ("site_id", "t_stamp")


@dataclass
class SiteRows:
    """All PV sites' rows from one scan of the readings, staged; the eligible ones with their cell."""

    every: DataFrame
    eligible: DataFrame


def site_rows(ts: DataFrame, meta: DataFrame, buckets: int) -> SiteRows:
    """Aggregate the readings once for the reports and for the estimator, which skips flexible-export sites.

    The readings are dealt to tasks as the rows are to buckets, so that one shuffle serves both.
    """
    rows = stage_bucketed(site_power(ts, meta, cell=True, tasks=buckets), "site_rows", READING, buckets=buckets)
    wanted = meta.where("is_pv AND NOT flex_export_detected").select("site_id").distinct()
    return SiteRows(rows.drop("latitude", "longitude"), rows.join(wanted, "site_id", "left_semi"))


#: What the chain reads of structured rows, and of training rows; other columns would only be shuffled and stored.
STRUCTURED = ("site_id", "t_stamp", "actual_day", "V", "P_kw_norm", "S_norm", "GHI", "P_kw_norm_cs", "GHI_cs", "S_99")
LABELLED = ("site_id", "t_stamp", "actual_day", "V", "P_kw_norm", "S_norm", "P_kw_norm_cs", "S_99", "tod_bin", "x", "y")


def fit(structured: DataFrame, fraction: float = 0.8, seed: int = 0) -> Fitted:
    """Split days, label the rows and fit the model; each table later steps read is staged.

    The days are those of all unconstrained rows, also of days without a row that may
    train; the training rows take their day's label.
    """
    table = stage(structured.select(*STRUCTURED), "structured")
    days = estimator.split_days(estimator.eligible_rows(table, "split"), fraction, seed)
    rows = estimator.eligible_rows(table, "train").select(*LABELLED)
    labelled = stage(rows.join(days, ["site_id", "actual_day"]), "labelled")
    model = stage(estimator.fit_ghi_norm_model(labelled.where("day_type = 'train'")), "model")
    return Fitted(table, labelled, model)


class HandOff:
    """What the chain hands to later reports, each table stored once, when it is first asked for.

    Site rows and both tables of estimates are bucketed by site and time, so the reports join them without a
    shuffle of either; structured rows and model are staged by :func:`fit`.
    """

    def __init__(self, ts: DataFrame, meta: DataFrame, eligible: Callable[[], DataFrame],
                 structured: Callable[[DataFrame], DataFrame]) -> None:
        self._ts, self._meta, self._eligible, self._structured = ts, meta, eligible, structured
        self._paths: list[str] = []

    @cached_property
    def buckets(self) -> int:
        """Of all stored tables, so that they join without a shuffle."""
        return buckets_for(self._ts)

    def _stored(self, make: Callable[[], T]) -> T:
        """``make()``, with a note of where it stages its tables."""
        before = len(staged_paths(self._ts.sparkSession))
        made = make()
        self._paths += staged_paths(self._ts.sparkSession)[before:]
        return made

    def intact(self) -> bool:
        """Whether nobody has deleted what was stored."""
        return all(path_exists(self._ts.sparkSession, path) for path in self._paths)

    @cached_property
    def site(self) -> SiteRows:
        return self._stored(lambda: site_rows(self._ts, self._meta, self.buckets))

    @cached_property
    def chain(self) -> Fitted:
        """The fitted chain; from the stored site rows if there are any, so that readings are scanned once."""
        rows = self.site.eligible if "site" in vars(self) else self._eligible()
        return self._stored(lambda: fit(self._structured(rows)))

    @cached_property
    def all_uncurtailed(self) -> DataFrame:
        chain = self.chain
        return self._stored(lambda: stage_bucketed(chain.all_uncurtailed(), "all_uncurtailed", READING, buckets=self.buckets))

    @cached_property
    def voltwatt_uncurtailed(self) -> DataFrame:
        chain = self.chain
        return self._stored(lambda: stage_bucketed(chain.voltwatt_uncurtailed(), "voltwatt_uncurtailed", READING,
                                                   buckets=self.buckets))
