"""All registered queries."""

from __future__ import annotations

from pvgrid.plans import (  # noqa: F401  (each module registers its queries)
    conformance_queries,
    estimator_queries,
    impact_queries,
    site_data_queries,
    storage_queries,
)
from pvgrid.plans.registry import QUERIES, SQL  # noqa: F401
