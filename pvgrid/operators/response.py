"""Response bands: what each inverter had to do at every time stamp."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvgrid.functions import curves


def response_bands(site: DataFrame, tolerance: float = curves.TOLERANCE) -> DataFrame:
    """Site rows plus P_limit, Q_set, Q_cap, Q_max, Q_min and Q_impact."""
    s, p, q, v = (F.col(c) for c in ("ac_capacity_kw", "P_kW", "Q_kvar", "V"))
    site = site.withColumns({
        "P_limit": curves.voltwatt_limit(v, s),
        "Q_set": curves.voltvar_q(v, s),
        "Q_cap": curves.q_capability(p, s),
    })
    upper, lower = curves.q_band(F.col("Q_set"), F.col("Q_cap"), s, tolerance)
    site = site.withColumns({"Q_max": upper, "Q_min": lower})
    return site.withColumn("Q_impact", curves.q_impact(q, F.col("Q_max"), F.col("Q_min")))
