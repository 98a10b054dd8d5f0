"""Mandated inverter responses as column expressions.

Voltages in V, active power P and rating S in kW/kVA, reactive power Q in kvar with
supply positive. All functions are plain expressions: no UDF, no extra stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pvgrid.functions.exact import strict_greatest, strict_least

# Fixed values of the response curves and class limits.
VOLTWATT_V1, VOLTWATT_V2, VOLTWATT_FLOOR = 253, 260, 0.2
VOLTVAR_V = (207, 220, 240, 258)
VOLTVAR_SUPPLY, VOLTVAR_ABSORB = 0.44, 0.60
TOLERANCE = 0.04
IMPACT_EPS = 1e-9


def voltwatt_limit(v: Column, s: Column, v1: float = VOLTWATT_V1, v2: float = VOLTWATT_V2) -> Column:
    """Highest permitted active power at voltage ``v``; null voltage gives null."""
    low = F.lit(VOLTWATT_FLOOR) * s
    slope = (s - low) / F.lit(float(v1 - v2))
    return (
        F.when(v < v1, s)
        .when(v > v2, low)
        .when(v.isNotNull(), slope * (v - F.lit(float(v2))) + low)
    )


def voltvar_q(v: Column, s: Column, volts: tuple = VOLTVAR_V, supply: float = VOLTVAR_SUPPLY,
              absorb: float = VOLTVAR_ABSORB) -> Column:
    """Reactive set-point: supply below the dead band, absorb above it."""
    v1, v2, v3, v4 = volts
    rise = F.lit(supply) * s / F.lit(float(v1 - v2))
    fall = F.lit(absorb) * s / F.lit(float(v3 - v4))
    return (
        F.when(v < v1, F.lit(supply) * s)
        .when(v < v2, rise * (v - F.lit(float(v2))))
        .when(v <= v3, F.lit(0.0))
        .when(v < v4, fall * (v - F.lit(float(v4))) - F.lit(absorb) * s)
        .when(v.isNotNull(), -(F.lit(absorb) * s))
    )


def voltvar_q_gated(v: Column, p: Column, s: Column, **curve) -> Column:
    """Set-point that is zero while the inverter runs below a fifth of its rating."""
    return F.when(F.abs(p) < F.lit(0.2) * s, F.lit(0.0)).otherwise(voltvar_q(v, s, **curve))


def q_capability(p: Column, s: Column, clamp: bool = True) -> Column:
    """Reactive capability (positive) at active power ``p``.

    Beyond the rating the capability is 0; with ``clamp=False`` it is NaN, the bare
    square root.
    """
    a = F.abs(p)
    at_pf = (a / F.lit(0.8)) * (a / F.lit(0.8)) - a * a
    at_rating = s * s - a * a

    def root(x: Column) -> Column:
        return F.when(x < 0, F.lit(0.0)).otherwise(F.sqrt(x)) if clamp else F.sqrt(x)

    return (
        F.when(a < F.lit(0.2) * s, F.lit(0.0))
        .when(a <= F.lit(0.6) * s, F.lit(0.44) * s)
        .when(a <= F.lit(0.8) * s, root(at_pf))
        .otherwise(root(at_rating))
    )


def q_band(q_set: Column, capability: Column, s: Column,
           tolerance: float = TOLERANCE) -> tuple[Column, Column]:
    """Upper and lower bound of the permitted reactive power.

    An absorbing upper bound is relaxed to what the inverter can absorb, a supplying
    lower bound to what it can supply.
    """
    margin = F.lit(tolerance) * s
    top, bottom = q_set + margin, q_set - margin
    upper = F.when(top < 0, strict_greatest(top, margin - capability)).otherwise(top)
    lower = F.when(bottom > 0, strict_least(bottom, capability - margin)).otherwise(bottom)
    return upper, lower


def q_impact(q: Column, upper: Column, lower: Column, eps: float = IMPACT_EPS) -> Column:
    """Delivered share of the nearer required bound, negative when it opposes it."""
    to_upper = F.abs(q) / (F.abs(upper) + F.lit(eps))
    to_lower = F.abs(q) / (F.abs(lower) + F.lit(eps))
    nearer_upper = to_upper <= to_lower
    share = F.when(nearer_upper, to_upper).otherwise(to_lower)
    bound = F.when(nearer_upper, upper).otherwise(lower)
    sign = F.when(upper + lower == 0, F.lit(1.0)).otherwise(F.signum(bound) * F.signum(q))
    return sign * share


def apparent_power(p: Column, q: Column) -> Column:
    return F.sqrt(p * p + q * q)


def power_factor(p: Column, q: Column) -> Column:
    """P/S, null where the apparent power is zero."""
    return F.try_divide(p, apparent_power(p, q))
