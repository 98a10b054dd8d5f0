"""SQL text of the views in :mod:`pvgrid.plans.views`, and small SQL text helpers."""

from __future__ import annotations


def mic(x: str) -> str:
    return f"CAST(floor(({x}) * 1e6 + 0.5e0) AS BIGINT)"


def xsum(x: str, scale: str = "1e6") -> str:
    return f"CAST(SUM({mic(x)}) AS DOUBLE) / {scale}"


def xavg(x: str) -> str:
    return f"CAST(SUM({mic(x)}) AS DOUBLE) / 1e6 / NULLIF(COUNT({x}), 0)"


def q6(x: str, scale: str = "1e6") -> str:
    return f"floor(({x}) * {scale} + 0.5e0) / {scale}"


def npos(x: str) -> str:
    return f"CAST(SUM(CASE WHEN {x} > 0 THEN 1 ELSE 0 END) AS BIGINT)"


def pick(values: tuple[str, ...], index: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {cases} END"


def sample_time(d: str, k: str) -> str:
    return (f"TIMESTAMP '2023-12-31 22:00:00' + to_minutes(CAST(({d} + CASE WHEN {d} >= 6 THEN 52 ELSE 0 END)"
            f" * 1440 + {k} * 5 + CASE WHEN {k} >= 15 THEN 480 ELSE 0 END AS BIGINT))")


def cap(s: str) -> str:
    return f"CAST(4 + {s} % 3 * 2 AS DOUBLE)"


def bell(k: str) -> str:
    return f"(1e0 - CAST(abs({k} - 15) AS DOUBLE) / 2e1)"


def local_day(t: str) -> str:
    return f"CAST({t} + INTERVAL 10 HOUR AS DATE)"


def tod(t: str, minutes: int = 5) -> str:
    lt = f"({t} + INTERVAL 10 HOUR)"
    return f"CAST(hour({lt}) * 60 + minute({lt}) - minute({lt}) % {minutes} AS BIGINT)"


def day_night(t: str) -> str:
    return f"CASE WHEN hour({t}) >= 20 OR hour({t}) <= 7 THEN 'day' ELSE 'night' END"


YMD = "year(t_stamp) AS year, month(t_stamp) AS month, day(t_stamp) AS day"
SIGN = "CASE WHEN slot = 1 THEN -1e0 ELSE 1e0 END"

VIEWS: dict[str, str] = {}

VIEWS["placed"] = """
SELECT site_id, okey, q, dsc, tax, place % 3 AS slot, (place // 3) // 30 AS d, (place // 3) % 30 AS k
FROM (SELECT l_suppkey AS site_id, l_orderkey AS okey, l_quantity AS q, l_discount AS dsc, l_tax AS tax,
             (l_orderkey * 3 + l_linenumber * 401 + l_partkey * 7) % 1080 AS place FROM lineitem)
"""

VIEWS["ts"] = f"""
SELECT site_id AS device_id, site_id * 10 + slot AS circuit_id, {sample_time('d', 'k')} AS t_stamp,
       slot < 2 AS is_pv,
       CASE WHEN slot < 2 THEN {SIGN} * CASE WHEN site_id % 10 = 0 AND k >= 20 THEN {cap('site_id')} * 450e0
                 ELSE {cap('site_id')} * 500e0 * {bell('k')} * (0.55e0 + dsc * 6e0) END
            ELSE {cap('site_id')} * 1000e0 * (dsc * 8e0 - 0.3e0) END AS power,
       {SIGN} * {cap('site_id')} * 1000e0 / 24e0 * (0.2e0 - tax * 10e0) AS energy_reactive,
       CASE WHEN okey % 83 = 0 THEN NULL WHEN okey % 89 = 0 THEN -5e0 WHEN okey % 97 = 0 THEN 310e0
            ELSE CASE WHEN site_id % 6 = 0 THEN 204e0 ELSE 236e0 END + 0.6e0 * q END AS voltage
FROM placed
"""

_STATES = ("NSW", "QLD", "SA", "VIC", "WA")
_NETWORKS = ("Energex", "Ergon", "Ausgrid", "SAPN", "Jemena", "CitiPower")
_MAKERS = ("SolarEdge", "Fronius", "SMA", "GoodWe", "Sungrow", "Solaredge", "Goodwe", "SolaX Power",
           "SolaX", "Generic Inverter", "Enphase")

VIEWS["meta"] = f"""
SELECT s AS site_id, s * 10 + slot AS circuit_id, CASE WHEN slot = 1 THEN -1 ELSE 1 END AS circuit_polarity,
       CASE WHEN slot < 2 THEN CASE WHEN s % 2 = 0 THEN 'pv_site_net' ELSE 'pv_inverter' END
            WHEN s % 4 = 0 THEN 'load_hot_water' ELSE 'ac_load_net' END AS circuit_type,
       slot < 2 AS is_pv, {cap('s')} AS ac_capacity_kw, 0.95e0 * {cap('s')} AS S_99,
       CAST(-(10 + s % 25) AS DOUBLE) AS n_lat, CAST(120 + s % 25 AS DOUBLE) AS n_long,
       {pick(_STATES, 'n % 5')} AS state, {pick(_NETWORKS, 's % 6')} AS dnsp_name,
       CASE WHEN s % 13 = 0 THEN NULL ELSE {pick(_MAKERS, 's % 11')} END AS manufacturer,
       CASE WHEN s % 17 = 0 THEN NULL ELSE DATE '2023-10-01' + CAST(s % 40 * 20 AS INTEGER) END AS pv_install_date,
       CASE WHEN s % 19 = 0 THEN NULL ELSE CAST(2000 + n AS BIGINT) END AS postcode,
       0.9e0 + CAST(s % 10 AS DOUBLE) / 100e0 AS pf_01, s % 10 = 0 AS flex_export_detected
FROM (SELECT s_suppkey AS s, s_nationkey AS n FROM supplier), (SELECT unnest([0, 1, 2]) AS slot)
"""

VIEWS["solar"] = f"""
SELECT {sample_time('d', 'k')} AS time, CAST(-(10 + c) AS DOUBLE) AS latitude, CAST(120 + c AS DOUBLE) AS longitude,
       CASE WHEN (c * d + k) % 37 = 0 THEN NULL
            ELSE 900e0 * {bell('k')} * (0.5e0 + 0.05e0 * CAST((c * 7 + d * 3 + k) % 10 AS DOUBLE)) END AS GHI,
       CAST(CASE WHEN (c + d) % 5 = 0 THEN 0
            ELSE (c + d * 5 + k % 3) % 6 + CASE WHEN c % 5 = 4 THEN 3 ELSE 0 END END AS BIGINT) AS cloud_type,
       CAST(2000 + c AS BIGINT) AS postcode
FROM (SELECT c, p // 15 AS d, p % 15 * 2 AS k
      FROM (SELECT o_custkey % 25 AS c, (o_orderkey * 7 + o_custkey // 25) % 180 AS p FROM orders))
"""

VIEWS["edp_readings"] = """
SELECT 'S' || CAST(circuit_id // 10 AS VARCHAR) AS edp_site_id,
       'C' || CAST(circuit_id % 10 AS VARCHAR) AS edp_circuit_label,
       'D' || CAST(circuit_id AS VARCHAR) AS edp_device_and_circuit,
       CASE WHEN circuit_id % 10 < 2 THEN 'pv_site_net' ELSE 'ac_load_net' END AS circuit_label,
       t_stamp + to_minutes(630) AS datetime,
       CASE WHEN circuit_id % 10 = 1 THEN -1e0 ELSE 1e0 END * power / 12e0 AS real_energy,
       CASE WHEN circuit_id % 10 = 1 THEN -1e0 ELSE 1e0 END * energy_reactive AS reactive_energy,
       power / 240e0 AS current_avg, voltage AS voltage_avg
FROM ts
"""

VIEWS["edp_sites"] = """
SELECT 'S' || CAST(s AS VARCHAR) AS edp_site_id, CASE WHEN s % 3 = 0 THEN 'VIC' ELSE 'SA' END AS state,
       CAST(1 + s % 3 AS DOUBLE) AS inverter_ac_rating_kw,
       CASE WHEN (s + unit) % 4 = 0 THEN NULL ELSE 1 + s % 2 END AS inverter_count
FROM (SELECT s_suppkey AS s FROM supplier), (SELECT unnest([0, 1]) AS unit)
"""

VIEWS["edp_postcodes"] = """
SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS edp_site_id, CAST(5000 + s_nationkey AS BIGINT) AS postcode
FROM supplier WHERE s_acctbal >= 0
"""

VIEWS["metered"] = "SELECT * FROM meta WHERE is_pv OR site_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 4500)"

VIEWS["locations"] = """
SELECT c_custkey AS point_id, -40e0 + CAST(c_custkey * 37 % 400 AS DOUBLE) / 16e0 AS latitude,
       115e0 + CAST(c_custkey * 91 % 560 AS DOUBLE) / 16e0 AS longitude FROM customer
"""

VIEWS["stations"] = """
SELECT s AS station_number,
       CASE WHEN s % 3 = 0 THEN -33e0 + CAST(s * 7 % 64 AS DOUBLE) / 1024e0
            ELSE -40e0 + CAST(s * 53 % 200 AS DOUBLE) / 8e0 END AS latitude,
       CASE WHEN s % 3 = 0 THEN 151e0 + CAST(s * 11 % 64 AS DOUBLE) / 1024e0
            ELSE 115e0 + CAST(s * 29 % 280 AS DOUBLE) / 8e0 END AS longitude
FROM (SELECT s_suppkey AS s FROM supplier)
"""

VIEWS["air_temperature"] = """
SELECT o_custkey % 40 AS station_number, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey * 60 % 525600) AS datetime,
       10e0 + CAST(o_orderkey * 13 % 300 AS DOUBLE) / 10e0 AS temp, o_orderkey % 2 AS state_table FROM orders
"""

VIEWS["site_stations"] = """
SELECT s_suppkey AS site_id, s_suppkey % 40 AS station_1, (s_suppkey + 7) % 40 AS station_2,
       (s_suppkey + 15) % 40 AS station_3 FROM supplier
"""

VIEWS["daily_ghi"] = f"""
SELECT station, time, CAST(time AS DATE) AS date,
       200e0 + (24 - abs(hour(time) * 2 + minute(time) // 30 - 24)) * 20e0
       + noise * CASE WHEN day(time) % 2 = 0 THEN 0.05e0 ELSE 1e0 END AS ghi_mean
FROM (SELECT user_id % 5 AS station, time_bucket(INTERVAL 30 MINUTE, ts) AS time, {xavg('value')} AS noise
      FROM events GROUP BY ALL)
"""

VIEWS["clear_labels"] = """
SELECT DISTINCT user_id % 5 AS station, CAST(ts AS DATE) AS date,
       (day(ts) + user_id % 5) % 3 = 0 AS is_clear, (day(ts) + user_id % 5) % 5 = 0 AS unsure FROM events
"""


def site(v: str = "voltage > 0 AND voltage < 300", volts: str | None = None, pv_meta: bool = True,
         meta: str = "meta", pv: str = "is_pv") -> str:
    """Site totals per time stamp from ts and metadata."""
    volts = volts or xavg("voltage")
    where = "WHERE is_pv" if pv_meta else ""
    return f"""
SELECT site_id, t_stamp, {xsum('power * circuit_polarity', '1e9')} AS P_kW,
       CAST(SUM({mic('energy_reactive * circuit_polarity')}) * 12 AS DOUBLE) / 1e9 AS Q_kvar,
       {volts} AS V, MAX(ac_capacity_kw) AS ac_capacity_kw, MAX(S_99) AS S_99
FROM (SELECT * FROM ts WHERE {pv} AND {v}) AS r
JOIN (SELECT DISTINCT site_id, circuit_id, circuit_polarity, ac_capacity_kw, S_99 FROM {meta} {where}) AS m
  USING (circuit_id)
GROUP BY site_id, t_stamp
"""


def with_views(final: str, *ctes: tuple[str, str], views: tuple[str, ...] = ()) -> str:
    """One statement: the named views, further CTEs in order, and the final SELECT."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in views] + [f"{n} AS ({body})" for n, body in ctes]
    return f"WITH {', '.join(parts)} {final}"
