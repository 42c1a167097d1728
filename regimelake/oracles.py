"""DuckDB SQL for the queries of the suite, written from the published definitions, not from the engine."""

from __future__ import annotations

from . import suite as Q
from .sources.views import _JANUARY, DAY, EVENTS, FIRST_HOUR, LAST_HOUR

_A = "(CAST(2 AS DOUBLE) / 11)"
_SLOW = "(CAST(2 AS DOUBLE) / 721)"
_HOUR = 3_600_000_000


def _blk(chain: str = "'evt'") -> str:
    return f"""blk AS (SELECT {chain} AS chain, event_id AS number, epoch_us(ts) AS us, value AS gas_used, CAST(600 AS DOUBLE) AS gas_limit,
        CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS tx, value * length(event_type) AS size, event_type, length(props) AS input_bytes, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) % 7 AS blobs FROM events)"""


def _inv(chain: str = "'evt'") -> str:
    return f"""WITH RECURSIVE {_blk(chain)},
    wb AS (SELECT *, (row_number() OVER (PARTITION BY chain ORDER BY number) - 1) // {Q.PHI} AS window_id FROM blk),
    inv AS (SELECT chain, window_id, min(us) AS start_us, max(us) AS end_us, count(*) AS block_count, min(number) AS first_block, max(number) AS last_block,
        ((max(us) - min(us)) // 1000) / CAST(1000 AS DOUBLE) / (count(*) - 1) AS rho_ts, avg(gas_used / nullif(gas_limit, 0)) AS rho_s,
        avg(size) AS size_avg, avg(tx) AS tx_count_avg, avg(gas_used) AS gas_used_avg, count(*) / CAST({Q.PHI} AS DOUBLE) AS c_s
        FROM wb GROUP BY chain, window_id HAVING count(*) >= 2),
    tr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY window_id) - 1 AS idx FROM
        (SELECT *, min(window_id) OVER (PARTITION BY chain) AS lo, max(window_id) OVER (PARTITION BY chain) AS hi FROM inv) WHERE window_id > lo AND window_id < hi)"""


def _fold(name: str, source: str, columns: dict[str, str], alpha: str, part: str = "chain", order: str = "idx", first: str | None = None) -> str:
    """A recursive baseline; nulls hold it."""
    start = ", ".join(f"CAST({f'coalesce({x}, {first})' if first else x} AS DOUBLE) AS {n}" for n, x in columns.items())
    step = ", ".join(f"CASE WHEN t.{x} IS NULL THEN p.{n} WHEN p.{n} IS NULL THEN t.{x} ELSE {alpha} * t.{x} + (1 - {alpha}) * p.{n} END" for n, x in columns.items())
    return f"""{name} AS (SELECT {part}, {order}, {start} FROM {source} WHERE {order} = 0 UNION ALL
        SELECT t.{part}, t.{order}, {step} FROM {name} p JOIN {source} t ON t.{part} = p.{part} AND t.{order} = p.{order} + 1)"""


_RATIO = {"rhythm": "rho_ts", "sigma": "rho_s", "size_r": "size_avg", "tx_r": "tx_count_avg"}


def _rat(chain: str = "'evt'", warm: int = 50, alpha: str = _A) -> str:
    cols = ", ".join(f"CASE WHEN tr.idx > {warm} THEN tr.{c} / nullif(em.e_{n}, 0) END AS {n}" for n, c in _RATIO.items())
    return f"{_inv(chain)}, {_fold('em', 'tr', {f'e_{n}': c for n, c in _RATIO.items()}, alpha)}, rat AS MATERIALIZED (SELECT tr.*, {cols} FROM tr JOIN em USING (chain, idx))"


def _ge(c: str, t) -> str:
    return f"coalesce({c} >= {t}, false)"


_DIMS = f"(CAST({_ge('sigma', 1.10)} AS INTEGER) + CAST({_ge('size_r', 1.20)} AS INTEGER) + CAST({_ge('tx_r', 1.10)} AS INTEGER))"
_GT = "gt AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {_JANUARY + (a - 1) * DAY}, {_JANUARY + (b - 1) * DAY}, {x})" for n, a, b, x in EVENTS) + ") v(event, onset, until, expected))"
_SC = f"{_rat()}, {_GT}, sc AS MATERIALIZED (SELECT *, {_DIMS} AS d2_dims, (CASE WHEN {_ge('rhythm', 1.12)} THEN 'S2' ELSE 'S1' END) || (CASE WHEN {_DIMS} >= 2 THEN 'D2' ELSE 'D1' END) AS state FROM rat), nm AS (SELECT * FROM sc WHERE idx > 50 AND NOT EXISTS (SELECT 1 FROM gt WHERE start_us BETWEEN onset AND until))"
_BAD = "state IN ('S2D1', 'S2D2', 'S1D2')"
_DET = f"{_SC}, det AS (SELECT event, onset, count(start_us) AS n_window, count(*) FILTER (WHERE list_contains(expected, state)) AS n_detected, min(start_us) FILTER (WHERE list_contains(expected, state)) AS first_us FROM gt LEFT JOIN sc ON start_us BETWEEN onset AND until GROUP BY event, onset)"
_FPR = f"avg(CASE WHEN {_BAD} THEN 1.0 ELSE 0.0 END)"

_SLOT = f"""WITH RECURSIVE {_blk()}, sl AS (SELECT chain, us // 60000000 AS slot, us FROM blk WHERE event_type = 'error'),
    sw AS (SELECT chain, slot // {Q.SLOT_PHI} AS window_id, count(*) AS block_count, min(us) AS start_us, max(us) AS end_us,
        round(((max(us) - min(us)) // 1000) / CAST(1000 AS DOUBLE) / (count(*) - 1), 6) AS rho_ts, round(count(*) / CAST({Q.SLOT_PHI} AS DOUBLE), 6) AS c_s FROM sl GROUP BY 1, 2 HAVING count(*) >= 2),
    st AS (SELECT * FROM sw WHERE window_id > (SELECT min(window_id) FROM sw) AND window_id < (SELECT max(window_id) FROM sw)),
    sp AS (SELECT unnest(range(min(window_id), max(window_id) + 1)) AS window_id, min(window_id) AS lo FROM st),
    sn AS MATERIALIZED (SELECT 'evt' AS chain, sp.window_id - lo AS idx, sp.window_id, block_count, rho_ts, c_s, start_us FROM sp LEFT JOIN st USING (window_id)),
    gf AS MATERIALIZED (SELECT chain, idx, window_id, coalesce(block_count, 0) AS block_count, coalesce(rho_ts, 999.0) AS rho_ts, coalesce(c_s, 0.0) AS c_s, coalesce(start_us, window_id * 320000000) AS start_us, least(coalesce(rho_ts, 999.0), 5.0) AS z FROM sn)"""
_SLOT_SC = f"{_SLOT}, {_fold('se', 'gf', {'e': 'z'}, _A)}, ss AS MATERIALIZED (SELECT gf.*, CASE WHEN gf.idx > 50 THEN least(rho_ts, 20.0) / e END AS rhythm FROM gf JOIN se USING (chain, idx)), {_GT}"


def _hours(name: str, where: str, least: int = 1) -> str:
    """All hours of the fixture's range; hours of fewer than `least` blocks are missing."""
    return f"""{name}b AS (SELECT *, us // {_HOUR} AS hour, (us - lag(us) OVER (PARTITION BY us // {_HOUR} ORDER BY us, number)) / CAST(1000000 AS DOUBLE) AS gap FROM blk WHERE {where}),
    {name}h AS (SELECT hour, count(*) AS block_count, CASE WHEN count(*) >= 2 THEN coalesce(avg(gap) FILTER (WHERE gap > 0 AND gap < 60), 12.0) END AS interval, avg(size) AS size_avg, avg(tx) AS tx_avg, avg(gas_used) AS gas_avg, avg(tx) AS blob_avg, avg(gas_used) AS basefee_avg FROM {name}b GROUP BY hour HAVING count(*) >= {least}),
    {name} AS MATERIALIZED (SELECT 'evt' AS chain, hour, hour - {FIRST_HOUR} AS idx, coalesce(block_count, 0) AS block_count, CAST(block_count AS DOUBLE) AS n, interval, size_avg, tx_avg, gas_avg, blob_avg, basefee_avg
        FROM (SELECT unnest(range({FIRST_HOUR}, {LAST_HOUR})) AS hour) LEFT JOIN {name}h USING (hour))"""


def _hourly(name: str, columns: dict[str, str]) -> str:
    r = ", ".join(f"CASE WHEN h.idx >= 20 AND h.{c} IS NOT NULL THEN CASE WHEN coalesce(p.{n}, 0) = 0 THEN 1.0 ELSE h.{c} / p.{n} END END AS {n}" for n, c in columns.items())
    return f"{_fold(name + 'e', name, columns, '0.1')}, {name}r AS MATERIALIZED (SELECT h.*, {r} FROM {name} h LEFT JOIN {name}e p ON p.idx = h.idx - 1)"


def _regime(structure: str, demand: str) -> str:
    return f"CASE WHEN {structure} AND {demand} THEN 'S2D2' WHEN {structure} THEN 'S2D1' WHEN {demand} THEN 'S1D2' ELSE 'S1D1' END"


_SIGMA1 = "((size_r + tx_r + blob_r) / 3)"
_L1 = f"WITH RECURSIVE {_blk()}, {_hours('a', 'true', 2)}, {_hourly('a', {'interval_r': 'interval', 'size_r': 'size_avg', 'tx_r': 'tx_avg', 'blob_r': 'blob_avg'})}, l1 AS (SELECT *, {_SIGMA1} AS sigma, CASE WHEN idx >= 20 AND block_count > 0 THEN {_regime('interval_r > 1.10', f'{_SIGMA1} > 1.10')} END AS l1_state FROM ar)"
_HC = _hours("c", "event_type = 'click'")
_CR = {"count_r": "n", "size_r": "size_avg", "gas_r": "gas_avg"}
_SIGMA2 = "((size_r + gas_r) / 2)"
_L2 = f"{_HC}, {_hourly('c', _CR)}, l2 AS (SELECT *, {_SIGMA2} AS sigma, CASE WHEN idx >= 20 AND n IS NOT NULL THEN {_regime('count_r < 0.90', f'{_SIGMA2} > 1.10')} END AS l2_state FROM cr)"
_GAPS = "pg AS (SELECT number, us, (us - lag(us) OVER (ORDER BY us, number)) / CAST(60000000 AS DOUBLE) AS own FROM blk WHERE event_type = 'purchase'), bg AS (SELECT number, us, last_value(own) OVER (PARTITION BY us ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS gap FROM pg)"
_ALL_HOURS = f"hr AS (SELECT unnest(range({FIRST_HOUR}, {LAST_HOUR})) AS hour)"
_LAST = f"{_ALL_HOURS}, lb AS (SELECT hour, hour - {FIRST_HOUR} AS idx, (SELECT max(us) FROM blk WHERE event_type = 'purchase' AND us < (hr.hour + 1) * {_HOUR}) AS last_us FROM hr)"
_BR = f"""{_GAPS}, {_LAST}, gh AS (SELECT us // {_HOUR} AS hour, nullif(avg(gap), 0) AS gap FROM bg WHERE gap < 60 GROUP BY 1), bh AS MATERIALIZED (SELECT 'evt' AS chain, lb.hour, lb.idx, last_us, gap FROM lb LEFT JOIN gh USING (hour)),
    {_fold('be', 'bh', {'e': 'gap'}, '0.1')}, br AS (SELECT bh.hour, bh.idx, coalesce(((bh.hour + 1) * {_HOUR} - last_us) / CAST(60000000 AS DOUBLE), 9999.0) AS age_min, p.e AS baseline FROM bh LEFT JOIN be p ON p.idx = bh.idx - 1),
    bs AS (SELECT *, CASE WHEN baseline IS NOT NULL AND age_min > 2 * baseline THEN 'BS2' ELSE 'BS1' END AS bs FROM br WHERE idx >= 20)"""
_COMP = f"""{_L1}, {_L2}, {_BR}, three AS (SELECT l1.*, bs.bs, bs.age_min, bs.baseline, l2.l2_state, l2.sigma AS sigma2, l2.count_r AS count2, l2.basefee_avg AS fee2 FROM l1 JOIN bs USING (hour) LEFT JOIN l2 ON l2.hour = l1.hour WHERE l1.l1_state IS NOT NULL),
    comp AS (SELECT strftime(make_timestamp(hour * {_HOUR}), '%Y-%m-%d %H:%M:%S') AS window_start, l1_state AS l1_regime, round(sigma, 6) AS l1_sigma_ratio, round(interval_r, 6) AS l1_interval_ratio, round(blob_r, 6) AS l1_blob_ratio, round(basefee_avg, 6) AS l1_basefee_gwei,
        bs AS bridge_regime, round(age_min, 6) AS bridge_last_age_min, round(nullif(baseline, 0), 6) AS bridge_ema_min,
        coalesce(l2_state, 'N/A') AS l2_regime, CASE WHEN l2_state IS NOT NULL THEN round(sigma2, 6) END AS l2_sigma_ratio, CASE WHEN l2_state IS NOT NULL THEN round(count2, 6) END AS l2_count_ratio, CASE WHEN l2_state IS NOT NULL THEN round(fee2, 6) END AS l2_basefee_gwei,
        CASE WHEN bs = 'BS2' AND l2_state IN ('S1D2', 'S2D1', 'S2D2') THEN 'MULTI_LAYER' WHEN bs = 'BS2' THEN 'BRIDGE_ONLY' WHEN l2_state IN ('S1D2', 'S2D1', 'S2D2') THEN 'L2_ONLY' ELSE 'NORMAL' END AS composite,
        basefee_avg > {Q.VISIBLE_FEE} AS fee_monitor_visible, (bs = 'BS2' OR coalesce(l2_state IN ('S2D1', 'S2D2'), false)) AS alert FROM three)"""
_RELAY = f"""{_GAPS}, {_ALL_HOURS}, tr_ AS (SELECT us // {_HOUR} AS hour, avg(gap) AS t_relay, count(*) AS throughput FROM bg GROUP BY 1), pe AS (SELECT us // {_HOUR} AS hour, count(*) AS pending FROM blk WHERE event_type = 'click' GROUP BY 1),
    rh AS MATERIALIZED (SELECT 'evt' AS chain, hour, hour - {FIRST_HOUR} AS idx, t_relay, throughput, pending FROM hr LEFT JOIN tr_ USING (hour) LEFT JOIN pe USING (hour)), {_fold('re', 'rh', {'e': 't_relay'}, '0.1')},
    rg AS (SELECT rh.hour, t_relay / nullif(p.e, 0) AS latency_ratio, pending / nullif(CAST(throughput AS DOUBLE), 0) AS backlog_ratio FROM rh LEFT JOIN re p ON p.idx = rh.idx - 1),
    grid AS (SELECT *, CASE WHEN coalesce(latency_ratio > 2, false) THEN CASE WHEN coalesce(backlog_ratio > 1, false) THEN 'BS2L2' ELSE 'BS2L1' END WHEN coalesce(backlog_ratio > 1, false) THEN 'BS1L2' ELSE 'BS1L1' END AS grid FROM rg)"""
_MULTI = _rat("event_type", 5)


def _grid(columns: str, rows) -> str:
    return "gr AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"CAST({float(x)} AS DOUBLE)" for x in r) + ")" for r in rows) + f") v({columns}))"


def _swept(base: str, keys: str, state: str, source: str) -> str:
    """fpr, n_s2, n_d2, n_detected, and of each incident whether and after how many hours, for each grid point, as the relation swp."""
    names = [e[0] for e in EVENTS]
    hours = ", ".join(f"min(start_us - onset) FILTER (WHERE event = '{e}') / CAST({_HOUR} AS DOUBLE) AS {e}_h" for e in names)
    out = ", ".join(f"h.{e}_h IS NOT NULL AS {e}_detected, round(h.{e}_h, 4) AS {e}_latency_h" for e in names)
    return f"""{base}, w AS (SELECT {keys}, idx, start_us, {state} AS state FROM {source} CROSS JOIN gr WHERE idx > 50),
    f AS (SELECT {keys}, round(avg(CASE WHEN {_BAD} THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT EXISTS (SELECT 1 FROM gt WHERE start_us BETWEEN onset AND until)), 4) AS fpr, count(*) FILTER (WHERE state LIKE 'S2%') AS n_s2, count(*) FILTER (WHERE state LIKE '%D2') AS n_d2 FROM w GROUP BY {keys}),
    h AS (SELECT {keys}, count(DISTINCT event) AS n, {hours} FROM w JOIN gt ON start_us BETWEEN onset AND until AND list_contains(expected, state) GROUP BY {keys}),
    swp AS (SELECT f.*, CAST(coalesce(h.n, 0) AS INTEGER) AS n_detected, {out} FROM f LEFT JOIN h USING ({keys}))"""


_BRIEF = "* EXCLUDE (" + ", ".join(f"{e[0]}_latency_h" for e in EVENTS) + ")"
_KEYS = "s2, d2_sigma, d2_size, d2_tx"


def _sweep(name: str) -> str:
    rows, need = Q.GRIDS[name]
    dims = " + ".join(f"CAST(coalesce({c} >= {t}, false) AS INTEGER)" for c, t in (("sigma", "d2_sigma"), ("size_r", "d2_size"), ("tx_r", "d2_tx")))
    state = f"(CASE WHEN coalesce(rhythm >= s2, false) THEN 'S2' ELSE 'S1' END) || (CASE WHEN {dims} >= {need} THEN 'D2' ELSE 'D1' END)"
    return _swept(f"{_rat()}, {_GT}, {_grid(_KEYS, rows)}", _KEYS, state, "rat")


_SLOT_STATE = "CASE WHEN coalesce(rhythm > s2, false) OR coalesce(c_s < continuity, false) THEN 'S2D1' ELSE 'S1D1' END"
_PHASE_A = _swept(f"{_SLOT_SC}, {_grid('s2, continuity', [(x, 0.5) for x in Q.SLOT_VALUES])}", "s2, continuity", _SLOT_STATE, "ss")
#: All detected and fpr under 0.05, lowest fpr first; else most detected of those under 0.05; else the middle of the list.
_CHOSEN = f"""(SELECT coalesce((SELECT s2 FROM swp WHERE n_detected = {len(EVENTS)} AND fpr < 0.05 ORDER BY fpr, s2 LIMIT 1), (SELECT s2 FROM swp WHERE fpr < 0.05 ORDER BY n_detected DESC, s2 LIMIT 1), CAST({Q.SLOT_VALUES[len(Q.SLOT_VALUES) // 2]} AS DOUBLE)))"""
_VALUES_B = ", ".join(f"(CAST({x} AS DOUBLE))" for x in Q.CONTINUITY)
_PHASE_B = _swept(f"{_SLOT_SC}, gr AS (SELECT ({_PHASE_A} SELECT {_CHOSEN}) AS s2, continuity FROM (VALUES {_VALUES_B}) v(continuity))", "s2, continuity", _SLOT_STATE, "ss")


def _q(c: str, p: float, name: str) -> str:
    return f"round(quantile_cont({c}, {p}), 6) AS {name}"


def _m1(signal: str) -> str:
    return f"""{_SC}, b AS (SELECT median({signal}) AS p50, stddev_samp({signal}) FILTER (WHERE {signal} < 1.05) / avg({signal}) FILTER (WHERE {signal} < 1.05) AS cv FROM nm),
    t AS (SELECT max({signal}) AS max_event, arg_max(event, {signal}) AS best_event FROM sc JOIN gt ON start_us BETWEEN onset AND until), m AS (SELECT *, (max_event - p50) / p50 / cv AS m1 FROM b, t)
    SELECT '{signal}' AS signal, best_event, round(max_event, 6) AS max_event, round(p50, 6) AS p50, round(cv, 6) AS cv, round(m1, 4) AS m1, CASE WHEN m1 >= 2 THEN 'Excellent' WHEN m1 >= 1 THEN 'Certified' WHEN m1 >= 0.5 THEN 'Operational' ELSE 'Provisional' END AS level FROM m"""


def _emas(alpha: str) -> str:
    return f"{_inv()}, {_fold('em', 'tr', {'a': 'rho_ts', 'b': 'rho_s'}, alpha)} SELECT idx, round(a, 6) AS e_rho, round(b, 6) AS e_sigma FROM em"


def _derived(value: str, out: str) -> str:
    return f"{_inv()}, dx AS MATERIALIZED (SELECT chain, idx, {value} AS x FROM tr), {_fold('em', 'dx', {'e': 'x'}, _A)} SELECT dx.idx, round({out}, 6) AS ratio FROM dx JOIN em USING (chain, idx)"


_P = f"WITH RECURSIVE {_blk()}, " + _hours("b", "event_type = 'purchase'")
_A1 = f"WITH RECURSIVE {_blk()}, {_hours('a', 'true')}"
_R4 = "round(rhythm, 6) AS rhythm, round(sigma, 6) AS sigma, round(size_r, 6) AS size_r, round(tx_r, 6) AS tx_r"

def _values(name: str, columns: str, rows: list) -> str:
    def said(x):
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)

    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) v({columns}))"


_VALID = _values("pr", "chain, signal, least_n, least_mean, least_variation, fixed", Q.VALIDITY)
_RANGES = _values("pr", "chain, version, valid_from, valid_to, p2, ps", Q.RANGES)
_RESETS = _values("rs", "chain, at_us", Q.RESETS)

ORACLE_SQL = {
    "catalog_columns": "SELECT table_name, column_name, ordinal_position FROM information_schema.columns WHERE table_name = 'events'",
    "range_cut": f"WITH {_blk()}, cut AS (SELECT *, (row_number() OVER (ORDER BY number) - 1) // {Q.PHI} AS window_id FROM blk WHERE number > 0 AND us BETWEEN {_JANUARY + 9 * DAY} AND {_JANUARY + 19 * DAY}) SELECT window_id, min(number) AS first_block, max(number) AS last_block, count(*) AS block_count FROM cut GROUP BY window_id HAVING count(*) >= 2",
    "row_windows": f"SELECT event_id AS number, (row_number() OVER (ORDER BY event_id) - 1) // {Q.PHI} AS window_id FROM events",
    "slot_windows": f"SELECT epoch_us(ts) // 60000000 AS slot, epoch_us(ts) // 60000000 // {Q.SLOT_PHI} AS window_id FROM events WHERE event_type = 'error'",
    "hour_windows": f"{_P} SELECT hour, block_count, round(size_avg, 6) AS size_avg, round(tx_avg, 6) AS tx_avg, round(gas_avg, 6) AS gas_avg, round(blob_avg, 6) AS blob_avg, round(basefee_avg, 6) AS basefee_avg FROM b",
    "hourly_rollup": f"WITH {_blk()} SELECT us // {_HOUR} AS hour, count(*) AS block_count, round(avg(size), 6) AS size_avg, round(avg(gas_used), 6) AS gas_avg, round(avg(gas_used), 6) AS basefee_avg FROM blk WHERE event_type = 'click' GROUP BY 1",
    "interblock_interval": f"{_P} SELECT hour, round(interval, 6) AS interval FROM b",
    "invariants": f"{_inv()} SELECT window_id, block_count, first_block, last_block, round(rho_ts, 6) AS rho_ts, round(rho_s, 6) AS rho_s, c_s FROM inv",
    "trim_edges": f"{_inv()} SELECT idx, window_id FROM tr",
    "gap_fill": f"{_SLOT} SELECT idx, window_id, block_count, rho_ts, c_s, start_us FROM gf",
    "ema_fast": _emas(_A),
    "ema_slow": _emas(_SLOW),
    "ema_nullsafe": f"{_SLOT}, {_fold('se', 'sn', {'e': 'rho_ts'}, _A, first='1.0')} SELECT idx, round(e, 6) AS e FROM se",
    "ema_lagged": f"{_P}, {_hourly('b', {'ratio': 'size_avg'})} SELECT hour, round(ratio, 6) AS ratio FROM br",
    "ema_reset": f"{_inv()}, tk AS MATERIALIZED (SELECT idx // 100 AS epoch, idx % 100 AS k, idx, rho_ts FROM tr), {_fold('em', 'tk', {'e': 'rho_ts'}, _A, 'epoch', 'k')} SELECT epoch * 100 + k AS idx, epoch, round(e, 6) AS e FROM em",
    "stream_ema": f"{_inv('event_type')}, whole AS (SELECT * FROM inv WHERE block_count = {Q.PHI}), {_fold('em', 'whole', {'e': 'rho_ts', 'l': 'rho_s'}, _A, order='window_id')}, {_fold('sl', 'whole', {'e': 'rho_ts'}, _SLOW, order='window_id')}, st AS (SELECT chain, window_id AS idx, start_us, end_us, rho_ts, rho_s, CASE WHEN window_id > 50 THEN rho_ts / nullif(em.e, 0) END AS rhythm, CASE WHEN window_id > 50 THEN rho_ts / nullif(sl.e, 0) END AS rhythm_slow, CASE WHEN window_id > 50 THEN rho_s / nullif(em.l, 0) END AS sigma FROM whole JOIN em USING (chain, window_id) JOIN sl USING (chain, window_id)) SELECT chain, idx, start_us, end_us, round(rho_ts, 6) AS rho_ts, round(rho_s, 6) AS rho_s, round(rhythm, 6) AS rhythm, round(rhythm_slow, 6) AS rhythm_slow, round(sigma, 6) AS sigma, (CASE WHEN {_ge('rhythm', 1.12)} THEN 'S2' ELSE 'S1' END) || (CASE WHEN {_ge('sigma', 1.10)} THEN 'D2' ELSE 'D1' END) AS state FROM st",
    "ratios": f"{_rat()} SELECT idx, {_R4} FROM rat",
    "warmup_null": f"{_rat()} SELECT count(*) FILTER (WHERE rhythm IS NULL) AS n_null, min(idx) FILTER (WHERE rhythm IS NOT NULL) AS first_idx FROM rat",
    "slow_drift": f"{_rat(alpha=_SLOW)} SELECT idx, round(rhythm, 6) AS rhythm FROM rat",
    "continuity_ratio": f"{_SLOT}, {_fold('ce', 'gf', {'e': 'c_s'}, _A)} SELECT idx, round(c_s / nullif(e, 0), 6) AS continuity_ratio FROM gf JOIN ce USING (chain, idx)",
    "complexity_ratio": _derived("size_avg / nullif(tx_count_avg, 0)", "greatest(0.01, least(20.0, x / nullif(e, 0)))"),
    "gas_complexity_ratio": _derived("gas_used_avg / nullif(tx_count_avg, 0)", "coalesce(x / nullif(e, 0), 1.0)"),
    "adapter_signals": f"WITH {_blk()}, ba AS (SELECT *, (SELECT max(us) FROM blk r WHERE r.event_type = 'click' AND r.us < b.us) AS last_us, CASE WHEN blobs > 0 THEN blobs * 131072 ELSE input_bytes END AS bytes FROM blk b WHERE event_type = 'purchase') SELECT number, round((us - last_us) / CAST(1000000 AS DOUBLE), 3) AS publish_latency, bytes AS calldata_bytes, round(blobs / CAST(6 AS DOUBLE), 6) AS blob_usage, round(bytes / nullif(CAST(tx AS DOUBLE), 0), 6) AS calldata_per_tx FROM ba",
    "classify_1d": f"{_rat()} SELECT idx, (CASE WHEN {_ge('rhythm', 1.12)} THEN 'S2' ELSE 'S1' END) || (CASE WHEN {_ge('sigma', 1.10)} THEN 'D2' ELSE 'D1' END) AS state FROM rat",
    "classify_2of3": f"{_SC} SELECT idx, d2_dims, state FROM sc",
    "classify_slot": f"{_SLOT_SC} SELECT idx, round(rhythm, 6) AS rhythm, CASE WHEN coalesce(rhythm > 1.12, false) OR c_s < 0.5 THEN 'S2D1' ELSE 'S1D1' END AS state FROM ss",
    "classify_l1_hour": f"{_L1} SELECT hour, round(interval_r, 6) AS interval_r, round(size_r, 6) AS size_r, round(tx_r, 6) AS tx_r, round(blob_r, 6) AS blob_r, round(sigma, 6) AS sigma, l1_state FROM l1",
    "classify_l2_hour": f"WITH RECURSIVE {_blk()}, {_L2} SELECT hour, round(count_r, 6) AS count_r, round(size_r, 6) AS size_r, round(gas_r, 6) AS gas_r, round(sigma, 6) AS sigma, l2_state FROM l2",
    "bridge_intervals": f"WITH {_blk()}, {_GAPS} SELECT number, round(gap, 6) AS gap FROM bg",
    "asof_last_blob": f"WITH {_blk()}, {_LAST} SELECT hour, last_us FROM lb",
    "bridge_bs": f"WITH RECURSIVE {_blk()}, {_BR} SELECT hour, round(age_min, 6) AS age_min, round(baseline, 6) AS baseline, bs FROM bs",
    "bridge_alarm": f"WITH RECURSIVE {_blk()}, {_BR} SELECT hour, bs FROM bs",
    "bridge_grid": f"WITH RECURSIVE {_blk()}, {_RELAY} SELECT hour, round(latency_ratio, 6) AS latency_ratio, round(backlog_ratio, 6) AS backlog_ratio, grid FROM grid",
    "composite": f"{_COMP} SELECT * FROM comp",
    "composite_summary": f"{_COMP} SELECT count(*) AS hours, count(*) FILTER (WHERE bridge_regime = 'BS2') AS bs2, count(*) FILTER (WHERE l2_regime IN ('S1D2', 'S2D1', 'S2D2')) AS l2_degraded, count(*) FILTER (WHERE composite = 'MULTI_LAYER') AS multi, count(*) FILTER (WHERE alert) AS alerts, count(*) FILTER (WHERE fee_monitor_visible) AS fee FROM comp",
    "first_alert": f"{_COMP} SELECT min(window_start) AS window_start, arg_min(composite, window_start) AS composite FROM comp WHERE alert",
    "causal_grid": f"""{_L1}, {_RELAY}, j AS (SELECT l1.hour, l1_state, grid FROM l1 JOIN grid USING (hour) WHERE l1_state IS NOT NULL) SELECT *,
        CASE WHEN grid IN ('BS2L1', 'BS2L2') THEN 'bridge congested, the rollup answers alone' WHEN grid = 'BS1L2' THEN NULL WHEN l1_state = 'S1D1' THEN 'overall calm' WHEN l1_state = 'S1D2' THEN 'healthy adoption' WHEN l1_state = 'S2D1' THEN 'structural stress that prices do not show' ELSE 'systemic congestion' END AS reading,
        CASE WHEN grid IN ('BS2L1', 'BS2L2') THEN 'adaptation up' WHEN grid = 'BS1L2' THEN NULL WHEN l1_state = 'S1D1' THEN 'demand down, composition down, adaptation down' WHEN l1_state = 'S1D2' THEN 'demand up, composition stable, adaptation stable' WHEN l1_state = 'S2D1' THEN 'demand down, composition up, adaptation up' ELSE 'demand up, composition up, adaptation up' END AS response FROM j""",
    "event_window": f"{_SC} SELECT event, count(*) AS n FROM sc JOIN gt ON start_us BETWEEN onset AND until GROUP BY event",
    "event_join": f"{_SC} SELECT event, idx, state FROM sc JOIN gt ON start_us BETWEEN onset AND until",
    "normal_windows": f"{_SC} SELECT idx, state FROM nm",
    "state_distribution": f"{_SC} SELECT state, count(*) AS n, round(100.0 * count(*) / nullif((SELECT count(*) FROM sc) - 50, 0), 4) AS percent FROM sc GROUP BY state",
    "slot_distribution": f"{_SLOT_SC}, v AS (SELECT CASE WHEN coalesce(rhythm > 1.12, false) OR c_s < 0.5 THEN 'S2D1' ELSE 'S1D1' END AS state FROM ss WHERE idx > 50) SELECT state, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM v), 4) AS percent FROM v GROUP BY state",
    "fpr": f"{_SC} SELECT round({_FPR}, 6) AS fpr, round(avg(CASE WHEN state IN ('S2D1', 'S2D2') THEN 1.0 ELSE 0.0 END), 6) AS fpr_tau, round(avg(CASE WHEN state = 'S1D2' THEN 1.0 ELSE 0.0 END), 6) AS fpr_pi, count(*) FILTER (WHERE {_BAD}) AS n_fp, count(*) AS n_normal FROM nm",
    "undetected": f"{_SLOT_SC}, v AS (SELECT *, CASE WHEN coalesce(rhythm > 1.5, false) OR c_s < 0.2 THEN 'S2D1' ELSE 'S1D1' END AS state FROM ss) SELECT event, round(max(rhythm), 6) AS max_rhythm, round(min(c_s), 6) AS min_c_s, CAST(1.0 AS DOUBLE) AS max_tx FROM v JOIN gt ON start_us BETWEEN onset AND until GROUP BY event HAVING count(*) FILTER (WHERE list_contains(expected, state)) = 0",
    "event_detection": f"{_DET} SELECT event, n_detected > 0 AS tp, round((first_us - onset) / CAST(3600000000 AS DOUBLE), 1) AS latency_h, n_window, n_detected, round(coalesce(n_detected / nullif(CAST(n_window AS DOUBLE), 0), 0), 3) AS detect_ratio FROM det",
    "tpr": f"{_DET} SELECT round(avg(CASE WHEN n_detected > 0 THEN 1.0 ELSE 0.0 END), 6) AS tpr FROM det",
    "quantiles_normal": f"{_SC} SELECT " + ", ".join(_q(c, p, f"{c}_p{int(p * 100)}") for c in ("rhythm", "sigma") for p in (0.1, 0.5, 0.9, 0.95, 0.99)) + " FROM nm",
    "m1": _m1("rhythm"),
    "m1_level": f"SELECT signal, level FROM ({_m1('sigma')})",
    "signal_profile": f"{_SC} SELECT count(rhythm) AS n, round(avg(rhythm), 6) AS avg, round(stddev_samp(rhythm), 6) AS std, " + ", ".join(_q("rhythm", p, f"p{int(p * 100)}") for p in (0.5, 0.85, 0.90, 0.95, 0.99)) + ", round(stddev_samp(rhythm) / avg(rhythm), 6) AS cv, round(quantile_cont(rhythm, 0.99) / quantile_cont(rhythm, 0.5), 6) AS p99_p50 FROM nm",
    "confidence_level": f"""{_DET}, sp AS (SELECT (max(end_us) - min(start_us)) / CAST({DAY} AS DOUBLE) AS days FROM sc), x AS (SELECT (SELECT avg(CASE WHEN n_detected > 0 THEN 1.0 ELSE 0.0 END) FROM det) AS tpr, (SELECT round({_FPR}, 6) FROM nm) AS fpr, (SELECT count(*) FROM det) AS n, days FROM sp)
        SELECT 'evt' AS chain, round(tpr, 6) AS tpr, fpr, n, CASE WHEN tpr >= 0.8 AND fpr <= 0.1 AND n >= 3 AND days > 30 THEN 'HIGH' ELSE 'MEDIUM event-based' END AS level FROM x
        UNION ALL SELECT event_type, NULL, NULL, 0, CASE WHEN max(epoch_us(ts)) - min(epoch_us(ts)) >= 30 * {DAY} THEN 'MEDIUM statistical' ELSE 'LOW' END FROM events GROUP BY event_type""",
    "signal_validity": f"{_inv('event_type')}, u AS (SELECT chain, unnest(['rho_ts', 'rho_s', 'c_s']) AS signal, unnest([rho_ts, rho_s, c_s]) AS x FROM inv), g AS (SELECT chain, signal, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS deviation FROM u GROUP BY ALL), {_VALID}, v AS (SELECT g.*, coalesce(o.least_n, e.least_n) AS least_n, coalesce(o.least_mean, e.least_mean) AS least_mean, coalesce(o.least_variation, e.least_variation) AS least_variation, coalesce(o.fixed, e.fixed) AS fixed FROM g LEFT JOIN pr o ON o.chain = g.chain AND o.signal = g.signal LEFT JOIN pr e ON e.chain IS NULL AND e.signal = g.signal) SELECT chain, signal, n, round(mean, 6) AS mean, round(deviation, 6) AS deviation, CASE WHEN abs(mean) <= least_mean THEN 'Broken' WHEN fixed IS NOT NULL THEN fixed WHEN n < least_n THEN 'Observational' WHEN deviation < least_variation * abs(mean) THEN 'Dormant' ELSE 'Valid' END AS status, CASE WHEN abs(mean) <= least_mean THEN 'mean' WHEN fixed IS NOT NULL THEN 'by design' WHEN n < least_n THEN 'windows' WHEN deviation < least_variation * abs(mean) THEN 'variation' END AS reason FROM v",
    "state_in_force": f"{_MULTI}, {_RANGES} SELECT rat.chain, idx, version, (CASE WHEN coalesce(rhythm >= CAST(p2 AS DOUBLE), false) THEN 'S2' ELSE 'S1' END) || (CASE WHEN coalesce(sigma >= CAST(ps AS DOUBLE), false) THEN 'D2' ELSE 'D1' END) AS state FROM rat LEFT JOIN pr ON pr.chain = rat.chain AND rat.start_us >= valid_from AND (valid_to IS NULL OR rat.start_us < valid_to)",
    "append_baselines": f"{_inv('event_type')}, {_RESETS}, ep AS (SELECT *, (SELECT count(*) FROM rs WHERE rs.chain = inv.chain AND rs.at_us <= inv.start_us) AS epoch FROM inv WHERE block_count = {Q.PHI}), ek AS MATERIALIZED (SELECT *, chain || '/' || epoch AS key, row_number() OVER (PARTITION BY chain, epoch ORDER BY window_id) - 1 AS pos FROM ep), {_fold('em', 'ek', {'e_rho': 'rho_ts', 'e_sigma': 'rho_s'}, _A, part='key', order='pos')}, {_fold('sl', 'ek', {'slow_rho': 'rho_ts'}, _SLOW, part='key', order='pos')} SELECT chain, window_id, epoch, start_us, round(rho_ts, 6) AS rho_ts, round(e_rho, 6) AS e_rho, round(slow_rho, 6) AS slow_rho, round(e_sigma, 6) AS e_sigma FROM ek JOIN em USING (key, pos) JOIN sl USING (key, pos)",
    "insensitive_periods": f"{_rat('event_type', 5)}, {_fold('sl', 'tr', {'slow': 'rho_ts'}, _SLOW)}, h AS (SELECT rat.chain, rat.idx, rat.start_us, rat.rhythm, em.e_rhythm AS fast, slow, coalesce(rat.rhythm >= 1.12, false) AS hot FROM rat JOIN em USING (chain, idx) JOIN sl USING (chain, idx)), f AS (SELECT *, hot AND NOT coalesce(lag(hot) OVER (PARTITION BY chain ORDER BY idx), false) AS begins FROM h), g AS (SELECT *, max(CASE WHEN begins THEN idx END) OVER (PARTITION BY chain ORDER BY idx) AS episode, NOT hot AND coalesce(fast <= 1.02 * slow, false) AS meets FROM f), k AS (SELECT chain, episode, max(idx) FILTER (WHERE hot) AS end_idx, count(*) FILTER (WHERE hot) AS n, min(start_us) FILTER (WHERE hot) AS start_us, max(start_us) FILTER (WHERE hot) AS end_us, max(rhythm) FILTER (WHERE hot) AS peak, min(idx) FILTER (WHERE meets) AS met, max(idx) AS last FROM g WHERE episode IS NOT NULL GROUP BY chain, episode) SELECT k.chain, k.episode, end_idx, n, k.start_us, k.end_us, round(peak, 6) AS peak, coalesce(met - 1, last) - end_idx AS insensitive, (SELECT start_us FROM g m WHERE m.chain = k.chain AND m.idx = met) AS met_us, (SELECT round(max(1.12 * fast / slow), 6) FROM g d WHERE d.chain = k.chain AND d.episode = k.episode AND d.idx > end_idx AND (met IS NULL OR d.idx < met)) AS needed FROM k",
    # Sketches of no more values than their size are exact: the least value of which 97 % are no larger.
    "rolling_p97": f"{_MULTI}, v AS (SELECT chain, start_us // {DAY} AS day, sigma FROM rat WHERE sigma IS NOT NULL), e AS (SELECT DISTINCT chain, day FROM v), s AS (SELECT e.chain, e.day, count(DISTINCT v.day) AS days, count(*) AS n, list_sort(list(sigma))[CAST(ceil(0.97 * count(*)) AS INTEGER)] AS p97 FROM e JOIN v ON v.chain = e.chain AND v.day BETWEEN e.day - 9 AND e.day GROUP BY ALL) SELECT chain, day, days, n, round(p97, 6) AS p97, CASE WHEN days >= 8 THEN round(p97, 6) END AS threshold FROM s",
    "continuity_check": f"{_SLOT}, q AS (SELECT chain, quantile_cont(c_s, [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]) AS q FROM (SELECT 'evt' AS chain, c_s FROM st) GROUP BY chain) SELECT chain, " + ", ".join(f"round(q[{i}], 6) AS p{p}" for i, p in enumerate(("01", "05", "10", "25", "50", "75", "90", "95", "99"), 1)) + ", q[3] > 0.99 AS disabled, CASE WHEN q[3] <= 0.99 THEN round(q[3], 6) END AS continuity_p10 FROM q",
    "latest_valid": f"{_inv('event_type')} SELECT chain, window_id, round(c_s, 6) AS c_s, round(rho_ts, 6) AS rho_ts, (c_s > 0.9 AND rho_ts < 2.5) AS valid FROM inv QUALIFY row_number() OVER (PARTITION BY chain ORDER BY window_id DESC) = 1",
    "histogram": f"{_SC}, lh AS (SELECT min(rhythm) AS least_, max(rhythm) AS most_ FROM sc) SELECT CAST(least(floor((rhythm - least_) / (most_ - least_) * 100), 99) AS INTEGER) AS bin, count(*) AS n FROM sc, lh WHERE rhythm IS NOT NULL GROUP BY 1",
    "l2_state_per_chain": f"{_MULTI}, pr AS (SELECT * FROM (VALUES ('click', 1.05, 1.20), ('purchase', 1.15, NULL), ('error', 1.05, 1.12)) v(chain, p2, ps)) SELECT chain, idx, (CASE WHEN coalesce(rhythm >= CAST(p2 AS DOUBLE), false) THEN 'S2' ELSE 'S1' END) || (CASE WHEN coalesce(sigma >= CAST(ps AS DOUBLE), false) THEN 'D2' ELSE 'D1' END) AS state FROM rat LEFT JOIN pr USING (chain)",
    "l2_d2_percent": f"{_MULTI} SELECT chain, count(*) AS n, round(100.0 * count(*) FILTER (WHERE sigma >= 1.10) / count(*), 4) AS d2_percent, round(avg(sigma), 6) AS avg_sigma, {_q('sigma', 0.9, 'p90')}, {_q('sigma', 0.95, 'p95')}, {_q('sigma', 0.97, 'p97')}, {_q('sigma', 0.98, 'p98')}, {_q('sigma', 0.99, 'p99')} FROM rat WHERE sigma IS NOT NULL GROUP BY chain",
    "calibrate_p97": f"{_MULTI}, c AS (SELECT chain, (max(end_us) - min(start_us)) / CAST({DAY} AS DOUBLE) AS days, quantile_cont(sigma, 0.97) AS p97 FROM rat GROUP BY chain) SELECT chain, round(days, 6) AS days, round(p97, 6) AS p97, CASE WHEN days >= 30 THEN round(p97, 6) END AS threshold, CASE WHEN days >= 29 THEN round(p97, 6) END AS threshold_29d FROM c WHERE p97 IS NOT NULL",
    "l0_hash": f"WITH {_blk()}, wb AS (SELECT *, (row_number() OVER (ORDER BY number) - 1) // {Q.PHI} AS window_id FROM blk) SELECT window_id, sha256(string_agg(sha256(concat_ws(':', chain, number, us, CAST(round(gas_used * 1000000) AS BIGINT), 600000000, CAST(round(size * 1000000) AS BIGINT), tx)), '' ORDER BY number)) AS batch_hash FROM wb GROUP BY window_id",
    "l1_hash": f"{_inv()} SELECT window_id, sha256(concat_ws(':', chain, window_id, start_us, end_us, block_count, first_block, last_block, " + ", ".join(f"CAST(round({c} * 1000000) AS BIGINT)" for c in ("rho_ts", "rho_s", "size_avg", "tx_count_avg", "c_s")) + ")) AS l1_hash FROM inv",
    **{n: f"{_sweep(n)} SELECT {'*' if n in Q.WITH_LATENCY else _BRIEF} FROM swp" for n in Q.GRIDS},
    "sweep_slot_a": f"{_PHASE_A} SELECT * FROM swp",
    "sweep_slot_b": f"{_PHASE_B} SELECT {_BRIEF} FROM swp",
    "sweep_union": f"SELECT *, 'A' AS phase FROM ({_PHASE_A} SELECT * FROM swp) UNION ALL BY NAME SELECT *, 'B' AS phase FROM ({_PHASE_B} SELECT {_BRIEF} FROM swp)",
    "select_slot_threshold": f"{_PHASE_A} SELECT {_CHOSEN} AS s2",
    "pivot_fpr": f"{_sweep('sweep_grid2d')} SELECT d2_size, " + ", ".join(f"max({c}) FILTER (WHERE d2_tx = {v}) AS {c}_tx_{round(v * 100)}" for v in Q.TX_VALUES for c in ("fpr", "n_d2")) + " FROM swp GROUP BY d2_size",
    "highest_full_tpr": f"{_sweep('sweep_s2')} SELECT max(s2) FILTER (WHERE n_detected = {len(EVENTS)}) AS s2 FROM swp",
    "select_threshold": f"{_sweep('sweep_pol_s2')} SELECT * FROM swp ORDER BY n_detected DESC, fpr, s2 LIMIT 1",
}
