"""SQL building blocks of the DuckDB twins: the driver tables as domain tables."""

from __future__ import annotations

from policylake.constants import MEAN_COLUMNS, STATE_COLUMNS


def u(*parts: str) -> str:
    """SQL text of the portable uniform; parts are SQL expressions."""
    key = ", ".join(parts)
    return f"((('0x' || substr(md5(concat_ws('|', {key})), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"


def _trace(ue: str) -> str:
    return f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
  CASE (l_orderkey // 18) % 4 WHEN 0 THEN 'rome_static_close' WHEN 1 THEN 'rome_static_medium'
       WHEN 2 THEN 'rome_static_far' ELSE 'rome_slow_close' END AS scenario,
  'tr' || (l_orderkey % 18) AS training_config,
  CASE WHEN l_linestatus = 'F' THEN 'exp1' ELSE 'exp2' END AS experiment,
  'bs' || (l_partkey % 4 + 1) AS base_station,
  'ue' || ({ue}) AS imsi_file,
  (floor(date_diff('day', DATE '1995-01-01', l_shipdate::DATE) / 90.0) * 1000
     + 250 * (l_linenumber % 4))::DOUBLE AS timestamp_ms,
  l_linenumber::DOUBLE AS num_ues,
  (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::DOUBLE AS slice_id,
  (2 * (1 + l_suppkey % 4))::DOUBLE AS slice_prb, 1 + l_tax AS power_multiplier,
  (l_linenumber % 3)::DOUBLE AS scheduler_code, (l_partkey % 28)::DOUBLE AS dl_mcs,
  l_quantity * 200 AS dl_buffer_bytes, l_extendedprice / 50000 AS dl_bitrate_mbps,
  l_discount * 100 AS dl_errors_pct, (1 + l_partkey % 15)::DOUBLE AS dl_cqi,
  (l_suppkey % 28)::DOUBLE AS ul_mcs, l_quantity * 20 AS ul_buffer_bytes,
  l_extendedprice / 500000 AS ul_bitrate_mbps, l_tax * 100 AS ul_errors_pct,
  (l_suppkey % 30)::DOUBLE AS ul_sinr, l_quantity AS requested_prbs,
  floor(l_quantity * (1 - 5 * l_tax)) AS granted_prbs
FROM lineitem"""


FLAG = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
_KEYS = "scenario, training_config, experiment, base_station, imsi_file"


def _mode(c: str) -> str:
    # most frequent value, smallest on ties
    return f"""(SELECT {_KEYS}, timestamp_s, {c} FROM (
    SELECT *, row_number() OVER (PARTITION BY {_KEYS}, timestamp_s ORDER BY n DESC, {c}) AS rn
    FROM (SELECT {_KEYS}, timestamp_s, {c}, count(*) AS n FROM tr0
      GROUP BY {_KEYS}, timestamp_s, {c})) WHERE rn = 1)"""


def seconds_cte(multi_ue: bool = False) -> str:
    means = ", ".join(f"avg({c}) AS {c}" for c in MEAN_COLUMNS)
    ue = "l_suppkey % 2" if multi_ue else FLAG
    using = f"USING ({_KEYS}, timestamp_s)"
    return f"""trace AS ({_trace(ue)}),
tr0 AS (SELECT *, floor(timestamp_ms / 1000)::BIGINT AS timestamp_s FROM trace),
sec0 AS (SELECT {_KEYS}, timestamp_s, {means},
  sum(requested_prbs) AS requested_prbs, sum(granted_prbs) AS granted_prbs
  FROM tr0 GROUP BY ALL),
seconds AS (SELECT *, CASE WHEN requested_prbs > 0
    THEN least(greatest(granted_prbs / requested_prbs, 0.0::DOUBLE), 1.0::DOUBLE) ELSE 1.0::DOUBLE END AS grant_ratio,
  CASE slice_id WHEN 0 THEN 'eMBB' WHEN 1 THEN 'mMTC' ELSE 'URLLC' END AS slice_type,
  concat_ws('/', {_KEYS}) AS episode_id,
  concat_ws('/', 'slice_traffic', scenario, training_config, experiment, base_station,
    'slices_' || base_station, imsi_file || '_metrics.csv') AS source_path
  FROM sec0 JOIN {_mode('slice_id')} m1 {using}
    JOIN {_mode('slice_prb')} m2 {using} JOIN {_mode('scheduler_code')} m3 {using})"""


def action_sql(code: str, prb: str) -> str:
    return (
        f"(CASE round_even({code}, 0)::BIGINT WHEN 0 THEN 'round_robin' WHEN 1 THEN 'waterfilling' "
        f"WHEN 2 THEN 'proportional_fair' ELSE 'scheduler_' || round_even({code}, 0)::BIGINT END"
        f" || ':prb=' || round_even({prb}, 0)::BIGINT)"
    )


def clip_sql(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low}::DOUBLE), {high}::DOUBLE)"


def reward_sql(slice_: str, dl: str, grant: str, err: str) -> str:
    c = clip_sql
    obj = (
        f"CASE WHEN {slice_} = 'eMBB' THEN {c(f'{dl} / 1.0', 0.0, 1.0)} "
        f"WHEN {slice_} = 'mMTC' THEN {c(f'{dl} / 0.03::DOUBLE', 0.0, 1.0)} "
        f"ELSE {c(grant, 0.0, 1.0)} END"
    )
    return c(f"({obj}) - 0.25::DOUBLE * {c(f'{err} / 100', 0.0, 1.0)}", -0.25, 1.0)


SPLIT_SQL = """CASE WHEN scenario IN ('rome_static_far', 'rome_slow_close') THEN 'test_unseen'
  WHEN replace(training_config, 'tr', '')::INT BETWEEN 15 AND 17 THEN 'test_seen'
  WHEN replace(training_config, 'tr', '')::INT BETWEEN 12 AND 14 THEN 'validation'
  WHEN replace(training_config, 'tr', '')::INT BETWEEN 0 AND 11 THEN 'train' ELSE 'excluded' END"""
SHIFT_SQL = """CASE scenario WHEN 'rome_static_far' THEN 'rf_distance_shift'
  WHEN 'rome_slow_close' THEN 'mobility_shift' ELSE 'seen_condition' END"""


def transitions_cte(multi_ue: bool = False) -> str:
    w = "OVER (PARTITION BY episode_id ORDER BY timestamp_s)"
    nexts = ", ".join(f"lead({c}) {w} AS next_{c}" for c in STATE_COLUMNS)
    return f"""{seconds_cte(multi_ue)},
lead0 AS (SELECT *, {nexts}, lead(slice_type) {w} AS next_slice,
  lead(timestamp_s) {w} AS next_s, lead(timestamp_s, 2) {w} AS next2_s FROM seconds),
trans AS (SELECT * EXCLUDE (next_slice, next_s, next2_s, slice_id),
  {action_sql('next_scheduler_code', 'next_slice_prb')} AS action,
  {reward_sql('next_slice', 'next_dl_bitrate_mbps', 'next_grant_ratio', 'next_dl_errors_pct')} AS reward,
  next2_s IS NULL AS done,
  CASE WHEN experiment = 'exp1' THEN 'train' ELSE 'test' END AS split,
  {SPLIT_SQL} AS publication_split, {SHIFT_SQL} AS shift_type,
  episode_id || '@' || timestamp_s AS row_id
  FROM lead0 WHERE next_s IS NOT NULL)"""


OBS = """obs AS (
SELECT event_id, ts AS timestamp, epoch_us(ts) / 1000000.0::DOUBLE AS epoch_s,
  'cell-' || lpad((user_id % 8 + 1)::VARCHAR, 3, '0') AS cell_id,
  CASE user_id % 3 WHEN 0 THEN 'eMBB' WHEN 1 THEN 'URLLC' ELSE 'mMTC' END AS slice_type,
  least(1.18::DOUBLE, 0.05::DOUBLE + 0.011::DOUBLE * k) AS prb_utilization,
  ((user_id * 37) % 1400)::INT AS active_users,
  1 + value AS downlink_mbps, 0.18::DOUBLE * (1 + value) AS uplink_mbps,
  (1 + (k * 13) % 120)::DOUBLE AS latency_ms, 0.16::DOUBLE * (1 + (k * 13) % 120) AS jitter_ms,
  (CASE WHEN event_type = 'error' THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END) + k / 100.0::DOUBLE AS packet_loss_pct,
  (1 + value) * (0.6::DOUBLE + k / 100.0::DOUBLE) AS throughput_demand_mbps,
  least(1.18::DOUBLE, 0.18::DOUBLE + 0.68::DOUBLE * least(least(1.18::DOUBLE, 0.05::DOUBLE + 0.011::DOUBLE * k), 1.0::DOUBLE)) AS energy_load,
  (event_id % 70) / 10.0::DOUBLE AS handover_failure_pct,
  (-60.0::DOUBLE - event_id % 65) AS rsrp_dbm, (event_id % 40 - 6)::DOUBLE AS sinr_db,
  ((k * 61) % 6000)::DOUBLE AS telemetry_age_ms,
  1.0::DOUBLE - (event_id % 5) / 20.0::DOUBLE AS telemetry_completeness, k
FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events))"""


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def r9(expr: str, name: str) -> str:
    return f"round({expr}, 9) AS {name}"


def energy_sql() -> str:
    g = "greatest(next_granted_prbs, 0.0::DOUBLE)"
    load = clip_sql(f"{g} / greatest(next_requested_prbs, 1.0::DOUBLE)", 0.0, 1.5)
    pressure = clip_sql(f"{g} / greatest(next_slice_prb, 1.0::DOUBLE)", 0.0, 2.0)
    return (f"greatest(next_power_multiplier, 0.0::DOUBLE) * (0.30::DOUBLE + 0.45::DOUBLE * {load} "
            f"+ 0.25::DOUBLE * least({pressure}, 1.0::DOUBLE))")


def targets_cte(multi_ue: bool = False) -> str:
    dl, err = "greatest(next_dl_bitrate_mbps, 0.0::DOUBLE)", clip_sql("next_dl_errors_pct / 100", 0.0, 1.0)
    g = clip_sql("next_grant_ratio", 0.0, 1.0)
    q = "greatest(next_dl_buffer_bytes, 0.0::DOUBLE)"
    sla = f"""CASE slice_type
      WHEN 'eMBB' THEN 0.75::DOUBLE * (1 - {clip_sql(dl, 0.0, 1.0)}) + 0.25::DOUBLE * {err}
      WHEN 'mMTC' THEN 0.70::DOUBLE * (1 - {clip_sql(dl + ' / 0.03::DOUBLE', 0.0, 1.0)}) + 0.20::DOUBLE * (1 - {g}) + 0.10::DOUBLE * {err}
      ELSE 0.65::DOUBLE * (1 - {g}) + 0.20::DOUBLE * {err} + 0.15::DOUBLE * ({q} / ({q} + 1000)) END"""
    cur = action_sql("scheduler_code", "slice_prb")

    def moved(c: str, floor: float) -> str:
        return clip_sql(f"abs(next_{c} - {c}) / (abs({c}) + {floor}::DOUBLE)", 0.0, 1.0)

    stab = clip_sql(
        f"0.60::DOUBLE * (CASE WHEN {cur} <> action THEN 1 ELSE 0 END) "
        f"+ 0.20::DOUBLE * {clip_sql('abs(next_grant_ratio - grant_ratio)', 0.0, 1.0)} "
        f"+ 0.10::DOUBLE * {moved('dl_bitrate_mbps', 0.10)} + 0.10::DOUBLE * {moved('dl_buffer_bytes', 100.0)}",
        0.0, 1.0,
    )
    return f"""{transitions_cte(multi_ue)},
scale AS (SELECT lo, CASE WHEN hi - lo < 1e-9 THEN lo + 1 ELSE hi END AS hi FROM (
  SELECT quantile_cont({energy_sql()}, 0.02) AS lo, quantile_cont({energy_sql()}, 0.98) AS hi
  FROM trans WHERE publication_split = 'train')),
targets0 AS (SELECT trans.*, {clip_sql(sla, 0.0, 1.0)} AS sla_cost,
  {clip_sql(f'({energy_sql()} - lo) / greatest(hi - lo, 1e-9::DOUBLE)', 0.0, 1.0)} AS energy_cost,
  {stab} AS stability_cost, {cur} AS current_action FROM trans, scale),
targets AS (SELECT *, 1 - (0.50::DOUBLE * sla_cost + 0.20::DOUBLE * energy_cost + 0.15::DOUBLE * stability_cost)
  / (0.50::DOUBLE + 0.20::DOUBLE + 0.15::DOUBLE) AS utility FROM targets0)"""


def policies_cte() -> str:
    from policylake.constants import POLICIES, POLICY_FIELDS

    rows = ", ".join(
        f"({i}, '{n}', '{v[0]}', " + ", ".join(f"{x}::DOUBLE" for x in v[1:]) + ")"
        for i, (n, v) in enumerate(POLICIES.items())
    )
    return f"pol(idx, policy, {', '.join(POLICY_FIELDS)}) AS (VALUES {rows})"


def intents_cte() -> str:
    from policylake.constants import INTENTS

    rows = ", ".join(
        f"('{n}', " + ", ".join(f"{x}::DOUBLE" for x in w) + f", {r}::DOUBLE, {'NULL' if b is None else b}::DOUBLE)"
        for n, (w, r, b, _) in INTENTS.items()
    )
    return f"intents(intent, w_latency, w_loss, w_throughput, w_stability, w_energy, risk_tolerance, energy_budget) AS (VALUES {rows})"


def up4(x: str) -> str:
    return f"floor(({x}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"


def penalty_list_sql() -> list[str]:
    from policylake.constants import OOD_ENVELOPE

    parts = []
    for c, (lo, hi) in OOD_ENVELOPE.items():
        span = hi - lo
        parts.append(
            f"(CASE WHEN {c} < {lo} THEN least(1.0::DOUBLE, ({lo}::DOUBLE - {c}) / {span!r}::DOUBLE * 5.0::DOUBLE + 0.35::DOUBLE) "
            f"WHEN {c} > {hi} THEN least(1.0::DOUBLE, ({c} - {hi}::DOUBLE) / {span!r}::DOUBLE * 5.0::DOUBLE + 0.35::DOUBLE) "
            f"ELSE greatest(0.0::DOUBLE, 0.12::DOUBLE - least({c} - {lo}::DOUBLE, {hi}::DOUBLE - {c}) / {span!r}::DOUBLE) * 0.6::DOUBLE END)"
        )
    return parts


def ood_sql() -> str:
    p = penalty_list_sql()
    return up4(f"least(1.0::DOUBLE, greatest({', '.join(p)}) * 0.7::DOUBLE + ({' + '.join(p)}) / 12 * 0.3::DOUBLE)")


LABEL_SQL = """CASE WHEN rsrp_dbm < -112 OR sinr_db < 1.5 OR handover_failure_pct > 5.0 THEN 'coverage_recovery'
  WHEN slice_type = 'URLLC' AND (latency_ms > 12.0 OR packet_loss_pct > 0.35::DOUBLE OR prb_utilization > 0.88::DOUBLE) THEN 'latency_guard'
  WHEN prb_utilization > 0.93::DOUBLE OR packet_loss_pct > 2.2::DOUBLE
    OR throughput_demand_mbps / greatest(downlink_mbps, 1.0::DOUBLE) > 1.48::DOUBLE THEN 'congestion_relief'
  WHEN slice_type = 'mMTC' AND (active_users > 700 OR packet_loss_pct > 1.1::DOUBLE) THEN 'massive_iot_access'
  WHEN slice_type = 'eMBB' AND (throughput_demand_mbps / greatest(downlink_mbps, 1.0::DOUBLE) > 1.15::DOUBLE
    OR throughput_demand_mbps > 180) THEN 'throughput_boost'
  WHEN prb_utilization < 0.38::DOUBLE AND energy_load < 0.48::DOUBLE
    AND throughput_demand_mbps / greatest(downlink_mbps, 1.0::DOUBLE) < 0.90::DOUBLE THEN 'energy_saver'
  ELSE 'balanced' END"""
HEURISTIC_SQL = """CASE WHEN rsrp_dbm < -112 OR sinr_db < 1.5 OR handover_failure_pct > 5.0 THEN 'coverage_recovery'
  WHEN slice_type = 'URLLC' AND (latency_ms > 12.0 OR packet_loss_pct > 0.35::DOUBLE) THEN 'latency_guard'
  WHEN prb_utilization > 0.93::DOUBLE OR packet_loss_pct > 2.2::DOUBLE THEN 'congestion_relief'
  WHEN slice_type = 'mMTC' AND active_users > 700 THEN 'massive_iot_access'
  WHEN slice_type = 'eMBB' AND throughput_demand_mbps > downlink_mbps * 1.15::DOUBLE THEN 'throughput_boost'
  WHEN prb_utilization < 0.38::DOUBLE AND energy_load < 0.48::DOUBLE THEN 'energy_saver' ELSE 'balanced' END"""
LEVEL_SQL = "CASE WHEN combined < 0.30::DOUBLE THEN 'low' WHEN combined < 0.55::DOUBLE THEN 'moderate' WHEN combined < 0.78::DOUBLE THEN 'high' ELSE 'critical' END"
INTENT_SQL = """CASE k % 10 WHEN 0 THEN 'green-ran' WHEN 1 THEN 'balanced' ELSE
  CASE slice_type WHEN 'URLLC' THEN 'urllc-strict' WHEN 'mMTC' THEN 'mmtc-reliability' ELSE 'embb-capacity' END END"""


def proposals_cte(source: str = "obs", key: str = "event_id") -> str:
    """Long proposal table with rank; `prob` is 0.01 outside the top 4."""
    return f"""prop0 AS (SELECT {key} AS pk, idx, policy, {u("'proposal'", key, "policy")} AS pu FROM {source}, pol),
prop1 AS (SELECT *, pu / sum(pu) OVER (PARTITION BY pk) AS pp FROM prop0),
prop AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY pp DESC, idx) AS rk FROM prop1),
ent AS (SELECT pk, least(1.0::DOUBLE, -sum(q * ln(q)) / ln(4.0::DOUBLE)) AS entropy,
   arg_min(idx, rk) AS top_idx FROM (SELECT pk, idx, rk, pp / sum(pp) OVER (PARTITION BY pk) AS q FROM prop WHERE rk <= 4) GROUP BY pk)"""


def project_ctes(source: str, prefix: str = "st", horizon: int = 3) -> str:
    """Unrolled projection: `<prefix>0` takes the KPI columns of `source` (which has the policy columns)."""
    out = [f"""{prefix}0 AS (SELECT *, latency_ms AS s_lat, packet_loss_pct AS s_loss, downlink_mbps AS s_dl,
  energy_load AS s_en, handover_failure_pct AS s_ho, sinr_db AS s_sinr, prb_utilization AS s_prb FROM {source})"""]
    for k in range(horizon):
        g = f"{1.0 / (1.0 + 0.55 * k)!r}::DOUBLE"

        def f(s: str, factor: str) -> str:
            return f"{s} * (1 + ({factor} - 1) * {g})"

        out.append(f"""{prefix}{k + 1} AS (SELECT * EXCLUDE (s_lat, s_loss, s_dl, s_en, s_ho, s_sinr, s_prb),
  greatest(0.2::DOUBLE, {f('s_lat', 'latency_factor')}) AS s_lat, greatest(0.0::DOUBLE, {f('s_loss', 'loss_factor')}) AS s_loss,
  greatest(0.0::DOUBLE, {f('s_dl', 'throughput_factor')}) AS s_dl, {clip_sql(f('s_en', 'energy_factor'), 0.0, 1.5)} AS s_en,
  greatest(0.0::DOUBLE, {f('s_ho', 'handover_factor')}) AS s_ho, s_sinr + sinr_delta * {g} AS s_sinr,
  {clip_sql(f's_prb + prb_share_delta * {g}', 0.0, 1.5)} AS s_prb FROM {prefix}{k})""")
    return ",\n".join(out)


def decide_ctes(source: str = "obs", key: str = "event_id") -> str:
    """CTE chain of the governed decision; ends in `decided` (one row per source row)."""
    lat_t = "(CASE slice_type WHEN 'URLLC' THEN 10.0 WHEN 'eMBB' THEN 40.0 ELSE 110.0 END)::DOUBLE"
    loss_t = "(CASE slice_type WHEN 'URLLC' THEN 0.10 WHEN 'eMBB' THEN 0.80 ELSE 1.20 END)::DOUBLE"
    raw = f"""(w_latency * exp(-greatest(0.0::DOUBLE, f_lat - {lat_t}) / greatest({lat_t}, 1.0::DOUBLE))
      + w_loss * exp(-greatest(0.0::DOUBLE, f_loss - {loss_t}) / greatest({loss_t}, 0.1::DOUBLE))
      + w_throughput * least(1.0::DOUBLE, f_dl / greatest(throughput_demand_mbps, 1.0::DOUBLE))
      + w_stability * exp(-f_ho / 4) + w_energy * {clip_sql('1.15::DOUBLE - f_en', 0.0, 1.0)})
      / (w_latency + w_loss + w_throughput + w_stability + w_energy)"""
    return f"""{proposals_cte(source, key)},
ooded AS (SELECT *, {ood_sql()} AS ood, {HEURISTIC_SQL} AS heuristic, {INTENT_SQL} AS intent,
  least(1.0::DOUBLE, 0.6::DOUBLE * least(1.0::DOUBLE, telemetry_age_ms / 5000) + 0.4::DOUBLE * (1 - telemetry_completeness)) AS telemetry
  FROM {source}),
unc0 AS (SELECT ooded.*, entropy, top_idx, w_latency, w_loss, w_throughput, w_stability, w_energy, risk_tolerance, energy_budget,
  least(1.0::DOUBLE, 0.32::DOUBLE * entropy + 0.30::DOUBLE * ood + 0.20::DOUBLE * telemetry + 0.18::DOUBLE * 0.2::DOUBLE) AS combined
  FROM ooded JOIN ent ON pk = {key} JOIN intents USING (intent)),
unc AS (SELECT *, {LEVEL_SQL} AS level, {up4('combined')} AS uncertainty FROM unc0),
cand0 AS (SELECT unc.*, pol.*, CASE WHEN rk <= 4 THEN pp ELSE 0.01::DOUBLE END AS prob
  FROM unc JOIN prop ON pk = {key} JOIN pol USING (idx)
  WHERE rk <= 4 OR pol.policy = 'balanced' OR pol.policy = heuristic),
{project_ctes('cand0')},
fin AS (SELECT *, round(s_lat, 6) AS f_lat, round(s_loss, 6) AS f_loss, round(s_dl, 6) AS f_dl, round(s_en, 6) AS f_en,
  round(s_ho, 6) AS f_ho, round(s_sinr, 6) AS f_sinr, round(s_prb, 6) AS f_prb FROM st3),
crit AS (SELECT *,
  list_filter([
   CASE WHEN abs(tx_power_db_delta) > 3 THEN 'transmit power change exceeds 3 dB' END,
   CASE WHEN policy = 'energy_saver' AND slice_type = 'URLLC' AND (latency_ms > 8 OR packet_loss_pct > 0.1::DOUBLE) THEN 'energy saving blocked near the URLLC targets' END,
   CASE WHEN f_prb > 1.18::DOUBLE THEN 'PRB pressure above the operating envelope' END,
   CASE WHEN f_loss > greatest(8.0::DOUBLE, packet_loss_pct * 1.15::DOUBLE + 0.2::DOUBLE) THEN 'packet loss degrades beyond the margin' END,
   CASE WHEN f_sinr < -6 THEN 'SINR below the service minimum' END,
   CASE WHEN policy = 'throughput_boost' AND prb_utilization > 0.96::DOUBLE THEN 'throughput boost in critical congestion' END,
   CASE WHEN policy = 'energy_saver' AND rsrp_dbm < -110 THEN 'power reduction in weak coverage' END,
   CASE WHEN abs(prb_share_delta) > 0.2::DOUBLE THEN 'PRB share change exceeds the action envelope' END,
   CASE WHEN ood > 0.72::DOUBLE AND policy NOT IN ('balanced', 'coverage_recovery') THEN 'aggressive policy blocked far out of distribution' END,
   CASE WHEN intent = 'urllc-strict' AND f_lat > 10 THEN 'intent latency_ms <=' END,
   CASE WHEN intent = 'urllc-strict' AND f_loss > 0.1::DOUBLE THEN 'intent packet_loss_pct <=' END,
   CASE WHEN f_en > energy_budget THEN 'energy load exceeds the intent budget' END,
   CASE WHEN level = 'critical' THEN 'combined uncertainty is critical' END], lambda x: x IS NOT NULL) AS reasons,
  CASE WHEN coalesce(f_en > energy_budget, false) THEN 'reject' WHEN f_en > energy_load * 1.20::DOUBLE + 0.03::DOUBLE THEN 'warning' ELSE 'pass' END AS critic_energy,
  {up4(clip_sql(f'({raw}) * 100 - greatest(0.0::DOUBLE, f_prb - 1) * 22', 0.0, 100.0))} AS raw_score FROM fin),
scored AS (SELECT *, len(reasons) = 0 AS safe,
  CASE WHEN len(reasons) > 0 THEN greatest(0.0::DOUBLE, raw_score - least(65.0::DOUBLE, 14.0::DOUBLE * len(reasons))) ELSE raw_score END AS score FROM crit),
flags AS (SELECT {key} AS fk, bool_or(safe) AS any_safe, count_if(NOT safe) AS unsafe_candidates,
  bool_or(idx = top_idx AND NOT safe) AS top_refused FROM scored GROUP BY 1),
pool AS (SELECT scored.*, any_safe, unsafe_candidates, top_refused FROM scored JOIN flags ON fk = {key}
  WHERE CASE WHEN any_safe THEN safe ELSE policy = 'balanced' END),
pranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(score + 8 * prob, 9) DESC, idx) AS sel_rank,
  nth_value(score, 2) OVER (PARTITION BY {key} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
  FROM pool),
decided0 AS (SELECT *, idx <> top_idx AND top_refused AS safety_override,
  {up4(clip_sql('''(0.48::DOUBLE + 0.34::DOUBLE * prob + least(0.18::DOUBLE, greatest(0.0::DOUBLE, (score - coalesce(second, 0)) / 100)))
    * (1 - least(0.45::DOUBLE, uncertainty * 0.45::DOUBLE))''', 0.0, 0.99))} AS confidence
  FROM pranked WHERE sel_rank = 1),
decided AS (SELECT *, policy AS selected_policy, score AS utility_score,
  safe AND level NOT IN ('high', 'critical') AND ood <= greatest(0.50::DOUBLE, 0.78::DOUBLE - risk_tolerance * 0.3::DOUBLE)
  AND confidence >= 0.55::DOUBLE AS approved FROM decided0)"""


def cells_cte(multi_ue: bool = False) -> str:
    return f"""{targets_cte(multi_ue)},
pcells AS (SELECT slice_type, action, count(*) AS support, avg(sla_cost) AS m_sla, avg(energy_cost) AS m_energy,
  avg(stability_cost) AS m_stability, avg(utility) AS m_value FROM targets
  WHERE publication_split = 'train' AND experiment = 'exp1' GROUP BY ALL),
ecells AS (SELECT slice_type, action, avg(sla_cost) AS m_e_sla, avg(energy_cost) AS m_e_energy, avg(stability_cost) AS m_e_stability
  FROM targets WHERE publication_split = 'train' AND experiment = 'exp2' GROUP BY ALL),
cells AS (SELECT *, dense_rank() OVER (ORDER BY action) - 1 AS idx FROM pcells JOIN ecells USING (slice_type, action)),
fallbacks AS (SELECT slice_type, arg_min(action, rk) AS fallback FROM (SELECT *, row_number() OVER (PARTITION BY slice_type
  ORDER BY round(0.70::DOUBLE * m_sla + 0.20::DOUBLE * m_energy + 0.10::DOUBLE * m_stability, 12), support DESC, action) AS rk FROM cells) GROUP BY 1)"""


POLICY_WHERE = "publication_split = 'train' AND experiment = 'exp1'"
EVALUATOR_WHERE = "publication_split = 'train' AND experiment = 'exp2'"


def state_cte(multi_ue: bool = False) -> str:
    """Rows `tb` with bin, next bin, fold and context distance, and `far` (median and 95 % of the distance)."""
    from policylake.config import ObjectiveSettings
    from policylake.constants import CONTEXT_COLUMNS
    from policylake.operators.outcome_model import LOAD, RADIO

    edges = [f"quantile_cont({c}, {p!r}) AS {k}_{c}" for c in (LOAD, RADIO) for k, p in (("lo", 1 / 3), ("hi", 2 / 3))]
    edges += [f"quantile_cont({c}, 0.5) AS mid_{c}" for c in CONTEXT_COLUMNS]
    edges += [f"CASE WHEN quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1) > 0 THEN quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1) ELSE 1 END AS wide_{c}" for c in CONTEXT_COLUMNS]

    def bin_of(p: str) -> str:
        third = "(({p}{c} > lo_{c})::INT + ({p}{c} > hi_{c})::INT)"
        return f"{third.format(p=p, c=LOAD)} * 3 + {third.format(p=p, c=RADIO)}"

    z2 = " + ".join(f"(({c} - mid_{c}) / wide_{c}) * (({c} - mid_{c}) / wide_{c})" for c in CONTEXT_COLUMNS)
    return f"""{cells_cte(multi_ue)},
edges AS (SELECT {", ".join(edges)} FROM targets WHERE {POLICY_WHERE}),
tb AS MATERIALIZED (SELECT targets.*, {bin_of("")} AS bin, {bin_of("next_")} AS next_bin, floor({u("'fold'", "episode_id")} * {ObjectiveSettings().folds})::INT AS fold,
  sqrt(({z2}) / {len(CONTEXT_COLUMNS)}.0::DOUBLE) AS distance FROM targets, edges),
far AS (SELECT quantile_cont(distance, 0.5) AS d50, quantile_cont(distance, 0.95) AS d95 FROM tb WHERE {POLICY_WHERE})"""


OOD_SCORE_SQL = "1.0::DOUBLE / (1 + exp(-(distance - d95) / greatest(d95 - d50, 1e-6::DOUBLE)))"


def drawn_sql(name: str, source: str, where: str, cols: dict[str, str], pairs: str) -> str:
    """Means by (slice, action, bin) drawn towards (slice, action) and slice; `n` and `cell_n` rows."""
    from policylake.operators.outcome_model import STRENGTH

    k = f"{STRENGTH}::DOUBLE"

    def value(c: str) -> str:
        cell = f"(coalesce(c.s_{c}, 0) + {k} * s.m_{c}) / (coalesce(c.n, 0) + {k})"
        return f"(coalesce(b.s_{c}, 0) + {k} * ({cell})) / (coalesce(b.n, 0) + {k}) AS {c}"

    return f"""{name}_b AS (SELECT slice_type, action, bin, count(*) AS n, {", ".join(f"sum({e})::DOUBLE AS s_{c}" for c, e in cols.items())} FROM {source} WHERE {where} GROUP BY ALL),
{name}_c AS (SELECT slice_type, action, sum(n)::DOUBLE AS n, {", ".join(f"sum(s_{c}) AS s_{c}" for c in cols)} FROM {name}_b GROUP BY ALL),
{name}_s AS (SELECT slice_type, {", ".join(f"sum(s_{c}) / sum(n) AS m_{c}" for c in cols)} FROM {name}_c GROUP BY ALL),
{name} AS (SELECT p.slice_type, p.action, g.bin, coalesce(b.n, 0) AS n, coalesce(c.n, 0) AS cell_n, {", ".join(map(value, cols))}
  FROM {pairs} p CROSS JOIN (SELECT unnest(range(9)) AS bin) g JOIN {name}_s s ON s.slice_type = p.slice_type
  LEFT JOIN {name}_c c ON c.slice_type = p.slice_type AND c.action = p.action LEFT JOIN {name}_b b ON b.slice_type = p.slice_type AND b.action = p.action AND b.bin = g.bin)"""


def outcome_model_ctes(multi_ue: bool = False) -> str:
    """`resid` (rows with out-of-fold residuals, `raw`, `target`) and `state` (estimates by slice, action, bin)."""
    from policylake.config import ObjectiveSettings
    from policylake.operators.outcome_model import COSTS, LEAST_CAP, LEAST_SPREAD, LOCAL_ROWS, RESIDUAL_CAP

    cfg = ObjectiveSettings()
    costs = {c: f"{c}_cost" for c in COSTS}
    folds = ",\n".join(drawn_sql(f"om_o{k}", "tb", f"{POLICY_WHERE} AND fold <> {k}", costs, "om_pp") for k in range(cfg.folds))
    oof = " UNION ALL ".join(f"SELECT slice_type, action, bin, {k} AS fold, {', '.join(f'{c} AS p_{c}' for c in COSTS)} FROM om_o{k}" for k in range(cfg.folds))
    raw = " + ".join(f"abs({c}_cost - p_{c}) / greatest(sd_{c}, {LEAST_SPREAD}::DOUBLE)" for c in COSTS)
    rounds = [drawn_sql("om_q0", "tb", POLICY_WHERE, {"q": "utility"}, "om_pp")]
    for i in range(1, cfg.q_iterations):
        rounds.append(f"""om_v{i} AS (SELECT slice_type, bin, max(q) AS v FROM om_q{i - 1} GROUP BY ALL),
om_t{i} AS (SELECT tb.slice_type, tb.action, tb.bin, utility + CASE WHEN done THEN 0 ELSE {cfg.gamma}::DOUBLE * v END AS t FROM tb JOIN om_v{i} ON om_v{i}.slice_type = tb.slice_type AND om_v{i}.bin = tb.next_bin WHERE {POLICY_WHERE}),
{drawn_sql(f"om_q{i}", f"om_t{i}", "true", {"q": "t"}, "om_pp")}""")
    last = f"om_q{cfg.q_iterations - 1}"
    return f"""{state_cte(multi_ue)},
om_pp AS (SELECT DISTINCT slice_type, action FROM tb WHERE {POLICY_WHERE}),
om_ep AS (SELECT DISTINCT slice_type, action FROM tb WHERE {EVALUATOR_WHERE}),
{drawn_sql("om_pm", "tb", POLICY_WHERE, costs, "om_pp")},
{drawn_sql("om_em", "tb", EVALUATOR_WHERE, costs, "om_ep")},
{folds},
om_oof AS ({oof}),
om_sds AS (SELECT {", ".join(f"stddev_pop({c}_cost) AS sd_{c}" for c in COSTS)} FROM tb WHERE {POLICY_WHERE}),
resid0 AS MATERIALIZED (SELECT tb.*, {", ".join(f"p_{c}" for c in COSTS)}, ({raw}) / 3.0::DOUBLE AS raw FROM tb JOIN om_oof USING (slice_type, action, bin, fold), om_sds WHERE {POLICY_WHERE}),
om_cap AS (SELECT greatest(quantile_cont(raw, {RESIDUAL_CAP}), {LEAST_CAP!r}::DOUBLE) AS cap FROM resid0),
resid AS (SELECT resid0.*, {clip_sql("raw / cap", 0.0, 1.0)} AS target FROM resid0, om_cap),
{drawn_sql("om_um", "resid", "true", {"unc": "target"}, "om_pp")},
{", ".join(rounds)},
state AS MATERIALIZED (SELECT c.slice_type, c.action, c.idx, p.bin, p.sla, p.energy, p.stability, om_um.unc, {last}.q,
  (CASE WHEN sum(p.n) OVER (PARTITION BY c.slice_type, p.bin) > 0 THEN p.n ELSE p.cell_n END)::DOUBLE AS w, p.n >= {LOCAL_ROWS} AND e.n >= {LOCAL_ROWS} AS sup,
  e.sla AS e_sla, e.energy AS e_energy, e.stability AS e_stability
  FROM cells c JOIN om_pm p ON p.slice_type = c.slice_type AND p.action = c.action JOIN om_em e ON e.slice_type = c.slice_type AND e.action = c.action AND e.bin = p.bin
  JOIN om_um ON om_um.slice_type = c.slice_type AND om_um.action = c.action AND om_um.bin = p.bin JOIN {last} ON {last}.slice_type = c.slice_type AND {last}.action = c.action AND {last}.bin = p.bin)"""


def candidates_cte(multi_ue: bool = False) -> str:
    """Long candidates `cand` (one row per row and supported action) with every field, and `rws`."""
    return f"""{outcome_model_ctes(multi_ue)},
rws AS (SELECT t.*, f.fallback, {OOD_SCORE_SQL} AS ood, cc.idx AS inc
  FROM tb t CROSS JOIN far JOIN fallbacks f ON f.slice_type = t.slice_type LEFT JOIN cells cc ON cc.slice_type = t.slice_type AND cc.action = t.current_action),
cand0 AS (SELECT row_id, t.slice_type, c.action AS a, c.idx, t.ood, t.inc, t.fallback, t.publication_split, t.episode_id, t.timestamp_s,
  t.current_action, t.action AS logged, t.scenario, t.training_config, t.experiment, t.base_station, t.utility, t.sla_cost, t.energy_cost, t.stability_cost,
  c.sla, c.energy, c.stability, c.unc, c.q, c.w, c.sup, c.e_sla, c.e_energy, c.e_stability
  FROM rws t JOIN state c ON c.slice_type = t.slice_type AND c.bin = t.bin),
cand AS MATERIALIZED (SELECT *, CASE WHEN qh - ql > 1e-9 THEN (q - ql) / (qh - ql) ELSE 0.5::DOUBLE END AS qn, w / ws AS prior FROM (
  SELECT *, min(q) OVER p AS ql, max(q) OVER p AS qh, sum(w) OVER p AS ws FROM cand0 WINDOW p AS (PARTITION BY row_id)))"""


def score_sql(sla_w=0.50, en_w=0.20, st_w=0.15, unc_w=0.10, plan_w=0.05) -> str:
    return (f"(1 - ({sla_w}::DOUBLE * sla + {en_w}::DOUBLE * energy + {st_w}::DOUBLE * stability + {unc_w}::DOUBLE * unc) "
            f"/ {sla_w + en_w + st_w + unc_w!r}::DOUBLE + {plan_w}::DOUBLE * qn)")


def utility_sql(p: str = "") -> str:
    return f"(1 - (0.50::DOUBLE * {p}sla + 0.20::DOUBLE * {p}energy + 0.15::DOUBLE * {p}stability) / (0.50::DOUBLE + 0.20::DOUBLE + 0.15::DOUBLE))"


def ranked_cte(name: str, source: str, where: str, value: str) -> str:
    """CTE with the best row per row_id under a filter."""
    return (f"{name} AS (SELECT * FROM (SELECT *, {value} AS val, row_number() OVER (PARTITION BY row_id ORDER BY round({value}, 12) DESC, idx) AS rk "
            f"FROM {source} WHERE {where}) WHERE rk = 1)")
