"""Queries on KPI snapshots: labels, scores, projections, governed decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from policylake.constants import FAULTS, KPI_COLUMNS, KPI_RANGES, POLICY_NAMES
from policylake.functions.core import cond_rate, decision_list, rounded, uniform
from policylake.operators import aggregates, governed, quality
from policylake.plans.registry import query
from policylake.plans.sqltext import (
    HEURISTIC_SQL,
    INTENT_SQL,
    LABEL_SQL,
    LEVEL_SQL,
    OBS,
    clip_sql,
    decide_ctes,
    intents_cte,
    ood_sql,
    policies_cte,
    project_ctes,
    proposals_cte,
    r9,
    u,
    with_,
)
from policylake.sources import adapters


def requested_intent():
    """Profile asked for by some rows; the others take their slice's default."""
    return F.when(F.col("k") % 10 == 0, "green-ran").when(F.col("k") % 10 == 1, "balanced")


def decided(spark, sf, source=None):
    obs = source if source is not None else adapters.observations(spark, sf)
    return governed.decide(governed.resolve_intent(obs, requested_intent()), governed.proposals(F.col("event_id")))


@query("p7_expert_label", with_(OBS, body=f"SELECT event_id, {LABEL_SQL} AS label FROM obs"))
def expert(spark, sf):
    return adapters.observations(spark, sf).select("event_id", governed.expert_label().alias("label"))


@query("p8_heuristic_candidate", with_(OBS, body=f"SELECT event_id, {HEURISTIC_SQL} AS candidate FROM obs"))
def heuristic(spark, sf):
    return adapters.observations(spark, sf).select("event_id", governed.heuristic_candidate().alias("candidate"))


@query("p11_ood_envelope_score", with_(OBS, body=f"SELECT event_id, {ood_sql()} AS ood FROM obs"))
def ood(spark, sf):
    return adapters.observations(spark, sf).select("event_id", governed.ood_score().alias("ood"))


_UNC = f"""unc0 AS (SELECT event_id, entropy, {ood_sql()} AS ood,
  least(1.0::DOUBLE, 0.6::DOUBLE * least(1.0::DOUBLE, telemetry_age_ms / 5000) + 0.4::DOUBLE * (1 - telemetry_completeness)) AS telemetry
  FROM obs JOIN ent ON pk = event_id),
unc AS (SELECT *, least(1.0::DOUBLE, 0.32::DOUBLE * entropy + 0.30::DOUBLE * ood + 0.20::DOUBLE * telemetry + 0.18::DOUBLE * 0.2::DOUBLE) AS combined FROM unc0)"""


@query(
    "p12_uncertainty",
    with_(
        OBS, policies_cte(), proposals_cte(), _UNC,
        body=f"SELECT event_id, {r9('entropy', 'entropy')}, {r9('telemetry', 'telemetry')}, {r9('combined', 'combined')}, {LEVEL_SQL} AS level FROM unc",
    ),
)
def uncertainty(spark, sf):
    o = adapters.observations(spark, sf).withColumn("ood", governed.ood_score())
    top = governed.top_k_array(governed.proposals(F.col("event_id")), 4)
    o = governed.with_uncertainty(o.withColumn("top", top), governed.top_probabilities(4))
    return o.select("event_id", *[rounded(c).alias(c) for c in ("entropy", "telemetry", "combined")], "level")


_SHORT = {"latency_ms": "s_lat", "packet_loss_pct": "s_loss", "downlink_mbps": "s_dl", "energy_load": "s_en",
          "handover_failure_pct": "s_ho", "sinr_db": "s_sinr", "prb_utilization": "s_prb"}


def _steps_sql(prefix: str, horizon: int) -> str:
    return " UNION ALL ".join(
        f"SELECT event_id, policy, {k} AS step, {', '.join(f'round({s}, 6) AS {n}' for n, s in _SHORT.items())} FROM {prefix}{k + 1}"
        for k in range(horizon)
    )


@query(
    "p13_policy_projection",
    with_(OBS, policies_cte(), "src AS (SELECT * FROM obs, pol)", project_ctes("src"), body=_steps_sql("st", 3)),
)
def projection(spark, sf):
    o = adapters.observations(spark, sf)
    paths = F.transform(
        governed.policy_array(),
        lambda p: F.struct(p["policy"].alias("policy"), governed.projected_states(p).alias("path")),
    )
    rows = o.select("event_id", F.inline(paths)).select("event_id", "policy", F.posexplode("path").alias("step", "s"))
    return rows.select("event_id", "policy", "step", *[F.round(F.col("s")[n], 6).alias(n) for n in governed.STATE])


# ---- fixed values: recorded per-policy deltas used by the recorded-delta projection --------
RECORDED_DELTAS = {
    "latency_guard": {"latency_ms": -6.0, "packet_loss_pct": -0.2, "energy_load": 0.05},
    "throughput_boost": {"downlink_mbps": 12.0, "prb_utilization": 0.08, "energy_load": 0.10},
    "energy_saver": {"energy_load": -0.30, "downlink_mbps": -3.0, "sinr_db": -1.0},
}


def _delta_sql() -> str:
    fallback = (
        "SELECT event_id, policy, " + ", ".join(f"round({s}, 6) AS {n}" for n, s in _SHORT.items())
        + ", 0.2::DOUBLE AS uncertainty FROM st3 WHERE policy NOT IN (" + ", ".join(f"'{p}'" for p in RECORDED_DELTAS) + ")"
    )
    parts = [fallback]
    for p, d in RECORDED_DELTAS.items():
        cols = []
        for n in governed.STATE:
            e = n
            for k in range(3):
                if n in d:
                    e = f"({e} + {d[n]}::DOUBLE * {1.0 / (k + 1)!r}::DOUBLE)"
                if n in ("prb_utilization", "energy_load"):
                    e = f"least(1.5::DOUBLE, greatest(0.0::DOUBLE, {e}))"
            cols.append(f"round({e}, 6) AS {n}")
        parts.append(f"SELECT event_id, '{p}' AS policy, {', '.join(cols)}, 0.24::DOUBLE AS uncertainty FROM obs")
    return " UNION ALL ".join(parts)


@query(
    "p14_recorded_delta_projection",
    with_(OBS, policies_cte(), "src AS (SELECT * FROM obs, pol)", project_ctes("src"), body=_delta_sql()),
)
def recorded_projection(spark, sf):
    from policylake.operators import recorded

    o = adapters.observations(spark, sf)
    return recorded.project(o, RECORDED_DELTAS, horizon=3)


_CANDS = ["event_id", "policy"]


def _candidates(spark, sf):
    d = decided(spark, sf)
    return d.select("*", F.inline(F.transform("cand", lambda c: F.struct(c.alias("c")))))


def _decision_body(body: str) -> str:
    return with_(OBS, policies_cte(), intents_cte(), decide_ctes(), body=body)


@query("p15_utility_score", _decision_body(f"SELECT event_id, policy, {r9('score', 'score')}, {r9('prob', 'prob')} FROM scored"))
def utility(spark, sf):
    return _candidates(spark, sf).select("event_id", F.col("c.policy").alias("policy"),
                                         rounded(F.col("c.score")).alias("score"), rounded(F.col("c.prob")).alias("prob"))


@query("p16_safety_reasons", _decision_body("SELECT event_id, policy, array_to_string(reasons, '; ') AS reasons, safe FROM scored"))
def safety(spark, sf):
    return _candidates(spark, sf).select(
        "event_id", F.col("c.policy").alias("policy"),
        F.array_join("c.critic.reasons", "; ").alias("reasons"), F.col("c.safe").alias("safe"),
    )


@query(
    "p17_critics",
    _decision_body("""SELECT event_id, policy, critic_energy, CASE level WHEN 'critical' THEN 'reject' WHEN 'high' THEN 'warning' ELSE 'pass' END AS critic_uncertainty,
    NOT safe AS rejected FROM scored"""),
)
def critics(spark, sf):
    return _candidates(spark, sf).select(
        "event_id", F.col("c.policy").alias("policy"), F.col("c.critic.energy").alias("critic_energy"),
        F.col("c.critic.uncertainty").alias("critic_uncertainty"), (~F.col("c.safe")).alias("rejected"),
    )


@query("p18_confidence", _decision_body(f"SELECT event_id, {r9('confidence', 'confidence')} FROM decided"))
def confidence(spark, sf):
    return decided(spark, sf).select("event_id", rounded("confidence").alias("confidence"))


_MODE = "CASE event_id % 5 WHEN 0 THEN 'recommend' WHEN 1 THEN 'shadow' WHEN 2 THEN 'simulated' WHEN 3 THEN 'canary' ELSE 'autonomous' END"
_GATE = f"""gate AS (SELECT *, {_MODE} AS mode FROM decided),
gated AS (SELECT *, CASE WHEN mode = 'recommend' THEN 'recommendation_only' WHEN mode = 'shadow' THEN 'shadow_recorded'
   WHEN event_id % 7 = 0 THEN 'approval_required'
   WHEN NOT approved OR confidence < 0.55::DOUBLE OR uncertainty > 0.55::DOUBLE OR ood > 0.65::DOUBLE
     OR selected_policy NOT IN ('balanced', 'latency_guard', 'congestion_relief', 'coverage_recovery', 'throughput_boost')
     OR (mode = 'canary' AND cell_id NOT IN ('cell-001', 'cell-002')) THEN 'blocked' ELSE 'simulated' END AS status,
  CASE WHEN mode = 'recommend' THEN 'no network change requested' WHEN mode = 'shadow' THEN 'recorded but not sent'
   WHEN event_id % 7 = 0 THEN 'operator approval is required' WHEN NOT approved THEN 'decision is not approved'
   WHEN confidence < 0.55::DOUBLE THEN 'confidence below the threshold' WHEN uncertainty > 0.55::DOUBLE THEN 'uncertainty above the threshold'
   WHEN ood > 0.65::DOUBLE THEN 'observation out of distribution'
   WHEN selected_policy NOT IN ('balanced', 'latency_guard', 'congestion_relief', 'coverage_recovery', 'throughput_boost') THEN 'policy not in the allow list'
   WHEN mode = 'canary' AND cell_id NOT IN ('cell-001', 'cell-002') THEN 'cell outside the canary list'
   ELSE 'applied to the projection' END AS message FROM gate)"""


def gated(spark, sf):
    d = decided(spark, sf)
    m = F.col("event_id") % 5
    mode = decision_list([(m == 0, "recommend"), (m == 1, "shadow"), (m == 2, "simulated"), (m == 3, "canary")], "autonomous")
    gate = governed.execution_gate(
        F.col("mode"), approval_required=F.col("event_id") % 7 == 0,
        allowed=["balanced", "latency_guard", "congestion_relief", "coverage_recovery", "throughput_boost"],
        canary=["cell-001", "cell-002"],
    )
    return d.withColumn("mode", mode).withColumn("gate", gate)


@query(
    "p19_execution_gate",
    with_(OBS, policies_cte(), intents_cte(), decide_ctes(), _GATE, body="SELECT event_id, mode, status, message FROM gated"),
)
def execution_gate(spark, sf):
    return gated(spark, sf).select("event_id", "mode", "gate.status", "gate.message")


@query(
    "p20_trace_explanation",
    _decision_body("""SELECT event_id, cell_id || '/' || slice_type || ': policy ' || selected_policy || ', level ' || level || ', rejected '
    || unsafe_candidates || CASE WHEN NOT any_safe THEN '; no candidate passed' WHEN safety_override THEN '; top proposal refused'
    WHEN unsafe_candidates > 0 THEN '; critics rejected some' ELSE '; all passed' END AS explanation FROM decided"""),
)
def explanation(spark, sf):
    d = decided(spark, sf)
    end = decision_list(
        [
            (F.size("safe_cand") == 0, "; no candidate passed"),
            (F.col("safety_override"), "; top proposal refused"),
            (F.col("unsafe_candidates") > 0, "; critics rejected some"),
        ],
        "; all passed",
    )
    return d.select(
        "event_id",
        F.concat(
            F.format_string("%s/%s: policy %s, level %s, rejected %d", "cell_id", "slice_type", "selected_policy", "level", "unsafe_candidates"),
            end,
        ).alias("explanation"),
    )


@query(
    "p10_fault_injection",
    with_(
        OBS,
        body=" UNION ALL ".join(
            f"SELECT event_id, '{f}' AS fault, " + ", ".join(
                f"{r9(e.get(c, c), c)}" for c in (*KPI_COLUMNS, "telemetry_age_ms", "telemetry_completeness")
            ) + " FROM obs"
            for f, e in {
                "traffic_spike": {"prb_utilization": "least(1.5::DOUBLE, prb_utilization + 0.35::DOUBLE)", "active_users": "floor(active_users * 1.8::DOUBLE)::INT",
                                  "throughput_demand_mbps": "throughput_demand_mbps * 1.7::DOUBLE"},
                "cell_outage": {"downlink_mbps": "0.0::DOUBLE", "uplink_mbps": "0.0::DOUBLE", "packet_loss_pct": "greatest(80.0::DOUBLE, packet_loss_pct)",
                                "latency_ms": "greatest(1500.0::DOUBLE, latency_ms)"},
                "backhaul_degradation": {"latency_ms": "latency_ms * 3.5::DOUBLE", "jitter_ms": "jitter_ms * 4", "downlink_mbps": "downlink_mbps * 0.55::DOUBLE"},
                "poor_radio": {"rsrp_dbm": "-121.0::DOUBLE", "sinr_db": "-4.0::DOUBLE", "handover_failure_pct": "greatest(7.5::DOUBLE, handover_failure_pct)"},
                "handover_storm": {"handover_failure_pct": "greatest(12.0::DOUBLE, handover_failure_pct * 4)", "jitter_ms": "jitter_ms * 2"},
                "packet_loss_burst": {"packet_loss_pct": "least(100.0::DOUBLE, packet_loss_pct + 12)", "latency_ms": "latency_ms * 1.7::DOUBLE"},
                "stale_telemetry": {"telemetry_age_ms": "12000.0::DOUBLE", "telemetry_completeness": "0.78::DOUBLE"},
                "corrupted_kpi": {"prb_utilization": "1.49::DOUBLE", "telemetry_completeness": "0.55::DOUBLE", "sinr_db": "60.0::DOUBLE"},
                "model_drift": {"active_users": "least(100000, active_users * 8)", "throughput_demand_mbps": "throughput_demand_mbps * 4"},
                "neighbor_interference": {"sinr_db": "greatest(-30.0::DOUBLE, sinr_db - 15)", "packet_loss_pct": "least(100.0::DOUBLE, packet_loss_pct + 3)"},
            }.items()
        ),
    ),
)
def fault_injection(spark, sf):
    f = governed.all_faults(adapters.observations(spark, sf), FAULTS)
    return f.select("event_id", "fault", *[rounded(c).alias(c) for c in (*KPI_COLUMNS, "telemetry_age_ms", "telemetry_completeness")])


@query(
    "j14_intent_resolution",
    with_(OBS, intents_cte(), f"r AS (SELECT *, {INTENT_SQL} AS intent FROM obs)",
          body="SELECT event_id, intent, risk_tolerance, energy_budget, w_latency, w_energy FROM r JOIN intents USING (intent)"),
)
def intent(spark, sf):
    o = governed.resolve_intent(adapters.observations(spark, sf), requested_intent())
    return o.select("event_id", "intent", "risk_tolerance", "energy_budget", "w_latency", "w_energy")


_FRONT_SQL = """front AS (SELECT a.event_id, a.idx, a.policy FROM scored a WHERE a.safe AND NOT EXISTS (
  SELECT 1 FROM scored b WHERE b.safe AND b.event_id = a.event_id
   AND round(b.f_lat, 4) <= round(a.f_lat, 4) AND round(b.f_loss, 4) <= round(a.f_loss, 4) AND round(b.f_dl, 4) >= round(a.f_dl, 4)
   AND round(b.f_en, 4) <= round(a.f_en, 4) AND round(b.f_ho, 4) <= round(a.f_ho, 4)
   AND (round(b.f_lat, 4) < round(a.f_lat, 4) OR round(b.f_loss, 4) < round(a.f_loss, 4) OR round(b.f_dl, 4) > round(a.f_dl, 4)
    OR round(b.f_en, 4) < round(a.f_en, 4) OR round(b.f_ho, 4) < round(a.f_ho, 4))))"""


@query(
    "j13_pareto_front",
    with_(OBS, policies_cte(), intents_cte(), decide_ctes(), _FRONT_SQL, body="SELECT event_id, policy FROM front"),
)
def pareto(spark, sf):
    d = decided(spark, sf)
    return d.select("event_id", F.explode(governed.pareto_front(F.col("safe_cand"))).alias("policy"))


@query(
    "d1_governed_decision",
    with_(
        OBS, policies_cte(), intents_cte(), decide_ctes(), _FRONT_SQL,
        body=f"""SELECT event_id, intent, selected_policy, {r9('confidence', 'confidence')}, {r9('utility_score', 'utility_score')},
        safety_override, approved, {r9('ood', 'ood')}, level, unsafe_candidates,
        coalesce((SELECT string_agg(policy, ',' ORDER BY idx) FROM front WHERE front.event_id = decided.event_id), '') AS pareto
        FROM decided""",
    ),
)
def governed_decision(spark, sf):
    d = decided(spark, sf)
    return d.select(
        "event_id", "intent", "selected_policy", rounded("confidence").alias("confidence"),
        rounded("utility_score").alias("utility_score"), "safety_override", "approved", rounded("ood").alias("ood"),
        "level", "unsafe_candidates", F.array_join(governed.pareto_front(F.col("safe_cand")), ",").alias("pareto"),
    )


_FAULT_SET = FAULTS


def _fault_obs_sql() -> str:
    base = "SELECT * EXCLUDE ({ex}), {cols}, '{f}' AS fault, event_id || '#{f}' AS fkey FROM obs"
    ex = {
        "traffic_spike": ("prb_utilization, active_users, throughput_demand_mbps",
                          "least(1.5::DOUBLE, prb_utilization + 0.35::DOUBLE) AS prb_utilization, floor(active_users * 1.8::DOUBLE)::INT AS active_users, throughput_demand_mbps * 1.7::DOUBLE AS throughput_demand_mbps"),
        "cell_outage": ("downlink_mbps, uplink_mbps, packet_loss_pct, latency_ms",
                        "0.0::DOUBLE AS downlink_mbps, 0.0::DOUBLE AS uplink_mbps, greatest(80.0::DOUBLE, packet_loss_pct) AS packet_loss_pct, greatest(1500.0::DOUBLE, latency_ms) AS latency_ms"),
        "backhaul_degradation": ("latency_ms, jitter_ms, downlink_mbps",
                                 "latency_ms * 3.5::DOUBLE AS latency_ms, jitter_ms * 4 AS jitter_ms, downlink_mbps * 0.55::DOUBLE AS downlink_mbps"),
        "poor_radio": ("rsrp_dbm, sinr_db, handover_failure_pct",
                       "-121.0::DOUBLE AS rsrp_dbm, -4.0::DOUBLE AS sinr_db, greatest(7.5::DOUBLE, handover_failure_pct) AS handover_failure_pct"),
        "handover_storm": ("handover_failure_pct, jitter_ms",
                           "greatest(12.0::DOUBLE, handover_failure_pct * 4) AS handover_failure_pct, jitter_ms * 2 AS jitter_ms"),
        "packet_loss_burst": ("packet_loss_pct, latency_ms",
                              "least(100.0::DOUBLE, packet_loss_pct + 12) AS packet_loss_pct, latency_ms * 1.7::DOUBLE AS latency_ms"),
        "stale_telemetry": ("telemetry_age_ms, telemetry_completeness", "12000.0::DOUBLE AS telemetry_age_ms, 0.78::DOUBLE AS telemetry_completeness"),
        "corrupted_kpi": ("prb_utilization, telemetry_completeness, sinr_db",
                          "1.49::DOUBLE AS prb_utilization, 0.55::DOUBLE AS telemetry_completeness, 60.0::DOUBLE AS sinr_db"),
        "model_drift": ("active_users, throughput_demand_mbps", "least(100000, active_users * 8) AS active_users, throughput_demand_mbps * 4 AS throughput_demand_mbps"),
        "neighbor_interference": ("sinr_db, packet_loss_pct",
                                  "greatest(-30.0::DOUBLE, sinr_db - 15) AS sinr_db, least(100.0::DOUBLE, packet_loss_pct + 3) AS packet_loss_pct"),
    }
    parts = [base.format(ex=a, cols=b, f=f) for f, (a, b) in ex.items()]
    return "fobs AS (" + " UNION ALL BY NAME ".join(parts) + ")"


@query(
    "d21_resilience_sweep",
    with_(
        OBS, policies_cte(), intents_cte(), _fault_obs_sql(), decide_ctes("fobs", "fkey"),
        body=f"""SELECT fault, count(*) AS n, {r9('avg(approved::INT)', 'approval_rate')}, {r9('avg(ood)', 'mean_ood')},
        {r9('avg(confidence)', 'mean_confidence')}, sum(unsafe_candidates)::BIGINT AS unsafe_candidates FROM decided GROUP BY fault""",
    ),
)
def resilience(spark, sf):
    f = governed.all_faults(adapters.observations(spark, sf), FAULTS)
    f = f.withColumn("fkey", F.concat(F.col("event_id").cast("string"), F.lit("#"), F.col("fault")))
    d = governed.decide(governed.resolve_intent(f, requested_intent()), governed.proposals(F.col("fkey")))
    return d.groupBy("fault").agg(
        F.count(F.lit(1)).alias("n"), rounded(cond_rate(F.col("approved"))).alias("approval_rate"),
        rounded(F.avg("ood")).alias("mean_ood"), rounded(F.avg("confidence")).alias("mean_confidence"),
        F.sum("unsafe_candidates").alias("unsafe_candidates"),
    )


@query(
    "d22_guardrail_checks",
    with_(
        OBS, policies_cte(), intents_cte(),
        """adv AS (SELECT * EXCLUDE (slice_type, latency_ms, prb_utilization), 'URLLC' AS slice_type, greatest(latency_ms, 9.0::DOUBLE) AS latency_ms,
           prb_utilization, 'urllc_energy' AS rule FROM obs UNION ALL BY NAME
           SELECT * EXCLUDE (prb_utilization), 1.1::DOUBLE AS prb_utilization, 'congested_boost' AS rule FROM obs)""",
        "advk AS (SELECT *, event_id || '#' || rule AS fkey FROM adv)", decide_ctes("advk", "fkey"),
        body="""SELECT rule, count_if(policy = CASE rule WHEN 'urllc_energy' THEN 'energy_saver' ELSE 'throughput_boost' END) AS tried,
        count_if(policy = CASE rule WHEN 'urllc_energy' THEN 'energy_saver' ELSE 'throughput_boost' END AND safe) AS let_through,
        count_if(policy = CASE rule WHEN 'urllc_energy' THEN 'energy_saver' ELSE 'throughput_boost' END AND safe) = 0 AS passed
        FROM scored GROUP BY rule""",
    ),
)
def guardrails(spark, sf):
    o = adapters.observations(spark, sf)
    urllc = o.withColumns({"slice_type": F.lit("URLLC"), "latency_ms": F.greatest("latency_ms", F.lit(9.0)), "rule": F.lit("urllc_energy")})
    boost = o.withColumns({"prb_utilization": F.lit(1.1), "rule": F.lit("congested_boost")})
    rows = urllc.unionByName(boost).withColumn("fkey", F.concat(F.col("event_id").cast("string"), F.lit("#"), F.col("rule")))
    d = governed.decide(governed.resolve_intent(rows, requested_intent()), governed.proposals(F.col("fkey")))
    target = F.when(F.col("rule") == "urllc_energy", "energy_saver").otherwise("throughput_boost")
    c = d.select("rule", target.alias("target"), F.inline(F.transform("cand", lambda c: F.struct(c["policy"].alias("policy"), c["safe"].alias("safe")))))
    hit = F.col("policy") == F.col("target")
    return c.groupBy("rule").agg(
        F.count_if(hit).alias("tried"), F.count_if(hit & F.col("safe")).alias("let_through"),
        (F.count_if(hit & F.col("safe")) == 0).alias("passed"),
    )


@query(
    "a23_decision_metrics",
    _decision_body(f"""SELECT slice_type, count(*) AS n, {r9(f'avg((selected_policy = ({LABEL_SQL}))::INT)', 'expert_agreement')},
    {r9('avg(safety_override::INT)', 'override_rate')}, {r9('avg(approved::INT)', 'approval_rate')}, {r9('avg(safe::INT)', 'safe_selection_rate')},
    {r9('avg(ood)', 'mean_ood')}, {r9('quantile_cont(ood, 0.95)', 'p95_ood')}, {r9('avg(uncertainty)', 'mean_uncertainty')},
    count(DISTINCT selected_policy) AS policies FROM decided GROUP BY slice_type"""),
)
def decision_metrics(spark, sf):
    d = decided(spark, sf)
    # ood is rounded to 4 decimals, so its exact percentile keeps at most 10,001 counts per group
    return d.groupBy("slice_type").agg(
        F.count(F.lit(1)).alias("n"),
        rounded(cond_rate(F.col("selected_policy") == governed.expert_label())).alias("expert_agreement"),
        rounded(cond_rate(F.col("safety_override"))).alias("override_rate"),
        rounded(cond_rate(F.col("approved"))).alias("approval_rate"),
        rounded(cond_rate(F.col("chosen.safe"))).alias("safe_selection_rate"),
        rounded(F.avg("ood")).alias("mean_ood"), rounded(F.percentile("ood", 0.95)).alias("p95_ood"),
        rounded(F.avg("uncertainty")).alias("mean_uncertainty"),
        F.countDistinct("selected_policy").alias("policies"),
    )


@query(
    "a25_request_counters",
    _decision_body(f"""SELECT selected_policy AS policy, count(*) AS requests, count_if(NOT approved) AS not_approved,
    {r9('sum(telemetry_age_ms) / 1000', 'total_seconds')} FROM decided GROUP BY 1"""),
)
def counters(spark, sf):
    d = decided(spark, sf)
    return d.groupBy(F.col("selected_policy").alias("policy")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("approved")).alias("not_approved"),
        rounded(F.sum("telemetry_age_ms") / 1000).alias("total_seconds"),
    )


@query(
    "w12_top_k_candidates",
    with_(
        OBS, policies_cte(), proposals_cte(),
        body=f"""SELECT pk AS event_id, policy, rk AS rank, {r9('exp(pp - max(pp) OVER w) / sum(exp(pp - mx)) OVER w', 'softmax')} FROM
        (SELECT *, max(pp) OVER (PARTITION BY pk) AS mx FROM prop WHERE rk <= 4) WINDOW w AS (PARTITION BY pk)""",
    ),
)
def top_k(spark, sf):
    o = adapters.observations(spark, sf)
    t = o.select("event_id", governed.top_k_array(governed.proposals(F.col("event_id")), 4).alias("top"))
    best = -F.col("top")[0]["np"]
    t = t.withColumn("e", F.transform("top", lambda x: F.exp(-x["np"] - best)))
    t = t.withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    t = t.select("event_id", "z", F.posexplode(F.arrays_zip("top", "e")).alias("pos", "x"))
    names = F.array(*[F.lit(n) for n in POLICY_NAMES])
    return t.select(
        "event_id", F.get(names, F.col("x.top.idx")).alias("policy"), (F.col("pos") + 1).alias("rank"),
        rounded(F.col("x.e") / F.col("z")).alias("softmax"),
    )
