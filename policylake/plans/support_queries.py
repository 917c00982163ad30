"""Queries of nearest-neighbour support, joint profiles, record validation and evidence sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from policylake.constants import CLUSTER_COLUMNS, CONTEXT_COLUMNS, SLICE_NAMES
from policylake.functions.core import cond_rate, reasons, rounded
from policylake.operators import candidates, inference, joint, selection, support
from policylake.operators.history import previous_value, time_bucket
from policylake.plans import decision_queries as dq
from policylake.plans import inference_queries as iq
from policylake.plans import joint_queries as jq
from policylake.plans import studies
from policylake.plans.registry import query
from policylake.plans.sqltext import candidates_cte, cells_cte, r9, score_sql, targets_cte, transitions_cte, utility_sql, with_
from policylake.session import shared_folder
from policylake.sources import adapters, sinks

_Z = ", ".join(f"(t.{c} - m_{c}) / s_{c} AS z_{c}" for c in CONTEXT_COLUMNS)
_D2 = " + ".join(f"(q.z_{c} - r.z_{c}) ** 2" for c in CONTEXT_COLUMNS)
_SCALE = "scl AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS m_{c}, CASE WHEN quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1) > 0 THEN quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1) ELSE 1 END AS s_{c}"
    for c in CONTEXT_COLUMNS) + " FROM trans WHERE publication_split = 'train')"


def _role(name: str, exp: str) -> str:
    return f"""{name}_r AS (SELECT * FROM z WHERE publication_split = 'train' AND experiment = '{exp}' QUALIFY count(*) OVER (PARTITION BY slice_type, action) >= 24),
{name}_rad AS (SELECT slice_type, action, greatest(quantile_cont(d, 0.95), 1e-4::DOUBLE) AS radius FROM (SELECT q.row_id, q.slice_type, q.action, sqrt(min({_D2})) AS d FROM {name}_r q JOIN {name}_r r
  ON q.slice_type = r.slice_type AND q.action = r.action AND q.row_id <> r.row_id GROUP BY ALL) GROUP BY 1, 2),
{name}_d AS (SELECT q.row_id, sqrt(min({_D2})) AS {name}_distance, any_value(rd.radius) AS radius FROM z q JOIN {name}_r r ON q.slice_type = r.slice_type AND q.action = r.action
  JOIN {name}_rad rd ON rd.slice_type = q.slice_type AND rd.action = q.action WHERE q.publication_split <> 'train' GROUP BY 1)"""


SCALED_SQL = f"{_SCALE}, z AS (SELECT t.row_id, t.episode_id, t.timestamp_s, t.slice_type, t.action, t.experiment, t.publication_split, {_Z} FROM trans t, scl)"
_SUPPORT = f"""{SCALED_SQL},
{_role('policy', 'exp1')}, {_role('evaluator', 'exp2')},
sup AS (SELECT z.row_id, z.publication_split, z.slice_type, z.action, policy_distance, evaluator_distance, coalesce(policy_distance <= p.radius, false) AS policy_ok, coalesce(evaluator_distance <= e.radius, false) AS evaluator_ok
  FROM z LEFT JOIN policy_d p USING (row_id) LEFT JOIN evaluator_d e USING (row_id) WHERE z.publication_split <> 'train')"""


_SUPPORTED: dict[tuple, object] = {}


def supported(spark, sf):
    """Distances and flags of every held-out row, searched once per application and prepared table."""
    t = adapters.prepared(spark, sf)
    key = (spark.sparkContext.applicationId, tuple(sorted(t.inputFiles())))
    if key not in _SUPPORTED:
        scaler = support.fit_scaler(t.filter("publication_split = 'train'"))
        rows = t.filter("publication_split <> 'train'")
        found = support.role_support(rows, {"policy": studies.policy_rows(t), "evaluator": studies.evaluator_rows(t)}, scaler)
        _SUPPORTED[key] = sinks.staged(rows.select("row_id", "publication_split", "slice_type", "action").join(found, "row_id"), "supported")
    return _SUPPORTED[key]


@query("j11_nearest_neighbour_distance", with_(transitions_cte(), _SUPPORT, body=f"SELECT row_id, {r9('policy_distance', 'policy_distance')}, {r9('evaluator_distance', 'evaluator_distance')} FROM sup"))
def nearest(spark, sf):
    return supported(spark, sf).select("row_id", rounded("policy_distance").alias("policy_distance"), rounded("evaluator_distance").alias("evaluator_distance"))


@query(
    "m15_state_support_audit",
    with_(transitions_cte(), _SUPPORT, body=f"""SELECT publication_split, slice_type, action, count(*) AS rows, {r9('avg(policy_ok::INT)', 'policy_overlap')}, {r9('avg(evaluator_ok::INT)', 'evaluator_overlap')},
    {r9('avg((policy_ok AND evaluator_ok)::INT)', 'joint_overlap')} FROM sup GROUP BY 1, 2, 3"""),
)
def audit(spark, sf):
    return supported(spark, sf).groupBy("publication_split", "slice_type", "action").agg(
        F.count(F.lit(1)).alias("rows"), rounded(cond_rate(F.col("policy_ok"))).alias("policy_overlap"), rounded(cond_rate(F.col("evaluator_ok"))).alias("evaluator_overlap"),
        rounded(cond_rate(F.col("policy_ok") & F.col("evaluator_ok"))).alias("joint_overlap"))


@query(
    "d6_support_guard",
    with_(
        cells_cte(), _SUPPORT,
        body="""SELECT s.row_id, policy_ok AND evaluator_ok AS locally_supported, CASE WHEN policy_ok AND evaluator_ok THEN s.action WHEN c.action IS NOT NULL THEN t.current_action ELSE f.fallback END AS guarded_action,
        NOT (policy_ok AND evaluator_ok) AND c.action IS NULL AS fallback_used FROM sup s JOIN targets t USING (row_id) JOIN fallbacks f ON f.slice_type = s.slice_type
        LEFT JOIN cells c ON c.slice_type = t.slice_type AND c.action = t.current_action""",
    ),
)
def guard(spark, sf):
    rows, _ = studies.candidate_rows(spark, sf, ["sup"])
    flags = supported(spark, sf).select("row_id", "policy_ok", "evaluator_ok")
    return support.guard(rows.join(flags, "row_id")).select("row_id", "locally_supported", "guarded_action", "fallback_used")


# ---- joint profiles ------------------------------------------------------------------------

_HY = dq.hysteresis_ctes("h", dq._SAFE, "0.65", "0.02::DOUBLE", score_sql())


def _profile_value(p: joint.JointProfile) -> str:
    return f"(({score_sql()} - {p.uncertainty_penalty}::DOUBLE * unc - CASE WHEN idx <> coalesce(inc, -1) THEN {p.switching_penalty}::DOUBLE ELSE 0.0::DOUBLE END) / 3)"


def _profile_sql(i: int, p: joint.JointProfile) -> str:
    keep = "false" if p.name == "original" else f"total - rv >= {p.minimum_advantage}::DOUBLE - 1e-9"
    return f"""{jq._knap(f'jp{i}', _profile_value(p))},
jr{i} AS (SELECT {jq._G}, count(DISTINCT cand.slice_type) AS k, round(sum(round({_profile_value(p)}, 12)), 9) AS rv, sum({utility_sql('e_')}) / 3 AS ref_u, sum(CASE cand.slice_type WHEN 'eMBB' THEN idx ELSE 0 END) AS re,
  sum(CASE cand.slice_type WHEN 'mMTC' THEN idx ELSE 0 END) AS rm, sum(CASE cand.slice_type WHEN 'URLLC' THEN idx ELSE 0 END) AS ru
  FROM cand JOIN (SELECT row_id, selected_action FROM h) hh ON hh.row_id = cand.row_id AND hh.selected_action = cand.a GROUP BY {jq._G} HAVING count(DISTINCT cand.slice_type) = 3),
jd{i} AS (SELECT r.*, total, ie, im, iu, coalesce({keep}, false) AND (ie, im, iu) <> (re, rm, ru) AS changed, '{p.name}' AS profile, total IS NOT NULL AND '{p.name}' <> 'original' AS proposed FROM jr{i} r LEFT JOIN jp{i} USING ({jq._G})),
ju{i} AS (SELECT d.profile, d.publication_split, d.scenario, d.training_config, d.experiment, d.changed, d.proposed, ref_u, CASE WHEN changed THEN (SELECT sum({utility_sql('c.e_')}) / 3 FROM cand c WHERE c.base_station = d.base_station AND c.scenario = d.scenario AND c.training_config = d.training_config
   AND c.experiment = d.experiment AND c.timestamp_s = d.timestamp_s AND c.idx = CASE c.slice_type WHEN 'eMBB' THEN ie WHEN 'mMTC' THEN im ELSE iu END) ELSE ref_u END AS new_u FROM jd{i} d)"""


_PROFILES = [_profile_sql(i, p) for i, p in enumerate(joint.JOINT_PROFILES)]
_PALL = "jall AS (" + " UNION ALL ".join(f"SELECT * FROM ju{i}" for i in range(len(joint.JOINT_PROFILES))) + ")"


def _profile_worth(p: joint.JointProfile):
    def worth(c):
        switch = F.when(c["idx"] != selection.incumbent_idx(), p.switching_penalty).otherwise(0.0)
        return (c["score"] - p.uncertainty_penalty * c["unc"] - switch) / 3

    return worth


def joint_decisions(spark, sf, profiles=None):
    """One row per (complete second, profile) with the evaluator's utility before and after."""
    rows, _ = studies.candidate_rows(spark, sf, studies.POLICY_FIELDS + studies.EVALUATOR_FIELDS)
    rows = joint.with_budget(selection.hysteresis_selection(rows, dq.CFG, 0.02), jq.BUDGETS)
    parts = []
    for p in profiles or joint.JOINT_PROFILES:
        worth = _profile_worth(p)
        r = rows.withColumns({
            "options": joint.compressed(worth, lambda c: (c["sla"] <= 0.6) & (c["unc"] <= 0.6)),
            "ref": F.struct(F.round(worth(F.col("pick")), 12).alias("v"), selection.outcome_utility(F.col("pick"), dq.CFG, "e_").alias("u"), F.col("pick.idx").alias("idx")),
            "us": F.map_from_arrays(F.transform("cand", lambda c: c["idx"]), F.transform("cand", lambda c: selection.outcome_utility(c, dq.CFG, "e_"))),
        })
        g = r.groupBy(*joint.GROUP).agg(
            *[F.max_by(F.struct("options", "ref", "us"), F.when(F.col("slice_type") == n, F.lit(1))).alias(n) for n in SLICE_NAMES], F.max("budget").alias("budget"))
        g = g.filter(" AND ".join(f"{n} IS NOT NULL" for n in SLICE_NAMES)).withColumn("k", joint.knapsack())
        rv = F.round(F.col("eMBB.ref.v") + F.col("mMTC.ref.v") + F.col("URLLC.ref.v"), 9)
        same = (F.col("k.e") == F.col("eMBB.ref.idx")) & (F.col("k.m") == F.col("mMTC.ref.idx")) & (F.col("k.u") == F.col("URLLC.ref.idx"))
        gain = -F.col("k.nv") - rv >= p.minimum_advantage - 1e-9
        changed = F.coalesce(gain & ~same, F.lit(False)) if p.name != "original" else F.lit(False)
        ref_u = (F.col("eMBB.ref.u") + F.col("mMTC.ref.u") + F.col("URLLC.ref.u")) / 3
        new_u = (F.element_at("eMBB.us", F.col("k.e")) + F.element_at("mMTC.us", F.col("k.m")) + F.element_at("URLLC.us", F.col("k.u"))) / 3
        parts.append(g.select(
            *joint.GROUP, F.lit(p.name).alias("profile"), changed.alias("changed"),
            (F.col("k").isNotNull() & F.lit(p.name != "original")).alias("proposed"), ref_u.alias("ref_u"),
            F.when(changed, new_u).otherwise(ref_u).alias("new_u")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "d15_joint_profiles",
    with_(candidates_cte(), _HY, *_PROFILES, _PALL,
          body=f"SELECT profile, publication_split, count(*) AS groups, count_if(changed) AS changed, count_if(proposed) AS proposed, {r9('avg(new_u)', 'utility')}, {r9('avg(new_u - ref_u)', 'delta')} FROM jall GROUP BY 1, 2"),
)
def joint_profiles(spark, sf):
    return joint_decisions(spark, sf).groupBy("profile", "publication_split").agg(
        F.count(F.lit(1)).alias("groups"), F.count_if("changed").alias("changed"), F.count_if("proposed").alias("proposed"),
        rounded(F.avg("new_u")).alias("utility"), rounded(F.avg(F.col("new_u") - F.col("ref_u"))).alias("delta"))


@query(
    "r4_joint_cluster_inference",
    with_(candidates_cte(), _HY, _profile_sql(1, joint.JOINT_PROFILES[1]),
          "dd AS (SELECT concat_ws('/', scenario, training_config, experiment) AS unit, avg(new_u - ref_u) AS delta FROM ju1 GROUP BY 1)", iq.infer_ctes("dd", "r4", False),
          body=f"SELECT {iq._INF} FROM inf"),
)
def joint_inference(spark, sf):
    d = joint_decisions(spark, sf, [joint.JOINT_PROFILES[1]])
    u = d.groupBy(F.concat_ws("/", *CLUSTER_COLUMNS).alias("unit")).agg(F.avg(F.col("new_u") - F.col("ref_u")).alias("delta"))
    return iq.tidy(inference.paired_inference(u, samples=iq.B, permutations=iq.P, seed="r4"))


@query("d17_joint_fold")
def joint_fold(spark, sf):
    d = sinks.staged(joint_decisions(spark, sf), "joint")
    v = d.filter("publication_split = 'validation'").groupBy("profile").agg(F.avg(F.col("new_u") - F.col("ref_u")).alias("gain"))
    best = v.agg(F.max_by("profile", F.when(F.col("gain") >= 0.002, F.round("gain", 12))).alias("p"))
    frozen = d.withColumn("frozen", F.coalesce(best.scalar(), F.lit("original"))).filter(F.col("profile") == F.col("frozen"))
    return frozen.filter("publication_split LIKE 'test%'").groupBy("publication_split", "profile").agg(
        F.count(F.lit(1)).alias("groups"), rounded(F.avg("new_u")).alias("utility"), rounded(F.avg(F.col("new_u") - F.col("ref_u"))).alias("delta"))


@query(
    "d31_frozen_controller_projection",
    with_(
        candidates_cte(), _HY,
        f"w AS (SELECT {jq._G}, sum(CASE slice_type WHEN 'eMBB' THEN p END)::BIGINT AS want_e, sum(CASE slice_type WHEN 'mMTC' THEN p END)::BIGINT AS want_m, sum(CASE slice_type WHEN 'URLLC' THEN p END)::BIGINT AS want_u FROM (SELECT *, regexp_extract(selected_action, ':prb=(\\d+)$', 1)::BIGINT AS p FROM h) GROUP BY {jq._G} HAVING count(DISTINCT slice_type) = 3)",
        "dw AS (SELECT DISTINCT want_e, want_m, want_u FROM w)",
        "op AS (SELECT dw.*, e, m, u, row_number() OVER (PARTITION BY want_e, want_m, want_u ORDER BY (e - want_e) ** 2 + (m - want_m) ** 2 + (u - want_u) ** 2, -(e + m + u), e, m, u) AS rk FROM dw, range(1, 15) a(e), range(1, 15) b(m), range(1, 15) c(u) WHERE e + m + u <= 14)",
        body=f"SELECT {jq._G}, e AS got_e, m AS got_m, u AS got_u FROM w JOIN op USING (want_e, want_m, want_u) WHERE rk = 1",
    ),
)
def frozen_controller(spark, sf):
    from policylake.functions.core import action_prb

    rows, _ = studies.candidate_rows(spark, sf)
    s = selection.hysteresis_selection(rows, dq.CFG, 0.02).select(*joint.GROUP, "slice_type", action_prb("selected_action").alias("p"))
    w = s.groupBy(*joint.GROUP).pivot("slice_type", SLICE_NAMES).agg(F.max("p")).dropna()
    w = w.select(*joint.GROUP, F.col("eMBB").alias("want_e"), F.col("mMTC").alias("want_m"), F.col("URLLC").alias("want_u"), F.lit(14).cast("long").alias("usable"))
    return joint.project_request(w).select(*joint.GROUP, "got_e", "got_m", "got_u")


# ---- records, ranking, evidence ------------------------------------------------------------

@query(
    "v15_logged_record_validation",
    with_(transitions_cte(), "pr AS (SELECT *, lag(timestamp_s) OVER (PARTITION BY episode_id ORDER BY timestamp_s) AS ps FROM trans)",
          body="""SELECT row_id, array_to_string(list_filter([CASE WHEN dl_cqi <= 1 THEN 'channel' END, CASE WHEN ps IS NOT NULL AND timestamp_s <> ps + 1 THEN 'step_index' END,
          CASE WHEN action <> regexp_replace(action, 'prb=2$', 'prb=4') THEN 'applied_action' END], lambda x: x IS NOT NULL), ',') AS errors FROM pr"""),
)
def record_validation(spark, sf):
    t = adapters.prepared(spark, sf)
    log = t.select("row_id", "episode_id", "timestamp_s", F.to_json(F.struct(
        F.array("dl_buffer_bytes", "ul_buffer_bytes", "requested_prbs").alias("queue"), F.array(F.col("dl_cqi") - 1).alias("channel"),
        F.col("action").alias("requested"), F.regexp_replace("action", "prb=2$", "prb=4").alias("applied"))).alias("record"))
    parsed = log.withColumn("r", F.from_json("record", "queue array<double>, channel array<double>, requested string, applied string"))
    p = previous_value(parsed, ["episode_id"], ["timestamp_s"], time_bucket("timestamp_s", 3600.0), F.col("timestamp_s"), "ps")
    e = reasons(
        (F.exists("r.queue", lambda q: (q < 0) | F.isnan(q)), "queue"), (F.exists("r.channel", lambda c: ~(c > 0)), "channel"),
        (F.col("timestamp_s") != F.col("ps") + 1, "step_index"), (F.col("r.requested") != F.col("r.applied"), "applied_action"))
    return p.select("row_id", F.array_join(e, ",").alias("errors"))


@query(
    "o4_model_ranking",
    with_(targets_cte(), body=f"SELECT action AS model, {r9('avg(utility)', 'score')}, count(*) AS n FROM targets GROUP BY 1 ORDER BY 2 DESC, 1"),
)
def ranking(spark, sf):
    t, _ = studies.targets(spark, sf)
    return t.groupBy(F.col("action").alias("model")).agg(rounded(F.avg("utility")).alias("score"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("score"), "model")


@query("s18_evidence_sinks")
def evidence(spark, sf):
    import uuid

    rows, _ = studies.candidate_rows(spark, sf)
    d = sinks.staged(selection.gated_selection(rows, dq.CFG).select("row_id", "episode_id", "publication_split", "selected_action", "direct_utility", "rollback"), "decisions")
    folder = f"{shared_folder(spark)}/policylake/evidence-{uuid.uuid4().hex}"
    sinks.write_evidence({
        "decisions": d,
        "episodes": d.groupBy("episode_id").agg(F.avg("direct_utility").alias("utility")),
        "splits": d.groupBy("publication_split").agg(F.avg("direct_utility").alias("utility"), cond_rate(F.col("rollback")).alias("rollback")),
    }, folder)
    parts = [spark.read.parquet(f"{folder}/{n}").agg(F.lit(n).alias("evidence"), F.count(F.lit(1)).alias("rows")) for n in ("decisions", "episodes", "splits")]
    return reduce(lambda a, b: a.unionByName(b), parts)
