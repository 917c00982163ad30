"""Queries of three-slice alignment, shadow recommendation, capacity and joint selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from policylake.constants import SLICE_NAMES
from policylake.functions.core import cond_rate, rounded, uniform
from policylake.operators import candidates, joins, joint, selection
from policylake.plans import decision_queries as dq
from policylake.plans import studies
from policylake.plans.registry import query
from policylake.plans.sqltext import candidates_cte, r9, score_sql, transitions_cte, utility_sql, with_
from policylake.sources import adapters

_G = "publication_split, scenario, training_config, experiment, base_station, timestamp_s"
_REP = f"""rep AS (SELECT {_G}, slice_type, avg(dl_buffer_bytes) AS dl_buffer_bytes, avg(next_dl_bitrate_mbps) AS next_dl_bitrate_mbps, arg_min(action, imsi_file) AS action,
  count(DISTINCT action) AS action_variants, bool_or(done) AS done, count(*) AS source_ue_rows FROM trans GROUP BY {_G}, slice_type),
full_g AS (SELECT {_G} FROM rep GROUP BY {_G} HAVING count(DISTINCT slice_type) = 3)"""
_REPCOLS = f"{_G}, slice_type, {r9('dl_buffer_bytes', 'dl_buffer_bytes')}, {r9('next_dl_bitrate_mbps', 'next_dl_bitrate_mbps')}, action, action_variants, done, source_ue_rows"


def _rep(spark, sf):
    return joint.representatives(adapters.prepared(spark, sf))


def _repcols(df):
    return df.select(*joint.GROUP, "slice_type", rounded("dl_buffer_bytes").alias("dl_buffer_bytes"), rounded("next_dl_bitrate_mbps").alias("next_dl_bitrate_mbps"),
                     "action", "action_variants", "done", "source_ue_rows")


@query("a20_joint_representatives", with_(transitions_cte(), _REP, body=f"SELECT {_REPCOLS} FROM rep"))
def representatives(spark, sf):
    return _repcols(_rep(spark, sf))


@query("j6_one_to_one_aggregates", with_(transitions_cte(), _REP, body=f"SELECT {_G}, slice_type, action_variants, source_ue_rows, {r9('dl_buffer_bytes', 'dl_buffer_bytes')} FROM rep"))
def one_to_one(spark, sf):
    """Means of the transitions joined with counts of the same keys from their own aggregate."""
    t, keys = adapters.prepared(spark, sf), [*joint.GROUP, "slice_type"]
    means = t.groupBy(*keys).agg(F.avg("dl_buffer_bytes").alias("dl_buffer_bytes"))
    info = t.groupBy(*keys).agg(F.countDistinct("action").alias("action_variants"), F.count(F.lit(1)).alias("source_ue_rows"))
    return joins.one_to_one(means, info, keys).select(*keys, "action_variants", "source_ue_rows", rounded("dl_buffer_bytes").alias("dl_buffer_bytes"))


@query("j8_complete_group_semi_join", with_(transitions_cte(), _REP, body=f"SELECT {_REPCOLS} FROM rep SEMI JOIN full_g USING ({_G})"))
def complete(spark, sf):
    return _repcols(joint.aligned(_rep(spark, sf)))


@query(
    "v9_joint_alignment_report",
    with_(transitions_cte(), _REP, f"per AS (SELECT {_G}, count(DISTINCT slice_type) AS k, count_if(action_variants > 1) AS mixed FROM rep GROUP BY {_G})",
          body=f"SELECT count(*) AS all_seconds, count_if(k = 3) AS complete_seconds, count_if(k <> 3) AS missing_seconds, {r9('avg((k = 3)::INT)', 'alignment_rate')}, sum(mixed)::BIGINT AS mixed_action_slice_seconds FROM per"),
)
def alignment(spark, sf):
    return joint.alignment_report(_rep(spark, sf))


_PIV = f"""piv AS (SELECT {_G}, {', '.join(f"avg(CASE WHEN slice_type = '{s}' THEN {c} END) AS {s}_{n}" for s in SLICE_NAMES for c, n in (('dl_buffer_bytes', 'queue'), ('slice_prb', 'prb'), ('reward', 'reward')))}
  FROM trans GROUP BY {_G} HAVING count(DISTINCT slice_type) = 3)"""
_SHADOW = f"""qs AS (SELECT quantile_cont(eMBB_queue, 0.9) AS qe, quantile_cont(URLLC_queue, 0.9) AS qu FROM piv WHERE publication_split = 'train'),
sh0 AS (SELECT piv.*, CASE WHEN URLLC_queue / qu > 0.45 THEN 'urllc_priority' WHEN eMBB_queue / qe > 1.0 THEN 'embb_priority' ELSE 'balanced' END AS mode, eMBB_prb + mMTC_prb + URLLC_prb AS tot FROM piv, qs),
sh AS (SELECT *, abs((CASE mode WHEN 'balanced' THEN 0.50 WHEN 'urllc_priority' THEN 0.35 ELSE 0.60 END)::DOUBLE - eMBB_prb / tot) + abs(0.2::DOUBLE - mMTC_prb / tot)
  + abs((CASE mode WHEN 'balanced' THEN 0.30 WHEN 'urllc_priority' THEN 0.45 ELSE 0.20 END)::DOUBLE - URLLC_prb / tot) AS l1 FROM sh0)"""


def _pivot(spark, sf):
    return joint.slice_pivot(adapters.prepared(spark, sf))


@query("a18_slice_pivot", with_(transitions_cte(), _PIV, body=f"SELECT {_G}, {', '.join(r9(f'{s}_{n}', f'{s}_{n}') for s in SLICE_NAMES for n in ('queue', 'prb', 'reward'))} FROM piv"))
def pivot(spark, sf):
    return _pivot(spark, sf).select(*joint.GROUP, *[rounded(f"{s}_{n}").alias(f"{s}_{n}") for s in SLICE_NAMES for n in ("queue", "prb", "reward")])


@query("a19_train_quantile_scales", with_(transitions_cte(), _PIV, _SHADOW, body=f"SELECT {r9('qe', 'embb_scale')}, {r9('qu', 'urllc_scale')} FROM qs"))
def scales(spark, sf):
    from policylake.functions.dims import constant

    s = joint.fit_queue_scales(_pivot(spark, sf))
    return constant(spark, [(s["eMBB"], s["URLLC"])], "embb_scale double, urllc_scale double").select(rounded("embb_scale").alias("embb_scale"), rounded("urllc_scale").alias("urllc_scale"))


def _shadow(spark, sf):
    p = _pivot(spark, sf)
    return joint.shadow(p, joint.fit_queue_scales(p))


@query("p29_queue_priority_rule", with_(transitions_cte(), _PIV, _SHADOW, body=f"SELECT {_G}, mode FROM sh"))
def queue_rule(spark, sf):
    return _shadow(spark, sf).select(*joint.GROUP, "mode")


@query("d18_shadow_recommendation", with_(transitions_cte(), _PIV, _SHADOW, body=f"SELECT {_G}, mode, {r9('l1', 'l1_distance')}, {r9('eMBB_prb / tot', 'recorded_embb_share')} FROM sh"))
def shadow(spark, sf):
    s = _shadow(spark, sf)
    return s.select(*joint.GROUP, "mode", rounded("l1").alias("l1_distance"), rounded(F.col("eMBB_prb") / (F.col("eMBB_prb") + F.col("mMTC_prb") + F.col("URLLC_prb"))).alias("recorded_embb_share"))


@query(
    "v10_alignment_coverage",
    with_(transitions_cte(), _PIV, _SHADOW,
          f"al AS (SELECT publication_split, count(*) AS all_seconds FROM (SELECT DISTINCT {_G} FROM trans) GROUP BY 1)",
          body=f"""SELECT al.publication_split, all_seconds, count(mode) AS aligned, count_if(mode = 'balanced') AS balanced, count_if(mode = 'urllc_priority') AS urllc_priority,
          count_if(mode = 'embb_priority') AS embb_priority, {r9('count(mode) / all_seconds', 'rate')} FROM al LEFT JOIN sh USING (publication_split) GROUP BY 1, 2"""),
)
def coverage(spark, sf):
    return joint.shadow_coverage(adapters.prepared(spark, sf), _shadow(spark, sf))


# ---- capacity ------------------------------------------------------------------------------

_CELL = """cap AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, [5, 10, 15, 20, 40, 100][(l_suppkey % 6 + 1)::INT]::BIGINT AS bandwidth_mhz, [15, 30, 60][(l_partkey % 3 + 1)::INT]::BIGINT AS scs_khz,
  (l_quantity / 5)::BIGINT AS reserved_prbs FROM lineitem)"""


def _capacity(spark, sf):
    li = adapters.table(spark, sf, "lineitem")
    def pick(vals, i):
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in vals]), (i + 1).cast("int"))
    return li.select(*adapters.TRACE_ORDER[:5], pick([5, 10, 15, 20, 40, 100], F.col("l_suppkey") % 6).alias("bandwidth_mhz"),
                     pick([15, 30, 60], F.col("l_partkey") % 3).alias("scs_khz"), F.rint(F.col("l_quantity") / 5).cast("long").alias("reserved_prbs"))


def _carrier_sql() -> str:
    return "carrier(bandwidth_mhz, scs_khz, carrier_prbs) AS (VALUES " + ", ".join(f"({b}::BIGINT, {s}::BIGINT, {n}::BIGINT)" for (b, s), n in joint.CARRIER_PRBS.items()) + ")"


@query(
    "p21_carrier_prbs",
    with_(_CELL.replace("(l_quantity / 5)::BIGINT", "round_even(l_quantity / 5, 0)::BIGINT"), _carrier_sql(),
          body="""SELECT bandwidth_mhz, scs_khz, reserved_prbs, carrier_prbs, CASE WHEN reserved_prbs < carrier_prbs THEN carrier_prbs - reserved_prbs END AS available_prbs, count(*) AS n
          FROM cap LEFT JOIN carrier USING (bandwidth_mhz, scs_khz) GROUP BY ALL"""),
)
def carrier(spark, sf):
    a = joint.available_prbs(_capacity(spark, sf))
    return a.groupBy("bandwidth_mhz", "scs_khz", "reserved_prbs", "carrier_prbs", "available_prbs").agg(F.count(F.lit(1)).alias("n"))


def _usable(spark, sf):
    li = adapters.table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 40).alias("cell")).agg((12 + F.max("l_quantity")).cast("long").alias("usable"))


@query(
    "p22_largest_remainder",
    with_(
        "us AS (SELECT l_suppkey % 40 AS cell, (12 + max(l_quantity))::BIGINT AS usable FROM lineitem GROUP BY 1)",
        "shr(se, sm, su) AS (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in joint.SHARES) + ")",
        "raw AS (SELECT cell, usable, usable - 3 AS rem, [(usable - 3) * se, (usable - 3) * sm, (usable - 3) * su] AS r FROM us, shr)",
        "fl AS (SELECT *, list_transform(r, lambda x: floor(x)::BIGINT) AS b, list_transform(r, lambda x: round(x - floor(x), 9)) AS f FROM raw)",
        "lf AS (SELECT *, rem - list_sum(b) AS lo FROM fl)",
        body="""SELECT DISTINCT cell, usable, b[1] + 1 + ((f[2] > f[1])::INT + (f[3] > f[1])::INT < lo)::INT AS prb_embb, b[2] + 1 + ((f[1] >= f[2])::INT + (f[3] > f[2])::INT < lo)::INT AS prb_mmtc,
        b[3] + 1 + ((f[1] >= f[3])::INT + (f[2] >= f[3])::INT < lo)::INT AS prb_urllc FROM lf""",
    ),
)
def remainder(spark, sf):
    return joint.share_catalogue(_usable(spark, sf))


_REQ = "req AS (SELECT 2 * (1 + l_suppkey % 4) AS want_e, 2 * (1 + l_partkey % 4) AS want_m, 2 * (1 + l_orderkey % 4) AS want_u, 10 + l_linenumber % 5 AS usable FROM lineitem)"


def _requests(spark, sf):
    li = adapters.table(spark, sf, "lineitem")
    def w(c):
        return (2 * (1 + F.col(c) % 4)).cast("long")
    return li.select(w("l_suppkey").alias("want_e"), w("l_partkey").alias("want_m"), w("l_orderkey").alias("want_u"), (10 + F.col("l_linenumber") % 5).cast("long").alias("usable"))


@query(
    "p23_nearest_feasible_allocation",
    with_(
        _REQ, "dr AS (SELECT want_e, want_m, want_u, usable, count(*) AS n FROM req GROUP BY ALL)",
        """op AS (SELECT dr.*, e, m, u, row_number() OVER (PARTITION BY want_e, want_m, want_u, usable ORDER BY (e - want_e) ** 2 + (m - want_m) ** 2 + (u - want_u) ** 2, -(e + m + u), e, m, u) AS rk
        FROM dr, range(1, 15) a(e), range(1, 15) b(m), range(1, 15) c(u) WHERE e + m + u <= usable)""",
        body="SELECT want_e, want_m, want_u, usable::BIGINT AS usable, n, e AS got_e, m AS got_m, u AS got_u FROM op WHERE rk = 1",
    ),
)
def nearest(spark, sf):
    r = _requests(spark, sf).groupBy("want_e", "want_m", "want_u", "usable").agg(F.count(F.lit(1)).alias("n"))
    return joint.project_request(r)


@query(
    "p24_joint_action_feasibility",
    with_(_REQ, body="""SELECT want_e, want_m, want_u, usable::BIGINT AS usable, CASE WHEN want_e + want_m + want_u > usable THEN 'over_budget' ELSE '' END AS errors, count(*) AS n FROM req GROUP BY ALL"""),
)
def feasibility(spark, sf):
    r = _requests(spark, sf).withColumn("scheduler", F.lit("proportional_fair"))
    e = r.withColumn("errors", F.array_join(joint.allocation_errors(("want_e", "want_m", "want_u"), "usable"), ","))
    return e.groupBy("want_e", "want_m", "want_u", "usable", "errors").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p31_allocation_pack_flatten",
    with_(_REQ, body="""SELECT want_e AS prb_embb, want_m AS prb_mmtc, want_u AS prb_urllc, 'proportional_fair' AS scheduler, count(*) AS n FROM req GROUP BY ALL"""),
)
def pack(spark, sf):
    packed = _requests(spark, sf).select(F.to_json(F.struct(
        F.struct(F.col("want_e").alias("eMBB"), F.col("want_m").alias("mMTC"), F.col("want_u").alias("URLLC")).alias("slice_prbs"), F.lit("proportional_fair").alias("scheduler"))).alias("wire"))
    flat = packed.select(F.from_json("wire", "slice_prbs struct<eMBB:long,mMTC:long,URLLC:long>, scheduler string").alias("a"))
    return flat.groupBy(F.col("a.slice_prbs.eMBB").alias("prb_embb"), F.col("a.slice_prbs.mMTC").alias("prb_mmtc"), F.col("a.slice_prbs.URLLC").alias("prb_urllc"), F.col("a.scheduler").alias("scheduler")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "v11_capacity_manifest",
    with_(
        transitions_cte(),
        "mf AS (SELECT base_station, training_config, 20 + count(*) % 300 AS total_prbs, count(*) % 30 AS reserved_prbs, count(*) % 7 AS numerology, CASE WHEN count(*) % 5 = 0 THEN 'trace' ELSE 'phy_observed' END AS source FROM trans GROUP BY 1, 2)",
        body="""SELECT base_station, training_config, array_to_string(list_filter([CASE WHEN total_prbs NOT BETWEEN 1 AND 275 THEN 'total_prbs' END, CASE WHEN reserved_prbs >= total_prbs THEN 'reserved_prbs' END,
        CASE WHEN numerology > 5 THEN 'numerology' END, CASE WHEN source = 'trace' THEN 'source' END], lambda x: x IS NOT NULL), ',') AS errors FROM mf""",
    ),
)
def manifest(spark, sf):
    t = adapters.prepared(spark, sf).groupBy("base_station", "training_config").agg(F.count(F.lit(1)).alias("c"))
    m = t.select("base_station", "training_config", (20 + F.col("c") % 300).alias("total_prbs"), (F.col("c") % 30).alias("reserved_prbs"), (F.col("c") % 7).alias("numerology"),
                 F.when(F.col("c") % 5 == 0, "trace").otherwise("phy_observed").alias("source"))
    return m.select("base_station", "training_config", F.array_join(joint.manifest_errors(), ",").alias("errors"))


# fixed values: budgets used by the joint queries; bs4 falls back to the smallest
BUDGETS = {"bs1": 14, "bs2": 16, "bs3": 18}
_BUDGET = "CASE base_station WHEN 'bs1' THEN 14 WHEN 'bs2' THEN 16 WHEN 'bs3' THEN 18 ELSE 14 END"


@query("j12_budget_lookup", with_(transitions_cte(), body=f"SELECT row_id, {_BUDGET} AS budget FROM trans"))
def budget(spark, sf):
    return joint.with_budget(adapters.prepared(spark, sf), BUDGETS).select("row_id", "budget")


_ELIG = "sla <= 0.6 AND unc <= 0.6"


def _knap(name: str, value: str) -> str:
    return f"""{name}_c AS (SELECT {_G}, slice_type, idx, cost, val, {_BUDGET} AS budget FROM (SELECT {_G}, slice_type, idx, regexp_extract(a, ':prb=(\\d+)$', 1)::BIGINT AS cost, round({value}, 12) AS val,
   row_number() OVER (PARTITION BY row_id, regexp_extract(a, ':prb=(\\d+)$', 1) ORDER BY round({value}, 12) DESC, idx) AS rk FROM cand WHERE {_ELIG}) WHERE rk = 1),
{name} AS (SELECT * FROM (SELECT e.publication_split, e.scenario, e.training_config, e.experiment, e.base_station, e.timestamp_s, e.idx AS ie, m.idx AS im, u.idx AS iu, e.cost + m.cost + u.cost AS total_cost,
  round(e.val + m.val + u.val, 9) AS total, row_number() OVER (PARTITION BY e.publication_split, e.scenario, e.training_config, e.experiment, e.base_station, e.timestamp_s
   ORDER BY round(e.val + m.val + u.val, 9) DESC, e.cost + m.cost + u.cost, e.idx, m.idx, u.idx) AS rk
  FROM {name}_c e JOIN {name}_c m USING ({_G}) JOIN {name}_c u USING ({_G}) WHERE e.slice_type = 'eMBB' AND m.slice_type = 'mMTC' AND u.slice_type = 'URLLC' AND e.cost + m.cost + u.cost <= e.budget) WHERE rk = 1)"""


def _joint_rows(spark, sf, value, fields):
    rows, _ = studies.candidate_rows(spark, sf, fields)
    s = candidates.with_scores(rows, dq.CFG)
    s = s.withColumn("options", joint.compressed(value, lambda c: (c["sla"] <= 0.6) & (c["unc"] <= 0.6)))
    return joint.with_budget(s, BUDGETS)


@query("d14_three_slice_knapsack", with_(candidates_cte(), _knap("kn", score_sql() + " / 3"), body=f"SELECT {_G}, ie, im, iu, total_cost, {r9('total', 'total')} FROM kn"))
def knapsack(spark, sf):
    g = joint.group_row(_joint_rows(spark, sf, lambda c: c["score"] / 3, studies.POLICY_FIELDS), []).withColumn("k", joint.knapsack()).filter(F.col("k").isNotNull())
    return g.select(*joint.GROUP, F.col("k.e").alias("ie"), F.col("k.m").alias("im"), F.col("k.u").alias("iu"), F.col("k.cost").alias("total_cost"), rounded(-F.col("k.nv")).alias("total"))


@query(
    "d16_validation_headroom",
    with_(
        candidates_cte(), _knap("kn", utility_sql("e_") + " / 3"),
        f"rf AS (SELECT {_G}, avg({utility_sql('e_')}) AS reference, count(DISTINCT slice_type) AS k FROM cand WHERE a = fallback GROUP BY {_G} HAVING count(DISTINCT slice_type) = 3)",
        body=f"""SELECT rf.publication_split, count(*) AS groups, {r9('avg(reference)', 'reference_mean')}, {r9('avg(greatest(reference, coalesce(total, reference)))', 'optimistic_mean')}, {r9('avg((total IS NOT NULL)::INT)', 'feasible_rate')}
        FROM rf LEFT JOIN kn USING ({_G}) GROUP BY 1""",
    ),
)
def headroom(spark, sf):
    util = lambda c: selection.outcome_utility(c, dq.CFG, "e_")
    rows = _joint_rows(spark, sf, lambda c: util(c) / 3, studies.POLICY_FIELDS + studies.EVALUATOR_FIELDS)
    ref = F.filter("cand", lambda c: c["action"] == F.col("fallback"))
    rows = rows.withColumn("ref", util(F.get(ref, F.lit(0))))
    g = joint.group_row(rows, ["ref"]).withColumn("k", joint.knapsack())
    reference = (F.col("eMBB.ref") + F.col("mMTC.ref") + F.col("URLLC.ref")) / 3
    g = g.withColumns({"reference": reference, "best": F.greatest(reference, F.coalesce(-F.col("k.nv"), reference))})
    return g.groupBy("publication_split").agg(F.count(F.lit(1)).alias("groups"), rounded(F.avg("reference")).alias("reference_mean"), rounded(F.avg("best")).alias("optimistic_mean"),
                                              rounded(cond_rate(F.col("k").isNotNull())).alias("feasible_rate"))
