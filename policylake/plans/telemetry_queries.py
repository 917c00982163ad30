"""Queries on telemetry sources, validation, per-cell windows and coordination."""

from __future__ import annotations

from pyspark.sql import functions as F

from policylake.constants import KPI_COLUMNS, KPI_RANGES, MEASURED_FIELDS, POLICIES
from policylake.functions.core import cond_rate, rounded
from policylake.functions.dims import constant
from policylake.operators import aggregates, cells, governed, quality
from policylake.operators.order_stats import exact_quantiles
from policylake.plans.kpi_queries import decided
from policylake.plans.registry import query
from policylake.plans.sqltext import (
    INTENT_SQL,
    LABEL_SQL,
    OBS,
    clip_sql,
    decide_ctes,
    intents_cte,
    policies_cte,
    r9,
    transitions_cte,
    with_,
)
from policylake.sources import adapters, catalogues, telemetry

# ---- nested payloads -----------------------------------------------------------------------


def _payload(spark, sf):
    o = adapters.observations(spark, sf)
    deep = F.array(F.struct((F.col("event_id") + 0.5).alias("leaf")))
    for name in "fedcba":
        deep = F.struct(deep.alias(name))
    js = F.to_json(F.struct(
        F.col("cell_id").alias("ran_node"),
        F.array(F.struct(F.col("downlink_mbps").alias("dl_brate"), F.col("uplink_mbps").alias("ul_brate"),
                         (F.col("prb_utilization") * 100).alias("dl_prb"), F.col("active_users").alias("nof_ues"))).alias("cells"),
        F.array(F.struct(F.lit("RSRP").alias("name"), F.col("rsrp_dbm").alias("value")),
                F.struct(F.lit("SINR").alias("name"), F.col("sinr_db").alias("value")),
                # the last value of a repeated name counts
                F.struct(F.when(F.col("event_id") % 3 == 0, "SINR").otherwise("OTHER").alias("name"), (F.col("sinr_db") + 1).alias("value"))).alias("metrics"),
        deep.alias("deep"),
    ))
    js = F.when(F.col("event_id") % 53 == 0, F.substring(js, F.lit(1), F.length(js) - 3)).otherwise(js)  # cut short: no JSON
    return o.select("event_id", "cell_id", "slice_type", js.alias("payload"))


_LAST = "CASE WHEN event_id % 3 = 0 THEN sinr_db + 1 ELSE sinr_db END"
_FLAT = f"""flat AS (SELECT event_id, unnest(['cells[0].dl_brate', 'cells[0].ul_brate', 'cells[0].dl_prb', 'cells[0].nof_ues', 'RSRP', 'SINR', 'metrics[0].value', 'metrics[1].value', 'metrics[2].value', 'deep.a.b.c.d.e.f[0].leaf', CASE WHEN event_id % 3 <> 0 THEN 'OTHER' END]) AS path,
  unnest([downlink_mbps, uplink_mbps, prb_utilization * 100, active_users::DOUBLE, rsrp_dbm, {_LAST}, rsrp_dbm, sinr_db, sinr_db + 1, event_id + 0.5::DOUBLE, sinr_db + 1]) AS value FROM obs WHERE event_id % 53 <> 0)"""


@query("s10_nested_json_flatten", with_(OBS, _FLAT, body=f"SELECT event_id, path, {r9('value', 'value')} FROM flat WHERE path IS NOT NULL"))
def flatten(spark, sf):
    f = telemetry.flatten_payload(_payload(spark, sf), "event_id", "payload")
    return f.select("event_id", "path", rounded("value").alias("value"))


_MAPPED = f"""mapped AS (SELECT event_id, cell_id, downlink_mbps, uplink_mbps, CASE WHEN prb_utilization * 100 > 1.5 THEN prb_utilization * 100 / 100.0::DOUBLE ELSE prb_utilization * 100 END AS prb_utilization,
  active_users, rsrp_dbm, {_LAST} AS sinr_db, 30.0::DOUBLE AS latency_ms, 5.0::DOUBLE AS jitter_ms, 0.0::DOUBLE AS packet_loss_pct, 0.55::DOUBLE AS energy_load, 0.5::DOUBLE AS handover_failure_pct,
  greatest(1.0::DOUBLE, downlink_mbps * 1.08::DOUBLE) AS throughput_demand_mbps, 6 / 12.0::DOUBLE AS telemetry_completeness FROM obs WHERE event_id % 53 <> 0)"""
_MAPCOLS = [c for c in KPI_COLUMNS] + ["telemetry_completeness"]


def _mapped(spark, sf):
    p = _payload(spark, sf)
    return telemetry.map_metrics(telemetry.with_entries(p, "payload").where("entries is not null"))


@query("s11_metric_alias_mapping", with_(OBS, _MAPPED, body=f"SELECT event_id, {', '.join(r9(c, c) for c in _MAPCOLS)} FROM mapped"))
def alias_mapping(spark, sf):
    m = _mapped(spark, sf)
    return m.select("event_id", *[rounded(c).alias(c) for c in _MAPCOLS])


@query(
    "s12_decoded_indications",
    with_(OBS, _MAPPED, body="SELECT event_id, cell_id, 'eMBB' AS slice_type, round(downlink_mbps, 9) AS downlink_mbps, round(sinr_db, 9) AS sinr_db FROM mapped"),
)
def indications(spark, sf):
    m = _mapped(spark, sf)
    return m.select(
        "event_id",
        F.coalesce(F.get_json_object("payload", "$.cell_id"), F.get_json_object("payload", "$.ran_node"), F.lit("e2-cell")).alias("cell_id"),
        F.coalesce(F.get_json_object("payload", "$.slice_type"), F.lit("eMBB")).alias("slice_type"),
        rounded("downlink_mbps").alias("downlink_mbps"), rounded("sinr_db").alias("sinr_db"),
    )


@query(
    "s13_exposition_text",
    with_(OBS, body="SELECT event_id, round(downlink_mbps, 4) AS downlink_mbps, round(latency_ms + 1, 4) AS latency_ms, NULL::DOUBLE AS jitter_ms FROM obs"),
)
def exposition(spark, sf):
    o = adapters.observations(spark, sf)
    text = F.concat(
        F.lit("# HELP dl rate\n\nran_dl_mbps{cell=\""), "cell_id", F.lit("\"} "), F.round("downlink_mbps", 4).cast("string"),
        F.lit("\nran_latency_ms "), F.col("latency_ms").cast("string"), F.lit("\nran_latency_ms "), (F.col("latency_ms") + 1).cast("string"),
        F.lit("\nran_broken{x=\"1\"} n/a\nlonely\n"),
    )
    cols = telemetry.parse_exposition(F.col("text"), {"downlink_mbps": "ran_dl_mbps", "latency_ms": "ran_latency_ms", "jitter_ms": "ran_broken"})
    out = o.withColumn("text", text).select("event_id", *[c.alias(n) for n, c in cols.items()])
    return out.select("event_id", F.round("downlink_mbps", 4).alias("downlink_mbps"), F.round("latency_ms", 4).alias("latency_ms"), "jitter_ms")


# ---- foreign tables ------------------------------------------------------------------------

_FOREIGN = """foreign_t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE rsrp_dbm END AS rsrp_dbm, CASE WHEN k % 3 = 0 THEN NULL ELSE downlink_mbps END AS downlink_mbps,
  uplink_mbps, CASE WHEN k % 11 = 0 THEN NULL ELSE latency_ms END AS latency_ms, cell_id AS location FROM obs),
norm AS (SELECT *, 'public' AS source_id, list_filter([CASE WHEN rsrp_dbm IS NOT NULL THEN 'rsrp_dbm' END, CASE WHEN downlink_mbps IS NOT NULL THEN 'downlink_mbps' END,
  CASE WHEN uplink_mbps IS NOT NULL THEN 'uplink_mbps' END, CASE WHEN latency_ms IS NOT NULL THEN 'latency_ms' END], lambda x: x IS NOT NULL) AS measured FROM foreign_t)"""


def _normalized(spark, sf):
    o = adapters.observations(spark, sf)
    foreign = o.select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("rsrp_dbm")).alias("Signal (dBm)"),
        F.when(F.col("k") % 3 != 0, F.col("downlink_mbps")).alias("Download (Mbps)"), F.col("uplink_mbps").alias("Upload (Mbps)"),
        F.when(F.col("k") % 11 == 0, "n/a").otherwise(F.col("latency_ms").cast("string")).alias("Ping (ms)"), F.col("cell_id").alias("Location"),
    )
    return telemetry.normalize_table(foreign, "public", "data", "event_id")


@query(
    "s6_table_normalisation",
    with_(OBS, _FOREIGN, body=f"""SELECT event_id AS source_row, location, {r9('rsrp_dbm', 'rsrp_dbm')}, {r9('downlink_mbps', 'downlink_mbps')}, {r9('uplink_mbps', 'uplink_mbps')},
    {r9('latency_ms', 'latency_ms')}, array_to_string(measured, ',') AS measured_fields FROM norm"""),
)
def normalisation(spark, sf):
    n = _normalized(spark, sf)
    return n.select("source_row", "location", *[rounded(c).alias(c) for c in ("rsrp_dbm", "downlink_mbps", "uplink_mbps", "latency_ms")],
                    F.array_join("measured_fields", ",").alias("measured_fields"))


@query(
    "s7_multi_table_read",
    with_(OBS, _FOREIGN, body="""SELECT source_id, source_row, observed FROM (SELECT 'public' AS source_id, event_id AS source_row, len(measured) AS observed FROM norm UNION ALL
    SELECT 'second', event_id, (latency_ms IS NOT NULL)::INT + (jitter_ms IS NOT NULL)::INT + (sinr_db IS NOT NULL)::INT FROM obs)"""),
)
def multi_table_read(spark, sf):
    every = cells.first_rows_per_source(_two_tables(spark, sf), None)
    return every.select("source_id", "source_row", F.size("measured_fields").alias("observed"))


@query(
    "s7_multi_table_cap",
    with_(OBS, _FOREIGN, body="""SELECT source_id, source_row FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY source_row) AS rn FROM (
    SELECT 'public' AS source_id, event_id AS source_row FROM norm UNION ALL SELECT 'second', event_id FROM obs)) WHERE rn <= 100"""),
)
def multi_table(spark, sf):
    return cells.first_rows_per_source(_two_tables(spark, sf), 100).select("source_id", "source_row")


def _two_tables(spark, sf):
    second = adapters.observations(spark, sf).select(
        "event_id", F.col("latency_ms").alias("RTT ms"), F.col("jitter_ms").alias("Jitter"), F.col("sinr_db").alias("SS-SINR"))
    return [_normalized(spark, sf), telemetry.normalize_table(second, "second", "data", "event_id")]


@query(
    "v8_measured_fields",
    with_(OBS, _FOREIGN, body=f"SELECT len(measured) AS observed, 12 - len(measured) AS derived, round(len(measured) / 12.0::DOUBLE, 4) AS realism, count(*) AS n FROM norm GROUP BY ALL"),
)
def measured(spark, sf):
    n = _normalized(spark, sf).withColumn("observed", F.size("measured_fields"))
    return n.groupBy("observed", (12 - F.col("observed")).alias("derived"), F.round(F.col("observed") / 12.0, 4).alias("realism")).agg(F.count(F.lit(1)).alias("n"))


_DL, _LAT, _RSRP = "coalesce(downlink_mbps, d_dl)", "coalesce(latency_ms, d_lat)", "coalesce(rsrp_dbm, d_rsrp)"
_PRB = clip_sql(f"0.18::DOUBLE + 0.66::DOUBLE * {clip_sql(f'{_DL} / d_p95', 0.0, 1.25)} + {clip_sql(f'({_LAT} - 25) / 100', 0.0, 0.35)}", 0.05, 1.18)
_PRESS = clip_sql(f"(-{_RSRP} - 88) / 42", 0.0, 1.0)


@query(
    "p9_feature_completion",
    with_(
        OBS, _FOREIGN,
        "dflt AS (SELECT quantile_cont(downlink_mbps, 0.5) AS d_dl, quantile_cont(latency_ms, 0.5) AS d_lat, quantile_cont(rsrp_dbm, 0.5) AS d_rsrp, greatest(quantile_cont(downlink_mbps, 0.95), 10.0::DOUBLE) AS d_p95 FROM norm)",
        body=f"""SELECT event_id AS source_row, 'public-' || location AS cell_id, round({_PRB}, 5) AS prb_utilization, round({_DL}, 4) AS downlink_mbps, round({_LAT}, 4) AS latency_ms,
        round({clip_sql(f'{_LAT} * 0.14::DOUBLE', 0.2, 35.0)}, 4) AS jitter_ms, round({clip_sql(f'greatest(0.0::DOUBLE, {_LAT} - 38) / 55 + 0.85::DOUBLE * {_PRESS}', 0.0, 8.0)}, 5) AS packet_loss_pct,
        round({clip_sql(f'({_RSRP} + 105) * 0.78::DOUBLE + 3', -8.0, 35.0)}, 4) AS sinr_db, len(measured) AS observed_model_features FROM norm, dflt""",
    ),
)
def completion(spark, sf):
    n = _normalized(spark, sf)
    c = telemetry.complete_features(n, telemetry.fit_completion(n))
    return c.select("source_row", "cell_id", "prb_utilization", "downlink_mbps", "latency_ms", "jitter_ms", "packet_loss_pct", "sinr_db", "observed_model_features")


# ---- replay, load test, catalogue ----------------------------------------------------------

@query("s8_telemetry_replay", with_(OBS, body="SELECT event_id, row_number() OVER (ORDER BY timestamp, event_id) - 1 AS sequence, 'replay' AS source FROM obs"))
def replay(spark, sf):
    return telemetry.replay(adapters.observations(spark, sf)).select("event_id", "sequence", "source")


@query(
    "s15_policy_catalogue",
    with_(OBS, policies_cte(), body=f"SELECT policy, scheduler, prb_share_delta, latency_factor, (SELECT count(*) FROM obs WHERE {LABEL_SQL} = policy) AS labelled FROM pol"),
)
def catalogue(spark, sf):
    dim = constant(spark, [(n, v[0], v[1], v[3]) for n, v in POLICIES.items()], "policy string, scheduler string, prb_share_delta double, latency_factor double")
    counts = adapters.observations(spark, sf).groupBy(governed.expert_label().alias("policy")).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "policy", "left").select("policy", "scheduler", "prb_share_delta", "latency_factor", F.coalesce("n", F.lit(0)).alias("labelled"))


# ---- validation ----------------------------------------------------------------------------

_DIRTY = "dirty AS (SELECT * REPLACE (CASE WHEN event_id % 101 = 0 THEN 1.7::DOUBLE ELSE prb_utilization END AS prb_utilization, CASE WHEN event_id % 103 = 0 THEN 'eMBBx' ELSE slice_type END AS slice_type, CASE WHEN event_id % 107 = 0 THEN NULL ELSE latency_ms END AS latency_ms) FROM obs)"


def _dirty(spark, sf):
    o = adapters.observations(spark, sf)
    i = F.col("event_id")
    return o.withColumns({
        "prb_utilization": F.when(i % 101 == 0, 1.7).otherwise(F.col("prb_utilization")),
        "slice_type": F.when(i % 103 == 0, "eMBBx").otherwise(F.col("slice_type")),
        "latency_ms": F.when(i % 107 != 0, F.col("latency_ms")),
    })


@query(
    "v1_kpi_range_validation",
    with_(OBS, _DIRTY, body="""SELECT event_id, array_to_string(errors, ',') AS errors FROM (SELECT event_id, list_filter([CASE WHEN prb_utilization > 1.5 THEN 'prb_utilization' END,
    CASE WHEN latency_ms IS NULL THEN 'latency_ms' END, CASE WHEN slice_type = 'eMBBx' THEN 'slice_type' END], lambda x: x IS NOT NULL) AS errors FROM dirty) WHERE len(errors) > 0"""),
)
def range_validation(spark, sf):
    _, bad = quality.split_valid(_dirty(spark, sf))
    return bad.select("event_id", F.array_join("errors", ",").alias("errors"))


@query(
    "v2_labelled_dataset_gates",
    with_(OBS, _DIRTY, body="""SELECT unnest(['non_empty', 'no_null_feature', 'known_labels']) AS gate, unnest([(SELECT count(*) > 0 FROM dirty), (SELECT count_if(latency_ms IS NULL) = 0 FROM dirty), true]) AS passed"""),
)
def labelled(spark, sf):
    return cells.labelled_gates(_dirty(spark, sf).withColumn("policy_label", governed.expert_label()), KPI_COLUMNS, list(POLICIES))


@query(
    "a13_feature_drift",
    with_(
        OBS, "e AS (SELECT obs.*, event_type FROM obs JOIN events USING (event_id))",
        f"ref AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in KPI_COLUMNS)} FROM e WHERE event_type = 'view')",
        body=" UNION ALL ".join(
            f"""SELECT event_type, '{c}' AS metric, {r9(f"least(1.0::DOUBLE, abs(avg({c}) - any_value(m_{c})) / (4 * greatest(any_value(s_{c}), 1e-6)))", 'drift')} FROM e, ref WHERE event_type <> 'view' GROUP BY 1"""
            for c in KPI_COLUMNS),
    ),
)
def drift(spark, sf):
    """Every other event type against views."""
    ev = adapters.table(spark, sf, "events").select("event_id", "event_type")
    o = adapters.observations(spark, sf).join(ev, "event_id")
    d = aggregates.feature_drift(o.filter("event_type = 'view'"), o.filter("event_type <> 'view'"), KPI_COLUMNS, ["event_type"])
    return d.select("event_type", "metric", rounded("drift").alias("drift"))


@query(
    "m22_promotion_gate",
    with_(
        OBS, policies_cte(), intents_cte(), decide_ctes(),
        f"f AS (SELECT avg((selected_policy = ({LABEL_SQL}))::INT) AS agree, avg(safe::INT) AS safety, avg(ood) AS d FROM decided)",
        body="SELECT unnest(['agreement', 'drift', 'safety']) AS gate, unnest([agree >= 0.75, d <= 0.35, safety >= 0.995]) AS passed FROM f",
    ),
)
def promotion(spark, sf):
    d = decided(spark, sf)
    facts = d.agg(cond_rate(F.col("selected_policy") == governed.expert_label()).alias("agree"), cond_rate(F.col("chosen.safe")).alias("safety"), F.avg("ood").alias("d"))
    return quality.gate_table(facts, {"agreement": F.col("agree") >= 0.75, "drift": F.col("d") <= 0.35, "safety": F.col("safety") >= 0.995})


@query(
    "a22_latency_summary",
    with_(OBS, body=f"""SELECT count(*) AS n, {r9('avg(telemetry_age_ms)', 'mean_ms')}, {r9('quantile_cont(telemetry_age_ms, 0.5)', 'p50_ms')}, {r9('quantile_cont(telemetry_age_ms, 0.95)', 'p95_ms')},
    {r9('max(telemetry_age_ms)', 'max_ms')}, {r9('count(*) / (sum(telemetry_age_ms) / 1000)', 'per_second')} FROM obs"""),
)
def latency_summary(spark, sf):
    o = adapters.observations(spark, sf)
    p50, p95 = exact_quantiles(o.select("telemetry_age_ms"), "telemetry_age_ms", [0.5, 0.95])
    t = F.col("telemetry_age_ms")
    return o.agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(t)).alias("mean_ms"), rounded(F.lit(p50)).alias("p50_ms"), rounded(F.lit(p95)).alias("p95_ms"),
                 rounded(F.max(t)).alias("max_ms"), rounded(F.count(F.lit(1)) / (F.sum(t) / 1000)).alias("per_second"))


# ---- per-cell windows ----------------------------------------------------------------------

_EV = f"ev AS (SELECT *, {LABEL_SQL} AS policy, row_number() OVER (PARTITION BY cell_id ORDER BY epoch_s, event_id) AS rn FROM obs)"


def labelled_events(spark, sf):
    return adapters.observations(spark, sf).withColumn("policy", governed.expert_label())


@query(
    "w5_dwell_churn_guard",
    with_(
        OBS, _EV,
        "hist AS (SELECT a.event_id, a.policy AS p, a.epoch_s AS t, b.policy AS hp, b.epoch_s AS ht, b.rn, lag(b.policy) OVER (PARTITION BY a.event_id ORDER BY b.rn) AS hpp, lag(b.epoch_s) OVER (PARTITION BY a.event_id ORDER BY b.rn) AS hpt, a.rn AS arn FROM ev a JOIN ev b ON a.cell_id = b.cell_id AND b.rn < a.rn AND (b.rn = a.rn - 1 OR b.epoch_s >= a.epoch_s - 21600))",
        "g AS (SELECT event_id, count_if(hpp <> hp AND t - hpt <= 21600) AS switches, bool_or(rn = arn - 1 AND hp <> p) AS changes, bool_or(rn = arn - 1 AND t - ht < 1800) AS young FROM hist GROUP BY 1)",
        body="SELECT ev.event_id, coalesce(changes AND young, false) AS dwell_reject, coalesce(changes AND switches >= 6, false) AS churn_reject FROM ev LEFT JOIN g USING (event_id)",
    ),
)
def dwell_guard(spark, sf):
    return cells.dwell_churn_guard(labelled_events(spark, sf), dwell=1800.0, window=21600.0, max_switches=6).select("event_id", "dwell_reject", "churn_reject")


_HIST24 = "h24 AS (SELECT event_id, list(throughput_demand_mbps) OVER (PARTITION BY cell_id ORDER BY epoch_s, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS h FROM obs)"
_EWMA = "list_reduce(h, lambda a, x: 0.45::DOUBLE * x + (1 - 0.45::DOUBLE) * a)"


def _forecasts(spark, sf):
    return cells.forecasts(adapters.observations(spark, sf), "throughput_demand_mbps", horizon=5)


@query("w6_ewma_forecast", with_(OBS, _HIST24, body=f"SELECT event_id, {r9(_EWMA, 'ewma')}, {r9('least(0.88::DOUBLE, 0.55::DOUBLE + len(h) / 100.0::DOUBLE)', 'confidence')} FROM h24"))
def ewma(spark, sf):
    return _forecasts(spark, sf).select("event_id", rounded(F.col("ewma")[0]).alias("ewma"), rounded(F.least(F.lit(0.88), 0.55 + F.col("points") / 100.0)).alias("confidence"))


_TREND = """tr AS (SELECT event_id, h, len(h) AS n, list_sum(h) AS sy, list_sum(list_transform(h, lambda x, i: x * (i - 1))) AS sxy FROM h24),
tl AS (SELECT *, n * (n - 1) / 2.0::DOUBLE AS sx, n * (n - 1) * (2 * n - 1) / 6.0::DOUBLE AS sxx FROM tr),
ts AS (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope FROM tl)"""
_P = "CASE WHEN n < 3 THEN h[-1] ELSE greatest(0.0::DOUBLE, (sy - slope * sx) / n + slope * (n + {s})) END"


@query("w7_trend_forecast", with_(OBS, _HIST24, _TREND, body=f"SELECT event_id, {r9(_P.format(s=0), 'step_1')}, {r9(_P.format(s=4), 'step_5')} FROM ts"))
def trend(spark, sf):
    return _forecasts(spark, sf).select("event_id", rounded(F.col("trend")[0]).alias("step_1"), rounded(F.col("trend")[4]).alias("step_5"))


@query(
    "w8_ensemble_forecast",
    with_(
        OBS, _HIST24, _TREND,
        f"en AS (SELECT event_id, h, n, {_EWMA} AS e, [{', '.join(_P.format(s=s) for s in range(5))}] AS t FROM ts)",
        body=f"""SELECT event_id, {r9('h[-1]', 'persistence')}, {r9('(e + t[1]) / 2', 'ensemble_1')}, {r9('''greatest(0.25::DOUBLE, least(0.90::DOUBLE,
        (least(0.88::DOUBLE, 0.55::DOUBLE + n / 100.0::DOUBLE) + least(0.82::DOUBLE, 0.45::DOUBLE + n / 90.0::DOUBLE)) / 2 - list_avg(list_transform(t, lambda x: abs(e - x) / 2)) / 500))''', 'confidence')} FROM en""",
    ),
)
def ensemble(spark, sf):
    f = _forecasts(spark, sf)
    spread = F.aggregate(F.transform("trend", lambda x: F.abs(F.col("ewma")[0] - x) / 2), F.lit(0.0), lambda a, x: a + x) / 5
    n = F.col("points")
    conf = (F.least(F.lit(0.88), 0.55 + n / 100.0) + F.least(F.lit(0.82), 0.45 + n / 90.0)) / 2 - spread / 500
    return f.select("event_id", rounded(F.col("persistence")[0]).alias("persistence"), rounded((F.col("ewma")[0] + F.col("trend")[0]) / 2).alias("ensemble_1"),
                    rounded(F.greatest(F.lit(0.25), F.least(F.lit(0.90), conf))).alias("confidence"))


_ARM = """arm AS (SELECT *, max(CASE WHEN policy <> 'balanced' THEN rn END) OVER (PARTITION BY cell_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS brn FROM ev),
rb AS (SELECT a.event_id, list_filter([CASE WHEN b.downlink_mbps > 0 AND (b.downlink_mbps - a.downlink_mbps) / b.downlink_mbps * 100 > 15 THEN 'throughput' END,
  CASE WHEN a.packet_loss_pct - b.packet_loss_pct > 5 THEN 'loss' END, CASE WHEN b.latency_ms > 0 AND (a.latency_ms - b.latency_ms) / b.latency_ms * 100 > 20 THEN 'latency' END], lambda x: x IS NOT NULL) AS reasons
  FROM arm a LEFT JOIN ev b ON a.cell_id = b.cell_id AND a.brn = b.rn)"""


@query("w9_rollback_check", with_(OBS, _EV, _ARM, body="SELECT event_id, len(reasons) > 0 AS rollback, array_to_string(reasons, ',') AS reasons FROM rb"))
def rollback(spark, sf):
    return cells.rollback_check(labelled_events(spark, sf), F.col("policy") != "balanced").select("event_id", F.col("rollback"), F.array_join("reasons", ",").alias("reasons"))


_LOG = """lg0 AS (SELECT event_id, cell_id, epoch_s, sha256(cell_id || '|' || event_id || '|' || policy) AS record_hash, cell_id || '|' || event_id || '|' || CASE WHEN event_id % 97 = 0 THEN 'altered' ELSE policy END AS canonical FROM ev),
lg AS (SELECT *, lag(record_hash, 1, repeat('0', 64)) OVER (PARTITION BY cell_id ORDER BY epoch_s, event_id) AS expected FROM lg0)"""


@query(
    "w11_hash_chain_verify",
    with_(OBS, _EV, _LOG, body="SELECT cell_id, count(*) AS records, count_if(event_id % 89 = 0) AS previous_mismatch, count_if(sha256(canonical) <> record_hash) AS record_mismatch FROM lg GROUP BY 1"),
)
def hash_chain(spark, sf):
    return cells.verify_chain(cells.demo_log(labelled_events(spark, sf)))


# ---- coordination --------------------------------------------------------------------------

_LATEST = "latest AS (SELECT * FROM (SELECT *, timestamp::DATE AS day, row_number() OVER (PARTITION BY cell_id, timestamp::DATE ORDER BY epoch_s DESC, event_id DESC) AS lrn FROM obs) WHERE lrn = 1)"
_RING = "edges AS (SELECT 'cell-' || lpad(i::VARCHAR, 3, '0') AS cell_id, 'cell-' || lpad((((i - 1 + d + 8) % 8) + 1)::VARCHAR, 3, '0') AS neighbor_id FROM range(1, 9) t(i), (SELECT unnest([-1, 1]) AS d))"
_COORD = """coord AS (SELECT d.day, d.cell_id, any_value(d.selected_policy) AS policy, any_value(d.utility_score) AS local_score, any_value(d.handover_failure_pct) AS ho, any_value(d.tx_power_db_delta) AS tx,
  coalesce(sum(CASE WHEN d.tx_power_db_delta > 0.5 THEN d.tx_power_db_delta * (greatest(0.0::DOUBLE, (8 - n.sinr_db) / 18) + greatest(0.0::DOUBLE, (n.prb_utilization - 0.78::DOUBLE) * 1.8::DOUBLE)) * 8 END), 0) AS cost,
  count_if(d.selected_policy = 'throughput_boost' AND n.prb_utilization > 0.95::DOUBLE) AS loaded
  FROM decided d LEFT JOIN edges e ON e.cell_id = d.cell_id LEFT JOIN latest n ON n.cell_id = e.neighbor_id AND n.day = d.day GROUP BY 1, 2)"""
_COORD_BODY = f"SELECT day, cell_id, policy, {r9('greatest(0.0::DOUBLE, local_score - cost)', 'network_score')}, cost <= 12 AND loaded = 0 AND NOT (ho > 6 AND tx < 0) AS approved, loaded FROM coord"


def _latest(spark, sf):
    o = adapters.observations(spark, sf).withColumn("day", F.to_date("timestamp"))
    rest = [c for c in o.columns if c not in ("cell_id", "day")]
    last = o.groupBy("cell_id", "day").agg(F.max_by(F.struct(*rest), F.struct("epoch_s", "event_id")).alias("r"))
    return last.select("cell_id", "day", "r.*")


@query("j10_neighbour_interference", with_(OBS, policies_cte(), intents_cte(), _LATEST, decide_ctes("latest"), _RING, _COORD, body=f"SELECT day, cell_id, {r9('cost', 'interference_cost')}, loaded FROM coord"))
def interference(spark, sf):
    latest = _latest(spark, sf)
    c = cells.coordinate(decided(spark, sf, latest), latest, cells.ring(spark, 8))
    return c.select("day", "cell_id", rounded("interference_cost").alias("interference_cost"), "loaded")


@query("d19_multi_cell_coordination", with_(OBS, policies_cte(), intents_cte(), _LATEST, decide_ctes("latest"), _RING, _COORD, body=_COORD_BODY))
def coordination(spark, sf):
    latest = _latest(spark, sf)
    c = cells.coordinate(decided(spark, sf, latest), latest, cells.ring(spark, 8))
    return c.select("day", "cell_id", "policy", rounded("network_score").alias("network_score"), "approved", "loaded")


@query(
    "p30_execution_outcome",
    with_(OBS, body=f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'recommendation_only' WHEN 1 THEN 'shadow_recorded' ELSE 'simulated' END AS status, event_id % 3 <> 0 AS attempted, event_id % 3 = 2 AS executed,
    CASE WHEN event_id % 3 = 2 THEN round(greatest(0.2::DOUBLE, latency_ms * (1 + (0.97::DOUBLE - 1) * 1.0::DOUBLE)), 6) END AS predicted_latency FROM obs"""),
)
def outcome(spark, sf):
    m = F.col("event_id") % 3
    mode = F.when(m == 0, "recommend").when(m == 1, "shadow").otherwise("simulated")
    return cells.execution_outcome(adapters.observations(spark, sf).withColumn("mode", mode), "balanced").select("event_id", "status", "attempted", "executed", "predicted_latency")


# ---- catalogues as tables ------------------------------------------------------------------

@query(
    "s15_intents",
    with_(OBS, intents_cte(), body=f"SELECT intent, w_latency, w_loss, w_throughput, w_stability, w_energy, risk_tolerance, energy_budget, (SELECT count(*) FROM obs WHERE {INTENT_SQL} = intent) AS requested FROM intents"),
)
def intents(spark, sf):
    """Intents with their weights and how many snapshots ask for each."""
    from policylake.plans.kpi_queries import requested_intent

    asked = governed.resolve_intent(adapters.observations(spark, sf), requested_intent()).groupBy("intent").agg(F.count(F.lit(1)).alias("requested"))
    table = catalogues.intents(spark)
    return table.drop("constraints").join(asked, "intent", "left").withColumn("requested", F.coalesce("requested", F.lit(0)))


@query(
    "s15_source_catalogue",
    with_(transitions_cte(), body="SELECT scenario AS source_id, count(*) AS rows, count(DISTINCT episode_id) AS episodes FROM trans GROUP BY 1 HAVING scenario <> 'rome_slow_close'"),
)
def source_catalogue(spark, sf):
    """Enabled sources of the trace with what each holds."""
    t = adapters.prepared(spark, sf)
    listed = t.groupBy(F.col("scenario").alias("source_id")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("episode_id").alias("episodes"))
    return catalogues.enabled(listed.withColumn("enabled", F.when(F.col("source_id") == "rome_slow_close", False)))
