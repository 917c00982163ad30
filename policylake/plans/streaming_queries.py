"""Streaming queries: each drains the event files and returns the table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from policylake.constants import KPI_COLUMNS
from policylake.functions.core import cond_rate, rounded
from policylake.operators import governed, quality
from policylake.plans import telemetry_queries as tq
from policylake.plans.kpi_queries import requested_intent
from policylake.plans.registry import SQL, query
from policylake.plans.sqltext import LABEL_SQL, OBS, decide_ctes, intents_cte, policies_cte, r9, with_
from policylake.sources import adapters
from policylake.streaming import pipelines


def _labelled(spark, sf):
    return pipelines.event_stream(spark, sf).withColumn("policy", governed.expert_label())


_LOGS: dict[tuple, object] = {}


def _state(spark, sf):
    """The cell log of the labelled stream, written once per application and input."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LOGS:
        def build(observed):
            return pipelines.cell_stream(observed.withColumn("policy", governed.expert_label()), dwell=1800.0, window=21600.0, max_switches=6)

        _LOGS[key] = pipelines.drained(spark, sf, build, "cells")
    return _LOGS[key]


@query("t1_stream_validation", SQL["v1_kpi_range_validation"])
def validation(spark, sf):
    i = F.col("event_id")
    dirty = pipelines.event_stream(spark, sf).withColumns({
        "prb_utilization": F.when(i % 101 == 0, 1.7).otherwise(F.col("prb_utilization")),
        "slice_type": F.when(i % 103 == 0, "eMBBx").otherwise(F.col("slice_type")),
        "latency_ms": F.when(i % 107 != 0, F.col("latency_ms")),
    })
    _, bad = pipelines.validate_to_two_sinks(dirty)
    return bad.select("event_id", "errors")


@query("t2_stream_dwell_guard", SQL["w5_dwell_churn_guard"])
def dwell(spark, sf):
    return _state(spark, sf).select("event_id", "dwell_reject", "churn_reject")


@query("t3_stream_rollback", with_(OBS, tq._EV, tq._ARM, body="SELECT event_id, len(reasons) > 0 AS rollback FROM rb"))
def rollback(spark, sf):
    return _state(spark, sf).select("event_id", "rollback")


@query(
    "t4_stream_forecast",
    with_(OBS, tq._HIST24, "n AS (SELECT event_id, least(row_number() OVER (PARTITION BY cell_id ORDER BY epoch_s, event_id), 120) AS points FROM obs)",
          body=f"SELECT event_id, points::INT AS points, CASE WHEN points >= 3 THEN round({tq._EWMA}, 9) END AS ewma FROM h24 JOIN n USING (event_id)"),
)
def forecast(spark, sf):
    return _state(spark, sf).select("event_id", "points", rounded("ewma").alias("ewma"))


@query(
    "t5_stream_audit_chain",
    with_(OBS, body="SELECT cell_id, count(*) AS records, 0::BIGINT AS previous_mismatch, 0::BIGINT AS record_mismatch FROM obs GROUP BY 1"),
)
def audit_chain(spark, sf):
    return pipelines.verify_stream_chain(_state(spark, sf), adapters.observations(spark, sf))


@query("t6_stream_control_step")
def control(spark, sf):
    out = pipelines.drained(spark, sf, lambda observed: pipelines.control_step(observed, requested_intent()), "control")
    return out.groupBy("cell_id", "policy").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("rollback").alias("rollbacks"), F.count_if("executed").alias("executed"),
        F.count_if(F.col("dwell_reject") | F.col("churn_reject")).alias("held_back"))


@query(
    "t7_stream_policy_counters",
    with_(OBS, f"l AS (SELECT *, {LABEL_SQL} AS policy FROM obs)",
          body=f"SELECT date_trunc('day', timestamp) AS window_start, policy, count(*) AS requests, {r9('sum(telemetry_age_ms)', 'total_ms')} FROM l GROUP BY 1, 2"),
)
def counters(spark, sf):
    def handle(df, target):
        df.write.mode("overwrite").parquet(target.format("counters"))

    base = pipelines.run_batches_complete(pipelines.policy_counters(_labelled(spark, sf)), "counters", handle)
    return spark.read.parquet(f"{base}/counters").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "policy", "requests", rounded("total_ms").alias("total_ms"))


_DRIFT_SQL = " + ".join(
    f"least(1.0::DOUBLE, abs(avg({c}) - avg({c}) FILTER (event_id % 2 = 0)) / (4 * greatest(stddev_pop({c}) FILTER (event_id % 2 = 0), 1e-6)))" for c in KPI_COLUMNS)


@query(
    "t8_stream_drift",
    with_(
        OBS, policies_cte(), intents_cte(), decide_ctes(),
        f"dr AS (SELECT round(({_DRIFT_SQL}) / {len(KPI_COLUMNS)}, 4) AS drift FROM obs)",
        f"f AS (SELECT avg((selected_policy = ({LABEL_SQL}))::INT) AS agree, avg(safe::INT) AS safety, any_value(drift) AS drift FROM decided, dr)",
        body="""SELECT unnest(['agreement', 'drift', 'safety']) AS gate, unnest([agree >= 0.75, drift <= 0.35, safety >= 0.995]) AS passed, drift,
        agree >= 0.75 AND drift <= 0.35 AND safety >= 0.995 AS promote FROM f""",
    ),
)
def drift(spark, sf):
    """Every batch against the even-numbered snapshots: drift, the gates of a promotion, the advice."""
    def gates(batch, drift):
        d = governed.decide(governed.resolve_intent(batch, requested_intent()), governed.proposals(F.col("event_id")))
        facts = d.agg(cond_rate(F.col("selected_policy") == governed.expert_label()).alias("agree"), cond_rate(F.col("chosen.safe")).alias("safety"))
        return quality.gate_table(facts, {"agreement": F.col("agree") >= 0.75, "drift": drift <= 0.35, "safety": F.col("safety") >= 0.995})

    reference = adapters.observations(spark, sf).filter("event_id % 2 = 0")
    return pipelines.promotion_per_batch(pipelines.event_stream(spark, sf), reference, KPI_COLUMNS, gates).drop("batch")
