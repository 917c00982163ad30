"""Driver tables read as domain tables (trace from lineitem, KPI snapshots from events)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylake.functions.core import decision_list, lookup
from policylake.session import shared_folder
from policylake.sources.sinks import write_prepared
from policylake.sources.trace import clean_trace, to_seconds, to_transitions, with_publication_split

SCENARIOS = ["rome_static_close", "rome_static_medium", "rome_static_far", "rome_slow_close"]
TRACE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
               "l_shipdate"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slice_trace(spark: SparkSession, folder: str, multi_ue: bool = False) -> DataFrame:
    """Raw 250 ms trace rows derived from lineitem, before cleaning."""
    li = table(spark, folder, "lineitem")
    d = "double"
    flag = lookup("l_returnflag", {"A": 0, "N": 1, "R": 2})
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    ue = F.col("l_suppkey") % 2 if multi_ue else flag
    return li.select(
        *TRACE_ORDER,
        lookup(F.floor(F.col("l_orderkey") / 18) % 4, dict(enumerate(SCENARIOS))).alias("scenario"),
        F.concat(F.lit("tr"), (F.col("l_orderkey") % 18).cast("string")).alias("training_config"),
        decision_list([(F.col("l_linestatus") == "F", "exp1")], "exp2").alias("experiment"),
        F.concat(F.lit("bs"), (F.col("l_partkey") % 4 + 1).cast("string")).alias("base_station"),
        F.concat(F.lit("ue"), ue.cast("string")).alias("imsi_file"),
        (F.floor(days / 90) * 1000 + 250 * (F.col("l_linenumber") % 4)).cast(d).alias("timestamp_ms"),
        F.col("l_linenumber").cast(d).alias("num_ues"),
        flag.cast(d).alias("slice_id"),
        (2 * (1 + F.col("l_suppkey") % 4)).cast(d).alias("slice_prb"),
        (1 + F.col("l_tax")).alias("power_multiplier"),
        (F.col("l_linenumber") % 3).cast(d).alias("scheduler_code"),
        (F.col("l_partkey") % 28).cast(d).alias("dl_mcs"),
        (F.col("l_quantity") * 200).alias("dl_buffer_bytes"),
        (F.col("l_extendedprice") / 50000).alias("dl_bitrate_mbps"),
        (F.col("l_discount") * 100).alias("dl_errors_pct"),
        (1 + F.col("l_partkey") % 15).cast(d).alias("dl_cqi"),
        (F.col("l_suppkey") % 28).cast(d).alias("ul_mcs"),
        (F.col("l_quantity") * 20).alias("ul_buffer_bytes"),
        (F.col("l_extendedprice") / 500000).alias("ul_bitrate_mbps"),
        (F.col("l_tax") * 100).alias("ul_errors_pct"),
        (F.col("l_suppkey") % 30).cast(d).alias("ul_sinr"),
        F.col("l_quantity").alias("requested_prbs"),
        F.floor(F.col("l_quantity") * (1 - 5 * F.col("l_tax"))).cast(d).alias("granted_prbs"),
    )


def seconds(spark: SparkSession, folder: str, multi_ue: bool = False) -> DataFrame:
    return to_seconds(clean_trace(slice_trace(spark, folder, multi_ue)))


_PREPARED: dict[tuple, DataFrame] = {}


def prepared(spark: SparkSession, folder: str, multi_ue: bool = False) -> DataFrame:
    """The transition table, written to the shared folder once per application and input.

    Studies fit and score several times over the same transitions; they read this prepared
    table, as separate prepare and evaluate jobs would.
    """
    files = tuple(sorted(table(spark, folder, "lineitem").inputFiles()))
    key = (spark.sparkContext.applicationId, files, multi_ue)
    if key not in _PREPARED:
        path = f"{shared_folder(spark)}/policylake/transitions-{uuid.uuid4().hex}"
        _PREPARED[key] = write_prepared(transitions(spark, folder, multi_ue), path)
    return _PREPARED[key]


def transitions(spark: SparkSession, folder: str, multi_ue: bool = False) -> DataFrame:
    """Transition rows with the publication split and a stable row id."""
    out = with_publication_split(to_transitions(seconds(spark, folder, multi_ue)))
    return out.withColumn("row_id", F.concat_ws("@", "episode_id", "timestamp_s"))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """KPI snapshots derived from events."""
    return observations_of(spread(table(spark, folder, "events")))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of fewer files than cores; larger inputs are left as read.

    Decisions over snapshots are narrow, so without this a single small file is a single task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def observations_of(ev: DataFrame) -> DataFrame:
    """The same projection for a batch or a streaming table of events."""
    k = F.get_json_object("props", "$.k").cast("int")
    base = ev.select(
        "event_id", "event_type", "user_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("v"), k.alias("k"),
    )
    prb = F.least(F.lit(1.18), 0.05 + 0.011 * F.col("k"))
    return base.select(
        "event_id",
        "timestamp",
        (F.unix_micros("timestamp") / 1e6).alias("epoch_s"),
        F.concat(F.lit("cell-"), F.lpad((F.col("user_id") % 8 + 1).cast("string"), 3, "0")).alias("cell_id"),
        lookup(F.col("user_id") % 3, {0: "eMBB", 1: "URLLC", 2: "mMTC"}).alias("slice_type"),
        prb.alias("prb_utilization"),
        ((F.col("user_id") * 37) % 1400).cast("int").alias("active_users"),
        (1 + F.col("v")).alias("downlink_mbps"),
        (0.18 * (1 + F.col("v"))).alias("uplink_mbps"),
        (1 + (F.col("k") * 13) % 120).cast("double").alias("latency_ms"),
        (0.16 * (1 + (F.col("k") * 13) % 120)).alias("jitter_ms"),
        (F.when(F.col("event_type") == "error", 2.5).otherwise(0.0) + F.col("k") / 100).alias("packet_loss_pct"),
        ((1 + F.col("v")) * (0.6 + F.col("k") / 100)).alias("throughput_demand_mbps"),
        F.least(F.lit(1.18), 0.18 + 0.68 * F.least(prb, F.lit(1.0))).alias("energy_load"),
        ((F.col("event_id") % 70) / 10).alias("handover_failure_pct"),
        (-60.0 - F.col("event_id") % 65).alias("rsrp_dbm"),
        (F.col("event_id") % 40 - 6).cast("double").alias("sinr_db"),
        ((F.col("k") * 61) % 6000).cast("double").alias("telemetry_age_ms"),
        (1.0 - (F.col("event_id") % 5) / 20).alias("telemetry_completeness"),
        "k",
    )
