"""Structured Streaming forms of the telemetry and per-cell operators.

Every stream reads files with a fixed schema, runs with `availableNow`, writes Parquet below the
session's shared checkpoint folder and can be compared with its batch twin. The state of a cell
(`cell_state`) moves in event order whatever the micro-batches; rows behind the watermark are late.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policylake.operators import aggregates, governed, quality
from policylake.session import shared_folder
from policylake.sources import adapters
from policylake.streaming import cell_state
from policylake.streaming.cell_state import NO_HASH

WATERMARK = "1 day"
#: Write buffers are memory of each open store outside the heap, 64 MB each by default.
STATE_STORE = {
    "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "rocksdb.writeBufferSizeMB": "8", "rocksdb.maxWriteBufferNumber": "2",
}


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """KPI snapshots from a growing folder of event files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder}/events*.parquet")
    )
    return adapters.observations_of(raw).withWatermark("timestamp", WATERMARK)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain the available input into Parquet and return the written table."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/policylake/stream-{name}-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def run_batches_complete(stream: DataFrame, name: str, handle: Callable[[DataFrame, str], None]) -> str:
    """Complete mode: every batch rewrites the whole (small) result table in one folder."""
    base = f"{shared_folder(stream.sparkSession)}/policylake/stream-{name}-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.outputMode("complete").foreachBatch(lambda df, epoch: handle(df, f"{base}/{{}}"))
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return base


def run_batches(stream: DataFrame, name: str, handle: Callable[[DataFrame, str], None]) -> str:
    """Drain the input through a `foreachBatch` handler; returns the output folder."""
    base = f"{shared_folder(stream.sparkSession)}/policylake/stream-{name}-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.foreachBatch(lambda df, epoch: handle(df, f"{base}/{{}}/batch={epoch}"))
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return base


def validate_to_two_sinks(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split each micro-batch into good and quarantined rows; batches overwrite their own folder,
    so a repeated batch writes the same files again."""
    spark = stream.sparkSession

    def handle(df: DataFrame, target: str) -> None:
        checked = df.withColumn("errors", F.array_join(quality.kpi_errors(), ",")).persist()
        checked.filter("errors = ''").write.mode("overwrite").parquet(target.format("good"))
        checked.filter("errors <> ''").write.mode("overwrite").parquet(target.format("quarantine"))
        checked.unpersist()

    base = run_batches(stream, "validate", handle)
    return spark.read.parquet(f"{base}/good"), spark.read.parquet(f"{base}/quarantine")


IDLE_SECONDS = 400 * 86400.0


def cell_stream(stream: DataFrame, dwell: float = 5.0, window: float = 60.0, max_switches: int = 6, control: Column | None = None) -> DataFrame:
    """Per-cell ordered state over snapshots with `policy` (or `control`, the judged candidates as JSON).

    Needs the RocksDB state store, which holds map state and timers.
    """
    for name, value in STATE_STORE.items():
        stream.sparkSession.conf.set(f"spark.sql.streaming.stateStore.{name}", value)
    rows = stream.withColumn("control", F.lit(None).cast("string") if control is None else control)
    if "policy" not in stream.columns:
        rows = rows.withColumn("policy", F.lit(None).cast("string"))
    typed = [F.col(c).cast(t).alias(c) for c, t in cell_state.INPUT.items()]
    return rows.select("timestamp", "cell_id", *typed).groupBy("cell_id").transformWithStateInPandas(
        cell_state.CellProcessor(cell_state.Guard(dwell, window, max_switches), IDLE_SECONDS), cell_state.OUTPUT, "append", "EventTime"
    )


@contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """A query started inside deals its keys over four tasks a core at most.

    Every micro-batch opens and commits a state store for each partition, rows or not, so partitions beyond
    what the cores need only add time. A query keeps the number of its first start.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drained(spark: SparkSession, folder: str, build: Callable[[DataFrame], DataFrame], name: str, files_per_trigger: int = 64, delay: str = WATERMARK) -> DataFrame:
    """Drain the event files through `build` in as many micro-batches as they need, then close the stream.

    Closing writes one mark behind the last event, by which the watermark passes every waiting row; a second
    run of the same query reads it. A stream that goes on leaves the mark out.
    """
    base = f"{shared_folder(spark)}/policylake/stream-{name}-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{folder}/events*.parquet")
    events.limit(0).write.parquet(f"{base}/marks")
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/events*.parquet")
    marks = spark.readStream.schema(events.schema).parquet(f"{base}/marks")
    observed = adapters.observations_of(raw).unionByName(adapters.observations_of(marks)).withWatermark("timestamp", delay)
    stream = build(observed)

    def run() -> None:
        with state_partitions(spark):
            q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    end = events.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL")
    mark = end.select(*[(F.col("ts") + F.expr(f"interval {delay}") + F.expr("interval 1 hour")).cast(f.dataType).alias("ts") if f.name == "ts"
                        else F.lit(-1).cast(f.dataType).alias(f.name) if f.name in ("event_id", "user_id") else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])
    mark.write.mode("append").parquet(f"{base}/marks")
    run()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def verify_stream_chain(log: DataFrame, order: DataFrame) -> DataFrame:
    """Re-hash every record of the written chains and check the links."""
    from policylake.operators.history import previous_value, time_bucket

    record = F.to_json(F.struct("cell_id", "event_id", "policy", "previous_hash"))  # keys in sorted order
    # hashed where the log is read, so that only keys and the two hashes travel; a day of a cell is one task's window
    hashed = log.select("cell_id", "event_id", "previous_hash", "record_hash", (F.sha2(record, 256) != F.col("record_hash")).alias("altered"))
    joined = hashed.join(order.select("event_id", "epoch_s"), "event_id")
    linked = previous_value(joined, ["cell_id"], ["epoch_s", "event_id"], time_bucket("epoch_s", 86400.0), F.col("record_hash"), "p")
    return linked.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("previous_hash") != F.coalesce("p", F.lit(NO_HASH))).alias("previous_mismatch"),
        F.count_if("altered").alias("record_mismatch"),
    )


def policy_counters(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """Windowed event-time counters per policy."""
    return (
        stream.groupBy(F.window("timestamp", width).alias("w"), "policy")
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("telemetry_age_ms").alias("total_ms"))
        .select(F.col("w.start").alias("window_start"), "policy", "requests", "total_ms")
    )


def promotion_per_batch(stream: DataFrame, reference: DataFrame, features: list[str], gates: Callable[[DataFrame, Column], DataFrame]) -> DataFrame:
    """Drift of every micro-batch against a reference of the same population, the promotion gates, the advice.

    `gates` takes the batch and its drift and returns (gate, passed).
    """
    spark = stream.sparkSession

    def handle(df: DataFrame, target: str) -> None:
        df = df.persist()
        d = aggregates.feature_drift(reference, df, features).agg(F.round(F.avg("drift"), 4).alias("drift"))
        drift = float(d.first()["drift"] or 0.0)
        judged = gates(df, F.lit(drift)).withColumn("drift", F.lit(drift))
        judged.withColumn("promote", F.min("passed").over(Window.partitionBy("drift"))).write.mode("overwrite").parquet(target.format("drift"))
        df.unpersist()

    base = run_batches(stream, "drift", handle)
    return spark.read.parquet(f"{base}/drift")


def control_step(stream: DataFrame, intent) -> DataFrame:
    """Candidates per snapshot without state, then the cell's ordered state: temporal reasons, choice,
    rollback, gate. Only executed actions are recorded, arm the rollback baseline and name the audit record.

    Runs in simulated mode: records are produced, nothing is actuated.
    """
    d = governed.decide(governed.resolve_intent(stream, intent), governed.proposals(F.col("event_id")))
    listed = F.transform("cand", lambda c: F.struct(*[c[f].alias(f) for f in ("idx", "policy", "prob", "score", "safe")]))
    limit = F.greatest(F.lit(0.50), 0.78 - F.col("risk_tolerance") * 0.3)
    is_open = ~F.col("level").isin("high", "critical") & (F.col("ood") <= limit)
    return cell_stream(d, control=F.to_json(F.struct(listed.alias("cand"), is_open.alias("open"), F.col("uncertainty"))))
