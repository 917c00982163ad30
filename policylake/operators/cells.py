"""Per-cell operators: guards, forecasts, rollback, audit chains, coordination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policylake.functions.core import any_of, finite, reasons
from policylake.functions.dims import constant
from policylake.operators import governed
from policylake.operators.history import previous_value, previous_values, time_bucket
from policylake.operators.quality import gate_table
from policylake.operators.windows import forecast_columns

DAY = 86400.0
ORDER = ["epoch_s", "event_id"]
NO_HASH = "0" * 64


def first_rows_per_source(tables: list[DataFrame], n: int | None = None) -> DataFrame:
    """All tables as one; `n` is the reader's optional row cap per source.

    Up to 1,000 rows, Spark applies the rank per task before the shuffle as well.
    """
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    if n is None:
        return both
    w = Window.partitionBy("source_id").orderBy("source_row")
    return both.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def labelled_gates(df: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    missing = sorted(set([*features, "policy_label"]) - set(df.columns))
    if missing:
        raise ValueError(f"labelled table is missing columns: {missing}")
    facts = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(any_of(*[~finite(F.col(c).cast("double")) for c in features])).alias("nulls"),
        F.count_if(F.col("policy_label").isNull() | ~F.col("policy_label").isin(labels)).alias("unknown"),
    )
    return gate_table(facts, {"non_empty": F.col("n") > 0, "no_null_feature": F.col("nulls") == 0, "known_labels": F.col("unknown") == 0})


def dwell_churn_guard(df: DataFrame, dwell: float = 5.0, window: float = 60.0, max_switches: int = 6, bucket: float = 7 * DAY) -> DataFrame:
    """Reject a policy change too soon after the last event or after too many switches.

    Counts every switch between earlier events of the cell that are at most `window` seconds old.
    A row also goes to the bucket behind its own where its window reaches into it, so a cell's
    history stays cut into buckets; needs cell_id, epoch_s, event_id, policy.
    """
    width = max(bucket, window)
    own = time_bucket("epoch_s", width)
    reach = time_bucket("__end", width)
    spread = df.withColumn("__end", F.col("epoch_s") + window).withColumn("__b", F.explode(F.sequence(own, reach))).withColumn("__own", F.col("__b") == own)
    rows = Window.partitionBy("cell_id", "__b").orderBy(*ORDER)
    change = F.when(F.lag("policy").over(rows) != F.col("policy"), 1).otherwise(0)
    counted = spread.withColumn("__c", change).withColumn("__sum", F.sum("__c").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    counted = counted.withColumn("__before", F.lag("__sum").over(rows))
    # Sums only grow, so the least one in a window is that of its first event. Every row also looks from its
    # window's start: walking back in time, the last event met before it is that first event, so a row costs
    # the same however many events its window holds.
    event, start = F.struct(F.lit(0).alias("look"), F.col("epoch_s").alias("at")), F.struct(F.lit(1).alias("look"), (F.col("epoch_s") - window).alias("at"))
    both = counted.withColumn("__e", F.explode(F.when(F.col("__own"), F.array(event, start)).otherwise(F.array(event))))
    back = Window.partitionBy("cell_id", "__b").orderBy(F.desc("__e.at"), "__e.look", F.desc("__sum")).rowsBetween(Window.unboundedPreceding, 0)
    first = F.last(F.when(F.col("__e.look") == 0, F.col("__sum")), ignorenulls=True).over(back)
    h = both.withColumn("switches", F.greatest(F.lit(0), F.coalesce(F.col("__before") - first, F.lit(0)))).where("__e.look = 1")
    h = h.drop("__end", "__b", "__own", "__c", "__sum", "__before", "__e")
    h = previous_value(h, ["cell_id"], ORDER, time_bucket("epoch_s", width), F.struct("epoch_s", "policy"), "__last")
    changes = F.col("policy") != F.col("__last.policy")
    return h.withColumns(
        {
            "dwell_reject": F.coalesce(changes & (F.col("epoch_s") - F.col("__last.epoch_s") < dwell), F.lit(False)),
            "churn_reject": F.coalesce(changes & (F.col("switches") >= max_switches), F.lit(False)),
        }
    ).drop("__last")


def forecasts(df: DataFrame, value: str, horizon: int = 5, points: int = 24, bucket: float = 7 * DAY) -> DataFrame:
    """EWMA, trend and persistence forecasts from the last points of each cell."""
    h = previous_values(df, ["cell_id"], ORDER, time_bucket("epoch_s", bucket), F.col(value), points, "__h", include_current=True)
    return h.withColumns({**forecast_columns(F.col("__h"), horizon), "points": F.size("__h")}).drop("__h")


def rollback_check(df: DataFrame, armed: Column, bucket: float = 7 * DAY) -> DataFrame:
    """Compare each row with the latest armed row of the cell before it."""
    before = F.when(armed, F.struct("downlink_mbps", "packet_loss_pct", "latency_ms"))
    b = previous_value(df, ["cell_id"], ORDER, time_bucket("epoch_s", bucket), before, "__b")
    p = F.col("__b")
    drop = F.try_divide(p["downlink_mbps"] - F.col("downlink_mbps"), p["downlink_mbps"]) * 100
    slower = F.try_divide(F.col("latency_ms") - p["latency_ms"], p["latency_ms"]) * 100
    why = reasons(
        ((p["downlink_mbps"] > 0) & (drop > 15.0), "throughput"),
        (F.col("packet_loss_pct") - p["packet_loss_pct"] > 5.0, "loss"),
        ((p["latency_ms"] > 0) & (slower > 20.0), "latency"),
    )
    return b.withColumn("reasons", why).withColumn("rollback", F.size("reasons") > 0).drop("__b")


def demo_log(df: DataFrame) -> DataFrame:
    """Audit records per cell with some altered payloads and some broken links, to be verified."""
    record = F.concat_ws("|", "cell_id", F.col("event_id").cast("string"), "policy")
    log = df.select("cell_id", "epoch_s", "event_id", "policy", F.sha2(record, 256).alias("record_hash"))
    linked = previous_value(log, ["cell_id"], ORDER, time_bucket("epoch_s", 7 * DAY), F.col("record_hash"), "p")
    return linked.withColumns(
        {
            "previous_hash": F.when(F.col("event_id") % 89 == 0, "broken").otherwise(F.coalesce("p", F.lit(NO_HASH))),
            "canonical": F.concat_ws(
                "|", "cell_id", F.col("event_id").cast("string"),
                F.when(F.col("event_id") % 97 == 0, "altered").otherwise(F.col("policy")),
            ),
        }
    ).drop("p")


def verify_chain(log: DataFrame, bucket: float = 7 * DAY) -> DataFrame:
    """Count broken links and altered records per cell chain."""
    linked = previous_value(log, ["cell_id"], ORDER, time_bucket("epoch_s", bucket), F.col("record_hash"), "__p")
    expected = F.coalesce("__p", F.lit(NO_HASH))
    return linked.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("previous_hash") != expected).alias("previous_mismatch"),
        F.count_if(F.sha2("canonical", 256) != F.col("record_hash")).alias("record_mismatch"),
    )


def ring(spark: SparkSession, n: int) -> DataFrame:
    rows = [
        (f"cell-{i + 1:03d}", f"cell-{(i + d) % n + 1:03d}") for i in range(n) for d in (-1, 1)
    ]
    return constant(spark, rows, "cell_id string, neighbor_id string")


def coordinate(decisions: DataFrame, latest: DataFrame, edges: DataFrame) -> DataFrame:
    """Interference cost and approval of each cell's decision given its neighbours' state."""
    mine = decisions.select(
        "day", "cell_id", F.col("selected_policy").alias("policy"), F.col("utility_score").alias("local"),
        F.col("chosen.tx").alias("tx"), F.col("handover_failure_pct").alias("ho"),
    )
    around = latest.select("day", F.col("cell_id").alias("neighbor_id"), F.col("sinr_db").alias("n_sinr"), F.col("prb_utilization").alias("n_prb"))
    pairs = mine.join(edges, "cell_id", "left").join(around, ["day", "neighbor_id"], "left")
    sensitivity = F.greatest(F.lit(0.0), (8.0 - F.col("n_sinr")) / 18.0) + F.greatest(F.lit(0.0), (F.col("n_prb") - 0.78) * 1.8)
    cost = F.when((F.col("tx") > 0.5) & F.col("n_sinr").isNotNull(), F.col("tx") * sensitivity * 8.0)
    g = pairs.groupBy("day", "cell_id", "policy", "local", "tx", "ho").agg(
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("interference_cost"),
        F.count_if((F.col("policy") == "throughput_boost") & (F.col("n_prb") > 0.95)).alias("loaded"),
    )
    return g.withColumns(
        {
            "network_score": F.greatest(F.lit(0.0), F.col("local") - F.col("interference_cost")),
            "approved": (F.col("interference_cost") <= 12.0) & (F.col("loaded") == 0) & ~((F.col("ho") > 6.0) & (F.col("tx") < 0)),
        }
    )


def execution_outcome(df: DataFrame, policy: str) -> DataFrame:
    """Outcome record of the recommend, shadow and simulated modes."""
    chosen = F.filter(governed.policy_array(), lambda p: p["policy"] == policy)[0]
    out = df.withColumn("__k", governed.final_kpis(chosen, 1))
    mode = F.col("mode")
    return out.withColumns(
        {
            "status": F.when(mode == "recommend", "recommendation_only").when(mode == "shadow", "shadow_recorded").otherwise("simulated"),
            "attempted": mode != "recommend",
            "executed": mode == "simulated",
            "predicted_latency": F.when(mode == "simulated", F.col("__k.latency_ms")),
        }
    ).drop("__k")
