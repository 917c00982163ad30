"""Slice-trace source: scan, clean, identify, aggregate to seconds, build transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policylake.constants import (
    CELL_COLUMNS,
    FILE_ID_COLUMNS,
    MEAN_COLUMNS,
    SCHEDULERS,
    SHIFT_TYPES,
    SLICES,
    STATE_COLUMNS,
    SUM_COLUMNS,
    TEST_CONFIGS,
    TRACE_HEADER,
    TRAIN_CONFIGS,
    TRAIN_SCENARIOS,
    UNSEEN_SCENARIOS,
    VALIDATION_CONFIGS,
)
from policylake.functions.core import (
    action_label,
    clip,
    decision_list,
    finite_or_null,
    ratio,
    slice_name,
)
from policylake.operators.history import previous_values, time_bucket

RAW_SCHEMA = T.StructType([T.StructField(h, T.StringType()) for h in TRACE_HEADER])
SECONDS_PER_BUCKET = 3600.0


def scan_trace_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw trace CSV files with the ids taken from each file's path."""
    raw = spark.read.schema(RAW_SCHEMA).option("header", True).option("enforceSchema", False).csv(paths)
    relative = F.regexp_extract(F.col("_metadata.file_path"), r"(slice_traffic/.*)$", 1)
    named = raw.select("*", relative.alias("source_path")).withColumnsRenamed(TRACE_HEADER)
    return clean_trace(named.select("*", *path_ids(F.col("source_path"))))


def path_ids(path: Column) -> list[Column]:
    """Ids from `slice_traffic/<scenario>/<config>/<exp>/<bs>/slices_<bs>/<imsi>_metrics.csv`."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    checked = F.when(depth >= 7, parts).otherwise(
        F.raise_error(F.concat(F.lit("unexpected trace path: "), path)).cast("array<string>")
    )
    named = [
        F.element_at(checked, i + 2).alias(n) for i, n in enumerate(CELL_COLUMNS)
    ]
    stem = F.regexp_replace(F.element_at(checked, -1), r"\.[^.]*$", "")
    return [*named, F.regexp_replace(stem, r"_metrics$", "").alias("imsi_file")]


def clean_trace(df: DataFrame) -> DataFrame:
    """Coerce counters to numbers, drop rows without the key counters or with unknown codes."""
    numeric = list(TRACE_HEADER.values())
    missing = sorted(set(numeric) - set(df.columns))
    if missing:
        raise ValueError(f"trace is missing columns: {', '.join(missing)}")
    typed = df.withColumns({c: F.col(c).try_cast("double") for c in numeric})
    return typed.dropna(subset=["timestamp_ms", "slice_id", "slice_prb", "scheduler_code"]).filter(
        F.col("slice_id").isin([float(k) for k in SLICES])
        & F.col("scheduler_code").isin([float(k) for k in SCHEDULERS])
    )


def first_rows_per_file(df: DataFrame, n: int | None, order: list[str]) -> DataFrame:
    """Row cap per file, an option of the reader; without one every row is read."""
    if n is None:
        return df
    w = Window.partitionBy(*FILE_ID_COLUMNS).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def grant_ratio(granted: Column | str, requested: Column | str) -> Column:
    """granted / requested in [0, 1]; one where nothing was requested."""
    g, r = (F.col(c) if isinstance(c, str) else c for c in (granted, requested))
    return clip(F.when(r > 0, ratio(g, r)).otherwise(1.0), 0.0, 1.0)


def episode_id() -> Column:
    return F.concat_ws("/", *FILE_ID_COLUMNS)


def to_seconds(trace: DataFrame) -> DataFrame:
    """250 ms counters to one row per file and second.

    Means for the KPIs, smallest mode for slice, PRBs and scheduler, sums for requested and
    granted PRBs; non-finite aggregates become zero. All aggregates combine map-side.
    """
    keyed = trace.withColumn("timestamp_s", F.floor(F.col("timestamp_ms") / 1000).cast("long"))
    aggs = [F.avg(c).alias(c) for c in MEAN_COLUMNS]
    aggs += [F.mode(c, True).alias(c) for c in ("slice_id", "slice_prb", "scheduler_code")]
    aggs += [F.sum(c).alias(c) for c in SUM_COLUMNS]
    out = keyed.groupBy(*FILE_ID_COLUMNS, "timestamp_s").agg(*aggs)
    measured = [*MEAN_COLUMNS, "slice_id", "slice_prb", "scheduler_code", *SUM_COLUMNS]
    out = out.withColumns({c: F.coalesce(finite_or_null(c), F.lit(0.0)) for c in measured})
    return out.withColumns(
        {
            "grant_ratio": grant_ratio("granted_prbs", "requested_prbs"),
            "slice_type": slice_name("slice_id"),
            "episode_id": episode_id(),
            "source_path": F.concat(
                F.concat_ws("/", F.lit("slice_traffic"), *CELL_COLUMNS),
                F.lit("/slices_"), F.col("base_station"), F.lit("/"), F.col("imsi_file"),
                F.lit("_metrics.csv"),
            ),
        }
    )


def slice_reward(slice_type: Column, dl_mbps: Column, grant: Column, errors_pct: Column) -> Column:
    objective = decision_list(
        [
            (slice_type == "eMBB", clip(dl_mbps / 1.0, 0.0, 1.0)),
            (slice_type == "mMTC", clip(dl_mbps / 0.03, 0.0, 1.0)),
        ],
        clip(grant, 0.0, 1.0),
    )
    return clip(objective - 0.25 * clip(errors_pct / 100.0, 0.0, 1.0), -0.25, 1.0)


def to_transitions(seconds: DataFrame, bucket_seconds: float = SECONDS_PER_BUCKET) -> DataFrame:
    """(state, action, reward, next state) rows of consecutive seconds of an episode.

    Action and reward come from the next row; the last row of an episode has no successor and
    is dropped, and `done` marks the last row kept.
    """
    follow = F.struct(F.col("slice_type"), *[F.col(c) for c in STATE_COLUMNS])
    ahead = previous_values(
        seconds, ["episode_id"], ["timestamp_s"], time_bucket("timestamp_s", bucket_seconds),
        follow, 2, "__next", following=True,
    ).filter(F.size("__next") >= 1)
    nxt = F.col("__next")[0]
    rows = ahead.select(
        "episode_id", "timestamp_s", *FILE_ID_COLUMNS, "source_path", "slice_type", *STATE_COLUMNS,
        action_label(nxt["scheduler_code"], nxt["slice_prb"]).alias("action"),
        slice_reward(
            nxt["slice_type"], nxt["dl_bitrate_mbps"], nxt["grant_ratio"], nxt["dl_errors_pct"]
        ).alias("reward"),
        *[nxt[c].alias(f"next_{c}") for c in STATE_COLUMNS],
        (F.size("__next") < 2).alias("done"),
    )
    return rows.withColumn("split", F.when(F.col("experiment") == "exp1", "train").otherwise("test"))


def config_number(c: Column | str = "training_config") -> Column:
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "^tr", "").cast("int")


def publication_split(scenario: str = "scenario", config: str = "training_config") -> Column:
    seen = F.col(scenario).isin(TRAIN_SCENARIOS)
    n = config_number(config)
    return decision_list(
        [
            (F.col(scenario).isin(UNSEEN_SCENARIOS), "test_unseen"),
            (seen & n.isin(TEST_CONFIGS), "test_seen"),
            (seen & n.isin(VALIDATION_CONFIGS), "validation"),
            (seen & n.isin(TRAIN_CONFIGS), "train"),
        ],
        "excluded",
    )


def with_publication_split(df: DataFrame) -> DataFrame:
    """Add the split and the kind of shift; rows of no split are dropped."""
    shift = decision_list(
        [(F.col("scenario") == k, v) for k, v in SHIFT_TYPES.items()], "seen_condition"
    )
    return (
        df.withColumn("publication_split", publication_split())
        .withColumn("shift_type", shift)
        .filter(F.col("publication_split") != "excluded")
    )
