"""Queries on the slice trace: scan, identify, aggregate, transitions, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from policylake.constants import (
    CELL_COLUMNS,
    FILE_ID_COLUMNS,
    STATE_COLUMNS,
    TRACE_HEADER,
    TRAIN_SCENARIOS,
    UNSEEN_SCENARIOS,
)
from policylake.functions import features
from policylake.functions.core import action_label, action_prb, action_scheduler, rounded, uniform
from policylake.functions.dims import constant
from policylake.operators import aggregates, outcomes, quality, windows
from policylake.plans import studies
from policylake.plans.registry import query
from policylake.plans.sqltext import (
    action_sql,
    energy_sql,
    r9,
    reward_sql,
    seconds_cte,
    targets_cte,
    transitions_cte,
    u,
    with_,
)
from policylake.sources import adapters, paths, sinks, trace

_ACTION_REWARD = with_(
    transitions_cte(),
    body=f"""SELECT slice_type, action, count(*) AS support, {r9('avg(reward)', 'mean_reward')}
    FROM trans GROUP BY ALL""",
)


@query("slice_action_reward", _ACTION_REWARD)
def slice_action_reward(spark, sf):
    t = adapters.transitions(spark, sf)
    return t.groupBy("slice_type", "action").agg(
        F.count(F.lit(1)).alias("support"), rounded(F.avg("reward")).alias("mean_reward")
    )


_STATE_R9 = ", ".join(r9(c, c) for c in STATE_COLUMNS)
_NEXT_R9 = ", ".join(r9(f"next_{c}", f"next_{c}") for c in STATE_COLUMNS)


@query(
    "a1_one_second_aggregate",
    with_(seconds_cte(), body=f"SELECT episode_id, timestamp_s, slice_type, source_path, {_STATE_R9} FROM seconds"),
)
def one_second(spark, sf):
    s = adapters.seconds(spark, sf)
    return s.select("episode_id", "timestamp_s", "slice_type", "source_path",
                    *[rounded(c).alias(c) for c in STATE_COLUMNS])


@query(
    "w1_transition_builder",
    with_(
        transitions_cte(),
        body=f"""SELECT episode_id, timestamp_s, scenario, training_config, experiment, base_station,
        imsi_file, source_path, slice_type, action, {r9('reward', 'reward')}, done, split,
        {_STATE_R9}, {_NEXT_R9} FROM trans""",
    ),
)
def transition_builder(spark, sf):
    t = trace.to_transitions(adapters.seconds(spark, sf))
    return t.select(
        "episode_id", "timestamp_s", "scenario", "training_config", "experiment", "base_station",
        "imsi_file", "source_path", "slice_type", "action", rounded("reward").alias("reward"), "done",
        "split", *[rounded(c).alias(c) for c in STATE_COLUMNS],
        *[rounded(f"next_{c}").alias(f"next_{c}") for c in STATE_COLUMNS],
    )


# ---- sources -------------------------------------------------------------------------------

def _dirty_raw(spark, sf):
    """Trace rows as text under the original headers, with some unusable cells."""
    t = adapters.slice_trace(spark, sf)
    t = t.withColumns(
        {
            "slice_prb": F.when(F.col("l_partkey") % 97 == 0, "n/a").otherwise(F.col("slice_prb").cast("string")),
            "scheduler_code": F.when(F.col("l_suppkey") % 53 == 0, "7").otherwise(F.col("scheduler_code").cast("string")),
        }
    )
    return t.withColumnsRenamed({v: k for k, v in TRACE_HEADER.items()})


_DIRTY_WHERE = "l_partkey % 97 <> 0 AND l_suppkey % 53 <> 0"


@query(
    "s1_trace_scan",
    with_(
        seconds_cte(),
        body=f"""SELECT scenario, slice_id, scheduler_code, count(*) AS n, {r9('sum(slice_prb)', 'prbs')},
        {r9('sum(dl_buffer_bytes)', 'bytes')} FROM trace WHERE {_DIRTY_WHERE} GROUP BY ALL""",
    ),
)
def trace_scan(spark, sf):
    raw = _dirty_raw(spark, sf).withColumnsRenamed(TRACE_HEADER)
    return trace.clean_trace(raw).groupBy("scenario", "slice_id", "scheduler_code").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("slice_prb")).alias("prbs"),
        rounded(F.sum("dl_buffer_bytes")).alias("bytes"),
    )


_FILE = "scenario, training_config, experiment, base_station, imsi_file"


@query(
    "s2_row_cap_per_file",
    with_(
        seconds_cte(),
        body=f"""SELECT {_FILE}, timestamp_ms, l_orderkey, l_linenumber, l_partkey FROM (
        SELECT *, row_number() OVER (PARTITION BY {_FILE} ORDER BY timestamp_ms, l_orderkey, l_linenumber,
          l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM trace) WHERE rn <= 5""",
    ),
)
def row_cap(spark, sf):
    t = adapters.slice_trace(spark, sf)
    capped = trace.first_rows_per_file(t, 5, ["timestamp_ms", *adapters.TRACE_ORDER])
    return capped.select(*FILE_ID_COLUMNS, "timestamp_ms", "l_orderkey", "l_linenumber", "l_partkey")


_PATHS = """paths AS (SELECT concat_ws('/', 'slice_traffic', scenario, training_config, experiment, base_station,
  'slices_' || base_station, imsi_file || '_metrics.csv') AS path FROM trace)"""


def _paths(spark, sf):
    t = adapters.slice_trace(spark, sf)
    return t.select(
        F.concat(
            F.concat_ws("/", F.lit("slice_traffic"), *CELL_COLUMNS), F.lit("/slices_"),
            F.col("base_station"), F.lit("/"), F.col("imsi_file"), F.lit("_metrics.csv"),
        ).alias("path")
    )


@query(
    "s3_path_identifiers",
    with_(
        seconds_cte(), _PATHS,
        body="""SELECT split_part(path, '/', 2) AS scenario, split_part(path, '/', 3) AS training_config,
        split_part(path, '/', 4) AS experiment, split_part(path, '/', 5) AS base_station,
        replace(split_part(path, '/', 7), '_metrics.csv', '') AS imsi_file, count(*) AS n
        FROM paths GROUP BY ALL""",
    ),
)
def path_identifiers(spark, sf):
    files = _paths(spark, sf).groupBy("path").agg(F.count(F.lit(1)).alias("n"))  # ids once per file, not per row
    return files.select(*trace.path_ids(F.col("path")), "n").groupBy(*FILE_ID_COLUMNS).agg(F.sum("n").alias("n"))


@query(
    "s4_expected_cell_grid",
    with_(
        seconds_cte(), _PATHS,
        body="""SELECT 'slice_traffic/rome_slow_close/tr' || t || '/exp' || e || '/bs' || b || '/slices_bs' || b
          || '/ue' || i || '_metrics.csv' AS path, coalesce(n, 0) AS rows
        FROM (SELECT unnest([0, 1, 2]) AS t), (SELECT unnest([1, 2]) AS e), (SELECT unnest([1, 4]) AS b),
          (SELECT unnest([0, 1, 2]) AS i)
        LEFT JOIN (SELECT path AS p, count(*) AS n FROM paths GROUP BY ALL)
          ON p = 'slice_traffic/rome_slow_close/tr' || t || '/exp' || e || '/bs' || b || '/slices_bs' || b
          || '/ue' || i || '_metrics.csv'""",
    ),
)
def expected_grid(spark, sf):
    grid = paths.expected_paths(
        spark, "rome_slow_close", [0, 1, 2], [1, 2], {1: ["ue0", "ue1", "ue2"], 4: ["ue0", "ue1", "ue2"]}
    )
    found = _paths(spark, sf).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(found, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("rows"))


@query(
    "s5_path_filter_completeness",
    with_(
        seconds_cte(), _PATHS,
        body="""SELECT count(DISTINCT path) AS files, count(DISTINCT concat_ws('/', split_part(path, '/', 2),
          split_part(path, '/', 3), split_part(path, '/', 4), split_part(path, '/', 5))) AS cells,
          4 * 18 * 2 * 4 AS expected,
          count(DISTINCT concat_ws('/', split_part(path, '/', 2),
          split_part(path, '/', 3), split_part(path, '/', 4), split_part(path, '/', 5))) = 4 * 18 * 2 * 4 AS complete
        FROM paths""",
    ),
)
def path_filter(spark, sf):
    # written, as Spark would filter every row below the distinct
    found = sinks.staged(_paths(spark, sf).distinct(), "paths")
    kept = paths.filter_paths(
        found, [*TRAIN_SCENARIOS, *UNSEEN_SCENARIOS], range(18), [1, 2], [1, 2, 3, 4]
    )
    return paths.completeness(kept, 4 * 18 * 2 * 4)


@query("s14_file_integrity_manifest")
def file_manifest(spark, sf):
    return paths.file_manifest(spark, f"{sf}/*.parquet")


@query(
    "s16_dataset_manifest",
    with_(
        transitions_cte(),
        body="""SELECT publication_split, count(*) AS rows, count(DISTINCT episode_id) AS episodes,
        count(DISTINCT action) AS actions, count_if(slice_type = 'eMBB') AS embb_rows,
        count_if(slice_type = 'mMTC') AS mmtc_rows, count_if(slice_type = 'URLLC') AS urllc_rows,
        array_to_string(list_sort(list(DISTINCT training_config)), ',') AS training_configs,
        array_to_string(list_sort(list(DISTINCT base_station)), ',') AS base_stations,
        array_to_string(list_sort(list(DISTINCT action)), ',') AS action_names
        FROM trans GROUP BY ALL""",
    ),
)
def dataset_manifest(spark, sf):
    return sinks.dataset_manifest(adapters.transitions(spark, sf))


# ---- row-level columns ---------------------------------------------------------------------

@query(
    "p1_grant_ratio",
    with_(
        seconds_cte(),
        body=f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        {r9('''CASE WHEN requested_prbs > 0 THEN least(greatest(granted_prbs / requested_prbs, 0.0::DOUBLE), 1.0::DOUBLE)
        ELSE 1.0::DOUBLE END''', 'grant_ratio')} FROM trace""",
    ),
)
def grant(spark, sf):
    t = adapters.slice_trace(spark, sf)
    return t.select(*adapters.TRACE_ORDER[:5],
                    rounded(trace.grant_ratio("granted_prbs", "requested_prbs")).alias("grant_ratio"))


@query(
    "p2_action_label",
    with_(
        seconds_cte(),
        body=f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        {action_sql('scheduler_code + l_partkey % 2 * 2', 'slice_prb + 0.5::DOUBLE * (l_partkey % 4)')} AS action FROM trace""",
    ),
)
def label(spark, sf):
    t = adapters.slice_trace(spark, sf)
    code = F.col("scheduler_code") + F.col("l_partkey") % 2 * 2
    prb = F.col("slice_prb") + 0.5 * (F.col("l_partkey") % 4)
    return t.select(*adapters.TRACE_ORDER[:5], action_label(code, prb).alias("action"))


@query(
    "p3_action_parse",
    with_(
        transitions_cte(),
        body="""SELECT row_id, regexp_extract(action, ':prb=(\\d+)$', 1)::BIGINT AS prb,
        regexp_extract(action, '^(.*):prb=\\d+$', 1) AS scheduler FROM trans""",
    ),
)
def parse(spark, sf):
    t = adapters.transitions(spark, sf)
    return t.select("row_id", action_prb("action").alias("prb"), action_scheduler("action").alias("scheduler"))


@query(
    "p4_slice_reward",
    with_(
        seconds_cte(),
        body=f"SELECT episode_id, timestamp_s, "
             f"{r9(reward_sql('slice_type', 'dl_bitrate_mbps', 'grant_ratio', 'dl_errors_pct'), 'reward')} FROM seconds",
    ),
)
def reward(spark, sf):
    s = adapters.seconds(spark, sf)
    r = trace.slice_reward(F.col("slice_type"), F.col("dl_bitrate_mbps"), F.col("grant_ratio"), F.col("dl_errors_pct"))
    return s.select("episode_id", "timestamp_s", rounded(r).alias("reward"))


@query("p5_energy_proxy", with_(transitions_cte(), body=f"SELECT row_id, {r9(energy_sql(), 'energy')} FROM trans"))
def energy(spark, sf):
    return adapters.transitions(spark, sf).select("row_id", rounded(outcomes.energy_raw()).alias("energy"))


_TARGETS = ["sla_cost", "energy_cost", "stability_cost", "utility"]


@query(
    "p6_outcome_costs",
    with_(targets_cte(), body=f"SELECT row_id, current_action, {', '.join(r9(c, c) for c in _TARGETS)} FROM targets"),
)
def costs(spark, sf):
    t, _ = studies.targets(spark, sf)
    return t.select("row_id", "current_action", *[rounded(c).alias(c) for c in _TARGETS])


@query(
    "p26_publication_split",
    with_(
        transitions_cte(),
        body="""SELECT publication_split, shift_type, scenario, count(*) AS n FROM trans
        WHERE publication_split <> 'excluded' GROUP BY ALL""",
    ),
)
def split_counts(spark, sf):
    t = adapters.transitions(spark, sf)
    return t.groupBy("publication_split", "shift_type", "scenario").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p27_stable_uniform",
    with_(
        transitions_cte(),
        body=f"SELECT row_id, {r9(u(chr(39) + '2026' + chr(39), 'episode_id', 'timestamp_s', 'base_station'), 'u')} FROM trans",
    ),
)
def stable_uniform(spark, sf):
    t = adapters.transitions(spark, sf)
    return t.select("row_id", rounded(uniform("2026", F.col("episode_id"), F.col("timestamp_s"), F.col("base_station"))).alias("u"))


_ENC = {
    "log_buffer": "ln(1 + dl_buffer_bytes)", "log_requested": "ln(1 + requested_prbs)",
    "log_ues": "ln(1 + num_ues)", "prb_fraction": "slice_prb / 14.0::DOUBLE",
    "sched_index": "round_even(scheduler_code, 0) / 2.0::DOUBLE", "time_sin": "sin(timestamp_s / 8.0::DOUBLE)",
    "time_cos": "cos(timestamp_s / 8.0::DOUBLE)",
}


@query(
    "p28_feature_encoding",
    with_(
        transitions_cte(),
        body=f"""SELECT row_id, {', '.join(r9(v, k) for k, v in _ENC.items())},
        {', '.join(f"(slice_type = '{s}')::INT AS is_{s.lower()}" for s in ('eMBB', 'mMTC', 'URLLC'))} FROM trans""",
    ),
)
def encoding(spark, sf):
    t = adapters.transitions(spark, sf)
    return t.select("row_id", *features.encode_columns(budget=14.0))


# ---- audits --------------------------------------------------------------------------------

@query(
    "v3_transition_gates",
    with_(
        transitions_cte(),
        body="""SELECT unnest(['train_rows', 'test_rows', 'three_actions', 'episodes_disjoint',
          'held_out_actions_supported', 'finite']) AS gate,
        unnest([(SELECT count_if(split = 'train') >= 100 FROM trans), (SELECT count_if(split = 'test') >= 100 FROM trans),
          (SELECT count(DISTINCT action) >= 3 FROM trans WHERE split = 'train'),
          (SELECT count(*) = 0 FROM (SELECT episode_id FROM trans GROUP BY 1 HAVING count(DISTINCT split) > 1)),
          (SELECT count(*) = 0 FROM (SELECT DISTINCT action FROM trans WHERE split = 'test' EXCEPT
             SELECT DISTINCT action FROM trans WHERE split = 'train')),
          (SELECT count_if(NOT isfinite(reward)) = 0 FROM trans)]) AS passed""",
    ),
)
def transition_gates(spark, sf):
    return quality.transition_gates(adapters.transitions(spark, sf))


def _overlap_sql(unit: str) -> str:
    return f"""SELECT '{unit}' AS unit, a.s AS left_split, b.s AS right_split,
      (SELECT count(*) FROM (SELECT DISTINCT {unit} FROM trans WHERE publication_split = a.s INTERSECT
        SELECT DISTINCT {unit} FROM trans WHERE publication_split = b.s)) AS overlap
      FROM sp a JOIN sp b ON a.s < b.s"""


@query(
    "v4_episode_leakage",
    with_(
        transitions_cte(), "sp AS (SELECT unnest(['train', 'validation', 'test_seen', 'test_unseen']) AS s)",
        body=_overlap_sql("episode_id") + " UNION ALL " + _overlap_sql("training_config"),
    ),
)
def leakage(spark, sf):
    t = adapters.transitions(spark, sf)
    splits = ["train", "validation", "test_seen", "test_unseen"]
    parts = [
        quality.overlap_audit(t, u_, "publication_split", splits).withColumn("unit", F.lit(u_))
        for u_ in ("episode_id", "training_config")
    ]
    return parts[0].unionByName(parts[1])


_PLACED = "slice_type || '|' || scenario || '|' || base_station || '|' || imsi_file || '|' || action"


@query(
    "v5_unsupported_actions",
    with_(
        transitions_cte(),
        body=f"""SELECT DISTINCT publication_split, {_PLACED} AS action FROM trans WHERE publication_split <> 'train'
        AND {_PLACED} NOT IN (SELECT {_PLACED} FROM trans WHERE publication_split = 'train')""",
    ),
)
def unsupported(spark, sf):
    """Actions of every held-out split that training never took at the same place."""
    t = adapters.transitions(spark, sf).withColumn("action", F.concat_ws("|", "slice_type", "scenario", "base_station", "imsi_file", "action"))
    return quality.unsupported_actions(t.filter("publication_split = 'train'"), t.filter("publication_split <> 'train'"), ["publication_split"])


@query(
    "v6_transition_audit",
    with_(
        transitions_cte(),
        body=f"""SELECT scenario, training_config, experiment, base_station, count(*) AS rows,
        count(DISTINCT episode_id) AS episodes, count(DISTINCT round_even(scheduler_code, 0)) AS unique_scheduler,
        count(DISTINCT round_even(slice_prb, 0)) AS unique_prb,
        count_if(round_even(scheduler_code, 0) <> round_even(next_scheduler_code, 0)) AS scheduler_change_rows,
        count_if(round_even(slice_prb, 0) <> round_even(next_slice_prb, 0)) AS prb_change_rows,
        count_if({action_sql('scheduler_code', 'slice_prb')} <> action) AS joint_action_change_rows,
        {r9(f"avg(CASE WHEN {action_sql('scheduler_code', 'slice_prb')} <> action THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)",
            'joint_action_change_rate')} FROM trans GROUP BY ALL""",
    ),
)
def transition_audit(spark, sf):
    a = quality.transition_audit(adapters.transitions(spark, sf))
    return a.withColumn("joint_action_change_rate", rounded("joint_action_change_rate"))


_RECORDED = f"""rec AS (SELECT *, concat_ws('/', scenario, training_config, experiment, base_station) AS ep FROM trans),
rec2 AS (SELECT *, lag(action) OVER w AS pa, lag(timestamp_s) OVER w AS pt FROM rec
  WINDOW w AS (PARTITION BY ep, slice_type ORDER BY timestamp_s, imsi_file))"""


def _recorded(spark, sf):
    t = adapters.transitions(spark, sf, multi_ue=True).withColumn("episode_id", F.concat_ws("/", *CELL_COLUMNS))
    return quality.recorded_action_changes(t, ["imsi_file"], bucket_seconds=8)


@query(
    "v7_recorded_action_audit",
    with_(
        transitions_cte(True), _RECORDED,
        body="""SELECT scenario, training_config, experiment, base_station, slice_type, count(*) AS rows,
        count(DISTINCT ep) AS episodes, count(DISTINCT action) AS distinct_actions_across_episodes,
        count_if(action <> pa AND timestamp_s > pt) AS valid_adjacent_change_rows,
        count_if(NOT timestamp_s > pt) AS timestamp_tie_rows FROM rec2 GROUP BY ALL""",
    ),
)
def recorded_audit(spark, sf):
    return quality.recorded_action_audit(_recorded(spark, sf))


@query(
    "v7_recorded_action_summary",
    with_(
        transitions_cte(True), _RECORDED,
        body="""SELECT sum(n)::BIGINT AS rows, count(*) AS episodes_by_slice, count_if(k > 1) AS episodes_with_multiple_recorded_actions,
        sum(c)::BIGINT AS adjacent_observed_action_changes, sum(t)::BIGINT AS timestamp_tie_rows FROM (
        SELECT ep, slice_type, count(*) AS n, count(DISTINCT action) AS k,
        count_if(action <> pa AND timestamp_s > pt) AS c, count_if(NOT timestamp_s > pt) AS t
        FROM rec2 GROUP BY 1, 2)""",
    ),
)
def recorded_summary(spark, sf):
    return quality.recorded_action_summary(_recorded(spark, sf))


# ---- plain aggregates and windows ----------------------------------------------------------

@query(
    "a2_value_counts",
    with_(
        transitions_cte(),
        body="""SELECT 'action' AS kind, action AS value, count(*) AS n FROM trans GROUP BY 2
        UNION ALL SELECT 'slice_type', slice_type, count(*) FROM trans GROUP BY 2
        UNION ALL SELECT 'scenario', scenario, count(*) FROM trans GROUP BY 2""",
    ),
)
def value_counts(spark, sf):
    return aggregates.value_counts(adapters.transitions(spark, sf), ["action", "slice_type", "scenario"])


@query("a3_energy_scale", with_(targets_cte(), body=f"SELECT {r9('lo', 'low')}, {r9('hi', 'high')} FROM scale"))
def energy_scale(spark, sf):
    t = adapters.transitions(spark, sf)
    low, high = outcomes.fit_energy_scale(t.filter("publication_split = 'train'"))
    return constant(spark, [(low, high)], "low double, high double").select(
        rounded("low").alias("low"), rounded("high").alias("high")
    )


_RETURN = " + ".join(
    f"0.97::DOUBLE ** {k} * coalesce(lead(reward, {k}) OVER w, 0)" if k else "reward" for k in range(5)
)


@query(
    "w2_discounted_return",
    with_(
        transitions_cte(),
        body=f"""SELECT row_id, {r9(_RETURN, 'discounted_return')} FROM trans
        WINDOW w AS (PARTITION BY episode_id ORDER BY timestamp_s)""",
    ),
)
def discounted(spark, sf):
    t = windows.discounted_return(adapters.transitions(spark, sf), gamma=0.97, horizon=5)
    return t.select("row_id", rounded("discounted_return").alias("discounted_return"))


@query(
    "w3_replay_switches",
    with_(
        transitions_cte(),
        body=f"""SELECT publication_split, count(*) AS rows, count(pa) AS replay_transitions,
        count_if(pa <> action) AS switches, {r9('count_if(pa <> action) / greatest(count(pa), 1)::DOUBLE', 'switch_rate')}
        FROM (SELECT *, lag(action) OVER (PARTITION BY episode_id ORDER BY timestamp_s) AS pa FROM trans) GROUP BY ALL""",
    ),
)
def replay(spark, sf):
    t = windows.replay_switches(adapters.transitions(spark, sf), "action")
    return t.groupBy("publication_split").agg(
        F.count(F.lit(1)).alias("rows"), F.count("previous_action").alias("replay_transitions"),
        F.count_if("switch").alias("switches"),
        rounded(F.count_if("switch") / F.greatest(F.count("previous_action"), F.lit(1))).alias("switch_rate"),
    )


@query(
    "w10_systematic_sample",
    with_(
        transitions_cte(),
        body="""SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY slice_type, action
          ORDER BY episode_id, timestamp_s) - 1 AS p, count(*) OVER (PARTITION BY slice_type, action) AS n FROM trans)
        WHERE n <= 20 OR p IN (SELECT (i * (n - 1)) // 19 FROM range(20) t(i))""",
    ),
)
def systematic(spark, sf):
    t = adapters.transitions(spark, sf)
    return windows.systematic_sample(t, ["slice_type", "action"], 20).select("row_id")


@query(
    "w16_within_episode_variation",
    with_(
        transitions_cte(),
        body="""SELECT episode_id, count_if(action <> pa) AS changes, count(*) AS records FROM (
        SELECT *, lag(action) OVER (PARTITION BY episode_id ORDER BY timestamp_s) AS pa FROM trans) GROUP BY ALL""",
    ),
)
def variation(spark, sf):
    t = windows.replay_switches(adapters.transitions(spark, sf), "action")
    return t.groupBy("episode_id").agg(F.count_if("switch").alias("changes"), F.count(F.lit(1)).alias("records"))


@query(
    "o1_stable_sort",
    with_(
        transitions_cte(),
        body="""SELECT row_id, scenario, training_config, experiment, base_station, slice_type, timestamp_s FROM trans
        ORDER BY scenario, training_config, experiment, base_station, slice_type, timestamp_s""",
    ),
)
def stable_sort(spark, sf):
    keys = [*CELL_COLUMNS, "slice_type", "timestamp_s"]
    return adapters.transitions(spark, sf).select("row_id", *keys).orderBy(*keys)


@query(
    "o5_union_tables",
    with_(
        transitions_cte(),
        body=f"""SELECT source, count(*) AS n, {r9('sum(reward)', 'reward_sum')} FROM (
        SELECT 'fold_a' AS source, reward FROM trans WHERE experiment = 'exp1'
        UNION ALL SELECT 'fold_b', reward FROM trans WHERE experiment = 'exp2'
        UNION ALL SELECT 'all', reward FROM trans) GROUP BY ALL""",
    ),
)
def union_tables(spark, sf):
    t = adapters.transitions(spark, sf)
    parts = {"fold_a": t.filter("experiment = 'exp1'"), "fold_b": t.filter("experiment = 'exp2'"), "all": t}
    tagged = [d.select(F.lit(k).alias("source"), "reward") for k, d in parts.items()]
    out = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("reward")).alias("reward_sum"))


_SUPPORT = "SELECT DISTINCT scenario, training_config, base_station, imsi_file, slice_type, action FROM trans WHERE"


@query(
    "o6_intersect_supports",
    with_(
        transitions_cte(),
        body=f"{_SUPPORT} experiment = 'exp1' INTERSECT {_SUPPORT} experiment = 'exp2'",
    ),
)
def intersect_supports(spark, sf):
    t = adapters.transitions(spark, sf).select("scenario", "training_config", "base_station", "imsi_file", "slice_type", "action", "experiment")
    keys = ["scenario", "training_config", "base_station", "imsi_file", "slice_type", "action"]
    return t.filter("experiment = 'exp1'").select(*keys).intersect(
        t.filter("experiment = 'exp2'").select(*keys)
    )


@query(
    "o7_except_supports",
    with_(
        transitions_cte(),
        body=f"{_SUPPORT} experiment = 'exp1' EXCEPT {_SUPPORT} experiment = 'exp2'",
    ),
)
def except_supports(spark, sf):
    t = adapters.transitions(spark, sf).select("scenario", "training_config", "base_station", "imsi_file", "slice_type", "action", "experiment")
    keys = ["scenario", "training_config", "base_station", "imsi_file", "slice_type", "action"]
    return t.filter("experiment = 'exp1'").select(*keys).subtract(
        t.filter("experiment = 'exp2'").select(*keys)
    )
