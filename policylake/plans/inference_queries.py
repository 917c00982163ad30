"""Queries of resampling inference, OOD metrics, fold merges and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from policylake.constants import CLUSTER_COLUMNS
from policylake.functions.core import cond_rate, first_of, rounded, uniform
from policylake.functions.dims import constant, freeze
from policylake.operators import aggregates, calibration, gates, inference, selection
from policylake.plans import decision_queries as dq
from policylake.plans import studies
from policylake.plans.registry import query
from policylake.plans.sqltext import OOD_SCORE_SQL, candidates_cte, r9, ranked_cte, score_sql, state_cte, targets_cte, transitions_cte, u, utility_sql, with_
from policylake.sources import adapters, sinks

B, P = 1000, 2000


def infer_ctes(source: str, seed: str, exact: bool, tag: str = "") -> str:
    """CTEs from `source`(unit, delta) to `inf<tag>` (one row)."""
    t = tag
    null = (
        f"""nul{t} AS (SELECT m AS p, avg(CASE WHEN (m >> idx) & 1 = 1 THEN delta ELSE -delta END) AS mu FROM un{t}, range((SELECT 1::BIGINT << count(*)::INT FROM un{t})) r(m) GROUP BY m)"""
        if exact else
        f"""nul{t} AS (SELECT p, avg(CASE WHEN {u(f"'{seed}'", "'sign'", 'p', 'idx')} < 0.5::DOUBLE THEN -delta ELSE delta END) AS mu FROM un{t}, range({P}) r(p) GROUP BY p)"""
    )
    pv = (
        f"(SELECT count_if(abs(mu) >= abs(o) - 1e-12) / count(*) FROM nul{t})" if exact
        else f"(SELECT (count_if(abs(mu) >= abs(o) - 1e-12) + 1) / ({P} + 1) FROM nul{t})"
    )
    return f"""un{t} AS (SELECT unit, delta, row_number() OVER (ORDER BY md5(unit)) - 1 AS idx, count(*) OVER () AS n FROM {source}),
bd{t} AS (SELECT b, floor(({u(f"'{seed}'", "'boot'", 'b', 'idx')}) * n)::BIGINT AS j FROM un{t}, range({B}) r(b)),
bm{t} AS (SELECT b, avg(delta) AS m FROM bd{t} JOIN un{t} ON idx = j GROUP BY b),
{null},
ob{t} AS (SELECT count(*) AS units, avg(delta) AS o, stddev_samp(delta) AS sd, avg((delta > 0)::INT) AS win FROM un{t}),
inf{t} AS (SELECT units, o AS mean_delta, CASE WHEN sd > 1e-12 THEN o / sd ELSE 0 END AS cohens_dz, win AS win_rate,
  (SELECT quantile_cont(m, 0.025) FROM bm{t}) AS ci_low, (SELECT quantile_cont(m, 0.975) FROM bm{t}) AS ci_high, {pv} AS p_value,
  {f'(SELECT count(*) FROM nul{t})' if exact else f'{P}::BIGINT'} AS permutations, '{'exact' if exact else 'monte_carlo'}' AS method FROM ob{t})"""


_NUM = ["mean_delta", "cohens_dz", "win_rate", "ci_low", "ci_high", "p_value"]
_INF = "units, " + ", ".join(r9(c, c) for c in _NUM) + ", permutations, method"


def tidy(df, *extra):
    return df.select(*extra, "units", *[rounded(c).alias(c) for c in _NUM], "permutations", "method")


_D4 = (dq.hysteresis_ctes("h", dq._SAFE, "0.65", "0.02::DOUBLE", score_sql()), dq._SCORED)


def _pair_query(name: str, unit_sql: str, unit_cols: list[str], seed: str, exact: bool = False):
    @query(
        name,
        with_(candidates_cte(), *_D4, f"dd AS (SELECT {unit_sql} AS unit, avg(e_utility) - avg(utility) AS delta FROM d4 GROUP BY 1)",
              infer_ctes("dd", seed, exact), body=f"SELECT {_INF} FROM inf"),
    )
    def run(spark, sf):
        s = dq.scored_selection(spark, sf).select(*unit_cols, "e_utility", "utility")
        d = s.groupBy(F.concat_ws("/", *unit_cols).alias("unit")).agg((F.avg("e_utility") - F.avg("utility")).alias("delta"))
        return tidy(inference.paired_inference(d, samples=B, permutations=P, seed=seed))

    return run


_pair_query("r1_episode_bootstrap_permutation", "episode_id", ["episode_id"], "r1")
_pair_query("r2_group_exact_permutation", "concat_ws('/', scenario, experiment)", ["scenario", "experiment"], "r2", exact=True)
_pair_query("r6_paired_bootstrap", "concat_ws('/', scenario, training_config, experiment)", CLUSTER_COLUMNS, "r6")


def _estimand_sql(i: int, name: str) -> str:
    den, num = inference.ESTIMANDS[name]
    return f"es{i} AS (SELECT concat_ws('/', scenario, training_config, experiment) AS unit, ({num}) / {den} AS delta FROM clusters WHERE {den} > 0)"


@query(
    "r3_cluster_inference",
    with_(
        candidates_cte(), dq.ACCOUNTING_SQL,
        *[x for i, e in enumerate(inference.ESTIMANDS) for x in (_estimand_sql(i, e), infer_ctes(f"es{i}", "r3", False, str(i)))],
        body=" UNION ALL ".join(
            f"SELECT '{e}' AS estimand, {_INF}, {r9(f'(SELECT sum({inference.ESTIMANDS[e][0]}) / sum(rows) FROM clusters)', 'paired_row_coverage')} FROM inf{i}"
            for i, e in enumerate(inference.ESTIMANDS)
        ),
    ),
)
def cluster_inference(spark, sf):
    clusters = freeze(aggregates.cluster_accounting(dq.accounting_rows(spark, sf)))
    parts = [inference.cluster_inference(clusters, e, samples=B, permutations=P, seed="r3") for e in inference.ESTIMANDS]
    out = [tidy(p, "estimand", rounded("paired_row_coverage").alias("paired_row_coverage")) for p in parts]
    return reduce(lambda a, b: a.unionByName(b), out)


_CONTROLLERS = {"greedy_q": "q", "score": score_sql(), "cautious": "-unc"}
_CTRL = [ranked_cte(f"k{i}", "cand", "true", v) for i, v in enumerate(_CONTROLLERS.values())]


def _controller_episodes(spark, sf):
    """Mean evaluator utility per episode of three simple controllers and the logged policy."""
    from policylake.operators import candidates

    rows, _ = studies.candidate_rows(spark, sf, studies.POLICY_FIELDS + studies.EVALUATOR_FIELDS)
    s = candidates.with_scores(rows, dq.CFG)
    values = {"greedy_q": lambda c: c["q"], "score": lambda c: c["score"], "cautious": lambda c: -c["unc"]}
    for name, v in values.items():
        s = s.withColumn(name, candidates.best(F.col("cand"), v))
    util = {n: selection.outcome_utility(F.col(n), dq.CFG, "e_") for n in values}
    return s.select("episode_id", "scenario", "publication_split", F.col("utility").alias("logged"), *[x.alias(n) for n, x in util.items()],
                    *[F.col(f"{n}.e_sla").alias(f"{n}_sla") for n in values])


_CTRL_ROWS = "kk AS (SELECT r.episode_id, r.scenario, r.publication_split, r.utility AS logged, " + ", ".join(
    f"{utility_sql(f'k{i}.e_')} AS {n}, k{i}.e_sla AS {n}_sla" for i, n in enumerate(_CONTROLLERS)
) + " FROM rws r " + " ".join(f"JOIN k{i} ON k{i}.row_id = r.row_id" for i in range(3)) + ")"


@query(
    "r5_matched_tests_with_holm",
    with_(
        candidates_cte(), *_CTRL, _CTRL_ROWS,
        *[x for i, n in enumerate(_CONTROLLERS) for x in (
            f"dk{i} AS (SELECT episode_id AS unit, avg({n}) - avg(logged) AS delta FROM kk WHERE publication_split = 'test_seen' GROUP BY 1)",
            infer_ctes(f"dk{i}", f"r5{n}", False, str(i)))],
        "cmp AS (" + " UNION ALL ".join(f"SELECT '{n}' AS controller, * FROM inf{i}" for i, n in enumerate(_CONTROLLERS)) + ")",
        body=f"""SELECT controller, {_INF}, {r9('least(1.0::DOUBLE, max((3 - rk + 1) * p_value) OVER (ORDER BY rk))', 'holm_p')} FROM
        (SELECT *, row_number() OVER (ORDER BY p_value, controller) AS rk FROM cmp)""",
    ),
)
def matched_tests(spark, sf):
    e = _controller_episodes(spark, sf).filter("publication_split = 'test_seen'")
    agg = freeze(e.groupBy(F.col("episode_id").alias("unit")).agg(
        *[(F.avg(n) - F.avg("logged")).alias(n) for n in _CONTROLLERS]))
    parts = [
        inference.paired_inference(agg.select("unit", F.col(n).alias("delta")), samples=B, permutations=P, seed=f"r5{n}")
        .withColumn("controller", F.lit(n)) for n in _CONTROLLERS
    ]
    out = inference.holm(reduce(lambda a, b: a.unionByName(b), parts), "p_value", "controller")
    return tidy(out, "controller", rounded("holm_p").alias("holm_p"))


@query(
    "w14_holm_adjustment",
    with_(
        transitions_cte(),
        f"p AS (SELECT slice_type || '|' || action AS comparison, avg(reward) * 0.02::DOUBLE * {u('slice_type', 'action')} AS p_value FROM trans GROUP BY slice_type, action)",
        body=f"SELECT comparison, {r9('p_value', 'p_value')}, {r9('least(1.0::DOUBLE, max((36 - rk + 1) * p_value) OVER (ORDER BY rk))', 'holm_p')} FROM (SELECT *, row_number() OVER (ORDER BY p_value, comparison) AS rk FROM p)",
    ),
)
def holm(spark, sf):
    t = adapters.prepared(spark, sf)
    p = t.groupBy("slice_type", "action").agg(F.avg("reward").alias("r")).select(
        F.concat_ws("|", "slice_type", "action").alias("comparison"),
        (F.col("r") * 0.02 * uniform(F.col("slice_type"), F.col("action"))).alias("p_value"),
    )
    return inference.holm(p, "p_value", "comparison").select("comparison", rounded("p_value").alias("p_value"), rounded("holm_p").alias("holm_p"))


@query(
    "a27_controller_aggregate",
    with_(
        candidates_cte(), *_CTRL, _CTRL_ROWS,
        body=" UNION ALL ".join(
            f"""SELECT '{n}' AS policy, publication_split, {r9(f'avg({n})', 'mean_utility')}, {r9(f'avg(({n}_sla > 0.45)::INT)', 'sla_rate')},
            {r9(f'avg({n}) - 2 * greatest(0.0::DOUBLE, avg(({n}_sla > 0.45)::INT) - 0.3::DOUBLE)', 'criterion')} FROM kk GROUP BY publication_split""" for n in _CONTROLLERS),
    ),
)
def controllers(spark, sf):
    e = _controller_episodes(spark, sf)
    long = e.select("publication_split", F.inline(F.array(*[
        F.struct(F.lit(n).alias("policy"), F.col(n).alias("value"), F.col(f"{n}_sla").alias("sla")) for n in _CONTROLLERS])))
    rate = cond_rate(F.col("sla") > 0.45)
    return long.groupBy("policy", "publication_split").agg(
        rounded(F.avg("value")).alias("mean_utility"), rounded(rate).alias("sla_rate"),
        rounded(F.avg("value") - 2 * F.greatest(F.lit(0.0), rate - 0.3)).alias("criterion"),
    )


_WITHOUT_SWITCH_COST = (
    ranked_cte("b2", "cand", "sup AND sla <= 0.45 AND unc <= 0.5", score_sql()),
    f"""ref2 AS (SELECT r.scenario, r.training_config, r.experiment, count(*) AS rows, count(b2.idx) AS accepted, sum(CASE WHEN b2.idx IS NULL THEN -0.12::DOUBLE ELSE {utility_sql('b2.e_')} END) AS penalized_sum
        FROM rws r LEFT JOIN b2 USING (row_id) GROUP BY 1, 2, 3)""",
)


def _two_policies(spark, sf):
    """Cluster tables of the re-ranked policy with and without a cost of switching."""
    from policylake.operators import accounting

    rows, _ = dq._modes_rows(spark, sf, studies.EVALUATOR_FIELDS)
    return [freeze(aggregates.cluster_accounting(accounting.decision_values(selection.rerank(rows, switch_cost=c), dq.CFG))) for c in (0.01, 0.0)]


@query(
    "r7_policy_vs_policy",
    with_(
        candidates_cte(), dq.ACCOUNTING_SQL,
        *_WITHOUT_SWITCH_COST[:1],
        *_WITHOUT_SWITCH_COST[1:],
        "dd AS (SELECT concat_ws('/', c.scenario, c.training_config, c.experiment) AS unit, (c.penalized_sum - f.penalized_sum) / c.rows AS delta, c.accepted = f.accepted AS same FROM clusters c FULL JOIN ref2 f ON c.scenario = f.scenario AND c.training_config = f.training_config AND c.experiment = f.experiment)",
        infer_ctes("dd", "r7", False),
        body=f"SELECT {_INF}, (SELECT bool_and(same) FROM dd) AS penalty_cancels FROM inf",
    ),
)
def policy_vs_policy(spark, sf):
    tables = _two_policies(spark, sf)
    joined = freeze(inference.aligned_clusters(tables[0], tables[1], CLUSTER_COLUMNS))
    d = joined.select(F.concat_ws("/", *CLUSTER_COLUMNS).alias("unit"), ((F.col("a_sum") - F.col("b_sum")) / F.col("a_rows")).alias("delta"))
    same = joined.agg(F.min(F.col("a_accepted") == F.col("b_accepted")).alias("s"))
    return tidy(inference.paired_inference(d, samples=B, permutations=P, seed="r7"), same.scalar().alias("penalty_cancels"))


@query(
    "j7_full_outer_clusters",
    with_(
        candidates_cte(), dq.ACCOUNTING_SQL, *_WITHOUT_SWITCH_COST,
        body=f"SELECT scenario, training_config, experiment, c.rows AS a_rows, f.rows AS b_rows, {r9('c.penalized_sum', 'a_sum')}, {r9('f.penalized_sum', 'b_sum')} FROM clusters c FULL JOIN ref2 f USING (scenario, training_config, experiment)",
    ),
)
def full_outer(spark, sf):
    """Clusters of the policy that pays for switches beside those of the one that does not."""
    j = inference.aligned_clusters(*_two_policies(spark, sf), CLUSTER_COLUMNS)
    return j.select(*CLUSTER_COLUMNS, "a_rows", "b_rows", rounded("a_sum").alias("a_sum"), rounded("b_sum").alias("b_sum"))


# ---- OOD metrics and conformal p-values ----------------------------------------------------

_OODS = f"""os AS (SELECT scenario, publication_split = 'test_unseen' AS positive, round({OOD_SCORE_SQL}, 4) AS score
  FROM tb, far WHERE publication_split IN ('test_seen', 'test_unseen'))"""


def _ood_scores(spark, sf):
    """Context distance scored by the fitted model; the split is the label only."""
    t, model, _ = studies.fitted(spark, sf)
    held = t.filter("publication_split IN ('test_seen', 'test_unseen')")
    return held.select("scenario", (F.col("publication_split") == "test_unseen").alias("positive"), F.round(model.ood(), 4).alias("score"))


@query(
    "a15_ood_detection",
    with_(
        state_cte(), _OODS,
        "k AS (SELECT score, count_if(positive) AS tp, count_if(NOT positive) AS fp FROM os GROUP BY 1)",
        "r AS (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf, (SELECT count_if(positive) FROM os) AS P, (SELECT count_if(NOT positive) FROM os) AS N FROM k WINDOW w AS (ORDER BY score DESC))",
        body=f"""SELECT {r9('sum(fp * (ct - tp + tp / 2.0::DOUBLE)) / (max(P) * max(N))', 'auroc')}, {r9('sum(tp * (ct / (ct + cf))) / max(P)', 'auprc')},
        {r9('min(CASE WHEN ct / P >= 0.95 THEN cf / N END)', 'fpr_at_95_tpr')} FROM r""",
    ),
)
def ood_detection(spark, sf):
    m = inference.rank_metrics(_ood_scores(spark, sf), [])
    return m.select(*[rounded(c).alias(c) for c in ("auroc", "auprc", "fpr_at_95_tpr")])


@query(
    "a15_threshold_sweep",
    with_(
        state_cte(), _OODS,
        body=f"""SELECT round(0.30::DOUBLE + i * 0.05::DOUBLE, 2) AS threshold, {r9('avg(CASE WHEN NOT positive THEN (score > round(0.30::DOUBLE + i * 0.05::DOUBLE, 2))::INT END)', 'seen_false_positive_rate')},
        {r9('avg(CASE WHEN positive THEN (score > round(0.30::DOUBLE + i * 0.05::DOUBLE, 2))::INT END)', 'unseen_true_positive_rate')} FROM os, range(11) t(i) GROUP BY i""",
    ),
)
def threshold_sweep(spark, sf):
    s = _ood_scores(spark, sf)
    levels = [round(0.30 + 0.05 * i, 2) for i in range(11)]
    rates = s.agg(*[
        F.struct(F.lit(v).alias("threshold"),
                 rounded(F.avg(F.when(~F.col("positive"), F.when(F.col("score") > v, 1.0).otherwise(0.0)))).alias("seen_false_positive_rate"),
                 rounded(F.avg(F.when(F.col("positive"), F.when(F.col("score") > v, 1.0).otherwise(0.0)))).alias("unseen_true_positive_rate")).alias(f"t{i}")
        for i, v in enumerate(levels)])
    return rates.select(F.inline(F.array(*[f"t{i}" for i in range(11)])))


@query(
    "w15_conformal_p_value",
    with_(
        targets_cte(),
        "ep AS (SELECT slice_type, experiment, episode_id, max(round(sla_cost, 6)) AS s FROM targets WHERE publication_split = 'validation' GROUP BY ALL)",
        "qr AS (SELECT row_id, publication_split, slice_type, round(sla_cost, 6) AS s FROM targets WHERE publication_split IN ('test_seen', 'test_unseen'))",
        "ec AS (SELECT slice_type, experiment, list(s) AS cal FROM ep GROUP BY ALL)",
        "pr AS (SELECT row_id, publication_split, experiment, (len(list_filter(cal, lambda x: x >= s)) + 1) / (len(cal) + 1) AS p FROM qr JOIN ec USING (slice_type))",
        body=f"SELECT row_id, publication_split, {r9('min(p)', 'p')} FROM pr GROUP BY 1, 2",
    ),
)
def conformal(spark, sf):
    t, _ = studies.targets(spark, sf)
    t = t.withColumn("s", F.round("sla_cost", 6))
    cal = t.filter("publication_split = 'validation'").groupBy("slice_type", F.col("experiment").alias("role"), "episode_id").agg(F.max("s").alias("s"))
    q = t.filter("publication_split IN ('test_seen', 'test_unseen')").select("row_id", "publication_split", "slice_type", "s")
    q = q.withColumn("role", F.explode(F.array(F.lit("exp1"), F.lit("exp2"))))
    p = inference.conformal_p(cal, q, ["slice_type", "role"], "s")
    return p.groupBy("row_id", "publication_split").agg(rounded(F.min("p")).alias("p"))


# ---- fold merges, trade-offs, gates --------------------------------------------------------

_FOLD = f"""{_D4[0]}, {_D4[1]},
fold AS (SELECT publication_split AS split, experiment AS fold, 'proposed' AS model, count(*) AS fold_rows, avg(e_utility) AS utility, avg((e_sla > 0.45)::INT) AS sla_rate,
  count_if(prev_action <> selected_action) / greatest(count(prev_action), 1) AS churn, count(prev_action) AS transitions, avg((selected_action <> current_action)::INT) AS disagreement FROM d4 GROUP BY 1, 2
  UNION ALL SELECT publication_split, experiment, 'logged', count(*), avg(utility), avg((sla_cost > 0.45)::INT), count_if(pa <> action) / greatest(count(pa), 1), count(pa), avg((current_action <> action)::INT)
  FROM (SELECT *, lag(action) OVER (PARTITION BY episode_id ORDER BY timestamp_s) AS pa FROM targets) GROUP BY 1, 2),
merged AS (SELECT split, model, sum(fold_rows)::BIGINT AS rows, sum(utility * fold_rows) / sum(fold_rows) AS utility, sum(sla_rate * fold_rows) / sum(fold_rows) AS sla_rate,
  sum(churn * transitions) / sum(transitions) AS churn, sum(disagreement * fold_rows) / sum(fold_rows) AS disagreement FROM fold GROUP BY 1, 2)"""


def _folds(spark, sf):
    from policylake.operators import windows

    s = dq.scored_selection(spark, sf)
    cols = ["episode_id", "publication_split", "experiment"]
    p = s.select(*cols, F.lit("proposed").alias("model"), F.col("e_utility").alias("u"), F.col("e_sla").alias("sla"), "switch", "previous_action",
                 (F.col("selected_action") != F.col("current_action")).alias("d"))
    t, _ = studies.targets(spark, sf)
    lg = windows.replay_switches(t, "action").select(*cols, F.lit("logged").alias("model"), F.col("utility").alias("u"), F.col("sla_cost").alias("sla"), "switch", "previous_action",
                                                    (F.col("action") != F.col("current_action")).alias("d"))
    pairs = F.count("previous_action")
    return p.unionByName(lg).groupBy(F.col("publication_split").alias("split"), F.col("experiment").alias("fold"), "model").agg(
        F.count(F.lit(1)).alias("fold_rows"), F.avg("u").alias("utility"), cond_rate(F.col("sla") > 0.45).alias("sla_rate"),
        (F.count_if("switch") / F.greatest(pairs, F.lit(1))).alias("churn"), pairs.alias("transitions"), cond_rate(F.col("d")).alias("disagreement"),
    )


_MERGE = ["utility", "sla_rate", "churn", "disagreement"]


def merged_folds(spark, sf):
    return freeze(aggregates.fold_merge(_folds(spark, sf), _MERGE, {"churn": "transitions"}, "fold_rows"))


@query("a9_fold_merge", with_(candidates_cte(), _FOLD, body=f"SELECT split, model, rows, {', '.join(r9(c, c) for c in _MERGE)} FROM merged"))
def fold_merge(spark, sf):
    return merged_folds(spark, sf).select("split", "model", "rows", *[rounded(c).alias(c) for c in _MERGE])


@query(
    "a24_tradeoff_deltas",
    with_(
        candidates_cte(), _FOLD,
        body=f"""SELECT p.split, b.model AS baseline, {r9('p.utility - b.utility', 'utility_delta')}, {r9('b.churn - p.churn', 'switch_reduction')},
        {r9('b.disagreement - p.disagreement', 'disagreement_reduction')}, {r9('p.sla_rate - b.sla_rate', 'sla_delta')} FROM merged p JOIN merged b USING (split) WHERE p.model = 'proposed' AND b.model <> 'proposed'""",
    ),
)
def tradeoff(spark, sf):
    return gates.tradeoffs(merged_folds(spark, sf), "proposed")


@query(
    "a21_weighted_overlap",
    with_(
        candidates_cte(),
        "ov AS (SELECT publication_split AS split, slice_type, a, count(*) AS w, avg(sup::INT) AS overlap FROM cand GROUP BY 1, 2, 3)",
        body=f"SELECT split, count(*) AS cells, sum(w)::BIGINT AS weight, {r9('sum(w * overlap) / sum(w)', 'overlap')} FROM ov GROUP BY 1",
    ),
)
def overlap(spark, sf):
    rows, _ = studies.candidate_rows(spark, sf, ["sup"])
    cells = rows.select(F.col("publication_split").alias("split"), "slice_type", F.inline("cand")).groupBy("split", "slice_type", "action").agg(
        F.count(F.lit(1)).alias("w"), cond_rate(F.col("sup")).alias("overlap"))
    return cells.groupBy("split").agg(F.count(F.lit(1)).alias("cells"), F.sum("w").alias("weight"), rounded(F.sum(F.col("w") * F.col("overlap")) / F.sum("w")).alias("overlap"))


@query(
    "v12_gate_verdicts",
    with_(
        targets_cte(),
        """f AS (SELECT count(*) AS n, count(DISTINCT publication_split) AS splits, avg(utility) AS util, avg((sla_cost > 0.45)::INT) AS viol, count(DISTINCT action) AS actions FROM targets)""",
        """g AS (SELECT unnest(['rows', 'splits', 'utility', 'violations', 'actions']) AS gate, unnest([n >= 1000, splits = 4, util > 0.4, viol < 0.2, actions >= 3]) AS passed FROM f)""",
        body="""SELECT gate, passed, CASE WHEN (SELECT count_if(passed) = count(*) FROM g) THEN 'ready' WHEN (SELECT count_if(passed) = count(*) - 1 FROM g) THEN 'nearly ready' ELSE 'not ready' END AS verdict FROM g""",
    ),
)
def gate_verdicts(spark, sf):
    t, _ = studies.targets(spark, sf)
    return gates.readiness(t)


@query(
    "v13_randomised_log_guards",
    with_(
        transitions_cte(),
        f"lg AS (SELECT *, 0.05::DOUBLE + 0.9::DOUBLE * {u(chr(39) + 'prop' + chr(39), 'row_id')} AS propensity, lag(action) OVER (PARTITION BY episode_id ORDER BY timestamp_s) AS pa FROM trans)",
        body="""SELECT unnest(['propensity_valid', 'four_episodes', 'switches', 'action_support']) AS gate, unnest([(SELECT bool_and(propensity > 0 AND propensity <= 1) FROM lg),
        (SELECT count(DISTINCT episode_id) >= 4 FROM lg), (SELECT count_if(pa <> action) >= 20 FROM lg), (SELECT min(n) >= 30 FROM (SELECT action, count(*) AS n FROM lg GROUP BY 1))]) AS passed""",
    ),
)
def randomised_guards(spark, sf):
    t = adapters.prepared(spark, sf).withColumn("propensity", 0.05 + 0.9 * uniform("prop", F.col("row_id")))
    return gates.randomised_log(t, min_switches=20, min_support=30)


_CONFIGS = "cfgs AS (SELECT training_config, slice_type || '|' || action || '|' || base_station AS cell, count(*) AS n FROM trans WHERE publication_split = 'train' GROUP BY 1, 2)"


@query(
    "m16_configuration_split",
    with_(
        transitions_cte(), _CONFIGS,
        "c AS (SELECT training_config, list(DISTINCT cell) AS cells, sum(n) AS n, row_number() OVER (ORDER BY replace(training_config, 'tr', '')::INT) AS k FROM cfgs GROUP BY 1)",
        "tot AS (SELECT count(DISTINCT cell) AS all_cells, (SELECT sum(n) FROM c) AS all_rows, (SELECT count(*) FROM c) AS nc FROM cfgs)",
        "combo AS (SELECT a.training_config AS c1, b.training_config AS c2, d.training_config AS c3, a.n + b.n + d.n AS n, a.k AS k1, b.k AS k2, d.k AS k3 FROM c a JOIN c b ON a.k < b.k JOIN c d ON b.k < d.k)",
        """sc AS (SELECT combo.*, (SELECT count(DISTINCT cell) FROM cfgs WHERE training_config IN (c1, c2, c3)) / all_cells AS oc,
        (SELECT count(DISTINCT cell) FROM cfgs WHERE training_config NOT IN (c1, c2, c3)) / all_cells AS pc, 1 - abs(n / all_rows - 3.0::DOUBLE / nc) AS bal FROM combo, tot)""",
        body=f"""SELECT c1 || ',' || c2 || ',' || c3 AS evaluator_configs, {r9('oc', 'evaluator_coverage')}, {r9('pc', 'policy_coverage')} FROM sc
        ORDER BY round(4 * least(oc, pc) + oc + pc + 0.05::DOUBLE * bal, 12) DESC, c1 DESC, c2 DESC, c3 DESC LIMIT 1""",
    ),
)
def configuration_split(spark, sf):
    t = adapters.prepared(spark, sf).filter("publication_split = 'train'")
    t = t.withColumn("cell", F.concat_ws("|", "slice_type", "action", "base_station"))
    return gates.configuration_split(t, "cell", 3)


@query(
    "m21_latest_run_per_version",
    with_(
        transitions_cte(),
        "runs AS (SELECT training_config AS version, timestamp_s AS registered_at, scenario || experiment || base_station AS artifact, avg(reward) AS f1 FROM trans GROUP BY ALL)",
        body=f"SELECT version, registered_at, artifact, {r9('f1', 'f1')} FROM (SELECT *, row_number() OVER (PARTITION BY version ORDER BY registered_at DESC, artifact DESC) AS rk FROM runs) WHERE rk = 1",
    ),
)
def latest_run(spark, sf):
    t = adapters.prepared(spark, sf)
    runs = t.groupBy(F.col("training_config").alias("version"), F.col("timestamp_s").alias("registered_at"),
                     F.concat("scenario", "experiment", "base_station").alias("artifact")).agg(F.avg("reward").alias("f1"))
    return gates.latest_per_version(runs).select("version", "registered_at", "artifact", rounded("f1").alias("f1"))


@query(
    "d29_margin_choice",
    with_(
        candidates_cte(), *_CTRL, _CTRL_ROWS,
        "ep AS (SELECT episode_id, avg(greedy_q) AS a, avg(score) AS b, avg(logged) AS l FROM kk WHERE publication_split = 'validation' GROUP BY 1)",
        "mg AS (SELECT unnest([0.0, 0.01, 0.02, 0.05])::DOUBLE AS margin)",
        body=f"""SELECT margin, {r9('avg(CASE WHEN b - l > margin THEN b ELSE l END)', 'value')}, {r9('avg((b - l > margin)::INT)', 'switch_rate')} FROM ep, mg GROUP BY margin""",
    ),
)
def margin_choice(spark, sf):
    e = _controller_episodes(spark, sf).filter("publication_split = 'validation'")
    ep = e.groupBy("episode_id").agg(F.avg("score").alias("b"), F.avg("logged").alias("l"))
    margins = F.array(*[F.lit(m) for m in (0.0, 0.01, 0.02, 0.05)])
    long = ep.withColumn("margin", F.explode(margins))
    wins = F.col("b") - F.col("l") > F.col("margin")
    return long.groupBy("margin").agg(rounded(F.avg(F.when(wins, F.col("b")).otherwise(F.col("l")))).alias("value"), rounded(cond_rate(wins)).alias("switch_rate"))


_MARGINS = (0.0, 0.01, 0.02, 0.05)
_CHOSEN = """mv AS (SELECT margin, avg(CASE WHEN b - l > margin THEN b ELSE l END) AS value FROM (SELECT episode_id, avg(score) AS b, avg(logged) AS l FROM kk WHERE publication_split = 'validation' GROUP BY 1), (SELECT unnest([0.0, 0.01, 0.02, 0.05])::DOUBLE AS margin) GROUP BY 1),
chosen AS (SELECT margin FROM mv ORDER BY round(value, 9) DESC, margin LIMIT 1)"""


@query(
    "d29_held_out_comparison",
    with_(
        candidates_cte(), *_CTRL, _CTRL_ROWS, _CHOSEN,
        "he AS (SELECT publication_split, episode_id, avg(score) AS b, avg(logged) AS l FROM kk WHERE publication_split IN ('test_seen', 'test_unseen') GROUP BY 1, 2)",
        "dl AS (SELECT publication_split, margin, CASE WHEN b - l > margin THEN b - l ELSE 0 END AS delta FROM he, chosen)",
        body=f"""SELECT publication_split, margin, count(*) AS episodes, {r9('avg(delta)', 'mean_delta')}, {r9('stddev_samp(delta)', 'std_delta')}, count_if(delta > 0)::BIGINT AS better, count_if(delta < 0)::BIGINT AS worse,
        {r9('avg(delta) - 1.96::DOUBLE * stddev_samp(delta) / sqrt(count(*))', 'low')}, {r9('avg(delta) + 1.96::DOUBLE * stddev_samp(delta) / sqrt(count(*))', 'high')} FROM dl GROUP BY 1, 2""",
    ),
)
def held_out_comparison(spark, sf):
    """The margin of the highest validation value (the least on ties), then paired episodes of every test split."""
    per = _controller_episodes(spark, sf).groupBy("publication_split", "episode_id").agg(F.avg("score").alias("b"), F.avg("logged").alias("l"))
    per = sinks.staged(per, "controller-episodes")
    gain = F.col("b") - F.col("l")
    value = per.filter("publication_split = 'validation'").agg(*[F.round(F.avg(F.when(gain > m, F.col("b")).otherwise(F.col("l"))), 9).alias(f"m{k}") for k, m in enumerate(_MARGINS)]).first()
    margin = max((v, -m) for v, m in zip(value, _MARGINS, strict=True))[1] * -1.0
    d = per.filter("publication_split IN ('test_seen', 'test_unseen')").withColumn("delta", F.when(gain > margin, gain).otherwise(0.0))
    half = 1.96 * F.stddev_samp("delta") / F.sqrt(F.count(F.lit(1)))
    return d.groupBy("publication_split", F.lit(margin).alias("margin")).agg(
        F.count(F.lit(1)).alias("episodes"), rounded(F.avg("delta")).alias("mean_delta"), rounded(F.stddev_samp("delta")).alias("std_delta"),
        F.count_if(F.col("delta") > 0).alias("better"), F.count_if(F.col("delta") < 0).alias("worse"),
        rounded(F.avg("delta") - half).alias("low"), rounded(F.avg("delta") + half).alias("high"))
