"""Study drivers: cross-fit folds, seed studies, partition benchmark, baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from policylake.constants import CLUSTER_COLUMNS, STATE_COLUMNS
from policylake.functions.core import cond_rate, first_of, rounded
from policylake.learn import supervised
from policylake.operators import accounting, aggregates, candidates, gates, inference, selection
from policylake.plans import decision_queries as dq
from policylake.plans import studies
from policylake.plans.learning_queries import _setup
from policylake.plans.registry import query
from policylake.sources import adapters, sinks


@query("d23_baseline_comparison")
def baselines(spark, sf):
    t, train, _, _, _ = _setup(spark, sf)
    _, model, _ = studies.fitted(spark, sf)
    test = t.filter("publication_split <> 'train'")
    learners = {
        "tree": DecisionTreeClassifier(featuresCol="x", labelCol="y", maxDepth=6),
        "forest": RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=8, maxDepth=6, seed=1),
        "small_forest": RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=4, maxDepth=4, seed=2),
        "logistic": LogisticRegression(featuresCol="x", labelCol="y", maxIter=8),
    }
    scored = candidates.with_candidates(test.select(*studies.ROW_COLUMNS), model, studies.POLICY_FIELDS)
    chosen = selection.gated_selection(scored, dq.CFG).select("row_id", "publication_split", "action", "cand", "fallback", "selected_action")
    parts = [chosen.select(F.lit("gated_selector").alias("model"), "publication_split", "action", "cand", F.col("selected_action").alias("pick"))]
    for name, learner in learners.items():
        pipe = Pipeline(stages=[StringIndexer(inputCol="action", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep"),
                                VectorAssembler(inputCols=STATE_COLUMNS, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x"), learner]).fit(train)
        p = supervised.named_prediction(pipe, test).select("row_id", "predicted").join(chosen, "row_id")
        ok = F.exists("cand", lambda c: c["action"] == F.col("predicted"))
        parts.append(p.select(F.lit(name).alias("model"), "publication_split", "action", "cand", F.when(ok, F.col("predicted")).otherwise(F.col("fallback")).alias("pick")))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    rows = rows.withColumn("c", first_of(F.filter("cand", lambda c: c["action"] == F.col("pick"))))
    return rows.groupBy("model", "publication_split").agg(
        F.count(F.lit(1)).alias("n"), cond_rate(F.col("pick") == F.col("action")).alias("agreement"),
        F.avg(selection.outcome_utility(F.col("c"), dq.CFG, "")).alias("mean_utility"), cond_rate(F.col("c.sla") > 0.45).alias("sla_violation_rate"))


def _fold(t, fold: str):
    """Policy fitted on one experiment, evaluator on the other; the fold's own test rows are scored."""
    train = t.filter("publication_split = 'train'")
    model, _ = candidates.fit_model(train.filter(F.col("experiment") == fold), train.filter(F.col("experiment") != fold))
    test = t.filter((F.col("experiment") == fold) & F.col("publication_split").startswith("test"))
    rows = candidates.with_candidates(test.select(*studies.ROW_COLUMNS), model, studies.POLICY_FIELDS + studies.EVALUATOR_FIELDS)
    return accounting.score_selection(selection.hysteresis_selection(rows, dq.CFG, 0.02), dq.CFG).select(
        F.lit(fold).alias("fold"), "row_id", "episode_id", "publication_split", *CLUSTER_COLUMNS, "e_utility", "e_sla", "utility", "switch", "previous_action", "rollback")


def _crossfit(spark, sf):
    t, _ = studies.targets(spark, sf)
    return sinks.staged(reduce(lambda a, b: a.unionByName(b), [_fold(t, f) for f in ("exp1", "exp2")]), "crossfit")


@query("d24_role_swap_crossfit")
def crossfit(spark, sf):
    e = _crossfit(spark, sf)
    pairs = F.count("previous_action")
    folds = e.groupBy(F.col("publication_split").alias("split"), "fold").agg(
        F.lit("proposed").alias("model"), F.count(F.lit(1)).alias("fold_rows"), F.avg("e_utility").alias("utility"), cond_rate(F.col("e_sla") > 0.45).alias("sla_rate"),
        (F.count_if("switch") / F.greatest(pairs, F.lit(1))).alias("churn"), pairs.alias("transitions"))
    return aggregates.fold_merge(folds, ["utility", "sla_rate", "churn"], {"churn": "transitions"}, "fold_rows")


@query("d25_partition_benchmark")
def partition_benchmark(spark, sf):
    t, _ = studies.targets(spark, sf)
    train = t.filter("publication_split = 'train'").withColumn("cell", F.concat_ws("|", "slice_type", "action", "base_station"))
    chosen = gates.configuration_split(train, "cell", 3).first()["evaluator_configs"].split(",")
    model, _ = candidates.fit_model(train.filter(~F.col("training_config").isin(chosen)), train.filter(F.col("training_config").isin(chosen)))
    rows = candidates.with_candidates(t.filter("publication_split LIKE 'test%'").select(*studies.ROW_COLUMNS), model, studies.POLICY_FIELDS + studies.EVALUATOR_FIELDS)
    return accounting.selection_summary(accounting.score_selection(selection.hysteresis_selection(rows, dq.CFG, 0.02), dq.CFG), ["publication_split"], dq.CFG)


@query("d26_episode_paired_benchmark")
def episode_benchmark(spark, sf):
    e = _crossfit(spark, sf)
    parts = []
    for split in ("test_seen", "test_unseen"):
        d = e.filter(F.col("publication_split") == split).groupBy(F.col("episode_id").alias("unit")).agg((F.avg("e_utility") - F.avg("utility")).alias("delta"))
        parts.append(inference.paired_inference(d, samples=500, permutations=500, seed=f"d26{split}").withColumn("split", F.lit(split)))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("d27_seed_study")
def seed_study(spark, sf):
    t, train, _, _, actions = _setup(spark, sf)
    x = supervised.assemble(t.filter("publication_split <> 'train'"), actions).select("row_id", "publication_split", "sla_cost", "x")
    parts = []
    for seed in (1, 2, 3):
        m = supervised.forest("sla_cost", seed, trees=4, depth=4).fit(supervised.assemble(train, actions))
        parts.append(m.transform(x).groupBy("publication_split").agg(F.lit(seed).alias("seed"), F.avg(F.abs(F.col("sla_cost") - F.col("p_sla_cost"))).alias("mae"), F.avg("p_sla_cost").alias("mean_prediction")))
    return aggregates.summary_stats(reduce(lambda a, b: a.unionByName(b), parts), ["publication_split"], ["mae", "mean_prediction"])
