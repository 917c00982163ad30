"""Supervised learners on transition and snapshot tables (MLlib)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.constants import CONTEXT_COLUMNS, KPI_COLUMNS, SLICE_NAMES, STATE_COLUMNS
from policylake.functions.core import uniform
from policylake.sources.sinks import staged


def state_features(prefix: str = "") -> list[Column]:
    """17 state columns and the slice one-hot, current or next."""
    return [F.col(f"{prefix}{c}").cast("double").alias(f"f_{c}") for c in STATE_COLUMNS] + [
        (F.col("slice_type") == s).cast("double").alias(f"f_{s}") for s in SLICE_NAMES
    ]


STATE_NAMES = [f"f_{c}" for c in (*STATE_COLUMNS, *SLICE_NAMES)]


def assemble(df: DataFrame, actions: list[str] | None, action: str = "action", prefix: str = "", out: str = "x") -> DataFrame:
    """State (and action one-hot) as a feature vector."""
    keep = [c for c in df.columns]
    feats = state_features(prefix)
    names = list(STATE_NAMES)
    if actions:
        feats += [(F.col(action) == a).cast("double").alias(f"a_{i}") for i, a in enumerate(actions)]
        names += [f"a_{i}" for i in range(len(actions))]
    wide = df.select(*keep, *feats)
    return VectorAssembler(inputCols=names, outputCol=out).transform(wide).drop(*names)


def forest(label: str, seed: int = 7, trees: int = 8, depth: int = 6) -> RandomForestRegressor:
    """Random forest without row resampling, as the tree regressor of critics and values."""
    return RandomForestRegressor(featuresCol="x", labelCol=label, predictionCol=f"p_{label}", numTrees=trees, maxDepth=depth, seed=seed, bootstrap=False)


def fit_critics(train: DataFrame, actions: list[str], seed: int = 7) -> dict[str, object]:
    x = assemble(train, actions)
    return {t: forest(t, seed + i).fit(x) for i, t in enumerate(("sla_cost", "energy_cost", "stability_cost"))}


def out_of_fold(train: DataFrame, actions: list[str], folds: int = 3) -> DataFrame:
    """Out-of-fold service-cost predictions; folds are hashed by episode, so episodes never split."""
    f = train.withColumn("fold", F.floor(uniform("fold", F.col("episode_id")) * folds).cast("int"))
    x = staged(assemble(f, actions).select("row_id", "episode_id", "slice_type", "action", "fold", "sla_cost", "x"), "oof")
    parts = None
    for k in range(folds):
        model = forest("sla_cost", 11 + k).fit(x.filter(F.col("fold") != k))
        p = model.transform(x.filter(F.col("fold") == k))
        parts = p if parts is None else parts.unionByName(p)
    return parts.withColumn("residual", F.col("sla_cost") - F.col("p_sla_cost"))


def fit_independent(train: DataFrame, actions: list[str]) -> object:
    """Independent outcome evaluator: boosted trees on the evaluator's own rows."""
    return GBTRegressor(featuresCol="x", labelCol="utility", predictionCol="p_utility", maxIter=5, maxDepth=4, seed=3).fit(assemble(train, actions))


def capped_by_hash(df: DataFrame, groups: list[str], cap: int) -> DataFrame:
    """At most `cap` rows per group: those of the lowest hash draws.

    A threshold from the group's size lets some four times `cap` rows through before anything is
    shuffled or ranked, so a hot group's rank sees a bounded number of rows.
    """
    from pyspark.sql import Window

    draw = uniform("cap", F.col("row_id"))
    sizes = df.groupBy(*groups).agg(F.least(F.lit(1.0), 4.0 * cap / F.count(F.lit(1))).alias("__share"))
    few = df.join(sizes, groups).withColumn("__u", draw).where(F.col("__u") <= F.col("__share"))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy("__u", "row_id"))
    return few.withColumn("__r", rank).filter(F.col("__r") <= cap).drop("__r", "__u", "__share")


def fit_behaviour(train: DataFrame, cap: int = 2500) -> Pipeline:
    x = VectorAssembler(inputCols=CONTEXT_COLUMNS, outputCol="x")
    model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=8, maxDepth=5, seed=5)
    return Pipeline(stages=[StringIndexer(inputCol="action", outputCol="y", stringOrderType="alphabetAsc"), x, model]).fit(
        capped_by_hash(train, ["slice_type", "action"], cap)
    )


def behaviour_long(model, rows: DataFrame, actions: list[str]) -> DataFrame:
    """Probability per (row, action); actions the prior never saw keep zero."""
    labels = model.stages[0].labels
    p = model.transform(rows).select("row_id", "slice_type", vector_to_array("probability").alias("p"))
    entries = F.array(*[F.struct(F.lit(a).alias("action"), (F.get("p", F.lit(labels.index(a))) if a in labels else F.lit(0.0)).alias("prob")) for a in actions])
    return p.select("row_id", "slice_type", F.inline(entries))


# ---- proposal models on KPI snapshots ------------------------------------------------------

def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.75) -> DataFrame:
    """Train flag by a per-label hash draw."""
    return df.withColumn("is_train", uniform("split", F.col(label), F.col(key)) < share)


def proposer(kind: str = "forest") -> Pipeline:
    names = [*KPI_COLUMNS, *[f"is_{s}" for s in SLICE_NAMES]]
    learners = {
        "forest": RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=12, maxDepth=8, seed=9),
        "tree": DecisionTreeClassifier(featuresCol="x", labelCol="y", maxDepth=8, seed=9),
        "small_forest": RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=4, maxDepth=5, seed=9),
        "logistic": LogisticRegression(featuresCol="x", labelCol="y", maxIter=15),
    }
    return Pipeline(stages=[
        StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x"), learners[kind],
    ])


def with_slice_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({f"is_{s}": (F.col("slice_type") == s).cast("double") for s in SLICE_NAMES})


def named_prediction(model, df: DataFrame) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    return model.transform(df).withColumn("predicted", F.get(labels, F.col("prediction").cast("int")))


def perturbed(df: DataFrame, share: float = 0.05) -> DataFrame:
    """Each KPI plus Gaussian noise of `share` of the column's spread, from portable uniforms."""
    spread = df.agg(*(F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(c) for c in KPI_COLUMNS)).first()

    def gauss(c: str) -> Column:
        a, b = uniform("n1", F.lit(c), F.col("event_id")), uniform("n2", F.lit(c), F.col("event_id"))
        return F.sqrt(-2.0 * F.ln(a)) * F.cos(2 * 3.141592653589793 * b)

    return df.withColumns({c: F.col(c) + share * float(spread[c]) * gauss(c) for c in KPI_COLUMNS})
