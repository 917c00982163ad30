"""Queries of the learners; values depend on the learner, so rows and invariants are checked."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from policylake.constants import CONTEXT_COLUMNS, STATE_COLUMNS
from policylake.functions.core import cond_rate, first_of, rounded, uniform
from policylake.functions.dims import freeze
from policylake.learn import isolation, supervised, transition, value
from policylake.operators import aggregates, candidates, density, governed, inference, neighbours, outcome_model, support
from policylake.plans import decision_queries as dq
from policylake.plans import studies
from policylake.plans.registry import query
from policylake.plans.sqltext import EVALUATOR_WHERE, POLICY_WHERE, drawn_sql, outcome_model_ctes, r9, state_cte, transitions_cte, u, with_
from policylake.plans.support_queries import SCALED_SQL, supported
from policylake.sources import adapters
from policylake.sources.sinks import staged


def _setup(spark, sf):
    t, _ = studies.targets(spark, sf)
    train = staged(t.filter("publication_split = 'train'"), "train")
    cells = freeze(train.select("slice_type", "action").distinct())
    allowed: dict[str, list[str]] = {}
    for r in cells.orderBy("slice_type", "action").collect():  # the action catalogue
        allowed.setdefault(r["slice_type"], []).append(r["action"])
    actions = sorted({a for xs in allowed.values() for a in xs})
    return t, train, cells, allowed, actions


@query("m1_feature_assembly")
def feature_assembly(spark, sf):
    t, _, _, _, actions = _setup(spark, sf)
    x = supervised.assemble(t, actions).select("publication_split", F.size(vector_to_array("x")).alias("width"))
    return x.groupBy("publication_split", "width").agg(F.count(F.lit(1)).alias("n"))


def _snapshots(spark, sf):
    o = supervised.with_slice_flags(adapters.observations(spark, sf).withColumn("label", governed.expert_label()))
    return staged(supervised.stratified_split(o, "label", "event_id"), "snapshots")


def _quality(model, test):
    p = supervised.named_prediction(model, test)
    return aggregates.classification_summary(aggregates.class_report(aggregates.confusion(p, "label", "predicted")))


@query("m2_policy_proposer")
def policy_proposer(spark, sf):
    s = _snapshots(spark, sf)
    model = supervised.proposer().fit(s.filter("is_train"))
    p = model.transform(s.filter("NOT is_train")).select("event_id", vector_to_array("probability").alias("p"))
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    top = F.slice(F.sort_array(F.arrays_zip("p", labels.alias("label")), asc=False), 1, 4)
    return p.select("event_id", F.posexplode(top).alias("rank", "c")).select("event_id", (F.col("rank") + 1).alias("rank"), F.col("c.label").alias("policy"), rounded(F.col("c.p")).alias("probability"))


@query("m3_model_selection")
def model_selection(spark, sf):
    s = _snapshots(spark, sf)
    parts = []
    for kind in ("forest", "small_forest", "tree", "logistic"):
        model = supervised.proposer(kind).fit(s.filter("is_train"))
        test = s.filter("NOT is_train")
        same = supervised.named_prediction(model, test).select("event_id", "predicted").join(
            supervised.named_prediction(model, supervised.perturbed(test)).select("event_id", F.col("predicted").alias("noisy")), "event_id")
        robust = same.agg(cond_rate(F.col("predicted") == F.col("noisy")).alias("r"))
        parts.append(_quality(model, test).select(F.lit(kind).alias("model"), "rows", "accuracy", "macro_f1", robust.scalar().alias("robustness")))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.withColumn("score", 0.70 * F.col("macro_f1") + 0.15 * F.col("robustness")).orderBy(F.desc("score"))


@query("m4_perturbation_stability")
def stability(spark, sf):
    s = _snapshots(spark, sf)
    model = supervised.proposer("tree").fit(s.filter("is_train"))
    a = supervised.named_prediction(model, s).select("event_id", "label", "predicted")
    b = supervised.named_prediction(model, supervised.perturbed(s)).select("event_id", F.col("predicted").alias("noisy"))
    return a.join(b, "event_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), cond_rate(F.col("predicted") == F.col("noisy")).alias("stability"))


@query("m5_fitted_q_iteration")
def fitted_q(spark, sf):
    t, train, cells, _, actions = _setup(spark, sf)
    model = value.fitted_q(train, cells, actions)
    rows = t.filter("publication_split <> 'train'").select("row_id", "slice_type", *STATE_COLUMNS).join(cells, "slice_type")
    q = model.transform(supervised.assemble(rows, actions))
    return q.groupBy("row_id").agg(F.max_by("action", F.struct("p_target", "action")).alias("action"), F.max("p_target").alias("q"))


_NEXT = [f"next_{c}" for c in CONTEXT_COLUMNS]


def _linear(spark, sf, **kw):
    t, train, _, allowed, actions = _setup(spark, sf)
    w = value.linear_q(train, CONTEXT_COLUMNS, _NEXT, actions, allowed, **kw)
    tail = 2 if kw.get("quantiles") else None
    return value.greedy_action(t.filter("publication_split <> 'train'"), w, CONTEXT_COLUMNS, actions, allowed, tail)


@query("m6_linear_conservative_q")
def conservative_q(spark, sf):
    return _linear(spark, sf, alpha=0.15).select("row_id", "greedy_action", "greedy_q")


@query("m7_polynomial_conservative_q")
def polynomial_q(spark, sf):
    t, train, _, allowed, actions = _setup(spark, sf)
    pairs = [(a, b) for i, a in enumerate(CONTEXT_COLUMNS) for b in CONTEXT_COLUMNS[i:]]
    def widen(df):
        return df.withColumns({
            **{f"x{i}": F.log1p(F.abs(a)) * F.log1p(F.abs(b)) for i, (a, b) in enumerate(pairs)},
            **{f"nx{i}": F.log1p(F.abs(f"next_{a}")) * F.log1p(F.abs(f"next_{b}")) for i, (a, b) in enumerate(pairs)}})
    feats, nxt = [f"x{i}" for i in range(len(pairs))], [f"nx{i}" for i in range(len(pairs))]
    w = value.linear_q(widen(train), feats, nxt, actions, allowed, alpha=0.3, epochs=4)
    return value.greedy_action(widen(t.filter("publication_split <> 'train'")), w, feats, actions, allowed).select("row_id", "greedy_action", "greedy_q")


@query("m8_quantile_value_tail")
def quantile_tail(spark, sf):
    return _linear(spark, sf, alpha=0.0, epochs=4, quantiles=[0.05, 0.15, 0.25, 0.5, 0.75, 0.85, 0.95]).select("row_id", "greedy_action", F.col("greedy_q").alias("tail_value"))


@query("m9_out_of_fold_residuals")
def oof(spark, sf):
    _, train, _, _, actions = _setup(spark, sf)
    o = supervised.out_of_fold(train, actions)
    return o.groupBy("fold", "slice_type").agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean_residual"), F.avg(F.abs("residual")).alias("mean_abs_residual"))


_ERRORS_SQL = ", ".join(r9(f"avg(abs({c}_cost - p_{c}))", f"mae_{c}") for c in outcome_model.COSTS)


def _residuals(spark, sf):
    """Policy rows with out-of-fold predictions of the three costs and the uncertainty target."""
    t, model, _ = studies.fitted(spark, sf)
    folds = dq.CFG.folds
    rows = outcome_model.prepared_rows(studies.policy_rows(t), model.scale, folds)
    sums = outcome_model.summed(rows, [*outcome_model.COSTS], folds)
    return outcome_model.uncertainty(rows, sums, folds)[0]


@query(
    "m9_uncertainty_target",
    with_(outcome_model_ctes(), body=f"""SELECT fold, slice_type, count(*) AS rows, count(DISTINCT episode_id) AS episodes, {_ERRORS_SQL}, {r9('avg(raw)', 'mean_residual')}, {r9('avg(target)', 'mean_target')},
    count_if(target >= 1)::BIGINT AS capped FROM resid GROUP BY 1, 2"""),
)
def uncertainty_target(spark, sf):
    """Fold sizes, out-of-fold errors of three costs, and the scaled residual capped at its 98 % quantile."""
    r = _residuals(spark, sf).withColumn("episode_id", F.substring_index("row_id", "@", 1))
    return r.groupBy("fold", "slice_type").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("episode_id").alias("episodes"),
        *[rounded(F.avg(F.abs(F.col(c) - F.col(f"p_{c}")))).alias(f"mae_{c}") for c in outcome_model.COSTS],
        rounded(F.avg("raw")).alias("mean_residual"), rounded(F.avg("target")).alias("mean_target"), F.count_if(F.col("target") >= 1).alias("capped"))


@query(
    "m10_uncertainty_critic",
    with_(outcome_model_ctes(), body=f"""SELECT t.publication_split, t.slice_type, count(*) AS rows, {', '.join(r9(f'avg(abs(t.{c}_cost - s.{c}))', f'mae_{c}') for c in outcome_model.COSTS)},
    {r9('avg(s.unc)', 'mean_uncertainty')}, {r9('min(s.unc)', 'least_uncertainty')}, {r9('max(s.unc)', 'most_uncertainty')},
    {r9('corr(s.unc, abs(t.sla_cost - s.sla) + abs(t.energy_cost - s.energy) + abs(t.stability_cost - s.stability))', 'error_correlation')}
    FROM tb t JOIN state s ON s.slice_type = t.slice_type AND s.action = t.action AND s.bin = t.bin WHERE t.publication_split <> 'train' GROUP BY 1, 2"""),
)
def uncertainty_critic(spark, sf):
    """Errors of the cost critics on every held-out split, and how the uncertainty critic goes with them."""
    t, model, _ = studies.fitted(spark, sf)
    held = candidates.with_candidates(t.filter("publication_split <> 'train'").select(*studies.ROW_COLUMNS), model, [*outcome_model.COSTS, "unc"])
    held = held.withColumn("own", first_of(F.filter("cand", lambda c: c["action"] == F.col("action")))).where("own IS NOT NULL")
    error = {c: F.abs(F.col(f"{c}_cost") - F.col(f"own.{c}")) for c in outcome_model.COSTS}
    return held.groupBy("publication_split", "slice_type").agg(
        F.count(F.lit(1)).alias("rows"), *[rounded(F.avg(e)).alias(f"mae_{c}") for c, e in error.items()],
        rounded(F.avg("own.unc")).alias("mean_uncertainty"), rounded(F.min("own.unc")).alias("least_uncertainty"), rounded(F.max("own.unc")).alias("most_uncertainty"),
        rounded(F.corr("own.unc", sum(error.values()))).alias("error_correlation"))


@query("m10_outcome_critics")
def critics(spark, sf):
    t, train, _, _, actions = _setup(spark, sf)
    x = supervised.assemble(t.filter("publication_split <> 'train'"), actions)
    for m in supervised.fit_critics(train, actions).values():
        x = m.transform(x)
    return x.groupBy("publication_split").agg(*[F.avg(F.abs(F.col(c) - F.col(f"p_{c}"))).alias(f"mae_{c}") for c in ("sla_cost", "energy_cost", "stability_cost")])


@query("m11_isolation_ood")
def isolation_ood(spark, sf):
    t, train, _, _, _ = _setup(spark, sf)
    f = isolation.fit_forest(train, STATE_COLUMNS, trees=96)
    s = isolation.ood_probability(isolation.score(train, f, STATE_COLUMNS), isolation.score(t, f, STATE_COLUMNS))
    return s.groupBy("publication_split").agg(F.count(F.lit(1)).alias("n"), F.avg("ood").alias("mean_ood"), F.max("ood").alias("max_ood"))


@query("m12_independent_evaluator")
def independent(spark, sf):
    t, _, _, _, actions = _setup(spark, sf)
    model = supervised.fit_independent(studies.evaluator_rows(t), actions)
    p = model.transform(supervised.assemble(t.filter("publication_split <> 'train'"), actions))
    return aggregates.regression_metrics(p, "utility", "p_utility", ["publication_split"])


def _crossfit_sql() -> str:
    k = dq.CFG.folds
    cluster = "concat_ws('/', scenario, training_config, experiment)"
    fold = f"floor({u("'cluster'", cluster)} * {k})::INT"
    costs = {c: f"{c}_cost" for c in outcome_model.COSTS}
    models = ", ".join(drawn_sql(f"x{i}", "tc", f"{EVALUATOR_WHERE} AND cfold <> {i}", costs, "ep") for i in range(k))
    union = " UNION ALL ".join(f"SELECT slice_type, action, bin, {i} AS cfold, {', '.join(outcome_model.COSTS)} FROM x{i}" for i in range(k))
    return f"tc AS MATERIALIZED (SELECT *, {fold} AS cfold FROM tb), ep AS (SELECT DISTINCT slice_type, action FROM tb WHERE {EVALUATOR_WHERE}), {models}, xf AS ({union})"


@query(
    "m12_cluster_crossfit",
    with_(state_cte(), _crossfit_sql(), body=f"""SELECT t.publication_split, t.slice_type, count(*) AS rows, count(x.sla) AS judged, count(DISTINCT t.cfold) AS folds, 0::BIGINT AS saw_cluster,
    {', '.join(r9(f'avg(abs(t.{c}_cost - x.{c}))', f'mae_{c}') for c in outcome_model.COSTS)} FROM tc t LEFT JOIN xf x ON x.slice_type = t.slice_type AND x.action = t.action AND x.bin = t.bin AND x.cfold = t.cfold
    WHERE t.publication_split <> 'train' GROUP BY 1, 2"""),
)
def cluster_crossfit(spark, sf):
    """Three costs of every held-out row from models that saw nothing of its cluster."""
    t, model, _ = studies.fitted(spark, sf)
    p = outcome_model.crossfit_predictions(studies.evaluator_rows(t), t.filter("publication_split <> 'train'"), model.scale, dq.CFG.folds)
    return p.groupBy("publication_split", "slice_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count("p_sla").alias("judged"), F.countDistinct("fold").alias("folds"), F.sum("saw_cluster").alias("saw_cluster"),
        *[rounded(F.avg(F.abs(F.col(f"{c}_cost") - F.col(f"p_{c}")))).alias(f"mae_{c}") for c in outcome_model.COSTS])


@query("m13_behaviour_prior")
def behaviour(spark, sf):
    t, train, _, _, actions = _setup(spark, sf)
    held = t.filter("publication_split <> 'train'")
    long = supervised.behaviour_long(supervised.fit_behaviour(train), held, actions).join(held.select("row_id", "publication_split"), "row_id")
    return long.groupBy("publication_split", "slice_type", "action").agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_prob"))


CALIBRATION_SHARE, MIN_REFERENCE = 0.25, 8
METHODS = ("nearest", "gaussian", "mixture")
_ROLE_KEYS = ["role", *support.KEYS]


def _nonconformity(t):
    """Long scores of calibration and held-out rows: role, method, row, score `s` (null: no model).

    A quarter of each role's episodes, by hash, is kept from the reference; every row that is not
    for training is asked about both roles.
    """
    scaler = support.fit_scaler(t.filter("publication_split = 'train'"))
    cal = uniform("calibration", F.col("episode_id")) < CALIBRATION_SHARE
    roles = {"policy": studies.policy_rows(t), "evaluator": studies.evaluator_rows(t)}
    columns = ["row_id", "episode_id", "publication_split", *support.KEYS]
    own = reduce(lambda a, b: a.unionByName(b), [df.select(*columns, *support.scaled(scaler), F.lit(r).alias("role"), cal.alias("asked")) for r, df in roles.items()])
    held = t.filter("publication_split <> 'train'").select(*columns, *support.scaled(scaler), F.explode(F.array(*map(F.lit, roles))).alias("role"), F.lit(True).alias("asked"))
    rows = staged(density.whole_rows(own.unionByName(held), support.FEATURES), "density-rows")
    reference, asked = rows.filter("NOT asked"), rows.filter("asked").drop("asked")
    points = staged(neighbours.point_counts(reference, _ROLE_KEYS, support.FEATURES), "reference")
    enough = points.groupBy(*_ROLE_KEYS).agg(F.sum("n").alias("rows")).filter(F.col("rows") >= MIN_REFERENCE)
    points = points.join(enough.drop("rows"), _ROLE_KEYS, "left_semi")
    near = neighbours.distinct_distances(asked.withColumn("own", F.lit(False)), points, _ROLE_KEYS, support.FEATURES, "nearest").drop("own")
    scored = asked.join(staged(near, "distances"), [*_ROLE_KEYS, *support.FEATURES], "left")
    scored = density.mahalanobis(scored, staged(density.gaussian(reference, _ROLE_KEYS, support.FEATURES, MIN_REFERENCE), "gaussian"), _ROLE_KEYS, support.FEATURES, "gaussian")
    scored = density.surprise(scored, density.mixture(reference, _ROLE_KEYS, support.FEATURES, MIN_REFERENCE), _ROLE_KEYS, support.FEATURES, "mixture")
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.round(m, 9).alias("s")) for m in METHODS])
    return staged(scored.select(*columns, "role", F.inline(each)), "nonconformity")


_P_VALUES: dict[tuple, object] = {}


def _conformal(spark, sf):
    """row_id, split, slice, action, method, `p` (least of both roles, 0 without a model) and `n_cal`."""
    t = adapters.prepared(spark, sf)
    key = (spark.sparkContext.applicationId, tuple(sorted(t.inputFiles())))
    if key not in _P_VALUES:
        _P_VALUES[key] = staged(_p_values(t), "conformal")
    return _P_VALUES[key]


def _p_values(t):
    scores = _nonconformity(t)
    keys = [*_ROLE_KEYS, "method"]
    calibration = scores.filter("publication_split = 'train' AND s IS NOT NULL").groupBy(*keys, "episode_id").agg(F.max("s").alias("s"))
    held = scores.filter("publication_split <> 'train'")
    known = inference.conformal_p(calibration, held.filter("s IS NOT NULL"), keys, "s").select("row_id", *keys, "p", "n_cal")
    both = held.join(known, ["row_id", *keys], "left")
    return both.groupBy("row_id", "publication_split", *support.KEYS, "method").agg(
        F.min(F.coalesce("p", F.lit(0.0))).alias("p"), F.min(F.coalesce("n_cal", F.lit(0).cast("long"))).alias("n_cal"))


def _supported_at(alpha):
    """Below the attainable resolution every action would pass, so the stratum is refused."""
    return (F.col("p") > alpha) & (F.col("n_cal") >= 1 / alpha - 1)


@query("m14_conformal_action_support")
def conformal(spark, sf):
    return _conformal(spark, sf).withColumn("supported", _supported_at(F.lit(0.2)))


def _gaussian_sql() -> str:
    d = len(CONTEXT_COLUMNS)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    z = ", ".join(f"z_{c} AS z{i}" for i, c in enumerate(CONTEXT_COLUMNS))
    square = " + ".join(f"s{i}_{j} * s{i}_{j} * {1 if i == j else 2}" for i, j in pairs)
    length = " + ".join(f"(z{i} - m{i}) * (z{i} - m{i})" for i in range(d))
    ctes = [f"""ref AS (SELECT CASE experiment WHEN 'exp1' THEN 'policy' ELSE 'evaluator' END AS role, row_id, episode_id, slice_type, action, {z}, {u("'calibration'", "episode_id")} < {CALIBRATION_SHARE} AS cal FROM z WHERE publication_split = 'train' AND experiment IN ('exp1', 'exp2'))""",
            f"gm AS (SELECT role, slice_type, action, count(*) AS gn, {', '.join(f'avg(z{i}) AS m{i}' for i in range(d))} FROM ref WHERE NOT cal GROUP BY ALL HAVING count(*) >= {MIN_REFERENCE})",
            f"""gs AS (SELECT role, slice_type, action, gn, {', '.join(f'm{i}' for i in range(d))}, {', '.join(f'avg((z{i} - m{i}) * (z{j} - m{j})) AS s{i}_{j}' for i, j in pairs)}, avg(({length}) * ({length})) AS fourth
  FROM ref JOIN gm USING (role, slice_type, action) WHERE NOT cal GROUP BY ALL)""",
            f"g0 AS (SELECT *, ({' + '.join(f's{i}_{i}' for i in range(d))}) / {d} AS ball, {square} AS square FROM gs)",
            f"g1 AS (SELECT *, (square - {d} * ball * ball) / {d} AS apart, least((fourth - square) / ({d} * gn), (square - {d} * ball * ball) / {d}) AS noise FROM g0)",
            "g2 AS (SELECT *, CASE WHEN noise <= 0 OR apart <= 0 THEN 0 ELSE noise / apart END AS share FROM g1)"]
    last = "g2"
    for j in range(d):
        minus = "".join(f" - l{j}_{k} * l{j}_{k}" for k in range(j))
        ctes.append(f"c{j} AS (SELECT *, sqrt(greatest(s{j}_{j} * (1 - share) + share * ball{minus}, {density.LEAST_PIVOT!r}::DOUBLE)) AS l{j}_{j} FROM {last})")
        last = f"c{j}"
        below = ", ".join("(" + f"s{i}_{j} * (1 - share)" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j)) + f") / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, d))
        if below:
            ctes.append(f"d{j} AS (SELECT *, {below} FROM c{j})")
            last = f"d{j}"
    ctes.append(f"""ask AS (SELECT role, row_id, episode_id, 'train' AS publication_split, slice_type, action, {', '.join(f'z{i}' for i in range(d))} FROM ref WHERE cal
  UNION ALL SELECT r.role, row_id, episode_id, publication_split, slice_type, action, {z} FROM z, (VALUES ('policy'), ('evaluator')) r(role) WHERE publication_split <> 'train')""")
    last_row = f"ask LEFT JOIN {last} USING (role, slice_type, action)"
    for i in range(d):
        y = f"(z{i} - m{i}" + "".join(f" - l{i}_{k} * y{k}" for k in range(i)) + f") / l{i}_{i} AS y{i}"
        ctes.append(f"y_{i} AS (SELECT {'ask.*, ' + last + '.* EXCLUDE (role, slice_type, action)' if i == 0 else '*'}, {y} FROM {last_row})")
        last_row = f"y_{i}"
    ctes.append(f"""sc AS MATERIALIZED (SELECT role, row_id, episode_id, publication_split, slice_type, action, round({' + '.join(f'y{i} * y{i}' for i in range(d))}, 9) AS s FROM {last_row})""")
    return ", ".join(ctes)


@query(
    "m14_gaussian_support",
    with_(
        transitions_cte(), SCALED_SQL, _gaussian_sql(),
        "ep AS (SELECT role, slice_type, action, episode_id, max(s) AS s FROM sc WHERE publication_split = 'train' AND s IS NOT NULL GROUP BY ALL)",
        "pv AS (SELECT q.row_id, q.role, any_value(q.s) AS s, count(e.s) AS n_cal, CASE WHEN any_value(q.s) IS NULL OR count(e.s) = 0 THEN 0 ELSE (count_if(e.s >= q.s) + 1) / (count(e.s) + 1) END AS p FROM sc q LEFT JOIN ep e USING (role, slice_type, action) WHERE q.publication_split <> 'train' GROUP BY 1, 2)",
        body=f"SELECT row_id, {r9('min(p)', 'p')}, min(CASE WHEN s IS NULL THEN 0 ELSE n_cal END) AS n_cal FROM pv GROUP BY 1",
    ),
)
def gaussian_support(spark, sf):
    return _conformal(spark, sf).filter("method = 'gaussian'").select("row_id", rounded("p").alias("p"), "n_cal")


@query("m17_shortcut_test")
def shortcut(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    t, train, _, _, _ = _setup(spark, sf)
    subsets = {"all": STATE_COLUMNS, "no_action": [c for c in STATE_COLUMNS if c not in ("slice_prb", "scheduler_code")], "action_only": ["slice_prb", "scheduler_code"], "context": CONTEXT_COLUMNS}
    parts = []
    for name, cols in subsets.items():
        model = Pipeline(stages=[StringIndexer(inputCol="action", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep"),
                                 VectorAssembler(inputCols=cols, outputCol="x"), DecisionTreeClassifier(featuresCol="x", labelCol="y", maxDepth=5)]).fit(train)
        p = supervised.named_prediction(model, t.filter("publication_split <> 'train'"))
        rates = p.groupBy("publication_split").agg(
            F.count(F.lit(1)).alias("n"), cond_rate(F.col("predicted") == F.col("action")).alias("agreement"),
            F.avg(F.when(F.col("current_action") != F.col("action"), F.when(F.col("predicted") == F.col("action"), 1.0).otherwise(0.0))).alias("agreement_on_changes"))
        report = aggregates.class_report(aggregates.confusion(p, "action", "predicted", ["publication_split"]), ["publication_split"])
        f1 = aggregates.classification_summary(report, ["publication_split"]).select("publication_split", "macro_f1")
        parts.append(rates.join(f1, "publication_split").withColumn("features", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts)


_T_FEATURES = [*CONTEXT_COLUMNS, "slice_prb"]
_T_TARGETS = ["next_dl_bitrate_mbps", "next_dl_buffer_bytes", "next_grant_ratio"]


def _transition_sql() -> str:
    """The normal equations in SQL, solved by elimination over lists."""
    d, k = len(_T_FEATURES), len(_T_TARGETS)
    prods = transition.pairs(d)
    width = 1 + d + len(prods)
    z = ", ".join(f"({c} - m{i}) / s{i}" for i, c in enumerate(_T_FEATURES))
    basis = "[1.0::DOUBLE, " + ", ".join(f"z[{i + 1}]" for i in range(d)) + ", " + ", ".join(f"z[{i + 1}] * z[{j + 1}]" for i, j in prods) + "]"
    y = ", ".join(f"{t} / q{i}" for i, t in enumerate(_T_TARGETS))
    return f"""tr AS (SELECT *, {u("'transition'", 'episode_id')} < {transition.CALIBRATION_SHARE} AS cal FROM trans),
st AS (SELECT {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS s{i}' for i, c in enumerate(_T_FEATURES))}, {', '.join(f'stddev_pop({t}) AS q{i}' for i, t in enumerate(_T_TARGETS))} FROM tr WHERE publication_split = 'train' AND NOT cal),
bz AS (SELECT tr.*, [{z}] AS z, [{y}] AS y FROM tr, st),
bx AS MATERIALIZED (SELECT row_id, publication_split, cal, y, {basis} AS x FROM bz),
gram AS (SELECT i, j, sum(x[i] * CASE WHEN j <= {width} THEN x[j] ELSE y[j - {width}] END) + CASE WHEN i = j AND i > 1 THEN {transition.ALPHA} ELSE 0 END AS g
  FROM bx, range(1, {width + 1}) a(i), range(1, {width + k + 1}) b(j) WHERE publication_split = 'train' AND NOT cal GROUP BY i, j),
mat AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(g ORDER BY j) AS r FROM gram GROUP BY i)),
gj AS (SELECT 1 AS n, m FROM mat UNION ALL
  SELECT n + 1, list_transform(m, lambda r, i: CASE WHEN i = n THEN list_transform(r, lambda v: v / r[n]) ELSE list_transform(r, lambda v, c: v - r[n] / m[n][n] * m[n][c]) END) FROM gj WHERE n <= {width}),
wt AS (SELECT m FROM gj WHERE n = {width + 1}),
rs AS MATERIALIZED (SELECT row_id, publication_split, cal, t, y[t + 1] - list_sum(list_transform(x, lambda v, i: v * m[i][{width} + t + 1])) AS residual FROM bx, wt, range({k}) g(t)),
qm AS (SELECT t, quantile_cont(residual, {transition.UPPER}) AS q FROM rs WHERE publication_split = 'train' AND cal GROUP BY 1),
mg AS (SELECT t, greatest(0.0::DOUBLE, any_value(q)) AS upper, greatest(greatest(0.0::DOUBLE, any_value(q)), avg(residual)) AS tail FROM rs JOIN qm USING (t) WHERE publication_split = 'train' AND cal AND residual >= q GROUP BY 1)"""


@query(
    "m18_transition_regression",
    "WITH RECURSIVE " + with_(
        transitions_cte(), _transition_sql(),
        body=f"""SELECT publication_split, ['{"', '".join(_T_TARGETS)}'][t + 1] AS target, count(*) AS rows, round(avg(abs(residual)), 6) AS scaled_mae, round(any_value(upper), 6) AS upper_margin,
        round(any_value(tail), 6) AS tail_margin, round(avg((residual <= upper)::INT), 6) AS covered FROM rs JOIN mg USING (t) WHERE publication_split <> 'train' GROUP BY 1, t""",
    )[len("WITH "):],
)
def transition_regression(spark, sf):
    """Three next-second values of every held-out row; margins from training episodes kept from the fit."""
    t = adapters.prepared(spark, sf)
    train = t.filter("publication_split = 'train'")
    model = transition.fit(train.filter(~transition.calibrates()), _T_FEATURES, _T_TARGETS)
    m = transition.margins(transition.residuals(train.filter(transition.calibrates()), model, []))
    held = transition.residuals(t.filter("publication_split <> 'train'"), model, ["publication_split"])
    return held.join(freeze(m), "target").groupBy("publication_split", "target").agg(
        F.count(F.lit(1)).alias("rows"), rounded(F.avg(F.abs("residual")), 6).alias("scaled_mae"), rounded(F.max("upper"), 6).alias("upper_margin"),
        rounded(F.max("tail"), 6).alias("tail_margin"), rounded(cond_rate(F.col("residual") <= F.col("upper")), 6).alias("covered"))


@query("m19_bootstrap_advantage_ensemble")
def advantage(spark, sf):
    from pyspark.ml.regression import DecisionTreeRegressor

    t, train, _, _, actions = _setup(spark, sf)
    x = supervised.assemble(train, actions).select("episode_id", "utility", "x")
    v = supervised.assemble(t.filter("publication_split = 'validation'"), actions).select("row_id", "x", "utility")
    for k in range(4):
        draws = uniform("boot", F.lit(k), F.col("episode_id"))
        weight = F.when(draws < 0.3679, 0.0).when(draws < 0.7358, 1.0).when(draws < 0.9197, 2.0).otherwise(3.0)
        model = DecisionTreeRegressor(featuresCol="x", labelCol="utility", weightCol="w", predictionCol=f"p{k}", maxDepth=5).fit(x.withColumn("w", weight).filter("w > 0"))
        v = model.transform(v)
    return v.select("row_id", F.array_min(F.array(*[f"p{k}" for k in range(4)])).alias("lower_value"), "utility")


REPLICATES, LOWER, MARGIN = 40, 0.05, 0.01


def _advantage_sql() -> str:
    s = f"{outcome_model.STRENGTH}::DOUBLE"
    w = " + ".join(f"(d >= {p!r}::DOUBLE)::INT" for p in outcome_model.POISSON)
    return f"""em AS (SELECT episode_id, slice_type, action, bin, count(*) AS n, sum(utility) AS s FROM tb WHERE {POLICY_WHERE} GROUP BY ALL),
dw AS (SELECT *, {w} AS w FROM (SELECT em.*, r, {u("'advantage'", 'r', 'episode_id')} AS d FROM em, range({REPLICATES}) x(r))),
rb AS (SELECT r, slice_type, action, bin, sum(w * n)::DOUBLE AS n, sum(w * s) AS s FROM dw GROUP BY ALL),
rc AS (SELECT r, slice_type, action, sum(n) AS n, sum(s) AS s FROM rb GROUP BY ALL),
rs AS (SELECT r, slice_type, sum(s) / sum(n) AS m FROM rc GROUP BY ALL),
rq AS MATERIALIZED (SELECT rc.r, rc.slice_type, rc.action, g.bin, c.idx, (coalesce(rb.s, 0) + {s} * ((rc.s + {s} * rs.m) / (rc.n + {s}))) / (coalesce(rb.n, 0) + {s}) AS q
  FROM rc JOIN rs USING (r, slice_type) JOIN cells c ON c.slice_type = rc.slice_type AND c.action = rc.action CROSS JOIN (SELECT unnest(range(9)) AS bin) g
  LEFT JOIN rb ON rb.r = rc.r AND rb.slice_type = rc.slice_type AND rb.action = rc.action AND rb.bin = g.bin),
ad AS (SELECT i.slice_type, i.bin, i.action AS current_action, k.action AS candidate, k.idx, quantile_cont(k.q - i.q, {LOWER}) AS lower
  FROM rq i JOIN rq k ON k.r = i.r AND k.slice_type = i.slice_type AND k.bin = i.bin AND k.action <> i.action GROUP BY ALL),
bestad AS (SELECT * FROM ad QUALIFY row_number() OVER (PARTITION BY slice_type, bin, current_action ORDER BY round(lower, 12) DESC, idx) = 1)"""


@query(
    "m19_paired_advantage",
    with_(state_cte(), _advantage_sql(), body=f"""SELECT t.row_id, t.publication_split, candidate, {r9('lower', 'lower_advantage')}, coalesce(lower > {MARGIN}, false) AS promoted,
    CASE WHEN lower > {MARGIN} THEN candidate ELSE t.current_action END AS chosen FROM tb t LEFT JOIN bestad b ON b.slice_type = t.slice_type AND b.bin = t.bin AND b.current_action = t.current_action WHERE t.publication_split <> 'train'"""),
)
def paired_advantage(spark, sf):
    """Candidate minus incumbent in every bootstrap replicate of the training episodes; promoted above a margin."""
    t, model, cells = studies.fitted(spark, sf)
    best = outcome_model.advantages(studies.policy_rows(t), model.scale, cells.collect(), REPLICATES, LOWER)
    held = t.filter("publication_split <> 'train'").withColumn("bin", model.scale.bin()).join(best, ["slice_type", "bin", "current_action"], "left")
    promoted = F.coalesce(F.col("lower") > MARGIN, F.lit(False))
    return held.select("row_id", "publication_split", "candidate", rounded("lower").alias("lower_advantage"), promoted.alias("promoted"),
                       F.when(promoted, F.col("candidate")).otherwise(F.col("current_action")).alias("chosen"))


@query("d12_cql_alpha_tuning")
def cql_tuning(spark, sf):
    t, train, _, allowed, actions = _setup(spark, sf)
    evaluator = supervised.fit_independent(studies.evaluator_rows(t), actions)
    parts = []
    for a in (0.05, 0.15, 0.30):
        w = value.linear_q(train, CONTEXT_COLUMNS, _NEXT, actions, allowed, alpha=a, epochs=3)
        g = value.greedy_action(t.filter("publication_split = 'validation'"), w, CONTEXT_COLUMNS, actions, allowed)
        p = evaluator.transform(supervised.assemble(g, actions, action="greedy_action"))
        parts.append(p.agg(F.lit(a).alias("alpha"), F.avg("p_utility").alias("utility")))
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.desc("utility"))


@query("d13_conformal_grid")
def conformal_grid(spark, sf):
    """Method x alpha grid on validation; the feasible point of most coverage wins, then the least alpha."""
    p = _conformal(spark, sf).filter("publication_split = 'validation'")
    alphas = F.array(*[F.lit(a) for a in (0.10, 0.15, 0.20, 0.25, 0.30, 0.35)])
    long = p.withColumn("alpha", F.explode(alphas))
    grid = long.groupBy("method", "alpha").agg(F.count(F.lit(1)).alias("n"), cond_rate(_supported_at(F.col("alpha"))).alias("coverage"))
    grid = freeze(grid.withColumn("feasible", F.col("coverage") >= 0.05))
    best = grid.filter("feasible").agg(F.max_by(F.struct("method", "alpha"), F.struct("coverage", -F.col("alpha"), "method")).alias("b")).first()["b"]
    won = (F.col("method") == best["method"]) & (F.col("alpha") == best["alpha"]) if best else F.lit(False)
    return grid.withColumn("winner", won)


@query("d28_masked_controllers")
def masked_controllers(spark, sf):
    a = _linear(spark, sf, alpha=0.15).select("row_id", F.col("greedy_action").alias("cql"), "action")
    b = _linear(spark, sf, alpha=0.0, epochs=3, quantiles=[0.05, 0.25, 0.5, 0.75, 0.95]).select("row_id", F.col("greedy_action").alias("cvar"))
    return a.join(b, "row_id").groupBy("cql", "cvar").agg(F.count(F.lit(1)).alias("n"), cond_rate(F.col("cql") == F.col("action")).alias("logged_agreement"))
