"""Outcome models of candidate actions, fitted on logged rows: what decisions rank and gate on.

A row's state is a bin: downlink load by radio quality, thirds of the policy role's training rows
each. Every estimate of a (slice, action, bin) is a mean drawn towards the mean of its (slice, action),
itself drawn towards the slice, with the weight of `strength` rows. From such means come

* the three cost critics of either role,
* out-of-fold predictions by episode folds, the residuals of which, scaled by each cost's spread and
  capped at their 98 % quantile, are the target of the uncertainty critic,
* fitted Q: the mean of utility plus the discounted best value of the next state's bin,
* the behaviour prior (how often an action was logged in the bin; never logged is zero) and local
  support (rows of both roles in the bin),
* the out-of-distribution score: distance of the context from its median in units of the 10-90 %
  spread, as a logistic curve over the training rows' median and 95 % quantile.

Rows are read in aggregates and one join with a table of cells. The driver holds sums by (slice,
action, bin, fold) and (slice, action, bin, next bin), whose size follows the action catalogue, not the
rows; more than `MOST_CELLS` stop the job.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.config import ObjectiveSettings
from policylake.constants import CONTEXT_COLUMNS
from policylake.functions.core import clip, uniform
from policylake.functions.dims import constant
from policylake.operators.quantiles import quantiles
from policylake.sources.sinks import staged

LOAD, RADIO = "dl_buffer_bytes", "dl_cqi"
BINS = 9
STRENGTH = 8.0
LOCAL_ROWS = 10  # rows of either role in a bin that make an action locally supported
COSTS = ("sla", "energy", "stability")
LEAST_SPREAD, RESIDUAL_CAP, LEAST_CAP = 0.05, 0.98, 1e-6
MOST_CELLS = 500_000
_PROBS = [0.10, 1 / 3, 0.50, 2 / 3, 0.90]


@dataclass(frozen=True)
class StateScale:
    """Thirds of load and radio quality; median and spread of every context feature."""

    thirds: dict[str, tuple[float, float]]
    context: dict[str, tuple[float, float]]

    def bin(self, prefix: str = "") -> Column:
        def third(c: str) -> Column:
            low, high = self.thirds[c]
            value = F.col(f"{prefix}{c}")
            return (value > low).cast("int") + (value > high).cast("int")

        return third(LOAD) * 3 + third(RADIO)

    def distance(self) -> Column:
        total = sum(((F.col(c) - m) / s) * ((F.col(c) - m) / s) for c, (m, s) in self.context.items())
        return F.sqrt(total / float(len(self.context)))


def fit_scale(rows: DataFrame) -> StateScale:
    q = quantiles(rows, [], {c: _PROBS for c in CONTEXT_COLUMNS}).first()
    spread = {c: q[f"{c}_4"] - q[f"{c}_0"] for c in CONTEXT_COLUMNS}
    return StateScale(
        {c: (q[f"{c}_1"], q[f"{c}_3"]) for c in (LOAD, RADIO)},
        {c: (q[f"{c}_2"], spread[c] if spread[c] > 0 else 1.0) for c in CONTEXT_COLUMNS},
    )


def episode_fold(folds: int) -> Column:
    """Fold of a row, a hash of its episode: episodes never split."""
    return F.floor(uniform("fold", F.col("episode_id")) * folds).cast("int")


def drawn_means(n: np.ndarray, total: np.ndarray, strength: float = STRENGTH) -> np.ndarray:
    """Means by (slice, action, bin) drawn towards those of (slice, action) and the slice."""
    cell_n, cell = n.sum(axis=2), total.sum(axis=2)
    with np.errstate(invalid="ignore"):
        slice_mean = cell.sum(axis=1) / cell_n.sum(axis=1)
    cell_mean = (cell + strength * slice_mean[:, None]) / (cell_n + strength)
    return (total + strength * cell_mean[:, :, None]) / (n + strength)


@dataclass(frozen=True)
class OutcomeModel:
    """Cell estimates by (slice, bin) and what scores a row."""

    cells: DataFrame
    scale: StateScale
    far: tuple[float, float]  # median and 95 % quantile of the training distance
    cap: float
    spread: dict[str, float]

    def ood(self) -> Column:
        mid, high = self.far
        return 1.0 / (1.0 + F.exp(-(self.scale.distance() - high) / max(high - mid, LEAST_CAP)))


FIELDS = (*COSTS, "unc", "q", "w", "sup", "e_sla", "e_energy", "e_stability")


def _collected(df: DataFrame):
    table = df.limit(MOST_CELLS + 1).toArrow()
    if table.num_rows > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of actions and states")
    return table.to_pylist()


def prepared_rows(rows: DataFrame, scale: StateScale, folds: int) -> DataFrame:
    """The narrow table that fitting reads several times."""
    return staged(
        rows.select(
            "row_id", "slice_type", "action", scale.bin().alias("bin"), scale.bin("next_").alias("next_bin"), episode_fold(folds).alias("fold"),
            *[F.col(f"{c}_cost").alias(c) for c in COSTS], "utility", "done", scale.distance().alias("distance"),
        ),
        "outcome-rows",
    )


def residual_rows(rows: DataFrame, oof: DataFrame, spread: dict[str, float]) -> DataFrame:
    """Out-of-fold predictions `p_<cost>` and the mean scaled residual `raw` of every row."""
    joined = rows.join(oof, ["slice_type", "action", "bin", "fold"])
    parts = [F.abs(F.col(c) - F.col(f"p_{c}")) / max(spread[c], LEAST_SPREAD) for c in COSTS]
    return joined.withColumn("raw", sum(parts[1:], parts[0]) / 3.0)


@dataclass(frozen=True)
class Fit:
    """Sums by cell as arrays over (slice, action, bin[, fold])."""

    slices: list[str]
    actions: list[str]
    n: np.ndarray
    sums: dict[str, np.ndarray]


def summed(rows: DataFrame, values: list[str], folds: int) -> Fit:
    """Counts and sums of the values by cell and fold."""
    got = _collected(rows.groupBy("slice_type", "action", "bin", "fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(v) for v in values]))
    slices, actions = sorted({r["slice_type"] for r in got}), sorted({r["action"] for r in got})
    shape = (len(slices), len(actions), BINS, folds)
    n, sums = np.zeros(shape), {v: np.zeros(shape) for v in values}
    for r in got:
        at = (slices.index(r["slice_type"]), actions.index(r["action"]), r["bin"], r["fold"])
        n[at] = r["n"]
        for v in values:
            sums[v][at] = r[v]
    return Fit(slices, actions, n, sums)


def out_of_fold(spark, fit: Fit, every: bool = False) -> DataFrame:
    """Predictions by (slice, action, bin, fold) from the rows of the other folds.

    With `every` also where the fold has no row, for other rows routed by fold.
    """
    rows = []
    seen = fit.n.sum(axis=(2, 3)) > 0
    for k in range(fit.n.shape[3]):
        others = [i for i in range(fit.n.shape[3]) if i != k]
        n = fit.n[..., others].sum(axis=3)
        p = {c: drawn_means(n, fit.sums[c][..., others].sum(axis=3)) for c in COSTS}
        present = np.broadcast_to(seen[:, :, None], n.shape) if every else fit.n[..., k]
        for s, a, b in zip(*np.nonzero(present), strict=True):
            rows.append((fit.slices[s], fit.actions[a], int(b), k, *(float(p[c][s, a, b]) if np.isfinite(p[c][s, a, b]) else None for c in COSTS)))
    return constant(spark, rows, "slice_type string, action string, bin int, fold int, " + ", ".join(f"p_{c} double" for c in COSTS))


def fitted_q(fit: Fit, moves: np.ndarray, gamma: float, rounds: int) -> np.ndarray:
    """Value by (slice, action, bin); `moves` counts next bins of rows that are not final."""
    n, utility = fit.n.sum(axis=3), fit.sums["utility"].sum(axis=3)
    logged = n.sum(axis=2) > 0
    q = drawn_means(n, utility)
    for _ in range(rounds - 1):
        best = np.where(logged[:, :, None], q, -np.inf).max(axis=1)
        q = drawn_means(n, utility + gamma * np.einsum("sabc,sc->sab", moves, np.where(np.isfinite(best), best, 0.0)))
    return q


def uncertainty(rows: DataFrame, fit: Fit, folds: int) -> tuple[DataFrame, float, dict[str, float]]:
    """Rows with out-of-fold residuals, their cap, and the spread of each cost."""
    found = rows.agg(*[F.stddev_pop(c).alias(c) for c in COSTS]).first()
    spread = {c: float(found[c]) for c in COSTS}
    judged = staged(residual_rows(rows, out_of_fold(rows.sparkSession, fit), spread), "residuals")
    cap = max(quantiles(judged, [], {"raw": [RESIDUAL_CAP]}).first()["raw_0"], LEAST_CAP)
    return judged.withColumn("target", clip(F.col("raw") / cap, 0.0, 1.0)), cap, spread


def fit(policy_rows: DataFrame, evaluator_rows: DataFrame, catalogue: list, cfg: ObjectiveSettings) -> OutcomeModel:
    """`catalogue` has (slice, action, idx, fallback) of the cells that candidates are drawn from."""
    spark, folds = policy_rows.sparkSession, cfg.folds
    scale = fit_scale(policy_rows)
    rows = prepared_rows(policy_rows, scale, folds)
    sums = summed(rows, [*COSTS, "utility"], folds)
    moves = np.zeros((*sums.n.shape[:3], BINS))
    for r in _collected(rows.where("NOT done").groupBy("slice_type", "action", "bin", "next_bin").agg(F.count(F.lit(1)).alias("n"))):
        moves[sums.slices.index(r["slice_type"]), sums.actions.index(r["action"]), r["bin"], r["next_bin"]] = r["n"]
    far = quantiles(rows, [], {"distance": [0.50, 0.95]}).first()
    judged, cap, spread = uncertainty(rows, sums, folds)
    targets = summed(judged, ["target"], folds)

    n = sums.n.sum(axis=3)
    policy = {c: drawn_means(n, sums.sums[c].sum(axis=3)) for c in COSTS}
    policy["unc"] = drawn_means(targets.n.sum(axis=3), targets.sums["target"].sum(axis=3))
    policy["q"] = fitted_q(sums, moves, cfg.gamma, cfg.q_iterations)
    theirs = evaluator_rows.select("slice_type", "action", scale.bin().alias("bin"), F.lit(0).alias("fold"), *[F.col(f"{c}_cost").alias(c) for c in COSTS])
    other = summed(theirs, list(COSTS), 1)
    e_n = other.n.sum(axis=3)
    evaluator = {f"e_{c}": drawn_means(e_n, other.sums[c].sum(axis=3)) for c in COSTS}

    by_slice: dict[str, list] = defaultdict(list)
    for r in catalogue:
        by_slice[r["slice_type"]].append(r)
    table = []
    for name, cells in by_slice.items():
        s, e = sums.slices.index(name), other.slices.index(name)
        for b in range(BINS):
            ours = [(sums.actions.index(c["action"]), other.actions.index(c["action"])) for c in cells]
            seen = sum(n[s, a, b] for a, _ in ours) > 0
            array = []
            for c, (a, ea) in sorted(zip(cells, ours, strict=True), key=lambda x: x[0]["idx"]):
                prior = float(n[s, a, b] if seen else n[s, a].sum())
                local = bool(n[s, a, b] >= LOCAL_ROWS and e_n[e, ea, b] >= LOCAL_ROWS)
                array.append((c["idx"], c["action"], *[float(policy[f][s, a, b]) for f in (*COSTS, "unc", "q")], prior, local, *[float(v[e, ea, b]) for v in evaluator.values()]))
            table.append((name, b, array, cells[0]["fallback"]))
    kinds = ", ".join(f"{f}: {'boolean' if f == 'sup' else 'double'}" for f in FIELDS)
    frame = spark.createDataFrame(
        [(name, b, [dict(zip(("idx", "action", *FIELDS), x, strict=True)) for x in array], fb) for name, b, array, fb in table],
        f"slice_type string, bin int, cells array<struct<idx: int, action: string, {kinds}>>, fallback string",
    )
    return OutcomeModel(F.broadcast(frame), scale, (far["distance_0"], far["distance_1"]), cap, spread)


# ---- cluster cross-fit and paired advantage ------------------------------------------------

CLUSTER = ("scenario", "training_config", "experiment")


def cluster_fold(folds: int) -> Column:
    """Fold of a row, a hash of its cluster."""
    return F.floor(uniform("cluster", F.concat_ws("/", *CLUSTER)) * folds).cast("int")


def crossfit_predictions(train: DataFrame, rows: DataFrame, scale: StateScale, folds: int) -> DataFrame:
    """Rows with the three costs predicted for their own action by a model that saw no row of their
    cluster: a cluster's fold picks the model, which is fitted on the other folds. `saw_cluster` counts
    training rows of the cluster that the model used (none). Predictions are null for an action that the
    training rows of the slice never took."""
    slim = train.select("slice_type", "action", scale.bin().alias("bin"), cluster_fold(folds).alias("fold"), *CLUSTER, *[F.col(f"{c}_cost").alias(c) for c in COSTS])
    slim = staged(slim, "crossfit-train")
    table = out_of_fold(train.sparkSession, summed(slim, list(COSTS), folds), every=True)
    used = slim.groupBy(*CLUSTER, F.col("fold").alias("used_fold")).agg(F.count(F.lit(1)).alias("used"))
    asked = rows.withColumns({"bin": scale.bin(), "fold": cluster_fold(folds)}).join(table, ["slice_type", "action", "bin", "fold"], "left")
    seen = F.when(F.col("used_fold") != F.col("fold"), F.col("used")).otherwise(0)
    return asked.join(used, list(CLUSTER), "left").withColumn("saw_cluster", F.coalesce(seen, F.lit(0))).drop("used", "used_fold", "bin")


#: Cumulative probabilities of a Poisson count of mean 1: how often a replicate takes an episode.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563)


def multiplicity(replicate: Column) -> Column:
    draw = uniform("advantage", replicate, F.col("episode_id"))
    return sum([(draw >= p).cast("int") for p in POISSON[1:]], (draw >= POISSON[0]).cast("int"))


def advantages(train: DataFrame, scale: StateScale, catalogue: list, replicates: int, quantile: float = 0.05) -> DataFrame:
    """Per (slice, bin, incumbent) the action whose paired advantage has the highest lower quantile.

    Every replicate draws episodes with repetition; all are summed in one pass over the episodes' sums,
    and an advantage is the difference of two actions within a replicate.
    """
    spark = train.sparkSession
    by_episode = train.groupBy("episode_id", "slice_type", "action", scale.bin().alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("utility").alias("u"))
    drawn = by_episode.select("*", F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), multiplicity).alias("w"))
    got = _collected(drawn.groupBy("slice_type", "action", "bin").agg(
        *[F.sum(F.col("w")[r] * F.col("n")).alias(f"n{r}") for r in range(replicates)], *[F.sum(F.col("w")[r] * F.col("u")).alias(f"u{r}") for r in range(replicates)]))
    slices, actions = sorted({r["slice_type"] for r in got}), sorted({r["action"] for r in got})
    n, u = (np.zeros((replicates, len(slices), len(actions), BINS)) for _ in range(2))
    for row in got:
        at = slices.index(row["slice_type"]), actions.index(row["action"]), row["bin"]
        for r in range(replicates):
            n[(r, *at)], u[(r, *at)] = row[f"n{r}"], row[f"u{r}"]
    value = np.stack([drawn_means(n[r], u[r]) for r in range(replicates)])
    out = []
    for name in slices:
        cells = sorted((c for c in catalogue if c["slice_type"] == name), key=lambda c: c["idx"])
        at = [actions.index(c["action"]) for c in cells]
        for b in range(BINS):
            q = value[:, slices.index(name), at, b]
            for i, incumbent in enumerate(cells):
                lower = np.quantile(q - q[:, i : i + 1], quantile, axis=0)
                others = [(-round(float(lower[j]), 12), c["idx"], c["action"], float(lower[j])) for j, c in enumerate(cells) if j != i]
                if others:
                    best = min(others)
                    out.append((name, b, incumbent["action"], best[2], best[3]))
    return constant(spark, out, "slice_type string, bin int, current_action string, candidate string, lower double")
