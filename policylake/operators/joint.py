"""Joint decisions of the three slices of a base-station second."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policylake.constants import SLICE_NAMES, STATE_COLUMNS
from policylake.functions.core import action_prb, cond_rate, decision_list, reasons, rounded
from policylake.functions.dims import constant, freeze
from policylake.operators.quantiles import quantiles

GROUP = ["publication_split", "scenario", "training_config", "experiment", "base_station", "timestamp_s"]


@dataclass(frozen=True)
class JointProfile:
    name: str
    minimum_advantage: float = 0.0
    uncertainty_penalty: float = 0.0
    switching_penalty: float = 0.0


# fixed values: the seven joint profiles; the first keeps the reference actions
JOINT_PROFILES = [
    JointProfile("original"),
    JointProfile("joint_utility"),
    JointProfile("joint_margin_005", 0.005),
    JointProfile("joint_margin_010", 0.010),
    JointProfile("joint_uncertainty_025", 0.005, 0.025),
    JointProfile("joint_uncertainty_050", 0.005, 0.050),
    JointProfile("joint_switch_010", 0.005, 0.025, 0.010),
]
# fixed values: target shares of the shadow modes (eMBB, mMTC, URLLC)
TARGET_SHARES = {"balanced": (0.50, 0.20, 0.30), "urllc_priority": (0.35, 0.20, 0.45), "embb_priority": (0.60, 0.20, 0.20)}


def representatives(rows: DataFrame) -> DataFrame:
    """One row per (base-station second, slice): mean KPIs over UEs, first action, counts.

    Values and counts come from one aggregate, so no join of two aggregates is needed.
    """
    numeric = [*STATE_COLUMNS, *[f"next_{c}" for c in STATE_COLUMNS]]
    return rows.groupBy(*GROUP, "slice_type").agg(
        *[F.avg(c).alias(c) for c in numeric],
        F.min_by("action", "imsi_file").alias("action"),
        F.countDistinct("action").alias("action_variants"),
        F.max("done").alias("done"),
        F.count(F.lit(1)).alias("source_ue_rows"),
    )


def complete_groups(rep: DataFrame) -> DataFrame:
    """Keys of the seconds that have all three slices."""
    n = rep.groupBy(*GROUP).agg(F.countDistinct("slice_type").alias("k"))
    return n.filter(F.col("k") == 3).select(*GROUP)


def aligned(rep: DataFrame) -> DataFrame:
    """Rows of complete seconds only; missing slices are never filled."""
    return rep.join(complete_groups(rep), GROUP, "left_semi")


def alignment_report(rep: DataFrame) -> DataFrame:
    per = rep.groupBy(*GROUP).agg(F.countDistinct("slice_type").alias("k"), F.count_if(F.col("action_variants") > 1).alias("mixed"))
    return per.agg(
        F.count(F.lit(1)).alias("all_seconds"), F.count_if(F.col("k") == 3).alias("complete_seconds"),
        F.count_if(F.col("k") != 3).alias("missing_seconds"), rounded(cond_rate(F.col("k") == 3)).alias("alignment_rate"),
        F.sum("mixed").alias("mixed_action_slice_seconds"),
    )


# ---- queue-priority shadow -----------------------------------------------------------------

def slice_pivot(rows: DataFrame) -> DataFrame:
    """Mean buffer, PRBs and reward per slice as columns; incomplete seconds are dropped."""
    p = rows.groupBy(*GROUP).pivot("slice_type", SLICE_NAMES).agg(
        F.avg("dl_buffer_bytes").alias("queue"), F.avg("slice_prb").alias("prb"), F.avg("reward").alias("reward")
    )
    return p.dropna(subset=[f"{s}_queue" for s in SLICE_NAMES])


def queue_priority(urllc: Column, embb: Column) -> Column:
    return decision_list([(urllc > 0.45, "urllc_priority"), (embb > 1.0, "embb_priority")], "balanced")


def fit_queue_scales(pivoted: DataFrame, quantile: float = 0.90) -> dict[str, float]:
    train = pivoted.filter("publication_split = 'train'")
    found = quantiles(train, [], {f"{s}_queue": [quantile] for s in ("eMBB", "URLLC")}).first()
    scales = {s: found[f"{s}_queue_0"] if found else None for s in ("eMBB", "URLLC")}
    if any(v is None or not v > 0 for v in scales.values()):
        raise ValueError("training rows give no positive buffer scale")
    return scales


def shadow(pivoted: DataFrame, scales: dict[str, float]) -> DataFrame:
    """Mode, target shares and L1 distance to the recorded shares, from recorded buffers only."""
    out = pivoted.withColumns(
        {"embb_norm": F.col("eMBB_queue") / scales["eMBB"], "urllc_norm": F.col("URLLC_queue") / scales["URLLC"]}
    ).withColumn("mode", queue_priority(F.col("urllc_norm"), F.col("embb_norm")))
    total = sum((F.col(f"{s}_prb") for s in SLICE_NAMES), start=F.lit(0.0))
    target = {
        s: decision_list([(F.col("mode") == m, v[i]) for m, v in TARGET_SHARES.items()], F.lit(None).cast("double"))
        for i, s in enumerate(SLICE_NAMES)
    }
    distance = sum((F.abs(target[s] - F.col(f"{s}_prb") / total) for s in SLICE_NAMES), start=F.lit(0.0))
    return out.withColumns({f"target_{s}": c for s, c in target.items()}).withColumn("l1", F.when(total > 0, distance))


def shadow_coverage(rows: DataFrame, recommended: DataFrame) -> DataFrame:
    """Alignment and mode counts per split, zero-filled."""
    all_seconds = rows.select(*GROUP).distinct().groupBy("publication_split").agg(F.count(F.lit(1)).alias("all_seconds"))
    per = recommended.groupBy("publication_split").agg(
        F.count(F.lit(1)).alias("aligned"), *[F.count_if(F.col("mode") == m).alias(m) for m in TARGET_SHARES]
    )
    out = all_seconds.join(per, "publication_split", "left").na.fill(0)
    return out.withColumn("rate", rounded(F.col("aligned") / F.col("all_seconds")))


# ---- capacity ------------------------------------------------------------------------------

# fixed values: carrier PRBs by (bandwidth MHz, subcarrier spacing kHz), 3GPP TS 38.104 FR1
CARRIER_PRBS = {
    (5, 15): 25, (5, 30): 11, (10, 15): 52, (10, 30): 24, (10, 60): 11, (15, 15): 79, (15, 30): 38, (15, 60): 18,
    (20, 15): 106, (20, 30): 51, (20, 60): 24, (25, 15): 133, (25, 30): 65, (25, 60): 31, (30, 15): 160, (30, 30): 78,
    (30, 60): 38, (40, 15): 216, (40, 30): 106, (40, 60): 51, (50, 15): 270, (50, 30): 133, (50, 60): 65, (60, 30): 162,
    (60, 60): 79, (70, 30): 189, (70, 60): 93, (80, 30): 217, (80, 60): 107, (90, 30): 245, (90, 60): 121,
    (100, 30): 273, (100, 60): 135,
}
# fixed values: share catalogue (eMBB, mMTC, URLLC)
SHARES = [
    (.34, .33, .33), (.50, .20, .30), (.35, .20, .45), (.60, .20, .20), (.40, .35, .25), (.40, .15, .45),
    (.25, .25, .50), (.50, .30, .20), (.20, .40, .40), (.20, .20, .60), (.65, .15, .20), (.30, .45, .25),
    (.40, .40, .20), (.30, .20, .50), (.45, .30, .25), (.25, .45, .30), (.25, .15, .60), (.45, .15, .40),
]


def available_prbs(cells: DataFrame) -> DataFrame:
    """Join the carrier table on (bandwidth, spacing); unsupported pairs keep a null."""
    dim = constant(cells.sparkSession, [(b, s, n) for (b, s), n in CARRIER_PRBS.items()], "bandwidth_mhz long, scs_khz long, carrier_prbs long")
    out = cells.join(dim, ["bandwidth_mhz", "scs_khz"], "left")
    ok = F.col("reserved_prbs").between(0, F.col("carrier_prbs") - 1)
    return out.withColumn("available_prbs", F.when(ok, F.col("carrier_prbs") - F.col("reserved_prbs")))


def largest_remainder(remaining: Column, shares: list[Column]) -> list[Column]:
    """Integer split of `remaining` by shares; leftover units go to the largest fractions, first on ties."""
    raw = [remaining * s for s in shares]
    base = [F.floor(r) for r in raw]
    frac = [F.round(r - b, 9) for r, b in zip(raw, base, strict=True)]
    left = remaining - sum(base[1:], start=base[0])
    out = []
    for i in range(3):
        ahead = sum(
            (F.when((frac[j] > frac[i]) | ((frac[j] == frac[i]) & F.lit(j < i)), 1).otherwise(0) for j in range(3) if j != i),
            start=F.lit(0),
        )
        out.append((base[i] + F.when(ahead < left, 1).otherwise(0)).cast("long"))
    return out


def share_catalogue(cells: DataFrame, minimum: int = 1) -> DataFrame:
    """Integer allocations of the share catalogue per cell, without duplicates."""
    shares = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("se", "sm", "su"), s, strict=True)]) for s in SHARES])
    long = cells.select("*", F.inline(shares))
    parts = largest_remainder(F.col("usable") - 3 * minimum, [F.col(c) for c in ("se", "sm", "su")])
    return long.select(
        *cells.columns, *[(p + minimum).alias(n) for p, n in zip(parts, ("prb_embb", "prb_mmtc", "prb_urllc"), strict=True)]
    ).distinct()


def project_request(df: DataFrame, minimum: int = 1) -> DataFrame:
    """Nearest feasible integer allocation to (want_e, want_m, want_u) within `usable` PRBs.

    A request inside the budget only lifts small values to the minimum. Otherwise every feasible
    pair of the first two slices is compared, usable^2 / 2 of them for each distinct request.
    """
    keys = ["want_e", "want_m", "want_u", "usable"]
    todo = df.select(*keys).distinct()
    def options() -> Column:
        span = F.sequence(F.lit(minimum).cast("long"), F.col("usable").cast("long"))
        pairs = F.flatten(F.transform(span, lambda e: F.transform(span, lambda m: F.struct(e.alias("e"), m.alias("m")))))
        feasible = F.filter(pairs, lambda p: p["e"] + p["m"] + minimum <= F.col("usable"))
        def best_u(p: Column) -> Column:
            return F.greatest(F.lit(minimum), F.least(F.col("want_u"), F.col("usable") - p["e"] - p["m"]))
        def cost(p: Column) -> Column:
            u = best_u(p)
            return F.pow(p["e"] - F.col("want_e"), 2) + F.pow(p["m"] - F.col("want_m"), 2) + F.pow(u - F.col("want_u"), 2)
        return F.array_min(F.transform(feasible, lambda p: F.struct(
            cost(p).cast("long").alias("cost"), (-(p["e"] + p["m"] + best_u(p))).alias("nused"), p["e"].alias("e"), p["m"].alias("m"), best_u(p).alias("u"))))
    solved = todo.withColumn("b", options()).select(*keys, F.col("b.e").alias("got_e"), F.col("b.m").alias("got_m"), F.col("b.u").alias("got_u"))
    return df.join(solved, keys)


def manifest_errors() -> Column:
    c = F.col
    return reasons(
        (~c("total_prbs").between(1, 275), "total_prbs"),
        ((c("reserved_prbs") < 0) | (c("reserved_prbs") >= c("total_prbs")), "reserved_prbs"),
        (~c("numerology").between(0, 5), "numerology"),
        (c("source").isin("historical_allocation_quantile", "trace", "unknown"), "source"),
    )


def allocation_errors(names: tuple[str, str, str], usable: str, minimum: int = 1) -> Column:
    total = sum((F.col(n) for n in names), start=F.lit(0))
    low = F.least(*[F.col(n) for n in names]) < minimum
    return reasons((low, "below_minimum"), (total > F.col(usable), "over_budget"), (~F.col("scheduler").isin("round_robin", "waterfilling", "proportional_fair"), "scheduler"))


def with_budget(rows: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Budget of the base station, or the smallest known budget where it is missing."""
    dim = constant(rows.sparkSession, list(budgets.items()), "base_station string, budget int")
    out = rows.join(dim, "base_station", "left")
    return out.withColumn("budget", F.coalesce("budget", F.lit(min(budgets.values()))))


# ---- knapsack ------------------------------------------------------------------------------

def compressed(value: Callable[[Column], Column], eligible: Callable[[Column], Column]) -> Column:
    """Best eligible candidate per PRB cost: the rest can never be part of an optimum."""
    scored = F.transform(
        F.filter("cand", eligible),
        lambda c: F.struct(action_prb(c["action"]).alias("cost"), (-F.round(value(c), 12)).alias("nv"), c["idx"].alias("idx")),
    )
    ordered = F.array_sort(scored)
    return F.filter(
        ordered, lambda x: ~F.exists(ordered, lambda y: (y["cost"] == x["cost"]) & ((y["nv"] < x["nv"]) | ((y["nv"] == x["nv"]) & (y["idx"] < x["idx"]))))
    )


def group_row(rows: DataFrame, extra: list[str]) -> DataFrame:
    """One row per complete second with each slice's struct in its own column."""
    s = F.struct("options", *extra)
    g = rows.groupBy(*GROUP).agg(
        *[F.max(F.when(F.col("slice_type") == n, s)).alias(n) for n in SLICE_NAMES], F.max("budget").alias("budget")
    )
    return g.filter(" AND ".join(f"{n} IS NOT NULL" for n in SLICE_NAMES))


def knapsack() -> Column:
    """Best (score, least cost) choice of one option per slice within the budget, or null.

    A slice keeps one option per distinct PRB cost, so the product stays small.
    """
    triples = F.flatten(F.transform(
        F.col("eMBB.options"), lambda e: F.flatten(F.transform(
            F.filter("mMTC.options", lambda m: e["cost"] + m["cost"] <= F.col("budget")),
            lambda m: F.transform(
                F.filter("URLLC.options", lambda u: e["cost"] + m["cost"] + u["cost"] <= F.col("budget")),
                lambda u: F.struct(
                    F.round(e["nv"] + m["nv"] + u["nv"], 9).alias("nv"), (e["cost"] + m["cost"] + u["cost"]).alias("cost"),
                    e["idx"].alias("e"), m["idx"].alias("m"), u["idx"].alias("u")))))))
    return F.array_min(triples)
