"""Governed policy decisions on KPI snapshots.

One snapshot has at most seven candidate policies, a fixed catalogue. Candidates therefore live
in an array column of the snapshot's row, so a decision over any number of rows needs no shuffle at
all. Projection, critics and score are plain columns per policy, which Spark compiles; it interprets
lambdas node by node, so these only rank and select.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policylake.constants import (
    DEFAULT_INTENT,
    INTENTS,
    OBJECTIVES,
    OOD_ENVELOPE,
    POLICIES,
    POLICY_FIELDS,
    SERVICE_TARGETS,
    SLICE_WEIGHTS,
)
from policylake.functions.core import clip, decision_list, let, lookup, uniform
from policylake.functions.dims import constant

STATE = ["latency_ms", "packet_loss_pct", "downlink_mbps", "energy_load", "handover_failure_pct",
         "sinr_db", "prb_utilization"]
HORIZON = 3


# ---- labels --------------------------------------------------------------------------------

def expert_label() -> Column:
    """Seven-branch expert decision list of a KPI snapshot."""
    c = F.col
    load = c("throughput_demand_mbps") / F.greatest(c("downlink_mbps"), F.lit(1.0))
    return decision_list(
        [
            ((c("rsrp_dbm") < -112) | (c("sinr_db") < 1.5) | (c("handover_failure_pct") > 5.0), "coverage_recovery"),
            (
                (c("slice_type") == "URLLC")
                & ((c("latency_ms") > 12.0) | (c("packet_loss_pct") > 0.35) | (c("prb_utilization") > 0.88)),
                "latency_guard",
            ),
            ((c("prb_utilization") > 0.93) | (c("packet_loss_pct") > 2.2) | (load > 1.48), "congestion_relief"),
            (
                (c("slice_type") == "mMTC") & ((c("active_users") > 700) | (c("packet_loss_pct") > 1.1)),
                "massive_iot_access",
            ),
            (
                (c("slice_type") == "eMBB") & ((load > 1.15) | (c("throughput_demand_mbps") > 180.0)),
                "throughput_boost",
            ),
            ((c("prb_utilization") < 0.38) & (c("energy_load") < 0.48) & (load < 0.90), "energy_saver"),
        ],
        "balanced",
    )


def heuristic_candidate() -> Column:
    """The policy a simple operator rule would always put on the candidate list."""
    c = F.col
    return decision_list(
        [
            ((c("rsrp_dbm") < -112.0) | (c("sinr_db") < 1.5) | (c("handover_failure_pct") > 5.0), "coverage_recovery"),
            (
                (c("slice_type") == "URLLC") & ((c("latency_ms") > 12.0) | (c("packet_loss_pct") > 0.35)),
                "latency_guard",
            ),
            ((c("prb_utilization") > 0.93) | (c("packet_loss_pct") > 2.2), "congestion_relief"),
            ((c("slice_type") == "mMTC") & (c("active_users") > 700), "massive_iot_access"),
            (
                (c("slice_type") == "eMBB") & (c("throughput_demand_mbps") > c("downlink_mbps") * 1.15),
                "throughput_boost",
            ),
            ((c("prb_utilization") < 0.38) & (c("energy_load") < 0.48), "energy_saver"),
        ],
        "balanced",
    )


# ---- out-of-distribution and uncertainty ---------------------------------------------------

def envelope_penalties() -> list[Column]:
    parts = []
    for name, (low, high) in OOD_ENVELOPE.items():
        v = F.col(name).cast("double")
        span = max(high - low, 1e-9)
        below = F.least(F.lit(1.0), (low - v) / span * 5.0 + 0.35)
        above = F.least(F.lit(1.0), (v - high) / span * 5.0 + 0.35)
        edge = F.least(v - low, high - v) / span
        inside = F.greatest(F.lit(0.0), 0.12 - edge) * 0.6
        parts.append(F.when(v < low, below).when(v > high, above).otherwise(inside))
    return parts


def half_up_4(c: Column) -> Column:
    """Round to 4 decimals by plain arithmetic, so that ties fall the same way on any engine."""
    return F.floor(c * 10000.0 + 0.5) / 10000.0


def round_6(c: Column) -> Column:
    """`F.round(c, 6)`, by plain arithmetic wherever that gives the same double.

    Below 1e6 the scaled value is off by less than 0.001, so only values nearer to a tie (and larger ones,
    infinities and NaN) need Spark's decimal; elsewhere the whole number is the same and is divided once.
    `c` should be a plain column, as it is read several times.
    """
    scaled = c * 1e6
    clear = (F.abs(c) < 1e6) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(clear, F.floor(scaled + 0.5) / 1e6).otherwise(F.round(c, 6))


def ood_score() -> Column:
    p = envelope_penalties()
    total = reduce(lambda a, b: a + b, p)
    return half_up_4(F.least(F.lit(1.0), F.greatest(*p) * 0.7 + total / len(OOD_ENVELOPE) * 0.3))


def normalised_entropy(probabilities: list[Column]) -> Column:
    if not probabilities:
        return F.lit(1.0)
    p = [F.greatest(x, F.lit(1e-12)) for x in probabilities]
    total = reduce(lambda a, x: a + x, p, F.lit(0.0))
    h = reduce(lambda a, x: a - (x / total) * F.ln(x / total), p, F.lit(0.0))
    return F.least(F.lit(1.0), h / F.ln(F.lit(float(max(len(p), 2)))))


def telemetry_penalty() -> Column:
    age = F.least(F.lit(1.0), F.col("telemetry_age_ms") / 5000.0)
    return F.least(F.lit(1.0), 0.6 * age + 0.4 * (1.0 - F.col("telemetry_completeness")))


def uncertainty_level(combined: Column) -> Column:
    return decision_list([(combined < 0.30, "low"), (combined < 0.55, "moderate"), (combined < 0.78, "high")], "critical")


def twin_uncertainty(horizon: int = HORIZON) -> float:
    return min(0.55, 0.10 + 0.05 * max(0, horizon - 1))


def with_uncertainty(df: DataFrame, probabilities: list[Column], horizon: int = HORIZON) -> DataFrame:
    """Needs `ood`; adds entropy, telemetry penalty, raw combined value, level, rounded value."""
    out = df.withColumns({"entropy": normalised_entropy(probabilities), "telemetry": telemetry_penalty()})
    combined = F.least(
        F.lit(1.0),
        0.32 * F.col("entropy") + 0.30 * F.col("ood") + 0.20 * F.col("telemetry") + 0.18 * twin_uncertainty(horizon),
    )
    out = out.withColumn("combined", combined)
    return out.withColumns(
        {"level": uncertainty_level(F.col("combined")), "uncertainty": half_up_4(F.col("combined"))}
    )


# ---- policy impact -------------------------------------------------------------------------

def policy_array() -> Column:
    """The policy catalogue as a constant array of structs."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("idx"), F.lit(name).alias("policy"),
                *[F.lit(v).alias(f) for f, v in zip(POLICY_FIELDS, values, strict=True)],
            )
            for i, (name, values) in enumerate(POLICIES.items())
        ]
    )


def policy_columns() -> list[dict[str, Column]]:
    """The fields of every policy of the catalogue as literals."""
    return [
        {"idx": F.lit(i), "policy": F.lit(name), **{f: F.lit(v) for f, v in zip(POLICY_FIELDS, values, strict=True)}}
        for i, (name, values) in enumerate(POLICIES.items())
    ]


def initial_state() -> Column:
    return F.struct(*[F.col(s).cast("double").alias(s) for s in STATE])


def _after(p: Column, name: str, steps: int) -> Column:
    """One KPI after `steps` projected steps. Every KPI evolves on its own, so the chain of
    steps mentions its predecessor once and stays linear in the horizon."""
    factors = {
        "latency_ms": ("latency_factor", 0.2), "packet_loss_pct": ("loss_factor", 0.0),
        "downlink_mbps": ("throughput_factor", 0.0), "handover_failure_pct": ("handover_factor", 0.0),
    }
    value = F.col(name).cast("double")
    for k in range(steps):
        gain = 1.0 / (1.0 + 0.55 * k)
        if name in factors:
            factor, floor = factors[name]
            value = F.greatest(F.lit(floor), value * (1.0 + (p[factor] - 1.0) * gain))
        elif name == "energy_load":
            value = clip(value * (1.0 + (p["energy_factor"] - 1.0) * gain), 0.0, 1.5)
        elif name == "sinr_db":
            value = value + p["sinr_delta"] * gain
        else:
            value = clip(value + p["prb_share_delta"] * gain, 0.0, 1.5)
    return value


def projected_states(p: Column, horizon: int = HORIZON) -> Column:
    """Array of unrounded projected states, one per step."""
    return F.array(
        *[F.struct(*[_after(p, s, k + 1).alias(s) for s in STATE]) for k in range(horizon)]
    )


def final_kpis(p: Column, horizon: int = HORIZON) -> Column:
    """State after the last step, recorded with 6 decimals."""
    return F.struct(*[F.round(_after(p, s, horizon), 6).alias(s) for s in STATE])


# ---- intents -------------------------------------------------------------------------------

def intent_table(spark: SparkSession) -> DataFrame:
    """Intent profiles as a dimension; its rows are the fixed profile list."""
    rows = []
    for name, (weights, risk, budget, constraints) in INTENTS.items():
        rows.append(
            (name, *weights, risk, budget,
             [{"metric": m, "operator": o, "value": v, "hard": h} for m, o, v, h in constraints])
        )
    return constant(
        spark, rows,
        "intent string, w_latency double, w_loss double, w_throughput double, w_stability double, "
        "w_energy double, risk_tolerance double, energy_budget double, "
        "constraints array<struct<metric:string,operator:string,value:double,hard:boolean>>",
    )


def resolve_intent(df: DataFrame, requested: Column) -> DataFrame:
    """Named profile where one is requested, else the default of the slice; unknown names fail."""
    wanted = F.coalesce(requested, lookup("slice_type", DEFAULT_INTENT, DEFAULT_INTENT["eMBB"]))
    joined = df.withColumn("intent", wanted).join(intent_table(df.sparkSession), "intent", "left")
    return joined.withColumn(
        "risk_tolerance",
        F.when(F.col("risk_tolerance").isNotNull(), F.col("risk_tolerance")).otherwise(
            F.raise_error(F.concat(F.lit("unknown intent profile: "), "intent")).cast("double")
        ),
    )


# ---- candidate critics ---------------------------------------------------------------------

def utility_score(kpi: Column, weights: dict[str, Column] | None = None) -> Column:
    """Weighted 0-100 score of projected KPIs against the slice's service targets."""
    latency_target = lookup("slice_type", {k: v[0] for k, v in SERVICE_TARGETS.items()})
    loss_target = lookup("slice_type", {k: v[1] for k, v in SERVICE_TARGETS.items()})
    zero = F.lit(0.0)
    parts = {
        "latency": F.exp(-F.greatest(zero, kpi["latency_ms"] - latency_target) / F.greatest(latency_target, F.lit(1.0))),
        "loss": F.exp(-F.greatest(zero, kpi["packet_loss_pct"] - loss_target) / F.greatest(loss_target, F.lit(0.1))),
        "throughput": F.least(F.lit(1.0), kpi["downlink_mbps"] / F.greatest(F.col("throughput_demand_mbps"), F.lit(1.0))),
        "stability": F.exp(-kpi["handover_failure_pct"] / 4.0),
        "energy": clip(1.15 - kpi["energy_load"], 0.0, 1.0),
    }
    if weights is None:
        weights = {
            o: lookup("slice_type", {s: w[i] for s, w in SLICE_WEIGHTS.items()}) for i, o in enumerate(OBJECTIVES)
        }
    total = F.greatest(sum(weights.values(), start=zero), F.lit(1e-9))
    raw = sum((weights[o] * parts[o] for o in OBJECTIVES), start=zero) / total
    overload = F.greatest(zero, kpi["prb_utilization"] - 1.0) * 22.0
    return half_up_4(clip(raw * 100.0 - overload, 0.0, 100.0))


def intent_weights() -> dict[str, Column]:
    return {o: F.col(f"w_{o}") for o in OBJECTIVES}


def _texts(condition: Column, text: Column) -> Column:
    """The text as a list, an empty list where the condition does not hold."""
    return F.when(condition, F.array(text)).otherwise(F.array().cast("array<string>"))


def _listed(rules: list[tuple[Column, Column]]) -> Column:
    """The texts of the rules whose condition holds."""
    return F.concat(*[_texts(condition, text) for condition, text in rules])


def _held(rules: list[tuple[Column, Column]]) -> Column:
    """How many of the rules hold: the size of their list, without building it."""
    return reduce(lambda a, x: a + x, [F.when(condition, 1).otherwise(0) for condition, _ in rules])


def safety_rules(p: Column, kpi: Column) -> list[tuple[Column, Column]]:
    c = F.col
    rules = [
        (F.abs(p["tx_power_db_delta"]) > 3.0, "transmit power change exceeds 3 dB"),
        (
            (p["policy"] == "energy_saver") & (c("slice_type") == "URLLC")
            & ((c("latency_ms") > 8.0) | (c("packet_loss_pct") > 0.1)),
            "energy saving blocked near the URLLC targets",
        ),
        (kpi["prb_utilization"] > 1.18, "PRB pressure above the operating envelope"),
        (
            kpi["packet_loss_pct"] > F.greatest(F.lit(8.0), c("packet_loss_pct") * 1.15 + 0.2),
            "packet loss degrades beyond the margin",
        ),
        (kpi["sinr_db"] < -6.0, "SINR below the service minimum"),
        ((p["policy"] == "throughput_boost") & (c("prb_utilization") > 0.96), "throughput boost in critical congestion"),
        ((p["policy"] == "energy_saver") & (c("rsrp_dbm") < -110.0), "power reduction in weak coverage"),
        (F.abs(p["prb_share_delta"]) > 0.20, "PRB share change exceeds the action envelope"),
    ]
    return [(condition, F.lit(text)) for condition, text in rules]


OOD_BLOCK = "aggressive policy blocked far out of distribution"


def core_rules(p: Column, kpi: Column) -> list[tuple[Column, Column]]:
    blocked = (F.col("ood") > 0.72) & ~p["policy"].isin("balanced", "coverage_recovery")
    return [*safety_rules(p, kpi), (blocked, F.lit(OOD_BLOCK))]


def intent_rules(kpi: Column) -> list[tuple[Column, Column]]:
    """The violated hard constraints of the row's intent; no profile has more than are looked at."""
    def metric(c: Column) -> Column:
        return decision_list([(c["metric"] == s, kpi[s]) for s in STATE], F.lit(None).cast("double"))

    def violated(c: Column) -> Column:
        v = metric(c)
        wrong = ((c["operator"] == "<=") & (v > c["value"])) | ((c["operator"] == ">=") & (v < c["value"]))
        return F.coalesce(wrong & c["hard"], F.lit(False))

    places = [F.get("constraints", F.lit(i)) for i in range(MOST_CONSTRAINTS)]
    return [(violated(c), F.concat_ws(" ", F.lit("intent"), c["metric"], c["operator"])) for c in places]


MOST_CONSTRAINTS = max(len(constraints) for *_, constraints in INTENTS.values())
ENERGY_REASON = "energy load exceeds the intent budget"
UNCERTAINTY_REASON = "combined uncertainty is critical"


def critics(p: dict[str, Column], kpi: dict[str, Column], temporal: Column | None = None) -> dict[str, Column]:
    """Critic verdicts, the ordered list of reasons of one candidate and its length."""
    over = F.coalesce(kpi["energy_load"] > F.col("energy_budget"), F.lit(False))
    warm = kpi["energy_load"] > F.col("energy_load") * 1.20 + 0.03
    critical = F.col("level") == "critical"
    core = core_rules(p, kpi)
    later = [*intent_rules(kpi), (over, F.lit(ENERGY_REASON)), (critical, F.lit(UNCERTAINTY_REASON))]
    between = [] if temporal is None else [temporal]
    return {
        "reasons": F.concat(_listed(core), *between, _listed(later)),
        "count": reduce(lambda a, x: a + F.size(x), between, _held([*core, *later])),
        "energy": decision_list([(over, "reject"), (warm, "warning")], "pass"),
        "uncertainty": decision_list([(critical, "reject"), (F.col("level") == "high", "warning")], "pass"),
    }


# ---- decision ------------------------------------------------------------------------------

def proposals(key: Column) -> Column:
    """Stand-in proposal model: normalised portable uniforms per policy."""
    raw = [uniform("proposal", key, F.lit(n)) for n in POLICIES]
    total = reduce(lambda a, x: a + x, raw, F.lit(0.0))
    return F.array(*[x / total for x in raw])


def top_k_array(probabilities: Column, k: int) -> Column:
    """(probability, policy index) of the k most probable policies, best first; one probability a policy."""
    pairs = [F.struct((-F.get(probabilities, F.lit(i))).alias("np"), F.lit(i).alias("idx")) for i in range(len(POLICIES))]
    return F.slice(F.sort_array(F.array(*pairs)), 1, k)


def top_probabilities(k: int) -> list[Column]:
    """The probabilities in column `top` of `top_k_array`."""
    return [-F.get("top", F.lit(i))["np"] for i in range(min(k, len(POLICIES)))]


def decide(df: DataFrame, probabilities: Column, k: int = 4, horizon: int = HORIZON) -> DataFrame:
    """Governed decision per snapshot; `df` must carry resolved intent columns.

    Candidates are the top-k proposals plus `balanced` and the heuristic policy. The JVM interprets
    methods of more than 8000 bytes, so a stage that needs one runs as separate projections.
    """
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    base = df.withColumn("__p", probabilities).withColumns(
        {"top": top_k_array(F.col("__p"), k), "heuristic": heuristic_candidate(), "ood": ood_score()}
    )
    base = with_uncertainty(base, top_probabilities(k), horizon)

    policies = policy_columns()
    place = [F.array_position(F.col("top.idx"), p["idx"]) for p in policies]
    base = base.withColumns(
        {f"__on{i}": (place[i] > 0) | p["policy"].isin("balanced") | (p["policy"] == F.col("heuristic")) for i, p in enumerate(policies)}
        | {f"__prob{i}": F.when(place[i] > 0, -F.get("top", (place[i] - 1).cast("int"))["np"]).otherwise(0.01) for i in range(len(policies))}
    )
    # columns of their own, as Spark would repeat the expressions of a struct for every use of a field
    base = base.withColumns(
        {f"__raw_{s}{i}": F.when(F.col(f"__on{i}"), _after(p, s, horizon)) for i, p in enumerate(policies) for s in STATE}
    )
    base = base.withColumns({f"__{s}{i}": round_6(F.col(f"__raw_{s}{i}")) for i in range(len(policies)) for s in STATE})
    kpis = [{s: F.col(f"__{s}{i}") for s in STATE} for i in range(len(policies))]
    judged = [critics(p, kpi) for p, kpi in zip(policies, kpis, strict=True)]
    base = base.withColumns(
        {f"__why{i}": F.when(F.col(f"__on{i}"), c["reasons"]) for i, c in enumerate(judged)}
        | {f"__n{i}": F.when(F.col(f"__on{i}"), c["count"]) for i, c in enumerate(judged)}
        | {f"__raw{i}": F.when(F.col(f"__on{i}"), utility_score(kpi, intent_weights())) for i, kpi in enumerate(kpis)}
    )

    def score(i: int) -> Column:
        n, raw = F.col(f"__n{i}"), F.col(f"__raw{i}")
        cut = F.least(F.lit(65.0), 14.0 * F.greatest(n, F.lit(1)))
        return F.when(n > 0, F.greatest(F.lit(0.0), raw - cut)).otherwise(raw)

    base = base.withColumns({f"__score{i}": score(i) for i in range(len(policies))})
    cand = [
        {
            **{name: p[field] for name, field in (("idx", "idx"), ("policy", "policy"), ("tx", "tx_power_db_delta"))},
            "prob": F.col(f"__prob{i}"), "kpi": F.struct(*[kpis[i][s].alias(s) for s in STATE]),
            "critic": F.struct(F.col(f"__why{i}").alias("reasons"), judged[i]["energy"].alias("energy"), judged[i]["uncertainty"].alias("uncertainty")),
            "safe": F.col(f"__n{i}") == 0, "score": F.col(f"__score{i}"),
        }
        for i, p in enumerate(policies)
    ]
    out = _select(base, cand)
    return out.drop("__p", "__best", *[c for c in out.columns if re.fullmatch(rf"__(on|prob|why|n|raw|score|pool|(raw_)?({'|'.join(STATE)}))\d", c)])


def _select(base: DataFrame, cand: list[dict[str, Column]]) -> DataFrame:
    """Ranks scalars of the candidates; whole candidates are built only for the columns that list them."""
    on = [F.col(f"__on{i}") for i in range(len(cand))]
    whole = [F.struct(*[v.alias(name) for name, v in c.items()]) for c in cand]

    def chosen_of(conditions: list[Column]) -> Column:
        """The candidates whose condition holds, in the order of the catalogue."""
        return F.concat(*[F.slice(F.array(v), F.lit(1), F.when(c, 1).otherwise(0)) for c, v in zip(conditions, whole, strict=True)])

    def counted(conditions: list[Column]) -> Column:
        return reduce(lambda a, x: a + x, [F.when(c, 1).otherwise(0) for c in conditions])

    safe = [o & c["safe"] for o, c in zip(on, cand, strict=True)]
    out = base.withColumns({"__cands": counted(on), "__safes": counted(safe)})
    out = out.withColumns({
        f"__pool{i}": o & F.when(F.col("__safes") > 0, c["safe"]).otherwise(c["policy"] == "balanced") for i, (o, c) in enumerate(zip(on, cand, strict=True))
    })
    pool = [F.col(f"__pool{i}") for i in range(len(cand))]
    ranked = [
        F.when(o, F.struct(F.round(c["score"] + 8.0 * c["prob"], 9).alias("rank"), (-c["idx"]).alias("first"), *[c[x].alias(x) for x in ("prob", "safe", "score")]))
        for o, c in zip(pool, cand, strict=True)
    ]
    # `balanced` is always a candidate, so the pool has one and the best is never null
    out = out.withColumn("__best", F.array_max(F.array(*ranked)))

    def best(name: str) -> Column:
        return decision_list([(F.col("__best.first") == -c["idx"], c[name]) for c in cand[:-1]], cand[-1][name])

    out = out.withColumns({
        "cand": chosen_of(on), "safe_cand": chosen_of(safe), "pool": chosen_of(pool),
        "__margin": F.sort_array(F.array(*[F.when(o, c["score"]) for o, c in zip(pool, cand, strict=True)]), asc=False),
        "chosen": F.struct(
            (-F.col("__best.first")).alias("idx"), *[best(x).alias(x) for x in ("policy", "tx")], F.col("__best.prob").alias("prob"),
            *[best(x).alias(x) for x in ("kpi", "critic")], F.col("__best.safe").alias("safe"), F.col("__best.score").alias("score"),
        ),
    })
    top_idx = F.col("top")[0]["idx"]
    refused = reduce(lambda a, x: a | x, [o & (c["idx"] == top_idx) & ~c["safe"] for o, c in zip(on, cand, strict=True)])
    margin = F.col("chosen.score") - F.when(counted(pool) > 1, F.col("__margin")[1]).otherwise(0.0)
    raw = 0.48 + 0.34 * F.col("chosen.prob") + F.least(F.lit(0.18), F.greatest(F.lit(0.0), margin / 100.0))
    confidence = half_up_4(clip(raw * (1.0 - F.least(F.lit(0.45), F.col("uncertainty") * 0.45)), 0.0, 0.99))
    out = out.withColumns(
        {
            "selected_policy": F.col("chosen.policy"),
            "safety_override": (F.col("chosen.idx") != top_idx) & refused,
            "confidence": confidence,
            "utility_score": F.col("chosen.score"),
            "unsafe_candidates": F.col("__cands") - F.col("__safes"),
        }
    )
    limit = F.greatest(F.lit(0.50), 0.78 - F.col("risk_tolerance") * 0.3)
    approved = (
        F.col("chosen.safe") & ~F.col("level").isin("high", "critical")
        & (F.col("ood") <= limit) & (F.col("confidence") >= 0.55)
    )
    return out.withColumn("approved", approved).drop("__cands", "__safes", "__margin")


LOWER_IS_BETTER = ["latency_ms", "packet_loss_pct", "energy_load", "handover_failure_pct"]


def dominates(a: Column, b: Column) -> Column:
    """Pareto dominance of two candidates by their KPIs."""
    no_worse = a["downlink_mbps"] >= b["downlink_mbps"]
    better = a["downlink_mbps"] > b["downlink_mbps"]
    for name in LOWER_IS_BETTER:
        no_worse = no_worse & (a[name] <= b[name])
        better = better | (a[name] < b[name])
    return no_worse & better


def pareto_front(candidates: Column) -> Column:
    """Policies of the candidates that no other candidate dominates, compared at 4 decimals."""
    points = F.transform(
        candidates,
        lambda c: F.struct(c["policy"].alias("policy"), *[F.round(c["kpi"][s], 4).alias(s) for s in ("downlink_mbps", *LOWER_IS_BETTER)]),
    )
    kept = let(points, lambda all_: F.filter(all_, lambda b: ~F.exists(all_, lambda a: dominates(a, b))))
    return F.transform(kept, lambda c: c["policy"])


# ---- execution gate ------------------------------------------------------------------------

def execution_gate(
    mode: Column, *, approval_required: Column, min_confidence: float = 0.55,
    max_uncertainty: float = 0.55, max_ood: float = 0.65,
    allowed: list[str] | None = None, canary: list[str] | None = None,
) -> Column:
    """Ordered gate of an executable mode; status and message of the first rule that stops it."""
    def outcome(status: str, message: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(message).alias("message"))

    c = F.col
    cases = [
        (mode == "recommend", outcome("recommendation_only", "no network change requested")),
        (mode == "shadow", outcome("shadow_recorded", "recorded but not sent")),
        (approval_required, outcome("approval_required", "operator approval is required")),
        (~c("approved"), outcome("blocked", "decision is not approved")),
        (c("confidence") < min_confidence, outcome("blocked", "confidence below the threshold")),
        (c("uncertainty") > max_uncertainty, outcome("blocked", "uncertainty above the threshold")),
        (c("ood") > max_ood, outcome("blocked", "observation out of distribution")),
    ]
    if allowed is not None:
        cases.append((~c("selected_policy").isin(allowed), outcome("blocked", "policy not in the allow list")))
    if canary is not None:
        cases.append(((mode == "canary") & ~c("cell_id").isin(canary), outcome("blocked", "cell outside the canary list")))
    return decision_list(cases, outcome("simulated", "applied to the projection"))


# ---- faults --------------------------------------------------------------------------------

def faulted(df: DataFrame, fault: str) -> DataFrame:
    """Snapshots under one injected fault."""
    c = F.col
    changes: dict[str, dict[str, Column]] = {
        "traffic_spike": {
            "prb_utilization": F.least(F.lit(1.5), c("prb_utilization") + 0.35),
            "active_users": F.floor(c("active_users") * 1.8).cast("int"),
            "throughput_demand_mbps": c("throughput_demand_mbps") * 1.7,
        },
        "cell_outage": {
            "downlink_mbps": F.lit(0.0), "uplink_mbps": F.lit(0.0),
            "packet_loss_pct": F.greatest(F.lit(80.0), c("packet_loss_pct")),
            "latency_ms": F.greatest(F.lit(1500.0), c("latency_ms")),
        },
        "backhaul_degradation": {
            "latency_ms": c("latency_ms") * 3.5, "jitter_ms": c("jitter_ms") * 4.0,
            "downlink_mbps": c("downlink_mbps") * 0.55,
        },
        "poor_radio": {
            "rsrp_dbm": F.lit(-121.0), "sinr_db": F.lit(-4.0),
            "handover_failure_pct": F.greatest(F.lit(7.5), c("handover_failure_pct")),
        },
        "handover_storm": {
            "handover_failure_pct": F.greatest(F.lit(12.0), c("handover_failure_pct") * 4.0),
            "jitter_ms": c("jitter_ms") * 2.0,
        },
        "packet_loss_burst": {
            "packet_loss_pct": F.least(F.lit(100.0), c("packet_loss_pct") + 12.0),
            "latency_ms": c("latency_ms") * 1.7,
        },
        "stale_telemetry": {"telemetry_age_ms": F.lit(12000.0), "telemetry_completeness": F.lit(0.78)},
        "corrupted_kpi": {
            "prb_utilization": F.lit(1.49), "telemetry_completeness": F.lit(0.55), "sinr_db": F.lit(60.0),
        },
        "model_drift": {
            "active_users": F.least(F.lit(100000), c("active_users") * 8),
            "throughput_demand_mbps": c("throughput_demand_mbps") * 4.0,
        },
        "neighbor_interference": {
            "sinr_db": F.greatest(F.lit(-30.0), c("sinr_db") - 15.0),
            "packet_loss_pct": F.least(F.lit(100.0), c("packet_loss_pct") + 3.0),
        },
    }
    if fault not in changes:
        raise ValueError(f"unknown fault: {fault}")
    return df.withColumns(changes[fault]).withColumn("fault", F.lit(fault))


def all_faults(df: DataFrame, faults: list[str]) -> DataFrame:
    """Every snapshot under every fault: a union of narrow projections of the same scan."""
    parts = [faulted(df, f) for f in faults]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
