"""Gates, verdicts, configuration split and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from policylake.functions.core import cond_rate, rounded
from policylake.functions.dims import freeze
from policylake.operators.quality import gate_table, verdict
from policylake.operators.windows import replay_switches
from policylake.sources.trace import config_number


def tradeoffs(merged: DataFrame, proposed: str) -> DataFrame:
    """Deltas of one model against every other model of the same split."""
    p = merged.filter(F.col("model") == proposed).select("split", *[F.col(c).alias(f"p_{c}") for c in ("utility", "churn", "disagreement", "sla_rate")])
    b = merged.filter(F.col("model") != proposed)
    return b.join(p, "split").select(
        "split", F.col("model").alias("baseline"),
        rounded(F.col("p_utility") - F.col("utility")).alias("utility_delta"),
        rounded(F.col("churn") - F.col("p_churn")).alias("switch_reduction"),
        rounded(F.col("disagreement") - F.col("p_disagreement")).alias("disagreement_reduction"),
        rounded(F.col("p_sla_rate") - F.col("sla_rate")).alias("sla_delta"),
    )


def readiness(targets: DataFrame) -> DataFrame:
    """Gate rows of a study table with the overall verdict."""
    facts = targets.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("publication_split").alias("splits"),
        F.avg("utility").alias("util"), cond_rate(F.col("sla_cost") > 0.45).alias("viol"),
        F.countDistinct("action").alias("actions"),
    )
    g = freeze(gate_table(facts, {
        "rows": F.col("n") >= 1000, "splits": F.col("splits") == 4, "utility": F.col("util") > 0.4,
        "violations": F.col("viol") < 0.2, "actions": F.col("actions") >= 3,
    }), 64)
    v = g.agg(verdict(F.count_if("passed"), F.count(F.lit(1))).alias("v"))
    return g.withColumn("verdict", v.scalar())


def randomised_log(log: DataFrame, min_switches: int, min_support: int) -> DataFrame:
    """Guards of a randomised-action log before it may be learnt from."""
    s = replay_switches(log, "action")
    per = s.groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("switch").alias("sw"),
        F.min(F.col("propensity").isNotNull() & (F.col("propensity") > 0) & (F.col("propensity") <= 1)).alias("ok"),
    )
    episodes = log.agg(F.countDistinct("episode_id").alias("e"))
    facts = per.agg(F.min("n").alias("least"), F.sum("sw").alias("sw"), F.min("ok").alias("ok")).withColumn("e", episodes.scalar())
    return gate_table(facts, {
        "propensity_valid": F.col("ok"), "four_episodes": F.col("e") >= 4,
        "switches": F.col("sw") >= min_switches, "action_support": F.col("least") >= min_support,
    })


#: Subsets that one comparison may have; C(18, 3) is 816.
MAX_SUBSETS = 4_000


def configuration_split(train: DataFrame, cell: str, count: int) -> DataFrame:
    """Subset of `count` configurations for the evaluator that maximises coverage on both sides.

    All combinations of the configurations are compared on the sets of configurations that see a
    cell; more than MAX_SUBSETS combinations are refused, never cut.
    """
    from itertools import combinations
    from math import comb

    from policylake.functions.dims import constant

    cells = freeze(train.groupBy("training_config", cell).agg(F.count(F.lit(1)).alias("n")))
    configs = [
        (r["training_config"], r["n"])
        for r in cells.groupBy("training_config").agg(F.sum("n").alias("n"))
        .orderBy(config_number("training_config")).limit(MAX_SUBSETS).collect()
    ]
    if len(configs) < count + 3:
        raise ValueError("not enough configurations for disjoint roles")
    if comb(len(configs), count) > MAX_SUBSETS:
        raise ValueError(f"{len(configs)} configurations have more than {MAX_SUBSETS} subsets of {count}")
    combos = [(i, list(c)) for i, c in enumerate(combinations([n for n, _ in configs], count))]
    dim = constant(train.sparkSession, combos, "combo int, members array<string>")
    per_cell = cells.groupBy(cell).agg(F.collect_set("training_config").alias("seen"))
    owners = cells.groupBy("training_config").agg(F.sum("n").alias("n"))
    total_cells = per_cell.count()
    total_rows = sum(n for _, n in configs)
    # group cells by the set of configurations that saw them: at most one row per distinct set
    sets = freeze(per_cell.groupBy(F.sort_array("seen").alias("seen")).agg(F.count(F.lit(1)).alias("w")))
    packed = sets.agg(F.collect_list(F.struct("seen", "w")).alias("sets")).scalar()
    sizes = owners.agg(F.map_from_entries(F.collect_list(F.struct("training_config", "n"))).alias("m")).scalar()
    d = dim.withColumns({"sets": packed, "sizes": sizes})

    def covered(test):
        return F.aggregate("sets", F.lit(0).cast("long"), lambda a, x: a + F.when(test(x["seen"]), x["w"]).otherwise(0)) / total_cells

    rows = F.aggregate("members", F.lit(0).cast("long"), lambda a, m: a + F.element_at("sizes", m)) / total_rows
    d = d.withColumns(
        {
            "oc": covered(lambda s: F.arrays_overlap(s, F.col("members"))),
            "pc": covered(lambda s: F.size(F.array_except(s, F.col("members"))) > 0),
            "bal": 1 - F.abs(rows - count / len(configs)),
        }
    )
    score = 4 * F.least("oc", "pc") + F.col("oc") + F.col("pc") + 0.05 * F.col("bal")
    return (
        d.withColumn("score", F.round(score, 12))
        .orderBy(F.desc("score"), F.desc("members")).limit(1)
        .select(F.array_join("members", ",").alias("evaluator_configs"), rounded("oc").alias("evaluator_coverage"), rounded("pc").alias("policy_coverage"))
    )


def latest_per_version(runs: DataFrame) -> DataFrame:
    """Newest registry entry of each version, combined map-side."""
    rest = [c for c in runs.columns if c != "version"]
    newest = F.max_by(F.struct(*rest), F.struct("registered_at", "artifact"))
    return runs.groupBy("version").agg(newest.alias("r")).select("version", "r.*")
