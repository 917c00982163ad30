"""Candidates of a decision are compiled columns."""

from pyspark.sql import functions as F

from policylake.operators import governed
from policylake.plans.kpi_queries import requested_intent
from policylake.sources import adapters

SF = "/root/testdata/sf0.001"


def test_candidates_are_projected_outside_lambdas(spark):
    rows = governed.resolve_intent(adapters.observations(spark, SF), requested_intent())
    d = governed.decide(rows, governed.proposals(F.col("event_id"))).select("event_id", governed.pareto_front(F.col("safe_cand")).alias("front"), "chosen")
    assert "__latency_ms0" in d._jdf.queryExecution().optimizedPlan().toString()
    front = d._jdf.queryExecution().analyzed().toString().split("\n")[0]
    assert front.count("round(") == 5  # every KPI of a candidate once, not once a pair
    # a decision is compiled throughout: nothing is ranked, judged or selected by a lambda
    assert "lambdafunction" not in d.select("chosen")._jdf.queryExecution().optimizedPlan().toString()


def test_a_decision_needs_no_interpreted_method(spark):
    """the JVM interprets methods of more than 8000 bytes; counts and verdicts fit the lists."""
    rows = governed.resolve_intent(adapters.observations(spark, SF), requested_intent())
    d = governed.decide(rows, governed.proposals(F.col("event_id")))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")  # the plan uncut
    try:  # a column of its own needs no texts of reasons
        assert governed.ENERGY_REASON not in d.select("confidence")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    wrong = d.agg(
        F.count_if((F.size("chosen.critic.reasons") == 0) != F.col("chosen.safe")).alias("safe"),
        F.count_if(F.size("cand") - F.size("safe_cand") != F.col("unsafe_candidates")).alias("unsafe"),
    )
    assert wrong.collect() == [(0, 0)]


def test_rounding_by_arithmetic_is_the_decimal_one(spark):
    ties = [k / 2e6 + e for k in (-3, -1, 0, 1, 5, 246913577) for e in (0.0, 1e-10, -1e-10, 1e-15)]
    values = [*ties, 123.4565005, 999999.9999995, 1e6 + 5e-7, 1e15, -4e-7, float("nan"), float("inf"), None]
    x = spark.createDataFrame([(v,) for v in values], "x double")
    assert x.select(governed.round_6(F.col("x")).alias("a"), F.round("x", 6).alias("b")).where("not (a <=> b)").count() == 0
