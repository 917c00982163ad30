"""Ordered per-cell state: shuffled micro-batches against the batch operators, the control step against a plain loop."""

import hashlib
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from policylake.operators import cells, governed
from policylake.plans.kpi_queries import requested_intent
from policylake.sources import adapters
from policylake.streaming import cell_state, pipelines

SF = "/root/testdata/sf0.001"
DELAY = "4000 days"  # rows of any batch may be in any order


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events in six shuffled files, so that every micro-batch holds rows of all times."""
    out = tmp_path_factory.mktemp("stream")
    events = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(6):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(6)) == i).coalesce(1).write.parquet(str(out / f"events{i}.parquet"))
    return str(out)


def observed(spark):
    return adapters.observations_of(spark.read.parquet(f"{SF}/events.parquet"))


def test_shuffled_batches_equal_the_batch_operators(spark, folder):
    def build(stream):
        return pipelines.cell_stream(stream.withColumn("policy", governed.expert_label()), dwell=1800.0, window=21600.0)

    got = {r["event_id"]: r for r in pipelines.drained(spark, folder, build, "test", files_per_trigger=1, delay=DELAY).collect()}
    rows = observed(spark).withColumn("policy", governed.expert_label())
    guard = cells.dwell_churn_guard(rows, 1800.0, 21600.0, 6).select("event_id", "dwell_reject", "churn_reject")
    back = cells.rollback_check(rows, F.col("policy") != "balanced").select("event_id", "rollback")
    want = guard.join(back, "event_id").collect()
    assert len(got) == len(want) > 500
    for r in want:
        assert [got[r["event_id"]][c] for c in ("dwell_reject", "churn_reject", "rollback")] == [r[c] for c in ("dwell_reject", "churn_reject", "rollback")]
    chain = pipelines.verify_stream_chain(spark.createDataFrame(list(got.values()), cell_state.OUTPUT), rows).collect()
    assert all(r["previous_mismatch"] == r["record_mismatch"] == 0 for r in chain)


def plain_loop(rows):
    """The control step of every cell by the rules, one row at a time."""
    out, memory = {}, {}
    for r in sorted(rows, key=lambda r: (r["cell_id"], r["epoch_s"], r["event_id"])):
        m = memory.setdefault(r["cell_id"], {"log": [], "armed": None, "hash": "0" * 64})
        now = r["epoch_s"]
        worse = False
        if m["armed"]:
            b = m["armed"]
            worse = (b["downlink_mbps"] > 0 and 100 * (b["downlink_mbps"] - r["downlink_mbps"]) / b["downlink_mbps"] > 15) or r["packet_loss_pct"] - b["packet_loss_pct"] > 5 or (
                b["latency_ms"] > 0 and 100 * (r["latency_ms"] - b["latency_ms"]) / b["latency_ms"] > 20)
        candidates = []
        for c in r["cand"]:
            recent = [p for t, p in m["log"] if now - t <= 60]
            held = bool(m["log"]) and m["log"][-1][1] != c["policy"] and (now - m["log"][-1][0] < 5 or sum(a != b for a, b in zip(recent, recent[1:])) >= 6)
            candidates.append((c, c["safe"] and not held))
        pool = [c for c, ok in candidates if ok] or [c for c, _ in candidates if c["policy"] == "balanced"]
        best = sorted(pool, key=lambda c: (-round(c["score"] + 8 * c["prob"], 9), c["idx"]))[0]
        second = sorted((c["score"] for c in pool), reverse=True)[1] if len(pool) > 1 else 0.0
        trust = (0.48 + 0.34 * best["prob"] + min(0.18, max(0.0, (best["score"] - second) / 100))) * (1 - min(0.45, r["uncertainty"] * 0.45))
        go = any(c is best and ok for c, ok in candidates) and r["level"] not in ("high", "critical") and r["ood"] <= max(0.5, 0.78 - r["risk_tolerance"] * 0.3) and min(trust, 0.99) >= 0.55
        policy = best["policy"]
        if worse:
            policy, go = "balanced", True
        if go:
            m["log"].append((now, policy))
            m["armed"] = r
        record = json.dumps({"cell_id": r["cell_id"], "event_id": r["event_id"], "policy": policy if go else "none", "previous_hash": m["hash"]}, sort_keys=True, separators=(",", ":"))
        m["hash"] = hashlib.sha256(record.encode()).hexdigest()
        out[r["event_id"]] = (policy if go else "none", worse, go, m["hash"])
    return out


def test_control_step_is_gated_and_armed_by_executed_actions(spark, folder):
    got = pipelines.drained(spark, folder, lambda s: pipelines.control_step(s, requested_intent()), "test", files_per_trigger=2, delay=DELAY)
    rows = governed.decide(governed.resolve_intent(observed(spark), requested_intent()), governed.proposals(F.col("event_id"))).collect()
    want = plain_loop(rows)
    have = {r["event_id"]: (r["policy"], r["rollback"], r["executed"], r["record_hash"]) for r in got.collect()}
    assert have == want
    assert {e for _, _, e, _ in want.values()} == {True, False} and any(w for _, w, _, _ in want.values())


def test_late_rows_are_dropped_and_silence_ends_a_cell():
    guard = cell_state.Guard(dwell=10.0, window=100.0, max_switches=1)
    state = cell_state.CellState()

    def row(i, t, policy, down=10.0):
        return SimpleNamespace(event_id=i, epoch_s=t, policy=policy, downlink_mbps=down, packet_loss_pct=0.0, latency_ms=1.0, throughput_demand_mbps=float(i), control=None)

    out = [cell_state.step(guard, state, "c", row(i, t, p, d)) for i, (t, p, d) in enumerate([(0, "a", 10.0), (5, "b", 10.0), (50, "a", 8.0), (300, "b", 10.0)])]
    assert [(o[3], o[4], o[5]) for o in out] == [(False, False, False), (True, False, False), (False, True, True), (False, False, False)]
    assert out[0][7] is None and out[2][6] == 3 and out[3][10] == out[2][11]
