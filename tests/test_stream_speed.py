"""A stream deals its keys over few state stores, and a block of rows equals its rows one by one."""

import os
import random
from types import SimpleNamespace

from policylake.operators import governed
from policylake.session import shared_folder
from policylake.streaming import cell_state, pipelines

SF = "/root/testdata/sf0.001"


def test_a_stream_opens_no_more_state_stores_than_its_cores_need(spark):
    def build(stream):
        return pipelines.cell_stream(stream.withColumn("policy", governed.expert_label()))

    def streams():
        folder = f"{shared_folder(spark).removeprefix('file:')}/policylake"
        return {f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("stream-stores-")} if os.path.isdir(folder) else set()

    earlier, before = streams(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        assert pipelines.drained(spark, SF, build, "stores").count() == spark.read.parquet(f"{SF}/events.parquet").count()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "48"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    (made,) = streams() - earlier
    stores = [s for s in os.listdir(f"{made}/checkpoint/state/0") if s.isdigit()]
    assert 0 < len(stores) <= 4 * spark.sparkContext.defaultParallelism < 48


def test_a_block_equals_its_rows_one_by_one():
    rng = random.Random(3)
    rows = [
        SimpleNamespace(event_id=i, epoch_s=float(i), policy=rng.choice(["a", "balanced", None]), downlink_mbps=rng.random(), packet_loss_pct=rng.random(),
                        latency_ms=rng.random(), throughput_demand_mbps=rng.random(), control=None) for i in range(300)]
    guard, one, many = cell_state.Guard(0.5, 60.0, 6), cell_state.CellState(), cell_state.CellState()
    want = [cell_state.step(guard, one, "c", r) for r in rows]
    got, at = [], 0
    for n in (1, 1, 5, 40, 200, 53):
        got += cell_state.steps(guard, many, "c", rows[at:at + n])
        at += n
    assert got == want and many.kept() == one.kept()
    for i, o in enumerate(got):
        tail = [r.throughput_demand_mbps for r in rows[max(0, i - 23):i + 1]]
        level = tail[0]
        for v in tail[1:]:
            level = 0.45 * v + (1 - 0.45) * level
        assert o[6] == min(i + 1, 120) and o[7] == (level if i > 1 else None)
