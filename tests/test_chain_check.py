"""The check of written chains: altered records and broken links are counted, and only keys and hashes travel."""

from policylake.streaming import cell_state, pipelines


def chains(n=60):
    """Two cells of an event every seven hours, with some altered records and broken links."""
    log, order = [], []
    for cell in ("a", "b"):
        state, guard = cell_state.CellState(), cell_state.Guard()
        for i in range(n):
            at = 7 * 3600.0 * i
            row = cell_state.Row(len(log), at, "ab"[i % 2], 1.0, 0.0, 1.0, 1.0, None)
            log.append(cell_state.step(guard, state, cell, row))
            order.append((row.event_id, at))
    altered, broken = {3, 17, 80}, {0, 29, 61, 62}
    log = [(*r[:2], "x" if r[0] in altered else r[2], *r[3:10], "broken" if r[0] in broken else r[10], r[11]) for r in log]
    # a record names the hash before it, so a broken link alters it as well
    return log, order, {"a": (n, 2, 4), "b": (n, 2, 3)}


def joins(node):
    found = [node] if node.nodeName() == "Join" else []
    for i in range(node.children().size()):
        found += joins(node.children().apply(i))
    return found


def test_altered_records_and_broken_links_are_counted(spark):
    log, order, want = chains()
    frame, events = spark.createDataFrame(log, cell_state.OUTPUT), spark.createDataFrame(order, "event_id long, epoch_s double")
    got = {r["cell_id"]: (r["records"], r["previous_mismatch"], r["record_mismatch"]) for r in pipelines.verify_stream_chain(frame, events).collect()}
    assert got == want


def test_only_keys_and_hashes_travel(spark, tmp_path):
    log, order, _ = chains(4)
    spark.createDataFrame(log, cell_state.OUTPUT).write.parquet(str(tmp_path / "log"))
    spark.createDataFrame(order, "event_id long, epoch_s double").write.parquet(str(tmp_path / "order"))
    plan = pipelines.verify_stream_chain(spark.read.parquet(str(tmp_path / "log")), spark.read.parquet(str(tmp_path / "order")))
    found = joins(plan._jdf.queryExecution().optimizedPlan())
    assert found and not any("policy" in j.children().apply(i).output().mkString(",") for j in found for i in (0, 1))
