"""The churn guard walks its windows once."""

import random

from policylake.operators import cells


def test_churn_windows_are_walked_once_and_count_every_switch(spark):
    rng = random.Random(3)
    rows, at = [], 0.0
    for i in range(400):
        at += rng.choice([0.0, 30.0, 2000.0])
        rows.append(("c1" if i % 3 else None, at, i, rng.choice("ab")))
    rows += [("c2", 5.0, 1, "a"), ("c2", 5.0, 1, "a"), ("c2", None, 2, "b")]
    got = cells.dwell_churn_guard(spark.createDataFrame(rows, "cell_id string, epoch_s double, event_id long, policy string"), 40.0, 3000.0, 2, 5000.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan
    out = {(r["cell_id"], r["event_id"]): r["switches"] for r in got.collect()}
    for cell in ("c1", None):
        mine = sorted((t, e, p) for c, t, e, p in rows if c == cell)
        for j, (t, e, _) in enumerate(mine):
            seen = [x for x in mine[:j] if t - x[0] <= 3000.0]
            assert out[(cell, e)] == sum(a[2] != b[2] for a, b in zip(seen, seen[1:]))
    assert got.where("cell_id = 'c2'").count() == 2
