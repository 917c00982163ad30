"""Exact quantiles and exact nearest neighbours against numpy."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from policylake.constants import CONTEXT_COLUMNS
from policylake.operators import neighbours, support
from policylake.operators.quantiles import ordered, quantiles, value_of

DOUBLES = [0.0, -0.0, 1.0, -1.0, 2.0, 0.1, 1 / 3, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
           -1.7976931348623157e308, 8.0, 7.999999999999999, 8.000000000000002, 2.0**-1022, 2.0**1023, 1e-310, math.inf, -math.inf, 4503599627370497.5]


def test_ordered_bits(spark):
    rng = np.random.default_rng(0)
    drawn = rng.integers(-(1 << 63), 1 << 63, 3000).view(np.float64)
    values = DOUBLES + [float(v) for v in drawn if not math.isnan(v)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered(F.col("v")).alias("b")).withColumn("back", value_of(F.col("b"))).collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
        assert r["b"] == (-bits if r["v"] < 0 else bits) and r["back"] == r["v"]
    assert spark.createDataFrame([(math.nan,), (None,)], "v double").select(ordered(F.col("v")).alias("b")).where("b IS NOT NULL").count() == 0


def test_quantiles_by_group_and_weight(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in ("a", "b", "c"):
        for i in range({"a": 400, "b": 1, "c": 37}[g]):
            x = float(rng.choice([rng.normal(), 1e-9 * rng.normal(), rng.integers(0, 4), 1e12 * rng.random()]))
            rows.append((g, i % 2, x, float(i % 3) if i % 5 else None, int(rng.integers(0, 4))))
    rows += [("d", 0, None, math.nan, 1), ("a", 0, 3.5, 3.5, 5000)]
    df = spark.createDataFrame(rows, "g string, h int, x double, y double, n int").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    for weight in (None, "n"):
        got = {(r["g"], r["h"]): r for r in quantiles(df, ["g", "h"], {"x": probs, "y": [0.5]}, weight).collect()}
        for g in "abcd":
            for h in (0, 1):
                mine = [r for r in rows if r[0] == g and r[1] == h for _ in range(r[4] if weight else 1)]
                x = [r[2] for r in mine if r[2] is not None]
                y = [r[3] for r in mine if r[3] is not None and not math.isnan(r[3])]
                row = got.get((g, h))
                assert (row is None) == (not x and not y)
                if x:
                    assert row["x_n"] == len(x) and np.allclose([row[f"x_{i}"] for i in range(5)], np.quantile(x, probs), rtol=1e-12, atol=0)
                if y:
                    assert row["y_n"] == len(y) and row["y_0"] == np.median(y)
    whole = quantiles(df, [], {"x": [0.25]}).first()
    assert whole["x_0"] == pytest.approx(np.quantile([r[2] for r in rows if r[2] is not None], 0.25), rel=1e-12)
    assert quantiles(df.where("false"), ["g"], {"x": [0.5]}).collect() == []


def brute(rows, ref):
    """Nearest other row by group; `rows` are (key, group, vector, own)."""
    out = {}
    for key, g, v, own in rows:
        d = [math.dist(v, p) for pk, pg, p in ref if pg == g and not (own and pk == key)]
        out[key] = min(d) if d else None
    return out


def compare(spark, rows, ref, features):
    named = ", ".join(f"{f} double" for f in features)
    points = spark.createDataFrame([(g, *p) for _, g, p in ref], f"g string, {named}").repartition(4)
    asked = spark.createDataFrame([(k, g, own, *v) for k, g, v, own in rows], f"k string, g string, own boolean, {named}").repartition(4)
    counted = neighbours.point_counts(points, ["g"], features)
    d = neighbours.distinct_distances(asked, counted, ["g"], features, "d")
    got = {r["k"]: r["d"] for r in asked.join(d, ["g", "own", *features], "left").collect()}
    want = brute(rows, ref)
    assert set(got) == set(want)
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, rel=1e-12, abs=1e-300)), k


@pytest.mark.parametrize("d, grid", [(1, True), (3, True), (6, False)])
def test_nearest_against_all_pairs(spark, monkeypatch, d, grid):
    """Dense and sparse places, copies, far rows, groups of one point, a group without points."""
    if grid:
        monkeypatch.setattr(neighbours, "PAIRS_WORTH_A_GRID", -1)
        chosen = neighbours.choose_grid
        seen = []
        monkeypatch.setattr(neighbours, "choose_grid", lambda *a: seen.append(chosen(*a)) or (seen[-1] if seen[-1][0] else (a[3][:2], 0.25, 18)))
    rng = np.random.default_rng(d)
    ref = []
    for i in range(500):
        g = "ab"[i % 2]
        v = rng.normal(size=d) * (0.01 if i % 3 else 1.0)
        ref.append((f"r{i}", g, tuple(np.round(v, 2).tolist())))
    ref += [("one", "c", (0.5,) * d), ("two", "e", (0.5,) * d), ("two'", "e", (0.5,) * d), ("far", "a", (500.0,) * d)]
    rows = [(k, g, p, True) for k, g, p in ref]
    for i in range(150):
        scale = [0.01, 1.0, 30.0, 4000.0][i % 4]
        rows.append((f"q{i}", "abce"[i % 4] if i % 11 else "none", tuple((rng.normal(size=d) * scale).tolist()), False))
    rows += [(f"s{i}", g, p, False) for i, (_, g, p) in enumerate(ref[:40])]
    compare(spark, rows, ref, [f"f{i}" for i in range(d)])


def test_a_hot_cell_is_split(spark, monkeypatch):
    """10,000 points of one group within one cell, jobs of 64 x 32 rows."""
    monkeypatch.setattr(neighbours, "QUERIES", 64)
    monkeypatch.setattr(neighbours, "POINTS", 32)
    monkeypatch.setattr(neighbours, "choose_grid", lambda points, queries, keys, features: (features, 8.0, 3))
    rng = np.random.default_rng(5)
    x = rng.random((10_000, 2))
    q = rng.random((300, 2)) * 3
    points = spark.createDataFrame([("g", *map(float, v)) for v in x], "g string, a double, b double")
    asked = spark.createDataFrame([("g", False, *map(float, v)) for v in q], "g string, own boolean, a double, b double")
    d = neighbours.distinct_distances(asked, neighbours.point_counts(points, ["g"], ["a", "b"]), ["g"], ["a", "b"], "d").collect()
    got = {(r["a"], r["b"]): r["d"] for r in d}
    want = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)).min(axis=1)
    assert len(got) == 300 and all(got[tuple(map(float, v))] == pytest.approx(w, rel=1e-12) for v, w in zip(q, want, strict=True))


def test_roles_use_every_reference_row(spark):
    """A group of 5,000 rows: radii and flags as from all of them; thin groups support nothing."""
    rng = np.random.default_rng(8)
    rows = [(f"t{i}", "eMBB", "x", *map(float, rng.integers(0, 12, 6))) for i in range(5000)] + [(f"u{i}", "eMBB", "y", *map(float, rng.integers(0, 12, 6))) for i in range(23)]
    schema = "row_id string, slice_type string, action string, " + ", ".join(f"{c} double" for c in CONTEXT_COLUMNS)
    train = spark.createDataFrame(rows, schema).repartition(6)
    asked = spark.createDataFrame([(f"q{i}", "eMBB", "xy"[i % 5 == 0], *map(float, rng.integers(0, 14, 6) + 0.25)) for i in range(200)] + [("hole", "eMBB", "x", 1.0, None, 1.0, 1.0, 1.0, 1.0)], schema)
    scaler = support.fit_scaler(train)
    x = np.array([r[3:] for r in rows])
    low, mid, high = np.quantile(x, [0.1, 0.5, 0.9], axis=0)
    for i, c in enumerate(CONTEXT_COLUMNS):
        assert scaler[c] == pytest.approx((mid[i], high[i] - low[i]))
    half = train.where("pmod(hash(row_id), 2) = 0 or action = 'y'")
    got = {r["row_id"]: r for r in support.role_support(asked, {"policy": train, "evaluator": half}, scaler).collect()}
    chosen = {r["row_id"] for r in half.collect()}
    z = {r[0]: (np.array(r[3:]) - mid) / (high - low) for r in rows if r[2] == "x"}
    for role, ids in (("policy", list(z)), ("evaluator", [i for i in z if i in chosen])):
        p = np.array([z[i] for i in ids])
        apart = np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2))
        np.fill_diagonal(apart, np.inf)
        radius = max(np.quantile(apart.min(axis=1), 0.95), 1e-4)
        for r in asked.collect():
            g = got[r["row_id"]]
            if r["action"] == "y" or r["row_id"] == "hole":
                assert g[f"{role}_distance"] is None and g[f"{role}_ok"] is False
                continue
            d = np.sqrt((((np.array(r[3:]) - mid) / (high - low) - p) ** 2).sum(axis=1)).min()
            assert g[f"{role}_distance"] == pytest.approx(d, rel=1e-9, abs=1e-12) and g[f"{role}_ok"] == (d <= radius * (1 + 1e-12))
    assert len(got) == 201
