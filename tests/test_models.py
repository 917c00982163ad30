"""Validated joins, catalogues, density models and outcome models against plain computations."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from policylake.config import ObjectiveSettings
from policylake.operators import density, joins, outcome_model
from policylake.sources import catalogues


def test_joins_fail_on_what_they_forbid(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "p"), (2, "q")], "k int, y string")
    assert sorted(tuple(r) for r in joins.one_to_one(left, right, ["k"]).collect()) == [(1, "a", "p"), (2, "b", "q")]
    assert joins.validated_many_to_one(left, right, ["k"], "y").count() == 2
    for a, b in ((left.unionAll(left), right), (left, right.unionAll(right))):
        with pytest.raises(PySparkException, match="more than once"):
            joins.one_to_one(a, b, ["k"]).collect()
    with pytest.raises(PySparkException, match="without a match"):
        joins.validated_many_to_one(left, right.where("k = 1"), ["k"], "y").collect()
    with pytest.raises(PySparkException, match="duplicate right keys"):
        joins.validated_many_to_one(left, right.unionAll(right), ["k"], "y").collect()


def test_catalogues(spark, tmp_path):
    path = tmp_path / "sources.json"
    path.write_text("\n".join(json.dumps(r) for r in ({"source_id": "a"}, {"source_id": "b", "enabled": False}, {"source_id": "c", "enabled": True})))
    assert sorted(r["source_id"] for r in catalogues.sources(spark, str(path)).collect()) == ["a", "c"]
    path.write_text(json.dumps({"source_id": "b", "enabled": False}))
    with pytest.raises(ValueError):
        catalogues.sources(spark, str(path))
    path.write_text(json.dumps({"policy": "energy_saver"}))
    with pytest.raises(ValueError):
        catalogues.policies(spark, str(path))
    assert {r["intent"]: r["constraints"] for r in catalogues.intents(spark).collect()}["green-ran"] == ["energy_load <= 0.72 (soft)"]


def points(seed, n, d):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d)


def test_gaussian_is_the_shrunk_covariance(spark):
    """Shrinkage, factor and distance as by the closed formulas over whole matrices."""
    d, groups = 4, {"a": points(1, 60, 4), "b": points(2, 9, 4), "c": points(3, 7, 4), "e": np.ones((30, 4))}
    feats = [f"f{i}" for i in range(d)]
    rows = spark.createDataFrame([(g, *map(float, x)) for g, xs in groups.items() for x in xs], "g string, " + ", ".join(f"{f} double" for f in feats)).repartition(3)
    model = density.gaussian(rows, ["g"], feats, minimum=8)
    share = {r["g"]: r["share"] for r in model.collect()}
    got = density.mahalanobis(rows, model, ["g"], feats, "s").collect()
    assert set(share) == {"a", "b", "e"}
    for r in got:
        if r["g"] in ("c", "e"):
            assert r["s"] is None if r["g"] == "c" else r["s"] == 0.0
            continue
        x = groups[r["g"]]
        c = x - x.mean(axis=0)
        s = c.T @ c / len(x)
        ball = np.trace(s) / d
        apart = ((s - ball * np.eye(d)) ** 2).sum() / d
        noise = min(((c**2).sum(axis=1) ** 2).mean() - (s**2).sum(), apart * d * len(x)) / (d * len(x))
        k = max(noise, 0.0) / apart
        assert share[r["g"]] == pytest.approx(k, rel=1e-9)
        v = np.array([r[f] for f in feats]) - x.mean(axis=0)
        assert r["s"] == pytest.approx(v @ np.linalg.inv((1 - k) * s + k * ball * np.eye(d)) @ v, rel=1e-8)


def test_mixture_finds_two_parts_and_scores_by_density(spark):
    rng = np.random.default_rng(5)
    two = np.vstack([rng.normal(0, 1, (80, 2)), rng.normal(9, 0.5, (40, 2))])
    rows = spark.createDataFrame([("two", *map(float, x)) for x in two] + [("few", *map(float, x)) for x in rng.normal(size=(12, 2))], "g string, a double, b double").repartition(3)
    model = density.mixture(rows, ["g"], ["a", "b"])
    by = {r["g"]: r for r in model.collect()}
    weights = sorted((by["two"]["aw"], by["two"]["bw"]))
    assert weights == pytest.approx([1 / 3, 2 / 3], abs=0.02) and (by["few"]["aw"], by["few"]["bw"]) == (1.0, 0.0)
    for r in density.surprise(rows, model, ["g"], ["a", "b"], "s").collect():
        m = by[r["g"]]
        total = 0.0
        for p in "ab":
            if m[f"{p}w"] > 0:
                total += m[f"{p}w"] * math.prod(math.exp(-((x - mu) ** 2) / (2 * v)) / math.sqrt(2 * math.pi * v) for x, mu, v in zip((r["a"], r["b"]), m[f"{p}m"], m[f"{p}v"], strict=True))
        assert r["s"] == pytest.approx(-math.log(total), rel=1e-9)
    again = {r["g"]: r for r in density.mixture(rows.repartition(7), ["g"], ["a", "b"]).collect()}
    assert again["two"]["am"] == pytest.approx(by["two"]["am"], rel=1e-9)


def transitions(seed=3, count=600):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        action = rng.choice(["x", "y", "z"] if i % 4 else ["x"])
        load = [rng.random() * 100 for _ in range(2)]
        rows.append((f"r{i}", f"e{i % 40}", ["eMBB", "URLLC"][i % 2], action, *[rng.random() for _ in range(3)], rng.random(), rng.random() < 0.2, load[0], rng.random() * 15, load[1], rng.random() * 15, *[rng.random() for _ in range(4)], f"s{i % 3}", f"t{i % 5}", f"x{i % 2}"))
    return rows


SCHEMA = ("row_id string, episode_id string, slice_type string, action string, sla_cost double, energy_cost double, stability_cost double, utility double, done boolean, "
          "dl_buffer_bytes double, dl_cqi double, next_dl_buffer_bytes double, next_dl_cqi double, num_ues double, ul_buffer_bytes double, ul_sinr double, requested_prbs double, "
          "scenario string, training_config string, experiment string")


def drawn(rows, value, slice_type, action, b, k=outcome_model.STRENGTH):
    """The mean drawn towards its cell and slice, from the rows themselves."""
    here = [value(r) for r in rows if r["slice_type"] == slice_type]
    cell = [value(r) for r in rows if (r["slice_type"], r["action"]) == (slice_type, action)]
    own = [value(r) for r in rows if (r["slice_type"], r["action"], r["bin"]) == (slice_type, action, b)]
    towards = (sum(cell) + k * np.mean(here)) / (len(cell) + k)
    return (sum(own) + k * towards) / (len(own) + k)


def test_outcome_model_against_rows(spark):
    cfg = ObjectiveSettings(folds=3, q_iterations=3)
    df = spark.createDataFrame(transitions(), SCHEMA).repartition(4)
    catalogue = [{"slice_type": s, "action": a, "idx": i, "fallback": "x"} for s in ("eMBB", "URLLC") for i, a in enumerate("xyz")]
    model = outcome_model.fit(df, df.where("row_id < 'r4'"), catalogue, cfg)
    rows = [r.asDict() for r in df.withColumns({"bin": model.scale.bin(), "next_bin": model.scale.bin("next_"), "fold": outcome_model.episode_fold(3)}).collect()]
    assert {r["bin"] for r in rows} == set(range(9))
    cells = {(r["slice_type"], r["bin"]): {c["action"]: c for c in r["cells"]} for r in model.cells.collect()}

    for r in rows:
        others = [o for o in rows if o["fold"] != r["fold"]]
        r["raw"] = np.mean([abs(r[f"{c}_cost"] - drawn(others, lambda o, c=c: o[f"{c}_cost"], r["slice_type"], r["action"], r["bin"])) / max(np.std([o[f"{c}_cost"] for o in rows]), 0.05) for c in outcome_model.COSTS])
    cap = np.quantile([r["raw"] for r in rows], 0.98)
    assert model.cap == pytest.approx(cap, rel=1e-9)
    q = {(s, a, b): drawn(rows, lambda r: r["utility"], s, a, b) for s in ("eMBB", "URLLC") for a in "xyz" for b in range(9)}
    for _ in range(2):
        best = {(s, b): max(q[s, a, b] for a in "xyz") for s in ("eMBB", "URLLC") for b in range(9)}
        q = {k: drawn(rows, lambda r, best=best: r["utility"] + (0.0 if r["done"] else cfg.gamma * best[r["slice_type"], r["next_bin"]]), *k) for k in q}
    theirs = [r for r in rows if r["row_id"] < "r4"]
    for (s, b), actions in cells.items():
        for a, c in actions.items():
            assert c["sla"] == pytest.approx(drawn(rows, lambda r: r["sla_cost"], s, a, b), rel=1e-9)
            assert c["e_energy"] == pytest.approx(drawn(theirs, lambda r: r["energy_cost"], s, a, b), rel=1e-9)
            assert c["unc"] == pytest.approx(drawn(rows, lambda r: min(max(r["raw"] / cap, 0.0), 1.0), s, a, b), rel=1e-9)
            assert c["q"] == pytest.approx(q[s, a, b], rel=1e-9)
            n = sum((r["slice_type"], r["action"], r["bin"]) == (s, a, b) for r in rows)
            assert c["w"] == n and c["sup"] == (n >= 10 and sum((r["slice_type"], r["action"], r["bin"]) == (s, a, b) for r in theirs) >= 10)


def test_crossfit_never_saw_the_cluster(spark):
    df = spark.createDataFrame(transitions(), SCHEMA)
    scale = outcome_model.fit_scale(df)
    train, held = df.where("scenario <> 's2'"), df.where("experiment = 'x1'")
    got = outcome_model.crossfit_predictions(train, held, scale, 3).collect()
    rows = [r.asDict() for r in train.withColumns({"bin": scale.bin(), "fold": outcome_model.cluster_fold(3)}).collect()]
    bins = {r["row_id"]: r["bin"] for r in held.select("row_id", scale.bin().alias("bin")).collect()}
    assert len(got) == held.count() and {r["saw_cluster"] for r in got} == {0}
    for r in got[:40]:
        others = [o for o in rows if o["fold"] != r["fold"]]
        assert not any((o["scenario"], o["training_config"], o["experiment"]) == (r["scenario"], r["training_config"], r["experiment"]) for o in others)
        assert r["p_sla"] == pytest.approx(drawn(others, lambda o: o["sla_cost"], r["slice_type"], r["action"], bins[r["row_id"]]), rel=1e-9)


def test_multiplicities_are_poisson(spark):
    draws = spark.range(4000).withColumn("episode_id", F.col("id").cast("string")).select(outcome_model.multiplicity(F.lit(3)).alias("w")).groupBy("w").count()
    shares = {r["w"]: r["count"] / 4000 for r in draws.collect()}
    assert shares[0] == pytest.approx(math.exp(-1), abs=0.03) and shares[1] == pytest.approx(math.exp(-1), abs=0.03) and shares[2] == pytest.approx(math.exp(-1) / 2, abs=0.03)
