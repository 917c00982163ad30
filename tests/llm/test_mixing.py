"""Targets against the stepwise rule, quotas, shards and the drawn rows."""

import math
import re

import pytest
from pyspark.sql import functions as F

from policylake.llm import mixing


def stepwise(sizes, weights, share, epochs):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), [s for s in names if sizes[s]]
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - epochs * sizes[s]) for s in open_)
        for s in open_:
            target[s] = min(target[s], epochs * sizes[s])
        open_ = [s for s in open_ if target[s] < epochs * sizes[s] - 1e-9]
    return target


def test_mix_meets_targets(documents, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    want = stepwise(sizes, (3, 1, 2), 1.5, 2)
    mixed = mixing.mix(documents, shard_words=512)
    got = mixing.taken(mixed).collect()
    assert len(got) == len(rows)
    again = mixing.taken(mixing.mix(documents.repartition(5), shard_words=512)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    of = {r[0]: (r[3], size(r[1])) for r in rows}
    taken: dict = {}
    for r in got:
        source, n = of[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[source] and 0 <= r["taken"] <= 2 * n
        assert r["target"] == pytest.approx(want[source])
        taken[source] = taken.get(source, 0) + r["taken"]
    for source, words in taken.items():
        assert abs(words - want[source]) <= 1


def test_every_shard_has_a_fair_share(spark):
    sources = spark.createDataFrame([("a", 6000), ("b", 2000), (None, 500)], "source string, quota long")
    got = mixing.splitting_tree(sources, 4, 3).collect()
    total: dict = {}
    for r in got:
        total[r["source"]] = total.get(r["source"], 0) + r["count"]
        assert abs(r["count"] / {"a": 375, "b": 125, None: 31.25}[r["source"]] - 1) < 0.5
    assert total == {"a": 6000, "b": 2000, None: 500}
    per = {}
    for r in got:
        per[r["shard"]] = per.get(r["shard"], 0) + r["count"]
    assert len(per) == 16 and max(per.values()) - min(per.values()) <= 4
    for s in ("a", "b", None):  # runs follow each other
        runs = sorted((r["first"], r["count"]) for r in got if r["source"] == s)
        assert all(a[0] + a[1] == b[0] for a, b in zip(runs, runs[1:], strict=False))


def test_hypergeometric_has_its_chances(spark):
    t, g, d = 30, 12, 10
    cdf = 0.0
    for x in range(d + 1):
        p = math.comb(g, x) * math.comb(t - g, d - x) / math.comb(t, d)
        if p > 1e-6:
            for u, want in ((cdf + 1e-9, x), (cdf + p - 1e-9, x)):
                got = spark.sql(f"select {mixing.hypergeometric(f'{t}L', f'{g}L', f'{d}L', f'{u!r}D')} as x").first()["x"]
                assert got == want
        cdf += p


def test_drawn_rows(documents, rows):
    mixed = mixing.mix(documents, shard_words=512)
    out = mixing.drawn(documents, mixed)
    assert out.columns == documents.columns
    words: dict = {}
    for r in out.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + n
        assert {x[0]: x[1] for x in rows}[r["doc_id"]].startswith(r["text"])
    taken: dict = {}
    for r in mixing.taken(mixed).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    assert words == {k: v for k, v in taken.items() if v}


def test_nothing_to_mix(spark, empty):
    assert mixing.taken(mixing.mix(empty)).collect() == []
    void = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in mixing.taken(mixing.mix(void)).collect()) == [(1, 0, 0), (2, 0, 0)]
    assert mixing.drawn(void, mixing.mix(void)).collect() == []


def test_drawn_rows_keep_columns_of_any_name(spark, documents):
    """Names used inside come back as they were; rows travel twice."""
    names = ["_order", "_nth", "_size", "_words", "_shard", "_slot", "order", "nth", "words", "shard", "slot", "doc"]
    odd = documents.drop("size").withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    out = mixing.drawn(odd, mixing.mix(odd))
    assert out.columns == odd.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    plain = mixing.drawn(documents, mixing.mix(documents))
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in plain.collect())
