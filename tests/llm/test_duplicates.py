"""N-gram Jaccard join and fingerprints against brute force."""

import hashlib
import re
from itertools import combinations

import pytest

from policylake.llm import fingerprints, jaccard_join


def grams(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def classes(rows, k, percent):
    sets = {r[0]: grams(r[1], k) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_components_equal_brute_force(documents, rows, k, percent):
    want = classes(rows, k, percent)
    got = jaccard_join.jaccard_join(documents, k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_a_chain_of_near_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(100)]
    chain = [(i, " ".join([f"x{j}" for j in range(i)] + words[i:])) for i in range(0, 30)]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    want = classes(chain, 4, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(df).collect()} == want


def links(rows, k, percent):
    """Of each row, the different sets that its set is linked with."""
    sets = {frozenset(grams(r[1], k)) for r in rows}
    near = {x: sum(1 for y in sets if x != y and x and y and 100 * len(x & y) >= percent * len(x | y)) for x in sets}
    return {r[0]: near[frozenset(grams(r[1], k))] for r in rows}


def near_copies():
    words = [f"w{i}" for i in range(100)]
    some = [(i, " ".join([*words[: i % 40], f"x{i}", *words[i % 40 + 1 :], *(f"y{j}" for j in range(i % 7))])) for i in range(90)]
    chain = [(100 + i, " ".join([f"z{j}" for j in range(3 * i)] + [f"v{j}" for j in range(60)])) for i in range(20)]
    return some + chain + [(200 + i, t) for i, t in some[:5]] + [(300, ""), (301, None), (302, "alone")]


@pytest.mark.parametrize(("block", "size"), [(1024, 2_000_000), (8, 2_000_000), (1024, 700)])
def test_every_link_is_counted(spark, monkeypatch, block, size):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "GRAMS", size)
    rows = near_copies()
    want = links(rows, 4, 85)
    assert max(want.values()) > 20 and len(set(want.values())) > 5
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want


def test_links_of_the_corpus_equal_brute_force(documents, rows):
    want = links(rows, 2, 50)
    assert {r["doc_id"]: r["n_links"] for r in jaccard_join.jaccard_join(documents, 2, 50).collect()} == want


def test_signatures_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, m in ((10, 12), (60, 65), (500, 580), (3000, 3000)):
        every = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        for apart in (0, 1, n // 10, n):
            a, b = every[:n], every[apart : apart + m]
            x, y = jaccard_join._signatures(np.r_[a, b], np.repeat([0, 2], [n, m]), np.array([n, 0, m])).to_pylist()[::2]
            gap = len(set(a.tolist()) ^ set(b.tolist()))
            assert jaccard_join._differing(x, y) <= gap and (gap - jaccard_join._differing(x, y)) % 2 == 0


def test_one_of_each_keeps_columns_and_first(documents, rows):
    kept = jaccard_join.one_of_each(documents)
    assert kept.columns == documents.columns
    want = sorted({c for _, c in classes(rows, 5, 80).values()})
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_no_rows(empty):
    assert jaccard_join.jaccard_join(empty).collect() == []
    assert jaccard_join.one_of_each(empty).collect() == []


def pieces(text):
    return set(re.findall(fingerprints.PARAGRAPH, text))


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_brute_force(documents, rows):
    got = {r["doc_id"]: r for r in fingerprints.compared(fingerprints.edited_versions(documents)).collect()}
    ring = sorted({(r[0], r[1] or "") for r in rows}, reverse=True)
    for (i, text), (_, after) in zip(ring, ring[1:] + ring[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(alike(pieces(text), pieces(edited)))
        assert r["near_next"] == pytest.approx(alike(pieces(text), pieces(after)))
        assert len(r["changed"]) == len(pieces(text) ^ pieces(edited))
    same = [r for r in rows if r[1] == rows[0][1]]
    assert len({got[r[0]]["fingerprint"] for r in same}) == 1 and len(same) > 2


def test_fingerprints_of_one_and_no_row(spark, empty):
    assert fingerprints.compared(fingerprints.edited_versions(empty)).collect() == []
    one = spark.createDataFrame([(None, "One. Two.")], "doc_id long, text string")
    r = fingerprints.compared(fingerprints.edited_versions(one)).collect()[0]
    assert r["near_next"] == 1.0 and r["n_chars"] == 9
