"""Exact counts, cuts, drops and ranks against a plain loop; the SQL twin on the same rows."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from policylake.llm import phrases, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER))]


def tally(rows):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for m in range(1, 5):
                f.update((lang or "und", tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    return f, n


def brute(rows, least, top):
    f, n = tally(rows)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = {}
    for (lang, words), a in cand.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                k = (lang, words[i : i + m])
                inside[k] = max(inside.get(k, 0), a)
    out = {}
    for (lang, words), a in cand.items():
        if 100 * inside.get((lang, words), 0) >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])
    )


def corpus(seed=11, count=160):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "citY", "of", "the", "a", "é", "ÉX", "中文", "to", "be", "or", "not", "#1", "x\x1cy"]
    rows = []
    for i in range(count):
        words = rng.choices(vocabulary, [9, 8, 7, 6, 5, 4, 3, 2, 2, 3, 3, 3, 3, 1, 1], k=rng.randint(0, 60))
        if i % 3 == 0:
            words[3:3] = ["to", "be", "or", "not", "to", "be"]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for w in words)
        rows.append((text, ["en", "en", "de", None, "und"][i % 5]))
    return rows + [rows[0]] * 40 + [(None, "en"), ("", None), (" \t ", "fr"), ("...", "fr")]


def table(spark, rows):
    cells = [(i if i % 7 else None, text, lang, "k", 1, 2, 3) for i, (text, lang) in enumerate(rows)]
    return spark.createDataFrame(cells, "doc_id long, text string, lang string, phrase string, n long, a long, salt int").repartition(3)


@pytest.mark.parametrize("one_in", [1, 4, 1_000_000])
def test_counts_close_whatever_the_sample_says(spark, one_in):
    """With an empty sample every pass fails until all four lengths are counted."""
    rows = corpus()
    f, n = tally(rows)
    got = {(r["lang"], r["phrase"], r["size"]): r["f"] for r in phrases.frequent(table(spark, rows), least=12, one_in=one_in).collect()}
    want = {(lang, " ".join(w), len(w)): c for (lang, w), c in f.items() if c >= 12} | {(lang, "", 0): c for lang, c in n.items() if c}
    assert got == want and {k[2] for k in want} == {0, 1, 2, 3, 4}


@pytest.mark.parametrize("least, top", [(2, 2000), (5, 2000), (3, 7)])
def test_collocations_against_a_loop(spark, least, top):
    rows = corpus(seed=least)
    got = sorted(tuple(r) for r in phrases.collocations(table(spark, rows), least=least, top=top).collect())
    assert got == brute(rows, least, top) and len(got) > 20


def test_hash_collisions_in_the_bit_array_only_count_more(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_size", lambda keys: 7)
    rows = corpus()
    got = sorted(tuple(r) for r in phrases.collocations(table(spark, rows), least=6).collect())
    assert got == brute(rows, 6, 2000)


def test_long_texts_are_counted_in_overlapping_parts(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["aa", "b", "ccc", "dé"]) + rng.choice([" ", " ", "  ", "\t", ".", " . ", "\n"]) for _ in range(900))

    def count(texts):
        f = Counter()
        for _, data, at, end in phrases.parts(pa.array(texts)):
            words = phrases.Words(data, at, end, np.zeros(len(at) - 1, np.uint64))
            for n, _, ok in words.keys(4):
                f.update(words.phrase(i, n) for i in np.flatnonzero(ok[: words.own]).tolist())
        return f

    whole = count([text])
    assert whole == Counter({" ".join(w): c for (_, w), c in tally([(text, "x")])[0].items()})
    for size in (1, 7, 50):
        monkeypatch.setattr(phrases, "PART", size)
        assert count([text]) == whole
    monkeypatch.setattr(phrases, "PART", 40)
    assert count(["n" * 400 + " a b"]) == Counter({"n" * 400: 1, "a": 1, "b": 1, "n" * 400 + " a": 1, "a b": 1, "n" * 400 + " a b": 1})


def test_nothing(spark, empty):
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(table(spark, [(None, None), ("", "en")])).collect() == []


def test_sql_twin(spark, tmp_path):
    rows = corpus(seed=3, count=600)
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_phrase_collocations(spark, str(tmp_path))
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(phrases.SQL).fetchall()) == brute(rows, 30, 2000)
