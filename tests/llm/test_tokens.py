"""Token counts and packed ids against the library itself."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from policylake.llm import packing, pretokens, token_counts

ODD = ["it's we're", "a<|endoftext|>b", "  two  spaces\n\n end ", "x\x1cy", "é×÷ñ ß", "中文 字", "1a2b  3", "\n", "a b", "'s 'll", "don't  "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(pretokens.default_vocabulary())


def test_counts_equal_the_library(spark, documents, library):
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    both = documents.select("doc_id", "text").union(odd)
    got = sorted(token_counts.count_tokens(both).collect())
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 1024) for r in both.collect())
    assert [tuple(r) for r in got] == want


def test_counts_of_nothing(empty):
    assert token_counts.count_tokens(empty).collect() == []


def test_cache_alone_gives_the_same(documents, monkeypatch):
    full = sorted(token_counts.count_tokens(documents).collect())
    monkeypatch.setattr(token_counts, "frequent", lambda *a, **k: (np.empty(0, np.uint64), np.empty(0, np.int32)))
    assert sorted(token_counts.count_tokens(documents).collect()) == full


def test_packing_round_trip(spark, documents, library):
    packs = packing.pack(documents, width=64, window=3_000)
    for r in packs.collect():
        assert r["n_tokens"] == len(r["ids"]) // 2 <= 64
        assert r["cu_seqlens"][-1] == r["n_tokens"] and r["resets"] == r["cu_seqlens"][:-1]
    back: dict = {}
    for r in packing.unpacked(packs).collect():
        back.setdefault(r["doc_id"], []).append((r["piece"], np.frombuffer(r["ids"], "<u2").tolist()))
    want = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in documents.collect()}
    for doc, ids in want.items():
        got = sorted(back.pop(doc, []))
        if doc == 0:  # the repeated row comes twice
            got = got[::2]
        assert [x for _, part in got for x in part] == ids
    assert not back


def test_packing_nothing(empty):
    assert packing.pack(empty).collect() == []


def test_best_fit_decreasing_against_a_scan():
    rng = np.random.default_rng(1)
    for _ in range(30):
        width, lengths = 50, rng.integers(1, 51, rng.integers(1, 80))
        rows, room = [], []
        for i in np.lexsort((np.arange(len(lengths)), -lengths)):
            fits = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
            if fits:
                least = min(fits)[0]
                k = min(fits)[1]
                room[k] = least - lengths[i]
                rows[k].append(int(i))
            else:
                room.append(width - lengths[i])
                rows.append([int(i)])
        got = packing.best_fit_decreasing(lengths, width)
        assert sorted(sum(lengths[r]) for r in got) == sorted(sum(lengths[r]) for r in rows)
        assert sorted(i for r in got for i in r) == list(range(len(lengths)))
