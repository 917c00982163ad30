"""Pieces give back the library's ids; sequences are full; the subset sum against brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from policylake.llm import bin_slack, queries

ODD = ["it's we're 'T", "a<|endoftext|>b <|STARTOFTEXT|>", "  two  spaces\n\n end ", "x\x1cy\x85z", "é×÷ñ ßÀÝ", "中文 字", "1a2b  3", "H̱ ẖ Å", "Σς İ", "́a"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bin_slack.default_vocabulary())


def test_closest_against_all_multisets():
    rng = random.Random(3)
    for _ in range(200):
        counts = [(x, rng.randint(1, 3)) for x in sorted(rng.sample(range(1, 40), rng.randint(0, 5)), reverse=True)]
        room = rng.randint(0, 90)
        sums = [sum(n * x for n, (x, _) in zip(ns, counts)) for ns in itertools.product(*(range(c + 1) for _, c in counts))]
        picked = bin_slack.closest(counts, room)
        assert sum(x * n for x, n in picked) == max(s for s in sums if s <= room)
        assert all(0 < n <= dict(counts)[x] for x, n in picked)


def test_sequences_use_every_id_once():
    rng = random.Random(5)
    for _ in range(40):
        waiting, lengths = bin_slack.Waiting(64), [rng.randint(1, 64) for _ in range(rng.randint(0, 60))]
        for i, n in enumerate(lengths):
            waiting.add((i, 0, n))
        out = [*bin_slack.sequences(waiting, 300), *bin_slack.sequences(waiting, 0)]
        assert sorted((d, s + k) for q in out for d, s, n in q for k in range(n)) == [(d, k) for d, n in enumerate(lengths) for k in range(n)]
        sizes = [sum(n for _, _, n in q) for q in out]
        rest = [x for x in sizes if x != 64]
        assert all(x & (x - 1) == 0 for x in sizes) and sorted(set(rest), reverse=True) == rest


def check(rows, texts, library, width):
    """Pieces of each document in order give its ids; sequences are gapless and full or powers of two."""
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        documents.setdefault(r["doc_id"], []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= width and at & (at - 1) == 0
    want = {d: [library.encode(t or "", add_special_tokens=False).ids + [1] for t in ts] for d, ts in texts.items()}
    assert set(documents) == set(want)
    for d, parts in documents.items():
        assert sum(r["length"] for r in parts) == sum(map(len, want[d]))
        if len(want[d]) == 1:
            parts.sort(key=lambda r: r["start"])
            ids = np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist()
            assert ids == want[d][0] and {r["doc_tokens"] for r in parts} == {len(ids)}
            assert [r["start"] for r in parts] == np.r_[0, np.cumsum([r["length"] for r in parts])[:-1]].tolist()


@pytest.mark.parametrize("width, window", [(64, 1_500), (2048, 1_000_000)])
def test_round_trip(spark, documents, library, width, window):
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate([*ODD, "lo ng" * 30_000])], "doc_id long, text string")
    both = documents.select("doc_id", "text").unionAll(odd)
    texts: dict = {}
    for r in both.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    check(bin_slack.pack(both, width=width, window=window).collect(), texts, library, width)


def test_small_cache_and_parts(spark, documents, library, monkeypatch):
    monkeypatch.setattr(bin_slack, "CACHE", 50)
    monkeypatch.setattr(bin_slack, "PART", 40)
    encoder = bin_slack.Encoder(bin_slack.default_vocabulary())
    texts = [r["text"] or "" for r in documents.collect()] + ODD
    for t, ids in zip(texts, encoder.ids([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_clashing_columns_null_keys_and_nothing(spark, empty, library):
    rows = [(None, "a b", 1, 2), (None, None, 1, 2), (3, "", 1, 2)]
    named = spark.createDataFrame(rows, "doc_id long, text string, ids long, start long")
    got = bin_slack.pack(named).collect()
    check(got, {None: ["a b", None], 3: [""]}, library, 2048)
    assert bin_slack.pack(empty).collect() == []
    with pytest.raises(ValueError):
        bin_slack.pack(empty, width=100)


def test_other_vocabularies_are_refused(empty):
    import public_tokenizers

    with pytest.raises(ValueError):
        bin_slack.pack(empty, public_tokenizers.path("byte_bpe_50k.json"))


def test_query_digests(spark, tmp_path, library, documents):
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_bin_slack_packing(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    one = got.where("doc_id = 1 and start = 0").first()
    text = documents.where("doc_id = 1").first()["text"]
    ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")[: one["length"]]
    assert one["ids_crc32"] == zlib.crc32(ids.tobytes())
