"""Rank-one updates, merged spectra and whole results against dense linear algebra."""

import math

import numpy as np
import pytest

from policylake.llm import queries, whitening


def test_rank_one_updates_against_a_dense_solver():
    rng = np.random.default_rng(0)
    for t in range(200):
        d = int(rng.integers(1, 20))
        values = np.sort(rng.choice([0, 0, 1, 2, 3, rng.random() * 1e6, rng.random(), rng.random() * 1e-9], d))
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        v = q[:, 0] * 2 if t % 3 == 0 else rng.normal(size=d) * 10.0 ** rng.integers(-8, 4)
        a = (q * values) @ q.T + np.outer(v, v)
        got, vectors = whitening.rank_one(values, q, v)
        size = np.abs(a).max()
        assert np.abs(np.linalg.eigvalsh(a) - got).max() < 1e-12 * size
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
        assert np.abs((vectors * got) @ vectors.T - a).max() < 1e-12 * size


def test_secular_roots_interlace():
    d, z2 = np.array([0.0, 1.0, 1.0 + 1e-9, 5.0]), np.array([1e-14, 2.0, 1e-3, 1e3])
    roots, delta = whitening.secular_roots(d, z2)
    assert np.all(roots[:-1] <= d[1:]) and np.all(roots >= d) and roots[-1] <= d[-1] + z2.sum()
    dense = np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(z2), np.sqrt(z2)))
    assert np.allclose(roots, dense, rtol=1e-12, atol=1e-12)
    assert np.allclose(delta, d - roots[:, None], rtol=1e-6, atol=1e-12)


def test_merged_spectra():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7)) * 30)
    parts = []
    for block in (x[:1], x[1:4], x[4:160], x[160:]):
        part = whitening.Spectrum.none(7)
        part.take(len(block), whitening._exact_sums(block), block.mean(axis=0), block - block.mean(axis=0))
        parts.append(whitening.Spectrum.unpacked(*part.packed()))
    whole = parts[0]
    for p in parts[1:]:
        whole.add(p)
    assert whole.n == 300 and whole.sums == [int(s) + 300 * 1_000_000 for s in x.sum(axis=0)]
    scatter = np.cov(x.T, bias=True) * 300
    assert np.abs((whole.vectors * whole.values) @ whole.vectors.T - scatter).max() < 1e-12 * np.abs(scatter).max()


def brute(vectors, components=32):
    """(x, S, eigenvalues, eigenvectors, trace) of the rows kept, from the definition."""
    kept = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(map(len, kept))
    x = [[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for v in kept]
    sums = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array([[r[j] - sums[j] / len(x) for j in range(d)] for r in x])
    v = centred.T @ centred / len(x)
    e, q = np.linalg.eigh(v)
    return x, sums, e[::-1][:components], q[:, ::-1][:, :components], np.trace(v), centred


def compare(rows, model, vectors):
    x, sums, e, q, trace, centred = brute(vectors)
    k = len(model.values)
    assert model.n == len(x) == len(rows) and model.sums == sums and np.all(e[k:] <= 1e-9 * e[0])
    assert np.allclose(model.explained, e[:k] / trace, rtol=1e-9) and model.identity_error < 1e-9
    got = np.array([r["whitened"] for r in rows]).reshape(len(x), k)
    want = centred @ q[:, :k] / np.sqrt(e[:k])
    sign = np.sign((got * want).sum(axis=0))
    apart = np.array([np.abs(np.delete(e, i) - e[i]).min(initial=np.inf) > 1e-6 * e[0] for i in range(k)])
    assert np.allclose((got * sign)[:, apart], want[:, apart], atol=1e-6)
    for r, row in zip(rows, x, strict=True):
        assert int(r["deviation"]) == sum((len(x) * a - s) ** 2 for a, s in zip(row, sums, strict=True))


SCHEMA = "vec_id long, embedding array<float>, n long, part long, v int"


def table(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in enumerate(vectors)], schema).repartition(5)


def vectors_of(count, d, seed):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(c)) for c in v] for v in rng.normal(size=(count, d)) @ rng.normal(size=(d, d))]


@pytest.mark.parametrize("d", [1, 6, 40])
def test_against_the_definition(spark, d):
    vectors = vectors_of(200, d, d)
    vectors += [vectors[0]] * 30 + [None, [None] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1)]
    rows = table(spark, vectors)
    model = whitening.fitted(rows)
    got = sorted(whitening.whitened(rows, model).collect(), key=lambda r: r["vec_id"])
    assert got[0].__fields__ == ["vec_id", "deviation", "whitened"]
    compare(got, model, vectors)


def test_many_parts_meet_in_a_tree(spark):
    vectors = vectors_of(150, 3, 9)
    rows = table(spark, vectors).repartition(70)
    compare(sorted(whitening.whitened(rows, model := whitening.fitted(rows)).collect(), key=lambda r: r["vec_id"]), model, vectors)


def test_short_empty_and_constant(spark):
    vectors = [v[: 2 + i % 4] + [0.0] for i, v in enumerate(vectors_of(60, 5, 2))] + [[], [1.0]]
    rows = table(spark, vectors)
    compare(sorted(whitening.whitened(rows, model := whitening.fitted(rows)).collect(), key=lambda r: r["vec_id"]), model, vectors)


def test_large_entries_and_deviations_beyond_64_bits(spark):
    vectors = [[float(x), 2.0] for x in (1 << 40, 1 << 41, 5)]
    rows = table(spark, vectors, "vec_id long, embedding array<double>, n long, part long, v int")
    compare(sorted(whitening.whitened(rows, model := whitening.fitted(rows)).collect(), key=lambda r: r["vec_id"]), model, vectors)
    far = table(spark, [[3e38], [-3e38], [0.0]])
    model = whitening.fitted(far)
    assert model.sums == [3_000_000] and model.n == 3


def test_one_row_equal_rows_and_nothing(spark):
    for vectors in ([[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]]):
        rows = table(spark, vectors)
        model = whitening.fitted(rows)
        assert model.n == len(vectors) and len(model.values) == 0
        assert [r["whitened"] for r in whitening.whitened(rows, model).collect()] == [[]] * len(vectors)
    for vectors in ([], [None, [float("nan")]]):
        rows = table(spark, vectors)
        model = whitening.fitted(rows)
        assert model is None and whitening.whitened(rows, model).collect() == []
    with pytest.raises(ValueError):
        whitening.fitted(table(spark, [[0.0] * 5000]))


def test_query(spark, tmp_path):
    vectors = vectors_of(90, 40, 1)
    table(spark, [*vectors, None]).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op13_embedding_whitening(spark, str(tmp_path))
    kinds = [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert got.dtypes == kinds
    rows = got.collect()
    assert sorted((r["vec_id"], r["component"]) for r in rows) == [(i, c + 1) for i in range(90) for c in range(32)]
    assert {r["n"] for r in rows} == {90} and len({r["identity_error"] for r in rows}) == 1
    table(spark, []).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    none = queries.op13_embedding_whitening(spark, str(tmp_path / "none"))
    assert none.dtypes == kinds and none.collect() == []
