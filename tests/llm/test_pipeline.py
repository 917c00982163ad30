"""The pipeline on a small folder: what each stage keeps, against plain rules."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from policylake.llm import packing, pretokens

from .conftest import text
from .test_duplicates import classes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, corpus):
    rng = random.Random(9)
    item = text(rng, 30)
    texts = [*corpus, f"{text(rng, 20)} {item} {text(rng, 20)}", f"{text(rng, 40)} " + item.replace(item.split()[5], "other", 1), "中文字 " * 30]
    rows = [(i, t, "en", ["a", "b", None][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows


def test_stages(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, at).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = sorted(r["doc_id"] for r in docs.collect())
    by_id = {r[0]: r for r in rows}
    known = [i for i, r in by_id.items() if r[1] and any(c.isalpha() and c < "　" for c in r[1])]
    assert kept["language_id"] == known
    groups = classes([by_id[i] for i in known], 5, 80)
    assert kept["near_duplicates"] == sorted({c for _, c in groups.values()})
    last = len(rows) - 1
    assert kept["decontamination"] == [i for i in kept["near_duplicates"] if i not in (last - 1, last - 2)]
    assert set(kept["source_mix"]) <= set(kept["decontamination"]) and max(map(kept["source_mix"].count, kept["source_mix"])) <= 2
    library = Tokenizer.from_file(pretokens.default_vocabulary())
    want = sorted((r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect())
    packs = corpus_pipeline.STAGES[-1][1](spark, docs, at)
    parts = sorted((r["doc_id"], r["piece"], np.frombuffer(r["ids"], "<u2").tolist()) for r in packing.unpacked(packs).collect())
    assert sum(len(p[2]) for p in parts) == sum(len(w[1]) for w in want)
    single = [w for w in want if [x[0] for x in want].count(w[0]) == 1]
    for doc, ids in single:
        assert [x for d, _, part in parts if d == doc for x in part] == ids


def test_run_agrees_with_itself(spark, folder):
    at, _ = folder
    one, two = (corpus_pipeline.run(spark, at) for _ in range(2))
    assert sorted(map(sorted, (r["doc_ids"] for r in one.collect()))) == sorted(map(sorted, (r["doc_ids"] for r in two.collect())))


def test_no_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
