"""Language, toxicity, main text, personal data and decontamination."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from policylake.llm import decontaminate, html_text, language_id, personal_data, toxicity

from .conftest import text


def worded(rng, stems, n):
    return " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(n))


LANGS = {"xx": ["ka", "to", "mi", "ru"], "yy": ["sch", "ein", "ung", "ber"], "zz": ["que", "eau", "oi", "ment"]}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows = [(i, worded(rng, LANGS[k], rng.randint(3, 60)), k) for i, k in enumerate(list(LANGS) * 30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_held_out_texts(spark, labelled):
    held = language_id.fold("doc_id", 3) == 1
    model = language_id.learned(labelled.where(~held))
    got = language_id.identify(labelled, model, ["doc_id", "lang"]).where(held).collect()
    assert got and all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "中文字" * 20), (5, "KATOMI-karu! " * 4000)], "doc_id long, text string")
    seen = {r["doc_id"]: r for r in language_id.identify(odd, model, ["doc_id"]).collect()}
    assert [seen[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and [seen[i]["score"] for i in (1, 2, 3)] == [0] * 3
    assert seen[4]["score"] == 0 and seen[5]["lang_pred"] == "xx"
    assert [r["doc_id"] for r in language_id.understood(odd, model).collect()] == [5]


def test_language_without_rows(labelled, empty, documents):
    none = language_id.learned(empty)
    assert {r["lang_pred"] for r in language_id.identify(labelled, none, ["doc_id"]).collect()} == {"und"}
    assert language_id.identify(empty, language_id.learned(labelled), ["doc_id"]).collect() == []
    assert language_id.understood(documents, language_id.learned(documents)).columns == documents.columns


def test_phrases_equal_a_plain_parse():
    rng = np.random.default_rng(0)
    known = rng.integers(0, 4, 200)
    parts = "".join(map(str, known)).split("0")
    for _ in range(20):
        one = rng.integers(0, 6, 70).astype(np.uint8)
        said, i, count = "".join(map(str, one)), 0, 0
        while i < len(said):
            j = i
            while j < len(said) and said[j] != "0" and any(said[i : j + 1] in p for p in parts):
                j += 1
            i, count = max(j, i + 1), count + 1
        step = language_id.automaton(known, language_id.ALPHABET)
        assert language_id.phrases(one, np.array([0, len(one)]), [step]).tolist() == [[count]]


def test_phrases_with_more_symbols_than_the_dense_table(monkeypatch):
    """The same parse with a dense table of 3 symbols and the rest as sorted pairs."""
    rng = np.random.default_rng(4)
    known, asked = rng.integers(0, 9, 300), [rng.integers(0, 11, 80).astype(np.uint32) for _ in range(12)]
    flat, at = np.concatenate(asked), np.arange(0, 80 * 13, 80)
    whole = language_id.automaton(known, language_id.ALPHABET)
    want = language_id.phrases(flat, at, [whole]).tolist()
    monkeypatch.setattr(language_id, "ALPHABET", 3)
    assert language_id.phrases(flat, at, [language_id.automaton(known, 3)]).tolist() == want


def test_languages_of_many_scripts_copies_and_signs(spark):
    """Two languages share each of two scripts; one text comes 3,000 times; signs are no letters."""
    rng = random.Random(9)
    script = {"ru": range(0x430, 0x440), "uk": range(0x43C, 0x450), "zh": range(0x4E00, 0x4E00 + 900), "ja": range(0x4E00 + 600, 0x4E00 + 1500), "old": range(0x20000, 0x20000 + 300)}

    def of(k):
        return " ".join("".join(chr(rng.choice(script[k])) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(20, 60)))

    rows = [(i, of(k), k) for i, k in enumerate(list(script) * 40)] + [(1000 + i, "the same text again", "en") for i in range(3000)]
    rows += [(5000 + i, worded(rng, LANGS["zz"], 40), "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    held = language_id.fold("doc_id", 3) == 1
    model = language_id.learned(df.where(~held))
    got = language_id.identify(df, model, ["doc_id", "lang"]).where(held).collect()
    for k in [*script, "en"]:
        mine = [r["lang_pred"] == k for r in got if r["lang"] == k]
        assert mine and sum(mine) >= 0.95 * len(mine), k
    assert language_id.understood(df.where("doc_id < 1000"), model).count() == 200
    signs = spark.createDataFrame([(1, "\U0001f600\U0001f680 \U0001f1e9\U0001f1ea"), (2, "\u2211 \u00d7 \u0301"), (3, "\U00020000\U00020001")], "doc_id long, text string")
    seen = {r["doc_id"]: r for r in language_id.identify(signs, model, ["doc_id"]).collect()}
    assert [(seen[i]["lang_pred"], seen[i]["n_letters"]) for i in (1, 2)] == [("und", 0)] * 2 and seen[3]["n_letters"] == seen[3]["n_rare"] == 2


def test_toxicity_on_held_out_texts(spark, empty):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words, toxic = text(rng, rng.randint(5, 60)).split(), i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["zorkfool", "zorkpest"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "!!")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5, 1, None), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    held = language_id.fold("doc_id", 5) == 0
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.learned(docs, marks, ~held), ["doc_id", held.alias("held_out")]).collect()}
    assert len(got) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    wrong = [i for i in range(400) if got[i]["held_out"] and got[i]["predicted"] != (i % 4 == 0)]
    assert not wrong and got[900]["score"] == got[901]["score"] == got[902]["score"] < 0.5
    unknown = toxicity.learned(docs, marks.where("toxic = 0"), ~held)
    assert {r["predicted"] for r in toxicity.score(docs, unknown, ["doc_id"]).collect()} == {0}
    assert toxicity.score(empty, unknown, ["doc_id"]).collect() == []


def test_toxicity_of_word_pairs_and_rare_words(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        words, toxic = text(rng, rng.randint(5, 40)).split(), i % 3 == 0
        at = rng.randrange(len(words))
        words[at:at] = ["bel", "tor"] if toxic else ["tor", "bel"]
        rows.append((i, " ".join([*words, "vexgrimly"] if i in (3, 6) else words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, "vexgrimly"), (901, "quasdorfn")], "doc_id long, text string")
    held = language_id.fold("doc_id", 5) == 0
    model = toxicity.learned(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), ~held & ~F.col("doc_id").isin(900, 901))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, ["doc_id", held.alias("held_out")]).collect()}
    assert [i for i in range(240) if got[i]["held_out"] and got[i]["predicted"] != (i % 3 == 0)] == []
    assert got[900]["score"] > got[901]["score"]
    # the same sums whether an expression is broadcast or joined
    model[0].keys, model[0].r = model[0].keys[:50], model[0].r[:50]
    joined = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all(abs(joined[i] - got[i]["score"]) < 1e-9 for i in got)


@pytest.mark.parametrize("n", [80, 150, 300])
def test_every_long_item_at_most_edits_is_found(n):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    items = [[rng.choice(words) for _ in range(n)] for _ in range(60)]
    texts = []
    for item in items:
        got = list(item)
        for _ in range(n // 5):
            at, kind = rng.randrange(len(got)), rng.randrange(3)
            got[at : at + (kind != 2)] = [] if kind == 1 else [rng.choice(words) + "x"]
        texts.append(" ".join([*(rng.choice(words) for _ in range(50)), *got, *(rng.choice(words) for _ in range(50))]))
    found = decontaminate._found(decontaminate.Items([" ".join(i) for i in items], 0.8), pa.array(texts))
    assert {(row, item) for row, item, *_ in found} >= {(i, i) for i in range(60)}


PAGE = """<html><head><title>No</title><style>p{{}}</style></head><body><nav><ul><li><a href=1>Home</a><li><a href=2>More</a></ul></nav>
<div class="ad">Buy it now.</div><article><h1>{0}</h1><p>{1} &amp; <b>bold</b>
 text<p>{2}<script>var x="<p>no</p>"</script></p></article><!-- no --><footer>&copy; site</footer></body></html>"""


def test_main_text(spark, empty):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(60):
        h, a, b = text(rng, 5), text(rng, 40), text(rng, 60)
        rows.append((i, f"u{i}", PAGE.format(h, a, b), "x"))
        want[i] = f"{h}\n{a} & bold text\n{b}"
    rows += [(100, "u", None, "x"), (101, "u", "", "x"), (102, "u", "<div", "x"), (103, None, "<script>never ends", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract(pages, html_text.trained(pages)).collect()}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert {i: got[i]["text"] for i in want} == want
    assert [got[i]["text"] for i in (100, 101, 103)] == [""] * 3
    assert html_text.extract(pages.limit(0), html_text.Labeller()).collect() == []


@pytest.mark.parametrize(("page", "want"), [("a<br>b", ["a b"]), ("<p>a<p>b</div>c", ["a", "b", "c"]), ("x &lt;b&gt; &#233;", ["x <b> é"]), ("<p>  </p>", []), ("<ul><li>a<li>b</ul>", ["a", "b"]), ("a <b>b</b>c", ["a bc"]),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be given.</p>", ["Let x=2 be given."]), ("<p>a <svg><path d='x'/></svg> b</p>", ["a b"]), ("<p>x<svg/>y</p><svg><title>q</title></svg>z", ["xy", "z"]),
    ('<p class="x>quote</p><p>next</p>', ["quote", "next"]), ("<p>a<script>1<2</script>b</p>", ["ab"]), ('<title>t</title><p title="a>b">c</p>', ["c"])])
def test_blocks(page, want):
    assert [t for t, _, _ in html_text.blocks(page)] == want


def test_every_word_of_a_long_block_counts():
    many = " ".join(f"w{i}" for i in range(200))
    _, _, words, _ = html_text._vectors([(many, ("<p",), 0), (many.replace("w100 ", "other "), ("<p",), 0)])
    assert words[0].sum() == pytest.approx(1.0) and (words[0] != words[1]).any()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(said):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, said):
            digits = re.sub("[^0-9]", "", m.group())
            odd = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and odd % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        said = "".join(rng.choice("0123456789 1.-+@ab().%é\n0002") for _ in range(rng.randint(0, 60)))
        assert personal_data.base(said) == plain_base(said)
    assert personal_data.base("4111 1111 1111 1111") == [(0, 19, "card")]


def test_personal_data(spark, empty):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        words = text(rng, 60).split()
        words.insert(rng.randrange(60), [f"ab.{i}@mail.example.com", f"10.20.{i}.7", f"+1 (555) 555-{1000 + i}", "plain"][i % 4])
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (502, "no mark")], "doc_id long, text string")
    model = personal_data.trained(docs, rounds=120)
    for r in personal_data.find(docs, model).collect():
        said = dict(rows).get(r["doc_id"], "")
        base = personal_data.joined(plain_base(said))
        assert r["base"] == base and set(base.split(",")) - {""} <= set(r["spans"].split(","))
        assert r["n_email"] == sum(k == "email" for *_, k in plain_base(said))
    alone = sum(set(plain_base(s)) <= set(personal_data.added(model, s, [])) for _, s in rows)
    assert alone >= 0.9 * len(rows)
    for _, s in rows[:20]:  # windows left out hold nothing
        assert personal_data.added(model, s, []) == personal_data.added(model, s, [], every=True)
    assert personal_data.find(empty, model).collect() == []


def fitting(item, words):
    before = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        now = [i]
        for j, x in enumerate(words, 1):
            now.append(min(before[j - 1] + (w != x), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def test_hits_equal_brute_force(spark, documents, empty):
    rng = random.Random(8)
    items = [(i, text(rng, n)) for i, n in enumerate([1, 3, 5, 12, 20, 33, 47])] + [(90, None), (91, " "), (92, text(rng, 9))]
    rows = []
    for i in range(80):
        words = text(rng, rng.randint(0, 90)).split()
        item = items[rng.randrange(7)][1].split()
        for _ in range(rng.randint(0, max(0, len(item) // 5 + 1))):
            k = rng.randrange(len(item) + 1)
            item[k : k + rng.randint(0, 1)] = [rng.choice(["qq", "Rr"])] if rng.random() < 0.7 else []
        at = rng.randrange(len(words) + 1)
        rows.append((i, " ".join([*words[:at], *item, *words[at:]])))
    docs = spark.createDataFrame([*rows, (300, None), (301, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t in rows:
        for i, s in items:
            item, words = (s or "").lower().split(), t.lower().split()
            if item and (e := fitting(item, words)) <= len(item) // 5:
                want[d, i] = e
    got = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in decontaminate.hits(docs, bench).collect()}
    assert all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.99 * len(want) and set(got) <= set(want)
    parts = decontaminate.hits(docs, bench, part_words=20)
    assert {(r["doc_id"], r["item_id"]) for r in parts.collect()} == set(got)
    left = decontaminate.without_hits(docs, bench)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({d for d, _ in rows} - {d for d, _ in got} | {300, 301})
    assert decontaminate.without_hits(documents, bench).columns == documents.columns
    assert decontaminate.hits(empty, bench).collect() == [] and decontaminate.hits(docs, bench.limit(0)).collect() == []
