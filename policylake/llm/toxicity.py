"""Toxicity by class-conditional Kneser-Ney models of words and word pairs with shared backoff counts.

The chain of a word w after v is: its first 5 bytes, its first 8 bytes (both for longer words only),
w, and the pair v w (v is a mark at the start of a text). Words are lower-cased runs of letters. An
entry e of the chain has in class c, with h = v for pairs and the whole class for the others, the chance

    p_c(e) = (max(n_c(e) - D, 0) + D * T_c(h) * p(e)) / N_c(h),

where p(e) is the shared lower order: the share of distinct pairs that end in w (or in a word with that
stem), over both classes. Whether the classes differ in e at all is uncertain; with the chance

    s = 1 / (1 + sqrt(d) / PRIOR * exp(-g)),    d: documents with e, g: log likelihood ratio over documents,

they do, and the log ratio of the classes is R(e) = (1 - s) * R(shorter) + s * log(p_1(e) / p_0(e)); an entry
never seen backs off to the shorter one, in the end to 0. So a rare expression weighs as much as its counts
say and none is left out. A text's log ratio is the sum over its words; per word and as a whole it goes
through a logistic curve.

Counts cover all labelled training rows: tasks add up and shuffle (expression, counts), and all
expressions are kept in a staged table that grows with the input. The most frequent `hot` ones are
also broadcast; a text's distinct other expressions are joined to the table, which gives the same sum.
A bit set leaves out what the table cannot have. The curve is fitted on about `calibration` labelled
rows, at most a fifth, with ratios from the counts of the other rows (with one class among these or
the others: on all of them, with all counts).

A null or empty text has ratio 0 and gets the score of an unmarked text. Rows without a
label are not learned from; a key with several labels counts once with the largest. Without any
label of one class every score is the share of toxic labels (0.5 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.llm import bytewise
from policylake.llm.staging import likely, maybe, small_batches, staged

DISCOUNT = 0.75
#: Odds that the classes differ in an expression, before its counts are seen.
PRIOR = 1e-3
PREFIXES = (5, 8)
STEM5, STEM8, WORD, PAIR = range(4)
START = np.uint64(0x5851F42D4C957F2D)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
HELD = 3_000_000
#: 16 MB of bits for what the table may have.
BITS = 27
#: Counts of both classes outside and inside the rows of the curve.
COUNTS = [f"{x}{i}" for x in "nd" for i in range(4)]


def _expressions(data: np.ndarray, at: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """(keys, keys of the shorter entry, keys of the context) of each level, 0 for none, and each word's row."""
    letters = np.where(_LETTER[data], bytewise.LOWER[data], 32).astype(np.uint8)
    start, end, of = bytewise.words(letters, at)
    word = bytewise.hashes(letters, start, end)
    five, eight = (np.where(end - start > n, bytewise.hashes(letters, start, np.minimum(end, start + n)) ^ np.uint64(n), np.uint64(0)) for n in PREFIXES)
    none = np.zeros(len(word), np.uint64)
    before = np.r_[none[:1], word[:-1]]
    before[np.r_[True, of[1:] != of[:-1]][: len(word)]] = START
    pair = bytewise.mix(before * np.uint64(0xD6E8FEB86659FD93) + word)
    return [(five, none, none), (eight, five, none), (word, np.where(eight != 0, eight, five), none), (pair, word, before)], of


def _added(key: np.ndarray, counts: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts summed by key; `rest` is the same for equal keys."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], np.add.reduceat(counts[order], first, axis=0), rest[order[first]]


def _counts(labelled: DataFrame) -> DataFrame:
    """(key, level, low, context, counts) of every expression: words and documents by `part`; key 0: all words, all documents."""
    small_batches(labelled.sparkSession)
    names = ["key", "level", "low", "context", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, counts, rest = _added(*(np.concatenate(c) for c in zip(*held, strict=True)))
            columns = [key.view(np.int64), *(np.ascontiguousarray(rest[:, j]).view(np.int64) for j in range(3)), *(np.ascontiguousarray(counts[:, j]) for j in range(8))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64)
            for row, end, data, at in bytewise.chunks(batch.column("text")):
                levels, of = _expressions(data, at)
                own = part[row:end]
                held.append((np.zeros(1, np.uint64), np.r_[np.bincount(own[of], minlength=4), np.bincount(own, minlength=4)][None], np.zeros((1, 3), np.uint64)))
                for level, (key, low, context) in enumerate(levels):
                    there = np.flatnonzero(key)
                    if not len(there):
                        continue
                    there = there[np.lexsort((of[there], key[there]))]
                    key, row_of = key[there], of[there]
                    new = np.r_[True, key[1:] != key[:-1]]
                    fresh = new | np.r_[True, row_of[1:] != row_of[:-1]]
                    first, place = np.flatnonzero(new), (np.cumsum(new) - 1) * 4 + own[row_of]
                    counts = np.concatenate([np.bincount(x, minlength=4 * len(first)).reshape(-1, 4) for x in (place, place[fresh])], axis=1)
                    rest = np.column_stack([np.full(len(first), level, np.uint64), low[there[first]], context[there[first]]])
                    held.append((key[first], counts, rest))
                    size += len(first)
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    parts = labelled.select("text", "part").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return parts.groupBy("key").agg(*(F.max(c).alias(c) for c in names[1:4]), *(F.sum(c).alias(c) for c in COUNTS))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (_k, text) whose key may be in `labels`."""
    bits = rows.sparkSession.sparkContext.broadcast(likely(labels.select(F.xxhash64("_k").alias("_h")), "_h"))
    hashed = rows.select("*", F.xxhash64("_k").alias("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe(bits.value, batch.column("_h").to_numpy().view(np.uint64))))

    return hashed.mapInArrow(run, hashed.schema).drop("_h")


def _sides(whole: bool) -> tuple[list[str], list[str]]:
    """Words and documents of the two classes: of all rows, or without the rows of the curve."""
    return tuple([f"({x}{c} + {x}{c + 2})" if whole else f"{x}{c}" for c in (0, 1)] for x in "nd")


def _ratio(whole: bool, words: list, types: list, texts: list, lower: str) -> Column:
    """R of an expression from its counts, those of its context, and R of the shorter one."""
    n, d = ([F.expr(x) for x in xs] for xs in _sides(whole))
    one, two = ((F.greatest(n[c] - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.greatest(types[c], F.lit(1)) * F.col("share")) / F.greatest(words[c], F.lit(1.0)) for c in (0, 1))
    seen, size = d[0] + d[1], F.greatest(texts[0] + texts[1], F.lit(1))

    def gain(have: Column, mean: Column) -> Column:
        return F.when(have > 0, have * F.log(have / F.greatest(mean, F.lit(1e-12)))).otherwise(0.0)

    g = sum((gain(d[c], seen * texts[c] / size) + gain(texts[c] - d[c], (size - seen) * texts[c] / size) for c in (0, 1)), start=F.lit(0.0))
    sure = 1 / (1 + F.exp(F.least(F.lit(600.0), 0.5 * F.log(seen) - np.log(PRIOR) - g)))
    return F.when((seen > 0) & (words[0] > 0) & (words[1] > 0), (1 - sure) * F.col(lower) + sure * (F.log(two) - F.log(one))).otherwise(F.col(lower))


def _table(counts: DataFrame) -> DataFrame:
    """(key, r, rest, n): what every expression adds to the log ratio, from all rows and without those of the curve."""
    total = counts.where("key = 0").first()
    pairs, level = counts.where(f"level = {PAIR} AND key <> 0"), {x: counts.where(f"level = {x} AND key <> 0") for x in (STEM5, STEM8, WORD)}
    ends = pairs.groupBy("low").agg(F.count("*").alias("ends"))
    word = staged(level[WORD].join(ends.withColumnRenamed("low", "key"), "key"), "words")
    stem = staged(word.where("low <> 0").groupBy("low").agg(F.sum("ends").alias("ends")), "stems").withColumnRenamed("low", "key")
    eight = staged(level[STEM8].join(stem, "key"), "stems")
    five_ends = stem.union(eight.groupBy("low").agg(F.sum("ends"))).groupBy("key").agg(F.sum("ends").alias("ends"))
    five = level[STEM5].join(five_ends, "key")
    most = float(word.agg(F.sum("ends")).first()[0] or 1)
    out, lower = [], None
    for own in (five, eight, word):
        kinds = own.agg(*(F.count_if(F.expr(n) > 0).alias(f"{w}{c}") for w in "ab" for c, n in enumerate(_sides(w == "a")[0]))).first()
        here = own.withColumn("share", F.col("ends") / most)
        here = here.join(lower, "low", "left") if lower is not None else here.withColumns({"ra": F.lit(None).cast("double"), "rb": F.lit(None).cast("double")})
        here = here.withColumns({"ra": F.coalesce("ra", F.lit(0.0)), "rb": F.coalesce("rb", F.lit(0.0))})
        done = here.withColumns({
            f"r{w}2": _ratio(w == "a", *([F.lit(float(total[f"{x}{c}"] + (total[f"{x}{c + 2}"] if w == "a" else 0))) for c in (0, 1)] if x else [F.lit(float(kinds[f"{w}{c}"])) for c in (0, 1)] for x in ("n", "", "d")), f"r{w}")
            for w in "ab"
        })
        done = staged(done.select("key", "ra2", "rb2", "ends", *COUNTS, (F.col("ra2") - F.col("ra")).alias("r"), (F.col("rb2") - F.col("rb")).alias("rest")), "ratios")
        out.append(done)
        up = done.select(F.col("key").alias("low"), F.col("ra2").alias("ra"), F.col("rb2").alias("rb"))
        lower = up if lower is None else staged(lower.union(up), "lower")
    last = out[-1].select(F.col("key").alias("low"), F.col("ra2").alias("ra"), F.col("rb2").alias("rb"), (F.col("ends") / most).alias("share"))
    docs = out[-1].select(F.col("key").alias("context"), *(F.expr(d).alias(f"t{w}{c}") for w in "ab" for c, d in enumerate(_sides(w == "a")[1])))
    sums = [f(F.expr(n)).alias(f"{x}{w}{c}") for w in "ab" for c, n in enumerate(_sides(w == "a")[0]) for x, f in (("w", F.sum), ("k", lambda n: F.count_if(n > 0)))]
    around = staged(pairs.groupBy("context").agg(*sums).join(docs, "context", "left"), "contexts")
    around = around.withColumns({f"t{w}{c}": F.coalesce(f"t{w}{c}", F.lit(total[f"d{c}"] + (total[f"d{c + 2}"] if w == "a" else 0))) for w in "ab" for c in (0, 1)})
    wide = pairs.join(last, "low").join(around, "context")
    ratio = {w: _ratio(w == "a", *([F.col(f"{x}{w}{c}").cast("double") for c in (0, 1)] for x in "wkt"), f"r{w}") - F.col(f"r{w}") for w in "ab"}
    size = sum((F.col(f"n{i}") for i in range(1, 4)), start=F.col("n0"))
    whole = wide.select("key", ratio["a"].alias("r"), ratio["b"].alias("rest"), size.alias("n"))
    for one in out:
        whole = whole.union(one.select("key", "r", "rest", size.alias("n")))
    return staged(whole, "expressions")


class Ratios:
    """The staged table, its most frequent rows (keys, ratios of both kinds) and the bits of all its keys."""

    def __init__(self, table: DataFrame, hot: int):
        self.table, self.bits = table, likely(table.select("key"), "key", BITS)
        top = table.orderBy(F.desc("n"), "key").limit(hot).toArrow()
        keys = top.column("key").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.r, self.rest = keys[order], top.column("r").to_numpy()[order], top.column("rest").to_numpy()[order]


def _likelihoods(rows: DataFrame, ratios: Ratios | None, carried: list[Column | str], kind: str = "r") -> DataFrame:
    """`carried`, _ratio (sum of log ratios) and _words of every row; reads only `text`."""
    small_batches(rows.sparkSession)
    known = (ratios.keys, getattr(ratios, kind), ratios.bits) if ratios else (np.empty(0, np.uint64), np.empty(0), np.zeros(1 << (BITS - 6), np.uint64))
    shared = rows.sparkSession.sparkContext.broadcast(known)
    slim = rows.select(*carried, F.monotonically_increasing_id().alias("_row"), F.col("text").cast("string").alias("_text"))
    names = slim.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, ratio, bits = shared.value
        for whole in batches:
            for row, end, data, at in bytewise.chunks(whole.column("_text")):
                batch = whole.slice(row, end - row)
                levels, of = _expressions(data, at)
                total = np.zeros(end - row)
                late_key, late_row = [], []
                for key, _, _ in levels if len(hot) else []:
                    there = np.flatnonzero(key)
                    key, own = key[there], of[there]
                    place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    hit = hot[place] == key
                    total += np.bincount(own[hit], weights=ratio[place[hit]], minlength=end - row)
                    late = ~hit & maybe(bits, key, BITS)
                    late_key.append(key[late])
                    late_row.append(own[late])
                key, own = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((late_key, np.uint64), (late_row, np.int64)))
                order = np.lexsort((key, own))
                key, own = key[order], own[order]
                first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])][: len(key)])
                times = np.diff(np.r_[first, len(key)]).astype(np.int32)
                edge = np.r_[0, np.cumsum(np.bincount(own[first], minlength=end - row))].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x)) for x in (key[first].view(np.int64), times)]
                words = np.bincount(of, minlength=end - row).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(total), pa.array(words), *lists], [*names, "_hot", "_words", "_keys", "_times"])

    kinds = "".join(f"`{n}` {slim.schema[n].dataType.simpleString()}, " for n in names)
    done = slim.mapInArrow(run, f"{kinds}_hot double, _words long, _keys array<long>, _times array<int>")
    if ratios is None:
        return done.select(*names[:-1], F.col("_hot").alias("_ratio"), "_words")
    done = staged(done, "texts")
    late = done.select("_row", F.explode(F.arrays_zip("_keys", "_times")).alias("e")).select("_row", F.col("e._keys").alias("key"), F.col("e._times").alias("times"))
    sums = late.join(ratios.table.select("key", kind), "key").groupBy("_row").agg(F.sum(F.col("times") * F.col(kind)).alias("_late"))
    return done.join(sums, "_row", "left").select(*names[:-1], (F.col("_hot") + F.coalesce("_late", F.lit(0.0))).alias("_ratio"), "_words")


def _features(ratio, words):
    """Per word, and as a whole; both 0 for an unmarked text."""
    size = F.abs(ratio) if isinstance(ratio, Column) else abs(ratio)
    return ratio / (words + 1.0), ratio / (size + 4.0)


def _curve(ratio: np.ndarray, words: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(ratio)), *_features(ratio, words)])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (label - p) - 1e-2 * w)
    return w


def learned(documents: DataFrame, labels: DataFrame, trained: Column, hot: int = 131_072, calibration: int = 20_000, key: str = "doc_id"):
    """The ratios and the curve, from the rows of `documents` where `trained` holds."""
    own = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = documents.where(trained).select(F.col(key).alias("_k"), F.col("text").cast("string").alias("text"))
    share = min(0.2, calibration / max(1, own.count()))
    mine = (F.shiftrightunsigned(F.xxhash64("_k", F.lit(5)), 11) / float(1 << 53)) < share
    own = own.withColumn("part", F.col("toxic") + F.when(mine, 2).otherwise(0))
    # merge at every size: neither side has a bound; texts without a label do not travel
    counts = staged(_counts(_labelled(rows, own).join(own.hint("merge"), "_k")), "counts")
    found = counts.where("key = 0").first()
    part = [found[f"d{i}"] if found else 0 for i in range(4)]
    if not (part[0] + part[2] and part[1] + part[3]):
        toxic = (part[1] + part[3]) / sum(part) if sum(part) else 0.5
        return None, np.array([np.log((toxic + 1e-9) / (1 - toxic + 1e-9)), 0.0, 0.0])
    ratios = Ratios(_table(counts), hot)
    apart = all(part)
    some = own.where("part >= 2") if apart else own.orderBy(F.xxhash64("_k", F.lit(5))).limit(calibration)
    chosen = _labelled(rows, some).join(F.broadcast(some), "_k")
    scored = _likelihoods(chosen, ratios, ["_k", "toxic"], "rest" if apart else "r").orderBy("_k").select("toxic", "_ratio", "_words").toArrow()
    label = scored.column("toxic").to_numpy().astype(float)
    return ratios, _curve(scored.column("_ratio").to_numpy().astype(float), scored.column("_words").to_numpy().astype(float), label)


def score(documents: DataFrame, model, carried: list[Column | str]) -> DataFrame:
    """`carried`, score and predicted of every row."""
    ratios, curve = model
    done = _likelihoods(documents, ratios, carried)
    names = done.columns[:-2]
    per_word, whole = _features(F.col("_ratio"), F.col("_words"))
    chance = 1 / (1 + F.exp(-(float(curve[0]) + float(curve[1]) * per_word + float(curve[2]) * whole)))
    return done.select(*names, chance.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
