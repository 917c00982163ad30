"""Collocations by language: phrases mined by Toivonen's sampling with exact counts.

ASCII letters are lower-cased, texts end pieces at `[.,;:!?\\x0A-\\x0D]`, words are what lies between
spaces and tabs. A sample (one document in `one_in`, by hash of key and text) proposes the phrases of 1 to
3 words that reach a lowered threshold there. One pass over all documents counts the proposed phrases
and their negative border exactly: every phrase whose two parts without its last or first word are
proposed (for words: all). A border phrase that reaches the threshold is a failure of the sample; it
joins the proposed ones, and a further pass counts the border phrases that this adds, until no failure is
left. Phrases of `most` words need no further border, so there are at most `most` passes.

Phrases travel as 62-bit keys, a hash of language and words; the odds that any frequent phrase shares
its key are below (frequent phrases x distinct phrases) / 2^62. Proposed ones go to the tasks as a bit
array of at most 2^27 bits, two bits for each key, whatever their number: a phrase that hits set bits by
chance is counted too, so full arrays only mean more counting. The words of the keys that reached the
threshold are read last: of a key's occurrences a share, by hash of key and document, is spelled out,
then a larger one for keys still without words, then every one.

Counts are added up in each task before the shuffle, so a frequent word, phrase or language is one row
a buffer. The first `top` of a language are taken from `SALTS` parts first. Very long texts are counted
in parts that overlap by three words.

A null text is empty, a null language is `und` (as is a language of that name), repeated rows count as
often as they come. Ties of score and count go by the phrase's bytes. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from policylake.llm import bytewise
from policylake.llm.staging import likely, maybe, small_batches, staged

SALTS = 64
#: Keys gathered before a task adds them up and passes them on.
BUFFER = 2_000_000
#: A text of more than four times this many bytes is counted in parts of about this size.
PART = bytewise.CHUNK
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*b".,;:!?", *range(10, 14)]] = True
_INSIDE = ~_SEPARATOR
_INSIDE[[9, 32]] = False
_GAP = re.compile(rb"[ \t]")
_AFTER = re.compile(rb"(?:[ \t]+[^ \t]+){0,3}")
_STEP = np.uint64(0xD6E8FEB86659FD93)


def parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, end of the words to start from) of runs of rows or parts of a long one."""
    for row, _, data, at in bytewise.chunks(column):
        if len(at) > 2 or len(data) <= 4 * PART:
            yield row, data, at, len(data)
            continue
        text, start = data.tobytes(), 0
        while start < len(text):
            gap = _GAP.search(text, start + PART)
            end = gap.start() if gap else len(text)
            far = _AFTER.match(text, end).end()
            yield row, data[start:far], np.array([0, far - start]), end - start
            start = end


class Words:
    """Words of a run of rows, and the key of every phrase that starts at a word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, end: int, salt: np.ndarray):
        self.low = bytewise.LOWER[data]
        inside = _INSIDE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(at, self.start, "right") - 1
        self.row = row
        breaks = np.cumsum(_SEPARATOR[data])
        self.piece = (breaks[self.start] + row) if len(data) else row
        self.own = int(np.searchsorted(self.start, end))
        self.word = bytewise.hashes(self.low, self.start, self.end) if len(data) else np.empty(0, np.uint64)
        self.salt = salt[row]

    def keys(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, key of the n words from each word on, whether they lie in one piece) for n = 1 to `most`."""
        key = bytewise.mix(self.word ^ self.salt)
        ok = np.ones(len(key), bool)
        for n in range(1, most + 1):
            if n > 1:
                key = bytewise.mix(key[:-1] * _STEP + self.word[n - 1 :])
                ok = self.piece[n - 1 :] == self.piece[: len(key)]
            if not len(key):
                return
            yield n, (key & ~np.uint64(3)) | np.uint64(n - 1), ok

    def phrase(self, first: int, n: int) -> str:
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.start[first : first + n], self.end[first : first + n], strict=True)).decode()


def _held(bits: np.ndarray, size: int, key: np.ndarray) -> np.ndarray:
    return maybe(bits, key, size) & maybe(bits, key << np.uint64(28), size)


def _bits(keys: DataFrame, size: int) -> np.ndarray:
    return likely(keys.select("key", F.shiftleft("key", 28).alias("next")), "key", size) | likely(keys.select(F.shiftleft("key", 28).alias("next")), "next", size)


def _size(keys: DataFrame) -> int:
    return int(np.clip((16 * keys.count()).bit_length(), 20, 27))


def _slim(documents: DataFrame, key: str) -> DataFrame:
    text, lang = F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return documents.select(lang.alias("lang"), F.xxhash64(lang).alias("salt"), text.alias("text"), F.xxhash64(F.col(key), text).alias("pick"))


def counts(slim: DataFrame, levels: range, most: int, proposed: tuple[np.ndarray, int] | None, before: np.ndarray | None = None) -> DataFrame:
    """Occurrences by key of the phrases of `levels` words whose parts are all proposed (and were not `before`)."""
    shared = slim.sparkSession.sparkContext.broadcast((proposed, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = shared.value
        held: list[np.ndarray] = []
        size = 0

        def added() -> pa.RecordBatch:
            nonlocal held, size
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "c"])

        for batch in batches:
            salts = batch.column("salt").to_numpy().view(np.uint64)
            for row, data, at, end in parts(batch.column("text")):
                words = Words(data, at, end, salts[row : row + len(at) - 1])
                fine = past = None
                for n, key, ok in words.keys(min(most, levels.stop - 1)):
                    counted = ok.copy()
                    if n > 1 and now is not None:
                        counted &= fine[:-1] & fine[1:]
                        if old is not None:
                            counted &= ~(past[:-1] & past[1:])
                    elif old is not None:
                        counted[:] = False
                    if now is not None and n < most:
                        fine = _held(now[0], now[1], key) & ok
                        past = _held(old, now[1], key) & ok if old is not None else None
                    if n in levels:
                        got = key[: words.own][counted[: words.own]]
                        held.append(got)
                        size += len(got)
                if size >= BUFFER:
                    yield added()
        if size:
            yield added()

    rows = slim.select("salt", "text").mapInArrow(run, "key long, c long")
    return rows.groupBy("key").agg(F.sum("c").alias("c"))


def frequent(documents: DataFrame, least: int = 30, most: int = 4, one_in: int = 4, key: str = "doc_id") -> DataFrame:
    """lang, phrase, size, f of every phrase of 1 to `most` words with f >= least; size 0: all words of the language."""
    if not 1 <= most <= 4:
        raise ValueError("phrases have 1 to 4 words")
    small_batches(documents.sparkSession)
    slim = _slim(documents, key)
    low = max(2, least // (2 * one_in))
    sample = slim.where(F.pmod("pick", F.lit(one_in)) == 0)
    short = staged(counts(sample, range(1, 3), most, None).where(F.col("c") >= low), "phrases-sample")
    if most > 3:
        size = _size(short)
        longer = counts(sample, range(3, 4), most, (_bits(short, size), size))
        short = staged(short.unionAll(longer.where(F.col("c") >= low)), "phrases-proposed")
    size = _size(short)
    bits = _bits(short, size)
    found, before = [], None
    while True:
        reached = counts(slim, range(1, most + 1), most, (bits, size), before).where(F.col("c") >= least)
        found.append(staged(reached, "phrases-counted"))
        joined = bits | _bits(found[-1].where(F.col("key").bitwiseAND(3) < most - 1), size)
        if np.array_equal(joined, bits):
            break
        before, bits = bits, joined
    counted = found[0]
    for more in found[1:]:
        counted = counted.unionAll(more)
    return _named(slim, counted, most)


#: Of a key's occurrences one in so many is spelled out, round by round.
SPELLED = (16, 4, 1)


def _named(slim: DataFrame, counted: DataFrame, most: int) -> DataFrame:
    """lang, phrase, size, f of all counted keys, and the number of words of each language (size 0)."""
    kinds = "lang string, phrase string, size int, key long, c long"
    names = None
    for one_in in SPELLED:
        open_ = counted if names is None else staged(counted.join(names.select("key"), "key", "left_anti"), "phrases-unnamed")
        if names is not None and not open_.limit(1).count():
            break
        size = _size(open_)
        rows = slim.select("lang", "salt", "text", "pick").mapInArrow(_speller(slim, _bits(open_, size), size, most, one_in, names is None), kinds)
        found = rows.groupBy("lang", "phrase", "size", "key").agg(F.sum("c").alias("n"))
        known = found.where("size = 0").unionAll(found.where("size > 0").join(open_.select("key"), "key", "left_semi").select(found.columns))
        names = staged(known if names is None else names.unionAll(known), "phrases-named")
    phrases = names.where("size > 0").join(counted, "key").select("lang", "phrase", "size", F.col("c").alias("f"))
    return phrases.unionAll(names.where("size = 0").select("lang", "phrase", "size", F.col("n").alias("f")))


def _speller(slim: DataFrame, bits: np.ndarray, size: int, most: int, one_in: int, totals: bool):
    """Task code: the words of some occurrences of every key in `bits`, each once a buffer."""
    shared = slim.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        spelled: dict[int, tuple] = {}
        total: dict[str, int] = {}

        def ready() -> pa.RecordBatch:
            rows = [*spelled.values(), *((lang, "", 0, 0, n) for lang, n in total.items())]
            spelled.clear()
            total.clear()
            cols = zip(*rows, strict=True)
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["lang", "phrase", "size", "key", "c"])

        for batch in batches:
            langs, salts, picks = batch.column("lang").to_pylist(), batch.column("salt").to_numpy().view(np.uint64), batch.column("pick").to_numpy().view(np.uint64)
            for row, data, at, end in parts(batch.column("text")):
                words = Words(data, at, end, salts[row : row + len(at) - 1])
                if totals:
                    for i, n in zip(*np.unique(words.row[: words.own], return_counts=True), strict=True):
                        total[langs[row + i]] = total.get(langs[row + i], 0) + int(n)
                pick = picks[row + words.row]
                for n, key, ok in words.keys(most):
                    place = np.flatnonzero(ok[: words.own])
                    if one_in > 1:
                        place = place[bytewise.mix(key[place] ^ pick[place]) % np.uint64(one_in) == 0]
                    place = place[_held(known, size, key[place])]
                    one, where = np.unique(key[place], return_index=True)
                    for k, i in zip(one.view(np.int64).tolist(), place[where].tolist(), strict=True):
                        if k not in spelled:
                            spelled[k] = (langs[row + int(words.row[i])], words.phrase(i, n), n, k, 1)
                if len(spelled) > BUFFER // 10:
                    yield ready()
        if spelled or total:
            yield ready()

    return run


def _spans(words: str, least: str, most: str) -> F.Column:
    """All runs of `least` to `most` of the words, joined by a space."""
    return F.expr(
        f"flatten(transform(sequence({least}, {most}), m -> transform(sequence(1, size({words}) - m + 1), i -> array_join(slice({words}, i, m), ' '))))"
    )


def collocations(documents: DataFrame, least: int = 30, most: int = 4, top: int = 2000, one_in: int = 4, key: str = "doc_id") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases.

    a, l, r count the phrase and its two parts at its lowest-scoring cut, n the language's words; the
    score is floor(2000000 a / (l + r)). Phrases inside a longer one with at least 0.8 of their count go.
    """
    counted = staged(frequent(documents, least, most, one_in, key), "phrases")
    known = counted.where("size > 0").select("lang", "phrase", "f")
    phrases = counted.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    inside = (
        phrases.where("size(words) > 2")
        .select("lang", "a", F.explode(_spans("words", "2", "size(words) - 1")).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    wide = "cast({} as decimal(38, 0))"
    own = (
        phrases.join(inside, ["lang", "phrase"], "left")
        .where(F.expr(f"longer is null or {wide.format('longer')} * 100 < {wide.format('a')} * 80"))
        .select("lang", "phrase", "a", F.explode(F.expr("transform(sequence(1, size(words) - 1), k -> struct(k, array_join(slice(words, 1, k), ' ') as head, array_join(slice(words, k + 1, size(words) - k), ' ') as rest))")).alias("cut"))
        .select("lang", "phrase", "a", "cut.k", "cut.head", "cut.rest")
    )
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr(f"({wide.format('a')} * 2000000) div ({wide.format('l')} + {wide.format('r')})")
    scored = own.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("b")).select("lang", "phrase", "b.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counted.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows by counting every phrase of 1 to 4 words.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS words FROM pieces),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS m),
places AS (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w, sizes WHERE len(words) >= m),
f AS (
  SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM places GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE m >= 2),
sub AS (SELECT c.lang, c.a, c.words, s.m, unnest(range(1, c.m - s.m + 2)) AS i FROM cand c JOIN sizes s ON s.m >= 2 AND s.m < c.m),
inside AS (SELECT lang, array_to_string(words[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM sub GROUP BY ALL),
own AS (
  SELECT c.* FROM cand c LEFT JOIN inside i USING (lang, phrase)
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * c.a),
cut AS (SELECT lang, phrase, a, words, m, unnest(range(1, m)) AS k FROM own),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, CAST((2000000::HUGEINT * c.a) // (h.f::HUGEINT + t.f) AS BIGINT) AS score
  FROM cut c
  JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.words[1 : c.k], ' ')
  JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.words[c.k + 1 : c.m], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
