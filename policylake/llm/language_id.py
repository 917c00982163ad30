"""Language by cross-parsing entropy.

For every language a suffix automaton of its labelled text is built. A text is parsed against it
greedily: the longest match that starts here is a phrase, the next one starts behind it (a code
point the automaton lacks is a phrase by itself). Fewer phrases per code point mean a smaller
cross entropy; the language with the fewest wins, ties go to the first by name.

Training text is a bounded sample: at most `sample` labelled rows of each language, the smallest
by hash of the text (copies count once), with at most `chars` code points of each; the automata hold at most `states` code points of
each language and are broadcast. Every code point of the sample is a symbol: transitions by the
47 most frequent ones of all languages are a dense table (languages x 2 x states x 48 x 4 bytes), those by all
others sorted pairs of state and symbol.

Texts are lower-cased and every run of anything but letters (by Unicode category, over the whole range) is read as one space, so marks,
numbers and capitals do not count. Long texts are parsed in segments of SEGMENT code points whose
phrases add up, so that one step handles many segments at once; nothing is left out. A null text and one without letters is `und`
with score 0. Score: 1 - (fewest / second fewest), 0 to 1; with one language learned it is 1.
Without any labelled row every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.llm.staging import small_batches

Model = tuple[list[str], np.ndarray, list]
SEGMENT = 1024
ALPHABET = 48
LANES = 16_384
ROWS, PART = 1_000, 1 << 20


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _letters_only(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with each run of anything but letters as one space, and the new offsets."""
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    kept = np.r_[0, np.cumsum(keep)]
    return np.where(letter, codes, 32)[keep], kept[at]


#: Dense transitions, sorted keys (state and symbol) of the others, and where these lead.
Automaton = tuple[np.ndarray, np.ndarray, np.ndarray]


def automaton(symbols: np.ndarray, alphabet: int) -> Automaton:
    """Transitions of the suffix automaton, dense (-1: none) below `alphabet`; symbol 0 is never a transition."""
    link, length, last, size = [-1], [0], 0, 1
    rows: list[dict[int, int]] = [{}]
    for c in symbols.tolist():
        if c == 0:
            last = 0
            continue
        if c in rows[last]:  # text that goes on after a gap may have been seen
            q = rows[last][c]
            if length[q] == length[last] + 1:
                last = q
                continue
            rows.append(dict(rows[q]))
            link.append(link[q])
            length.append(length[last] + 1)
            link[q] = size
            p = last
            while p >= 0 and rows[p].get(c) == q:
                rows[p][c] = size
                p = link[p]
            last, size = size, size + 1
            continue
        cur, size = size, size + 1
        rows.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in rows[p]:
            rows[p][c] = cur
            p = link[p]
        if p >= 0:
            q = rows[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                rows.append(dict(rows[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and rows[p].get(c) == q:
                    rows[p][c] = size
                    p = link[p]
                link[q] = link[cur] = size
                size += 1
        last = cur
    to = np.full((size, alphabet), -1, np.int32)
    rare = []
    for state, row in enumerate(rows):
        for c, target in row.items():
            if c < alphabet:
                to[state, c] = target
            else:
                rare.append((state << 32 | c, target))
    keys, targets = np.array(sorted(rare), np.int64).reshape(-1, 2).T
    return to, np.ascontiguousarray(keys), targets.astype(np.int32)


def _by_rare(edges: Automaton, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Where symbols beyond the dense table lead, -1: nowhere."""
    _, keys, targets = edges
    if not len(keys):
        return np.full(len(symbol), -1, np.int32)
    key = state.astype(np.int64) << 32 | symbol
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, targets[at], -1)


def learned(labelled: DataFrame, sample: int = 48, chars: int = 4_000, states: int = 30_000) -> Model:
    """Language names, symbol of each code point, and an automaton for each language."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    texts = F.approx_count_distinct(F.xxhash64("text"))
    sizes = {r["lang"]: max(r["n"], 1) for r in rows.groupBy("lang").agg(texts.alias("n")).collect()}
    if not sizes:
        return [], np.zeros(1, np.uint32), []
    spark, h = labelled.sparkSession, F.xxhash64("text").alias("h")
    share = spark.createDataFrame([(k, min(1.0, 4 * sample / n)) for k, n in sizes.items()], "lang string, share double")
    kept = rows.select("lang", F.substring("text", 1, chars).alias("text"), h).join(F.broadcast(share), "lang")
    near = kept.where((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) <= F.col("share"))
    best = near.groupBy("lang").agg(F.sort_array(F.collect_set(F.struct("h", "text"))).alias("all"))
    got = {r["lang"]: [x["text"] for x in r["few"]] for r in best.select("lang", F.slice("all", 1, sample).alias("few")).collect()}
    names = sorted(sizes)
    code = {k: _letters_only(c := _codes([t + " " for t in got.get(k, [])]), np.array([0, len(c)]))[0] for k in names}
    seen = np.bincount(np.concatenate(list(code.values())), minlength=0x110000)
    symbol = np.zeros(0x110000, np.uint32)
    common = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)]
    symbol[common] = np.arange(1, len(common) + 1)
    return names, symbol, [automaton(symbol[code[k]][:states], ALPHABET) for k in names]


def phrases(symbols: np.ndarray, at: np.ndarray, step: list[Automaton]) -> np.ndarray:
    """Phrases of every segment (n + 1 offsets `at`) against every automaton: (segments, languages)."""
    out = np.zeros((len(at) - 1, len(step)), np.int64)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], at[:-1][order]
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    odd = bool(len(symbols)) and int(symbols.max()) >= ALPHABET
    for k, edges in enumerate(step):
        flat, root = edges[0].ravel(), edges[0][0].copy()
        root[root < 0] = 0
        state = np.zeros(len(size), np.int32)
        count = np.zeros(len(size), np.int32)
        for t in range(longest):
            m = alive[t]
            sym = symbols[first[:m] + t]
            now = state[:m]
            rare = np.flatnonzero(sym >= ALPHABET) if odd else ()
            if len(rare):
                plain = np.where(sym >= ALPHABET, 0, sym)
                there, again = flat[now * ALPHABET + plain], root[plain]
                there[rare] = _by_rare(edges, now[rare], sym[rare])
                again[rare] = np.maximum(_by_rare(edges, np.zeros(len(rare), np.int64), sym[rare]), 0)
            else:
                there, again = flat[now * ALPHABET + sym], root[sym]
            ends = there < 0
            ends |= now == 0  # a new phrase starts here
            count[:m] += ends
            state[:m] = np.where(there < 0, again, there)
        out[order, k] = count
    return out


def identify(documents: DataFrame, model: Model, carried: list[Column | str]) -> DataFrame:
    """`carried`, lang_pred, score, phrase_rate, n_letters and n_rare of every row; reads only `text`.

    phrase_rate is the fewest phrases per code point read, n_rare the letters beyond the dense table
    that labelled text has (most of a text in a script of many letters).
    """
    slim = documents.select(*carried, F.col("text").cast("string").alias("_text"))
    return _identified(slim, slim.columns[:-1], "_text", model)


def _identified(slim: DataFrame, names: list[str], text: str, model: Model) -> DataFrame:
    """`names` of `slim` and the results for its column `text`; a task holds PART code points at a time."""
    small_batches(slim.sparkSession)
    shared = slim.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, symbol, step = shared.value
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, len(b), ROWS)):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            pred, score, rate = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            letters, rare = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            row = 0
            while langs and row < len(texts):
                end, held = row, 0
                while end < len(texts) and (end == row or held + len(texts[end]) <= PART):
                    held += len(texts[end])
                    end += 1
                part = texts[row:end]
                size = np.array([len(t) for t in part], np.int64)
                codes = _codes(part)
                if len(codes) != size.sum():  # lower case changed a length
                    part = [t.lower() for t in part]
                    size = np.array([len(t) for t in part], np.int64)
                    codes = _codes(part)
                codes, edge = _letters_only(codes, np.r_[0, np.cumsum(size)])
                size = np.diff(edge)
                pieces = -(-size // SEGMENT)
                owner = np.repeat(np.arange(len(part)), pieces)
                inner = np.arange(pieces.sum()) - np.repeat(np.r_[0, np.cumsum(pieces)[:-1]], pieces)
                begin = np.repeat(edge[:-1], pieces) + inner * SEGMENT
                symbols = symbol[codes]
                count = np.zeros((len(part), len(langs)), np.int64)
                for lo in range(0, len(begin), LANES):
                    some = slice(lo, lo + LANES)
                    bounds = np.r_[begin[some], begin[lo + LANES] if lo + LANES < len(begin) else len(codes)]
                    np.add.at(count, owner[some], phrases(symbols, bounds, step))
                heard, seldom = np.r_[0, np.cumsum(codes != 32)], np.r_[0, np.cumsum(symbols >= ALPHABET)]
                for i in range(len(part)):
                    rare[row + i] = seldom[edge[i + 1]] - seldom[edge[i]]
                    letters[row + i] = heard[edge[i + 1]] - heard[edge[i]]
                    if letters[row + i]:
                        few = np.sort(count[i])
                        pred[row + i] = langs[int(np.argmin(count[i]))]
                        score[row + i] = 1 - few[0] / few[1] if len(few) > 1 else 1.0
                        rate[row + i] = few[0] / size[i]
                row = end
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(pred), pa.array(score), pa.array(rate), pa.array(letters), pa.array(rare)], [*names, "lang_pred", "score", "phrase_rate", "n_letters", "n_rare"])

    kinds = ", ".join(f"`{n}` {slim.schema[n].dataType.simpleString()}" for n in names)
    return slim.mapInArrow(run, f"{kinds}{', ' if kinds else ''}lang_pred string, score double, phrase_rate double, n_letters long, n_rare long")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def understood(documents: DataFrame, model: Model, worst_rate: float = 0.75, least_letters: int = 8) -> DataFrame:
    """The rows, all columns, that have letters and that some learned language explains.

    A text of at least `least_letters` letters goes if even the best language needs more than
    `worst_rate` phrases per code point, as text in an unknown script does; not if most of its letters
    are rare ones that labelled text has, since phrases are short in a script of many letters.
    """
    names = [f"_c{i}" for i in range(len(documents.columns))]
    slim = documents.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(documents.columns, names, strict=True)))
    done = _identified(slim, names, names[documents.columns.index("text")], model)
    kept = done.where((F.col("lang_pred") != "und") & ((F.col("n_letters") < least_letters) | (F.col("phrase_rate") <= worst_rate) | (F.col("n_rare") * 2 > F.col("n_letters"))))
    return kept.select(*(F.col(n).alias(c) for c, n in zip(documents.columns, names, strict=True)))
