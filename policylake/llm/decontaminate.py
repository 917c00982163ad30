"""Benchmark decontamination: edit distance over words, found by shared pieces and exact alignment.

An item of n words is in a document if some run of its words is at most K = floor(n * (1 - likeness))
word edits away. Any such run shares one of the item's K + 1 pieces word for word, at most K words from
where the piece says, so the item is aligned exactly around every such place. This finds every match.
CGK walks with sampled places chose among the places before; they lost matches of long items.

The benchmark is broadcast in parts of at most `part_words` words. Words are lower-cased runs of
no white space. A null or empty text has no item, an empty item is in no text. Repeated rows and
repeated items are each reported. Ties between places go to the smallest distance, then the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm import bytewise
from policylake.llm.staging import small_batches


class Items:
    """The words and pieces of one part of the benchmark."""

    def __init__(self, texts: list[str | None], likeness: float):
        data, at = bytewise.utf8(pa.array(texts, pa.string()))
        start, end, of = bytewise.words(data, at)
        every = bytewise.hashes(bytewise.LOWER[data], start, end)
        self.words = [every[of == i] for i in range(len(texts))]
        self.edits = [int(len(w) * (1 - likeness) + 1e-9) for w in self.words]
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(self.words):
            if not len(w):
                continue
            parts = self.edits[i] + 1
            q = len(w) // parts
            for p in range(parts):
                offset = p * len(w) // parts
                pieces.setdefault(q, []).append((int(_run(w, q)[offset]), i, offset))
        self.pieces = {}
        for q, rows in pieces.items():
            rows.sort()
            self.pieces[q] = tuple(np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int64), strict=True))


def _run(words: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q words from each place on (the last ones run off the end)."""
    out = np.full(len(words), q, np.uint64)
    for j in range(q):
        out[: len(words) - j] = bytewise.mix(out[: len(words) - j] * np.uint64(0xD6E8FEB86659FD93) + words[j:])
    return out


def _edits(item: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Least word edits between the item and any run inside each region (0: no word there)."""
    width = np.arange(regions.shape[1] + 1)
    before = np.zeros((len(regions), len(width)), np.int64)
    for i, word in enumerate(item.tolist(), 1):
        now = np.minimum(np.concatenate([np.full((len(regions), 1), i), before[:, :-1] + (regions != np.uint64(word))], axis=1), before + 1)
        before = np.minimum.accumulate(now - width, axis=1) + width
    return before.min(axis=1)


def _found(items: Items, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, edits, first word) of the best place of every item in every row that has it."""
    for first_row, end_row, data, at in bytewise.chunks(column):
        start, end, of = bytewise.words(data, at)
        words = bytewise.hashes(bytewise.LOWER[data], start, end)
        bounds = np.searchsorted(of, np.arange(end_row - first_row + 1))
        windows: set[tuple[int, int, int]] = set()  # item, row, place in the row
        for q, (key, item, offset) in items.pieces.items():
            if len(words) < q:
                continue
            runs = _run(words, q)[: len(words) - q + 1]
            inside = of[: len(runs)] == of[q - 1 :]
            low = np.searchsorted(key, runs, "left")
            hit = np.flatnonzero(inside & (key[np.minimum(low, len(key) - 1)] == runs))
            high = np.searchsorted(key, runs[hit], "right")
            for p, lo, hi in zip(hit.tolist(), low[hit].tolist(), high.tolist(), strict=True):
                for s in range(lo, hi):
                    windows.add((int(item[s]), int(of[p]), p - int(offset[s]) - int(bounds[of[p]])))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        ordered = sorted(windows)
        cut = 0
        while cut < len(ordered):
            i, stop = ordered[cut][0], cut
            while stop < len(ordered) and ordered[stop][0] == i and stop - cut < 4096:
                stop += 1
            some = np.array([x[1:] for x in ordered[cut:stop]], np.int64)
            cut, most = stop, items.edits[i]
            lo, hi = bounds[some[:, 0]], bounds[some[:, 0] + 1]
            place = (lo + some[:, 1] - most)[:, None] + np.arange(len(items.words[i]) + 2 * most)
            good = (place >= lo[:, None]) & (place < hi[:, None])
            region = np.where(good, words[np.clip(place, 0, len(words) - 1)], np.uint64(0))
            for (row, word), e in zip(some.tolist(), _edits(items.words[i], region).tolist(), strict=True):
                if e <= most:
                    spot = (first_row + row, i)
                    best[spot] = min(best.get(spot, (e, 1 << 62)), (e, max(0, word)))
        for (row, i), (e, word) in sorted(best.items()):
            yield row, i, e, word


def _parts(benchmark: DataFrame, key: str, likeness: float, part_words: int) -> Iterator[tuple[list, Items]]:
    """The benchmark in parts that are small enough to broadcast."""
    rows = benchmark.select(F.col(key).alias("item"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(total // (6 * part_words)) + 1
    for p in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p)
        got = own.orderBy("item", "text").toArrow()
        yield got.column("item").to_pylist(), Items(got.column("text").to_pylist(), likeness)


def hits(documents: DataFrame, benchmark: DataFrame, likeness: float = 0.8, part_words: int = 2_000_000, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_edits, n_item_words, first_word) for every document and item found in it."""
    small_batches(documents.sparkSession)
    spark = documents.sparkSession
    slim = documents.select(F.col(key).alias("doc"), F.col("text").cast("string").alias("text"))
    item_type = benchmark.schema[item_key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(item_type)
    whole: DataFrame | None = None
    for names, items in _parts(benchmark, item_key, likeness, part_words):
        shared = spark.sparkContext.broadcast((names, items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, items = shared.value
            for batch in batches:
                got = list(_found(items, batch.column("text")))
                rows = pa.array([g[0] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(rows), pa.array([names[g[1]] for g in got], kind), pa.array([g[2] for g in got], pa.int32()), pa.array([len(items.words[g[1]]) for g in got], pa.int32()), pa.array([g[3] for g in got], pa.int64())],
                    [key, item_key, "n_edits", "n_item_words", "first_word"],
                )

        one = slim.mapInArrow(run, f"`{key}` {slim.schema['doc'].dataType.simpleString()}, `{item_key}` {item_type.simpleString()}, n_edits int, n_item_words int, first_word long")
        whole = one if whole is None else whole.union(one)
    return whole


def without_hits(documents: DataFrame, benchmark: DataFrame, likeness: float = 0.8, part_words: int = 2_000_000, item_key: str = "item_id") -> DataFrame:
    """The rows of `documents`, all columns, whose text has no item; no shuffle."""
    small_batches(documents.sparkSession)
    out = documents
    for _, items in _parts(benchmark, item_key, likeness, part_words):
        shared = documents.sparkSession.sparkContext.broadcast(items)
        text = documents.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared: Callable = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for row, *_ in _found(shared.value, batch.column(text)):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, documents.schema)
    return out
