"""Token ids in packed matrices: best-fit decreasing over windows of pieces, map side.

A text becomes token ids; ids beyond `width` are cut into whole pieces of `width` and a rest, so
nothing is lost. Each task gathers pieces up to `window` tokens, places them longest first into
the row with the least room that still holds them (a segment tree over room finds it), and writes
rows: `ids` (little-endian uint16 or uint32 of up to `width` ids), `cu_seqlens` (0 and the end of
every segment), `resets` (where position ids start again at 0), and for each segment its document
and piece number. No shuffle; a task holds one window.

A null or empty text has no tokens and so no segment. Repeated rows are packed row by row. A
window ends early only at the end of a task, where rows may stay partly filled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm import bytewise, pretokens
from policylake.llm.staging import small_batches

CACHE = 1_500_000


class Rooms:
    """Rows by free room; a segment tree over 0..width says where rows are."""

    def __init__(self, width: int):
        self.base = 1 << width.bit_length()
        self.filled = bytearray(2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.base + room
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take(self, need: int) -> int:
        """Room of the fullest row that still holds `need`, or -1."""
        filled, node = self.filled, self.base + need
        if not filled[node]:
            while node > 1 and (node & 1 or not filled[node + 1]):
                node >>= 1
            if node <= 1:
                return -1
            node += 1
            while node < self.base:
                node = 2 * node if filled[2 * node] else 2 * node + 1
        return node - self.base

    def pop(self, room: int) -> int:
        row = self.rows[room].pop()
        node = self.base + room
        if not self.rows[room]:
            self.filled[node] = 0
            while node > 1:
                node >>= 1
                self.filled[node] = self.filled[2 * node] | self.filled[2 * node + 1]
        return row


def best_fit_decreasing(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Pieces (by index) of each packed row; longest first, ties by index."""
    rooms, rows = Rooms(width), []
    for i in np.lexsort((np.arange(len(lengths)), -lengths)).tolist():
        need = int(lengths[i])
        room = rooms.take(need)
        if room < 0:
            row, room = len(rows), width
            rows.append([])
        else:
            row = rooms.pop(room)
        rows[row].append(i)
        if room > need:
            rooms.add(room - need, row)
    return rows


class Encoder:
    """Token ids of texts by the library's vocabulary; ids of each pre-token are kept per worker."""

    def __init__(self, path: str):
        self.library = pretokens.tokenizer(path)
        self._reset()

    def _reset(self) -> None:
        self.flat = np.empty(0, np.int32)
        self.at = np.zeros(1, np.int64)
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)

    def _learn(self, fresh: np.ndarray, pieces: list[str]) -> None:
        got = [x.ids for x in self.library.encode_batch(pieces, add_special_tokens=False)]
        base = len(self.at) - 1
        self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(got), np.int32)]
        self.at = np.r_[self.at, self.at[-1] + np.cumsum([len(x) for x in got])]
        place = np.searchsorted(self.keys, fresh)
        self.keys = np.insert(self.keys, place, fresh)
        self.slots = np.insert(self.slots, place, base + np.arange(len(fresh)))

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of a run of rows, their n + 1 offsets)."""
        for row, _, data, at in bytewise.chunks(column):
            ok = pretokens.plain(data, at)
            start, end, of = pretokens.spans(data, at)
            keep = ok[of]
            start, end, of = start[keep], end[keep], of[keep]
            h = bytewise.hashes(data, start, end)
            if len(self.keys) > CACHE:
                self._reset()
            # ascending hashes are found much faster than those of the text's order
            each, where, back = np.unique(h, return_index=True, return_inverse=True)
            place = np.minimum(np.searchsorted(self.keys, each), max(len(self.keys) - 1, 0))
            miss = np.flatnonzero(self.keys[place] != each) if len(self.keys) else np.arange(len(each))
            if len(miss):
                raw = data.tobytes()
                self._learn(each[miss], [raw[a:b].decode() for a, b in zip(start[where[miss]].tolist(), end[where[miss]].tolist(), strict=True)])
                place = np.searchsorted(self.keys, each)
            slot = self.slots[place][back] if len(h) else np.empty(0, np.int64)
            size = self.at[slot + 1] - self.at[slot]
            ids = self.flat[np.repeat(self.at[slot] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())] if len(h) else np.empty(0, np.int32)
            count = np.bincount(of, weights=size, minlength=len(at) - 1).astype(np.int64) if len(h) else np.zeros(len(at) - 1, np.int64)
            if ok.all():
                yield row, ids, np.r_[0, np.cumsum(count)]
                continue
            cut, parts, bounds = np.r_[0, np.cumsum(count)], [], [0]
            for i in range(len(at) - 1):
                one = ids[cut[i] : cut[i + 1]]
                if not ok[i]:
                    text = data[at[i] : at[i + 1]].tobytes().decode()
                    one = np.array(self.library.encode_batch([text], add_special_tokens=False)[0].ids, np.int32)
                parts.append(one)
                bounds.append(bounds[-1] + len(one))
            yield row, np.concatenate(parts), np.array(bounds)


def pack(documents: DataFrame, path: str | None = None, width: int = 2048, window: int = 4_000_000, key: str = "doc_id") -> DataFrame:
    """Packed rows of all texts: pack_id, n_tokens, n_segments, ids, cu_seqlens, resets, doc_ids, pieces."""
    small_batches(documents.sparkSession)
    path = path or pretokens.default_vocabulary()
    slim = documents.select(F.col(key).alias("k"), F.col("text").cast("string").alias("text"))
    kind = slim.schema["k"].dataType.simpleString()
    wide = pretokens.tokenizer(path).get_vocab_size() > 1 << 16

    def placed(owner: list, piece: list, body: list) -> pa.RecordBatch:
        lengths = np.array([len(x) for x in body], np.int64)
        cols: dict[str, list] = {n: [] for n in ("pack_id", "n_tokens", "n_segments", "ids", "cu_seqlens", "resets", "doc_ids", "pieces")}
        for row in best_fit_decreasing(lengths, width):
            ends = np.cumsum(lengths[row])
            cols["pack_id"].append(f"{owner[row[0]]}-{piece[row[0]]}")
            cols["n_tokens"].append(int(ends[-1]))
            cols["n_segments"].append(len(row))
            cols["ids"].append(np.concatenate([body[i] for i in row]).tobytes())
            cols["cu_seqlens"].append([0, *ends.tolist()])
            cols["resets"].append([0, *ends[:-1].tolist()])
            cols["doc_ids"].append([owner[i] for i in row])
            cols["pieces"].append([piece[i] for i in row])
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(key_type), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True)], list(cols))

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(slim.schema["k"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, small = Encoder(path), np.dtype("<u4" if wide else "<u2")
        owner, piece, body, held = [], [], [], 0
        for batch in batches:
            keys = batch.column("k").to_pylist()
            for row, ids, at in encoder.encode(batch.column("text")):
                ids = ids.astype(small)
                for i in range(len(at) - 1):
                    for n, start in enumerate(range(int(at[i]), int(at[i + 1]), width)):
                        owner.append(keys[row + i])
                        piece.append(n)
                        body.append(ids[start : min(start + width, int(at[i + 1]))])
                held += len(ids)
                if held >= window:
                    yield placed(owner, piece, body)
                    owner, piece, body, held = [], [], [], 0
        if body:
            yield placed(owner, piece, body)

    return slim.mapInArrow(run, f"pack_id string, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<{kind}>, pieces array<int>")


def unpacked(packs: DataFrame) -> DataFrame:
    """One row for each segment: doc_id, piece, the bytes of its ids (for the way back)."""
    size = F.length("ids") / F.col("n_tokens")
    one = F.posexplode("doc_ids").alias("n", "doc_id")
    rows = packs.where("n_tokens > 0").withColumn("_b", size.cast("int")).select("*", one)
    first, end = F.expr("cu_seqlens[n]"), F.expr("cu_seqlens[n + 1]")
    return rows.select("doc_id", F.expr("pieces[n]").alias("piece"), F.substring("ids", first * F.col("_b") + 1, (end - first) * F.col("_b")).alias("ids"))
