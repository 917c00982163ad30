"""Token sequences of one width with little padding, by minimum bin slack.

A text becomes token ids and an end id. Whole widths are cut off long documents at once; what is
left of each document waits in its task, at most about `window` tokens. Sequences are filled from
these pieces one by one: the longest piece is set, and a subset-sum over the multiset of waiting
lengths (one integer as the bit set of sums that can be reached, counts by binary splitting) finds
the multiset that comes closest to the room left; the counts are traced back from the bit sets. Room
that no multiset fills is closed by cutting the longest waiting piece. The last tokens of a task, less
than one width, fill sequences of descending powers of two, which need no padding.

Pre-tokens of plain texts (ASCII and the letters U+00C0-U+00FF, no special strings) are cut by the
vocabulary's own pattern and lower-cased here, other texts are cut at ASCII white space only; ids of
either are kept per worker (`CACHE` of them), and the library encodes what is new. `encodes_by_words`
refuses vocabularies with other rules. No shuffle; a task holds one window and one text.

A null or empty text has the end id alone. Repeated rows and rows without a key are documents of
their own. Pieces of equal length are interchangeable: the one that came last is taken first. An empty
table gives no rows. A sequence's id is its task's number and its place there.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm import bytewise
from policylake.llm.staging import small_batches

CACHE = 500_000
#: Longer ones are encoded each time they occur.
KEPT_BYTES = 64
#: A text is split into words in parts of about this many bytes.
PART = 1 << 20
_GAP = re.compile(rb"[\t-\r ]")
#: Bytes that make a text other than plain: separator controls and other scripts (and two signs, see `_plain`).
_ODD = np.zeros(256, bool)
_ODD[[*range(0x1C, 0x20), *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
#: The vocabulary's pattern (a fixed value), and the same for the bytes of plain lower-case texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encodes_by_words(path: str) -> bool:
    """Whether the vocabulary lower-cases and cuts as assumed here, so that a text's ids are its pieces' ids."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    normal = {"NFC", "Lowercase", "Replace"}
    steps = (rules.get("normalizer") or {}).get("normalizers", [])
    cuts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    drops = bool(cuts) and cuts[0] == {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    spaces = all(s["type"] in normal and (s["type"] != "Replace" or (s["pattern"], s["content"]) == ({"Regex": "\\s+"}, " ")) for s in steps)
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") for t in rules.get("added_tokens", []))
    ends = rules["model"].get("end_of_word_suffix") == "</w>" and "Lowercase" in {s["type"] for s in steps}
    return drops and spaces and plain and ends


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.library = _library(path)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def _together(self, new: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens in one call; each ends with an id of a word's end."""
        if not new:
            return []
        ids = np.array(self.library.encode_batch_fast([b" ".join(new).decode()], add_special_tokens=False)[0].ids, "<u4")
        at, flat = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()], ids.tobytes()
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _singly(self, new: list[bytes]) -> list[bytes]:
        got = self.library.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        parts, of = [], []
        for i, text in enumerate(texts):
            plain, at = _plain(text), 0
            while at < len(text):
                end = len(text)
                if end - at > PART and (gap := _GAP.search(text, at + PART)):
                    end = gap.start()
                part = text[at:end]
                parts.append(_PIECE.findall(part.lower()) if plain else part.split())
                of.append((i, plain))
                at = end
        out: list[list[bytes]] = [[] for _ in texts]
        for plain, kept, encoded in ((True, self.pieces, self._together), (False, self.words, self._singly)):
            mine = [(i, p) for (i, b), p in zip(of, parts, strict=True) if b is plain]
            new = list(set().union(*(p for _, p in mine)).difference(kept))
            if len(kept) + len(new) > CACHE:
                kept.clear()
                new = list(set().union(*(p for _, p in mine)))
            kept.update(zip(new, encoded(new), strict=True))
            for i, p in mine:
                out[i].append(b"".join(map(kept.__getitem__, p)))
            for w in new:
                if len(w) > KEPT_BYTES:
                    del kept[w]
        return [b"".join(x) for x in out]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for each worker process, so that later tasks find what earlier ones learned."""
    return Encoder(path)


def _plain(text: bytes) -> bool:
    data = np.frombuffer(text, np.uint8)
    return not (_ODD[data].any() or b"\xc3\x97" in text or b"\xc3\xb7" in text or b"<|" in text)


def closest(counts: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the multiset within `counts` whose sum comes closest to `room` from below.

    `counts` has each length once; earlier lengths are preferred.
    """
    sums, before, mask = 1, [], (1 << (room + 1)) - 1
    for length, many in counts:
        if length > room:
            continue
        before.append((length, sums))
        left, take = min(many, room // length), 1
        while left > 0:
            take = min(take, left)
            sums |= (sums << (length * take)) & mask
            left -= take
            take *= 2
        if sums >> room:
            break
    total, picked = sums.bit_length() - 1, []
    for length, earlier in reversed(before):
        n = 0
        while not earlier >> total & 1:
            total -= length
            n += 1
        if n:
            picked.append((length, n))
    return picked


class Waiting:
    """Pieces of a window by length. A piece is (document, first id, number of ids)."""

    def __init__(self, width: int):
        self.width, self.tokens = width, 0
        self.by_length: list[list[tuple]] = [[] for _ in range(width + 1)]
        self.counts = np.zeros(width + 1, np.int64)

    def add(self, piece: tuple) -> None:
        self.by_length[piece[2]].append(piece)
        self.counts[piece[2]] += 1
        self.tokens += piece[2]

    def _take(self, length: int) -> tuple:
        self.counts[length] -= 1
        self.tokens -= length
        return self.by_length[length].pop()

    def sequence(self, size: int) -> list[tuple]:
        """Pieces of exactly `size` ids in all; at least so many must be waiting."""
        out, room = [], size
        lengths = np.flatnonzero(self.counts[: size + 1])[::-1].tolist()
        if lengths:
            out.append(self._take(lengths[0]))
            room -= lengths[0]
        for length, n in closest([(x, int(self.counts[x])) for x in lengths if self.counts[x]], room):
            out += [self._take(length) for _ in range(n)]
            room -= length * n
        while room:
            doc, start, length = self._take(int(np.flatnonzero(self.counts)[-1]))
            part = min(room, length)
            out.append((doc, start, part))
            if length > part:
                self.add((doc, start + part, length - part))
            room -= part
        return out


def sequences(waiting: Waiting, keep: int) -> Iterator[list[tuple]]:
    """Full sequences until fewer than `keep` tokens wait; with `keep` 0 the rest in powers of two."""
    while waiting.tokens >= max(waiting.width, keep):
        yield waiting.sequence(waiting.width)
    while keep == 0 and waiting.tokens:
        yield waiting.sequence(1 << (waiting.tokens.bit_length() - 1))


def pack(documents: DataFrame, path: str | None = None, width: int = 2048, end_id: int = 1, window: int = 1_000_000, key: str = "doc_id") -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    `ids` are the piece's ids as little-endian unsigned 32-bit numbers.
    """
    if width < 1 or width & (width - 1):
        raise ValueError("width must be a power of two")
    path = path or default_vocabulary()
    if not encodes_by_words(path):
        raise ValueError(f"{path}: ids of a text are not those of its words")
    small_batches(documents.sparkSession)
    slim = documents.select(F.col(key).alias("k"), F.col("text").cast("string").alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind = slim.schema["k"].dataType
    fields = [("doc_id", to_arrow_type(kind)), *((n, pa.int64()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, waiting = _encoder(path), Waiting(width)
        base, done = TaskContext.get().partitionId() << 33, 0
        rows: list[tuple] = []
        size = 0

        def put(pieces: list[tuple]) -> None:
            nonlocal done, size
            at = 0
            for (owner, ids), start, length in pieces:
                rows.append((owner, start, length, len(ids) // 4, base + done, at, ids[4 * start : 4 * (start + length)]))
                at += length
            done += 1
            size += at

        def ready() -> pa.RecordBatch:
            nonlocal rows, size
            cols = zip(*rows, strict=True) if rows else [[] for _ in fields]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])
            rows, size = [], 0
            return batch

        for batch in batches:
            keys = batch.column("k").to_pylist()
            for first, last, data, at in bytewise.chunks(batch.column("text"), PART):
                texts = [data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                for owner, body in zip(keys[first:last], encoder.ids(texts), strict=True):
                    ids = body + end
                    doc, n = (owner, ids), len(ids) // 4
                    for start in range(0, n - n % width, width):
                        put([(doc, start, width)])
                        if size >= window:
                            yield ready()
                    if n % width:
                        waiting.add((doc, n - n % width, n % width))
                if waiting.tokens >= window:
                    for pieces in sequences(waiting, window // 2):
                        put(pieces)
                if size >= window:
                    yield ready()
        for pieces in sequences(waiting, 0):
            put(pieces)
            if size >= window:
                yield ready()
        if rows:
            yield ready()

    return slim.mapInArrow(run, f"doc_id {kind.simpleString()}, start long, length long, doc_tokens long, sequence_id long, `offset` long, ids binary")
