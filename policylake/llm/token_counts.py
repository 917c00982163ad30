"""Token counts: map-side lookup in two tiers, without a shuffle of pre-tokens.

Tier one is a compact table (hash, length) of the frequent pre-tokens, found in a bounded sample
of documents and broadcast: at most `table` rows of 12 bytes. Tier two is a cache in each Python
worker of what the library gave for a missed pre-token. The sample only decides which tier
answers, never the answer.

A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm import bytewise, pretokens
from policylake.llm.staging import sampled, small_batches

CACHE = 400_000


def frequent(documents: DataFrame, path: str, sample: int = 2_000, chars: int = 8_000, table: int = 131_072) -> tuple[np.ndarray, np.ndarray]:
    """Hash and token count of the most frequent pre-tokens in at most `sample` x `chars` code points."""
    column = pa.array(sampled(documents, "text", sample, chars), pa.string())
    seen: dict[int, list] = {}
    for _, _, data, at in bytewise.chunks(column):
        ok = pretokens.plain(data, at)
        start, end, row = pretokens.spans(data, at)
        keep = ok[row]
        start, end = start[keep], end[keep]
        h, where, count = np.unique(bytewise.hashes(data, start, end), return_index=True, return_counts=True)
        for key, w, c in zip(h.tolist(), where.tolist(), count.tolist(), strict=True):
            if key in seen:
                seen[key][0] += c
            else:
                seen[key] = [c, data[start[w] : end[w]].tobytes()]
    best = sorted(seen.items(), key=lambda x: (-x[1][0], x[0]))[:table]
    best.sort()
    encode = pretokens.tokenizer(path).encode_batch
    got = [len(x.ids) for x in encode([x[1].decode() for _, x in best], add_special_tokens=False)]
    return np.array([k for k, _ in best], np.uint64), np.array(got, np.int32)


def count_tokens(documents: DataFrame, path: str | None = None, limit: int = 1024, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keys`, n_bytes, n_tokens, over_limit of every row of `documents` (text)."""
    small_batches(documents.sparkSession)
    path = path or pretokens.default_vocabulary()
    shared = documents.sparkSession.sparkContext.broadcast(frequent(documents, path))
    names = [f"k{i}" for i in range(len(keys))]
    slim = documents.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, length = shared.value
        cache: dict[int, int] = {}
        encode = pretokens.tokenizer(path).encode_batch
        for batch in batches:
            column = batch.column("text")
            sizes, counts = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for row, end_row, data, at in bytewise.chunks(column):
                sizes[row:end_row] = np.diff(at)
                ok = pretokens.plain(data, at)
                start, end, of = pretokens.spans(data, at)
                keep = ok[of]
                start, end, of = start[keep], end[keep], of[keep]
                h = bytewise.hashes(data, start, end)
                got = np.zeros(len(h), np.int64)
                if len(table):
                    at_table = np.minimum(np.searchsorted(table, h), len(table) - 1)
                    hit = table[at_table] == h
                    got[hit] = length[at_table[hit]]
                else:
                    hit = np.zeros(len(h), bool)
                miss = np.flatnonzero(~hit)
                if len(miss):
                    unique, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
                    known = [cache.get(k, -1) for k in unique.tolist()]
                    new = [i for i, v in enumerate(known) if v < 0]
                    pieces = [data[start[m] : end[m]].tobytes().decode() for m in miss[where[new]].tolist()] if new else []
                    for i, ids in zip(new, encode(pieces, add_special_tokens=False), strict=True):
                        known[i] = cache[int(unique[i])] = len(ids.ids)
                    got[miss] = np.array(known, np.int64)[back]
                    if len(cache) > CACHE:
                        cache.clear()
                counts[row:end_row] = np.bincount(of, weights=got, minlength=len(at) - 1).astype(np.int64)
                for i in np.flatnonzero(~ok).tolist():
                    text = data[at[i] : at[i + 1]].tobytes().decode()
                    counts[row + i] = len(encode([text], add_special_tokens=False)[0].ids)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sizes), pa.array(counts)], [*names, "n_bytes", "n_tokens"])

    kinds = ", ".join(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names)
    done = slim.mapInArrow(run, f"{kinds}, n_bytes long, n_tokens long")
    return done.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
