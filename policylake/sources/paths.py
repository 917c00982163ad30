"""Trace paths: expected grid, filter, completeness and file manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylake.constants import CELL_COLUMNS
from policylake.functions.dims import constant
from policylake.sources.trace import path_ids


def expected_paths(
    spark: SparkSession, scenario: str, configs: Iterable[int], experiments: Iterable[int],
    stations: dict[int, list[str]],
) -> DataFrame:
    """Grid of the trace files a profile must hold; the lists come from the profile."""
    configs, experiments = list(configs), list(experiments)
    if any(not 0 <= c <= 17 for c in configs):
        raise ValueError("training configurations must lie between 0 and 17")
    if any(e < 1 for e in experiments):
        raise ValueError("experiment numbers must be positive")
    rows = [
        (f"slice_traffic/{scenario}/tr{t}/exp{e}/bs{b}/slices_bs{b}/{ue}_metrics.csv",)
        for t in configs for e in experiments for b, ues in stations.items() for ue in ues
    ]
    return constant(spark, rows, "path string")


def filter_paths(
    paths: DataFrame, scenarios: list[str], configs: Iterable[int], experiments: list[int],
    stations: list[int],
) -> DataFrame:
    """Keep metric files of the configured cells; ids become columns."""
    candidates = paths.filter(
        F.col("path").startswith("slice_traffic/") & F.col("path").endswith("_metrics.csv")
        & (F.size(F.split("path", "/")) >= 7)
    )
    named = candidates.select("path", *path_ids(F.col("path")))
    return named.filter(
        F.col("scenario").isin(scenarios)
        & F.col("training_config").isin([f"tr{c}" for c in configs])
        & F.col("experiment").isin([f"exp{e}" for e in experiments])
        & F.col("base_station").isin([f"bs{b}" for b in stations])
        & (F.split("path", "/")[5] == F.concat(F.lit("slices_"), F.col("base_station")))
    )


def completeness(kept: DataFrame, expected: int) -> DataFrame:
    return kept.groupBy(*CELL_COLUMNS, "path").agg(F.lit(1).alias("x")).agg(
        F.countDistinct("path").alias("files"),
        F.countDistinct(*CELL_COLUMNS).alias("cells"),
        F.lit(expected).alias("expected"),
        (F.countDistinct(*CELL_COLUMNS) == expected).alias("complete"),
    )


BLOCK_BYTES = 256 << 10
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
#: Files that Spark's text source would unpack by their name.
UNPACKED = ["bz2", "deflate", "gz", "lz4", "snappy", "zst", "zstd"]
PIECES = "path string, file string, bytes long, at long, seq long, data binary"
DIGESTS = "file string, bytes long, sha256 string, md5 string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a piece of a file, in order, to blocks of bytes, and one row with the bytes of them all."""
    held, path, at, seq, total = bytearray(), None, 0, 0, 0
    schema = pa.schema([("path", pa.string()), ("file", pa.string()), ("bytes", pa.int64()), ("at", pa.int64()), ("seq", pa.int64()), ("data", pa.binary())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def blocks(least: int) -> Iterator[pa.RecordBatch]:
        nonlocal held, seq, total
        start = 0
        while len(held) - start >= least:
            data = bytes(held[start:start + BLOCK_BYTES])
            yield batch([(path, None, len(data), at, seq, data)])
            start, seq, total = start + len(data), seq + 1, total + len(data)
        held = held[start:]

    def ended() -> Iterator[pa.RecordBatch]:
        yield from blocks(1)
        yield batch([(path, None, total, -1, 0, None)])

    for lines in batches:
        names = lines["path"].dictionary_encode()
        codes, starts = names.indices.to_numpy(), lines["at"].to_numpy()
        edges = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), len(codes)]
        for first, end in pairwise(edges):
            if first == end:
                continue
            piece = names.dictionary[int(codes[first])].as_py(), int(starts[first])
            if piece != (path, at):
                if path is not None:
                    yield from ended()
                (path, at), seq, total = piece, 0, 0
            held += b"\n".join(lines["value"].slice(first, end - first).to_pylist()) + b"\n"
            yield from blocks(BLOCK_BYTES)
    if path is not None:
        yield from ended()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of files whose rows come in order: the file's length, the bytes of its pieces, the blocks.

    Lines do not tell a line feed at the end of a file from none, nor a byte order mark at its start; the
    length does: the mark adds three bytes, and the last line feed is one byte too many where there is none.
    """
    path, file, size, left, read, sums = None, None, 0, 0, 0, None

    def begin() -> None:
        nonlocal sums, left
        sums, left = (hashlib.sha256(), hashlib.md5(usedforsecurity=False)), size
        if size - read not in (-1, 0, 2, 3):
            raise ValueError(f"{path}: read {read} bytes as lines, the file has {size}")
        if size - read > 0:
            write(BYTE_ORDER_MARK)

    def write(data: bytes) -> None:
        nonlocal left
        data = data[:left]
        for s in sums:
            s.update(data)
        left -= len(data)

    def end() -> pa.RecordBatch:
        if sums is None:
            begin()
        if left:
            raise ValueError(f"{path}: {left} of {size} bytes were not read")
        return pa.RecordBatch.from_pylist([{"file": file, "bytes": size, "sha256": sums[0].hexdigest(), "md5": sums[1].hexdigest()}])

    for rows in batches:
        for i in range(rows.num_rows):
            at = rows["at"][i].as_py()
            if at == -2:
                if path is not None:
                    yield end()
                path, file, size = (rows[c][i].as_py() for c in ("path", "file", "bytes"))
                read, sums = 0, None
            elif rows["path"][i].as_py() != path:
                raise ValueError(f"{rows['path'][i].as_py()}: not among the files of the listing")
            elif at == -1:
                read += rows["bytes"][i].as_py()
            else:
                if sums is None:
                    begin()
                write(rows["data"][i].as_buffer())
    if path is not None:
        yield end()


def file_manifest(spark: SparkSession, glob: str, catalog: DataFrame | None = None) -> DataFrame:
    """Bytes, SHA-256 and MD5 of every file; compared with a catalogue if one is given.

    A file is read in pieces by Spark's text source, as lines of raw bytes, and hashed block by block in one
    task, so no file is held as a whole; a row is a line, so only a line must fit into memory. Files that
    the text source would unpack are read whole.
    """
    packed = F.col("_metadata.file_name").rlike(rf"\.({'|'.join(UNPACKED)})$")
    name = F.element_at(F.split("path", "/"), -1)
    listed = spark.read.format("binaryFile").load(glob).where(~packed).select(
        F.col("_metadata.file_path").alias("path"), name.alias("file"), F.col("length").alias("bytes"),
        F.lit(-2).cast("long").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("binary").alias("data"))
    lines = spark.read.option("lineSep", "\n").text(glob).where(~packed).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value"))
    pieces = listed.unionByName(lines.mapInArrow(_blocks, PIECES))
    hashed = pieces.repartition("path").sortWithinPartitions("path", "at", "seq").mapInArrow(_digests, DIGESTS)
    whole = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(UNPACKED)}}}").load(glob).select(
        name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))
    files = hashed.unionByName(whole)
    if catalog is None:
        return files
    joined = files.join(catalog.withColumnsRenamed({"md5": "expected_md5"}), "file", "left")
    return joined.withColumn("matches", F.col("md5") == F.col("expected_md5"))
