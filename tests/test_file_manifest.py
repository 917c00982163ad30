"""Files are hashed in blocks: the same digests as of their whole bytes, whatever the bytes."""

import gzip
import hashlib
import random

import pytest

from policylake.sources import paths

MARK = b"\xef\xbb\xbf"


def contents():
    rng = random.Random(5)
    noise = rng.randbytes(3_000_000)
    return {
        "noise": noise, "noise_line": noise[:700_000] + b"\n", "noise_lines": noise[:700_000] + b"\n\n\n", "zeros": bytes(600_000), "one": b"x",
        "feed": b"\n", "feeds": b"\n\n\n", "mark": MARK, "mark_feed": MARK + b"\n", "mark_text": MARK + b"a\nb", "mark_text_feed": MARK + b"a\nb\n",
        "marks": MARK + MARK + b"a", "crlf": b"a\r\nb\rc\r\n", "text": b"a\n\nb\n", "late_mark": b"a\n" + MARK + b"b\n", "mark_noise": MARK + noise[:2_000_000],
    }


def test_digests_equal_those_of_the_whole_bytes_in_many_pieces(spark, tmp_path):
    files = {f"{n}.parquet": b for n, b in contents().items()}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    (tmp_path / "folder.parquet").mkdir()
    files["part 1 %20.bin"] = b"in a folder\n"
    files["unpacked.gz"] = gzip.compress(b"as it is\n" * 9)
    for n in ("part 1 %20.bin", "unpacked.gz"):
        (tmp_path / "folder.parquet" / n).write_bytes(files[n])
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    spark.conf.set("spark.sql.files.openCostInBytes", "64k")
    try:
        got = paths.file_manifest(spark, f"{tmp_path}/*.parquet").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(got) == len(files)
    for r in got:
        b = files[r["file"]]
        assert (r["file"], r["bytes"], r["sha256"], r["md5"]) == (r["file"], len(b), hashlib.sha256(b).hexdigest(), hashlib.md5(b).hexdigest())


def test_a_file_may_be_larger_than_a_row(spark, tmp_path):
    """`binaryFile` refuses a file longer than this limit as one row; blocks do not meet it."""
    noise = random.Random(6).randbytes(2_000_000)
    (tmp_path / "noise.parquet").write_bytes(noise)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000000")
    try:
        with pytest.raises(Exception, match="exceeds the max length"):
            spark.read.format("binaryFile").load(f"{tmp_path}/*.parquet").collect()
        got = paths.file_manifest(spark, f"{tmp_path}/*.parquet").first()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert (got["bytes"], got["sha256"]) == (len(noise), hashlib.sha256(noise).hexdigest())
