"""Written tables in the shared folder that cut lineage, and a bounded set of keys for early skips."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where a session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2,000 rows where the session has Spark's 10,000: whole texts pass through
    Python, and two workers share an executor's memory with its heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write and read back, so that later steps never recompute `df`."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Usual bits of the set below: 2 MB, whatever the number of keys.
BITS = 24


def likely(keys: DataFrame, column: str, size: int = BITS) -> np.ndarray:
    """Bit array over the top bits of well mixed longs: each key's bit is set, few others are."""
    place = F.shiftrightunsigned(column, 64 - size)
    words = keys.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {64 - size}) & 63 as int))").alias("m"))
    rows = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bits = np.zeros(1 << (size - 6), np.int64)
    bits[rows.column("w").to_numpy()] = rows.column("m").to_numpy()
    return bits.view(np.uint64)


def maybe(bits: np.ndarray, keys: np.ndarray, size: int = BITS) -> np.ndarray:
    """Whether each uint64 key's bit is set."""
    place = keys >> np.uint64(64 - size)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def sampled(df: DataFrame, column: str, rows: int, chars: int) -> list[str]:
    """At most `chars` code points of each of the `rows` distinct texts that are smallest by hash.

    Only hashes are shuffled; the driver gets rows x chars code points at most.
    """
    texts = df.select(F.col(column).cast("string").alias("text")).where("text is not null").select("text", F.xxhash64("text").alias("h"))
    least = [r["h"] for r in texts.select("h").distinct().orderBy("h").limit(rows).collect()]
    if not least:
        return []
    near = texts.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min(F.substring("text", 1, chars)).alias("text"))
    return [r["text"] for r in near.orderBy("h").collect()]
