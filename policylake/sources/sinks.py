"""Sinks: manifest of the prepared transition table, evidence tables, staged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.session import shared_folder


def dataset_manifest(df: DataFrame) -> DataFrame:
    """Rows, episodes, action and slice counts and distinct ids per split, in one aggregate."""
    def names(c: str) -> Column:
        return F.array_join(F.sort_array(F.collect_set(c)), ",")

    return df.groupBy("publication_split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("episode_id").alias("episodes"),
        F.countDistinct("action").alias("actions"),
        *[F.count_if(F.col("slice_type") == s).alias(f"{s.lower()}_rows") for s in ("eMBB", "mMTC", "URLLC")],
        names("training_config").alias("training_configs"),
        names("base_station").alias("base_stations"),
        names("action").alias("action_names"),
    )


def write_prepared(df: DataFrame, path: str) -> DataFrame:
    """The prepared transition table by split and scenario, so that a filter on either reads its folders only.

    Rows of a folder are dealt by episode over a few tasks; an episode stays in one file.
    """
    dealt = df.repartition("publication_split", "scenario", F.pmod(F.xxhash64("episode_id"), F.lit(8)))
    dealt.write.partitionBy("publication_split", "scenario").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def write_evidence(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per kind of evidence."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors.
    """
    import uuid

    path = f"{shared_folder(df.sparkSession)}/policylake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
