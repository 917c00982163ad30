"""One thin query for each operator, over whole tables, and its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylake.llm import bin_slack, decontaminate, fingerprints, html_text, jaccard_join, language_id, mixing, packing, personal_data, phrases, token_counts, toxicity, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir))


def op2_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    held_out = language_id.fold("doc_id", 3) == 1
    model = language_id.learned(documents.where(~held_out))
    return language_id.identify(documents, model, ["doc_id", held_out.alias("held_out")])


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_documents(spark, sf_dir))


def op5_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(_documents(spark, sf_dir)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    held_out = language_id.fold("doc_id", 5) == 0
    model = toxicity.learned(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return toxicity.score(documents, model, ["doc_id", held_out.alias("held_out")])


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_text.extract(pages, html_text.trained(pages))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    found = personal_data.find(documents, personal_data.trained(documents))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fingerprints.compared(fingerprints.edited_versions(_documents(spark, sf_dir)))
    return done.withColumn("n_changed", F.size("changed")).drop("changed")


def op11_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bin_slack.pack(_documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = whitening.fitted(embeddings)
    rows = whitening.whitened(embeddings, model)
    n, error, shares = (model.n, model.identity_error, model.explained.tolist()) if model else (0, 0.0, [])
    explained = F.array(*map(F.lit, shares)).cast("array<double>")
    each = rows.select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "at").alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir))


QUERIES = {
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_embedding_whitening": op13_embedding_whitening,
    "op11_bin_slack_packing": op11_bin_slack_packing,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op9_personal_data": op9_personal_data,
    "op6_main_text": op6_main_text,
    "op10_toxicity": op10_toxicity,
    "op1_source_mixing": op1_source_mixing,
    "op5_benchmark_hits": op5_benchmark_hits,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op2_packed_token_ids": op2_packed_token_ids,
    "op3_language_id": op3_language_id,
    "op7_token_counts": op7_token_counts,
}

SQL: dict[str, str] = {"op12_phrase_collocations": phrases.SQL}
