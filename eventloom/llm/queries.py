"""The operators' queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexical_topk, line_dedup, minhash_dedup, mixing, ppm, quality_knn, quality_rules, secrets, suffix_decontam, token_fst, toxicity_cnn, url_templates, vector_codes
from .common import remainder
from .oracles import oracle_sql

TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents on at least as many partitions as there are cores; a file of one row group would be one task."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ppm_scores(spark, sf_dir):
    return ppm.scored(documents(spark, sf_dir), held_out=ppm.fold(F.col("doc_id")))


def op2_secret_scan(spark, sf_dir):
    return secrets.secret_spans(documents(spark, sf_dir))


def op3_url_templates(spark, sf_dir):
    return url_templates.judged(table(spark, sf_dir, "pages"))


def op4_minhash_dedup(spark, sf_dir):
    return minhash_dedup.grouped(documents(spark, sf_dir))


def op5_quality_rules(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return quality_rules.judged(documents(spark, sf_dir), labels)


def op6_decontamination(spark, sf_dir):
    return suffix_decontam.decontamination_digest(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_quality_knn(spark, sf_dir):
    docs, held = documents(spark, sf_dir), remainder(F.col("doc_id"), 4) == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    space = quality_knn.space_for(docs, labels, ~held)
    return quality_knn.scored(docs.select("doc_id", "text"), space).select("doc_id", held.alias("held_out"), "score", "predicted")


def toxicity_network(docs: DataFrame, labels: DataFrame):
    """Learnt from rows outside the held-out fold: crc32 of the id's text modulo 3 is 1."""
    return toxicity_cnn.network_for(docs, labels.select("doc_id", F.col("toxic").alias("label")), remainder(F.col("doc_id"), 3) != 1)


def op8_toxicity_cnn(spark, sf_dir):
    docs = documents(spark, sf_dir)
    network = toxicity_network(docs, table(spark, sf_dir, "labels"))
    return toxicity_cnn.scored(docs.select("doc_id", "text"), network).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op9_mixing(spark, sf_dir):
    return mixing.mix_digest(documents(spark, sf_dir))


def op10_token_counts(spark, sf_dir):
    return token_fst.token_counts(documents(spark, sf_dir), tokenizer_path())


def op11_line_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    index = line_dedup.LineIndex(spark).insert(docs)
    return index.deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op12_lexical_topk(spark, sf_dir):
    return lexical_topk.ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.encoded(table(spark, sf_dir, "embeddings"))


__all__ = ["oracle_sql", "queries", "table"]
OPERATORS = (op1_ppm_scores, op2_secret_scan, op3_url_templates, op4_minhash_dedup, op5_quality_rules, op6_decontamination, op7_quality_knn, op8_toxicity_cnn, op9_mixing, op10_token_counts, op11_line_dedup, op12_lexical_topk, op13_vector_codes)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}
