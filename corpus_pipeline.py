"""A corpus in five stages: toxic documents go, near-duplicates go, benchmark passages go, secrets are replaced, sources are mixed.

Every stage gets what its predecessor kept; all but the last return the columns of documents.  No stage fails on nulls in any
column, empty or very long texts, ties, repeated rows, extra columns or an empty table: an empty table gives an empty
one, and what else holds is said at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import minhash_dedup, mixing, queries as q, secrets, suffix_decontam, toxicity_cnn
from eventloom.llm.common import intermediates, shared_dir, written  # noqa: F401


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go.  A null or empty text is judged as one without words; equal texts are judged alike."""
    return toxicity_cnn.without_toxic(docs, q.toxicity_network(docs, q.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more, the row with the least doc_id stays.

    Null, empty and blank texts are linked with nothing and stay.  Rows that share an id, or have none, stay once for each text kept.
    """
    return minhash_dedup.deduplicated(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which at least a twentieth of the words lies in benchmark passages go; texts without words stay."""
    return suffix_decontam.decontaminated(docs, q.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; secrets in its text are replaced by their kind.  A null text stays null."""
    return secrets.without_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row a draw, with its copy, shard, words and text; documents that are not drawn have no shard and no text."""
    return mixing.mixture(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("mixing", source_mix)]
#: The classifier, the signatures and the entropy scan are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage wrote on its way is deleted once its result is written."""
    docs = q.documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/eventloom/{uuid.uuid4().hex}-{name}"
        with intermediates(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
