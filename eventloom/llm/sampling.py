"""Bounded training samples of labelled documents."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, written


def sample_table(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int, most_chars: int, most_text: int = 1_000_000) -> tuple[DataFrame, dict[int, int]]:
    """(h, doc_id, text, label) of at most per_class rows a class, and the number of allowed labelled documents a class.

    labels has doc_id and label (0 or 1, others are left out); allowed is a condition on doc_id.  The choice follows a
    hash of the id, so reruns agree and no order of the tables matters.  Texts are whole; one of more than most_text characters
    is left out by itself, and beyond most_chars / 2 characters a class, further documents of that class are.  Ids with
    two labels count as the lesser one, ids with two texts have the lesser one.
    """
    one = labels.where(allowed & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.select("doc_id", F.length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    there = written(one.join(sizes, "doc_id"), "labelled")
    counts = {int(r["label"]): int(r["n"]) for r in there.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    there = there.where(F.col("n") <= most_text)
    chosen = None
    for label in (0, 1):
        part = there.where(F.col("label") == label).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    running = Window.partitionBy("label").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = chosen.withColumn("total", F.sum("n").over(running)).where(2 * F.col("total") <= most_chars).select("doc_id", "label")
    # broadcast: at most 2 * per_class rows
    found = texts.join(F.broadcast(kept), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found.select(order.alias("h"), "doc_id", "text", "label"), counts


def both_classes(sample: list[tuple[str, int]], counts: dict[int, int]) -> bool:
    """Whether the sample has both classes; an error if documents of both are labelled but the bounds left none of one."""
    if len({label for _, label in sample}) == 2:
        return True
    if all(counts.get(k) for k in (0, 1)):
        raise ValueError(f"documents of both classes are labelled {counts}, but the sample within its bounds has not both")
    return False


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int, most_chars: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """The sample's (text, label), ordered by the hash, on the driver, and the number of allowed labelled rows a class."""
    found, counts = sample_table(docs, labels, allowed, per_class, most_chars)
    rows = found.orderBy("h", "doc_id").select("text", "label").collect()
    return [(r["text"], int(r["label"])) for r in rows], counts


def fitted(sample: DataFrame, fit, rows: int = 500):
    """fit(pairs) for the sample's (text, label), ordered by the hash, run in one task: the driver gets the model only.

    sample is bounded by the parameters of sample_table.  fit([]) is the model of an empty one.
    """

    def run(batches):
        pairs = []
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                pairs += zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(pairs))], pa.binary())})

    one = sample.repartition(1).sortWithinPartitions("h", "doc_id").select("text", "label")
    found = one.mapInArrow(run, "model binary").first()
    settled(sample.sparkSession)
    return pickle.loads(found["model"]) if found else fit([])  # no task runs for an empty sample
