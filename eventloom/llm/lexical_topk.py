"""Ranked lexical search of a whole collection for a set of items, as a blocked sparse matrix product.

Rows of the left matrix are items, with the multiplicity of each term; rows of the right one are terms, with an integer impact
for each document.  Documents are read once into a table of term numbers and frequencies (only terms that some item has), from
which the collection's statistics are summed.  Then blocks of documents become sparse rows by term in numpy; an item's scores in a block are
the merged rows of its terms (Gustavson), and a running list of the best is kept for each item and task.  Spark merges the tasks' lists by
a window whose rank limit is applied before the shuffle too.

Items are taken in blocks of at most ``block_terms`` terms, so what is sent to a task has a fixed size; a larger set of items
reads the collection once a block.  A repeated row of items counts once, and rows that share an id with different texts are ranked apart.  Items and
documents without terms match nothing.  Equal scores go by doc_id, documents without an id last.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .common import slices, written
from .suffix_decontam import plain_words


def item_blocks(items: DataFrame, block_terms: int):
    """Lists of (item_id, terms), each of at most block_terms terms (or one item); the items pass through in order of their ids."""
    block, size = [], 0
    for item, text in items.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        if terms := plain_words(text):
            if block and size + len(terms) > block_terms:
                yield block
                block, size = [], 0
            block.append((item, terms))
            size += len(terms)
    if block:
        yield block


class ItemMatrix:
    """The left matrix of a block: for each item its term numbers and their multiplicities."""

    def __init__(self, block: list):
        self.ids = [item for item, _ in block]
        self.number = {t: k for k, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        self.rows = [np.unique([self.number[t] for t in terms], return_counts=True) for _, terms in block]


def term_table(docs: DataFrame, number: dict[bytes, int], slice_bytes: int = 8_000_000) -> DataFrame:
    """(doc_id, n, terms, tf) of every document: its number of terms, and the numbered ones that it has with their frequencies."""
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("n long, terms array<int>, tf array<int>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                sizes, found, owner = [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    words = plain_words(text)
                    own = np.array([number.get(w, -1) for w in words], dtype=np.int64)
                    own = own[own >= 0]
                    sizes.append(len(words))
                    found.append(own)
                    owner.append(np.full(len(own), k, dtype=np.int64))
                keys, tf = np.unique(np.concatenate(owner) * max(1, len(number)) + np.concatenate(found), return_counts=True)
                ends = np.searchsorted(keys, np.arange(part.num_rows + 1) * max(1, len(number))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))).cast(arrow.field(name).type) for name, x in (("terms", keys % max(1, len(number))), ("tf", tf))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(arrow.field("doc_id").type), pa.array(sizes, pa.int64()), *lists], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def best(scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; ties by id, missing ids last.  All ties at the cut take part in the choice."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
    return at[np.lexsort((ids[at], missing[at], -scores[at]))[:k]]


def block_product(matrix: ItemMatrix, weight: np.ndarray, total_docs: int, total_terms: int, n: np.ndarray, owner: np.ndarray, terms: np.ndarray, tf: np.ndarray):
    """Yields (item row, scores of the block's documents), all in 64-bit integers; owner, terms, tf: the block's entries."""
    length = 100 - 25 + (25 * n * total_docs) // max(1, total_terms)
    impact = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * length[owner]))
    order = np.argsort(terms, kind="stable")
    owner, impact = owner[order], impact[order]
    starts = np.searchsorted(terms[order], np.arange(len(weight) + 1))
    for i, (own, times) in enumerate(matrix.rows):
        scores = np.zeros(len(n), dtype=np.int64)
        for t, m in zip(own, times, strict=True):
            row = slice(starts[t], starts[t + 1])
            scores[owner[row]] += m * impact[row]  # a document is once in a term's row
        yield i, scores


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = 200_000, block_docs: int = 8192) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item."""
    parts = [_ranked_block(docs, ItemMatrix(block), items, k, block_docs) for block in item_blocks(items, block_terms)]
    if not parts:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return items.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {kind}, score long")
    return reduce(DataFrame.unionAll, parts)


def _ranked_block(docs: DataFrame, matrix: ItemMatrix, items: DataFrame, k: int, block_docs: int) -> DataFrame:
    table = written(term_table(docs, matrix.number), "terms")
    total_docs, total_terms = (x or 0 for x in table.where("n > 0").agg(F.count("*"), F.sum("n")).first())
    weight = np.zeros(len(matrix.number), dtype=np.int64)
    for term, holding in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most a block's terms
        weight[term] = term_weight(total_docs, holding)
    entry = StructType([StructField("_item", LongType()), StructField("item_id", items.schema["item_id"].dataType), docs.schema["doc_id"], StructField("score", LongType())])
    arrow = to_arrow_schema(entry)

    def run(batches):
        top: dict[int, tuple] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, block_docs):
                part = batch.slice(start, block_docs)
                ids = part.column("doc_id")
                missing, numbers = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
                lists, n = part.column("terms"), part.column("n").to_numpy()
                owner = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
                terms, tf = lists.flatten().to_numpy(), part.column("tf").flatten().to_numpy().astype(np.int64)
                for i, scores in block_product(matrix, weight, total_docs, total_terms, n, owner, terms, tf):
                    if (old := top.get(i)) is not None and len(old[0]) == k:
                        scores[scores < old[0][-1]] = 0
                    at = best(scores, numbers, missing, k)
                    if not len(at):
                        continue
                    new = scores[at], numbers[at], missing[at]
                    if old is not None:
                        new = tuple(np.concatenate(x) for x in zip(old, new, strict=True))
                        at = best(new[0], new[1], new[2], k)
                        new = tuple(x[at] for x in new)
                    top[i] = new
        for i, (scores, numbers, missing) in top.items():
            columns = [np.full(len(scores), i), [matrix.ids[i]] * len(scores), pa.array(numbers, mask=missing), scores]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    lists = table.where("n > 0").mapInArrow(run, entry)
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
