"""Language-model scores by prediction by partial matching over bytes.

The model is a byte-context trie: every context of up to ORDER bytes has the counts of the symbols that followed it in
all training texts (bytes, and an end mark).  A symbol is predicted in the longest context; a context that lacks it
escapes to the next shorter one with probability d / (n + d) (d symbols seen n times), and symbols seen in the longer
contexts are excluded there.  Below the empty context the symbols left are equally likely.

Counting is a shuffle of pre-summed grams (context and symbol).  Contexts that share their last two bytes are
compiled in one task, which needs at most 2^24 grams; the two shortest orders are one table of at most 65,792 counts.
Scoring deals the texts out in blocks of about ``block_bytes``; each block's distinct words and grams are joined to
the model and come back to the block, so neither the vocabulary nor the trie is ever sent whole to a task.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, written

#: Fixed values of the format: 4 bytes of context, then 9 bits of symbol; 256 is the end of a text.
ORDER, SYMBOL_BITS, SYMBOLS, END = 4, 9, 257, 256
#: The end token of the word model; no word holds white space.
END_TOKEN = b"\n"
WORD_KEY, GRAM_KEY = b"w", b"g"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(grams of all texts one after another, grams a text); a text starts in a context of zero bytes."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    pad = b"\0" * ORDER
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), dtype=np.uint8).astype(np.int64)
    at = np.cumsum(lengths + ORDER)
    data[at - 1] = END
    out = data[ORDER:].copy()
    for i in range(1, ORDER + 1):
        out |= (data[ORDER - i : len(data) - i] & 0xFF) << (SYMBOL_BITS + 8 * (i - 1))
    valid = np.ones(len(data), dtype=bool)
    for i in range(ORDER):
        valid[at - lengths - ORDER + i] = False
    return out[valid[ORDER:]] if len(texts) else np.zeros(0, dtype=np.int64), lengths


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)
    return values[starts], np.diff(np.append(starts, len(values)))


def gram_keys(gram: np.ndarray) -> pa.Array:
    """Keys of grams: the kind's byte, then the gram's low six bytes."""
    raw = np.empty((len(gram), 7), dtype=np.uint8)
    raw[:, 0] = GRAM_KEY[0]
    raw[:, 1:] = gram.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 2:]
    offsets = np.arange(0, 7 * len(gram) + 1, 7, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(gram), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def grams_in(keys: pa.Array) -> np.ndarray:
    """The grams of gram keys."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), dtype=np.uint8).reshape(-1, 7)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 2:] = raw[:, 1:]
    return wide.view(">i8").ravel().astype(np.int64)


def portions(texts: list[bytes], most: int = 4_000_000):
    """Runs of texts of about `most` bytes, as (start, end)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encoded(column) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]


def count_batches(batches):
    """(word, gram, n) pre-summed over each Arrow batch; grams of held-out texts come with n = 0, their words don't."""
    for batch in batches:
        texts, held = encoded(batch.column("text")), batch.column("held_out").to_pylist()
        learn = [t for t, h in zip(texts, held, strict=True) if not h]
        found = Counter()
        for t in learn:
            found.update(t.lower().split())
        if learn:
            found[END_TOKEN] = len(learn)
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.binary()), "gram": pa.nulls(len(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})
        for own, by in ((learn, 1), ([t for t, h in zip(texts, held, strict=True) if h], 0)):
            for a, b in portions(own):
                gram, n = counted(grams_of(own[a:b])[0])
                yield pa.RecordBatch.from_pydict({"word": pa.nulls(len(gram), pa.binary()), "gram": pa.array(gram), "n": pa.array(n * by)})


def code_lengths(gram: np.ndarray, n: np.ndarray, one: np.ndarray, zero: np.ndarray, most: int = 1024) -> np.ndarray:
    """log10 probability of each gram of a group whose contexts share their last two bytes.

    one: the symbol counts after the last byte; zero: those after nothing.
    """
    symbol, context = gram & 511, gram >> SYMBOL_BITS
    two = np.bincount(symbol, n, SYMBOLS)
    three = np.bincount(((context >> 16) & 0xFF) * SYMBOLS + symbol, n, 256 * SYMBOLS).reshape(256, SYMBOLS)
    heads, inverse = np.unique(context >> 16, return_inverse=True)
    out = np.empty(len(gram))
    order = np.argsort(inverse, kind="stable")
    bounds = np.searchsorted(inverse[order], np.arange(0, len(heads) + most, most))
    for k, start in enumerate(range(0, len(heads), most)):
        rows = order[bounds[k] : bounds[k + 1]]
        own = inverse[rows] - start
        m = min(most, len(heads) - start)
        four = np.bincount(own * SYMBOLS + symbol[rows], n[rows], m * SYMBOLS).reshape(m, SYMBOLS)
        value, escape, seen = np.zeros((m, SYMBOLS)), np.zeros((m, 1)), np.zeros((m, SYMBOLS), dtype=bool)
        for counts in (four, three[heads[start : start + m] & 0xFF], two[None], one[None], zero[None]):
            live = (counts > 0) & ~seen
            total, kinds = (counts * live).sum(1, keepdims=True), live.sum(1, keepdims=True)
            size = np.maximum(total + kinds, 1)
            value = np.where(live, escape + np.log10(np.maximum(counts, 1e-9) / size), value)
            escape = escape + np.where(kinds > 0, np.log10(np.maximum(kinds, 1) / size), 0.0)
            seen |= live
        left = SYMBOLS - seen.sum(1, keepdims=True)
        value = np.where(seen, value, escape - np.log10(np.maximum(left, 1)))
        out[rows] = value[own, symbol[rows]]
    return out


class GramTable:
    """Values by gram: a hashed table answers most look-ups, a binary search the rest."""

    def __init__(self, gram: np.ndarray, value: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.value = gram[order], value[order]
        self.shift = np.uint64(64 - max(10, min(23, int(len(gram)).bit_length() + 4)))
        self.slot = np.zeros(1 << (64 - int(self.shift)), dtype=np.int32)
        self.slot[self.hash(self.gram)] = np.arange(len(gram), dtype=np.int32)

    def hash(self, gram: np.ndarray) -> np.ndarray:
        return (gram.view(np.uint64) * _MULTIPLIER) >> self.shift

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        at = self.slot[self.hash(gram)]
        wrong = np.flatnonzero(self.gram[at] != gram)
        at[wrong] = np.searchsorted(self.gram, gram[wrong])
        return self.value[at]


def block_keys(table: pa.Table) -> pa.Table:
    """A block's distinct words and grams, as keys of the model."""
    texts = encoded(table.column("text"))
    found = {END_TOKEN}
    for t in texts:
        found.update(t.lower().split())
    grams = [counted(grams_of(texts[a:b])[0])[0] for a, b in portions(texts)]
    keys = pa.chunked_array([pa.array([WORD_KEY + w for w in found], pa.binary()), gram_keys(counted(np.concatenate(grams))[0] if grams else np.zeros(0, dtype=np.int64))])
    return pa.table({"block": pa.array(np.full(len(keys), table.column("block")[0].as_py(), dtype=np.int32)), "key": keys})


def block_scores(docs: pa.Table, model: pa.Table) -> pa.Table:
    """(doc_id, held_out, n_tokens, n_known, log_counts, score) of a block's texts."""
    texts = encoded(docs.column("text"))
    known: dict[bytes, float] = {}
    grams, values = [], []
    for batch in model.select(["key", "value"]).to_batches(max_chunksize=50_000):
        keys, value = batch.column("key"), batch.column("value").to_numpy()
        is_word = pc.starts_with(keys, WORD_KEY)
        known.update(zip((k[1:] for k in keys.filter(is_word).to_pylist()), value[is_word.to_numpy(zero_copy_only=False)].tolist(), strict=True))
        own = pc.invert(is_word)
        grams.append(grams_in(keys.filter(own)))
        values.append(value[own.to_numpy(zero_copy_only=False)])
    look = GramTable(np.concatenate(grams), np.concatenate(values))
    n_tokens, n_known, logs = [], [], []
    for t in texts:
        found = [known[w] for w in t.lower().split()]
        found.append(known[END_TOKEN])
        n_tokens.append(len(found))
        n_known.append(len(found) - found.count(0.0))
        logs.append(math.fsum(found))
    scores = np.zeros(len(texts))
    for a, b in portions(texts, 1_000_000):
        gram, lengths = grams_of(texts[a:b])
        scores[a:b] = np.add.reduceat(look(gram), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "log_counts": pa.array(logs, pa.float64()), "score": pa.array(scores)})


def trained(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The model from docs (text, held_out) as (key, value), and the number of training tokens and of distinct ones.

    A word's value is log10(count + 1), a gram's its log10 probability in the trie.
    """
    spark = docs.sparkSession
    found = docs.select("text", "held_out").mapInArrow(count_batches, "word binary, gram bigint, n bigint")
    counts = written(found.groupBy("word", "gram").agg(F.sum("n").alias("n")), "ppm-counts")
    n_all, n_distinct = counts.where("word is not null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    grams = counts.where("gram is not null").select("gram", "n")
    low = np.zeros((256, SYMBOLS))
    last = F.shiftright("gram", SYMBOL_BITS).bitwiseAND(F.lit(0xFF))
    for byte, symbol, n in grams.groupBy(last.alias("byte"), F.col("gram").bitwiseAND(F.lit(511)).alias("symbol")).agg(F.sum("n")).collect():  # at most 256 * 257 rows
        low[byte, symbol] = n
    low = spark.sparkContext.broadcast(low)

    def compiled(table: pa.Table) -> pa.Table:
        gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        one = low.value[int(gram[0] >> SYMBOL_BITS) & 0xFF]
        return pa.table({"key": gram_keys(gram), "value": pa.array(code_lengths(gram, n, one, low.value.sum(0)))})

    lengths = grams.withColumn("tail", F.shiftright("gram", SYMBOL_BITS).bitwiseAND(F.lit(0xFFFF))).groupBy("tail").applyInArrow(compiled, "key binary, value double")
    known = counts.where("word is not null").select(F.concat(F.lit(WORD_KEY), "word").alias("key"), F.log10(F.col("n") + 1.0).alias("value"))
    return written(known.unionAll(lengths), "ppm-model"), int(n_all), int(n_distinct)


def scored(docs: DataFrame, *, held_out, block_bytes: int = 16_000_000) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out is a column that says which rows not to learn from.  A null or empty text is the end token and the end
    mark alone.  Repeated rows are learnt from and scored one by one.  Without training rows every count is 0 and the
    trie is empty, so every byte is equally likely; an empty table gives an empty result.  Other columns are ignored.
    """
    slim = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), held_out.alias("held_out"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    model, n_all, n_distinct = trained(slim)
    blocked = slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))
    keys = blocked.groupBy("block").applyInArrow(block_keys, "block int, key binary")
    values = keys.join(model, "key", "left").select("block", "key", F.coalesce("value", F.lit(0.0)).alias("value"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = blocked.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(block_scores, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, log_counts double, score double")
    base = F.col("log_counts") - F.col("n_tokens") * math.log10(n_all + n_distinct + 1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def fold(doc_id):
    """The held-out fold of the query: crc32 of the id's text modulo 7 is 2."""
    return remainder(doc_id, 7) == 2
