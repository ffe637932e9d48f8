"""Incremental, reversible line dedup: exact reference counts of lines, with a cuckoo filter in front of each shard.

A line's key is the line without outer white space, with A-Z lower-cased, kept as 128 bits.  The index has three tables in
shared storage: which document holds which key (``members``, one part a batch), how many documents hold a key and the largest of
them (``counts``), and a cuckoo filter a shard (``filters``) with the fingerprints of the keys that at least ``least``
documents hold.  An inserted batch adds to the counts, a deleted document takes from them; keys that cross ``least`` are inserted into
their shard's filter or deleted from it, so after any insertions and deletions the index answers as one built from the documents that are left.

Documents are screened by the filters: a key that a filter doesn't hold stays, as filters forget nothing; the few that it holds are
looked up in the exact counts.  A shard's filter is the most that a task holds; keys, not lines, are dealt to shards, so a line that
every document has is one row there.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, Hot, shared_dir
from .exact import let

WAYS = 4  # slots of a bucket


class Cuckoo:
    """A cuckoo filter over 128-bit keys: 16-bit fingerprints, two buckets a key, a multiset.  All steps are rounds over arrays."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros((1 << max(2, int(np.ceil(np.log2(max(1, keys) / (0.8 * WAYS))))), WAYS), dtype=np.uint16))

    @classmethod
    def read(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, dtype=np.uint16).reshape(-1, WAYS).copy())

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> Cuckoo:
        size = len(hi)
        while not (found := cls.sized(size)).insert(hi, lo):
            size = 2 * max(size, 1)
        return found

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & (len(self.table) - 1)

    def places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = np.maximum(hi & 0xFFFF, 1).astype(np.uint16)
        first = lo & (len(self.table) - 1)
        return mark, first, self._other(mark, first)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(hi, lo)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)

    def insert(self, hi: np.ndarray, lo: np.ndarray, rounds: int = 500) -> bool:
        """False if they don't all fit; the filter is to be built anew then."""
        mark, bucket, _ = self.places(hi, lo)
        for k in range(rounds):
            if not len(mark):
                return True
            order = np.argsort(bucket, kind="stable")
            mark, bucket = mark[order], bucket[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            taken = self.table[bucket] != 0
            free = WAYS - taken.sum(axis=1)
            fits = rank < free
            slots = np.argsort(taken, axis=1, kind="stable")
            self.table[bucket[fits], slots[fits, rank[fits]]] = mark[fits]
            kicks = (rank == free)[~fits] & (k > 1)
            mark, bucket = mark[~fits], bucket[~fits]
            slot = (mark[kicks] + k) % WAYS
            out = self.table[bucket[kicks], slot].copy()
            self.table[bucket[kicks], slot] = mark[kicks]
            mark[kicks] = out
            bucket = self._other(mark, bucket)
        return not len(mark)

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Remove one fingerprint a key; the keys must be in the filter."""
        mark, a, b = self.places(hi, lo)
        while len(mark):
            own = (self.table[a] == mark[:, None]).any(axis=1)
            at = np.where(own, a, b)
            held = self.table[at] == mark[:, None]
            if not held.any(axis=1).all():
                raise KeyError("a key that the filter does not hold")
            slot = at * WAYS + held.argmax(axis=1)
            _, first = np.unique(slot, return_index=True)  # keys that share a slot take turns
            self.table.reshape(-1)[slot[first]] = 0
            left = np.ones(len(mark), dtype=bool)
            left[first] = False
            mark, a, b = mark[left], a[left], b[left]


def text_lines(text: Column) -> Column:
    """A text's lines; a null or empty one is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def long_lines(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, _t, _i, hi, lo): a row for each line whose key has at least `shortest` code points; _t: the text's hash, _i: the line's place."""
    keys = F.transform(text_lines(F.col("text")), line_key)
    rows = docs.select("doc_id", F.xxhash64("text").alias("_t"), F.posexplode(keys).alias("_i", "_k"))
    return rows.where(F.length("_k") >= shortest).select("doc_id", "_t", "_i", F.xxhash64("_k").alias("hi"), F.xxhash64(F.lit(1), "_k").alias("lo"))


_FILTERS = "shard int, n long, table binary, full boolean"


class LineIndex:
    """The index in the folder `path` (one of its own in the shared folder if none is given).

    Rows that share a doc_id are one document, those without an id are one document that is smaller than all others.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, least: int = 3, shortest: int = 20, shard_keys: int = 1 << 16):
        self.spark, self.least, self.shortest, self.shard_keys = spark, least, shortest, shard_keys
        self.path = path or f"{shared_dir(spark).rstrip('/')}/eventloom/{uuid.uuid4().hex}-lines"
        self.batch, self.inserted, self.deleted, self.bits = 0, [], [], None

    def _at(self, name: str, batch: int | None = None) -> str:
        return f"{self.path}/{name}/{self.batch if batch is None else batch}"

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self._at(name))
        return self.spark.read.schema(df.schema).parquet(self._at(name))

    def members(self, shape: DataFrame) -> DataFrame:
        """(hi, lo, doc_id) of the documents that are in the index; shape: documents, for the type of their ids."""
        kind = shape.schema["doc_id"].dataType.simpleString()
        schema = f"hi long, lo long, doc_id {kind}, batch int"
        if not self.inserted:
            return self.spark.createDataFrame([], schema).drop("batch")
        rows = self.spark.read.schema(schema).parquet(*[self._at("members", b) for b in self.inserted])
        if self.deleted:
            gone = self.spark.read.schema(f"doc_id {kind}, batch int").parquet(*[self._at("gone", b) for b in self.deleted]).groupBy("doc_id").agg(F.max("batch").alias("until"))
            rows = rows.alias("m").join(gone.alias("g"), F.expr("m.doc_id <=> g.doc_id and m.batch < g.until"), "left_anti")
        return rows.select("hi", "lo", "doc_id")

    def counts(self, shape: DataFrame) -> DataFrame:
        """(shard, hi, lo, n, largest): how many documents hold a key, and the largest doc_id that does."""
        schema = f"shard int, hi long, lo long, n long, largest {shape.schema['doc_id'].dataType.simpleString()}, was long"
        found = self.spark.read.schema(schema).parquet(self._at("counts")) if self.batch else self.spark.createDataFrame([], schema)
        return found.where("n > 0").drop("was")

    def filters(self) -> DataFrame:
        return self.spark.read.schema(_FILTERS).parquet(self._at("filters")) if self.batch else self.spark.createDataFrame([], _FILTERS)

    def _shard(self, hi: Column) -> Column:
        return F.shiftrightunsigned(hi, 64 - self.bits).cast("int")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents (doc_id, text).  A line that the index has of the same document is not counted again."""
        known, before, filters = self.members(docs), self.counts(docs), self.filters()
        fresh = long_lines(docs, self.shortest).select("hi", "lo", "doc_id").distinct()
        if self.inserted:
            fresh = fresh.alias("f").join(known.alias("k"), F.expr("f.hi = k.hi and f.lo = k.lo and f.doc_id <=> k.doc_id"), "left_anti")
        self.batch += 1
        fresh = self._written(fresh.withColumn("batch", F.lit(self.batch)), "members")
        self.inserted.append(self.batch)
        if self.bits is None:
            self.bits = max(6, int(np.ceil(np.log2(max(1, fresh.count()) / self.shard_keys))))
        new = fresh.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("largest")).select(self._shard(F.col("hi")).alias("shard"), "hi", "lo", "n", "largest", F.lit(0).cast("long").alias("was"))
        both = new.unionByName(before.withColumn("was", F.col("n"))).groupBy("shard", "hi", "lo").agg(F.sum("n").alias("n"), F.max("largest").alias("largest"), F.sum("was").alias("was"))
        return self._settle(self._written(both, "counts"), filters)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Takes documents (doc_id) out; ids that the index doesn't have change nothing."""
        before, filters = self.counts(ids), self.filters()
        gone = ids.select("doc_id").distinct()
        touched = self.members(ids).alias("m").join(gone.alias("g"), F.expr("m.doc_id <=> g.doc_id"), "left_semi").groupBy("hi", "lo").agg(F.count("*").alias("_gone"))
        self.batch += 1
        touched = self._written(touched, "touched")
        self._written(gone.withColumn("batch", F.lit(self.batch)), "gone")
        self.deleted.append(self.batch)
        left = self.members(ids).join(touched, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.max("doc_id").alias("_largest"))
        rows = before.join(touched, ["hi", "lo"], "left").join(left, ["hi", "lo"], "left")
        now = rows.select("shard", "hi", "lo", (F.col("n") - F.coalesce("_gone", F.lit(0))).alias("n"), F.when(F.col("_gone").isNull(), F.col("largest")).otherwise(F.col("_largest")).alias("largest"), F.col("n").alias("was"))
        return self._settle(self._written(now, "counts"), filters)

    def _settle(self, counts: DataFrame, filters: DataFrame) -> LineIndex:
        """Carry keys that crossed `least` into their shards' filters; shards whose filter overflows get a larger one, from the exact counts."""
        held = F.col("n") >= self.least
        crossed = counts.where(held != (F.col("was") >= self.least)).select("shard", "hi", "lo", F.when(held, 1).otherwise(-1).alias("sign"))
        done = self._written(_by_shard(filters, crossed, _changed, _FILTERS), "changed")
        full = done.where("full").select("shard")
        again = counts.where(held).join(full, "shard", "left_semi").select("shard", "hi", "lo", F.lit(1).alias("sign"))
        self._written(done.where("not full").unionByName(_by_shard(filters.limit(0), again, _changed, _FILTERS)), "filters")
        return self

    def screened(self, keys: DataFrame) -> DataFrame:
        """The keys (hi, lo, n) that the filters hold: all that `least` documents have, and hardly any others."""
        rows = keys.withColumn("shard", self._shard(F.col("hi")))
        return _by_shard(self.filters(), rows.select("shard", "hi", "lo", F.col("n").alias("sign")), _held, "hi long, lo long, n long")

    def deduplicated(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs whose text keeps no line that `least` documents hold but in the largest of them, and n_lines (before), n_dropped.

        A column of docs with one of these two names is replaced.  Equal rows stay, each with what is left of it.
        """
        source = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
        lines = long_lines(source, self.shortest)
        keys = lines.groupBy("hi", "lo").agg(F.count("*").alias("n"))
        hits = self.screened(keys).join(self.counts(docs).where(F.col("n") >= self.least).select("hi", "lo", "largest"), ["hi", "lo"])
        hits = hits.withColumn("_key", F.struct("hi", "lo"))
        path = f"{self._at('hits')}-{uuid.uuid4().hex}"
        hits.write.parquet(path)
        hits = self.spark.read.schema(hits.schema).parquet(path)
        hot = Hot(hits.select("_key", "n"), "_key")
        dealt = hot.dealt(lines.withColumn("_key", F.struct("hi", "lo")).drop("hi", "lo"), "_t")
        drops = dealt.join(hot.copied(hits.select("_key", "largest")), ["_key", "_salt"]).where("not doc_id <=> largest")
        drops = drops.groupBy(F.col("doc_id").alias("_d"), "_t").agg(F.collect_set("_i").alias("_drop"))  # at most a document's lines
        own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        rows = docs.select(*[F.col(f"`{c}`") for c in own], F.xxhash64(F.col(f"`{text}`")).alias("_row_t")).join(drops, F.expr("doc_id <=> _d and _row_t = _t"), "left")
        kept = let(text_lines(F.col(f"`{text}`")), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_drop")), lambda i: F.get(ls, i)), "\n"))
        new = F.when(F.col("_drop").isNull(), F.col(f"`{text}`")).otherwise(kept)
        return rows.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in own], F.size(text_lines(F.col(f"`{text}`"))).cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))


def _by_shard(filters: DataFrame, keys: DataFrame, each, schema: str) -> DataFrame:
    """each(shard, filter or None, batches of (hi, lo, sign)) -> rows, over shards side by side; keys stream past the shard's filter."""
    both = filters.select("shard", F.lit(0).alias("_kind"), "table", F.lit(None).cast("long").alias("hi"), F.lit(None).cast("long").alias("lo"), F.lit(0).cast("long").alias("sign")).unionByName(keys.select("shard", F.lit(1).alias("_kind"), F.lit(None).cast("binary").alias("table"), "hi", "lo", F.col("sign").cast("long").alias("sign")))

    def run(batches):
        shard, held = None, None
        for batch in batches:
            ids = batch.column("shard").to_numpy()
            for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1):
                if not len(part):
                    continue
                rows = batch.slice(part[0], len(part))
                if ids[part[0]] != shard:
                    if held is not None:
                        yield from held.end()
                    shard, held = ids[part[0]], each(int(ids[part[0]]))
                kind = rows.column("_kind").to_numpy()
                for data in rows.column("table").drop_null().to_pylist():
                    held.begin(data)
                hi, lo, sign = (rows.column(c).fill_null(0).to_numpy()[kind == 1] for c in ("hi", "lo", "sign"))  # nulls would make doubles
                if len(hi):
                    yield from held.keys(hi, lo, sign)
        if held is not None:
            yield from held.end()

    # by a hash of the shard: above a join on the shard itself, a repartition by it would be left out, and the join may be replaced at run time
    return both.repartition(F.xxhash64("shard")).sortWithinPartitions("shard", "_kind").mapInArrow(run, schema)


class _held:
    """Emits the keys that the shard's filter holds."""

    def __init__(self, shard: int):
        self.filter = None

    def begin(self, data: bytes) -> None:
        self.filter = Cuckoo.read(data)

    def keys(self, hi, lo, sign):
        if self.filter is not None and (found := self.filter.contains(hi, lo)).any():
            yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (hi, lo, sign)], ["hi", "lo", "n"])

    def end(self):
        return ()


class _changed(_held):
    """Inserts keys with sign 1 and deletes those with -1, which are in the filter; emits the shard's filter, or says that it is full."""

    def __init__(self, shard: int):
        super().__init__(shard)
        self.shard, self.new = shard, []

    def keys(self, hi, lo, sign):
        self.new.append((hi, lo, sign))
        return ()

    def end(self):
        hi, lo, sign = (np.concatenate(x) for x in zip(*self.new, strict=True)) if self.new else (np.zeros(0, np.int64),) * 3
        if self.filter is None:
            self.filter, ok = Cuckoo.of(hi[sign > 0], lo[sign > 0]), True
        else:
            self.filter.delete(hi[sign < 0], lo[sign < 0])
            ok = self.filter.insert(hi[sign > 0], lo[sign > 0])
        yield pa.RecordBatch.from_arrays([pa.array([self.shard], pa.int32()), pa.array([int((self.filter.table > 0).sum())]), pa.array([self.filter.table.tobytes()]), pa.array([not ok])], ["shard", "n", "table", "full"])
