"""Helpers shared by the text operators: shared storage, folds, words and span digests."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import time
import uuid
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The white space of the word contract, as a regular expression class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SPACE_CHARS = " \t\n\x0b\f\r"
#: Where Spark ends a batch that it sends to a Python worker: with the row that reaches so many bytes.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where none is configured, a local one is made for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="eventloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_OPEN: list[list[str]] = []
_SETTLED = [0.0]


def written(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder once and read the table back.  outer: it outlives the innermost block of intermediates()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/eventloom/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    for paths in _OPEN[-2:-1] if outer else _OPEN[-1:]:
        paths.append(path)
    settled(spark)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession) -> None:
    """After a step, at most every second: collect the driver's garbage, as only then Spark removes the step's shuffle files and broadcasts, and give freed memory back.

    The driver's many short-lived threads leave freed native memory with the C library's allocator, which keeps it; after a few hundred jobs that is as much as the heap in
    use.  A JVM without the command for it keeps the memory; nothing else changes.
    """
    if time.monotonic() - _SETTLED[0] > 1:
        jvm = spark.sparkContext._jvm
        jvm.System.gc()
        with suppress(Py4JError):
            trim_native_memory(spark)
        _SETTLED[0] = time.monotonic()


def trim_native_memory(spark: SparkSession) -> None:
    """What `jcmd System.trim_native_heap` does, in the driver itself: the diagnostic command's bean, called by its public interface."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    kinds = array(jvm.java.lang.Class, 4)
    kinds[0], kinds[1], kinds[2], kinds[3] = named("javax.management.ObjectName"), named("java.lang.String"), named("[Ljava.lang.Object;"), named("[Ljava.lang.String;")
    values = array(jvm.Object, 4)
    values[0], values[1], values[2], values[3] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", array(jvm.Object, 0), array(jvm.String, 0)
    named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


@contextmanager
def intermediates(spark: SparkSession):
    """Tables written within the block are deleted at its end; what is read later must be written by other means."""
    _OPEN.append([])
    try:
        yield
    finally:
        for name in _OPEN.pop():
            removed(spark, name)


def removed(spark: SparkSession, name: str) -> None:
    """Delete a table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Hot:
    """Keys with more than one in ``most`` of all rows.  Their rows are dealt over several salts, so that no task gets such a key whole.

    counts has a row a key, with its number of rows n.  Fewer than ``most`` keys can be hot, so their list is small.
    A join on [key, "_salt"] of dealt rows with copied ones gives what the join on key would.
    """

    def __init__(self, counts: DataFrame, key: str, most: int = 2000, least: int = 64):
        total, largest = counts.agg(F.sum("n"), F.max("n")).first()
        limit = max(least, (total or 0) // most)
        self.key, self.parts = key, None
        settled(counts.sparkSession)
        if (largest or 0) > limit:
            found = counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("_parts"))
            self.parts = F.broadcast(counts.sparkSession.createDataFrame(found.collect(), found.schema))

    def dealt(self, df: DataFrame, by: str) -> DataFrame:
        """df and _salt, a hash of the column `by` within the key's salts."""
        if self.parts is None:
            return df.withColumn("_salt", F.lit(0))
        return df.join(self.parts, self.key, "left").withColumn("_salt", F.pmod(F.hash(by), F.coalesce("_parts", F.lit(1)))).drop("_parts")

    def copied(self, df: DataFrame) -> DataFrame:
        """df once for each salt of its key."""
        if self.parts is None:
            return df.withColumn("_salt", F.lit(0))
        return df.join(self.parts, self.key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8; bytes.lower and bytes.split act on ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sha(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def small_batches(spark: SparkSession) -> None:
    """From now on Spark's Arrow batches end at BATCH_BYTES, not at 64 MB; a session that names the setting keeps its own.

    A batch of texts is held whole several times: as Arrow vectors and as bytes to send in the executor's native memory, which doubles its buffers as they fill and keeps
    much of what is freed, and as a table in the Python worker, in each task that runs.  No result depends on where batches end.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def slices(batch, column: str, most_bytes: int):
    """Cut an Arrow batch into consecutive slices whose column holds about most_bytes each."""
    start = size = 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def row_map(docs: DataFrame, new: dict[str, str], figures, text: str, slice_bytes: int = 8_000_000) -> DataFrame:
    """All columns of docs but those named in new, then new's columns (name: type), as figures(texts) gives them, column by column.

    figures gets whole texts (None where null), those of one slice of an Arrow batch of about slice_bytes at a time.
    Batches are of about BATCH_BYTES or of one longer row, so a task's memory doesn't grow with its rows.
    """
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in new]
    kept = docs.select(*[F.col(f"`{c}`") for c in own])
    spark_schema = StructType([*kept.schema.fields, *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in new.items())).fields])
    schema = to_arrow_schema(spark_schema)

    def mapped(batches):
        for batch in batches:
            for part in slices(batch, text, slice_bytes):
                columns = figures(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c).cast(schema.field(c).type) for c in own), *(pa.array(x, schema.field(c).type) for c, x in zip(new, columns, strict=True))], schema=schema)

    return kept.mapInArrow(mapped, spark_schema)
