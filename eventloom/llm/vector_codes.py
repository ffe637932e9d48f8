"""Product codes of vectors by Lloyd's rounds with Elkan's pruning.

Components become integers, vectors are cut into equal parts, and each part position has a codebook of a few entries.  A row's state
is written from round to round: for each part its entry, an upper bound of the distance to it and a lower bound of the distance to
every entry, in half precision rounded outwards.  A round shifts the bounds by how far the entries have moved and computes a distance only where
the triangle inequality does not exclude the entry strictly; those distances are exact integers, so ties go to the lower index
as in a full search.  The codebooks, a fixed number of entries, are all that passes through the driver; sums of parts are added up by task first.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import removed, shared_dir

MARGIN = 1e-12  # relative, far beyond the rounding of a square root


def outwards(x: np.ndarray, up: bool) -> np.ndarray:
    """Half-precision numbers not below (up) or not above x >= 0; beyond their range infinity, or the largest number."""
    with np.errstate(over="ignore"):
        half = (x if up else np.minimum(x, 65504.0)).astype(np.float16)
        wrong = half.astype(np.float64) < x if up else half.astype(np.float64) > x
        half[wrong] = np.nextafter(half[wrong], np.float16(np.inf if up else 0))
    return half


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    return ((x - entries) ** 2).sum(axis=-1)


def assigned(x: np.ndarray, entries: np.ndarray, state: tuple | None, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper bound, lower bounds) of a part's rows, and how many distances were computed; state: those of the round before."""
    n, k = len(x), len(entries)
    if state is None:
        exact = np.stack([squares(x, e) for e in entries], axis=1) if n else np.zeros((0, k), np.int64)
        own, far = exact.argmin(axis=1), np.sqrt(exact)
        return own, far[np.arange(n), own] * (1 + MARGIN), far * (1 - MARGIN), n * k
    own, upper, lower = state[0].copy(), state[1] + moved[state[0]] * (1 + MARGIN), np.maximum(state[2] - moved * (1 + MARGIN), 0)
    between = np.sqrt(squares(entries[:, None, :], entries[None, :, :])) / 2 * (1 - MARGIN)
    np.fill_diagonal(between, np.inf)
    todo = np.flatnonzero(upper >= between.min(axis=1)[own])
    if k == 1 or not len(todo):
        return own, upper, lower, 0
    exact = squares(x[todo], entries[own[todo]])
    upper[todo] = np.sqrt(exact) * (1 + MARGIN)
    lower[todo, own[todo]] = np.sqrt(exact) * (1 - MARGIN)
    open_ = (lower[todo] <= upper[todo, None]) & (between[own[todo]] <= upper[todo, None])
    open_[np.arange(len(todo)), own[todo]] = False
    r, c = np.nonzero(open_)
    found = np.full((len(todo), k), np.iinfo(np.int64).max)
    found[np.arange(len(todo)), own[todo]] = exact
    found[r, c] = squares(x[todo[r]], entries[c])
    lower[todo[r], c] = np.sqrt(found[r, c]) * (1 - MARGIN)
    own[todo] = found.argmin(axis=1)
    upper[todo] = np.sqrt(found.min(axis=1)) * (1 + MARGIN)
    return own, upper, lower, len(todo) + len(r)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has neither null, NaN nor infinite components, and not none at all."""
    v = F.col(f"`{vector}`")
    odd = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~odd)


def integers(lists: pa.ListArray, scale: float, length: int) -> np.ndarray:
    """Rows of floor(scale * x); an error if a vector has another length, or a squared distance could pass 64 bits."""
    if len(lists) and not (np.diff(lists.offsets.to_numpy()) == length).all():
        raise ValueError(f"vectors must all have {length} components")
    x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, length)
    if x.size and 4 * length * float(np.abs(x).max()) ** 2 >= 2.0**62:
        raise ValueError("a component is too large for 64-bit distances")
    return x.astype(np.int64)


class Codebooks:
    """entries: [parts, entries, components of a part] integers; moved: how far each has moved in the last round, rounded up."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray | None = None):
        self.entries = entries
        self.moved = np.zeros(entries.shape[:2]) if moved is None else moved

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256), one row a usable vector.

    Codebooks start as the parts of the vectors with the smallest keys (fewer vectors, fewer entries; equal keys by their components, null keys last).
    Rows whose vector is null, empty, or has null or non-finite components are dropped; vectors of another length than the first, or one that the
    number of parts doesn't divide, are an error.  Repeated rows each have a row.  The errors of equal labels, nulls together, are summed.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(key, F.col(f"`{vector}`").alias("_v"), F.col(f"`{label}`").alias("_label")), "_v")
    head = rows.orderBy(F.asc_nulls_last(key), "_v").limit(entries).select("_v").toArrow()
    kind = vectors.schema[key]
    if not head.num_rows:
        return spark.createDataFrame([], StructType([kind, *StructType.fromDDL("code string, error long, label_error long, codebooks_sha256 string").fields]))
    first = head.column("_v").combine_chunks()
    length = len(first[0])
    if length % parts:
        raise ValueError(f"{length} components can't be cut into {parts} equal parts")
    books = Codebooks(integers(first, scale, length).reshape(-1, parts, length // parts).transpose(1, 0, 2).copy())
    root, state = f"{shared_dir(spark).rstrip('/')}/eventloom/{uuid.uuid4().hex}-codes", None
    for r in range(rounds):
        step = _round(rows if state is None else spark.read.schema(state).parquet(f"{root}/{r - 1}"), state is None, books, parts, length, scale)
        step.write.parquet(f"{root}/{r}")
        state = step.schema
        if r:
            removed(spark, f"{root}/{r - 1}")
        books = _replaced(spark.read.schema(state).parquet(f"{root}/{r}"), books, parts, length)
    last = rows if state is None else spark.read.schema(state).parquet(f"{root}/{rounds - 1}")
    _round(last, state is None, books, parts, length, scale, final=True).write.parquet(f"{root}/codes")
    if rounds:
        removed(spark, f"{root}/{rounds - 1}")
    codes = spark.read.schema(StructType([kind, rows.schema["_label"], *StructType.fromDDL("code string, error long").fields])).parquet(f"{root}/codes")
    sums = codes.groupBy(F.col("_label").alias("_l")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.expr("_label <=> _l")).select(key, "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _round(df: DataFrame, fresh: bool, books: Codebooks, parts: int, length: int, scale: float, final: bool = False) -> DataFrame:
    """Every part assigned to its nearest entry: the state for the next round, or in the end codes with their exact errors."""
    key = df.schema.fields[0]
    own = [key, df.schema["_label"]]
    schema = StructType([*own, *StructType.fromDDL("code string, error long" if final else "x array<bigint>, entry binary, upper binary, lower binary").fields])
    arrow = to_arrow_schema(schema)
    k, d = books.entries.shape[1], length // parts

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = integers(batch.column("_v"), scale, length) if fresh else batch.column("x").flatten().to_numpy().reshape(n, length)
            entry, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float16), np.zeros((n, parts, k), np.float16)
            if not fresh:
                before = [np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(n, parts, -1) for c, t in (("entry", np.uint8), ("upper", np.float16), ("lower", np.float16))]
            error = np.zeros(n, dtype=np.int64)
            for p in range(parts):
                part = x[:, p * d : (p + 1) * d]
                state = None if fresh else (before[0][:, p, 0].astype(np.int64), before[1][:, p, 0].astype(np.float64), before[2][:, p].astype(np.float64))
                e, u, low, _ = assigned(part, books.entries[p], state, books.moved[p])
                entry[:, p] = e
                if final:
                    error += squares(part, books.entries[p][e])
                else:
                    upper[:, p], lower[:, p] = outwards(u, True), outwards(low, False)
            if final:
                new = [pa.array([bytes(c).hex() for c in entry], pa.string()), pa.array(error)]
            else:
                packed = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                new = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * length), pa.array(x.reshape(-1))), packed(entry), packed(upper), packed(lower)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([batch.column(key.name), batch.column("_label"), *new], arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def _replaced(state: DataFrame, books: Codebooks, parts: int, length: int) -> Codebooks:
    """The next codebooks: componentwise floors of the means; entries that no part uses stay."""
    k, d = books.entries.shape[1], length // parts

    def run(batches):
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64)
        for batch in batches:
            n = batch.num_rows
            x = batch.column("x").flatten().to_numpy().reshape(n, parts, d)
            entry = np.frombuffer(b"".join(batch.column("entry").to_pylist()), np.uint8).reshape(n, parts)
            for p in range(parts):
                count[p] += np.bincount(entry[:, p], minlength=k)
                np.add.at(total[p], entry[:, p], x[:, p])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = state.select("x", "entry").mapInArrow(run, "part int, entry int, n long, total array<bigint>")
    flat = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    new = books.entries.copy()
    for p, e, at, n, v in flat.collect():  # one row a component of an entry
        new[p, e, at] = v // n
    return Codebooks(new, np.sqrt(squares(new, books.entries)) * (1 + MARGIN))
