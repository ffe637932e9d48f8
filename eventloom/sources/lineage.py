"""Writing and lineage: manifests, row-set hashes, latest-wins registries, sharded exports."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import ContractError


#: Fixed value: the prime modulo which rows' hashes are added up.
PRIME = 2**255 - 19


def row_set_sums(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[int, int]:
    """(rows, sum of the rows' SHA-256 modulo PRIME): of a union of disjoint sets of rows it is the sum of theirs.

    Each hash is added in eight parts of 32 bits, so a task holds eight numbers, however many rows it has; repeated rows count as often as they occur.
    """
    body = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns or df.columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)
    parts = df.select(body.alias("h")).select(*[F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)").alias(f"p{k}") for k in range(8)])
    n, *sums = parts.agg(F.count("*"), *[F.sum(f"p{k}") for k in range(8)]).first()
    return n, sum(int(x or 0) << (32 * (7 - k)) for k, x in enumerate(sums)) % PRIME


def merged_sums(parts: Sequence[tuple[int, int]]) -> tuple[int, int]:
    return sum(n for n, _ in parts), sum(x for _, x in parts) % PRIME


def row_set_hash(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A digest of a multiset of rows (of some columns, by default all), whatever its order and partitions."""
    n, total = row_set_sums(df, columns)
    return hashlib.sha256(f"{n}:{total:064x}".encode()).hexdigest()


def write_atomic_json(payload: dict, path: str | Path) -> Path:
    """Sorted-key JSON, published by a rename on the driver's file system."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".partial")
    part.write_text(json.dumps(payload, sort_keys=True, indent=2) + "\n")
    os.replace(part, path)
    return path


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def snapshot_id(parts: Sequence[tuple]) -> str:
    """Content address of (name, hash, rows) entries, whatever their order."""
    return hashlib.sha256(json.dumps(sorted(parts)).encode()).hexdigest()


def pinned_problems(manifest: dict, root: str | Path, *, statuses: Sequence[str] = ("accepted",)) -> list[str]:
    """What keeps a pinned set of artifacts from being used: missing fields or files, other hashes, a status that is not allowed.

    manifest: status, and artifacts as {name: {path, sha256}}.
    """
    out = [] if manifest.get("status") in statuses else [f"status {manifest.get('status')!r} is none of {list(statuses)}"]
    for name, entry in sorted(manifest.get("artifacts", {}).items()):
        if not {"path", "sha256"} <= set(entry):
            out.append(f"{name}: no path or hash")
        elif not (Path(root) / entry["path"]).is_file():
            out.append(f"{name}: no file")
        elif file_sha256(Path(root) / entry["path"]) != entry["sha256"]:
            out.append(f"{name}: other content")
    return out if manifest.get("artifacts") else [*out, "no artifacts"]


def latest(df: DataFrame, key: Sequence[str], at: Sequence[str]) -> DataFrame:
    """The last registered row of each key: an upsert table as an append-only one."""
    rest = [c for c in df.columns if c not in key]
    found = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_row"))
    return found.select(*key, "_row.*").select(*df.columns)


def register(spark, path: str, rows: DataFrame) -> None:
    rows.write.mode("append").parquet(path)


def sharded_json(df: DataFrame, key: str, shards: int, path: str) -> None:
    """One folder of JSON lines a shard, by the key's remainder."""
    df.withColumn("shard", F.pmod(F.col(key), F.lit(shards)).cast("int")).repartition("shard").write.mode("overwrite").partitionBy("shard").json(path)


def parquet_contract(spark, path: str, columns: dict[str, str]) -> list[str]:
    """What a Parquet file's footer lacks of a contract (name -> type)."""
    there = dict(spark.read.parquet(path).dtypes)
    return [f"{c}: {there.get(c, 'missing')} instead of {t}" for c, t in columns.items() if there.get(c) != t]


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop: the store that the executors see, whatever it is."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def write_manifest(spark: SparkSession, payload: dict, path: str) -> None:
    """Sorted-key JSON in the shared store: written aside, then renamed over the old one in one step, so a reader sees either whole."""
    files, part = _files(spark, f"{path}.{uuid.uuid4().hex}.partial")
    out = files.create(part, True)
    out.write(bytearray((json.dumps(payload, sort_keys=True, indent=2) + "\n").encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(part, hadoop.Path(path), over)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    files, found = _files(spark, path)
    if not files.exists(found):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def publish(df: DataFrame, root: str, keep: int = 2, **more) -> dict:
    """Write df as a new version below root and point to it last; returns the manifest (version, rows, hash, columns, previous, more).

    A write that fails leaves the pointer, and so the version before, as they were.  Versions but the latest `keep` are deleted after the pointer has moved.
    """
    spark, pointer = df.sparkSession, f"{root}/current.json"
    before = read_manifest(spark, pointer)
    version = uuid.uuid4().hex
    try:
        df.write.parquet(f"{root}/versions/{version}")
    except Exception:
        files, path = _files(spark, f"{root}/versions/{version}")
        files.delete(path, True)
        raise
    written = spark.read.schema(df.schema).parquet(f"{root}/versions/{version}")
    n, total = row_set_sums(written)
    older = [before["version"], *before["previous"]] if before else []
    manifest = {**more, "version": version, "rows": n, "sum": f"{total:064x}", "columns": dict(df.dtypes), "previous": older[: keep - 1]}
    write_manifest(spark, manifest, pointer)
    for old in older[keep - 1 :]:
        files, path = _files(spark, f"{root}/versions/{old}")
        files.delete(path, True)
    return manifest


def published(spark: SparkSession, root: str, verify: bool = False) -> DataFrame:
    """The version that root points to; verify: an error if its rows are not those that were published."""
    manifest = read_manifest(spark, f"{root}/current.json")
    if manifest is None:
        raise ContractError(f"nothing is published at {root}")
    df = spark.read.parquet(f"{root}/versions/{manifest['version']}")
    if verify and row_set_sums(df) != (manifest["rows"], int(manifest["sum"], 16)):
        raise ContractError(f"the rows of {manifest['version']} are not those that were published")
    return df


def bundle(spark: SparkSession, roots: dict[str, str], target: str, statuses: Sequence[str] = ("accepted",)) -> dict:
    """Pin the published versions of several tables in one manifest; an error if one is not there, has not one of the statuses, or does not hold its rows."""
    pinned = {}
    for name, root in sorted(roots.items()):
        found = read_manifest(spark, f"{root}/current.json")
        if found is None or found.get("status") not in statuses:
            raise ContractError(f"{name}: {'nothing is published' if found is None else 'status ' + repr(found.get('status'))}")
        published(spark, root, verify=True)
        pinned[name] = {"path": f"{root}/versions/{found['version']}", "rows": found["rows"], "sum": found["sum"]}
    manifest = {"tables": pinned, "id": snapshot_id([(n, p["sum"], p["rows"]) for n, p in pinned.items()])}
    write_manifest(spark, manifest, target)
    return manifest


def spliced_if_alike(old: DataFrame, new: DataFrame, key: Sequence[str], period: str, at: int, value: str, *, coverage: float = 0.95, correlation: float = 0.95, sd_ratio: tuple[float, float] = (0.8, 1.25), least: int = 20) -> DataFrame:
    """spliced(), if the two sources tell the same on the keys that the old one has; else an error that names the gates.

    Gates: at least `least` shared keys, the share of the old ones that are there, the correlation and the ratio of the deviations.
    """
    row = overlap(old, new, [*key, period], value).first()
    wrong = [g for g, ok in (("keys", row["n"] >= least), ("coverage", (row["coverage"] or 0) >= coverage), ("correlation", (row["correlation"] or 0) >= correlation), ("sd_ratio", sd_ratio[0] <= (row["sd_ratio"] or 0) <= sd_ratio[1])) if not ok]
    if wrong:
        raise ContractError(f"the sources differ: {', '.join(wrong)} ({row.asDict()})")
    return spliced(old, new, period, at)


def spliced(old: DataFrame, new: DataFrame, period: str, at: int) -> DataFrame:
    """The old series before a period, the new one from it on."""
    return old.where(F.col(period) < at).unionByName(new.where(F.col(period) >= at))


def overlap(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """One row: shared keys, coverage of the old ones, correlation, ratio of deviations, mean absolute difference."""
    a, b = old.select(*key, F.col(value).alias("_a")), new.select(*key, F.col(value).alias("_b"))
    both = a.join(b, list(key), "left")
    there = F.col("_b").isNotNull()
    return both.agg(F.count_if(there).alias("n"), F.avg(there.cast("double")).alias("coverage"), F.corr("_a", "_b").alias("correlation"), F.try_divide(F.stddev_pop("_b"), F.stddev_pop(F.when(there, F.col("_a")))).alias("sd_ratio"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mean_abs_difference"))


def canonical_names(df: DataFrame, ident: str, name: str, order: Sequence[str]) -> DataFrame:
    """Per id: the preferred name, all others joined by "|" in order, and how many there are."""
    best = Window.partitionBy(ident).orderBy(*[F.desc(o) for o in order], name)
    ranked = df.groupBy(ident, name).agg(*[F.max(o).alias(o) for o in order]).withColumn("_n", F.row_number().over(best))
    return ranked.groupBy(ident).agg(F.max(F.when(F.col("_n") == 1, F.col(name))).alias("canonical"), F.array_join(F.array_sort(F.collect_set(name)), "|").alias("aliases"), F.count("*").alias("n_names"))
