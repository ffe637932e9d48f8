"""Joins with a checked number of partners, quarantine of whole keys, and quality ledgers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contracts import ContractError


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def unique_gate(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """df, or an error if a key is null or comes twice; pre-summed counts, never the rows, are shuffled."""
    bad = df.groupBy(*keys).count().where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.col("count") > 1)).limit(3).collect()
    if bad:
        raise ContractError(f"{what}: key {tuple(keys)} is null or repeated, as in {[tuple(r)[:-1] for r in bad]}")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join that fails if a key repeats on a side that the contract calls "one"."""
    ones = {"one_to_one": (True, True), "many_to_one": (False, True), "one_to_many": (True, False), "many_to_many": (False, False)}[validate]
    for side, one, name in ((left, ones[0], "left"), (right, ones[1], "right")):
        if one:
            bad = duplicate_keys(side.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])), on).limit(3).collect()
            if bad:
                raise ContractError(f"{validate} join: the {name} key {tuple(on)} repeats, as in {[tuple(r)[:-1] for r in bad]}")
    return left.join(right, list(on), how)


def coverage_gate(df: DataFrame, matched: Column, least: float, what: str) -> float:
    """The share of matched rows, or an error if it is below `least`."""
    n, hits = df.agg(F.count("*"), F.count_if(matched)).first()
    share = hits / n if n else 1.0
    if share < least:
        raise ContractError(f"{what}: {share:.4f} of the rows match, {least} are needed")
    return share


def reasons(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that a row breaks; a null condition counts as kept."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))


def rejected_keys(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row a key with a broken row: key, n_bad rows, reasons (sorted, comma-joined)."""
    found = df.select(*key, reasons(rules).alias("_r")).where(F.size("_r") > 0)
    return found.groupBy(*key).agg(F.count("*").alias("n_bad"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_r")))), ",").alias("reasons"))


def quarantine(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows of clean keys, ledger): one bad row rejects its whole key.

    collect_set holds at most one entry a combination of rules, not a row each.
    """
    ledger = rejected_keys(df, key, rules)
    return df.join(ledger.select(*key), list(key), "left_anti"), ledger


def quality_report(df: DataFrame, keys: Sequence[str], ranges: Mapping[str, tuple] = {}, members: Mapping[str, Sequence] = {}) -> DataFrame:  # noqa: B006
    """One row: rows, null keys, repeated keys, and per column nulls, values out of range or outside a set."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    repeated = per_key.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).alias("n_repeated"))
    counts = [F.count("*").alias("n_rows"), F.count_if(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).alias("n_null_keys")]
    counts += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in (*ranges, *members)]
    counts += [F.count_if(~F.col(c).between(*r)).alias(f"range_{c}") for c, r in ranges.items()]
    counts += [F.count_if(~F.col(c).isin(*m)).alias(f"member_{c}") for c, m in members.items()]
    one = df.agg(*counts)
    return one.withColumn("_k", F.lit(1)).join(repeated.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row on each side


def full_outer_issues(left: DataFrame, right: DataFrame, on: Sequence[str], compare: Mapping[str, str]) -> DataFrame:
    """Keys of both feeds with an issue label: missing_left, missing_right, differs or ok."""
    a, b = left.withColumn("_in_left", F.lit(1)), right.withColumn("_in_right", F.lit(1))
    both = a.join(b, list(on), "full")
    same = reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in compare.items()], F.lit(True))
    label = F.when(F.col("_in_left").isNull(), "missing_left").when(F.col("_in_right").isNull(), "missing_right").when(~same, "differs").otherwise("ok")
    return both.withColumn("issue", label).drop("_in_left", "_in_right")


def reconcile(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that only one feed has: key, side."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    return a.join(b, list(on), "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, list(on), "left_anti").withColumn("side", F.lit("right_only")))


def prefer(feeds: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Rows of the first feed that has the key: each later feed only adds keys that none before it has."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed.join(out.select(*key).distinct(), list(key), "left_anti"), allowMissingColumns=True)
    return out


def collapse_identical(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(one row a key whose rows are all alike, keys with conflicting payloads and how many)."""
    payloads = df.distinct()
    counts = payloads.groupBy(*key).agg(F.count("*").alias("n_payloads"))
    return payloads.join(counts.where("n_payloads = 1").select(*key), list(key), "left_semi"), counts.where("n_payloads > 1")
