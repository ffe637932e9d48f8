"""Leaderboards, peaks, search, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rates import quantiles, running_counts, weighted_mean


def leaderboard(df: DataFrame, where: Column, order: Sequence[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of the rows that qualify, with their rank from 1 in a total order.

    With a limit, only offset + limit rows reach the final sort, by a top-k that every task starts; a rank over all rows would
    bring them all to one task.
    """
    top = df.where(where).orderBy(*order)
    if limit is not None:
        top = top.limit(offset + limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.where(F.col("rank") > offset)


def rank_within(df: DataFrame, by: Sequence[str], value: str, eligible: Column, name: str = "rank", descending: bool = True) -> DataFrame:
    """Adds the least rank among eligible rows of the group; null for the others."""
    counts = df.where(eligible & F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranks = running_counts(counts, by, value, "_n", descending).select(*by, value, (F.col("_before") + 1).cast("long").alias("_place"))
    return df.join(ranks, [*by, value], "left").withColumn(name, F.when(eligible, F.col("_place"))).drop("_place")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits each task's rows of a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def best_row(df: DataFrame, by: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """The row of each group with the greatest value, missing ones aside; ties go to the least `ties` (numbers)."""
    rest = [c for c in df.columns if c not in by]
    order = F.struct(F.col(value), *[(-F.col(t)).alias(f"_{t}") for t in ties])
    found = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return found.select(*by, "_row.*")


def calendar_windows(df: DataFrame, keys: Sequence[str], period: str, value: str, weight: str, span: int, least_weight: float = 0.0) -> DataFrame:
    """Weighted means over every calendar window of `span` periods between a key's first and last one.

    Windows may start in a period without a row.  Each row goes to the windows that hold it, so no range join is needed.
    """
    bounds = df.groupBy(*keys).agg(F.min(period).alias("_lo"), F.max(period).alias("_hi"))
    both = df.join(bounds, list(keys))
    first, last = F.greatest(F.col("_lo"), F.col(period) - span + 1), F.least(F.col(period), F.col("_hi") - span + 1)
    starts = F.when(first <= last, F.sequence(first, last))
    spread = both.withColumn("window_start", F.explode(starts))
    out = spread.groupBy(*keys, "window_start").agg(weighted_mean(F.col(value), F.col(weight)).alias("mean"), F.sum(weight).alias("weight"), F.count("*").alias("periods"))
    return out.where(F.col("weight") >= least_weight).withColumn("window_end", F.col("window_start") + span - 1)


def peaks(df: DataFrame, keys: Sequence[str], period: str, value: str, weight: str, span: int, least_weight: float = 0.0) -> DataFrame:
    """Each key's best window and its rank among all keys."""
    best = best_row(calendar_windows(df, keys, period, value, weight, span, least_weight), keys, "mean", ["window_start"])
    return rank_within(best, (), "mean", F.lit(True), "peak_rank")


def search(df: DataFrame, column: str, text: str, ties: Sequence[str], limit: int = 20) -> DataFrame:
    """Case-insensitive substring search: exact hits, then prefixes, then the rest."""
    name, wanted = F.lower(column), text.lower()
    kind = F.when(name == wanted, 0).when(name.startswith(wanted), 1).when(name.contains(wanted), 2)
    return df.withColumn("match_kind", kind).where("match_kind is not null").orderBy("match_kind", *ties).limit(limit)


def profile(base: DataFrame, key: str, tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One nested row a key: the base columns and, for each table, its rows of the key in a given order.

    tables: name -> (rows, order columns); rows of a key are few, as those of one player are.
    """
    out = base
    for name, (rows, order) in tables.items():
        rest = [c for c in rows.columns if c != key and c not in order]
        nested = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
        out = out.join(nested, key, "left")
    return out


def median_of(df: DataFrame, where: Column, value: str) -> DataFrame:
    return quantiles(df.where(where), (), value, {"median": 0.5})


def quantile_bins(df: DataFrame, value: str, n: int, name: str = "bin") -> DataFrame:
    """Adds the number of the equal-count bin (edges at exact percentiles, right-closed, the first one closed on both sides)."""
    edges = quantiles(df, (), value, {f"q{i}": i / n for i in range(n + 1)}).first()  # n + 1 numbers
    if edges is None or edges[0] is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    number = F.lit(n)
    for i in range(n - 1, 0, -1):
        number = F.when(F.col(value) <= edges[i], i).otherwise(number)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), number))
