"""Resampling whole clusters: multiplicities by hashed draws, replicated statistics, intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an md5 over the parts' text; reruns agree."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def poisson_edges(most: int = 12) -> list[float]:
    """Cumulative probabilities of Poisson(1)."""
    out, total = [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
    return out


def poisson_weight(u: Column, most: int = 12) -> Column:
    """A Poisson(1) count by inverting its distribution at u: how often a bootstrap draws a cluster, when there are many."""
    out = F.lit(most)
    for k, edge in reversed(list(enumerate(poisson_edges(most)))):
        out = F.when(u < edge, k).otherwise(out)
    return out


def poisson_digest(digest: Column, most: int = 12) -> Column:
    """poisson_weight of the number that a digest's first 12 hexadecimal digits are, by comparing texts: the digest is taken once and no digit is converted."""
    out = F.lit(most)
    for k, edge in reversed([(k, f"{e:012x}" if e < 1 << 48 else "g") for k, e in enumerate(_whole_edges(most))]):
        out = F.when(digest < F.lit(edge), k).otherwise(out)
    return out


def _whole_edges(most: int) -> list[int]:
    """For each edge of Poisson(1) the first number of 48 bits that is not below it."""
    return [math.ceil(e * (1 << 48)) for e in poisson_edges(most)]


def poisson_hex(digits: Column) -> Column:
    """A Poisson(1) count from six hexadecimal digits, compared as text with the edges of its distribution."""
    out = F.lit(10)
    for k, edge in reversed(list(enumerate(poisson_edges(10)))):
        out = F.when(digits < F.lit(hex_edge(edge)), k).otherwise(out)
    return out


def hex_edge(edge: float) -> str:
    return f"{math.floor(edge * (1 << 24)):06x}"


def poisson_blocks(df: DataFrame, strata: Sequence[str], cluster: str, values: Sequence[str], repetitions: int, seed: int) -> DataFrame:
    """(strata, draw, weight, values): sums over reweighted clusters, one row of df each; weight is the sum of the weights.

    One md5 of (seed, block, strata, cluster) gives the weights of five draws, six digits each; a cluster's row is read once a block.
    """
    blocks = math.ceil(repetitions / 5)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_block").cast("string"), *[text(c) for c in (*strata, cluster)]).cast("binary")))
    rows = rows.withColumns({f"_w{k}": poisson_hex(F.substring("_h", 6 * k + 1, 6)) for k in range(5)})
    sums = rows.groupBy(*strata, "_block").agg(*[F.sum(f"_w{k}").alias(f"_n{k}") for k in range(5)], *[F.sum(F.col(f"_w{k}") * F.col(v)).alias(f"_v{k}_{i}") for k in range(5) for i, v in enumerate(values)])
    each = F.explode(F.array(*[F.struct((F.col("_block") * 5 + k).alias("draw"), F.col(f"_n{k}").alias("weight"), *[F.col(f"_v{k}_{i}").alias(v) for i, v in enumerate(values)]) for k in range(5)]))
    return sums.select(*strata, each.alias("_e")).select(*strata, "_e.*").where(F.col("draw") < repetitions)


def cluster_draws(df: DataFrame, strata: Sequence[str], cluster: str, repetitions: int, seed: int) -> DataFrame:
    """(strata, cluster, draw, multiplicity): each draw reweights whole clusters; strata are drawn independently.

    A multiplicity depends on (seed, draw, stratum, cluster) only, so draws can be computed anywhere and resumed.
    """
    clusters = df.select(*strata, cluster).distinct()
    return _digested(clusters, strata, cluster, repetitions, seed).select(*strata, cluster, "draw", poisson_digest(F.col("_h")).alias("multiplicity"))


def _digested(clusters: DataFrame, strata: Sequence[str], cluster: str, repetitions: int, seed: int) -> DataFrame:
    """A row a cluster and draw with _h, the md5 of (seed, draw, strata, cluster); a cluster's own text is made once."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*strata, cluster)])
    first = F.array(*[F.lit(f"{seed}|{draw}|") for draw in range(repetitions)])
    drawn = clusters.withColumn("_t", text).select(*clusters.columns, "_t", F.posexplode(first).alias("draw", "_f"))
    return drawn.withColumn("_h", F.md5(F.concat("_f", "_t").cast("binary"))).drop("_t", "_f")


def bootstrap_means(df: DataFrame, strata: Sequence[str], cluster: str, value: str, repetitions: int, seed: int) -> DataFrame:
    """(draw, mean): the mean of value over reweighted clusters, with the weights of cluster_draws.

    Values are summed by cluster first, so a draw multiplies clusters, not rows; a cluster and draw costs one digest.
    """
    sums = df.groupBy(*strata, cluster).agg(F.sum(value).alias("_v"), F.count(value).alias("_n"))
    drawn = _digested(sums, strata, cluster, repetitions, seed).withColumn("_w", poisson_digest(F.col("_h")))
    return drawn.groupBy("draw").agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum(F.col("_w") * F.col("_n"))).alias("mean"))


def interval(draws: DataFrame, keys: Sequence[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Per key: mean, standard error, exact percentile interval and the share of draws above zero."""
    return draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("se"), F.percentile(value, low).alias("low"), F.percentile(value, high).alias("high"), F.avg((F.col(value) > 0).cast("double")).alias("p_positive"))


def paired_difference(losses: DataFrame, cluster: str, candidate: str, baseline: str, strata: Sequence[str], repetitions: int, seed: int) -> DataFrame:
    """Interval of the mean loss difference, candidate less baseline, over whole clusters."""
    return interval(bootstrap_means(losses.withColumn("_d", F.col(candidate) - F.col(baseline)), strata, cluster, "_d", repetitions, seed), (), "mean")


def rank_bands(draws: DataFrame, entity: str, draw: str, value: str, tops: Sequence[int] = (10, 25)) -> DataFrame:
    """Per entity: 5 %, 50 % and 95 % of its rank over the draws, and how often it is among the first few."""
    from .ranking import rank_within

    ranked = rank_within(draws, [draw], value, F.lit(True), "_rank")
    return ranked.groupBy(entity).agg(*[F.percentile("_rank", q).alias(f"rank_p{round(100 * q)}") for q in (0.05, 0.5, 0.95)], *[F.avg((F.col("_rank") <= t).cast("double")).alias(f"p_top{t}") for t in tops])


def permuted(df: DataFrame, columns: Sequence[str], order: Sequence[str], seed: int, rows: int = 100_000) -> DataFrame:
    """The columns' values dealt anew among the rows, jointly: for grouped permutation importance.

    Rows are numbered within hash buckets and values move within their bucket, so nothing is sorted as a whole.
    """
    from pyspark.sql import Window

    size = max(64, math.ceil(df.count() / rows))  # buckets of about `rows` rows
    own = Window.partitionBy("_b").orderBy(*order)
    dealt = Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed), *[F.col(o) for o in order]), *order)
    base = df.withColumn("_b", F.pmod(F.xxhash64(*[F.col(o) for o in order]), F.lit(size)))
    values = base.select("_b", F.row_number().over(dealt).alias("_n"), *columns)
    return base.drop(*columns).withColumn("_n", F.row_number().over(own)).join(values, ["_b", "_n"]).select(*df.columns)


def peak_bands(draws: DataFrame, entity: str, draw: str, period: str, value: str, weight: str, span: int, tops: Sequence[int] = (10, 25)) -> DataFrame:
    """Rank bands of each entity's best window, chosen anew in every draw, so that the choice's own luck is part of the bands."""
    from .ranking import best_row, calendar_windows

    best = best_row(calendar_windows(draws, [draw, entity], period, value, weight, span), [draw, entity], "mean", ["window_start"])
    return rank_bands(best, entity, draw, "mean", tops)
