"""Pooled rates, shrinkage, leave-one-out expectations, scaling, percentiles, mixtures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clipped, entropy, ratio


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(w * x) / sum(w) over rows where both are there and the weight is positive; null without such rows."""
    valid = value.isNotNull() & (weight > 0)
    return ratio(F.sum(F.when(valid, value * weight)), F.sum(F.when(valid, weight)))


def pooled(df: DataFrame, keys: Sequence[str], period: str, ends: Sequence[int], span: int, counts: Sequence[str]) -> DataFrame:
    """Sums of counts over windows of `span` periods that end at each of `ends`: keys, window_end, counts.

    Each row goes to the windows that hold it by an array of their ends, so the table is read and shuffled once.
    """
    own = F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: (F.col(period) <= e) & (F.col(period) > e - span))
    return df.withColumn("window_end", F.explode(own)).groupBy(*keys, "window_end").agg(*[F.sum(c).alias(c) for c in counts])


def per_exposure(df: DataFrame, counts: Mapping[str, str], exposure: str, per: float = 100.0) -> DataFrame:
    """Adds name = per * count / exposure for {name: count}."""
    return df.withColumns({name: per * ratio(F.col(c), F.col(exposure)) for name, c in counts.items()})


def shrunk(value: Column, exposure: Column, strength: float, center: Column) -> Column:
    """n / (n + k) * x + k / (n + k) * centre; the centre where x is missing."""
    n = F.coalesce(exposure, F.lit(0.0))
    return F.coalesce(n / (n + strength) * value + strength / (n + strength) * center, center)


def shrunk_rate(df: DataFrame, value: str, exposure: str, strength: float, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Adds the rate shrunk to the exposure-weighted mean of its group (all rows without `by`)."""
    group = df.groupBy(*by).agg(weighted_mean(F.col(value), F.col(exposure)).alias("_center"))
    return with_group(df, group, by).withColumn(name or f"{value}_shrunk", shrunk(F.col(value), F.col(exposure), strength, F.col("_center"))).drop("_center")


def shrunk_ratio(df: DataFrame, numerator: str, denominator: str, strength: float, by: Sequence[str], name: str) -> DataFrame:
    """Adds (num + k * centre) / (den + k), centre: the group's ratio of sums."""
    group = df.groupBy(*by).agg(ratio(F.sum(numerator), F.sum(denominator)).alias("_center"))
    value = (F.coalesce(F.col(numerator), F.lit(0.0)) + strength * F.col("_center")) / (F.coalesce(F.col(denominator), F.lit(0.0)) + strength)
    return with_group(df, group, by).withColumn(name, value).drop("_center")


def with_group(df: DataFrame, group: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with the columns of its group's row; pre-aggregation keeps a hot group from meeting in one task."""
    if by:
        return df.join(group, list(by), "left")
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(group.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")  # one row


def posterior(prior: Column, raw: Column, n: Column, strength: float) -> Column:
    """(strength * prior + n * raw) / (strength + n); the prior where there is nothing raw."""
    return F.coalesce((strength * prior + n * raw) / (strength + n), prior)


def leave_one_out(df: DataFrame, group: Sequence[str], value: str, exposure: str, name: str = "expected") -> DataFrame:
    """Adds the group's rate without the row itself, null if nothing else is there."""
    sums = df.groupBy(*group).agg(F.sum(value).alias("_v"), F.sum(exposure).alias("_e"))
    rate = ratio(F.col("_v") - F.coalesce(F.col(value), F.lit(0.0)), F.col("_e") - F.coalesce(F.col(exposure), F.lit(0.0)))
    return df.join(sums, list(group), "left").withColumn(name, rate).drop("_v", "_e")


def centered(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None, name: str | None = None) -> DataFrame:
    """Adds the value less its group's (weighted) mean."""
    mean = weighted_mean(F.col(value), F.col(weight)) if weight else F.avg(value)
    return with_group(df, df.groupBy(*by).agg(mean.alias("_m")), by).withColumn(name or f"{value}_centered", F.col(value) - F.col("_m")).drop("_m")


def weighted_zscore(df: DataFrame, by: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """Adds the exposure-weighted z-score; 0 where the group does not vary, null where the value is missing."""
    w = F.when(F.col(value).isNotNull() & (F.col(weight) > 0), F.col(weight))
    x = F.col(value)
    group = df.groupBy(*by).agg(ratio(F.sum(w * x), F.sum(w)).alias("_m"), ratio(F.sum(w * x * x), F.sum(w)).alias("_q"))
    spread = F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0)))
    z = F.when(F.col(value).isNull(), F.lit(None)).when(spread > 1e-12, (x - F.col("_m")) / spread).otherwise(0.0)
    return with_group(df, group, by).withColumn(name, z).drop("_m", "_q")


def running_counts(counts: DataFrame, by: Sequence[str], value: str, n: str = "_n", descending: bool = False, ranges: int = 64) -> DataFrame:
    """Adds _before: how many rows of the group come before a value, from one row a distinct value with its count.

    Within groups that is a window.  Without groups the values are cut into ranges at approximate quantiles (any cut gives the same
    result), so no task sorts all of them; only the ranges' sums meet in one.
    """
    at = F.desc(value) if descending else F.asc(value)
    if by:
        order = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("_before", F.coalesce(F.sum(n).over(order), F.lit(0)))
    edges = counts.agg(F.approx_percentile(value, [k / ranges for k in range(1, ranges)], 1000)).first()[0] or []
    rows = counts.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(value))) if edges else F.lit(0))
    ahead = Window.orderBy(F.desc("_range") if descending else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # at most `ranges` rows
    starts = rows.groupBy("_range").agg(F.sum(n).alias("_s")).select("_range", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_o"))
    order = Window.partitionBy("_range").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_before", F.coalesce(F.sum(n).over(order), F.lit(0))).join(F.broadcast(starts), "_range")
    return inside.withColumn("_before", F.col("_before") + F.col("_o")).drop("_range", "_o")


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """One row a group: the exact (linearly interpolated) quantile of each share, {name: share}; null without values.

    From running counts of distinct values: a sort that may spill, not a table of all values in memory.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    ranked = with_group(running_counts(counts, by, value), total, by)
    x = F.col(value).cast("double")
    at = lambda place: F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), x))
    spots = {name: (F.col("_all") - 1) * F.lit(float(q)) for name, q in shares.items()}
    ends = [f.alias(f"_{k}_{name}") for name, spot in spots.items() for k, f in (("lo", at(F.floor(spot))), ("hi", at(F.ceil(spot))), ("p", F.max(spot - F.floor(spot))))]
    return ranked.groupBy(*by).agg(*ends).select(*by, *[(F.col(f"_lo_{n}") + F.col(f"_p_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in shares])


def robust_scale(df: DataFrame, by: Sequence[str], columns: Sequence[str], limit: float = 5.0) -> DataFrame:
    """Fills missing values with the group's median, then (x - median) / IQR, standard deviation if the IQR is 0, clipped.

    Exact quantiles of each group, joined back.
    """
    out = with_group(df, df.groupBy(*by).agg(*[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]), by)
    for c in columns:
        out = with_group(out, quantiles(df, by, c, {f"_m_{c}": 0.5, f"_a_{c}": 0.25, f"_b_{c}": 0.75}), by)
    for c in columns:
        iqr = F.col(f"_b_{c}") - F.col(f"_a_{c}")
        scale = F.when(iqr > 1e-12, iqr).when(F.col(f"_s_{c}") > 1e-12, F.col(f"_s_{c}")).otherwise(1.0)
        out = out.withColumn(f"{c}_scaled", clipped((F.coalesce(F.col(c), F.col(f"_m_{c}")) - F.col(f"_m_{c}")) / scale, -limit, limit))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "mabs"])


def median_imputed(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Missing values from the group's median, then from that of all rows, then 0."""
    out = df
    for c in columns:
        out = with_group(out, quantiles(df, by, c, {f"_l_{c}": 0.5}), by)
        if by:
            out = with_group(out, quantiles(df, (), c, {f"_t_{c}": 0.5}), ())
        else:
            out = out.withColumn(f"_t_{c}", F.col(f"_l_{c}"))
    return out.withColumns({c: F.coalesce(c, f"_l_{c}", f"_t_{c}", F.lit(0.0)) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "lt"])


def average_rank_percentile(df: DataFrame, by: Sequence[str], value: str, name: str, ascending: bool = True) -> DataFrame:
    """Adds 100 * (average rank) / (number of values) within the group; null for missing values.

    Ranks come from the distinct values and their counts, so ties cost one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_peers"))
    ranked = with_group(running_counts(counts, by, value, "_peers", not ascending), counts.groupBy(*by).agg(F.sum("_peers").alias("_all")), by)
    share = ranked.select(*by, value, (100.0 * (F.col("_before") + (F.col("_peers") + 1) / 2) / F.col("_all")).alias(name))
    return df.join(share, [*by, value], "left")


def mix_entropy(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], weight: str) -> DataFrame:
    """One row a key: the share of each kind (0 if absent) and the entropy of the mix."""
    wide = df.groupBy(*keys).pivot(kind, list(kinds)).agg(F.sum(weight))
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{k}`"), F.lit(0.0)) for k in kinds])
    shares = wide.select(*keys, *[F.coalesce(ratio(F.coalesce(F.col(f"`{k}`"), F.lit(0.0)), total), F.lit(0.0)).alias(f"share_{i}") for i, k in enumerate(kinds)])
    return shares.withColumn("entropy", entropy([F.col(f"share_{i}") for i in range(len(kinds))]))


def expected_from_mix(df: DataFrame, keys: Sequence[str], league: Sequence[str], kind: str, attempts: str, points: str, least: float = 0.0) -> DataFrame:
    """Per key: attempts, points, what the league's rate of each kind would have given, and the difference.

    League rates come from rows of at least `least` attempts.
    """
    rates = df.where(F.col(attempts) >= least).groupBy(*league, kind).agg(ratio(F.sum(points), F.sum(attempts)).alias("_rate"))
    both = df.join(rates, [*league, kind], "left")
    expected = F.sum(F.col(attempts) * F.coalesce("_rate", F.lit(0.0)))
    return both.groupBy(*keys).agg(F.sum(attempts).alias("attempts"), F.sum(points).alias("points"), expected.alias("expected")).withColumn("over_expected", F.col("points") - F.col("expected"))


def era_profile(df: DataFrame, keys: Sequence[str], period: str, value: str, end: int, span: int = 3) -> DataFrame:
    """Per key over the span up to `end`: latest, trend (latest less earliest), population deviation, all relative to the period's mean."""
    era = df.groupBy(period).agg(F.avg(value).alias("_m"))
    own = df.where((F.col(period) <= end) & (F.col(period) > end - span)).join(era, period).withColumn("_r", F.col(value) - F.col("_m"))
    at = lambda p: F.max(F.when(F.col(period) == p, F.col("_r")))
    return own.groupBy(*keys).agg(at(end).alias("latest"), (at(end) - at(end - span + 1)).alias("trend"), F.stddev_pop("_r").alias("volatility"))


def standardized_mean(df: DataFrame, keys: Sequence[str], stratum: str, value: str, weight: str, reference: DataFrame, share: str) -> DataFrame:
    """Weighted means within strata, averaged by the reference mix renormalised to the strata a key has."""
    within = df.groupBy(*keys, stratum).agg(weighted_mean(F.col(value), F.col(weight)).alias("_m")).where("_m is not null")
    both = within.join(reference.select(stratum, share), stratum)
    return both.groupBy(*keys).agg(weighted_mean(F.col("_m"), F.col(share)).alias("standardized"))


def fit_scores(df: DataFrame, keys: Sequence[str], actual: str, predicted: str, weight: Column | None = None) -> DataFrame:
    """Per key: n, weighted RMSE and R2, mean absolute error, correlation (null without variance)."""
    w = F.lit(1.0) if weight is None else weight
    a, p = F.col(actual), F.col(predicted)
    rows = df.where(a.isNotNull() & p.isNotNull()).withColumn("_w", w)
    s = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("_w").alias("_sw"), F.sum(F.col("_w") * (a - p) ** 2).alias("_se"), F.sum(F.col("_w") * a).alias("_sa"), F.sum(F.col("_w") * a * a).alias("_saa"),
        F.avg(F.abs(a - p)).alias("mae"), F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(p) > 0), F.corr(a, p)).alias("correlation"),
    )
    spread = F.col("_saa") - F.col("_sa") * F.col("_sa") / F.col("_sw")
    return s.select(*keys, "n", F.sqrt(F.col("_se") / F.col("_sw")).alias("rmse"), F.when(spread > 0, 1 - F.col("_se") / spread).alias("r2"), "mae", "correlation")


def probability_scores(df: DataFrame, keys: Sequence[str], outcome: str, probability: str) -> DataFrame:
    """Per key: Brier score, log loss, accuracy and AUC (by average ranks of distinct probabilities)."""
    y, p = F.col(outcome).cast("double"), F.col(probability)
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    basic = df.groupBy(*keys).agg(F.avg((p - y) ** 2).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"), F.avg(((p >= 0.5).cast("double") == y).cast("double")).alias("accuracy"), F.sum(y).alias("_n1"), F.sum(1 - y).alias("_n0"))
    ties = df.groupBy(*keys, probability).agg(F.count("*").alias("_n"), F.sum(y).alias("_y"))
    ranks = running_counts(ties, keys, probability).withColumn("_r", F.col("_before") + (F.col("_n") + 1) / 2).groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_y")).alias("_s"))
    both = basic.join(ranks, list(keys)) if keys else with_group(basic, ranks, ())
    auc = ratio(F.col("_s") - F.col("_n1") * (F.col("_n1") + 1) / 2, F.col("_n1") * F.col("_n0"))
    return both.withColumn("auc", auc).drop("_n1", "_n0", "_s")


def spread_profile(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Unpivoted: by, metric, p10, median, p90, iqr."""
    long = df.unpivot(list(by), list(columns), "metric", "value")
    found = quantiles(long, [*by, "metric"], "value", {"p10": 0.1, "_q1": 0.25, "median": 0.5, "_q3": 0.75, "p90": 0.9})
    keys = long.select(*by, "metric").distinct()  # a metric without values stays, with nulls
    return with_group(keys, found, [*by, "metric"]).select(*by, "metric", "p10", "median", "p90", (F.col("_q3") - F.col("_q1")).alias("iqr"))


def line_by_group(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def spread_between(df: DataFrame, residual: str, variance: str, high: float, rounds: int = 4, grid: int = 24) -> float:
    """The between-entity variance that makes the residuals likeliest, given each one's own sampling variance.

    Every round evaluates a grid in one aggregation and narrows it around the best point.
    """
    low = 0.0
    for _ in range(rounds):
        points = [low + (high - low) * k / (grid - 1) for k in range(grid)]
        total = [F.sum(F.log(F.col(variance) + p + 1e-300) + F.col(residual) ** 2 / (F.col(variance) + p + 1e-300)).alias(f"l{k}") for k, p in enumerate(points)]
        likelihood = df.where(F.col(residual).isNotNull() & (F.col(variance) > 0)).agg(*total).first()
        if likelihood[0] is None:
            return 0.0
        best = min(range(grid), key=lambda k: likelihood[k])
        low, high = points[max(0, best - 1)], points[min(grid - 1, best + 1)]
    return points[best]


def tier_targets(df: DataFrame, by: Sequence[str], value: str, quantile: float = 0.25) -> DataFrame:
    """Per group: the mean of the values up to its quantile."""
    return df.join(quantiles(df, by, value, {"_q": quantile}), list(by)).groupBy(*by).agg(F.avg(F.when(F.col(value) <= F.col("_q"), F.col(value))).alias("target"))
