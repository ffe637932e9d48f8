"""Operators over ordered events: runs, forward fill, prefix sums, buckets, neighbours, durations.

Every function takes the key columns of a stream and a total order within it.  A stream is one game, user or entity; its
rows meet in one task, so a stream must be small against the table, as a game is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import differs, ratio


def _stream(keys: Sequence[str], order: Sequence[str], descending: bool = False):
    return Window.partitionBy(*keys).orderBy(*[F.desc(o) if descending else F.asc(o) for o in order])


def so_far(keys, order):
    return _stream(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(keys, order):
    return _stream(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def number_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], by: Sequence[str], name: str = "run") -> DataFrame:
    """Adds the number of the run a row belongs to; a run starts where any `by` column differs from the row before.

    A missing value differs from everything, also from another missing one.
    """
    step = _stream(keys, order)
    first = F.row_number().over(step) == 1
    starts = reduce(lambda a, b: a | b, [differs(F.col(c), F.lag(c).over(step)) for c in by])
    flagged = df.withColumn("_start", F.when(first | starts, 1).otherwise(0))
    return flagged.withColumn(name, F.sum("_start").over(so_far(keys, order))).drop("_start")


def collapse_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], by: Sequence[str], aggregates: Mapping[str, Column] = {}, ident: str | None = None) -> DataFrame:  # noqa: B006
    """One row a run: keys, run, by, n_rows, first and last ident (by the order), and the given aggregates."""
    ident = ident or order[-1]
    at = F.struct(*order)
    numbered = number_runs(df, keys, order, by)
    own = [F.min_by(c, at).alias(c) for c in by if c not in keys]
    named = [value.alias(name) for name, value in aggregates.items()]
    return numbered.groupBy(*keys, "run").agg(*own, F.count("*").alias("n_rows"), F.min_by(ident, at).alias(f"first_{ident}"), F.max_by(ident, at).alias(f"last_{ident}"), *named)


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], start: float | None = None) -> DataFrame:
    """Missing values take the last one before them in their stream; `start` fills what has none."""
    fill = lambda c: F.last(c, ignorenulls=True).over(so_far(keys, order))
    return df.withColumns({c: fill(c) if start is None else F.coalesce(fill(c), F.lit(start)) for c in columns})


def state_changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """Forward-fills a sparse running state and adds its value before, its change, corrections and the last-row flag."""
    filled = forward_fill(df, keys, order, [column], 0.0)
    step = _stream(keys, order)
    known = filled.withColumn(f"{column}_before", F.coalesce(F.lag(column).over(step), F.lit(0.0)))
    change = F.col(column) - F.col(f"{column}_before")
    return known.withColumns({f"{column}_change": change, f"{column}_corrected": change < 0, "is_last": F.row_number().over(_stream(keys, order, True)) == 1})


def trim_stale_tail(df: DataFrame, keys: Sequence[str], order: Sequence[str], final: Column, most: int = 5) -> DataFrame:
    """Drops rows after the last one that satisfies `final`, if they are at most `most`; streams without one stay."""
    numbered = df.withColumn("_n", F.row_number().over(_stream(keys, order))).withColumn("_hit", final)
    whole = Window.partitionBy(*keys)
    last = F.max(F.when(F.col("_hit"), F.col("_n"))).over(whole)
    size = F.count("*").over(whole)
    return numbered.withColumns({"_last": last, "_size": size}).where(F.col("_last").isNull() | (F.col("_size") - F.col("_last") > most) | (F.col("_n") <= F.col("_last"))).drop("_n", "_hit", "_last", "_size")


def prefix_context(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Adds number, what came before in all and last, and whether the row is the first: nothing of the row itself or later."""
    step = _stream(keys, order)
    return df.withColumns({
        "number": F.row_number().over(step),
        f"{value}_before": F.coalesce(F.sum(value).over(before(keys, order)), F.lit(0.0)),
        f"previous_{value}": F.coalesce(F.lag(value).over(step), F.lit(0.0)),
        "is_first": F.row_number().over(step) == 1,
    })


def conservation_gaps(df: DataFrame, keys: Sequence[str], value: str, totals: DataFrame, total: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose values don't add up to the stated total: keys, summed, total."""
    sums = df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("summed"))
    both = totals.select(*keys, total).join(sums, list(keys), "left")
    return both.where(F.abs(F.coalesce("summed", F.lit(0.0)) - F.col(total)) > tolerance)


def bucket_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """The last row of every bucket of a stream; aggregated map-side, so rows of a bucket need not meet."""
    at = F.struct(*order)
    rest = [c for c in df.columns if c not in keys]
    found = df.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.max_by(F.struct(*rest), at).alias("_row"))
    return found.select(*keys, "bucket", "_row.*")


def sampled_states(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Rows that open or close a stream or close a bucket."""
    per_bucket = Window.partitionBy(*keys, "_bucket").orderBy(*[F.desc(o) for o in order])
    marked = df.withColumn("_bucket", bucket).withColumns({"_b": F.row_number().over(per_bucket), "_f": F.row_number().over(_stream(keys, order)), "_l": F.row_number().over(_stream(keys, order, True))})
    return marked.where("_b = 1 or _f = 1 or _l = 1").drop("_bucket", "_b", "_f", "_l")


def nearest_row(df: DataFrame, keys: Sequence[str], distance: Column, ties: Sequence[str]) -> DataFrame:
    """The row of each key with the least distance."""
    rest = [c for c in df.columns if c not in keys]
    found = df.withColumn("distance", distance).groupBy(*keys).agg(F.min_by(F.struct(*rest, "distance"), F.struct("distance", *ties)).alias("_row"))
    return found.select(*keys, "_row.*")


def adjacent(df: DataFrame, keys: Sequence[str], period: str, columns: Sequence[str], step: int = 1, prefix: str = "next_") -> DataFrame:
    """Adds the columns of the same key's row `step` periods on, null if there is none just then."""
    window = _stream(keys, [period])
    shifted = (F.lead if step > 0 else F.lag)
    there = shifted(period, abs(step)).over(window) == F.col(period) + step
    return df.withColumns({f"{prefix}{c}": F.when(there, shifted(c, abs(step)).over(window)) for c in columns})


def duration_weights(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Column, end: Column, count: str) -> DataFrame:
    """Adds each row's share of its key's time, up to the next row's start or the key's end; of its count if no time passes."""
    step = _stream(keys, order)
    whole = Window.partitionBy(*keys)
    timed = df.withColumn("_d", F.greatest(F.coalesce(F.lead(start).over(step), end) - start, F.lit(0.0)))
    total, counted = F.sum("_d").over(whole), F.sum(count).over(whole)
    weight = F.when(total > 0, F.col("_d") / total).when(counted > 0, F.col(count) / counted).otherwise(1 / F.count("*").over(whole))
    return timed.withColumn("weight", weight).drop("_d")


def order_violations(df: DataFrame, keys: Sequence[str], order: Sequence[str], clock: str, number: str) -> DataFrame:
    """Per key: rows whose clock or number goes back, and repeated numbers."""
    step = _stream(keys, order)
    flagged = df.withColumns({"_c": F.col(clock) < F.lag(clock).over(step), "_n": F.col(number) < F.lag(number).over(step)})
    return flagged.groupBy(*keys).agg(F.count_if("_c").alias("clock_backwards"), F.count_if("_n").alias("number_backwards"), (F.count(number) - F.count_distinct(number)).alias("repeated_numbers"))


def trailing_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], rows: int) -> DataFrame:
    """Adds the mean of each column over the last `rows` rows, fewer at the start."""
    window = _stream(keys, order).rowsBetween(-(rows - 1), 0)
    return df.withColumns({f"{c}_mean{rows}": F.avg(c).over(window) for c in columns})


def trailing_range_mean(df: DataFrame, keys: Sequence[str], period: str, columns: Sequence[str], span: int) -> DataFrame:
    """Adds the mean over the last `span` periods by value, gaps included."""
    window = Window.partitionBy(*keys).orderBy(period).rangeBetween(-(span - 1), 0)
    return df.withColumns({f"{c}_span{span}": F.avg(c).over(window) for c in columns})


def rest_days(df: DataFrame, keys: Sequence[str], date: str, ties: Sequence[str], most: int = 7) -> DataFrame:
    """Adds days since the stream's row before (capped; the first row has the cap) and whether it was the day before."""
    gap = F.date_diff(F.col(date), F.lag(date).over(_stream(keys, [date, *ties])))
    return df.withColumns({"rest": F.least(F.coalesce(gap, F.lit(most)), F.lit(most)), "back_to_back": F.coalesce(gap == 1, F.lit(False))})


def share_of_progress(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Adds a row's number over the highest one of its key."""
    return df.withColumn("progress", ratio(F.col(number), F.max(number).over(Window.partitionBy(*keys))))


def without_decided(df: DataFrame, game: Sequence[str], period: str, order: Sequence[str], margin: Column, base: Mapping[int, int], slope: float = 8.0) -> DataFrame:
    """Rows played before the game is decided: the margin before the row is within base[period] + floor(slope * (1 - progress)).

    margin: what a row adds to the running margin.  The bound is judged on nine decimals, so that the order in which doubles are added does not decide a
    margin that lies just on it.
    """
    numbered = share_of_progress(df.withColumn("_n", F.row_number().over(_stream([*game, period], order))), [*game, period], "_n")
    running = F.coalesce(F.sum(margin).over(before(game, [period, *order])), F.lit(0.0))
    limit = reduce(lambda acc, kv: F.when(F.col(period) == kv[0], F.lit(kv[1])).otherwise(acc), base.items(), F.lit(min(base.values())))
    return numbered.withColumn("margin_before", running).where(F.abs(F.round("margin_before", 9)) <= limit + F.floor(slope * (1 - F.col("progress")))).drop("_n")
