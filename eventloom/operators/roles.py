"""Roles of entities by what they do: robust scaling within a period, sign-fixed principal axes, clusters in a fixed order, affinities, and gates on stability.

Nothing depends on a seed: clusters start from equal parts along each axis in turn, Lloyd's rounds run for all starts in one aggregation a round, and the start with the
least cost wins.  Axes have their largest loading positive and clusters are ordered by their centres, so a refit on the same rows gives the same names; two fits
on different rows are named alike by an optimal matching.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import ContractError
from .joins import shifted_self_join
from .models import adjusted_rand, stored
from .rates import quantiles, with_group


@dataclass(frozen=True)
class Gates:
    """What a role map must reach on the periods that it was not fitted on."""

    coverage: float = 0.90
    refit_rand: float = 0.90
    same_role: float = 0.50
    axis_cosine: float = 0.75
    least_share: float = 0.02
    most_share: float = 0.30


def scaled_within(df: DataFrame, period: str, numbers: Sequence[str], limit: float = 5.0) -> DataFrame:
    """Numbers less the period's median over its interquartile range, cut at +-limit; missing values are the median.

    Without a spread between the quartiles the standard deviation is taken, without that 1.
    """
    long = df.unpivot([period], list(numbers), "_m", "_v")
    middle = quantiles(long, [period, "_m"], "_v", {"_mid": 0.5})
    filled = with_group(long, middle, [period, "_m"]).withColumn("_v", F.coalesce("_v", "_mid", F.lit(0.0)))
    spread = quantiles(filled.select(period, "_m", "_v"), [period, "_m"], "_v", {"_lo": 0.25, "_hi": 0.75})
    deviation = filled.groupBy(period, "_m").agg(F.stddev_pop("_v").alias("_sd"), F.max(F.coalesce("_mid", F.lit(0.0))).alias("_mid"))
    scale = deviation.join(spread, [period, "_m"]).withColumn("_scale", F.when(F.col("_hi") - F.col("_lo") > 1e-9, F.col("_hi") - F.col("_lo")).when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0))
    wide = scale.groupBy(period).agg(*[F.max(F.when(F.col("_m") == c, F.col(x))).alias(f"_{x}_{c}") for c in numbers for x in ("_mid", "_scale")])  # one row a period
    both = df.join(F.broadcast(wide), period)
    value = lambda c: (F.coalesce(F.col(c), F.col(f"__mid_{c}")) - F.col(f"__mid_{c}")) / F.col(f"__scale_{c}")
    return both.withColumns({c: F.greatest(F.lit(-limit), F.least(F.lit(limit), value(c))) for c in numbers}).drop(*[f"_{x}_{c}" for c in numbers for x in ("_mid", "_scale")])


def principal_axes(df: DataFrame, numbers: Sequence[str], dims: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(means, axes as rows, share of the variance): the covariance comes from one aggregation; each axis has its largest loading positive."""
    pairs = [(i, j) for i in range(len(numbers)) for j in range(i + 1)]
    row = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(numbers)], *[F.covar_samp(numbers[i], numbers[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if not row["n"] or row["n"] < 2:
        raise ContractError("too few rows for principal axes")
    cov = np.zeros((len(numbers),) * 2)
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, np.argsort(-values, kind="stable")[:dims]].T
    axes *= np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return np.array([row[f"m{i}"] for i in range(len(numbers))]), axes, float(np.sort(values)[::-1][:dims].sum() / max(values.sum(), 1e-300))


def on_axes(numbers: Sequence[str], means: np.ndarray, axes: np.ndarray) -> list[Column]:
    return [sum(((F.col(c) - float(m)) * float(v) for c, m, v in zip(numbers, means, axis, strict=True)), F.lit(0.0)) for axis in axes]


def _distances(columns: Sequence[str], centers: np.ndarray) -> list[Column]:
    return [sum(((F.col(c) - float(v)) ** 2 for c, v in zip(columns, center, strict=True)), F.lit(0.0)) for center in centers]


def clusters_of(df: DataFrame, columns: Sequence[str], k: int, rounds: int = 40) -> tuple[np.ndarray, float]:
    """(centres ordered by their coordinates, mean squared distance) of the best of one start an axis; df is read once a round."""
    starts = []
    for c in columns:
        cuts = df.agg(*[F.percentile(c, q / k).alias(f"q{q}") for q in range(1, k)]).first() if k > 1 else []
        part = sum(((F.col(c) > F.lit(float(x))).cast("int") for x in cuts), F.lit(0))
        means = {r["_p"]: [r[f"m{i}"] for i in range(len(columns))] for r in df.groupBy(part.alias("_p")).agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(columns)]).collect()}
        if len(means) == k:
            starts.append(np.array([means[p] for p in sorted(means)]))
    if not starts:
        raise ContractError(f"no axis has {k} distinct parts")
    cost = [float("inf")] * len(starts)
    for _ in range(rounds):
        each = []
        for s, centers in enumerate(starts):
            distance = F.array(*_distances(columns, centers))
            each.append(F.struct(F.lit(s).alias("s"), (F.array_position(distance, F.array_min(distance)) - 1).cast("int").alias("c"), F.array_min(distance).alias("d")))
        found = df.select(*columns, F.explode(F.array(*each)).alias("_e")).groupBy("_e.s", "_e.c").agg(F.count("*").alias("n"), F.sum("_e.d").alias("d"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(columns)]).collect()  # k rows a start
        moved = 0.0
        for s, centers in enumerate(starts):
            own = [r for r in found if r["s"] == s]
            cost[s] = sum(r["d"] for r in own) / sum(r["n"] for r in own)
            new = centers.copy()
            for r in own:
                new[r["c"]] = np.round([r[f"m{i}"] for i in range(len(columns))], 12)
            moved, starts[s] = max(moved, float(np.abs(new - centers).max())), new
        if moved < 1e-9:
            break
    best = min(range(len(starts)), key=lambda s: (round(cost[s], 9), s))
    centers = starts[best]
    return centers[sorted(range(k), key=lambda r: tuple(np.round(centers[r], 9)))], cost[best]


class RoleMap:
    """Means, axes, centres and the softmax's temperature: all that is needed to name the roles of other rows."""

    def __init__(self, numbers: Sequence[str], period: str, means: np.ndarray, axes: np.ndarray, centers: np.ndarray, temperature: float, explained: float):
        self.numbers, self.period, self.means, self.axes, self.centers, self.temperature, self.explained = list(numbers), period, means, axes, centers, temperature, explained

    @classmethod
    def fit(cls, scaled: DataFrame, period: str, numbers: Sequence[str], development: Iterable, dims: int, k: int, least_rows: int = 20) -> RoleMap:
        """From rows of the development periods (see scaled_within); every one of these must have rows, and each cluster `least_rows` on average."""
        development = sorted(set(development))
        own = scaled.where(F.col(period).isin(development))
        there = {r[0]: r[1] for r in own.groupBy(period).count().collect()}  # one row a period
        if len(there) < len(development):
            raise ContractError(f"no rows in the development periods {sorted(set(development) - set(there))}")
        if sum(there.values()) < k * least_rows:
            raise ContractError("too few development rows for the clusters")
        means, axes, explained = principal_axes(own, numbers, dims)
        names = [f"axis_{i + 1}" for i in range(dims)]
        placed = own.select(*[c.alias(n) for c, n in zip(on_axes(numbers, means, axes), names, strict=True)])
        centers, _ = clusters_of(placed, names, k)
        nearest = F.array_min(F.array(*_distances(names, centers)))
        temperature = placed.agg(F.percentile(nearest, 0.5)).first()[0]
        return cls(numbers, period, means, axes, centers, max(float(temperature), 1e-6), explained)

    def assigned(self, scaled: DataFrame, keys: Sequence[str]) -> DataFrame:
        """keys, role, distance, confidence, axis_1.., affinity_0..: softmax of -distance^2 over twice the temperature."""
        names = [f"axis_{i + 1}" for i in range(len(self.axes))]
        placed = scaled.select(*keys, *[c.alias(n) for c, n in zip(on_axes(self.numbers, self.means, self.axes), names, strict=True)])
        rows = placed.withColumn("_d", F.array(*_distances(names, self.centers))).withColumn("_least", F.array_min("_d"))
        rows = rows.withColumn("_w", F.transform("_d", lambda d: F.exp(-(d - F.col("_least")) / (2 * self.temperature)))).withColumn("_sum", F.aggregate("_w", F.lit(0.0), lambda a, x: a + x))
        affinities = [(F.col("_w")[k] / F.col("_sum")).alias(f"affinity_{k}") for k in range(len(self.centers))]
        return rows.select(*keys, (F.array_position("_d", F.col("_least")) - 1).cast("int").alias("role"), F.sqrt("_least").alias("distance"), (1 / F.col("_sum")).alias("confidence"), *names, *affinities)

    def matched(self, other: RoleMap, scaled: DataFrame) -> dict[int, int]:
        """{role of the other map: role of this one} by the matching that agrees on most rows."""
        a = self.assigned(scaled.withColumn("_row", F.monotonically_increasing_id()), ["_row", *self.numbers])
        both = other.assigned(a.withColumnRenamed("role", "_a").select("_a", *self.numbers), ["_a"]).groupBy("_a", "role").count().collect()  # one row a pair of roles
        table = np.zeros((max(len(self.centers), len(other.centers)),) * 2)
        for r in both:
            table[r["role"], r["_a"]] = r["count"]
        return {b: a for b, a in enumerate(best_matching(table)) if b < len(other.centers)}


def best_matching(gain: np.ndarray) -> list[int]:
    """For each row of a square table its column in the assignment of greatest total gain, by shortest augmenting paths."""
    cost, n = gain.max() - gain if gain.size else gain, len(gain)
    row_price, column_price, owner = np.zeros(n), np.zeros(n + 1), np.full(n + 1, -1)
    for row in range(n):
        owner[n], at = row, n
        reach, came, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n + 1, dtype=bool)
        while owner[at] >= 0:
            done[at] = True
            i = owner[at]
            slack = cost[i] - row_price[i] - column_price[:n]
            better = ~done[:n] & (slack < reach)
            reach[better], came[better] = slack[better], at
            step = np.where(done[:n], np.inf, reach)
            nxt = int(step.argmin())
            delta = step[nxt]
            for c in np.flatnonzero(done):
                row_price[owner[c]] += delta
                column_price[c] -= delta
            reach[~done[:n]] -= delta
            at = nxt
        while at != n:
            owner[at], at = owner[came[at]], came[at]
    out = [0] * n
    for c in range(n):
        out[owner[c]] = c
    return out


def role_report(panel: DataFrame, entity: str, period: str, numbers: Sequence[str], development: Sequence, dims: int, k: int, path: str, *, least_filled: float = 0.8, gates: Gates = Gates(), parts: int = 3) -> tuple[RoleMap, DataFrame, dict]:
    """(map, assignments of all eligible rows, measures with the gates that they pass).

    Eligible rows have at least `least_filled` of the numbers; scaled, they are written below `path`, as every round of clustering reads them.  Stability is measured on later periods: the adjusted Rand index against refits that
    leave out one of `parts` hash parts of the development rows, the share of entities that keep their role from one period to the next, the median cosine of their axes,
    and the least and greatest share of a role.
    """
    filled = sum((F.col(c).isNotNull().cast("double") for c in numbers), F.lit(0.0)) / len(numbers)
    marked = panel.withColumn("_filled", filled)
    eligible = marked.where(F.col("_filled") >= least_filled - 1e-12).drop("_filled")
    scaled = scaled_within(eligible.select(entity, period, *[F.col(c).cast("double").alias(c) for c in numbers]), period, numbers)
    scaled = stored(scaled, path, "scaled")
    keys, names = [entity, period], [f"axis_{i + 1}" for i in range(dims)]
    found = RoleMap.fit(scaled, period, numbers, development, dims, k)
    assigned = found.assigned(scaled, keys)
    later = scaled.where(~F.col(period).isin(list(development)))
    hashed = F.pmod(F.xxhash64(entity), F.lit(parts))
    rand = []
    for p in range(parts):
        other = RoleMap.fit(scaled.where(hashed != p), period, numbers, development, dims, k, least_rows=1)
        both = found.assigned(later, keys).select(*keys, F.col("role").alias("_a")).join(other.assigned(later, keys).select(*keys, F.col("role").alias("_b")), keys)
        rand.append(adjusted_rand(both, "_a", "_b"))
    pairs = shifted_self_join(assigned.select(*keys, "role", *names), [entity], period, ["role", *names]).where(~(F.col(period) + 1).isin(list(development)))
    dot = lambda a, b: sum((F.col(x) * F.col(y) for x, y in zip(a, b, strict=True)), F.lit(0.0))
    ahead = [f"next_{n}" for n in names]
    cosine = F.coalesce(F.try_divide(dot(names, ahead), F.sqrt(dot(names, names) * dot(ahead, ahead))), F.lit(0.0))
    moves = pairs.agg(F.count("*").alias("n"), F.avg((F.col("role") == F.col("next_role")).cast("double")).alias("same"), F.percentile(cosine, 0.5).alias("cosine")).first()
    shares = {r["role"]: r["count"] for r in assigned.where(~F.col(period).isin(list(development))).groupBy("role").count().collect()}
    total = sum(shares.values()) or 1
    coverage = marked.agg(F.avg((F.col("_filled") >= least_filled - 1e-12).cast("double"))).first()[0] or 0.0
    share = [shares.get(r, 0) / total for r in range(k)]
    measures = {"coverage": coverage, "refit_rand": sorted(rand)[len(rand) // 2], "same_role": moves["same"] or 0.0, "axis_cosine": moves["cosine"] or 0.0, "least_share": min(share), "most_share": max(share), "pairs": moves["n"], "explained": found.explained}
    passed = {g: measures[g] <= gates.most_share if g == "most_share" else measures[g] >= getattr(gates, g) for g in ("coverage", "refit_rand", "same_role", "axis_cosine", "least_share", "most_share")}
    return found, assigned, {**measures, "gates": passed, "passed": all(passed.values())}


def released(assigned: DataFrame, measures: dict) -> DataFrame:
    """The assignments if every gate is passed, else an error that names those that are not."""
    if not measures["passed"]:
        raise ContractError(f"roles are not stable enough: {sorted(g for g, ok in measures['gates'].items() if not ok)}")
    return assigned
