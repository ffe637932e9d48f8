"""Sparse block ridge by additive normal equations.

A design is a long table (row, col, val).  Spark forms X'WX from the pairs within a row, which has as many entries as
a lineup has members, and a sum by (i, j) that is pre-aggregated in every task.  The system has one unknown a player, so
its matrix, checked against MOST_COLUMNS, is solved on the driver; packed.py has the form for more.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import ContractError
from ..functions.scalars import ratio
from .rates import weighted_mean, with_group
from .resample import poisson_weight, unit

MOST_COLUMNS = 8_000


def lineup_design(df: DataFrame, row: str, blocks: Mapping[str, Column], home: Column | None = None, numbers: Mapping[str, Column] | None = None) -> DataFrame:
    """(row, block, entity, val): 1 for each member of a block's array; home and other numbers (a running margin, rest, a playoff flag), if given, are blocks of their own."""
    parts = [_members(name, members) for name, members in blocks.items()]
    for name, value in {**({} if home is None else {"home": home}), **(numbers or {})}.items():
        parts.append(F.array(F.struct(F.lit(name).alias("block"), F.lit(name).alias("entity"), value.cast("double").alias("val"))))
    return df.select(row, F.explode(F.concat(*parts)).alias("_e")).select(row, "_e.*").where("val <> 0 and entity is not null")


def _members(name: str, members: Column) -> Column:
    return F.transform(members, lambda e: F.struct(F.lit(name).alias("block"), e.cast("string").alias("entity"), F.lit(1.0).alias("val")))


def columns_of(design: DataFrame) -> list[tuple[str, str]]:
    """The coefficients' (block, entity) in a fixed order: names only, a row a coefficient."""
    found = design.select("block", "entity").distinct().toArrow().sort_by([("block", "ascending"), ("entity", "ascending")])
    return list(zip(found["block"].to_pylist(), found["entity"].to_pylist(), strict=True))


def number_table(spark: SparkSession, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """(block, entity, i), a row a coefficient."""
    blocks, entities = zip(*columns, strict=True) if columns else ((), ())
    return F.broadcast(spark.createDataFrame(pa.table({"block": pa.array(blocks, pa.string()), "entity": pa.array(entities, pa.string()), "i": pa.array(range(len(columns)), pa.int32())})))


def pair_sums(entries: DataFrame, row: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, i, j, x), j up to i: sums of v * u over the pairs of a row's entries (row, groups, i, u, v).

    A row's entries are sorted by number and each meets those up to it; two entries of one number meet both ways.
    """
    members = entries.groupBy(row, *groups).agg(F.sort_array(F.collect_list(F.struct("i", "u", "v"))).alias("m"))
    first = members.select(*groups, "m", F.posexplode("m").alias("_k", "_a"))
    both = first.select(*groups, "_k", "_a", F.posexplode(F.slice("m", F.lit(1), F.col("_k") + 1)).alias("_l", "_b"))
    a, b = F.col("_a"), F.col("_b")
    twice = F.when(a["i"].eqNullSafe(b["i"]) & (F.col("_k") != F.col("_l")), b["v"] * a["u"]).otherwise(0.0)
    return both.select(*groups, a["i"].alias("i"), b["i"].alias("j"), (a["v"] * b["u"] + twice).alias("x")).groupBy(*groups, "i", "j").agg(F.sum("x").alias("x"))


def _numbered_entries(design: DataFrame, columns: Sequence[tuple[str, str]], *keys: str) -> DataFrame:
    """(keys, i, u, v): the design's entries with their coefficient's number, null for an unknown one."""
    weight = F.col("weight") if "weight" in design.columns else F.lit(1.0)
    return design.join(number_table(design.sparkSession, columns), ["block", "entity"], "left").select(*keys, "i", F.col("val").alias("u"), (F.col("val") * weight).alias("v"))


def gram_entries(design: DataFrame, row: str) -> DataFrame:
    """(block_i, entity_i, block_j, entity_j, value) of X'X, lower triangle by (block, entity); `weight` counts if there.

    Pairs are summed by the coefficients' numbers, in the order of their names; the names are joined to the sums.
    """
    columns = columns_of(design)
    names = number_table(design.sparkSession, columns)
    sums = pair_sums(_numbered_entries(design, columns, row), row).withColumnRenamed("x", "value")
    for x in "ij":
        sums = sums.join(F.broadcast(names.toDF(f"block_{x}", f"entity_{x}", x)), x)
    return sums.select("block_i", "entity_i", "block_j", "entity_j", "value")


def moments(design: DataFrame, response: DataFrame, row: str, y: str) -> DataFrame:
    """(block, entity, xy, exposure): X'Wy and X'W1; response has row, y and maybe weight."""
    both = design.join(response, row)
    weight = F.col("weight") if "weight" in response.columns else F.lit(1.0)
    return both.groupBy("block", "entity").agg(F.sum(F.col("val") * weight * F.col(y)).alias("xy"), F.sum(F.col("val") * weight).alias("exposure"))


class NormalEquations:
    """X'WX, X'Wy, X'W1 and the response's sums; they add up over disjoint rows, so folds are differences."""

    def __init__(self, columns, gram, xy, exposure, n, y_sum, yy):
        self.columns, self.gram, self.xy, self.exposure, self.n, self.y_sum, self.yy = columns, gram, xy, exposure, n, y_sum, yy

    @classmethod
    def of(cls, design: DataFrame, response: DataFrame, row: str, y: str, columns: Sequence | None = None) -> NormalEquations:
        columns = list(columns or columns_of(design))
        if len(columns) > MOST_COLUMNS:
            raise ContractError(f"more than {MOST_COLUMNS} coefficients; packed.equations takes any number")
        at = {c: k for k, c in enumerate(columns)}
        weighted = "weight" in response.columns
        used = design.join(response.select(row, *(["weight"] if weighted else [])), row)
        p = len(columns)
        gram, xy, exposure = np.zeros((p, p)), np.zeros(p), np.zeros(p)
        found = pair_sums(_numbered_entries(used, columns, row), row).toArrow()  # at most MOST_COLUMNS^2 / 2 sums of 16 bytes, fewer as it is sparse
        if found["i"].null_count or found["j"].null_count:
            raise ContractError("the design has a column that is not among the coefficients")
        i, j, v = (found[c].to_numpy() for c in ("i", "j", "x"))
        gram[i, j] = gram[j, i] = v
        for b, e, v, x in moments(design, response, row, y).collect():
            xy[at[b, e]], exposure[at[b, e]] = v, x
        w = F.col("weight") if weighted else F.lit(1.0)
        n, y_sum, yy = response.agg(F.sum(w), F.sum(w * F.col(y)), F.sum(w * F.col(y) * F.col(y))).first()
        return cls(columns, gram, xy, exposure, n or 0.0, y_sum or 0.0, yy or 0.0)

    def __sub__(self, other: NormalEquations) -> NormalEquations:
        return NormalEquations(self.columns, self.gram - other.gram, self.xy - other.xy, self.exposure - other.exposure, self.n - other.n, self.y_sum - other.y_sum, self.yy - other.yy)

    def __add__(self, other: NormalEquations) -> NormalEquations:
        return NormalEquations(self.columns, self.gram + other.gram, self.xy + other.xy, self.exposure + other.exposure, self.n + other.n, self.y_sum + other.y_sum, self.yy + other.yy)

    def penalty(self, penalties: Mapping[str, float] | np.ndarray) -> np.ndarray:
        """The penalty of each coefficient, from one a block or one a coefficient (such as error variance over prior variance)."""
        return penalties if isinstance(penalties, np.ndarray) else np.array([penalties[b] for b, _ in self.columns])

    def with_prior(self, penalties: Mapping[str, float] | np.ndarray, prior: np.ndarray, mode: str, strength: float = 1.0, confidence: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """(coefficients, intercept) with a prior used in one of four ways.

        zero: not at all.  target: the penalty pulls towards strength * prior.  offset: what strength * prior predicts is taken off the response, the
        rest is fitted towards zero and the prior is added back.  dummy: each coefficient has a pseudo-row of its prior, which counts as `confidence`
        rows (a number a coefficient) beside the penalty towards zero.
        """
        if mode == "zero":
            return self.solve(penalties)
        if mode == "target":
            return self.solve(penalties, prior, strength)
        d, own = self.penalty(penalties), strength * prior
        if mode == "offset":
            rest = self.y_sum - self.exposure @ own
            mean = rest / self.n if self.n else 0.0
            return own + np.linalg.solve(self.gram + np.diag(d), self.xy - self.gram @ own - mean * self.exposure), mean
        if mode == "dummy" and confidence is not None:
            mean = self.y_sum / self.n if self.n else 0.0
            return np.linalg.solve(self.gram + np.diag(d + confidence), self.xy - mean * self.exposure + confidence * own), mean
        raise ContractError(f"no prior mode {mode!r}, or no confidence")

    def prior_center(self, priors: Mapping[tuple[str, str], float], blocks: Sequence[str], per: float = 100.0, test_exposure: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
        """(prior coefficients, coverage): ratings per `per` rows become coefficients, and each block's exposure-weighted mean is taken off.

        Entities without a rating stay at 0, the mean.  coverage: the share of each block's exposure (and of a test set's) that has a rating.
        """
        center, coverage = np.zeros(len(self.columns)), {}
        has = np.array([c in priors for c in self.columns])
        for block in blocks:
            own = np.array([b == block for b, _ in self.columns])
            rated = own & has
            values = np.array([priors[c] / per for c, r in zip(self.columns, rated, strict=True) if r])
            if self.exposure[rated].sum() > 0:
                values = values - np.average(values, weights=self.exposure[rated])
            center[rated] = values
            coverage[block] = float(self.exposure[rated].sum() / self.exposure[own].sum()) if self.exposure[own].sum() else 0.0
            if test_exposure is not None:
                coverage[f"{block}_test"] = float(test_exposure[rated].sum() / test_exposure[own].sum()) if test_exposure[own].sum() else 0.0
        return center, coverage

    def solve(self, penalties: Mapping[str, float], center: np.ndarray | None = None, scale: float = 1.0) -> tuple[np.ndarray, float]:
        """(coefficients, intercept) of ridge towards scale * center, on the response less its mean."""
        d = self.penalty(penalties)
        mean = self.y_sum / self.n if self.n else 0.0
        right = self.xy - mean * self.exposure + (0.0 if center is None else scale * d * center)
        return np.linalg.solve(self.gram + np.diag(d), right), mean

    def solutions(self, candidates: Sequence[Mapping[str, float]]) -> list[tuple[np.ndarray, float]]:
        """What solve gives for each set of penalties."""
        return [self.solve(c) for c in candidates]

    def residual(self, beta: np.ndarray, penalties: Mapping[str, float], center: np.ndarray | None = None) -> float:
        """The largest entry of the normal equations' residual."""
        d = self.penalty(penalties)
        right = self.xy - self.y_sum / self.n * self.exposure + (0.0 if center is None else d * center)
        return float(np.abs((self.gram + np.diag(d)) @ beta - right).max())

    def recentered(self, beta: np.ndarray, intercept: float, blocks: Sequence[str], size: int = 5) -> tuple[np.ndarray, float]:
        """Each block's exposure-weighted mean becomes zero; the intercept takes `size` times it."""
        beta = beta.copy()
        for block in blocks:
            own = np.array([b == block for b, _ in self.columns])
            if self.exposure[own].sum() > 0:
                mean = float(np.average(beta[own], weights=self.exposure[own]))
                beta[own] -= mean
                intercept += size * mean
        return beta, intercept

    def standard_errors(self, beta: np.ndarray, intercept: float, penalties: Mapping[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """(standard errors, covariance) of ridge with independent errors: sigma^2 (G + D)^-1 G (G + D)^-1."""
        inverse = np.linalg.inv(self.gram + np.diag(self.penalty(penalties)))
        hat = inverse @ self.gram
        freedom = max(self.n - np.trace(hat) - 1, 1.0)
        covariance = self.squared_error(beta, intercept) / freedom * hat @ inverse
        return np.sqrt(np.clip(np.diag(covariance), 0, None)), covariance

    def condition(self, penalties: Mapping[str, float]) -> float:
        return float(np.linalg.cond(self.gram + np.diag(self.penalty(penalties))))

    def generalized_error(self, penalties: Mapping[str, float]) -> float:
        """Generalised cross-validation: n * squared error / (n - trace of the hat matrix)^2."""
        beta, mean = self.solve(penalties)
        trace = np.trace(np.linalg.solve(self.gram + np.diag(self.penalty(penalties)), self.gram))
        return self.n * self.squared_error(beta, mean) / max(self.n - trace - 1, 1.0) ** 2

    def squared_error(self, beta: np.ndarray, intercept: float) -> float:
        """Sum of squared errors on these rows, from the sums alone."""
        fit = beta @ self.gram @ beta + 2 * intercept * (beta @ self.exposure) + intercept**2 * self.n
        return float(self.yy - 2 * (beta @ self.xy + intercept * self.y_sum) + fit)


def cross_validated(folds: Sequence[NormalEquations], candidates: Sequence[Mapping[str, float]]) -> list[tuple[Mapping[str, float], float]]:
    """(penalties, held-out mean squared error) of every candidate, best first; each training set is the total less a fold."""
    total = folds[0]
    for f in folds[1:]:
        total = total + f
    out = []
    for c in candidates:
        error = sum(f.squared_error(*(total - f).solve(c)) for f in folds)
        out.append((c, error / total.n))
    return sorted(out, key=lambda x: (x[1], -sum(x[0].values())))


def coordinate_search(folds: Sequence[NormalEquations], start: Mapping[str, float], factor: float = 4.0, least: float = 1.1) -> tuple[dict[str, float], float]:
    """(penalties, held-out error) by log-step coordinate search: each block's penalty is multiplied or divided by `factor`
    as long as that lowers the error; when no block moves, the factor's root is tried, down to `least`.

    Works on the folds' sums alone, so no step reads the rows again.  Ties keep the larger penalty.
    """
    now, error = dict(start), cross_validated(folds, [start])[0][1]
    while factor >= least:
        moved = False
        for block in now:
            best, found = cross_validated(folds, [now | {block: now[block] * factor}, now | {block: now[block] / factor}])[0]
            if found < error - 1e-12 * abs(error):
                now, error, moved = dict(best), found, True
        if not moved:
            factor **= 0.5
    return now, error


def grouped_equations(design: DataFrame, response: DataFrame, row: str, y: str, group: str, columns: Sequence | None = None) -> dict:
    """{group: NormalEquations} of every season, fold or game of response's column `group`, from one pass over the rows.

    The sums are additive, so any window, fold complement or bootstrap draw is a (weighted) sum of them.  The number of
    groups times the entries of a Gram matrix is what reaches the driver: for seasons and folds, not for games.
    """
    columns = list(columns or columns_of(design))
    if len(columns) > MOST_COLUMNS:
        raise ContractError(f"more than {MOST_COLUMNS} coefficients; packed.SeasonSums takes any number")
    at, p = {c: k for k, c in enumerate(columns)}, len(columns)
    weighted = "weight" in response.columns
    w = F.col("weight") if weighted else F.lit(1.0)
    used = design.join(response.select(row, group, y, *(["weight"] if weighted else [])), row)
    grams = pair_sums(_numbered_entries(used, columns, row, group), row, [group])
    sides = used.groupBy(group, "block", "entity").agg(F.sum(F.col("val") * w * F.col(y)).alias("xy"), F.sum(F.col("val") * w).alias("exposure"))
    totals = response.groupBy(group).agg(F.sum(w).alias("n"), F.sum(w * F.col(y)).alias("y"), F.sum(w * F.col(y) * F.col(y)).alias("yy"))
    out = {r[group]: NormalEquations(columns, np.zeros((p, p)), np.zeros(p), np.zeros(p), r["n"] or 0.0, r["y"] or 0.0, r["yy"] or 0.0) for r in totals.collect()}
    for g, i, j, v in grams.select(group, "i", "j", "x").collect():
        out[g].gram[i, j] = out[g].gram[j, i] = v
    for g, b, e, v, x in sides.collect():
        out[g].xy[at[b, e]], out[g].exposure[at[b, e]] = v, x
    return out


def rolling_fits(by_season: Mapping[int, NormalEquations], span: int, penalties: Mapping[str, float]) -> dict[int, tuple[np.ndarray, float]]:
    """{last season: (coefficients, intercept)} of every window of `span` seasons that are all there."""
    out = {}
    for end in sorted(by_season):
        own = [by_season.get(end - k) for k in range(span)]
        if all(own):
            out[end] = reduce(lambda a, b: a + b, own).solve(penalties)
    return out


def bootstrap_fits(spark, design: DataFrame, response: DataFrame, row: str, y: str, cluster: str, draws: Sequence[int], penalties: Mapping[str, float], seed: int, path: str) -> DataFrame:
    """(draw, block, entity, beta) of refits on reweighted clusters, written draw by draw to `path`: a rerun computes only those missing.

    response has row, cluster and y.  A draw's weights follow a hash of (seed, draw, cluster), so they need no state.
    """
    columns = columns_of(design)
    for d in draws:
        target = f"{path}/draw={d}"
        try:
            spark.read.parquet(target).limit(1).count()
            continue
        except AnalysisException:
            pass
        drawn = response.withColumn("weight", poisson_weight(unit(F.lit(seed), F.lit(d), F.col(cluster))).cast("double"))
        found = NormalEquations.of(design, drawn, row, y, columns)
        beta, _ = found.solve(penalties)
        coefficients(spark, columns, beta).write.mode("overwrite").parquet(target)
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/draw={d}").withColumn("draw", F.lit(d)) for d in draws])


def half_stability(first: NormalEquations, second: NormalEquations, penalties: Mapping[str, float]) -> dict[str, float]:
    """{block: correlation} of the coefficients of two halves of the rows, over entities that both halves have."""
    a, b = first.solve(penalties)[0], second.solve(penalties)[0]
    both = (first.exposure > 0) & (second.exposure > 0)
    out = {}
    for block in dict.fromkeys(b for b, _ in first.columns):
        own = both & np.array([c == block for c, _ in first.columns])
        varies = own.sum() > 1 and a[own].std() > 0 and b[own].std() > 0
        out[block] = float(np.corrcoef(a[own], b[own])[0, 1]) if varies else float("nan")
    return out


def coefficients(spark, columns: Sequence[tuple[str, str]], beta: np.ndarray) -> DataFrame:
    blocks, entities = zip(*columns, strict=True) if columns else ((), ())
    return spark.createDataFrame(pa.table({"block": pa.array(blocks, pa.string()), "entity": pa.array(entities, pa.string()), "beta": pa.array(np.asarray(beta, float))}))


def predicted(design: DataFrame, beta: DataFrame, row: str, intercept: float) -> DataFrame:
    """(row, predicted, unknown): the sum of the coefficients, and how many entries have none.

    The coefficients are sent to every task: dealt by coefficient, all rows that a frequent one is in would meet in one task.
    """
    both = design.join(F.broadcast(beta), ["block", "entity"], "left")
    return both.groupBy(row).agg((F.sum(F.col("val") * F.coalesce("beta", F.lit(0.0))) + intercept).alias("predicted"), F.count_if(F.col("beta").isNull()).alias("unknown"))


def ratings(beta: DataFrame, exposure: DataFrame, plus: str, minus: str, per: float = 100.0) -> DataFrame:
    """One row an entity: offense, defense (its sign turned, as allowed points count against it), net, exposures."""
    both = beta.join(exposure, ["block", "entity"], "left")
    side = lambda b, c: F.max(F.when(F.col("block") == b, F.col(c)))
    out = both.where(F.col("block").isin(plus, minus)).groupBy("entity").agg((per * side(plus, "beta")).alias("offense"), (-per * side(minus, "beta")).alias("defense"), side(plus, "exposure").alias("exposure_for"), side(minus, "exposure").alias("exposure_against"))
    return out.withColumn("net", F.coalesce("offense", F.lit(0.0)) + F.coalesce("defense", F.lit(0.0)))


def cluster_scores(design: DataFrame, residuals: DataFrame, row: str, cluster: str, residual: str) -> DataFrame:
    """(cluster, block, entity, score): sums of x * residual, the meat of a cluster-robust covariance."""
    return design.join(residuals, row).groupBy(cluster, "block", "entity").agg(F.sum(F.col("val") * F.col(residual)).alias("score"))


def sandwich(equations: NormalEquations, penalties: Mapping[str, float], scores: DataFrame, cluster: str) -> np.ndarray:
    """Cluster-robust covariance; the meat is summed by Spark over clusters, as the Gram matrix is over rows."""
    at = {c: k for k, c in enumerate(equations.columns)}
    meat = np.zeros_like(equations.gram)
    for bi, ei, bj, ej, v in gram_entries(scores.withColumnRenamed("score", "val"), cluster).collect():
        i, j = at[bi, ei], at[bj, ej]
        meat[i, j] = meat[j, i] = v
    bread = np.linalg.inv(equations.gram + np.diag(equations.penalty(penalties)))
    return bread @ meat @ bread


def two_parameters(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares of y on 1 and x from centred sums: products of raw sums overflow 64 bits and cancel in doubles once there are many rows."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"))


def smoothing_rows(seasons: DataFrame, entity: str, season: str, expected: Column, weight: float) -> DataFrame:
    """Pseudo-rows that pull an entity's coefficients of consecutive seasons towards an expected change.

    (row, entity, season, val, y, weight): +1 on the later season, -1 on the earlier one, y = expected.
    """
    later = seasons.select(entity, (F.col(season) - 1).alias(season), expected.alias("y"))
    pairs = seasons.select(entity, season).join(later, [entity, season])
    key = F.concat_ws(":", F.lit("smooth"), F.col(entity).cast("string"), F.col(season).cast("string"))
    rows = F.array(F.struct((F.col(season) + 1).alias("season"), F.lit(1.0).alias("val")), F.struct(F.col(season).alias("season"), F.lit(-1.0).alias("val")))
    return pairs.select(key.alias("row"), entity, "y", F.lit(weight).alias("weight"), F.explode(rows).alias("_r")).select("row", entity, "_r.season", "_r.val", "y", "weight")


def prior_rows(priors: DataFrame, confidence: Column) -> DataFrame:
    """One pseudo-row a coefficient (block, entity, prior): row, block, entity, val, y, weight."""
    return priors.select(F.concat_ws(":", F.lit("prior"), "block", "entity").alias("row"), "block", "entity", F.lit(1.0).alias("val"), F.col("prior").alias("y"), confidence.alias("weight"))


def age_curve(deltas: DataFrame, age: str, delta: str, weight: str) -> DataFrame:
    """(age, mean change, curve): weighted mean change by age and its running sum."""
    by_age = deltas.groupBy(age).agg(weighted_mean(F.col(delta), F.col(weight)).alias("change"))
    return by_age.withColumn("curve", F.sum("change").over(Window.orderBy(age).rowsBetween(Window.unboundedPreceding, Window.currentRow)))  # one row an age


def smoothed_age_curve(deltas: DataFrame, age: str, delta: str, weight: str, *, width: float = 2.0, reference: float | None = None) -> DataFrame:
    """(age, weight, change, smooth, curve): the weighted mean change by age, a local-linear fit of it, and the fit's running sum.

    The fit at an age is a weighted line over all ages, with weight * exp(-(distance / width)^2 / 2); where all weight lies on
    one age, its mean.  With a reference age the curve is 0 there.  Works on one row an age, so the ages' table meets itself.
    """
    w = F.when(F.col(delta).isNotNull() & (F.col(weight) > 0), F.col(weight))
    by_age = deltas.groupBy(age).agg(F.sum(w).alias("weight"), ratio(F.sum(w * F.col(delta)), F.sum(w)).alias("change")).where("weight > 0")
    one = by_age.agg(F.collect_list(F.struct(F.col(age).cast("double").alias("a"), F.col("weight").alias("w"), F.col("change").alias("x"))).alias("all"))  # one entry an age
    rows = with_group(by_age, one, ())
    k = lambda r: r["w"] * F.exp(-0.5 * ((r["a"] - F.col(age)) / width) ** 2)
    moment = lambda f: F.aggregate("all", F.lit(0.0), lambda acc, r: acc + k(r) * f(r))
    d = lambda r: r["a"] - F.col(age)
    rows = rows.withColumns({"_s0": moment(lambda r: F.lit(1.0)), "_s1": moment(d), "_s2": moment(lambda r: d(r) * d(r)), "_t0": moment(lambda r: r["x"]), "_t1": moment(lambda r: d(r) * r["x"])})
    base = F.col("_s0") * F.col("_s2") - F.col("_s1") * F.col("_s1")
    rows = rows.withColumn("smooth", F.when(base > 1e-12, (F.col("_s2") * F.col("_t0") - F.col("_s1") * F.col("_t1")) / base).otherwise(F.col("_t0") / F.col("_s0")))
    rows = rows.withColumn("curve", F.sum("smooth").over(Window.orderBy(age).rowsBetween(Window.unboundedPreceding, Window.currentRow)))  # one row an age
    if reference is not None:
        rows = with_group(rows, rows.agg(F.min_by("curve", F.abs(F.col(age) - reference)).alias("_r")), ()).withColumn("curve", F.col("curve") - F.col("_r"))
    return rows.select(age, "weight", "change", "smooth", "curve")


def at_reference_age(df: DataFrame, curve: DataFrame, age: str, value: str, name: str) -> DataFrame:
    """Adds the value less the curve at its age; ages beyond the curve take its nearest end."""
    ends = curve.agg(F.min(age).alias("_lo"), F.max(age).alias("_hi"))
    rows = with_group(df, ends, ()).withColumn("_age", F.greatest(F.least(F.col(age), F.col("_hi")), F.col("_lo")))
    return rows.join(F.broadcast(curve.select(F.col(age).alias("_age"), F.col("curve").alias("_c"))), "_age", "left").withColumn(name, F.col(value) - F.col("_c")).drop("_age", "_lo", "_hi", "_c")  # one row an age


def with_exits(df: DataFrame, keys: Sequence[str], period: str, value: str, weight: str, last: int, drop: float, share: float) -> DataFrame:
    """Changes to the next period (keys, period, delta, weight, is_exit): real ones, and for keys without a next one a fall of `drop` at a low weight.

    Rows of the last period have no next one to judge and leave no exit.  weight: the lesser of both periods, or share * own.
    """
    from .joins import shifted_self_join

    pairs = shifted_self_join(df.select(*keys, period, value, weight), keys, period, [value, weight])
    real = pairs.select(*keys, period, (F.col(f"next_{value}") - F.col(value)).alias("delta"), F.least(weight, f"next_{weight}").alias("weight"), F.lit(False).alias("is_exit"))
    gone = df.where(F.col(period) < last).join(pairs.select(*keys, period), [*keys, period], "left_anti")
    return real.unionByName(gone.select(*keys, period, F.lit(-float(drop)).alias("delta"), (share * F.col(weight)).alias("weight"), F.lit(True).alias("is_exit")))
