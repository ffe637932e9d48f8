"""Penalties judged forwards in time: windows of seasons train, the season after them tests, whole clusters carry the losses.

Training sums come from the seasons' prefix sums, so a window costs a difference, not a pass; all candidates of all folds are scored
in one pass over the test rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..contracts import ContractError
from .packed import SeasonSums
from .rates import fit_scores
from .resample import poisson_blocks

#: What a candidate must reach to be worth an untouched confirmation, or to be promising.
STRONG, PROMISING, LEAST_FOLDS = {"better": 0.95, "wins": 0.7, "gain": 0.01}, {"better": 0.90, "wins": 0.5}, 3


def retrodicted(design: DataFrame, response: DataFrame, fits: Mapping, row: str, y: str, season: str, cluster: str, sign: Column | None = None) -> DataFrame:
    """(season, cluster, candidate, actual, predicted, unknown, squared_error), one row a cluster and candidate.

    fits: {test season: [(columns, coefficients, intercept) of each candidate]}.  A row's sign is 1 or -1, so that a cluster's sums are margins;
    coefficients that a fit does not have, or has seen no row of, count 0 and are counted as unknown.
    """
    spark, first = design.sparkSession, next(iter(fits.values()))
    k = len(first)
    if any(len(f) != k for f in fits.values()):
        raise ContractError("every fold has the same candidates")
    kind = response.schema[season].dataType.simpleString()
    parts = []
    for s, own in fits.items():  # a row a season and coefficient
        names, values = own[0][0], np.column_stack([b for _, b, _ in own]).astype(float).ravel()
        parts.append(pa.table({"_s": pa.array([s] * len(names), to_arrow_type(response.schema[season].dataType)), "block": pa.array([b for b, _ in names], pa.string()), "entity": pa.array([e for _, e in names], pa.string()), "_b": pa.FixedSizeListArray.from_arrays(values, k).cast(pa.list_(pa.float64()))}))
    betas = F.broadcast(spark.createDataFrame(pa.concat_tables(parts)))
    means = spark.createDataFrame([(s, [float(m) for *_, m in own]) for s, own in fits.items()], f"_s {kind}, _m array<double>")
    rows = response.select(row, F.col(season).alias("_s"), F.col(cluster).alias("_c"), F.col(y).cast("double").alias("_y"), (F.lit(1.0) if sign is None else sign.cast("double")).alias("_sign")).join(F.broadcast(means), "_s")
    known = design.join(rows.select(row, "_s"), row).join(betas, ["_s", "block", "entity"], "left")
    fit = known.groupBy(row).agg(F.count_if(F.col("_b").isNull()).alias("_u"), *[F.sum(F.col("val") * F.coalesce(F.col("_b")[c], F.lit(0.0))).alias(f"_f{c}") for c in range(k)])
    both = rows.join(fit, row, "left")
    sums = both.groupBy("_s", "_c").agg(F.sum(F.col("_sign") * F.col("_y")).alias("actual"), F.sum(F.coalesce("_u", F.lit(0))).alias("unknown"), *[F.sum(F.col("_sign") * (F.col("_m")[c] + F.coalesce(f"_f{c}", F.lit(0.0)))).alias(f"_p{c}") for c in range(k)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(f"_p{c}").alias("predicted")) for c in range(k)]))
    out = sums.select(F.col("_s").alias(season), F.col("_c").alias(cluster), "actual", "unknown", each.alias("_e"))
    return out.select(season, cluster, "_e.candidate", "actual", "_e.predicted", "unknown", ((F.col("actual") - F.col("_e.predicted")) ** 2).alias("squared_error"))


def margin_scores(losses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: n, rmse, r2, mae, correlation of the clusters' margins, the ratio of their deviations and the slope of actual on predicted ones."""
    more = losses.groupBy(*keys).agg(F.try_divide(F.stddev_pop("predicted"), F.stddev_pop("actual")).alias("spread_ratio"), F.regr_slope("actual", "predicted").alias("slope"), F.sum("unknown").alias("unknown"))
    return fit_scores(losses, keys, "actual", "predicted").join(more, list(keys))


def window_fits(sums: SeasonSums, candidates: Sequence[Mapping[str, float]], tests: Sequence, span: int) -> dict:
    """{test season: fits of every candidate on the `span` seasons before it}; all of these must be there."""
    out = {}
    for t in sorted(tests):
        missing = [s for s in (*range(t - span, t), t) if s not in sums.totals]
        if missing:
            raise ContractError(f"the fold of {t} has no rows of {missing}")
        train = sums.window(t - span, t - 1)
        own = train.exposure != 0
        columns = [c for c, x in zip(train.columns, own, strict=True) if x]
        out[t] = [(columns, b[own], m) for b, m in train.solutions(candidates)]
    return out


def better_than_baseline(losses: DataFrame, season: str, cluster: str, candidates: int, draws: int, seed: int) -> dict[int, float]:
    """{candidate: share of draws in which its mean loss is below that of candidate 0}; clusters are drawn within seasons, paired."""
    wide = losses.groupBy(season, cluster).agg(*[F.max(F.when(F.col("candidate") == c, F.col("squared_error"))).alias(f"_l{c}") for c in range(candidates)])
    deltas = wide.select(F.col(season).alias("_s"), F.col(cluster).alias("_c"), *[(F.col(f"_l{c}") - F.col("_l0")).alias(f"_d{c}") for c in range(1, candidates)])
    names = [f"_d{c}" for c in range(1, candidates)]
    sums = poisson_blocks(deltas, ["_s"], "_c", names, draws, seed)
    sizes = deltas.groupBy("_s").agg(F.count("*").alias("_n"))
    drawn = sums.join(F.broadcast(sizes), "_s").where("weight > 0")  # a season a row
    means = drawn.groupBy("draw").agg(*[(F.sum(F.col("_n") * F.col(n) / F.col("weight")) / F.sum("_n")).alias(n) for n in names])
    found = means.agg(*[F.avg((F.col(n) < 0).cast("double")).alias(n) for n in names]).first()
    return {c: float(found[f"_d{c}"] or 0.0) for c in range(1, candidates)}


def verdict(better: float, wins: int, folds: int, gain: float) -> str:
    if folds < LEAST_FOLDS:
        return "too_few_folds"
    if better >= STRONG["better"] and wins >= math.ceil(STRONG["wins"] * folds) and gain >= STRONG["gain"]:
        return "worth_confirmation"
    return "promising" if better >= PROMISING["better"] and wins >= math.ceil(PROMISING["wins"] * folds) else "not_shown"


def compare(losses: DataFrame, season: str, cluster: str, candidates: Sequence[Mapping[str, float]], draws: int = 2000, seed: int = 7) -> DataFrame:
    """One row a candidate: penalties, folds, mean RMSE and correlation over folds, folds won, relative gain, share of draws that are better, verdict.

    The first candidate is the baseline; losses: what retrodicted returns for all of them.
    """
    spark = losses.sparkSession
    folds = margin_scores(losses, [season, "candidate"]).collect()  # a row a fold and candidate
    by = {(r[season], r["candidate"]): r for r in folds}
    tests = sorted({s for s, _ in by})
    mean = lambda c, f: sum(by[s, c][f] or 0.0 for s in tests) / len(tests)
    better = better_than_baseline(losses, season, cluster, len(candidates), draws, seed) if len(candidates) > 1 else {}
    out = []
    for c, penalties in enumerate(candidates):
        wins = sum(by[s, c]["rmse"] < by[s, 0]["rmse"] for s in tests)
        base = mean(0, "rmse")
        gain = (base - mean(c, "rmse")) / base if base else 0.0
        share = better.get(c, 0.5)
        out.append((c, ",".join(f"{b}={v:g}" for b, v in sorted(penalties.items())), len(tests), mean(c, "rmse"), mean(c, "correlation"), wins, gain, share, verdict(share, wins, len(tests), gain) if c else "baseline"))
    return spark.createDataFrame(out, "candidate int, penalties string, folds int, rmse double, correlation double, wins int, gain double, better double, verdict string")


def walk_forward(design: DataFrame, response: DataFrame, row: str, y: str, season: str, cluster: str, candidates: Sequence[Mapping[str, float]], tests: Sequence, span: int, path: str, sign: Column | None = None, draws: int = 2000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(losses by cluster, comparison) of fixed candidates over independent chronological folds."""
    if span < 1 or not candidates:
        raise ContractError("a window of one season or more and a candidate are needed")
    sums = SeasonSums.build(design, response, row, y, season, path)
    losses = retrodicted(design, response, window_fits(sums, candidates, tests, span), row, y, season, cluster, sign)
    losses.write.mode("overwrite").parquet(f"{path}/losses")
    losses = design.sparkSession.read.schema(losses.schema).parquet(f"{path}/losses")
    return losses, compare(losses, season, cluster, candidates, draws, seed)


def select_then_confirm(sums: SeasonSums, design: DataFrame, response: DataFrame, row: str, y: str, season: str, cluster: str, default: Mapping[str, float], candidates: Sequence[Mapping[str, float]], selection: tuple, confirmation: tuple, sign: Column | None = None) -> DataFrame:
    """(stage, candidate, penalties, rmse, correlation, chosen): penalties are chosen on one season and judged once on a later one.

    selection and confirmation: (first training season, last one, test season), in order of time.  Candidate -1 is the default, which is
    only judged in the confirmation; the winner is the least RMSE, ties by smaller penalties.  chosen marks the winner of the selection, and in the
    confirmation the penalties to use: the winner's if they are the default's or have the lesser RMSE there, else the default's.
    """
    for first, last, test in (selection, confirmation):
        if not first <= last < test:
            raise ContractError("training seasons must precede the test season")
    if selection[2] >= confirmation[2]:
        raise ContractError("the confirmation season must follow the selection season")
    if not candidates or any(v <= 0 for c in (default, *candidates) for v in c.values()):
        raise ContractError("penalties must be positive")
    missing = [s for first, last, test in (selection, confirmation) for s in (*range(first, last + 1), test) if s not in sums.totals]
    if missing:
        raise ContractError(f"no rows of {missing}")
    name = lambda c: ",".join(f"{b}={v:g}" for b, v in sorted(c.items()))

    def judged(fold, options):
        first, last, test = fold
        train = sums.window(first, last)
        own = train.exposure != 0
        columns = [c for c, x in zip(train.columns, own, strict=True) if x]
        fits = {test: [(columns, b[own], m) for b, m in train.solutions(options)]}
        return {r["candidate"]: r for r in margin_scores(retrodicted(design, response, fits, row, y, season, cluster, sign), ["candidate"]).collect()}

    chosen = judged(selection, candidates)
    best = min(chosen, key=lambda c: (chosen[c]["rmse"], [candidates[c][b] for b in sorted(candidates[c])], c))
    same = dict(candidates[best]) == dict(default)
    final = judged(confirmation, [default, candidates[best]])
    confirmed = same or final[1]["rmse"] < final[0]["rmse"]
    out = [("selection", c, name(candidates[c]), r["rmse"], r["correlation"], c == best) for c, r in sorted(chosen.items())]
    out += [("confirmation", -1, name(default), final[0]["rmse"], final[0]["correlation"], not confirmed), ("confirmation", best, name(candidates[best]), final[1]["rmse"], final[1]["correlation"], confirmed)]
    return design.sparkSession.createDataFrame(out, "stage string, candidate int, penalties string, rmse double, correlation double, chosen boolean")


def annual_fits(sums: SeasonSums, penalties: Mapping[str, float], priors: Mapping | None = None) -> DataFrame:
    """(season, block, entity, beta, prior, update, exposure): one ridge a season, towards its prior if it has one.

    priors: {season: coefficients in the order of the columns}.  beta = prior + update; without a prior the prior is 0 and beta is the plain ridge.
    """
    parts = []
    for s in sums.seasons:
        own = sums.window(s, s)
        center = None if priors is None else priors.get(s)
        beta, _ = own.solve(penalties, center)
        prior = np.zeros(len(beta)) if center is None else np.asarray(center)
        rows = [(s, *c, float(b), float(q), float(b - q), float(x)) for c, b, q, x in zip(own.columns, beta, prior, own.exposure, strict=True) if x]
        parts.append(sums.spark.createDataFrame(rows, "season int, block string, entity string, beta double, prior double, update double, exposure double"))
    return reduce(DataFrame.unionByName, parts)
