"""Model fitting on panels: splits by time, logistic, Poisson, ridge, trees, roles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, FeatureHasher, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import ContractError
from .rates import quantiles


def chronological_split(df: DataFrame, key: str, date: str, share: float) -> DataFrame:
    """Adds is_train: whole keys, by their first date, up to the date at which `share` of the keys have begun."""
    starts = df.groupBy(key).agg(F.min(date).alias("_start"))
    per_date = starts.groupBy("_start").agg(F.count("*").alias("_n"))  # one row a date
    upto = per_date.withColumn("_c", F.sum("_n").over(Window.orderBy("_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = starts.count()
    cut = upto.where(F.col("_c") <= share * total).agg(F.max("_start")).first()[0]
    return df.join(starts, key).withColumn("is_train", F.coalesce(F.col("_start") <= F.lit(cut), F.lit(False)) if cut is not None else F.lit(False)).drop("_start")


def expanding_folds(df: DataFrame, period: str, periods: Iterable[int], gap: int = 1) -> Iterable[tuple[int, DataFrame, DataFrame]]:
    """(period, rows that end at least `gap` periods before it, rows of it)."""
    for p in periods:
        yield p, df.where(F.col(period) <= p - gap), df.where(F.col(period) == p)


def features(numbers: Sequence[str], categories: Sequence[str] = (), scale: bool = True, impute: bool = False) -> list:
    """Stages that assemble numbers (imputed by medians, standardised) and one-hot categories into `features`."""
    stages: list = []
    cols = list(numbers)
    if impute:
        stages.append(Imputer(strategy="median", inputCols=cols, outputCols=[f"{c}_filled" for c in cols]))
        cols = [f"{c}_filled" for c in cols]
    if cols:
        stages.append(VectorAssembler(inputCols=cols, outputCol="numbers", handleInvalid="error"))
    if scale and cols:
        stages.append(StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True))
    parts = [("scaled" if scale else "numbers")] if cols else []
    for c in categories:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_hot")]
        parts.append(f"{c}_hot")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def fit(df: DataFrame, stages: Sequence, model) -> PipelineModel:
    return Pipeline(stages=[*stages, model]).fit(df)


def win_probability(train: DataFrame, numbers: Sequence[str], label: str, strength: float = 1e-4) -> PipelineModel:
    """Standardised L2 logistic regression."""
    return fit(train, features(numbers), LogisticRegression(labelCol=label, regParam=strength, elasticNetParam=0.0))


def candidates(label: str, layers: Sequence[int], seed: int = 0) -> dict:
    """Classifiers to compare: boosted trees and a small network; layers starts with the number of features."""
    return {"boosted": GBTClassifier(labelCol=label, seed=seed, maxIter=20), "network": MultilayerPerceptronClassifier(labelCol=label, layers=[*layers, 2], seed=seed, maxIter=50)}


def expected_points(train: DataFrame, numbers: Sequence[str], categories: Sequence[str], label: str, strength: float = 1e-6) -> PipelineModel:
    return fit(train, features(numbers, categories), GeneralizedLinearRegression(family="poisson", link="log", labelCol=label, regParam=strength))


def weighted_ridge(train: DataFrame, numbers: Sequence[str], label: str, weight: str | None, strength: float, mix: float = 0.0) -> PipelineModel:
    model = LinearRegression(labelCol=label, regParam=strength, elasticNetParam=mix)
    return fit(train, features(numbers, impute=True), model.setWeightCol(weight) if weight else model)


def boosted(train: DataFrame, numbers: Sequence[str], label: str, seed: int = 0, depth: int = 3, rounds: int = 30) -> PipelineModel:
    return fit(train, features(numbers, scale=False, impute=True), GBTRegressor(labelCol=label, seed=seed, maxDepth=depth, maxIter=rounds))


def probability(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def prediction(model: PipelineModel, df: DataFrame, name: str = "predicted") -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", name).select(*df.columns, name)


def stored(df: DataFrame, path: str | None, name: str) -> DataFrame:
    """df through a table below path, so that what follows reads results and plans stay short; without a path df itself."""
    if path is None:
        return df
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


def out_of_fold(df: DataFrame, fold: str, folds: Iterable, fit_one: Callable[[DataFrame], PipelineModel], name: str = "predicted", path: str | None = None) -> DataFrame:
    """Every row predicted by a model that has not seen its fold; with a path each fold's predictions are written there."""
    out = None
    for i, k in enumerate(folds):
        part = stored(prediction(fit_one(df.where(F.col(fold) != k)), df.where(F.col(fold) == k), name), path, f"fold-{i}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ContractError("no folds")
    return out


def least_error(errors: DataFrame, metric: str, ties: Sequence) -> dict:
    """The candidate with the least metric; ties in a given order."""
    return errors.orderBy(metric, *ties).limit(1).first().asDict()


def roles(panel: DataFrame, keys: Sequence[str], numbers: Sequence[str], dims: int, clusters: int, seed: int = 0, temperature: float = 1.0) -> DataFrame:
    """keys, role (ordered by the clusters' size, largest first) and affinities: a softmax over negative distances.

    Columns are standardised, projected on principal components and clustered.
    """
    stages = [*features(numbers), PCA(k=dims, inputCol="features", outputCol="components"), KMeans(k=clusters, featuresCol="components", seed=seed, predictionCol="_cluster")]
    model = Pipeline(stages=stages).fit(panel)
    found = model.transform(panel).withColumn("_x", vector_to_array("components"))
    sizes = [r["_cluster"] for r in found.groupBy("_cluster").count().orderBy(F.desc("count"), "_cluster").collect()]  # one row a cluster
    centers = model.stages[-1].clusterCenters()
    distance = [sum(((F.col("_x")[i] - float(v)) ** 2 for i, v in enumerate(centers[c])), F.lit(0.0)) for c in sizes]
    weights = [F.exp(-F.sqrt(d) / temperature) for d in distance]
    total = sum(weights, F.lit(0.0))
    role = F.array_position(F.array(*[F.lit(c) for c in sizes]), F.col("_cluster")) - 1
    return found.select(*keys, role.alias("role"), *[(w / total).alias(f"affinity_{k}") for k, w in enumerate(weights)])


def cluster_counts(panel: DataFrame, numbers: Sequence[str], counts: Sequence[int], seed: int = 0) -> list[tuple[int, float]]:
    """(k, silhouette) of each number of clusters, best first."""
    ready = Pipeline(stages=features(numbers)).fit(panel).transform(panel)
    score = ClusteringEvaluator(featuresCol="features", metricName="silhouette")
    return sorted(((k, score.evaluate(KMeans(k=k, seed=seed, featuresCol="features").fit(ready).transform(ready))) for k in counts), key=lambda x: (-x[1], x[0]))


def component_signs(model: PipelineModel) -> list[float]:
    """1 or -1 a component, so that its largest loading is positive; a PCA fixes components up to their sign only."""
    loadings = next(x for x in model.stages if hasattr(x, "pc")).pc.toArray()
    return [1.0 if loadings[abs(loadings[:, k]).argmax(), k] >= 0 else -1.0 for k in range(loadings.shape[1])]


def adjusted_rand(df: DataFrame, a: str, b: str) -> float:
    """The adjusted Rand index of two labellings: 1 if they are the same partition, about 0 for unrelated ones."""
    table = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))  # one row a pair of labels
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = table.agg(pairs("n")).first()[0] or 0.0
    left, right = (table.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs("n")).first()[0] or 0.0 for c in (a, b))
    n = table.agg(F.sum("n")).first()[0] or 0.0
    chance = left * right / max(n * (n - 1) / 2, 1.0)
    top = (left + right) / 2
    return 1.0 if top == chance else (both - chance) / (top - chance)


def stable_cluster_count(panel: DataFrame, numbers: Sequence[str], counts: Sequence[int], seeds: Sequence[int] = (0, 1), least: float = 0.8) -> list[dict]:
    """Per number of clusters: k, silhouette, stability (the least adjusted Rand index between two seeds' fits) and stable.

    The best comes first: stable ones by silhouette, then the others; ties take fewer clusters.
    """
    ready = Pipeline(stages=features(numbers)).fit(panel).transform(panel)
    score = ClusteringEvaluator(featuresCol="features", metricName="silhouette")
    out = []
    for k in counts:
        labelled = ready
        for s in seeds:
            labelled = KMeans(k=k, seed=s, featuresCol="features", predictionCol=f"_c{s}").fit(ready).transform(labelled)
        stability = min((adjusted_rand(labelled, f"_c{a}", f"_c{b}") for i, a in enumerate(seeds) for b in seeds[i + 1 :]), default=1.0)
        out.append({"k": k, "silhouette": score.setPredictionCol(f"_c{seeds[0]}").evaluate(labelled), "stability": stability, "stable": stability >= least})
    return sorted(out, key=lambda r: (not r["stable"], -r["silhouette"], r["k"]))


def stacked(df: DataFrame, fold: str, folds: Sequence, keys: Sequence[str], bases: dict[str, Callable[[DataFrame], PipelineModel]], meta: Callable[[DataFrame, list[str]], PipelineModel], label: str, name: str = "predicted", path: str | None = None) -> DataFrame:
    """keys, fold, label, one column a base model and the stack's prediction, all out of fold on both levels.

    The stack that predicts fold k is trained on the other folds' rows, and a row of fold j there has its base columns from models fitted without the rows of both j and
    k; the rows of k have theirs from models fitted without k.  So no label of k reaches the stack that predicts it.  A model without two folds serves both of them:
    n (n + 1) / 2 fits a base model.  With a path predictions are written there, so no plan holds more than one model.
    """
    folds = list(folds)
    if len(folds) < 3:
        raise ContractError("nested folds need three folds or more")
    parts: dict = {k: [] for k in folds}
    for i, k in enumerate(folds):
        for j in folds[i:]:
            rest, held = df.where(~F.col(fold).isin([j, k])), df.where(F.col(fold).isin([j, k]))
            columns = held
            for base, fit_one in bases.items():
                columns = prediction(fit_one(rest), columns, base)
            found = stored(columns.select(*keys, fold, label, *bases), path, f"without-{i}-{folds.index(j)}")
            if j == k:
                parts[k].append(found)
            else:  # for the stack of k the rows of j, and the other way round
                parts[k].append(found.where(F.col(fold) == j))
                parts[j].append(found.where(F.col(fold) == k))
    out = None
    for i, k in enumerate(folds):
        rows = reduce(DataFrame.unionByName, parts[k])
        model = meta(rows.where(F.col(fold) != k), list(bases))
        part = stored(prediction(model, rows.where(F.col(fold) == k), name), path, f"stack-{i}")
        out = part if out is None else out.unionByName(part)
    return out


class HashedLogistic:
    """Multinomial (or two-class) logistic regression over hashed one-hot categories and standardised numbers.

    Categories of any number share `buckets` columns, so no dictionary of ids is gathered; an id that was not trained on has its bucket's weight, which is 0 unless it
    collides.  Each step's gradient is added up over the rows by a tree of tasks.
    """

    def __init__(self, categories: Sequence[str], numbers: Sequence[str], label: str, buckets: int = 1 << 18, strength: float = 1e-5, rounds: int = 100, tolerance: float = 1e-6):
        self.categories, self.numbers, self.label, self.buckets, self.strength, self.rounds, self.tolerance = list(categories), list(numbers), label, buckets, strength, rounds, tolerance

    def fit(self, train: DataFrame) -> HashedLogistic:
        """The classes are the labels' values in order, few of them; numbers are standardised by the training rows."""
        self.classes = [r[0] for r in train.where(F.col(self.label).isNotNull()).select(self.label).distinct().orderBy(self.label).collect()]
        if len(self.classes) < 2:
            raise ContractError("one class is none to tell apart")
        row = train.agg(*[f(c).alias(f"{n}_{c}") for c in self.numbers for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if self.numbers else {}
        self.scale = {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in self.numbers}
        model = LogisticRegression(labelCol="_label", featuresCol="features", family="multinomial", regParam=self.strength, maxIter=self.rounds, tol=self.tolerance, standardization=False, aggregationDepth=3)
        self.model = model.fit(self._ready(train.where(F.col(self.label).isNotNull())))
        self.iterations, self.converged = self.model.summary.totalIterations, self.model.summary.totalIterations < self.rounds
        return self

    def _ready(self, df: DataFrame) -> DataFrame:
        label = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col(self.label)) - 1
        rows = df.withColumns({"_label": label.cast("double"), **{f"_c_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.categories}, **{f"_n_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / d for c, (m, d) in self.scale.items()}})
        hashed = FeatureHasher(inputCols=[f"_c_{c}" for c in self.categories], outputCol="_hashed", numFeatures=self.buckets, categoricalCols=[f"_c_{c}" for c in self.categories]).transform(rows)
        return VectorAssembler(inputCols=["_hashed", *[f"_n_{c}" for c in self.numbers]], outputCol="features").transform(hashed)

    def probabilities(self, df: DataFrame, name: str = "p") -> DataFrame:
        """df and an array of the classes' probabilities, in the order of `classes`."""
        return self.model.transform(self._ready(df)).withColumn(name, vector_to_array("probability")).select(*df.columns, name)

    def losses(self, df: DataFrame) -> DataFrame:
        """df with loss (-log of the label's probability, at most that of 1e-15) and squared (the Brier score over classes); rows with a label that was not trained on have null."""
        at = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col(self.label))
        own = F.when(at > 0, F.element_at("_p", F.greatest(at, F.lit(1)).cast("int")))
        squared = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x * x) - 2 * own + 1
        return self.probabilities(df, "_p").withColumns({"loss": F.when(own.isNotNull(), -F.log(F.greatest(own, F.lit(1e-15)))), "squared": F.when(own.isNotNull(), squared)}).drop("_p")


def added_signal(panel: DataFrame, is_train: str, cluster: str, categories: Sequence[str], extra: Sequence[str], numbers: Sequence[str], label: str, draws: int = 200, seed: int = 7, **options) -> DataFrame:
    """(model, rows, log_loss, brier, iterations, converged, better): whether `extra` categories tell more, on rows that are not trained on.

    better: the share of draws of whole clusters (games) in which the larger model's summed loss is the lesser one; null for the smaller model.
    """
    from .resample import poisson_blocks

    train, test = panel.where(F.col(is_train)), panel.where(~F.col(is_train))
    fits = [HashedLogistic([*categories, *more], numbers, label, **options).fit(train) for more in ((), tuple(extra))]
    scored = fits[1].losses(fits[0].losses(test).withColumnsRenamed({"loss": "_loss0", "squared": "_squared0"})).where("loss is not null and _loss0 is not null")
    sums = scored.groupBy(cluster).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("_loss0", "_squared0", "loss", "squared")])
    total = sums.agg(*[F.sum(c).alias(c) for c in ("n", "_loss0", "_squared0", "loss", "squared")]).first()
    drawn = poisson_blocks(sums.withColumn("d", F.col("loss") - F.col("_loss0")), [], cluster, ["d"], draws, seed)
    better = drawn.agg(F.avg((F.col("d") < 0).cast("double"))).first()[0]
    n = total["n"] or 0
    rows = [(kind, n, total[a] / n if n else None, total[b] / n if n else None, f.iterations, f.converged, p) for kind, f, a, b, p in (("smaller", fits[0], "_loss0", "_squared0", None), ("larger", fits[1], "loss", "squared", better))]
    return panel.sparkSession.createDataFrame(rows, "model string, rows long, log_loss double, brier double, iterations int, converged boolean, better double")


def residual_projection(transitions: DataFrame, origin: str, base: Column, target: str, basis: Sequence[str], weight: str, strength: float, first: int) -> DataFrame:
    """transitions with base and predicted: an AR(1) base and a ridge of what it leaves on an age basis, each origin from earlier ones only.

    A fit for origin s uses rows with origin < s - 1, whose targets lie before s; basis columns are standardised by their unweighted mean and deviation over those
    rows, the ridge is weighted and its intercept free.  Sums by origin are added up over time, so the rows are read once; origins before `first` or with fewer than two earlier
    rows have the base alone.
    """
    rows = transitions.withColumn("base", base).withColumn("_r", F.col(target) - F.col("base"))
    usable = rows.where(F.col("_r").isNotNull() & (F.col(weight) > 0))
    for c in basis:
        usable = usable.where(F.col(c).isNotNull())
    names = list(basis)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    w = F.col(weight)
    sums = usable.groupBy(origin).agg(
        F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * F.col("_r")).alias("wr"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)], *[F.sum(F.col(c) * F.col(c)).alias(f"q{i}") for i, c in enumerate(names)],
        *[F.sum(w * F.col(c)).alias(f"wx{i}") for i, c in enumerate(names)], *[F.sum(w * F.col(c) * F.col("_r")).alias(f"wxr{i}") for i, c in enumerate(names)], *[F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"wxx{i}_{j}") for i, j in pairs],
    )
    by = {r[origin]: r.asDict() for r in sums.collect()}  # one row a season
    fits = []
    for s in sorted(r[0] for r in rows.select(origin).distinct().collect() if r[0] is not None):
        own = [r for o, r in by.items() if o < s - 1]
        total = lambda k: float(sum(r[k] for r in own))  # noqa: E731, B023
        if s < first or total("n") < 2:
            continue
        n, sw, wr = total("n"), total("w"), total("wr")
        mean = np.array([total(f"s{i}") / n for i in range(len(names))])
        sd = np.sqrt(np.maximum([total(f"q{i}") / n - mean[i] ** 2 for i in range(len(names))], 0.0))
        sd[sd < 1e-12] = 1.0
        center, slopes = np.array([total(f"wx{i}") / sw for i in range(len(names))]), np.array([total(f"wxr{i}") for i in range(len(names))])
        gram = np.zeros((len(names),) * 2)
        for i, j in pairs:
            gram[i, j] = gram[j, i] = total(f"wxx{i}_{j}") - sw * center[i] * center[j]
        beta = np.linalg.solve(gram / np.outer(sd, sd) + strength * np.eye(len(names)), (slopes - center * wr) / sd) / sd
        fits.append((s, float(wr / sw - beta @ center), [float(b) for b in beta]))
    kind = transitions.schema[origin].dataType.simpleString()
    table = transitions.sparkSession.createDataFrame(fits, f"{origin} {kind}, _a double, _b array<double>")
    both = rows.join(F.broadcast(table), origin, "left")  # one row a season
    fit = F.col("_a") + sum((F.col("_b")[i] * F.col(c) for i, c in enumerate(names)), F.lit(0.0))
    return both.withColumn("predicted", F.col("base") + F.coalesce(fit, F.lit(0.0))).drop("_r", "_a", "_b")


def spline_basis(x: Column, knots: Sequence[float], degree: int = 3, name: str = "spline") -> list[Column]:
    """B-spline basis of a column as expressions: len(knots) + degree - 1 columns that are not negative and sum to 1; beyond the outer knots x counts as the knot.

    knots: ascending, the outer ones included; see exact_knots.
    """
    if len(knots) < 2 or any(a >= b for a, b in zip(knots, knots[1:], strict=False)):
        raise ContractError("knots must rise")
    full = [knots[0]] * degree + [float(k) for k in knots] + [knots[-1]] * degree
    at = F.greatest(F.lit(float(knots[0])), F.least(F.lit(float(knots[-1])), x.cast("double")))
    last = max(i for i in range(len(full) - 1) if full[i] < full[i + 1])
    level = [((at >= full[i]) & ((at <= full[i + 1]) if i == last else (at < full[i + 1]))).cast("double") if full[i] < full[i + 1] else F.lit(0.0) for i in range(len(full) - 1)]
    for d in range(1, degree + 1):
        part = lambda i, d=d: (at - full[i]) / (full[i + d] - full[i]) if full[i + d] > full[i] else F.lit(0.0)
        rest = lambda i, d=d: (full[i + d + 1] - at) / (full[i + d + 1] - full[i + 1]) if full[i + d + 1] > full[i + 1] else F.lit(0.0)
        level = [part(i) * level[i] + rest(i) * level[i + 1] for i in range(len(level) - 1)]
    return [c.alias(f"{name}_{i}") for i, c in enumerate(level)]


def exact_knots(df: DataFrame, column: str, count: int) -> list[float]:
    """Distinct exact quantiles at equal steps, the ends included."""
    steps = {f"q{i}": i / (count - 1) for i in range(count)}
    row = quantiles(df.select(column), (), column, steps).first()
    return sorted({float(row[q]) for q in steps if row is not None and row[q] is not None})


def spline_logistic(train: DataFrame, splined: dict[str, Sequence[float]], numbers: Sequence[str], label: str, strength: float = 1e-4) -> Callable[[DataFrame], DataFrame]:
    """A logistic regression on spline bases of some columns (name: knots) and standardised others; returns a function that adds p."""
    bases = {c: [b.alias(f"{c}_{i}") for i, b in enumerate(spline_basis(F.col(c), k, name=c))] for c, k in splined.items()}
    names = [f"{c}_{i}" for c, own in bases.items() for i in range(len(own) - 1)]  # they sum to 1, as the intercept does
    wide = lambda df: df.select("*", *[b for own in bases.values() for b in own[:-1]])
    model = win_probability(wide(train), [*names, *numbers], label, strength)
    return lambda df: probability(model, wide(df)).drop(*names)


def random_search(df: DataFrame, group: str, folds: int, options: dict[str, Sequence], tries: int, fit_one: Callable[[DataFrame, dict], PipelineModel], label: str, seed: int = 0) -> list[tuple[dict, float]]:
    """(options, held-out RMSE) of random choices, best first; whole groups are held out together."""
    import random

    rng = random.Random(seed)
    parted = df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(folds)))  # a hash, so every reading has the same folds
    out = []
    for _ in range(tries):
        chosen = {k: rng.choice(list(v)) for k, v in options.items()}
        held = out_of_fold(parted, "_fold", range(folds), lambda train, c=chosen: fit_one(train, c))
        out.append((chosen, held.agg(F.sqrt(F.avg((F.col(label) - F.col("predicted")) ** 2))).first()[0]))
    return sorted(out, key=lambda x: x[1])
