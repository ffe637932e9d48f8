"""Hashed multinomial regression, nested stacks, residual projections, spline bases and roles against plain versions."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.contracts import ContractError
from eventloom.operators import models, roles


def shots(n, seed=1, ids=100_000):
    """Three classes that depend on a few of many ids, a number, and for "d" on another id."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s, d, x = (rng.randrange(20) if rng.random() < 0.7 else rng.randrange(ids)), rng.randrange(10), rng.gauss(3, 2)
        z = np.array([0.0, 1.2 * (s % 3) - 0.5, 0.6 * x - 1.5 + 1.5 * (d % 2)])
        p = np.exp(z - z.max())
        out.append((i // 20, f"s{s}", d, float(x), "abc"[rng.choices(range(3), p / p.sum())[0]], i < 0.7 * n))
    return out


SHOTS = "game int, s string, d int, x double, zone string, train boolean"


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shots") / "rows")
    spark.createDataFrame(shots(6000), SHOTS).write.parquet(path)
    return spark.read.parquet(path)


def plain_multinomial(rows, categories, strength, rounds=600):
    """Held-out log loss of a dense fit by accelerated descent, one column an id, numbers standardised."""
    train = [r for r in rows if r[5]]
    names = {c: k for k, c in enumerate(sorted({(i, r[i]) for r in train for i in categories}, key=str))}
    x0, sd = np.mean([r[3] for r in train]), np.std([r[3] for r in train])

    def design(own):
        x = np.zeros((len(own), len(names) + 2))
        x[:, -1], x[:, -2] = 1, [(r[3] - x0) / sd for r in own]
        for k, r in enumerate(own):
            for i in categories:
                if (i, r[i]) in names:
                    x[k, names[i, r[i]]] = 1
        return x

    x, y = design(train), np.eye(3)[["abc".index(r[4]) for r in train]]
    w = v = np.zeros((x.shape[1], 3))
    penalty = np.full((x.shape[1], 1), strength)
    penalty[-1] = 0
    step = 1 / (0.5 * np.linalg.norm(x, 2) ** 2 / len(x) + strength)
    soft = lambda z: (e := np.exp(z - z.max(axis=1, keepdims=True))) / e.sum(axis=1, keepdims=True)
    for k in range(rounds):
        new = v - step * (x.T @ (soft(x @ v) - y) / len(x) + penalty * v)
        v, w = new + k / (k + 3) * (new - w), new
    test = [r for r in rows if not r[5]]
    p = soft(design(test) @ w)
    return -np.mean(np.log([p[k, "abc".index(r[4])] for k, r in enumerate(test)]))


def test_hashed_logistic_is_near_a_dense_fit(panel):
    rows = shots(6000)
    model = models.HashedLogistic(["s"], ["x"], "zone", buckets=1 << 15, strength=1e-3).fit(panel.where("train"))
    held = model.losses(panel.where("not train"))
    got = held.agg(F.avg("loss")).first()[0]
    assert got == pytest.approx(plain_multinomial(rows, [1], 1e-3), rel=0.01) and got < 0.95 * np.log(3)
    assert model.classes == ["a", "b", "c"] and model.converged and panel.select("s").distinct().count() > 1500
    row = model.probabilities(panel.limit(50)).select(F.max(F.abs(F.aggregate("p", F.lit(0.0), lambda a, v: a + v) - 1)).alias("gap")).first()
    assert row["gap"] < 1e-9


def test_unknown_classes_and_ids_have_defined_losses(spark, panel):
    model = models.HashedLogistic(["s"], ["x"], "zone", buckets=1 << 12, rounds=5).fit(panel.where("train"))
    odd = spark.createDataFrame([(1, "never seen", 1, 1.0, "a", False), (1, None, 1, None, "b", False), (1, "s1", 1, 2.0, "new", False), (1, "s1", 1, 2.0, None, False)], SHOTS)
    got = [r["loss"] for r in model.losses(odd).collect()]
    assert got[0] > 0 and got[1] > 0 and got[2] is None and got[3] is None
    with pytest.raises(ContractError, match="one class"):
        models.HashedLogistic(["s"], ["x"], "zone").fit(panel.where("zone = 'a'"))


def test_added_signal_is_seen_and_noise_is_not(panel):
    run = lambda extra: {r["model"]: r for r in models.added_signal(panel, "train", "game", ["s"], [extra], ["x"], "zone", draws=100, buckets=1 << 14, strength=1e-3).collect()}
    told = run("d")
    assert told["larger"]["log_loss"] < told["smaller"]["log_loss"] - 0.01 and told["larger"]["better"] > 0.95 and told["larger"]["brier"] < told["smaller"]["brier"] and told["smaller"]["better"] is None
    assert told["smaller"]["rows"] == 1800


def linear(columns):
    return lambda train: models.weighted_ridge(train, columns, "y", None, 1e-6)


def stack_rows(flip=None):
    rng = random.Random(7)
    rows = [(i, i % 4, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(80)]
    return [(i, f, x, z, q, (-5.0 if f == flip else 1.0) * (2 * x - z) + 0.1 * q) for i, f, x, z, q in rows]


def stack(spark, rows, tmp_path=None):
    df = spark.createDataFrame(rows, "i int, fold int, x double, z double, q double, y double")
    return {r["i"]: r for r in models.stacked(df, "fold", range(4), ["i"], {"one": linear(["x"]), "two": linear(["z"])}, lambda train, names: models.weighted_ridge(train, names, "y", None, 1e-6), "y", path=tmp_path).collect()}


def test_labels_of_a_fold_reach_nothing_that_predicts_it(spark, tmp_path):
    """Other labels in fold 2 leave its own predictions as they are; a stack trained on plain out-of-fold columns would change them."""
    true, changed = stack(spark, stack_rows(), str(tmp_path / "a")), stack(spark, stack_rows(2), str(tmp_path / "b"))
    own = [i for i in true if i % 4 == 2]
    assert all(true[i]["predicted"] == pytest.approx(changed[i]["predicted"]) and true[i]["one"] == pytest.approx(changed[i]["one"]) for i in own)
    assert any(abs(true[i]["predicted"] - changed[i]["predicted"]) > 0.1 for i in true if i % 4 != 2)


def test_each_base_model_is_fitted_once_a_pair_of_folds(spark):
    seen = []

    def fit_one(train):
        seen.append(frozenset(r[0] for r in train.select("fold").distinct().collect()))
        return linear(["x"])(train)

    df = spark.createDataFrame(stack_rows(), "i int, fold int, x double, z double, q double, y double")
    models.stacked(df, "fold", range(4), ["i"], {"one": fit_one}, lambda train, names: linear(names)(train), "y")
    assert sorted(map(sorted, seen)) == sorted(map(sorted, [set(range(4)) - {a, b} for a, b in itertools.combinations_with_replacement(range(4), 2)]))
    with pytest.raises(ContractError, match="three folds"):
        models.stacked(df, "fold", range(2), ["i"], {}, None, "y")


def test_residual_projection_uses_earlier_origins_only(spark):
    rng = np.random.default_rng(5)
    rows = [(s, float(rng.uniform(19, 38)), float(rng.normal()), float(rng.uniform(1, 9))) for s in range(2000, 2008) for _ in range(30)]
    rows = [(s, a, max(a - 28, 0.0), f, w, 0.7 * f - 0.02 * (a - 27) ** 2 / 5 + float(rng.normal(0, 0.2))) for s, a, f, w in rows]
    df = spark.createDataFrame(rows + [(2009, 25.0, 0.0, 1.0, 2.0, None), (2001, None, None, 1.0, 2.0, 0.5), (2001, 30.0, 2.0, 1.0, 0.0, 9.9)], "s int, a double, h double, f double, w double, y double")
    got = {(r["s"], r["a"], r["f"]): r for r in models.residual_projection(df, "s", 0.6 * F.col("f"), "y", ["a", "h"], "w", 3.0, 2004).collect()}
    for s in range(2000, 2010):
        train = np.array([r for r in rows if r[0] < s - 1])
        for r in rows:
            if r[0] != s:
                continue
            want = 0.6 * r[3]
            if s >= 2004:
                x, w, e = train[:, 1:3], train[:, 4], train[:, 5] - 0.6 * train[:, 3]
                mean, sd = x.mean(axis=0), x.std(axis=0)
                z = (x - mean) / sd
                zm, em = np.average(z, axis=0, weights=w), np.average(e, weights=w)
                beta = np.linalg.solve((z - zm).T @ ((z - zm) * w[:, None]) + 3.0 * np.eye(2), (z - zm).T @ (w * (e - em)))
                want += em + ((np.array(r[1:3]) - mean) / sd - zm) @ beta
            assert got[s, r[1], r[3]]["predicted"] == pytest.approx(want) and got[s, r[1], r[3]]["base"] == pytest.approx(0.6 * r[3])
    assert got[2001, None, 1.0]["predicted"] == pytest.approx(0.6) and got[2009, 25.0, 1.0]["predicted"] is not None


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_spline_basis_equals_the_plain_recursion(spark, degree):
    knots = [0.0, 1.0, 2.5, 4.0]
    full = [0.0] * degree + knots + [4.0] * degree

    def plain(i, d, x):
        if d == 0:
            return float(full[i] <= x < full[i + 1] or (x == 4.0 and full[i] < full[i + 1] == 4.0))
        a = (x - full[i]) / (full[i + d] - full[i]) * plain(i, d - 1, x) if full[i + d] > full[i] else 0.0
        b = (full[i + d + 1] - x) / (full[i + d + 1] - full[i + 1]) * plain(i + 1, d - 1, x) if full[i + d + 1] > full[i + 1] else 0.0
        return a + b

    points = [-1.0, 0.0, 0.3, 1.0, 1.7, 2.5, 3.9, 4.0, 9.0]
    got = spark.createDataFrame([(x,) for x in points], "x double").select("x", *models.spline_basis(F.col("x"), knots, degree)).collect()
    assert len(got[0]) == 1 + len(knots) + degree - 1
    for r in got:
        x = min(max(r["x"], 0.0), 4.0)
        assert list(r)[1:] == pytest.approx([plain(i, degree, x) for i in range(len(knots) + degree - 1)]) and sum(list(r)[1:]) == pytest.approx(1.0) and min(list(r)[1:]) >= 0
    with pytest.raises(ContractError, match="rise"):
        models.spline_basis(F.col("x"), [1.0, 1.0])


def test_spline_logistic_bends(spark):
    rng = random.Random(2)
    rows = [(x := rng.uniform(-3, 3), rng.gauss(0, 1), int(rng.random() < (0.9 if abs(x) > 1.5 else 0.1))) for _ in range(1500)]
    df = spark.createDataFrame(rows, "x double, n double, y int")
    knots = models.exact_knots(df, "x", 5)
    assert knots[0] == min(r[0] for r in rows) and len(knots) == 5 and knots[2] == pytest.approx(np.median([r[0] for r in rows]))
    loss = lambda scored: scored.agg(F.avg(-F.log(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))))).first()[0]
    bent = models.spline_logistic(df, {"x": knots}, ["n"], "y")(df)
    assert bent.columns == ["x", "n", "y", "p"] and loss(bent) < 0.45 < 0.65 < loss(models.probability(models.win_probability(df, ["x", "n"], "y"), df))


# roles ---------------------------------------------------------------------------------------------------------------


def season_rows(seed=3, n=60, seasons=range(2001, 2006), drift=0.0):
    rng = random.Random(seed)
    centers = [(0, 0, 0, 0), (6, 0, 1, 2), (0, 7, -1, 2), (6, 7, 5, -4)]
    return [(p, s, *(c + rng.gauss(0, 0.4) for c in centers[(p + int(rng.random() < drift)) % 4])) for s in seasons for p in range(n)]


ROLE_NUMBERS = ["a", "b", "c", "d"]
ROLE_ROWS = "p int, s int, a double, b double, c double, d double"


def test_roles_do_not_depend_on_order_partitions_or_refits(spark, tmp_path):
    rows = season_rows()
    run = lambda r, parts: roles.role_report(spark.createDataFrame(r, ROLE_ROWS).repartition(parts), "p", "s", ROLE_NUMBERS, [2001, 2002], 3, 4, f"{tmp_path}/{parts}", parts=2)
    found, assigned, measures = run(rows, 3)
    assert measures["passed"] and measures["refit_rand"] == pytest.approx(1.0) and measures["same_role"] == pytest.approx(1.0) and measures["coverage"] == 1.0
    first = {(r["p"], r["s"]): r for r in assigned.collect()}
    assert all(first[p, s]["role"] == first[p % 4, 2001]["role"] for p, s in first) and len({first[p, 2001]["role"] for p in range(4)}) == 4
    assert all(sum(r[f"affinity_{k}"] for k in range(4)) == pytest.approx(1.0) and r["confidence"] == pytest.approx(max(r[f"affinity_{k}"] for k in range(4))) for r in first.values())
    random.Random(1).shuffle(rows)
    again, other, _ = run(rows, 1)
    assert np.allclose(found.axes, again.axes) and np.allclose(found.centers, again.centers)
    assert {(r["p"], r["s"]): r["role"] for r in other.collect()} == {k: r["role"] for k, r in first.items()}
    assert all(found.axes[k][np.abs(found.axes[k]).argmax()] > 0 for k in range(3))
    assert roles.released(assigned, measures) is assigned


def test_role_gates_refuse_what_moves(spark, tmp_path):
    _, assigned, measures = roles.role_report(spark.createDataFrame(season_rows(drift=0.7), ROLE_ROWS), "p", "s", ROLE_NUMBERS, [2001, 2002], 3, 4, f"{tmp_path}/a", parts=2, gates=roles.Gates(same_role=0.9))
    assert not measures["passed"] and not measures["gates"]["same_role"]
    with pytest.raises(ContractError, match="same_role"):
        roles.released(assigned, measures)
    frame = spark.createDataFrame(season_rows(), ROLE_ROWS)
    with pytest.raises(ContractError, match="1999"):
        roles.role_report(frame, "p", "s", ROLE_NUMBERS, [1999, 2001], 3, 4, f"{tmp_path}/b")
    with pytest.raises(ContractError, match="too few"):
        roles.role_report(frame.where("p < 5"), "p", "s", ROLE_NUMBERS, [2001], 3, 4, f"{tmp_path}/c")


def test_scaling_within_a_period(spark):
    rows = [(1, 2001, 1.0, 5.0), (2, 2001, 2.0, 5.0), (3, 2001, 3.0, 5.0), (4, 2001, None, 5.0), (5, 2001, 90.0, 5.0), (1, 2002, None, 1.0), (2, 2002, None, 2.0)]
    got = {(r["p"], r["s"]): (r["a"], r["b"]) for r in roles.scaled_within(spark.createDataFrame(rows, "p int, s int, a double, b double"), "s", ["a", "b"]).collect()}
    filled = np.array([1, 2, 3, 2.5, 90])
    scale = np.quantile(filled, 0.75) - np.quantile(filled, 0.25)
    assert [got[p, 2001][0] for p in range(1, 6)] == pytest.approx(np.clip((filled - 2.5) / scale, -5, 5).tolist())
    assert {got[p, 2001][1] for p in range(1, 6)} == {0.0} and got[1, 2002] == pytest.approx((0.0, -1.0))


def test_two_maps_are_matched(spark):
    rows = season_rows()
    frame = spark.createDataFrame(rows, ROLE_ROWS)
    scaled = roles.scaled_within(frame, "s", ROLE_NUMBERS)
    one, two = (roles.RoleMap.fit(scaled, "s", ROLE_NUMBERS, years, 3, 4) for years in ([2001, 2002], [2004, 2005]))
    shuffled = roles.RoleMap(ROLE_NUMBERS, "s", two.means, two.axes, two.centers[[2, 0, 3, 1]], two.temperature, two.explained)
    named = one.matched(shuffled, scaled)
    a = {(r["p"], r["s"]): r["role"] for r in one.assigned(scaled, ["p", "s"]).collect()}
    b = {(r["p"], r["s"]): named[r["role"]] for r in shuffled.assigned(scaled, ["p", "s"]).collect()}
    assert sorted(named.values()) == [0, 1, 2, 3] and a == b


def test_best_matching_is_the_best():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 6):
        for _ in range(20):
            gain = rng.integers(0, 9, (n, n)).astype(float)
            got = roles.best_matching(gain)
            assert sorted(got) == list(range(n)) and sum(gain[i, c] for i, c in enumerate(got)) == max(sum(gain[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(n)))
