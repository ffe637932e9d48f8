"""Operators on tiny frames with known answers, invariants, and what must not leak from the future."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom import checks, contracts
from eventloom.functions import scalars as s
from eventloom.operators import filters, joins, models, ordered, ranking, rates, resample, ridge


def values(df, *columns, order=()):
    return [tuple(r[c] for c in columns) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# scalars -------------------------------------------------------------------------------------------------------------


def test_clocks_and_ids(spark):
    rows = spark.createDataFrame([("PT12M00.00S", 720.0), ("PT00M02.30S", 2.3), ("x", None), (None, None), ("PT1H2M3S", 3723.0)], "c string, want double")
    assert all(got == want for got, want in values(rows.select(s.iso_seconds(F.col("c")).alias("got"), "want"), "got", "want"))
    texts = spark.createDataFrame([("5:30", 330.0), ("30.5", 30.5), ("", 0.0), (None, 0.0), ("PT01M00S", 60.0), ("bad", None)], "c string, want double")
    assert all(got == want for got, want in values(texts.select(s.clock_seconds(F.col("c")).alias("got"), "want"), "got", "want"))
    assert [one(spark, s.elapsed_seconds(F.lit(p), F.lit(r))) for p, r in ((1, 720.0), (2, 720.0), (5, 300.0))] == [0.0, 720.0, 2880.0]
    assert one(spark, s.padded_id(F.lit(22300001))) == "0022300001" and one(spark, s.padded_id(F.lit(12345678901))) == "12345678901"
    assert one(spark, s.strict_clock_seconds(F.lit("5:99"))) is None
    assert one(spark, s.game_type(F.lit("0042300101"))) == "playoffs"


def test_names_and_numbers(spark):
    assert one(spark, s.name_key(F.lit("Zoë Škoda-Ünal Jr."))) == "zoeskodaunal"
    assert one(spark, s.first_number_in(F.lit("about -1,234.5 or 7"))) == -1234.5 and one(spark, s.first_number_in(F.lit("none"))) is None
    assert one(spark, s.final_free_throw(F.lit("Free Throw 2 of 2"))) and not one(spark, s.final_free_throw(F.lit("1 of 2")))
    assert one(spark, s.text_points(F.lit("26' 3pt jump"), F.lit(True), F.lit(False))) == 3
    assert one(spark, s.keyword_class(F.lit("rim shots"), [("pass", "passing"), ("rim", "rim")], "other")) == "rim"
    assert one(spark, s.entropy([F.lit(0.5), F.lit(0.5), F.lit(0.0)])) == pytest.approx(np.log(2))


def test_predicates_have_two_values(spark):
    null = F.lit(None).cast("int")
    assert one(spark, s.differs(null, null)) is True and one(spark, s.holds(null == 1)) is False
    assert one(spark, s.ratio(F.lit(1.0), F.lit(0.0))) is None
    lineups = spark.createDataFrame([(1, 2, 2, 3), (1, None, None, 4), (1, 2, 3, 4)], "a1 int, a2 int, h1 int, h2 int")
    assert values(lineups.select(s.lineups_overlap(["a1", "a2"], ["h1", "h2"]).alias("x")), "x") == [(True,), (False,), (False,)]
    assert [one(spark, s.right_closed_bin(F.lit(v), [0, 10, 20], ["a", "b"])) for v in (0, 10, 10.5, 20, 21)] == [None, "a", "b", "b", None]


# ordered events ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([("g", 1, 0.0), ("g", 2, None), ("g", 3, 2.0), ("g", 4, None), ("g", 5, 1.0), ("h", 1, None)], "game string, n int, home double")


def test_sparse_scores(scores):
    got = values(ordered.state_changes(scores, ["game"], ["n"], "home"), "home", "home_before", "home_change", "home_corrected", "is_last", order=("game", "n"))
    assert got == [(0, 0, 0, False, False), (0, 0, 0, False, False), (2, 0, 2, False, False), (2, 2, 0, False, False), (1, 2, -1, True, True), (0, 0, 0, False, True)]


def test_runs_treat_missing_owners_as_different(spark):
    rows = spark.createDataFrame([(1, i, o) for i, o in enumerate(["a", "a", None, None, "b", "b", "a"])], "g int, n int, owner string")
    assert [x for x, in values(ordered.number_runs(rows, ["g"], ["n"], ["owner"]), "run", order=("n",))] == [1, 1, 2, 3, 4, 4, 5]
    runs = ordered.collapse_runs(rows.withColumn("points", F.lit(1.0)), ["g"], ["n"], ["owner"], {"points": F.sum("points")})
    assert runs.agg(F.sum("points")).first()[0] == 7.0 and values(runs, "first_n", "last_n", order=("run",))[3] == (4, 5)


def test_context_does_not_see_the_future(spark):
    rows = [("g", i, float(v)) for i, v in enumerate([2, 0, 3, 1])]
    schema = "g string, n int, points double"
    run = lambda r: values(ordered.prefix_context(spark.createDataFrame(r, schema), ["g"], ["n"], "points"), "number", "points_before", "previous_points", "is_first", order=("n",))
    assert run(rows) == [(1, 0.0, 0.0, True), (2, 2.0, 2.0, False), (3, 2.0, 0.0, False), (4, 5.0, 3.0, False)]
    changed = [*rows[:2], ("g", 2, 99.0), *rows[3:]]
    assert run(changed)[:3] == run(rows)[:3]


def test_conservation_and_stale_tail(spark):
    rows = spark.createDataFrame([("g", 1, 2.0), ("g", 2, 3.0), ("h", 1, 1.0)], "g string, n int, v double")
    totals = spark.createDataFrame([("g", 5.0), ("h", 2.0), ("i", 1.0)], "g string, total double")
    assert values(ordered.conservation_gaps(rows, ["g"], "v", totals, "total"), "g", order=("g",)) == [("h",), ("i",)]
    tail = spark.createDataFrame([("g", i, v) for i, v in enumerate([0, 1, 2, 1, 0])], "g string, n int, v int")
    assert ordered.trim_stale_tail(tail, ["g"], ["n"], F.col("v") == 2).count() == 3
    assert ordered.trim_stale_tail(tail, ["g"], ["n"], F.col("v") == 2, most=1).count() == 5
    assert ordered.trim_stale_tail(tail, ["g"], ["n"], F.col("v") == 7).count() == 5


def test_duration_weights_sum_to_one(spark):
    rows = spark.createDataFrame([("p", 1, 0.0, 10.0, 1), ("p", 2, 4.0, 10.0, 3), ("q", 1, 5.0, 5.0, 1), ("q", 2, 5.0, 5.0, 3)], "k string, n int, t double, e double, c int")
    got = dict(((k, n), w) for k, n, w in values(ordered.duration_weights(rows, ["k"], ["n"], F.col("t"), F.col("e"), "c"), "k", "n", "weight"))
    assert got == {("p", 1): 0.4, ("p", 2): 0.6, ("q", 1): 0.25, ("q", 2): 0.75}


def test_adjacent_needs_the_very_next_period(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 4, 40)], "k string, y int, v int")
    assert values(ordered.adjacent(rows, ["k"], "y", ["v"]), "next_v", order=("y",)) == [(20,), (None,), (None,)]
    assert values(ordered.adjacent(rows, ["k"], "y", ["v"], -1, "before_"), "before_v", order=("y",)) == [(None,), (10,), (None,)]


# joins ---------------------------------------------------------------------------------------------------------------


def test_interval_ends(spark):
    points = spark.createDataFrame([("g", i) for i in (0, 9, 10, 19, 20)], "g string, at int")
    stints = spark.createDataFrame([("g", "a", 0, 10), ("g", "b", 10, 20)], "g string, stint string, lo int, hi int")
    run = lambda closed, f: dict(values(f(points, stints, ["g"], F.col("at"), "lo", "hi", *([["stint"]] if f is joins.interval_join else []), closed=closed), "at", "stint"))
    assert run(False, joins.interval_join) == run(False, joins.disjoint_interval_join) == {0: "a", 9: "a", 10: "b", 19: "b"}
    assert run(True, joins.interval_join) == {0: "a", 9: "a", 10: "b", 19: "b", 20: "b"}
    assert values(joins.outside_intervals(points, stints, ["g"], F.col("at"), "lo", "hi"), "at") == [(20,)]


def test_nearest_within_tolerance_and_ties(spark):
    left = spark.createDataFrame([(1, "g", 10.0), (2, "g", 50.0)], "l int, g string, t double")
    right = spark.createDataFrame([(7, "g", 12.0), (6, "g", 8.0), (9, "h", 10.0)], "r int, g string, u double")
    assert values(joins.nearest_within(left, right, ["g"], "l", "t", "u", ["r"], 3.0), "l", "r", "gap") == [(1, 6, 2.0)]


def test_names_that_mean_two_people_stay_unresolved(spark):
    named = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (3, "y"), (None, "z")], "id int, k string")
    known, several = joins.resolver(named, ["k"], "id")
    assert values(known, "k", "id") == [("y", 3)] and values(several, "k", "n_ids") == [("x", 2)]
    assert values(joins.attach_id(named.where("id is null"), known, ["k"], "id"), "id") == [(None,)]


def test_checked_joins(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), spark.createDataFrame([(1, "p"), (2, "q")], "k int, w string")
    assert checks.checked_join(a, b, ["k"]).count() == 2
    with pytest.raises(contracts.ContractError, match="left key"):
        checks.checked_join(a, b, ["k"], validate="one_to_one")
    with pytest.raises(contracts.ContractError, match="right key"):
        checks.checked_join(b, a, ["k"])
    with pytest.raises(contracts.ContractError):
        checks.unique_gate(a, ["k"])
    with pytest.raises(contracts.ContractError, match="0.5000"):
        checks.coverage_gate(b, F.col("k") == 1, 0.9, "games")


def test_one_bad_row_rejects_its_game(spark):
    rows = spark.createDataFrame([("g1", 1, 2, 2), ("g1", 2, 1, 2), ("g2", 1, 1, 2), ("g2", 2, 1, None)], "gameid string, num int, h1 int, h2 int")
    clean, ledger = checks.quarantine(rows, ["gameid"], {"repeated": F.col("h1") == F.col("h2"), "range": F.col("num") > 5})
    assert values(clean, "gameid") == [("g2",), ("g2",)] and values(ledger, "gameid", "n_bad", "reasons") == [("g1", 1, "repeated")]


def test_conforming_to_a_contract(spark):
    raw = spark.createDataFrame([("1", "bad", [1, 2])], "a string, b string, c array<int>")
    got = contracts.conform(raw, contracts.schema(a="long", b="double", c="string", d="date")).first()
    assert tuple(got) == (1, None, "[1,2]", None)
    with pytest.raises(contracts.ContractError, match="z"):
        contracts.require(raw, ["a", "z"])
    assert values(contracts.missing_as_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double")), "x") == [(None,), (1.0,)]


# rates ---------------------------------------------------------------------------------------------------------------


def test_leave_one_out_adds_up(spark):
    rows = spark.createDataFrame([("s", "a", 4.0, 10.0), ("s", "b", 6.0, 10.0), ("t", "a", 5.0, 5.0)], "g string, d string, v double, e double")
    got = {(g, d): x for g, d, x in values(rates.leave_one_out(rows, ["g"], "v", "e"), "g", "d", "expected")}
    assert got == {("s", "a"): 0.6, ("s", "b"): 0.4, ("t", "a"): None}


def test_centering_is_exact(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i % 3, rng.random(), rng.random()) for i in range(50)], "y int, v double, w double")
    got = rates.centered(rows, ["y"], "v", "w").groupBy("y").agg(F.sum(F.col("w") * F.col("v_centered")).alias("x"))
    assert all(abs(x) < 1e-12 for x, in values(got, "x"))


def test_shrinkage_moves_between_value_and_centre(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.0, 1e9), ("c", None, 0.0)], "k string, x double, n double")
    got = dict(values(rates.shrunk_rate(rows, "x", "n", 100.0, name="y"), "k", "y"))
    assert got["a"] == pytest.approx(1 / 101, abs=1e-6) and got["b"] == pytest.approx(0.0, abs=1e-6) and got["c"] == pytest.approx(0.0, abs=1e-6)
    assert one(spark, rates.posterior(F.lit(2.0), F.lit(None).cast("double"), F.lit(5.0), 10.0)) == 2.0


def test_percentiles_average_ties(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "x double")
    got = sorted(values(rates.average_rank_percentile(rows.withColumn("g", F.lit(1)), ["g"], "x", "p"), "x", "p"), key=str)
    assert got == sorted([(1.0, 25.0), (2.0, 62.5), (2.0, 62.5), (3.0, 100.0), (None, None)], key=str)


def test_peaks_include_windows_that_start_in_a_gap(spark):
    rows = spark.createDataFrame([("a", 2000, 0.0, 1.0), ("a", 2003, 9.0, 1.0), ("a", 2004, 9.0, 1.0), ("b", 2001, 1.0, 1.0)], "k string, y int, v double, w double")
    got = {k: (lo, m, r) for k, lo, m, r in values(ranking.peaks(rows, ["k"], "y", "v", "w", 3), "k", "window_start", "mean", "peak_rank")}
    assert got == {"a": (2001, 9.0, 1)} or got == {"a": (2002, 9.0, 1)}
    assert got["a"][0] == 2001  # ties go to the earliest window


def test_search_and_pages(spark):
    names = spark.createDataFrame([(1, "Ann Lee"), (2, "Lee"), (3, "Leeds"), (4, "Bob")], "id int, name string")
    assert [i for i, in values(ranking.search(names, "name", "lee", ["name"]), "id")] == [2, 3, 1]
    page = ranking.leaderboard(names, F.col("id") < 4, [F.desc("id")], 1, 1)
    assert values(page, "id", "rank") == [(2, 2)]


# filters -------------------------------------------------------------------------------------------------------------


def test_decay_counts_gaps(spark):
    rows = spark.createDataFrame([("a", 2000, 10.0, 1.0), ("a", 2002, 20.0, 1.0)], "k string, y int, v double, w double")
    assert values(filters.decayed_mean(rows, ["k"], "y", "v", "w", 0.5), "filtered", order=("y",))[1][0] == pytest.approx((20 + 10 * 0.25) / 1.25)


def test_kalman_is_causal_and_shrinks(spark):
    rows = [("a", y, float(v), 1.0) for y, v in ((1, 2), (2, 2), (4, 2))]
    run = lambda r: values(filters.kalman(spark.createDataFrame(r, "k string, y int, v double, r double"), ["k"], "y", "v", "r", phi=1.0, noise=0.0), "filtered", "filtered_variance", order=("y",))
    assert [x for x, _ in run(rows)] == pytest.approx([1.0, 4 / 3, 1.5]) and run([*rows[:2], ("a", 4, 99.0, 1.0)])[:2] == run(rows)[:2]


def test_elo_updates_a_day_at_once(spark):
    d = dt.date
    games = spark.createDataFrame([("l", d(2020, 1, 1), 1, "a", "b", 5.0), ("l", d(2020, 1, 1), 1, "a", "c", 5.0), ("l", d(2020, 1, 2), 1, "a", "b", 5.0), ("l", d(2021, 1, 1), 2, "a", "b", 5.0)], "league string, day date, season int, h string, v string, m double")
    got = values(filters.elo(games, ["league"], "day", "season", "h", "v", "m"), "home_before", "away_before", order=("day", "v"))
    assert got[0] == got[1] == (1500.0, 1500.0) and got[2][0] > 1500 > got[2][1] and 1500 < got[3][0]


def test_lineups_replay_and_reject(spark):
    starters = spark.createDataFrame([("g", [1, 2, 3, 4, 5]), ("h", [1, 2, 3, 4, 5])], "game string, players array<int>")
    subs = spark.createDataFrame([("g", 20, 1, "out"), ("g", 20, 6, "in"), ("g", 30, 6, "out"), ("g", 30, 6, "in"), ("g", 40, 9, "out"), ("g", 40, 1, "in"), ("h", 5, 1, "out")], "game string, at int, player int, direction string")
    moments = filters.simultaneous(subs, ["game"], ["at"], "player", "direction")
    got = values(filters.replay_lineups(starters, moments, ["game"], "at"), "game", "stint", "players", "start", "end", "ok", order=("game", "stint"))
    assert got == [("g", 0, [1, 2, 3, 4, 5], None, 20, True), ("g", 1, [2, 3, 4, 5, 6], 20, None, False), ("h", 0, [1, 2, 3, 4, 5], None, None, False)]


def test_states_between_equal_neighbours(spark):
    rows = spark.createDataFrame([("g", i, x) for i, x in enumerate(["a", None, "a", None, "b", None])], "g string, n int, x string")
    assert [x for x, in values(filters.filled_between(rows, ["g"], ["n"], "x"), "x", order=("n",))] == ["a", "a", "a", None, "b", None]
    marks = spark.createDataFrame([("g", 1, 7, "in"), ("g", 2, 8, "out"), ("g", 3, 9, None), ("g", 4, 7, "out")], "g string, n int, p int, d string")
    assert values(filters.inferred_starters(marks, ["g"], "n", "p", F.col("d")), "players") == [([8, 9],)]


def test_smoothing_restarts_after_a_gap(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 0.0), ("a", 2, 0.0, 1.0), ("a", 4, 0.0, 1.0)], "k string, y int, p double, q double")
    assert values(filters.smoothed_vectors(rows, ["k"], "y", ["p", "q"], 0.25), "p", "q", "leading", order=("y",)) == [(1.0, 0.0, 0), (0.75, 0.25, 0), (0.0, 1.0, 1)]


# ridge ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def league(spark):
    rng = np.random.default_rng(3)
    skill = rng.normal(0, 0.1, 20)
    rows = []
    for i in range(4000):
        on = rng.permutation(20)
        o, d = sorted(map(int, on[:5])), sorted(map(int, on[5:10]))
        rows.append((i, i % 4, o, d, float(1 + skill[o].sum() - skill[d].sum() + rng.normal(0, 0.3))))
    return spark.createDataFrame(rows, "row int, fold int, o array<int>, d array<int>, y double"), skill


def test_ridge_recovers_skill_and_sign(league):
    df, skill = league
    design = ridge.lineup_design(df, "row", {"offense": F.col("o"), "defense": F.col("d")})
    found = ridge.NormalEquations.of(design, df.select("row", "y"), "row", "y")
    weights = {"offense": 5.0, "defense": 5.0}
    beta, mean = found.solve(weights)
    assert found.residual(beta, weights) < 1e-6
    beta, level = found.recentered(beta, mean, ["offense", "defense"])
    by = dict(zip(found.columns, beta, strict=True))
    assert np.corrcoef([by["offense", str(k)] for k in range(20)], skill)[0, 1] > 0.95
    assert np.corrcoef([by["defense", str(k)] for k in range(20)], skill)[0, 1] < -0.9
    off = [k for k, (b, _) in enumerate(found.columns) if b == "offense"]
    assert abs(np.average(beta[off], weights=found.exposure[off])) < 1e-12
    table = ridge.ratings(ridge.coefficients(df.sparkSession, found.columns, beta), ridge.moments(design, df.select("row", "y"), "row", "y"), "offense", "defense")
    assert table.count() == 20 and table.agg(F.corr("offense", "defense")).first()[0] > 0.8
    scored = ridge.predicted(design, ridge.coefficients(df.sparkSession, found.columns, beta), "row", level)
    assert scored.join(df, "row").agg(F.sum((F.col("y") - F.col("predicted")) ** 2)).first()[0] == pytest.approx(found.squared_error(beta, level), rel=1e-6)


def test_folds_are_differences(league):
    df, _ = league
    design = ridge.lineup_design(df, "row", {"offense": F.col("o"), "defense": F.col("d")}).persist()
    columns = ridge.columns_of(design)
    parts = [ridge.NormalEquations.of(design, df.where(F.col("fold") == k).select("row", "y"), "row", "y", columns) for k in range(4)]
    whole = ridge.NormalEquations.of(design, df.select("row", "y"), "row", "y", columns)
    np.testing.assert_allclose(sum((p.gram for p in parts[1:]), parts[0].gram), whole.gram)
    best = ridge.cross_validated(parts, [{"offense": a, "defense": a} for a in (1.0, 10.0, 1e5)])
    assert best[-1][0]["offense"] == 1e5 and best[0][1] < 0.12


def test_prior_rows_equal_a_centre(league):
    df, _ = league
    spark = df.sparkSession
    design = ridge.lineup_design(df, "row", {"offense": F.col("o")}).withColumn("row", F.col("row").cast("string"))
    response = df.select(F.col("row").cast("string").alias("row"), "y", F.lit(1.0).alias("weight"))
    priors = spark.createDataFrame([("offense", str(k), 0.5) for k in range(20)], "block string, entity string, prior double")
    pseudo = ridge.prior_rows(priors, F.lit(3.0))
    plain = ridge.NormalEquations.of(design, response, "row", "y")
    extra = ridge.NormalEquations.of(pseudo.select("row", "block", "entity", "val"), pseudo.select("row", "y", "weight"), "row", "y", plain.columns)
    np.testing.assert_allclose(extra.gram, 3 * np.eye(20))
    np.testing.assert_allclose(extra.xy, np.full(20, 1.5))


def test_cluster_covariance_is_symmetric(league):
    df, _ = league
    design = ridge.lineup_design(df, "row", {"offense": F.col("o")})
    found = ridge.NormalEquations.of(design, df.select("row", "y"), "row", "y")
    beta, mean = found.solve({"offense": 1.0})
    residual = ridge.predicted(design, ridge.coefficients(df.sparkSession, found.columns, beta), "row", mean).join(df, "row").select("row", "fold", (F.col("y") - F.col("predicted")).alias("r"))
    cov = ridge.sandwich(found, {"offense": 1.0}, ridge.cluster_scores(design, residual, "row", "fold", "r"), "fold")
    assert np.allclose(cov, cov.T) and (np.linalg.eigvalsh(cov) > -1e-12).all()


# resampling and models -----------------------------------------------------------------------------------------------


def test_bootstrap_covers_the_mean_and_reruns(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i // 10, i % 2, rng.gauss(1, 1)) for i in range(4000)], "game int, season int, v double")
    run = lambda df: resample.interval(resample.bootstrap_means(df, ["season"], "game", "v", 100, 3), (), "mean").first()
    got, again = run(rows), run(rows.repartition(5))
    assert got["low"] < 1 < got["high"] and got["se"] == pytest.approx(1 / 4000**0.5, rel=0.4) and got["low"] == pytest.approx(again["low"])
    draws = resample.cluster_draws(rows, ["season"], "game", 50, 3)
    assert draws.agg(F.avg("multiplicity")).first()[0] == pytest.approx(1.0, abs=0.02)


def test_permutation_keeps_values(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("a"), (F.col("id") * 2).alias("b"))
    got = resample.permuted(rows, ["b"], ["id"], 1)
    assert got.count() == 500 and got.agg(F.sum("b")).first()[0] == rows.agg(F.sum("b")).first()[0] and got.where("b <> 2 * id").count() > 400


def test_chronological_split_keeps_games_whole(spark):
    rows = spark.createDataFrame([(g, dt.date(2020, 1, 1 + g // 2), k) for g in range(10) for k in range(3)], "g int, d date, k int")
    got = models.chronological_split(rows, "g", "d", 0.7)
    assert got.where("is_train").select("g").distinct().count() == 6 and got.groupBy("g").agg(F.count_distinct("is_train").alias("n")).where("n > 1").count() == 0


def test_models_learn(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for i in range(800):
        x, z = rng.gauss(0, 1), rng.choice("pq")
        rows.append((i % 4, x, z, int(rng.random() < 1 / (1 + 2.718 ** (-2 * x))), float(rng.random() < 0.5) + (z == "p"), 3 * x + rng.gauss(0, 0.1), 1.0 + i % 3))
    spark.createDataFrame(rows, "fold int, x double, z string, win int, points double, y double, w double").write.parquet(f"{tmp_path}/panel")
    df = spark.read.parquet(f"{tmp_path}/panel")
    win = models.probability(models.win_probability(df, ["x"], "win"), df)
    assert rates.probability_scores(win, [], "win", "p").first()["auc"] > 0.8
    points = models.prediction(models.expected_points(df, ["x"], ["z"], "points"), df).groupBy("z").agg(F.avg("predicted").alias("m"))
    assert dict(values(points, "z", "m"))["p"] > dict(values(points, "z", "m"))["q"] + 0.5
    held = models.out_of_fold(df, "fold", range(4), lambda train: models.weighted_ridge(train, ["x"], "y", "w", 0.01))
    assert held.count() == 800 and rates.fit_scores(held, ["fold"], "y", "predicted").agg(F.min("r2")).first()[0] > 0.9
    assert models.least_error(spark.createDataFrame([("a", 2.0, 3), ("b", 1.0, 9), ("c", 1.0, 4)], "m string, e double, n int"), "e", ["n"])["m"] == "c"


def test_roles_are_ordered_by_size(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(10 * (i % 3 == 0), 0.1), rng.gauss(10 * (i % 3 == 1), 0.1)) for i in range(90)] + [(100 + i, rng.gauss(10, 0.1), 0.0) for i in range(9)]
    got = models.roles(spark.createDataFrame(rows, "id int, a double, b double"), ["id"], ["a", "b"], 2, 3)
    counts = [n for _, n in sorted((r["role"], r["count"]) for r in got.groupBy("role").count().collect())]
    assert counts == sorted(counts, reverse=True) and sum(counts) == 99
    assert got.select(F.max(F.abs(F.col("affinity_0") + F.col("affinity_1") + F.col("affinity_2") - 1))).first()[0] < 1e-9


def test_errors_condition_and_generalized_validation(league):
    df, _ = league
    design = ridge.lineup_design(df, "row", {"offense": F.col("o"), "defense": F.col("d")})
    found = ridge.NormalEquations.of(design, df.select("row", "y"), "row", "y")
    weights = {"offense": 5.0, "defense": 5.0}
    beta, mean = found.solve(weights)
    errors, cov = found.standard_errors(beta, mean, weights)
    assert (errors > 0).all() and np.allclose(cov, cov.T) and errors.max() < 0.1
    assert found.condition({"offense": 100.0, "defense": 100.0}) < found.condition({"offense": 1.0, "defense": 1.0})
    assert found.generalized_error(weights) < found.generalized_error({"offense": 1e6, "defense": 1e6})


def test_played_time_against_official(spark):
    stints = spark.createDataFrame([("g", [1, 2], 0.0, 100.0), ("g", [1, 3], 100.0, 150.0)], "g string, players array<int>, a double, b double")
    played = filters.played_time(stints, ["g"], "players", F.col("a"), F.col("b"))
    official = spark.createDataFrame([("g", 1, 152.0), ("g", 2, 90.0), ("g", 4, 10.0)], "g string, player int, official double")
    assert [(p, gap) for p, gap in values(filters.time_gaps(played, official, ["g"]), "player", "gap", order=("player",))] == [(2, 10.0), (3, 50.0), (4, 10.0)]


def test_owner_agreement_and_texts(spark):
    rows = spark.createDataFrame([("g", i, a, b) for i, (a, b) in enumerate([("x", "x"), ("x", "x"), ("y", "y"), ("y", "z")])] + [("h", 0, "x", "x")], "g string, n int, o string, l string")
    assert values(filters.agreement(rows, ["g"], ["n"], "o", "l"), "g", "agreement", "same_runs", order=("g",)) == [("g", 0.75, False), ("h", 1.0, True)]
    names = spark.createDataFrame([("g", "annlee", 1), ("g", "bobo", 2)], "g string, name_key string, id int")
    texts = spark.createDataFrame([("g", 1, "SUB: Ann Lee FOR Bobo"), ("g", 2, "SUB: Cy FOR Bobo"), ("g", 3, "foul")], "g string, n int, t string")
    assert values(filters.substitutions_from_text(texts, "t", names, ["g"], "id"), "in_id", "out_id", "failure", order=("n",)) == [(1, 2, None), (None, 2, "unknown_name"), (None, None, "no_match")]


def test_spread_between_entities(spark):
    rng = np.random.default_rng(4)
    v = rng.uniform(0.5, 2.0, 3000)
    rows = [(float(rng.normal(0, np.sqrt(1.5 + x))), float(x)) for x in v]
    assert rates.spread_between(spark.createDataFrame(rows, "r double, v double"), "r", "v", 20.0) == pytest.approx(1.5, abs=0.25)
    tiers = spark.createDataFrame([("a", float(i)) for i in range(1, 9)], "t string, x double")
    assert values(rates.tier_targets(tiers, ["t"], "x"), "target") == [(1.5,)]


def test_random_search_holds_groups_out(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i % 20, x := rng.gauss(0, 1), 2 * x + rng.gauss(0, 0.1)) for i in range(300)], "g int, x double, y double")
    got = models.random_search(df, "g", 3, {"strength": [0.001, 100.0]}, 3, lambda train, c: models.weighted_ridge(train, ["x"], "y", None, c["strength"]), "y", seed=2)
    assert got[0][0]["strength"] == 0.001 and got[0][1] < 0.3


def test_control_and_strength_features(spark):
    rows = spark.createDataFrame([(1, 720.0, 100.0, False, 6.0, True, 2160.0), (2, -30.0, 0.0, True, 6.0, False, 3000.0), (3, None, 5.0, False, 6.0, None, None)], "i int, remaining double, left double, overtime boolean, gap double, home boolean, elapsed double")
    to_play = s.seconds_to_play(F.col("remaining"), F.col("left"), F.col("overtime"))
    found = {"to_play": to_play} | s.fading_features({"gap": F.col("gap")}, to_play) | s.control_features(F.col("home"), F.col("elapsed"), to_play)
    got = [tuple(r) for r in rows.orderBy("i").select(*[F.round(c, 6).alias(k) for k, c in found.items()]).collect()]
    assert got == [(720.0, 6.0, 3.0, 1.0, round(13**-0.5, 6), 0.75), (0.0, 6.0, 0.0, -1.0, -1.0, -1.0), (None, 6.0, None, None, None, None)]


def test_two_parameters_of_large_keys(spark):
    """The products of the sums of such keys pass 64 bits."""
    big = 3_000_000_000
    rows = [(k, big + i, 2.5 * i + k) for k in (1, 2) for i in range(50)] + [(3, 7, 1.0), (1, None, 5.0), (2, 5, None)]
    got = {r["k"]: (r["slope"], r["intercept"]) for r in ridge.two_parameters(spark.createDataFrame(rows, "k int, x bigint, y double"), ["k"], "x", "y").collect()}
    assert all(got[k] == pytest.approx((2.5, k - 2.5 * big)) for k in (1, 2)) and got[3] == (None, None)


def test_a_margin_on_the_bound_is_undecided(spark):
    """Forty times 0.1 add up to more than 4 in doubles."""
    rows = spark.createDataFrame([("g", 1, i, 0.1) for i in range(60)], "g string, p int, i int, v double")
    kept = ordered.without_decided(rows, ["g"], "p", ["i"], F.col("v"), {1: 4}, slope=0.0).select("i").collect()
    assert max(r["i"] for r in kept) == 40 and len(kept) == 41


def test_a_coefficient_of_every_row_is_not_dealt_to_one_task(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        design = spark.range(1000).select(F.col("id").alias("row"), F.lit("b").alias("block"), F.lit("e").alias("entity"), F.lit(2.0).alias("val"))
        out = ridge.predicted(design, spark.createDataFrame([("b", "e", 0.5)], "block string, entity string, beta double"), "row", 1.0)
        assert "SortMergeJoin" not in out._jdf.queryExecution().toString()
        assert {(r["predicted"], r["unknown"]) for r in out.collect()} == {(2.0, 0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_replay_streams_a_key_of_many_moments(spark):
    """Moments are not gathered into one value a key, and the state lives on from batch to batch."""
    starters = spark.createDataFrame([("a", [1, 2, 3, 4, 5]), ("b", [1, 2, 3, 4, 5])], "k string, players array<int>")
    rows = spark.range(30_000).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.array(F.when(F.col("id") % 2 == 0, 1).otherwise(6)).alias("outs"), F.array(F.when(F.col("id") % 2 == 0, 6).otherwise(1)).alias("ins"))
    moments = rows.unionByName(rows.limit(1).withColumn("k", F.lit("no starters")))
    out = filters.replay_lineups(starters, moments, ["k"], "t")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = {r["k"]: r.asDict() for r in out.groupBy("k").agg(F.count("*").alias("n"), F.max("stint").alias("last"), F.count_if(~F.col("ok")).alias("wrong"), F.max("end").alias("end")).collect()}
    assert got == {"a": {"k": "a", "n": 30_001, "last": 30_000, "wrong": 0, "end": 29_999}, "b": {"k": "b", "n": 1, "last": 0, "wrong": 0, "end": None}}


def test_a_large_group_is_paired_by_many_tasks(spark):
    df = spark.range(400).select(F.lit(1).alias("team"), F.col("id").alias("p")).unionByName(spark.createDataFrame([(None, 7), (None, 8), (2, 9)], "team int, p bigint"))
    out = joins.teammates(df.unionByName(df), ["team"], "p")
    assert out.select(F.spark_partition_id().alias("n")).distinct().count() > 20
    assert out.where("team = 1").count() == 400 * 399 == out.where("team = 1").distinct().count()
    assert sorted(tuple(r) for r in out.where("team is null or team = 2").collect()) == [(None, 7, 8), (None, 8, 7)]
