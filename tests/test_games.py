"""Builders over game feeds on frames with known answers."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventloom import checks, contracts
from eventloom.plans import games


def test_states_of_sparse_scores(spark):
    events = spark.createDataFrame([(22300001, 1, 1, "PT12M00.00S", None, None), (22300001, 2, 1, "PT11M30.00S", 2.0, 0.0), (22300001, 3, 1, "PT11M00.00S", None, None)], "gameId long, actionId long, period int, clock string, scoreHome double, scoreAway double")
    dim = spark.createDataFrame([("0022300001", 2, 0)], "game_id string, home_score long, away_score long")
    got = games.event_states(events, dim).orderBy("actionId").collect()
    assert [r["home_score_after"] for r in got] == [0, 2, 2] and [r["points_added"] for r in got] == [0, 2, 0]
    assert [r["is_terminal_event"] for r in got] == [False, False, True] and [r["seconds_elapsed_game"] for r in got] == [0, 30, 60]
    stale = games.event_states(events, dim.withColumn("home_score", F.lit(3).cast("long"))).orderBy("actionId").collect()
    assert [r["home_score_after"] for r in stale] == [0, 2, 3]
    with pytest.raises(contracts.ContractError):
        games.event_states(events.union(events), dim)


def test_scoring_events_skip_sentinels_and_stale_rows(spark):
    rows = [(1, 1, 0, 0), (1, 2, 2, 0), (1, 3, 0, 0), (1, 4, 2, 3), (1, 5, 1, 3), (1, 6, 4, 3), (1, 7, 2, 0)]
    events = spark.createDataFrame(rows, "gameId long, actionId long, scoreHome int, scoreAway int")
    finals = spark.createDataFrame([("0000000001", 4, 3)], "game_id string, home_final int, away_final int")
    got = [(r["actionId"], r["home_points"], r["away_points"], r["is_correction"]) for r in games.scoring_events(events, finals).orderBy("actionId").collect()]
    assert got == [(2, 2, 0, False), (4, 0, 3, False), (5, -1, 0, True), (6, 3, 0, False)]


@pytest.mark.parametrize("final, points, repaired", [(2, [0.0, 2.0], 1), (1, [0.0, 0.0], 0)])
def test_gaps_are_filled_only_if_proven(spark, final, points, repaired):
    actions = spark.createDataFrame([("g", 1, 11, 1, "PT12M", 0, 0), ("g", 2, 12, 1, "PT11M", 0, 0)], "game_id string, orderNumber long, actionNumber long, period int, clock string, scoreHome long, scoreAway long")
    states = spark.createDataFrame([("g", 12, 1, "PT11M", 2.0, 0.0)], "game_id string, actionNumber long, period int, clock string, home_points_added double, away_points_added double")
    dim = spark.createDataFrame([("g", final, 0)], "game_id string, home_score long, away_score long")
    got = games.reconciled_points(actions, states, dim).orderBy("orderNumber").collect()
    assert [r["home_points_added"] for r in got] == points and sum(r["is_repaired"] for r in got) == repaired


def test_possessions_by_order_not_by_number(spark):
    rows = [(40, 1, 1, 2, 0.0, 2.0, "s1"), (10, 99, 1, 1, 3.0, 0.0, "s1"), (30, 98, 1, 1, 1.0, 0.0, "s2"), (20, 50, 1, 0, 3.0, 0.0, "s1"), (35, 3, 1, None, 0.0, 0.0, "s2")]
    actions = spark.createDataFrame([("g", o, n, p, own, h, a, s, float(o), h + a, 1, 2) for o, n, p, own, h, a, s in rows], "game_id string, orderNumber long, actionNumber long, period int, possession long, home_points_added double, away_points_added double, ordinal_stint_id string, seconds_elapsed_game double, points_added double, home_team_id long, away_team_id long")
    whole, segments = games.possessions(actions)
    got = whole.orderBy("possession_number").collect()
    assert [r["points"] for r in got] == [7.0, 2.0] and [r["start_action_number"] for r in got] == [99, 1] and [r["lineup_segment_count"] for r in got] == [2, 1]
    assert segments.agg(F.sum("points")).first()[0] == 9.0 and [r["possession_segment_id"] for r in segments.orderBy("possession_segment_id").collect()] == ["g:001:s01", "g:001:s02", "g:002:s01"]


def test_context_is_causal(spark):
    schema = "possession_id string, game_id string, possession_number int, period int, start_seconds_elapsed double, offense_is_home boolean, points double, home_points double, away_points double"
    rows = [("p1", "g", 1, 1, 0.0, True, 2.0, 2.0, 0.0), ("p2", "g", 2, 1, 20.0, False, 0.0, 0.0, 0.0), ("p3", "g", 3, 5, 2887.0, True, 3.0, 3.0, 0.0)]
    run = lambda r: [tuple(x)[3:6] for x in games.possession_context(spark.createDataFrame(r, schema)).orderBy("possession_number").collect()]
    assert run(rows) == [(0.0, 0.0, 720.0), (2.0, -2.0, 700.0), (0.0, 2.0, 293.0)]
    assert run([rows[0], (*rows[1][:6], 3.0, 0.0, 3.0), rows[2]])[:2] == run(rows)[:2]
    with pytest.raises(contracts.ContractError):
        games.possession_context(spark.createDataFrame([("p", "g", 1, 1, 0.0, True, 2.0, 1.0, 0.0)], schema))


def test_legacy_quarantine(spark):
    columns = ["gameid", "num", "period", "pts", *[f"h{k}" for k in range(1, 6)], *[f"a{k}" for k in range(1, 6)]]
    rows = [("g1", 1, 1, 2, 1, 1, 3, 4, 5, 6, 7, 8, 9, 10), ("g1", 2, 1, 0, *range(1, 11)), ("g2", 1, 1, 0, *range(1, 11))]
    df = spark.createDataFrame(rows, columns)
    clean, ledger = checks.quarantine(df, ["gameid"], games.legacy_rules([f"h{k}" for k in range(1, 6)], [f"a{k}" for k in range(1, 6)]))
    assert [r["gameid"] for r in clean.collect()] == ["g2"] and [tuple(r) for r in ledger.collect()] == [("g1", 1, "repeated_player")]


def test_matchups_are_centred_and_signed(spark):
    schema = "game_id long, person_id long, matchups_person_id long, partial_possessions double, player_points double, matchup_field_goals_made double, matchup_field_goals_attempted double, matchup_three_pointers_made double, matchup_free_throws_made double"
    rows = [(1, 10, 1, 50.0, 20.0, 10.0, 20.0, 0.0, 0.0), (1, 10, 2, 50.0, 60.0, 30.0, 40.0, 0.0, 0.0), (1, 11, 1, 40.0, 20.0, 10.0, 20.0, 0.0, 0.0), (1, 11, 2, 60.0, 60.0, 30.0, 50.0, 0.0, 0.0)]
    got = {r["PLAYER_ID"]: r for r in games.matchup_defense(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["saved_p100"] > 0 > got[2]["saved_p100"] and abs(got[1]["saved"] + got[2]["saved"]) < 1e-12
    assert 0 < got[1]["saved_p100_shrunk"] < got[1]["saved_p100"]
    with pytest.raises(contracts.ContractError):
        games.matchup_defense(spark.createDataFrame([(1, 10, 1, 50.0, 21.0, *rows[0][5:])], schema))


def test_shooting_over_the_mix(spark):
    box = spark.createDataFrame([(1, 2024, 1000.0, 100.0, 40.0, 10.0), (2, 2024, 1000.0, 80.0, 40.0, 0.0), (3, 2024, 10.0, 0.0, 5.0, 0.0)], "PLAYER_ID int, Season int, Minutes double, PTS double, FGA double, FTA double")
    kinds = spark.createDataFrame([(1, 2024, "iso", 60.0, 60.0, 50.0, 0.1), (2, 2024, "cut", 60.0, 80.0, 50.0, None)], "PLAYER_ID int, Season int, playtype string, Poss double, Points double, FGA double, free_throw_share double")
    got = {r["PLAYER_ID"]: r for r in games.playtype_shooting(box, kinds).collect()}
    assert set(got) == {1, 2} and got[2]["ExpectedTS"] == pytest.approx(80.0) and got[1]["TS"] == pytest.approx(100 * 100 / (2 * 44.4))
    assert all(r["zTS"] == pytest.approx(r["rTS"] + r["Difficulty"]) for r in got.values())


def test_dates_weights_and_dimensions(spark):
    days = spark.createDataFrame([(2020, dt.date(2020, 8, 20)), (2020, dt.date(2020, 5, 1)), (2019, dt.date(2019, 5, 1)), (2019, None)], "s int, d date")
    assert [r[0] for r in days.select(games.in_playoffs(F.col("s"), F.col("d"))).collect()] == [True, False, True, False]
    weighted = games.recency_weights(spark.createDataFrame([(1, 2023, 1), (2, 2024, 1), (3, 2024, 2)], "g int, s int, n int"), "s", ["n", "g"], 0.1, 0.5)
    assert [round(r["weight"], 4) for r in weighted.orderBy("g").collect()] == [0.5, 0.9048, 1.0]
    a = spark.createDataFrame([(22300001, None), (22300002, dt.date(2024, 1, 2))], "game_id long, game_date date")
    b = spark.createDataFrame([(22300001, dt.date(2024, 1, 1), 5), (22300002, dt.date(2024, 1, 3), 6)], "game_id long, game_date date, x int")
    got = games.game_dimension([a, b]).orderBy("game_id").collect()
    assert [(r["game_date"], r["date_conflicts"], r["game_type"]) for r in got] == [(dt.date(2024, 1, 1), 0, "regular"), (dt.date(2024, 1, 2), 1, "regular")]
    logs = spark.createDataFrame([(1, "2024-01-01", 7, "AAA vs. BBB", 100), (1, "2024-01-01", 8, "BBB @ AAA", 90)], "GAME_ID long, GAME_DATE string, TEAM_ID int, MATCHUP string, PTS int")
    assert tuple(games.team_rows_to_games(logs).first()) == ("0000000001", "2024-01-01", 7, 8, 100, 90, 2, 10)


def test_pooled_features(spark):
    box = spark.createDataFrame([(1, 2022, 100.0, 20.0, 5.0, 10.0, 0.4), (1, 2023, 300.0, 40.0, 9.0, 10.0, None), (1, 2020, 999.0, 1.0, 1.0, 1.0, 1.0)], "p int, y int, poss double, ast double, m double, a double, r double")
    got = games.pooled_features(box, ["p"], "y", [2023, 2024], 3, {"ast_100": "ast"}, "poss", {"pct": ("m", "a")}, {"mean": "r"}).orderBy("window_end").collect()
    assert [tuple(r) for r in got] == [(1, 2023, 400.0, 15.0, 0.7, 0.4), (1, 2024, 400.0, 15.0, 0.7, 0.4)]
    load = games.offensive_load(spark.createDataFrame([(1000.0, 250.0, 60.0, 30.0, 200.0, 50.0, 60.0, 0.36), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None)], "OffPoss double, PTS double, AST double, TOV double, FGA double, FTA double, FG3A double, FG3_PCT double")).collect()
    assert 0 < load[0]["cTOV_pct"] < 0.2 and load[1]["Load"] is None
    people = spark.createDataFrame([(1,), (2,), (3,)], "p int")
    seen = games.complete_exposure(spark.createDataFrame([(2023, [1, 2]), (2023, [1, 2])], "s int, l array<int>"), "s", F.col("l"), people, [2023, 2024], "p")
    assert seen.count() == 6 and seen.agg(F.sum("possessions")).first()[0] == 4


def test_single_feed_rates(spark):
    box = spark.createDataFrame([(1, 2024, 1000.0, 60.0), (2, 2024, 0.0, 10.0)], "p int, s int, poss double, ast double")
    feed = spark.createDataFrame([(1, 2024, 30.0, 10.0, 20.0), (1, 2024, 20.0, 10.0, 20.0), (2, 2024, 5.0, 8.0, 10.0)], "p int, s int, deflections double, m double, t double")
    got = {r["p"]: r for r in games.feed_rates(feed, box, ["p", "s"], "poss", {"deflections_100": "deflections"}, {"pct": ("m", "t")}).collect()}
    assert got[1]["deflections_100"] == 5.0 and got[1]["pct"] == 0.5 and got[2]["deflections_100"] is None
    saved = {r["p"]: r["saved_per_100"] for r in games.shots_saved(feed, box, ["p", "s"], "s", "m", "t", "poss").collect()}
    assert saved[1] == pytest.approx(100 * 2 * (28 / 50 * 40 - 20) / 1000)
    rolled = games.team_rollup(spark.createDataFrame([(1, 2.0)], "p int, r double"), spark.createDataFrame([(1, "t", 30.0), (9, "t", 10.0)], "p int, team string, min double"), "p", ["team"], "r", "min").first()
    assert tuple(rolled) == ("t", 7.5, 0.75)


def test_passers_rate_higher_with_more_assists(spark):
    rows = [(k, 1000.0, 250.0, a, 30.0, 200.0, 50.0, 60.0, 0.36, 60.0) for k, a in ((1, 20.0), (2, 90.0))]
    box = spark.createDataFrame(rows, "p int, OffPoss double, PTS double, AST double, TOV double, FGA double, FTA double, FG3A double, FG3_PCT double, AtRimFGA double")
    got = {r["p"]: r["PasserRating"] for r in games.passer_rating(games.offensive_load(box), F.lit(78.0)).collect()}
    assert 0 <= got[1] < got[2] <= 11.3
