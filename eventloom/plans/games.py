"""Builders over game feeds: score states, possessions, context, matchups, shooting, weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import checks
from ..contracts import ContractError
from ..functions.scalars import elapsed_seconds, game_type, holds, iso_seconds, lineups_overlap, padded_id, ratio
from ..operators import ordered, rates

#: The weight of a free throw in shooting attempts; seasons whose playoffs fell on other days, and the usual ones.
FREE_THROW = 0.44
PLAYOFFS = {1999: ("05-08", "06-25"), 2012: ("04-28", "06-21"), 2020: ("08-17", "10-11"), 2021: ("05-22", "07-20")}
USUAL_PLAYOFFS = ("04-12", "06-30")


def game_dimension(feeds: Sequence[DataFrame]) -> DataFrame:
    """Left joins of per-game feeds (each with game_id and game_date) on the first one; the first date there wins, conflicts are counted."""
    out = feeds[0].withColumn("game_id", padded_id(F.col("game_id"))).withColumn("date_conflicts", F.lit(0))
    for k, feed in enumerate(feeds[1:]):
        other = checks.unique_gate(feed.withColumn("game_id", padded_id(F.col("game_id"))), ["game_id"], f"feed {k + 1}").withColumnRenamed("game_date", "_date")
        out = checks.checked_join(out, other, ["game_id"], validate="one_to_one")
        conflict = holds(F.col("game_date") != F.col("_date")).cast("int")
        out = out.withColumn("date_conflicts", F.col("date_conflicts") + conflict).withColumn("game_date", F.coalesce("game_date", "_date")).drop("_date")
    return out.withColumn("game_type", game_type(F.col("game_id")))


def event_states(events: DataFrame, games: DataFrame) -> DataFrame:
    """Score before and after every event of sparse-score feeds; the last row takes the game's final score.

    events: gameId, actionId, period, clock, scoreHome, scoreAway; games: game_id, home_score, away_score.
    """
    rows = events.withColumn("game_id", padded_id(F.col("gameId")))
    checks.unique_gate(rows, ["game_id", "actionId"], "events")
    rows = checks.checked_join(rows, games.select("game_id", F.col("home_score").cast("double").alias("home_final"), F.col("away_score").cast("double").alias("away_final")), ["game_id"], "inner")
    last = F.row_number().over(Window.partitionBy("game_id").orderBy(F.desc("actionId"))) == 1
    for side, raw in (("home", "scoreHome"), ("away", "scoreAway")):
        rows = rows.withColumn(f"{side}_score_after", F.when(last, F.col(f"{side}_final")).otherwise(F.col(raw).try_cast("double")))
    for side in ("home", "away"):
        rows = ordered.state_changes(rows, ["game_id"], ["actionId"], f"{side}_score_after").withColumnsRenamed({f"{side}_score_after_before": f"{side}_score_before", f"{side}_score_after_change": f"{side}_points_added", f"{side}_score_after_corrected": f"{side}_corrected"})
    remaining = iso_seconds(F.col("clock"))
    return rows.withColumns({
        "event_id": F.concat_ws(":", "game_id", F.col("actionId").cast("string")), "seconds_elapsed_game": elapsed_seconds(F.col("period"), remaining),
        "points_added": F.col("home_points_added") + F.col("away_points_added"), "is_corrected": F.col("home_corrected") | F.col("away_corrected"),
    }).withColumnRenamed("is_last", "is_terminal_event").drop("home_corrected", "away_corrected", "home_final", "away_final")


def scoring_events(events: DataFrame, finals: DataFrame | None = None, most_stale: int = 5) -> DataFrame:
    """Rows that change the score: game_id, n, points of both sides, corrections.

    A score of 0:0 means that no score was given.  finals (game_id, home_final, away_final): rows after the last one with
    the final score are stale if they are few.
    """
    known = F.col("scoreHome").isNotNull() & F.col("scoreAway").isNotNull() & ((F.col("scoreHome") != 0) | (F.col("scoreAway") != 0))
    rows = events.withColumn("game_id", padded_id(F.col("gameId"))).where(known)
    if finals is not None:
        rows = checks.checked_join(rows, finals, ["game_id"])
        final = holds((F.col("scoreHome") == F.col("home_final")) & (F.col("scoreAway") == F.col("away_final")))
        rows = ordered.trim_stale_tail(rows, ["game_id"], ["actionId"], final, most_stale).drop("home_final", "away_final")
    step = Window.partitionBy("game_id").orderBy("actionId")
    change = lambda c: F.col(c) - F.coalesce(F.lag(c).over(step), F.lit(0))
    out = rows.withColumns({"home_points": change("scoreHome"), "away_points": change("scoreAway")}).where("home_points <> 0 or away_points <> 0")
    return out.withColumn("is_correction", (F.col("home_points") < 0) | (F.col("away_points") < 0))


def reconciled_points(actions: DataFrame, states: DataFrame, games: DataFrame) -> DataFrame:
    """Points of ordered actions from their running scores; a gap to the final score is filled from a second feed only if
    the rows of it that agree in period and clock make up just that gap.

    actions: game_id, orderNumber, actionNumber, period, clock, scoreHome, scoreAway; states: game_id, actionNumber, period,
    clock, home_points_added, away_points_added; games: game_id, home_score, away_score.
    """
    step = Window.partitionBy("game_id").orderBy("orderNumber")
    out = actions
    for side, raw in (("home", "scoreHome"), ("away", "scoreAway")):
        out = out.withColumn(f"own_{side}", (F.col(raw) - F.coalesce(F.lag(raw).over(step), F.lit(0))).cast("double"))
    at = F.struct("period", "clock")
    second = states.groupBy("game_id", "actionNumber").agg(F.min(at).alias("_at"), F.sum("home_points_added").alias("other_home"), F.sum("away_points_added").alias("other_away"))
    out = checks.checked_join(out, second, ["game_id", "actionNumber"], validate="one_to_one")
    aligned = holds((F.col("_at.period") == F.col("period")) & (F.col("_at.clock") == F.col("clock")))
    more = {s: F.when(aligned, F.greatest(F.col(f"other_{s}") - F.col(f"own_{s}"), F.lit(0.0))).otherwise(0.0) for s in ("home", "away")}
    out = out.withColumns({f"more_{s}": v for s, v in more.items()})
    totals = out.groupBy("game_id").agg(*[F.sum(f"more_{s}").alias(f"can_{s}") for s in more], F.max_by("scoreHome", "orderNumber").alias("end_home"), F.max_by("scoreAway", "orderNumber").alias("end_away"))
    gaps = totals.join(games, "game_id").select("game_id", *[((F.col(f"{s}_score") - F.col(f"end_{s}") > 0) & (F.col(f"can_{s}") == F.col(f"{s}_score") - F.col(f"end_{s}"))).alias(f"fill_{s}") for s in more])
    out = out.join(gaps, "game_id", "left")
    points = {f"{s}_points_added": F.col(f"own_{s}") + F.when(holds(F.col(f"fill_{s}")), F.col(f"more_{s}")).otherwise(0.0) for s in more}
    filled = F.lit(False)
    for s in more:
        filled = filled | (holds(F.col(f"fill_{s}")) & (F.col(f"more_{s}") > 0))
    out = out.withColumns(points).withColumn("is_repaired", filled).withColumn("points_added", F.col("home_points_added") + F.col("away_points_added"))
    return out.drop("_at", *[f"{p}_{s}" for p in ("own", "other", "more", "fill") for s in more])


def possessions(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(possessions, their lineup segments) from actions with an owner and an ordinal stint.

    An action of neither team belongs to the side that scores on it, or to none and goes.  A new possession starts where
    game, period or owner changes, a new segment also where the stint does; points add up on both levels.
    """
    home, away, owner = F.col("home_team_id"), F.col("away_team_id"), F.col("possession")
    scorer = F.when(F.col("home_points_added") > 0, home).when(F.col("away_points_added") > 0, away)
    rows = actions.withColumn("possession", F.when(owner.isin(home, away), owner).otherwise(F.coalesce(F.when(F.col("away_points_added") > 0, away), scorer)))
    rows = rows.where(F.col("possession").isNotNull())
    rows = ordered.number_runs(rows, ["game_id"], ["orderNumber"], ["period", "possession"], "possession_number")
    rows = ordered.number_runs(rows, ["game_id", "possession_number"], ["orderNumber"], ["ordinal_stint_id"], "segment_number")
    number = lambda c, width: F.format_string(f"%0{width}d", F.col(c).cast("long"))
    rows = rows.withColumn("possession_id", F.concat_ws(":", "game_id", number("possession_number", 3)))
    at = F.col("orderNumber")
    ends = lambda c, name: [F.min_by(c, at).alias(f"start_{name}"), F.max_by(c, at).alias(f"end_{name}")]
    shared = [F.min("period").alias("period"), *ends("orderNumber", "order_number"), *ends("actionNumber", "action_number"), *ends("seconds_elapsed_game", "seconds_elapsed"), F.min("possession").alias("offense_team_id"), F.sum("points_added").alias("points"), F.count("*").alias("action_count")]
    whole = rows.groupBy("possession_id", "game_id", "possession_number").agg(*shared, F.min(home).alias("home_team_id"), F.min(away).alias("away_team_id"), F.sum("home_points_added").alias("home_points"), F.sum("away_points_added").alias("away_points"), F.max("segment_number").alias("lineup_segment_count"))
    offense_is_home = F.col("offense_team_id") == F.col("home_team_id")
    whole = whole.withColumn("offense_is_home", offense_is_home).withColumn("defense_team_id", F.when(offense_is_home, F.col("away_team_id")).otherwise(F.col("home_team_id")))
    segments = rows.groupBy("possession_id", "game_id", "possession_number", "segment_number").agg(*shared, F.min_by("ordinal_stint_id", at).alias("ordinal_stint_id"))
    return whole, segments.withColumn("possession_segment_id", F.concat(F.col("possession_id"), F.lit(":s"), number("segment_number", 2)))


def possession_context(rows: DataFrame) -> DataFrame:
    """What is known when a possession starts: score difference, last points, time left.  Nothing of it or later."""
    bad = rows.where(F.abs(F.col("home_points") + F.col("away_points") - F.col("points")) > 1e-9).limit(1).count()
    if bad:
        raise ContractError("points of both sides don't add up to the possession's")
    known = ordered.prefix_context(rows, ["game_id"], ["possession_number"], "points")
    for side in ("home", "away"):
        known = known.withColumn(f"{side}_start", F.coalesce(F.sum(f"{side}_points").over(ordered.before(["game_id"], ["possession_number"])), F.lit(0.0)))
    margin = F.col("home_start") - F.col("away_start")
    end = F.when(F.col("period") <= 4, F.col("period") * 720.0).otherwise(2880.0 + (F.col("period") - 4) * 300.0)
    return known.select(
        "possession_id", "game_id", "possession_number", F.col("previous_points").alias("previous_possession_points"),
        F.when(F.col("offense_is_home"), margin).otherwise(-margin).alias("offense_score_diff_start"), (end - F.col("start_seconds_elapsed")).alias("seconds_remaining_period_start"), "is_first",
    )


def legacy_rules(home: Sequence[str], away: Sequence[str]) -> dict[str, Column]:
    """What makes a row of the legacy possession table bad."""
    players = [F.col(c) for c in (*home, *away)]
    return {
        "missing_player": F.array_contains(F.transform(F.array(*players), lambda x: x.isNull()), True),
        "repeated_player": F.size(F.array_distinct(F.array(*players))) < len(players),
        "overlap": lineups_overlap(home, away),
        "points": ~F.col("pts").between(0, 10),
        "period": F.col("period") < 1,
    }


def team_rows_to_games(rows: DataFrame) -> DataFrame:
    """One row a game from one a team: MATCHUP is "AAA vs. BBB" at home and "AAA @ BBB" away."""
    at_home = F.col("MATCHUP").contains(" vs. ")
    side = lambda c, home: F.max(F.when(at_home == home, F.col(c)))
    out = rows.groupBy(padded_id(F.col("GAME_ID")).alias("game_id")).agg(F.min("GAME_DATE").alias("game_date"), side("TEAM_ID", True).alias("home_team_id"), side("TEAM_ID", False).alias("away_team_id"), side("PTS", True).alias("home_score"), side("PTS", False).alias("away_score"), F.count("*").alias("n_teams"))
    return out.withColumn("home_margin", F.col("home_score") - F.col("away_score"))


def matchup_defense(frame: DataFrame, prior_possessions: float = 500.0, prior_attempts: float = 200.0) -> DataFrame:
    """Points a defender saves against what each scorer makes elsewhere: per 100 possessions, centred, shrunk.

    frame: game_id, person_id (scorer), matchups_person_id (defender), partial_possessions, player_points, made and tried
    shots.  Rows must be unique and points must add up.
    """
    made, threes = F.col("matchup_field_goals_made"), F.col("matchup_three_pointers_made")
    wrong = frame.where(F.col("game_id").isNull() | F.col("person_id").isNull() | F.col("matchups_person_id").isNull() | (F.col("partial_possessions") < 0) | (F.abs(2 * made + threes + F.col("matchup_free_throws_made") - F.col("player_points")) > 1e-9)).limit(1).count()
    if wrong or checks.duplicate_keys(frame, ["game_id", "person_id", "matchups_person_id"]).limit(1).count():
        raise ContractError("matchups fail identity or conservation")
    pairs = frame.where("partial_possessions > 0").groupBy("person_id", "matchups_person_id").agg(F.sum("partial_possessions").alias("possessions"), F.sum("player_points").alias("points"), F.sum(made + 0.5 * threes).alias("made"), F.sum("matchup_field_goals_attempted").alias("attempts"))
    league = pairs.agg(ratio(F.sum("points"), F.sum("possessions")).alias("ppp"), ratio(F.sum("made"), F.sum("attempts")).alias("efg"))
    expected = rates.with_group(rates.leave_one_out(pairs, ["person_id"], "points", "possessions", "expected_rate"), league, ())
    expected = expected.withColumn("saved", F.coalesce("expected_rate", "ppp") * F.col("possessions") - F.col("points"))
    defenders = expected.groupBy("matchups_person_id").agg(*[F.sum(c).alias(c) for c in ("possessions", "points", "saved", "made", "attempts")], F.max("efg").alias("efg"))
    offset = defenders.agg(ratio(F.sum("saved"), F.sum("possessions")).alias("offset"))
    out = rates.with_group(defenders, offset, ()).withColumn("saved", F.col("saved") - F.col("offset") * F.col("possessions"))
    per = 100.0 * ratio(F.col("saved"), F.col("possessions"))
    return out.select(
        F.col("matchups_person_id").alias("PLAYER_ID"), "possessions", "saved", (100.0 * ratio(F.col("points"), F.col("possessions"))).alias("allowed_p100"), per.alias("saved_p100"),
        (F.col("possessions") / (F.col("possessions") + prior_possessions) * per).alias("saved_p100_shrunk"), (100.0 * (F.col("made") + prior_attempts * F.col("efg")) / (F.col("attempts") + prior_attempts)).alias("efg_allowed_shrunk"),
    )


def true_shooting(points: Column, attempts: Column, free_throws: Column) -> Column:
    return 100 * ratio(points, 2 * (attempts + FREE_THROW * free_throws))


def playtype_shooting(box: DataFrame, playtypes: DataFrame, least_minutes: float = 250.0, least_possessions: float = 50.0, least_league: float = 20.0) -> DataFrame:
    """True shooting over what a player's mix of play types would give the league.

    box: PLAYER_ID, Season, Minutes, PTS, FGA, FTA; playtypes: PLAYER_ID, Season, playtype, Poss, Points, FGA, free_throw_share.
    """
    league = box.groupBy("Season").agg(true_shooting(F.sum("PTS"), F.sum("FGA"), F.sum("FTA")).alias("League_TS"))
    tried = playtypes.withColumns({"_fta": 2 * F.coalesce("free_throw_share", F.lit(0.0)) * F.col("Poss"), "_fga": F.coalesce("FGA", F.lit(0.0))})
    kinds = tried.where(F.col("Poss") >= least_league).groupBy("Season", "playtype").agg(true_shooting(F.sum("Points"), F.sum("_fga"), F.sum("_fta")).alias("_ts"))
    mix = tried.join(kinds, ["Season", "playtype"], "left").groupBy("PLAYER_ID", "Season").agg(F.sum("Poss").alias("SynPoss"), ratio(F.sum(F.col("Poss") * F.coalesce("_ts", F.lit(0.0))), F.sum("Poss")).alias("ExpectedTS"))
    out = box.where(F.col("Minutes") >= least_minutes).join(mix.where(F.col("SynPoss") >= least_possessions), ["PLAYER_ID", "Season"]).join(league, "Season")
    ts = true_shooting(F.col("PTS"), F.col("FGA"), F.col("FTA"))
    return out.select("PLAYER_ID", "Season", "Minutes", "SynPoss", ts.alias("TS"), "League_TS", "ExpectedTS", (ts - F.col("League_TS")).alias("rTS"), (F.col("League_TS") - F.col("ExpectedTS")).alias("Difficulty"), (ts - F.col("ExpectedTS")).alias("zTS"))


def offensive_load(box: DataFrame) -> DataFrame:
    """Creation, load and turnovers per load from totals (published formulas; their weights are fixed values)."""
    per = lambda c: 100 * ratio(F.col(c), F.col("OffPoss"))
    three = (2 / (1 + F.exp(-per("FG3A"))) - 1) * F.coalesce("FG3_PCT", F.lit(0.0))
    use = per("PTS") + per("TOV")
    rows = box.withColumns({"ThreePtP": three, "_ast": per("AST"), "_use": use})
    rows = rows.withColumn("Creation", 0.1843 * F.col("_ast") + 0.0969 * F.col("_use") - 2.3021 * F.col("ThreePtP") + 0.0582 * F.col("_ast") * F.col("_use") * F.col("ThreePtP") - 1.1942)
    rows = rows.withColumn("Load", F.col("_ast") - 0.38 * 0.75 * F.col("Creation") + per("FGA") + FREE_THROW * per("FTA") + F.col("Creation") + per("TOV"))
    return rows.withColumn("cTOV_pct", ratio(per("TOV"), F.col("Load"))).drop("_ast", "_use")


def in_playoffs(season: Column, date: Column) -> Column:
    """Whether a date lies in its season's playoffs."""
    day = lambda k: F.to_date(F.concat_ws("-", season.cast("string"), _by_season(season, k)))
    return holds(date.between(day(0), day(1)))


def _by_season(season: Column, k: int) -> Column:
    out = F.lit(USUAL_PLAYOFFS[k])
    for year, days in PLAYOFFS.items():
        out = F.when(season == year, F.lit(days[k])).otherwise(out)
    return out


def recency_weights(games: DataFrame, season: str, order: Sequence[str], within: float | None, across: float | None) -> DataFrame:
    """Adds weight = exp(-within * games until the season's last) * across^(seasons until the last)."""
    later = Window.partitionBy(season).orderBy(*[F.desc(o) for o in order])
    weight = F.lit(1.0)
    if within is not None:
        weight = weight * F.exp(-within * (F.row_number().over(later) - 1))
    if across is not None:
        last = games.agg(F.max(season)).first()[0]
        weight = weight * F.pow(F.lit(across), F.lit(last) - F.col(season))
    return games.withColumn("weight", weight)


def pooled_features(box: DataFrame, keys: Sequence[str], period: str, ends: Sequence[int], span: int, counts: Mapping[str, str], exposure: str, ratios: Mapping[str, tuple[str, str]], means: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """Rates per 100 of pooled counts, ratios of pooled sums, and exposure-weighted means, by window.

    counts: name -> column; ratios: name -> (numerator, denominator); means: name -> column.
    """
    held = box.withColumns({f"_w_{n}": F.when(F.col(c).isNotNull() & (F.col(exposure) > 0), F.col(exposure)) for n, c in means.items()} | {f"_x_{n}": F.col(c) * F.col(exposure) for n, c in means.items()})
    sums = sorted({exposure, *counts.values(), *(c for r in ratios.values() for c in r)}) + [f"_{p}_{n}" for n in means for p in "wx"]
    out = rates.per_exposure(rates.pooled(held, keys, period, ends, span, sums), dict(counts), exposure)
    out = out.withColumns({n: ratio(F.col(a), F.col(b)) for n, (a, b) in ratios.items()} | {n: ratio(F.col(f"_x_{n}"), F.col(f"_w_{n}")) for n in means})
    return out.select(*keys, "window_end", exposure, *counts, *ratios, *means)


def complete_exposure(lineups: DataFrame, season: str, players: Column, people: DataFrame, seasons: Sequence[int], person: str) -> DataFrame:
    """Possessions of every person in every one of a few seasons, zero where there are none."""
    seen = lineups.select(season, F.explode(players).alias(person)).groupBy(season, person).agg(F.count("*").alias("possessions"))
    frame = people.select(person).distinct().withColumn(season, F.explode(F.array(*[F.lit(s) for s in seasons])))
    return frame.join(seen, [season, person], "left").withColumn("possessions", F.coalesce("possessions", F.lit(0)))


def passer_rating(box: DataFrame, height: Column) -> DataFrame:
    """Adds PasserRating to what offensive_load gives (a published logistic; its weights are fixed values).

    box also has AtRimFGA; height is in inches.
    """
    per = lambda c: 100 * ratio(F.col(c), F.col("OffPoss"))
    by_load = F.coalesce(ratio(per("AST"), F.col("Load")), F.lit(0.0))
    without_threes = F.col("Creation") + 2.3021 * F.col("ThreePtP") - 0.0582 * per("AST") * (per("PTS") + per("TOV")) * F.col("ThreePtP")
    by_assist = F.coalesce(ratio(without_threes, per("AST")), F.lit(0.0))
    at_rim = F.coalesce(ratio(F.coalesce("AtRimFGA", F.lit(0.0)), F.col("FGA")), F.lit(0.0))
    inner = 4.79 + 6.48 * at_rim + 0.19 * F.col("Load") - 76.71 * by_load - 0.07 * height - 0.08 * per("TOV") ** 2 - 2.71 * by_assist + 1.19 * height * by_load
    return box.withColumn("PasserRating", 11.3 / (1 + F.exp(-F.log(F.lit(2.5)) * (inner - 5.6))))


def feed_rates(feed: DataFrame, box: DataFrame, keys: Sequence[str], exposure: str, per_100: Mapping[str, str], shares: Mapping[str, tuple[str, str]] = {}) -> DataFrame:  # noqa: B006
    """Rates of a tracking feed by the box score's exposure: hustle, passing, drives, rebounds, forced turnovers.

    The feed's rows are summed by key first, so repeated rows (traded players) count once with their sums.
    """
    columns = sorted({*per_100.values(), *(c for pair in shares.values() for c in pair)})
    sums = feed.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])
    both = checks.checked_join(sums, box.select(*keys, F.col(exposure).alias("_exposure")), keys)
    rate = {n: 100 * ratio(F.col(c), F.col("_exposure")) for n, c in per_100.items()} | {n: ratio(F.col(a), F.col(b)) for n, (a, b) in shares.items()}
    return both.select(*keys, *[v.alias(n) for n, v in rate.items()])


def shots_saved(feed: DataFrame, box: DataFrame, keys: Sequence[str], season: str, made: str, tried: str, exposure: str, points: float = 2.0) -> DataFrame:
    """Points saved per 100 against the season's rate of the shots defended."""
    league = feed.groupBy(season).agg(ratio(F.sum(made), F.sum(tried)).alias("_league"))
    both = feed.groupBy(*keys).agg(F.sum(made).alias("_m"), F.sum(tried).alias("_t")).join(league, season)
    both = checks.checked_join(both, box.select(*keys, F.col(exposure).alias("_exposure")), keys)
    return both.select(*keys, (100 * points * ratio(F.col("_league") * F.col("_t") - F.col("_m"), F.col("_exposure"))).alias("saved_per_100"), ratio(F.col("_t"), F.col("_exposure")).alias("tries_per_possession"))


def team_rollup(ratings: DataFrame, minutes: DataFrame, player: str, team: Sequence[str], rating: str, weight: str, size: int = 5) -> DataFrame:
    """Team predictions: `size` times the minutes-weighted mean rating, unrated players as 0, and the share of minutes rated."""
    both = minutes.join(ratings.select(player, F.col(rating).alias("_r")), player, "left")
    return both.groupBy(*team).agg((size * ratio(F.sum(F.coalesce("_r", F.lit(0.0)) * F.col(weight)), F.sum(weight))).alias("predicted"), ratio(F.sum(F.when(F.col("_r").isNotNull(), F.col(weight))), F.sum(weight)).alias("rated_share"))
