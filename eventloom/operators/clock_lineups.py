"""Lineups by the clock: substitutions replayed in order of elapsed time, with period resets, and held against official playing time.

A game is a stream of moments that ends with its final whistle; the fold's state is both lineups, the seconds each player has been on so
far and the errors seen.  Stints leave the fold as they close; a game's account leaves it with its last row.  Games that don't reconcile are kept out of the
stints and stay in the table of accounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from ..contracts import ContractError
from .filters import ordered_fold

START, RESET, CHANGE, END = 0, 1, 2, 9


def replay_by_clock(games: DataFrame, starters: DataFrame, moments: DataFrame, official: DataFrame, game: str, *, resets: DataFrame | None = None, tolerance: float = 5.0, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """(stints of the games that reconcile, one account a game).

    games: game, home, away, seconds.  starters: game, team, players.  moments: game, team, at, outs, ins (see filters.simultaneous); players in both
    net out.  resets: game, team, at, players: the lineup that begins a period, null where it could not be inferred.  official: game, player, seconds.
    stints: game, stint, start, end, duration, home_players, away_players (sorted).  accounts: game, starters_ok, errors, stints, covered, seconds,
    gap (the largest difference to the official time) and passed.

    An error is a moment outside the game, a team that does not play, one who leaves without being on or comes while being on, a lineup of another size than
    `size`, and a reset without players.  While a lineup has another size no stint closes.  A game passes without errors, with whole starters, with all its seconds
    covered and no player further than `tolerance` from the official time.
    """
    player = starters.schema["players"].dataType.elementType
    team = starters.schema["team"].dataType
    many = ArrayType(player)
    blank = lambda kind: F.lit(None).cast(kind)
    columns = {"_at": DoubleType(), "_kind": LongType(), "_team": team, "_home": team, "_away": team, "_seconds": DoubleType(), "_players": many, "_outs": many, "_ins": many, "_official": ArrayType(StructType([StructField("player", player), StructField("seconds", DoubleType())]))}

    def rows(df: DataFrame, **own: Column) -> DataFrame:
        return df.select(game, *[own.get(c, blank(kind)).cast(kind).alias(c) for c, kind in columns.items()])

    base = games.select(game, F.col("home").alias("_home"), F.col("away").alias("_away"), F.col("seconds").cast("double").alias("_seconds"))
    first = starters.join(base, game).transform(lambda df: rows(df, _at=F.lit(0.0), _kind=F.lit(START), _team=F.col("team"), _home=F.col("_home"), _away=F.col("_away"), _seconds=F.col("_seconds"), _players=F.col("players")))
    changes = rows(moments.join(base.select(game), game, "left_semi"), _at=F.col("at"), _kind=F.lit(CHANGE), _team=F.col("team"), _outs=F.col("outs"), _ins=F.col("ins"))
    times = official.where(F.col("player").isNotNull()).groupBy(game).agg(F.collect_list(F.struct(F.col("player").cast(player), F.col("seconds").cast("double").alias("seconds"))).alias("_official"))  # a game's players
    last = rows(base.join(times, game, "left"), _at=F.lit(float("inf")), _kind=F.lit(END), _home=F.col("_home"), _away=F.col("_away"), _seconds=F.col("_seconds"), _official=F.col("_official"))
    feed = first.unionByName(changes).unionByName(last)
    if resets is not None:
        feed = feed.unionByName(rows(resets.join(base.select(game), game, "left_semi"), _at=F.col("at"), _kind=F.lit(RESET), _team=F.col("team"), _players=F.col("players")))

    # moments come before the starters only if their time is below 0; the teams are known from the starters or, without them, at the end
    def start():
        return {"on": {}, "home": None, "away": None, "seconds": None, "before": 0.0, "errors": 0, "played": {}, "stints": 0, "covered": 0.0}

    def close(s, end):
        home, away = s["on"].get(s["home"], set()), s["on"].get(s["away"], set())
        if end <= s["before"] or len(home) != size or len(away) != size:
            return None
        found = {"stint": s["stints"] + 1, "start": s["before"], "end": end, "duration": end - s["before"], "home_players": sorted(home), "away_players": sorted(away)}
        for p in home | away:
            s["played"][p] = s["played"].get(p, 0.0) + found["duration"]
        s["stints"], s["covered"], s["before"] = s["stints"] + 1, s["covered"] + found["duration"], end
        return found

    def step(s, row):
        at, kind, team, home, away, seconds, players, outs, ins, times = row
        if kind == START:
            s["home"], s["away"], s["seconds"] = home, away, seconds
            if team in (home, away):
                s["on"][team] = set(players or ())
                s.setdefault("whole", {})[team] = len(s["on"][team]) == size
            return s, (None, None)
        if kind == END:
            s["home"], s["away"] = home, away
            found = close(s, seconds) if seconds is not None else None
            want = {t["player"]: t["seconds"] or 0.0 for t in times or ()}
            gap = max((abs(s["played"].get(p, 0.0) - want.get(p, 0.0)) for p in want.keys() | s["played"].keys()), default=float("inf"))
            whole = all(s.get("whole", {}).get(t, False) for t in (home, away))
            passed = bool(whole and not s["errors"] and seconds is not None and abs(s["covered"] - seconds) < 1e-6 and gap <= tolerance)
            return s, (found, {"starters_ok": whole, "errors": s["errors"], "stints": s["stints"], "covered": s["covered"], "seconds": seconds, "gap": gap, "passed": passed})
        if at is None or at < s["before"] or s["seconds"] is None or at > s["seconds"] or team not in (s["home"], s["away"]):
            s["errors"] += 1
            return s, (None, None)
        found, on = close(s, at), s["on"].get(team, set())
        if kind == RESET:
            s["errors"] += players is None
            s["on"][team] = on if players is None else set(players)
        else:
            gone, come = set(outs or ()) - set(ins or ()), set(ins or ()) - set(outs or ())
            s["errors"] += not gone <= on or bool(come & on)
            s["on"][team] = (on - gone) | come
            s["errors"] += len(s["on"][team]) != size
        return s, (found, None)

    stint = StructType([StructField("stint", LongType()), *[StructField(c, DoubleType()) for c in ("start", "end", "duration")], StructField("home_players", many), StructField("away_players", many)])
    account = StructType([StructField("starters_ok", BooleanType()), StructField("errors", LongType()), StructField("stints", LongType()), *[StructField(c, DoubleType()) for c in ("covered", "seconds", "gap")], StructField("passed", BooleanType())])
    new = StructType([StructField("_stint", stint), StructField("_account", account)])
    folded = ordered_fold(feed, [game], ["_at", "_kind", "_team"], list(columns), start, step, new)
    accounts = folded.where("_account is not null").select(game, "_account.*")
    stints = folded.where("_stint is not null").select(game, "_stint.*").join(accounts.where("passed").select(game), game, "left_semi")
    return stints, accounts


def quarantine_gate(accounts: DataFrame, most: float = 0.005, tolerance: float = 5.0) -> dict:
    """Counts of games by what is wrong with them, the share kept out, and whether the whole may be published: that share is at most `most`, and there are games."""
    n = F.count("*")
    row = accounts.agg(n.alias("games"), F.count_if(~F.col("passed")).alias("rejected"), F.count_if(~F.col("starters_ok")).alias("without_starters"), F.count_if(F.col("errors") > 0).alias("with_errors"), F.count_if(F.col("gap") > tolerance).alias("with_time_gaps"), F.count_if(F.abs(F.col("covered") - F.col("seconds")) >= 1e-6).alias("not_covered")).first().asDict()
    share = row["rejected"] / row["games"] if row["games"] else 1.0
    return {**row, "share": share, "passed": bool(row["games"]) and share <= most}


def published_stints(stints: DataFrame, accounts: DataFrame, most: float = 0.005) -> DataFrame:
    """The stints, if few enough games are kept out; else an error that names the counts."""
    gate = quarantine_gate(accounts, most)
    if not gate["passed"]:
        raise ContractError(f"too many games are kept out: {gate}")
    return stints
