"""Queries over lineups by the clock.  A user's events are a game: even ones are substitutions of the home team, odd ones of the away team.

The n-th moment of a team takes its player n - 1 off and brings player n + 4 on (of ten), so five are on at any time.  Users whose id leaves 3 modulo 11 have
a wrong second moment of the home team, and those with 5 modulo 13 an official time that is off by half a minute: both kinds are to be kept out.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import clock_lineups
from .catalog import query, table

SECONDS, BREAK, ROSTER = 2880, 1440.0, 10


def clock_moments(spark, sf_dir):
    """(user_id, team, at, n): a team's moments by tenths of seconds; several events of one moment are one."""
    events = table(spark, sf_dir, "events").select("user_id", s.micros(F.col("ts")).alias("us"), (F.col("event_id") % 2).cast("int").alias("team"))
    ends = events.groupBy("user_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    at = F.expr("(us - lo) * 28800 div greatest(hi - lo, 1)") / 10.0
    rows = events.join(ends, "user_id").select("user_id", "team", at.alias("at")).distinct()
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "team").orderBy("at")))


def clock_replay(spark, sf_dir):
    moments = clock_moments(spark, sf_dir)
    who = lambda k: (F.lit(0) + k) % ROSTER
    wrong = (F.col("user_id") % 11 == 3) & (F.col("team") == 0) & (F.col("n") == 2)
    changes = moments.select("user_id", "team", "at", F.array(who(F.col("n") - 1)).alias("outs"), F.array(F.when(wrong, who(F.col("n"))).otherwise(who(F.col("n") + 4))).alias("ins"))
    users = moments.select("user_id").distinct()
    teams = users.withColumn("team", F.explode(F.array(F.lit(0), F.lit(1))))
    games = users.select("user_id", F.lit(0).alias("home"), F.lit(1).alias("away"), F.lit(float(SECONDS)).alias("seconds"))
    starters = teams.withColumn("players", F.array(*[F.lit(k) for k in range(5)]))
    # players of the away team are numbered from 10 on, so that the two rosters differ
    shifted = lambda c: F.transform(c, lambda p: p + ROSTER * F.col("team"))
    before = teams.join(moments.where(F.col("at") < BREAK).groupBy("user_id", "team").agg(F.count("*").alias("n")), ["user_id", "team"], "left").na.fill(0, ["n"])
    resets = before.select("user_id", "team", F.lit(BREAK).alias("at"), shifted(F.array(*[who(F.col("n") + k) for k in range(5)])).alias("players"))
    spans = teams.join(moments, ["user_id", "team"], "left").groupBy("user_id", "team").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    ends = F.concat(F.array(F.lit(0.0)), "ats", F.array(F.lit(float(SECONDS))))
    lasting = F.transform(F.sequence(F.lit(0), F.size("ats")), lambda i: F.struct(i.alias("n"), (F.get(ends, i + 1) - F.get(ends, i)).alias("d")))
    played = spans.select("user_id", "team", F.explode(lasting).alias("e")).select("user_id", "team", F.explode(F.array(*[who(F.col("e.n") + k) for k in range(5)])).alias("p"), "e.d")
    official = played.groupBy("user_id", "team", "p").agg(F.sum("d").alias("seconds")).select("user_id", (F.col("p") + ROSTER * F.col("team")).cast("int").alias("player"), (F.col("seconds") + F.when((F.col("user_id") % 13 == 5) & (F.col("p") == 0) & (F.col("team") == 0), 30.0).otherwise(0.0)).alias("seconds"))
    shift = lambda df, *names: df.withColumns({c: shifted(F.transform(c, lambda p: p.cast("int"))) for c in names})
    return clock_lineups.replay_by_clock(games, shift(starters, "players"), shift(changes, "outs", "ins"), official, "user_id", resets=resets.withColumn("players", F.transform("players", lambda p: p.cast("int"))))


CLOCK = f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us, CAST(event_id % 2 AS INT) AS team FROM events), x AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM e GROUP BY 1), m AS (SELECT DISTINCT user_id, team, ((us - lo) * 28800 // greatest(hi - lo, 1)) / 10.0::DOUBLE AS tm FROM e JOIN x USING (user_id)),
  w AS (SELECT user_id, count(*) FILTER (team = 0) AS homes, count(*) FILTER (team = 1) AS aways FROM m GROUP BY 1), g AS (SELECT user_id, NOT (user_id % 11 = 3 AND homes >= 2) AND user_id % 13 <> 5 AS passed FROM w),
  b AS (SELECT user_id, tm FROM m UNION SELECT user_id, unnest([0.0, {BREAK}, {SECONDS}.0]) FROM g), c AS (SELECT user_id, tm AS lo, lead(tm) OVER (PARTITION BY user_id ORDER BY tm) AS hi FROM b),
  k AS (SELECT c.user_id, lo, hi, count(*) FILTER (team = 0 AND tm <= lo) AS h, count(*) FILTER (team = 1 AND tm <= lo) AS a FROM c LEFT JOIN m USING (user_id) WHERE hi IS NOT NULL GROUP BY 1, 2, 3), z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lo) AS stint FROM k JOIN g USING (user_id) WHERE passed)"""
LINEUP = "array_to_string(list_sort([({0} + i) % 10 + {1} FOR i IN range(0, 5)]), ',')"


@query(f"{CLOCK} SELECT user_id, stint, round(lo, 1) AS start_at, round(hi, 1) AS end_at, {LINEUP.format('h', 0)} AS home, {LINEUP.format('a', 10)} AS away FROM z")
def lineup_clock_replay(spark, sf_dir):
    stints, _ = clock_replay(spark, sf_dir)
    text = lambda c: F.concat_ws(",", F.transform(c, lambda p: p.cast("string")))
    return stints.select("user_id", "stint", F.round("start", 1).alias("start_at"), F.round("end", 1).alias("end_at"), text("home_players").alias("home"), text("away_players").alias("away"))


@query(f"{CLOCK} SELECT user_id, passed, coalesce(n, 0) AS stints FROM g LEFT JOIN (SELECT user_id, count(*) AS n FROM z GROUP BY 1) USING (user_id)")
def lineup_clock_accounts(spark, sf_dir):
    _, accounts = clock_replay(spark, sf_dir)
    return accounts.select("user_id", "passed", F.when(F.col("passed"), F.col("stints")).otherwise(0).alias("stints"))
