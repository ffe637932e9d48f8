"""Queries over the builders for game feeds and the expressions behind them; retail tables stand in for the feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import filters, joins, models, ordered, ranking, rates, ridge
from ..sources import lineage
from . import games
from .catalog import ORDER, YEARS, events, query, rounded, supplier_years, table

# expressions ---------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 5 = 0 THEN 0 ELSE (p_size % 13) * 60 + p_partkey % 60 END AS DOUBLE) AS clock, CAST(CASE WHEN p_partkey % 75 < 60 THEN (p_size % 13) * 60 + p_partkey % 75 END AS DOUBLE) AS strict,
  round(p_size + (p_partkey % 10) / 10.0, 6)::DOUBLE AS tenths, CAST(CASE WHEN p_size % 7 < 4 THEN (p_size % 7 + 1) * 720 ELSE 2880 + (p_size % 7 - 3) * 300 END - p_partkey % 300 AS DOUBLE) AS elapsed FROM part""")
def clock_functions(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    clock = s.clock_seconds(F.when(size % 5 == 0, F.lit(" ")).otherwise(F.format_string("%d:%02d", size % 13, key % 60)))
    strict = s.strict_clock_seconds(F.format_string("%d:%02d", size % 13, key % 75))
    tenths = F.round(s.clock_seconds(F.format_string("%d.%d", size, key % 10)), 6)
    return table(spark, sf_dir, "part").select("p_partkey", clock.alias("clock"), strict.alias("strict"), tenths.alias("tenths"), s.elapsed_seconds(size % 7 + 1, key % 300).alias("elapsed"))


@query("""SELECT p_partkey, CASE p_size % 6 + 1 WHEN 2 THEN 'regular' WHEN 4 THEN 'playoffs' WHEN 5 THEN 'play_in' WHEN 6 THEN 'cup_final' ELSE 'other' END AS game_type, CAST(-((p_partkey + 1) * 1000 + 250.5) AS DOUBLE) AS number,
  CASE p_brand WHEN 'Brand#1' THEN 'first' WHEN 'Brand#2' THEN 'second' ELSE p_brand END AS alias, CASE WHEN regexp_matches(p_name, 'red|green') THEN 'colour' WHEN contains(p_name, 'ring') THEN 'jewel' ELSE 'other' END AS kind,
  CAST(CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 5 = 0 THEN 1 WHEN p_size % 2 = 0 THEN 3 ELSE 2 END AS INT) AS points, p_size % 3 = p_partkey % 3 AS last_try,
  p_size % 5 IN (p_partkey % 5, p_partkey % 11) OR (p_size % 7 <> 0 AND p_size % 11 IN (p_partkey % 5, p_partkey % 11)) AS overlap FROM part""")
def text_functions(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, sf_dir, "part").withColumns({"_a": (size % 5).cast("long"), "_b": F.when(size % 7 != 0, size % 11).cast("long"), "_c": key % 5, "_d": key % 11})
    number = s.first_number_in(F.concat(F.lit("cost: -"), (key + 1).cast("string"), F.lit(",250.5 each, or 7")))
    return rows.select(
        "p_partkey", s.game_type(F.concat(F.lit("00"), (size % 6 + 1).cast("string"), F.lit("2300001"))).alias("game_type"), number.alias("number"), s.mapped(F.col("p_brand"), {"Brand#1": "first", "Brand#2": "second"}).alias("alias"),
        s.keyword_class(F.col("p_name"), [("red|green", "colour"), ("ring", "jewel")], "other").alias("kind"), s.text_points(F.when(size % 2 == 0, "3pt jump shot").otherwise("layup"), size % 3 != 0, size % 5 == 0).alias("points"),
        s.final_free_throw(F.format_string("Free throw %d of %d", size % 3 + 1, key % 3 + 1)).alias("last_try"), s.lineups_overlap(["_a", "_b"], ["_c", "_d"]).alias("overlap"),
    )


@query("""WITH a AS (SELECT o_orderkey, CAST(o_custkey % 41 - 20 AS DOUBLE) AS m, CAST(o_orderkey % 3000 - 100 AS DOUBLE) AS r, CAST(18 + o_custkey % 20 AS DOUBLE) AS age, o_custkey % 100 / 100.0 AS p, o_orderkey % 100 / 100.0 AS q FROM orders)
  SELECT o_orderkey, round(greatest(r, 0) / 2880.0, 6) AS share_left, round(m / sqrt(greatest(r, 0) + 1), 6) AS pressure, round(m * exp(-greatest(r, 0) / 300.0), 6) AS late, CAST(r < 0 AS INT) AS overtime, age - 27 AS centred, greatest(0, age - 23) AS young, greatest(0, age - 30) AS old, round((p + 1 - q) / 2, 6)::DOUBLE AS neutral FROM a""")
def state_features(spark, sf_dir):
    number = lambda c: F.expr(c).cast("double")
    rows = table(spark, sf_dir, "orders").withColumns({"m": number("o_custkey % 41 - 20"), "r": number("o_orderkey % 3000 - 100"), "age": number("18 + o_custkey % 20")})
    features = s.score_features(F.col("m"), F.col("r"))
    _, centred, young, old = s.age_basis(F.col("age"), 27.0, [23.0, 30.0])
    neutral = s.neutral_probability(number("o_custkey % 100") / 100, number("o_orderkey % 100") / 100)
    out = rows.select("o_orderkey", *[features[c].alias(c) for c in ("share_left", "pressure", "late", "overtime")], centred.alias("centred"), young.alias("young"), old.alias("old"), neutral.alias("neutral"))
    return rounded(out, "share_left", "pressure", "late", "neutral")


@query("""WITH a AS (SELECT o_orderkey, o_orderkey % 3200 AS e, CAST(o_custkey % 41 - 20 AS DOUBLE) AS gap, CAST(o_custkey % 5 - 2 AS DOUBLE) AS rest, CASE o_orderstatus WHEN 'O' THEN 1.0 WHEN 'F' THEN -1.0 END AS c FROM orders),
  b AS (SELECT *, CAST(CASE WHEN e > 2880 THEN 3180 - e ELSE 2880 - e END AS DOUBLE) AS r FROM a), d AS (SELECT *, greatest(r, 0) AS p FROM b)
  SELECT o_orderkey, gap, round(gap * sqrt(p / 2880), 6) AS gap_remaining, rest, round(rest * sqrt(p / 2880), 6) AS rest_remaining, CAST(c AS DOUBLE) AS control, round(c / sqrt(p / 60 + 1), 6) AS control_pressure, round(c * least(e / 2880.0, 1), 6)::DOUBLE AS control_late FROM d""")
def control_and_strength(spark, sf_dir):
    """Pregame strengths that fade and control that grows with the clock; an order's status says who has the ball, if anyone."""
    number = lambda c: F.expr(c).cast("double")
    status, elapsed = F.col("o_orderstatus"), number("o_orderkey % 3200")
    control = F.when(status == "O", True).when(status == "F", False)
    to_play = s.seconds_to_play(2880 - elapsed, 3180 - elapsed, elapsed > 2880)
    found = s.fading_features({"gap": number("o_custkey % 41 - 20"), "rest": number("o_custkey % 5 - 2")}, to_play) | s.control_features(control, elapsed, to_play)
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", *[v.alias(k) for k, v in found.items()]), "gap_remaining", "rest_remaining", "control_pressure", "control_late")


@query("""WITH a AS (SELECT o_orderkey, year(o_orderdate) AS y, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, CASE y WHEN 1999 THEN d BETWEEN DATE '1999-05-08' AND DATE '1999-06-25' ELSE d BETWEEN make_date(y, 4, 12) AND make_date(y, 6, 30) END AS in_playoffs FROM a""")
def playoff_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", games.in_playoffs(F.year("o_orderdate"), F.to_date("o_orderdate")).alias("in_playoffs"))


@query(f"WITH {YEARS}, r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY l_suppkey DESC) - 1 AS back, max(year) OVER () - year AS age FROM y) SELECT l_suppkey, CAST(year AS INT) AS year, round(exp(-0.01 * back) * pow(0.85, age), 6) AS weight FROM r")
def recency_weights(spark, sf_dir):
    return rounded(games.recency_weights(supplier_years(spark, sf_dir), "year", ["l_suppkey"], 0.01, 0.85).select("l_suppkey", "year", "weight"), "weight")


# rates ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {YEARS} SELECT l_suppkey, CAST(year AS INT) AS year, round(coalesce((1000 * 0.3 + returned) / (1000 + quantity), 0.3), 6)::DOUBLE AS posterior FROM y")
def posterior_rate(spark, sf_dir):
    found = rates.posterior(F.lit(0.3), F.col("returned") / F.col("quantity"), F.col("quantity"), 1000.0)
    return supplier_years(spark, sf_dir).select("l_suppkey", "year", F.round(found, 6).alias("posterior"))


@query(f"WITH {YEARS}, q AS (SELECT year, quantile_cont(revenue, 0.25) AS q FROM y GROUP BY 1) SELECT CAST(year AS INT) AS year, round(avg(revenue) FILTER (WHERE revenue <= q), 2) AS target FROM y JOIN q USING (year) GROUP BY 1")
def tier_targets(spark, sf_dir):
    return rounded(rates.tier_targets(supplier_years(spark, sf_dir), ["year"], "revenue"), "target", digits=2)


BOX = "b AS (SELECT l_suppkey, year, quantity, 100 * lines * 2.0 / quantity AS pts, 100 * lines * 0.1 / quantity AS tov, 100 * lines * 0.5 / quantity AS ast, 100 * lines * 0.3 / quantity AS fg3a, 100.0 * lines / quantity AS fga, 100 * lines * 0.2 / quantity AS fta FROM y)"


@query(f"""WITH {YEARS}, {BOX}, c AS (SELECT *, (2 / (1 + exp(-fg3a)) - 1) * 0.35 AS three, pts + tov AS use FROM b), d AS (SELECT *, 0.1843 * ast + 0.0969 * use - 2.3021 * three + 0.0582 * ast * use * three - 1.1942 AS creation FROM c),
  e AS (SELECT *, ast - 0.38 * 0.75 * creation + fga + 0.44 * fta + creation + tov AS load FROM d), f AS (SELECT *, 4.79 + 6.48 * 0.4 + 0.19 * load - 76.71 * ast / load - 0.07 * 78 - 0.08 * tov * tov - 2.71 * (creation + 2.3021 * three - 0.0582 * ast * use * three) / ast + 1.19 * 78 * ast / load AS inner_ FROM e)
  SELECT l_suppkey, CAST(year AS INT) AS year, round(creation, 4) AS creation, round(load, 4) AS load, round(tov / load, 6) AS ctov, round(11.3 / (1 + exp(-ln(2.5) * (inner_ - 5.6))), 4) AS passer FROM f""")
def creation_and_load(spark, sf_dir):
    lines = lambda by: F.col("lines") * by
    box = supplier_years(spark, sf_dir).select("l_suppkey", "year", F.col("quantity").alias("OffPoss"), lines(2.0).alias("PTS"), lines(0.1).alias("TOV"), lines(0.5).alias("AST"), lines(0.3).alias("FG3A"), F.lit(0.35).alias("FG3_PCT"), lines(1.0).alias("FGA"), lines(0.2).alias("FTA"), lines(0.4).alias("AtRimFGA"))
    out = games.passer_rating(games.offensive_load(box), F.lit(78.0))
    out = out.select("l_suppkey", "year", F.col("Creation").alias("creation"), F.col("Load").alias("load"), F.col("cTOV_pct").alias("ctov"), F.col("PasserRating").alias("passer"))
    return rounded(rounded(out, "ctov"), "creation", "load", "passer", digits=4)


@query("""WITH f AS (SELECT l_suppkey, sum(l_quantity) AS q, sum(l_tax) AS t, sum(l_discount) AS d FROM lineitem GROUP BY 1) SELECT l_suppkey, round(100 * q / (s_nationkey + 10.0), 4) AS per_100, round(CASE WHEN d > 0 THEN t / d END, 6) AS share FROM f JOIN supplier ON s_suppkey = l_suppkey""")
def feed_rates(spark, sf_dir):
    box = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") + 10.0).alias("exposure"))
    out = games.feed_rates(table(spark, sf_dir, "lineitem"), box, ["l_suppkey"], "exposure", {"per_100": "l_quantity"}, {"share": ("l_tax", "l_discount")})
    return rounded(rounded(out, "per_100", digits=4), "share")


DEFENSE = "f AS (SELECT l_suppkey, year(l_shipdate) AS year, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS m, count(*) AS t, sum(l_quantity) AS e FROM lineitem GROUP BY ALL)"


@query(f"WITH {DEFENSE}, g AS (SELECT year, sum(m) / sum(t) AS p FROM f GROUP BY 1) SELECT l_suppkey, CAST(year AS INT) AS year, round(200 * (p * t - m) / e, 6) AS saved_per_100, round(t / e, 6) AS tries_per_possession FROM f JOIN g USING (year)")
def rim_points_saved(spark, sf_dir):
    feed = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), (F.col("l_returnflag") == "R").cast("int").alias("made"), F.lit(1).alias("tried"), "l_quantity")
    box = feed.groupBy("l_suppkey", "year").agg(F.sum("l_quantity").alias("exposure"))
    return rounded(games.shots_saved(feed, box, ["l_suppkey", "year"], "year", "made", "tried", "exposure"), "saved_per_100", "tries_per_possession")


@query(f"""WITH {YEARS}, k AS (SELECT l_suppkey, year(l_shipdate) AS year, p_brand, count(*) AS poss, sum(l_quantity) AS pts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
  t AS (SELECT year, p_brand, 100 * sum(pts) / (2 * (sum(poss * 0.9) + 0.44 * sum(2 * 0.05 * poss))) AS ts FROM k WHERE poss >= 2 GROUP BY ALL), m AS (SELECT l_suppkey, year, sum(poss) AS syn, sum(poss * coalesce(ts, 0)) / sum(poss) AS expected FROM k LEFT JOIN t USING (year, p_brand) GROUP BY ALL),
  b AS (SELECT l_suppkey, year, lines * 10 AS minutes, 100 * quantity / (2 * (lines * 15.0 + 0.44 * lines * 2.0)) AS ts FROM y), l AS (SELECT year, 100 * sum(quantity) / (2 * (sum(lines * 15.0) + 0.44 * sum(lines * 2.0))) AS league FROM y GROUP BY 1)
  SELECT l_suppkey, CAST(year AS INT) AS year, round(ts, 4) AS ts, round(league, 4) AS league, round(expected, 4) AS expected, round(ts - league, 4) AS relative, round(ts - expected, 4) AS over_mix FROM b JOIN m USING (l_suppkey, year) JOIN l USING (year) WHERE minutes >= 50 AND syn >= 5""")
def shooting_over_mix(spark, sf_dir):
    lines = F.col("lines")
    box = supplier_years(spark, sf_dir).select(F.col("l_suppkey").alias("PLAYER_ID"), F.col("year").alias("Season"), (lines * 10).alias("Minutes"), F.col("quantity").alias("PTS"), (lines * 15.0).alias("FGA"), (lines * 2.0).alias("FTA"))
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kinds = sold.groupBy(F.col("l_suppkey").alias("PLAYER_ID"), F.year("l_shipdate").alias("Season"), F.col("p_brand").alias("playtype")).agg(F.count("*").alias("Poss"), F.sum("l_quantity").alias("Points"))
    out = games.playtype_shooting(box, kinds.withColumns({"FGA": F.col("Poss") * 0.9, "free_throw_share": F.lit(0.05)}), 50.0, 5.0, 2.0)
    out = out.select(F.col("PLAYER_ID").alias("l_suppkey"), F.col("Season").alias("year"), F.col("TS").alias("ts"), F.col("League_TS").alias("league"), F.col("ExpectedTS").alias("expected"), F.col("rTS").alias("relative"), F.col("zTS").alias("over_mix"))
    return rounded(out, "ts", "league", "expected", "relative", "over_mix", digits=4)


@query("""WITH f AS (SELECT l_linenumber AS s, l_suppkey AS d, l_quantity AS q, 1.0 AS m, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS t, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS ft FROM lineitem),
  p AS (SELECT s, d, sum(q) AS q, sum(2 * m + t + ft) AS pts, sum(m + 0.5 * t) AS made, sum(2 * m) AS att FROM f GROUP BY ALL), l AS (SELECT sum(pts) / sum(q) AS ppp, sum(made) / sum(att) AS efg FROM p), g AS (SELECT s, sum(pts) AS gp, sum(q) AS gq FROM p GROUP BY 1),
  e AS (SELECT d, q, pts, made, att, coalesce(CASE WHEN gq - q > 0 THEN (gp - pts) / (gq - q) END, ppp) * q - pts AS saved FROM p JOIN g USING (s), l), h AS (SELECT d, sum(q) AS q, sum(pts) AS pts, sum(saved) AS saved, sum(made) AS made, sum(att) AS att FROM e GROUP BY 1), o AS (SELECT sum(saved) / sum(q) AS offset_ FROM h)
  SELECT d AS l_suppkey, round(100 * pts / q, 4) AS allowed, round(100 * (saved - offset_ * q) / q, 4) AS saved, round(q / (q + 500) * 100 * (saved - offset_ * q) / q, 4) AS shrunk, round(100 * (made + 200 * efg) / (att + 200), 4) AS efg FROM h, o, l""")
def matchup_points_saved(spark, sf_dir):
    """A line's number is its scorer, its supplier the defender, its order the game."""
    flag = lambda c, v: F.sum(F.when(F.col(c) == v, 1.0).otherwise(0.0))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    lines = filters.dealt_by_size(lines, ["l_orderkey", "l_linenumber", "l_suppkey"])  # nearly every line is a group of its own
    rows = lines.groupBy(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("person_id"), F.col("l_suppkey").alias("matchups_person_id")).agg(
        F.sum("l_quantity").alias("partial_possessions"), F.count("*").cast("double").alias("matchup_field_goals_made"), flag("l_returnflag", "R").alias("matchup_three_pointers_made"), flag("l_linestatus", "F").alias("matchup_free_throws_made")
    )
    made = F.col("matchup_field_goals_made")
    rows = rows.withColumns({"player_points": 2 * made + F.col("matchup_three_pointers_made") + F.col("matchup_free_throws_made"), "matchup_field_goals_attempted": 2 * made})
    out = games.matchup_defense(rows).select(F.col("PLAYER_ID").alias("l_suppkey"), F.col("allowed_p100").alias("allowed"), F.col("saved_p100").alias("saved"), F.col("saved_p100_shrunk").alias("shrunk"), F.col("efg_allowed_shrunk").alias("efg"))
    return rounded(out, "allowed", "saved", "shrunk", "efg", digits=4)


@query(f"""WITH {YEARS}, r AS (SELECT s_suppkey AS l_suppkey, s_acctbal / 1000 AS r FROM supplier WHERE s_acctbal > 0) SELECT CAST(year AS INT) AS year, round(5 * sum(coalesce(r, 0) * lines) / sum(lines), 6) AS predicted, round(sum(lines) FILTER (WHERE r IS NOT NULL) / sum(lines), 6) AS rated_share FROM y LEFT JOIN r USING (l_suppkey) GROUP BY 1""")
def team_rollup(spark, sf_dir):
    ratings = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") / 1000).alias("r"))
    return rounded(games.team_rollup(ratings, supplier_years(spark, sf_dir), "l_suppkey", ["year"], "r", "lines"), "predicted", "rated_share")


@query("""WITH l AS (SELECT DISTINCT year(l_shipdate) AS year, l_orderkey, l_suppkey FROM lineitem), f AS (SELECT s_suppkey, y AS year FROM supplier, (SELECT unnest([1997, 1998, 2050]) AS y))
  SELECT f.s_suppkey, CAST(f.year AS INT) AS year, count(l_orderkey) AS possessions FROM f LEFT JOIN l ON l.l_suppkey = f.s_suppkey AND l.year = f.year GROUP BY ALL""")
def complete_exposure(spark, sf_dir):
    lineups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.year("l_shipdate").alias("year")).agg(F.collect_set("l_suppkey").alias("players"))
    return games.complete_exposure(lineups, "year", F.col("players"), table(spark, sf_dir, "supplier"), [1997, 1998, 2050], "s_suppkey").select("s_suppkey", "year", "possessions")


@query("""SELECT CAST(round(median(o_totalprice), 2) AS DOUBLE) AS median FROM orders WHERE o_orderpriority = '1-URGENT'""")
def median_of_some(spark, sf_dir):
    return rounded(ranking.median_of(table(spark, sf_dir, "orders"), F.col("o_orderpriority") == "1-URGENT", "o_totalprice"), "median", digits=2)


@query(f"WITH {YEARS}, m AS (SELECT year, sum(quantity * lines) / sum(lines) AS m FROM y GROUP BY 1) SELECT l_suppkey, CAST(year AS INT) AS year, round(quantity - m, 4) AS quantity_centered, round(lines / CAST(max(lines) OVER (PARTITION BY year) AS DOUBLE), 6) AS progress FROM y JOIN m USING (year)")
def centered_and_share(spark, sf_dir):
    out = ordered.share_of_progress(rates.centered(supplier_years(spark, sf_dir), ["year"], "quantity", "lines"), ["year"], "lines")
    return rounded(rounded(out.select("l_suppkey", "year", "quantity_centered", "progress"), "quantity_centered", digits=4), "progress")


# names and sources ---------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT p_brand, p_name, max(p_partkey) AS k FROM part GROUP BY ALL) SELECT p_brand, arg_max(p_name, k) AS canonical, string_agg(p_name, '|' ORDER BY p_name) AS aliases, count(*) AS n_names FROM n GROUP BY 1""")
def canonical_names(spark, sf_dir):
    return lineage.canonical_names(table(spark, sf_dir, "part"), "p_brand", "p_name", ["p_partkey"])


@query(f"""WITH {YEARS}, b AS (SELECT l_suppkey, year, quantity AS a, CASE WHEN lines >= 5 THEN revenue / 1000 END AS b FROM y)
  SELECT count(b) AS n, round(count(b) / count(*)::DOUBLE, 6) AS coverage, round(corr(a, b), 6) AS correlation, round(stddev_pop(b) / stddev_pop(a) FILTER (WHERE b IS NOT NULL), 6) AS sd_ratio, round(avg(abs(a - b)), 4) AS mean_abs_difference FROM b""")
def source_overlap(spark, sf_dir):
    rows = supplier_years(spark, sf_dir)
    out = lineage.overlap(rows.select("l_suppkey", "year", F.col("quantity").alias("v")), rows.where("lines >= 5").select("l_suppkey", "year", (F.col("revenue") / 1000).alias("v")), ["l_suppkey", "year"], "v")
    return rounded(rounded(out, "coverage", "correlation", "sd_ratio"), "mean_abs_difference", digits=4)


@query(f"WITH {YEARS} SELECT l_suppkey, CAST(year AS INT) AS year, round(CASE WHEN year < 1998 THEN quantity ELSE revenue END, 2) AS v FROM y")
def spliced_series(spark, sf_dir):
    rows = supplier_years(spark, sf_dir)
    part = lambda c: rows.select("l_suppkey", "year", F.col(c).alias("v"))
    return rounded(lineage.spliced(part("quantity"), part("revenue"), "year", 1998), "v", digits=2)


@query(f"WITH {YEARS} SELECT l_suppkey, CAST(max(year) AS INT) AS year, CAST(arg_max(lines, year) AS BIGINT) AS lines FROM y GROUP BY 1")
def latest_registered(spark, sf_dir):
    return lineage.latest(supplier_years(spark, sf_dir).select("l_suppkey", "year", "lines"), ["l_suppkey"], ["year"])


@query("""WITH m AS (SELECT DISTINCT s_nationkey, s_suppkey FROM supplier) SELECT a.s_nationkey, a.s_suppkey, b.s_suppkey AS other FROM m a JOIN m b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey""")
def teammate_pairs(spark, sf_dir):
    return joins.teammates(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey")


@query("""WITH k AS (SELECT p_partkey, p_brand, p_size, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS n FROM part), u AS (SELECT p_brand, n, min(p_partkey) AS i FROM k GROUP BY ALL HAVING count(DISTINCT p_partkey) = 1)
  SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN i END AS in_id, CASE WHEN p_size % 2 = 0 THEN i END AS out_id, CASE WHEN p_size % 2 = 1 THEN 'no_match' WHEN i IS NULL THEN 'unknown_name' END AS failure FROM k LEFT JOIN u USING (p_brand, n)""")
def substitutions_from_text(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("name_key", s.name_key(F.col("p_name")))
    known, _ = joins.resolver(parts.withColumnRenamed("p_partkey", "id"), ["p_brand", "name_key"], "id")
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("SUB: "), "p_name", F.lit(" FOR "), "p_name")).otherwise("TIMEOUT")
    out = filters.substitutions_from_text(parts.select("p_partkey", "p_brand", text.alias("text")), "text", known, ["p_brand"], "id")
    return out.select("p_partkey", "in_id", "out_id", "failure")


# ordered events ------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT user_id, event_id, CAST(floor(value / 10) AS BIGINT) AS h, CAST(floor(value / 25) AS BIGINT) AS w FROM events), b AS (SELECT *, h - coalesce(lag(h) OVER o, 0) AS home_points, w - coalesce(lag(w) OVER o, 0) AS away_points FROM a WHERE h <> 0 OR w <> 0 WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
  SELECT event_id, home_points, away_points, home_points < 0 OR away_points < 0 AS is_correction FROM b WHERE home_points <> 0 OR away_points <> 0""")
def scoring_events(spark, sf_dir):
    feed = events(spark, sf_dir).select(F.col("user_id").alias("gameId"), F.col("event_id").alias("actionId"), F.floor(F.col("value") / 10).alias("scoreHome"), F.floor(F.col("value") / 25).alias("scoreAway"))
    return games.scoring_events(feed).select(F.col("actionId").alias("event_id"), "home_points", "away_points", "is_correction")


@query("""WITH f AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), a AS (SELECT user_id, event_id, lead(event_id) OVER o IS NULL AS t, CASE WHEN lead(event_id) OVER o IS NULL THEN n WHEN event_type = 'purchase' THEN floor(value) END AS h,
    CASE WHEN lead(event_id) OVER o IS NULL THEN n + 1 WHEN event_type = 'view' THEN floor(value / 2) END AS w FROM events JOIN f USING (user_id) WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
  b AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER o, 0) AS ha, coalesce(last_value(w IGNORE NULLS) OVER o, 0) AS wa FROM a WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), c AS (SELECT *, coalesce(lag(ha) OVER o, 0) AS hb, coalesce(lag(wa) OVER o, 0) AS wb FROM b WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
  SELECT printf('%010d', user_id) || ':' || event_id AS event_id, CAST(hb AS DOUBLE) AS home_before, CAST(ha AS DOUBLE) AS home_after, CAST(ha - hb + wa - wb AS DOUBLE) AS points_added, ha < hb OR wa < wb AS is_corrected, t AS is_terminal, CAST(CASE WHEN event_id % 5 < 4 THEN (event_id % 5 + 1) * 720 ELSE 3180 END - (event_id % 4 * 60 + 30.5) AS DOUBLE) AS elapsed FROM c""")
def event_states(spark, sf_dir):
    rows = events(spark, sf_dir)
    feed = rows.select(
        F.col("user_id").alias("gameId"), F.col("event_id").alias("actionId"), (F.col("event_id") % 5 + 1).alias("period"), F.format_string("PT%02dM30.50S", F.col("event_id") % 4).alias("clock"),
        F.when(F.col("event_type") == "purchase", F.floor("value").cast("string")).alias("scoreHome"), F.when(F.col("event_type") == "view", F.floor(F.col("value") / 2).cast("string")).alias("scoreAway"),
    )
    finals = rows.groupBy(s.padded_id(F.col("user_id")).alias("game_id")).agg(F.count("*").alias("home_score"), (F.count("*") + 1).alias("away_score"))
    out = games.event_states(feed, finals)
    return out.select("event_id", F.col("home_score_before").alias("home_before"), F.col("home_score_after").alias("home_after"), "points_added", "is_corrected", F.col("is_terminal_event").alias("is_terminal"), F.col("seconds_elapsed_game").alias("elapsed"))


@query("""WITH a AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 2 ELSE 1 END AS o, floor(value / 50) AS st, CASE event_type WHEN 'purchase' THEN 2.0 ELSE 0.0 END AS p FROM events WHERE event_type IN ('view', 'click', 'purchase')),
  b AS (SELECT *, CASE WHEN lag(o) OVER w IS NULL OR lag(o) OVER w <> o THEN 1 ELSE 0 END AS s FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), c AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM b),
  d AS (SELECT *, CASE WHEN lag(st) OVER w IS NULL OR lag(st) OVER w <> st THEN 1 ELSE 0 END AS g FROM c WINDOW w AS (PARTITION BY user_id, n ORDER BY event_id))
  SELECT user_id || ':' || printf('%03d', CAST(n AS BIGINT)) AS possession_id, CAST(min(o) AS INT) AS offense_team_id, min(event_id) AS start_order_number, max(event_id) AS end_order_number, CAST(sum(p) AS DOUBLE) AS points, count(*) AS action_count, CAST(sum(g) AS BIGINT) AS segments FROM d GROUP BY user_id, n""")
def game_possessions(spark, sf_dir):
    """Views belong to the home side, clicks to the other one, and purchases score for the home side; other actions are no one's."""
    rows = events(spark, sf_dir)
    scored = F.when(F.col("event_type") == "purchase", 2.0).otherwise(0.0)
    actions = rows.select(
        F.col("user_id").cast("string").alias("game_id"), F.col("event_id").alias("orderNumber"), F.col("event_id").alias("actionNumber"), F.lit(1).alias("period"), F.lit(0.0).alias("seconds_elapsed_game"), F.floor(F.col("value") / 50).alias("ordinal_stint_id"),
        F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).alias("possession"), F.lit(1).alias("home_team_id"), F.lit(2).alias("away_team_id"), scored.alias("home_points_added"), F.lit(0.0).alias("away_points_added"), scored.alias("points_added"),
    )
    whole, _ = games.possessions(actions)
    return whole.select("possession_id", "offense_team_id", "start_order_number", "end_order_number", "points", "action_count", F.col("lineup_segment_count").alias("segments"))


@query("""SELECT printf('%010d', l_orderkey) AS game_id, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS home_score, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS away_score, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) - max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS home_margin, count(*) AS n_teams
  FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey""")
def team_games(spark, sf_dir):
    """An order's first line is the home side, its second one the away side."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    rows = rows.select(F.col("l_orderkey").alias("GAME_ID"), F.to_date("l_shipdate").alias("GAME_DATE"), F.col("l_suppkey").alias("TEAM_ID"), F.col("l_quantity").alias("PTS"), F.when(F.col("l_linenumber") == 1, "AAA vs. BBB").otherwise("BBB @ AAA").alias("MATCHUP"))
    return games.team_rows_to_games(rows).select("game_id", "home_score", "away_score", "home_margin", "n_teams")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type AS o, CASE WHEN value > 90 THEN 'dear' ELSE event_type END AS l FROM events), f AS (SELECT *, lag(o) OVER w AS po, lag(l) OVER w AS pl FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id, count(*) AS n, round(avg(CASE WHEN o = l THEN 1.0 ELSE 0.0 END), 6) AS agreement, string_agg(o, ',' ORDER BY ts, event_id) FILTER (WHERE po IS NULL OR po <> o) = string_agg(l, ',' ORDER BY ts, event_id) FILTER (WHERE pl IS NULL OR pl <> l) AS same_runs FROM f GROUP BY 1""")
def owner_agreement(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("label", F.when(F.col("value") > 90, "dear").otherwise(F.col("event_type")))
    return rounded(filters.agreement(rows, ["user_id"], ORDER, "event_type", "label"), "agreement")


@query("""WITH a AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS t FROM events), b AS (SELECT event_id, t, last_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM a)
  SELECT event_id, coalesce(t, CASE WHEN p = n THEN p END) AS state FROM b""")
def filled_between(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("state", F.when(F.col("event_type") != "error", F.col("event_type")))
    return filters.filled_between(rows, ["user_id"], ORDER, "state").select("event_id", "state")


@query("""WITH m AS (SELECT year(l_shipdate) AS year, l_suppkey, l_orderkey * 100 + l_linenumber AS place, min(CASE l_returnflag WHEN 'R' THEN 'in' WHEN 'A' THEN 'out' END) AS d FROM lineitem GROUP BY ALL), f AS (SELECT year, l_suppkey, arg_min(d, place) FILTER (WHERE d IS NOT NULL) AS mark FROM m GROUP BY ALL)
  SELECT CAST(year AS INT) AS year, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS players FROM f WHERE mark IS NULL OR mark = 'out' GROUP BY 1""")
def inferred_starters(spark, sf_dir):
    marks = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), "l_suppkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"))
    marks = marks.agg(F.min(F.when(F.col("l_returnflag") == "R", "in").when(F.col("l_returnflag") == "A", "out")).alias("d"))
    found = filters.inferred_starters(marks, ["year"], "at", "l_suppkey", F.col("d"))
    return found.select("year", F.array_join(F.transform("players", lambda p: p.cast("string")), ",").alias("players"))


@query("""WITH s AS (SELECT DISTINCT year(o_orderdate) AS year, o_orderkey, l_suppkey, o_totalprice / 1000 AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey), p AS (SELECT year, l_suppkey, sum(d) AS played FROM s GROUP BY ALL),
  q AS (SELECT year(l_shipdate) AS year, l_suppkey, sum(l_quantity) AS official FROM lineitem GROUP BY ALL) SELECT CAST(year AS INT) AS year, l_suppkey AS player, round(coalesce(played, 0), 6) AS played, round(coalesce(official, 0), 6) AS official, round(abs(coalesce(played, 0) - coalesce(official, 0)), 6) AS gap
  FROM p FULL JOIN q USING (year, l_suppkey) WHERE abs(coalesce(played, 0) - coalesce(official, 0)) > 50""")
def played_time_gaps(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    stints = orders.join(lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("players")), "o_orderkey").withColumn("year", F.year("o_orderdate"))
    played = filters.played_time(stints, ["year"], "players", F.lit(0.0), F.col("o_totalprice") / 1000)
    official = lines.groupBy(F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("player")).agg(F.sum("l_quantity").alias("official"))
    return rounded(filters.time_gaps(played, official, ["year"], 50.0), "played", "official", "gap")


@query("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS summed FROM lineitem GROUP BY 1) SELECT o_orderkey AS l_orderkey, round(summed, 2) AS summed, o_totalprice AS total FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE abs(coalesce(summed, 0) - o_totalprice) > 150000""")
def conservation_gaps(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("total"))
    return rounded(ordered.conservation_gaps(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice", totals, "total", 150_000.0), "summed", digits=2)


# models and aging ----------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY 1), c AS (SELECT d, sum(count(*)) OVER (ORDER BY d) AS c FROM s GROUP BY d), k AS (SELECT max(d) AS cut FROM c WHERE c <= 0.7 * (SELECT count(*) FROM s)) SELECT o_orderkey, coalesce(d <= cut, false) AS is_train FROM orders JOIN s USING (o_custkey), k""")
def chronological_split(spark, sf_dir):
    return models.chronological_split(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", 0.7).select("o_orderkey", "is_train")


DELTAS = "d AS (SELECT a.year - 1990 AS age, b.quantity - a.quantity AS x, CAST(least(a.lines, b.lines) AS DOUBLE) AS w FROM y a JOIN y b ON a.l_suppkey = b.l_suppkey AND b.year = a.year + 1), g AS (SELECT age, sum(w) AS w, sum(w * x) / sum(w) AS x FROM d GROUP BY 1)"
MOMENTS = "m AS (SELECT a.age, any_value(a.w) AS w, any_value(a.x) AS x, sum(k) AS s0, sum(k * t) AS s1, sum(k * t * t) AS s2, sum(k * v) AS t0, sum(k * t * v) AS t1 FROM g a, LATERAL (SELECT b.age - a.age AS t, b.x AS v, b.w * exp(-0.5 * ((b.age - a.age) / 2.0) ** 2) AS k FROM g b) GROUP BY a.age)"
SMOOTH = "f AS (SELECT age, w, x, CASE WHEN s0 * s2 - s1 * s1 > 1e-12 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS smooth FROM m), c AS (SELECT *, sum(smooth) OVER (ORDER BY age) AS curve FROM f), z AS (SELECT age, w, x, smooth, curve - (SELECT arg_min(curve, abs(age - 7)) FROM c) AS curve FROM c)"


def yearly_deltas(spark, sf_dir):
    pairs = joins.shifted_self_join(supplier_years(spark, sf_dir).select("l_suppkey", "year", "quantity", "lines"), ["l_suppkey"], "year", ["quantity", "lines"])
    return pairs.select((F.col("year") - 1990).alias("age"), (F.col("next_quantity") - F.col("quantity")).alias("x"), F.least("lines", "next_lines").cast("double").alias("w"))


@query(f"WITH {YEARS}, {DELTAS}, {MOMENTS}, {SMOOTH} SELECT CAST(age AS INT) AS age, w AS weight, round(x, 4) AS change, round(smooth, 4) AS smooth, round(curve, 4) AS curve FROM z")
def smoothed_age_curve(spark, sf_dir):
    return rounded(ridge.smoothed_age_curve(yearly_deltas(spark, sf_dir), "age", "x", "w", width=2.0, reference=7), "change", "smooth", "curve", digits=4)


@query(f"WITH {YEARS}, {DELTAS}, {MOMENTS}, {SMOOTH}, e AS (SELECT min(age) AS lo, max(age) AS hi FROM z) SELECT l_suppkey, CAST(year AS INT) AS year, round(quantity - curve, 4) AS adjusted FROM y, e JOIN z ON z.age = greatest(lo, least(hi, y.year - 1990))")
def at_reference_age(spark, sf_dir):
    curve = ridge.smoothed_age_curve(yearly_deltas(spark, sf_dir), "age", "x", "w", width=2.0, reference=7)
    rows = supplier_years(spark, sf_dir).withColumn("age", F.col("year") - 1990)
    return rounded(ridge.at_reference_age(rows, curve, "age", "quantity", "adjusted").select("l_suppkey", "year", "adjusted"), "adjusted", digits=4)


@query(f"""WITH {YEARS}, b AS (SELECT a.l_suppkey, a.year, a.lines, b.quantity - a.quantity AS delta, least(a.lines, b.lines) AS w FROM y a LEFT JOIN y b ON a.l_suppkey = b.l_suppkey AND b.year = a.year + 1)
  SELECT l_suppkey, CAST(year AS INT) AS year, round(coalesce(delta, -20.0), 4) AS delta, CAST(CASE WHEN delta IS NULL THEN 0.25 * lines ELSE w END AS DOUBLE) AS weight, delta IS NULL AS is_exit FROM b WHERE delta IS NOT NULL OR year < 2001""")
def changes_with_exits(spark, sf_dir):
    rows = supplier_years(spark, sf_dir).withColumn("lines", F.col("lines").cast("double"))
    return rounded(ridge.with_exits(rows, ["l_suppkey"], "year", "quantity", "lines", 2001, 20.0, 0.25), "delta", digits=4)


@query(f"""WITH {YEARS} SELECT 'smooth:' || a.l_suppkey || ':' || a.year AS row, a.l_suppkey, CAST(a.year + s AS INT) AS season, CAST(2 * s - 1 AS DOUBLE) AS val, 0.5::DOUBLE AS y, 3.0::DOUBLE AS weight FROM y a JOIN y b ON a.l_suppkey = b.l_suppkey AND b.year = a.year + 1, (SELECT unnest([0, 1]) AS s)""")
def smoothing_rows(spark, sf_dir):
    return ridge.smoothing_rows(supplier_years(spark, sf_dir), "l_suppkey", "year", F.lit(0.5), 3.0)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS entity, round(s_acctbal / 100, 6) AS offense, round(CASE WHEN s_nationkey > 5 THEN -s_acctbal / 200 END, 6) AS defense, round(s_acctbal / 100 + CASE WHEN s_nationkey > 5 THEN -s_acctbal / 200 ELSE 0 END, 6) AS net FROM supplier""")
def signed_ratings(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("entity"), "s_nationkey", (F.col("s_acctbal") / 10_000).alias("beta"))
    beta = rows.select(F.lit("plus").alias("block"), "entity", "beta").unionByName(rows.where("s_nationkey > 5").select(F.lit("minus").alias("block"), "entity", (F.col("beta") / 2).alias("beta")))
    out = ridge.ratings(beta, beta.select("block", "entity", F.lit(1.0).alias("exposure")), "plus", "minus")
    return rounded(out.select("entity", "offense", "defense", "net"), "offense", "defense", "net")
