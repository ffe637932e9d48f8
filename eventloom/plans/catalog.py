"""Queries over the retail and event tables, one an operator, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checks
from ..functions import scalars as s
from ..operators import filters, joins, ordered, packed, ranking, rates, resample, ridge
from ..sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


ORDER = ["ts", "event_id"]
RUNS = """runs AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""


# ordered events ------------------------------------------------------------------------------------------------------


@query(f"""WITH {RUNS} SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n_rows, arg_min(event_id, (ts, event_id)) AS first_event_id,
  arg_max(event_id, (ts, event_id)) AS last_event_id, round(sum(value), 6) AS total FROM runs GROUP BY user_id, run""")
def possession_collapse(spark, sf_dir):
    return rounded(ordered.collapse_runs(events(spark, sf_dir), ["user_id"], ORDER, ["event_type"], {"total": F.sum("value")}), "total")


@query(f"""WITH {RUNS}, b AS (SELECT *, floor(value / 50) AS band FROM runs), c AS (SELECT *, CASE WHEN lag(band) OVER w IS NULL OR lag(band) OVER w <> band THEN 1 ELSE 0 END AS t
  FROM b WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id)), d AS (SELECT *, sum(t) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM c)
  SELECT user_id, CAST(run AS BIGINT) AS run, CAST(segment AS BIGINT) AS segment, count(*) AS n_rows, round(sum(value), 6) AS total FROM d GROUP BY ALL""")
def nested_segments(spark, sf_dir):
    first = ordered.number_runs(events(spark, sf_dir).withColumn("band", F.floor(F.col("value") / 50)), ["user_id"], ORDER, ["event_type"])
    second = ordered.number_runs(first, ["user_id", "run"], ORDER, ["band"], "segment")
    return rounded(second.groupBy("user_id", "run", "segment").agg(F.count("*").alias("n_rows"), F.sum("value").alias("total")), "total")


@query("""WITH a AS (SELECT *, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0.0) AS score FROM events),
  b AS (SELECT *, coalesce(lag(score) OVER w, 0.0) AS score_before, lead(event_id) OVER w IS NULL AS is_last FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id, round(score, 6) AS score, round(score_before, 6) AS score_before, round(score - score_before, 6) AS score_change, score < score_before AS score_corrected, is_last FROM b""")
def score_state_ffill(spark, sf_dir):
    sparse = events(spark, sf_dir).withColumn("score", F.when(F.col("event_type") == "purchase", F.col("value")))
    out = ordered.state_changes(sparse, ["user_id"], ORDER, "score")
    return rounded(out.select("event_id", "score", "score_before", "score_change", "score_corrected", "is_last"), "score", "score_before", "score_change")


@query("""SELECT event_id, row_number() OVER w AS number, round(coalesce(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS value_before,
  coalesce(lag(value) OVER w, 0.0) AS previous_value, row_number() OVER w = 1 AS is_first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def prefix_context(spark, sf_dir):
    out = ordered.prefix_context(events(spark, sf_dir), ["user_id"], ORDER, "value")
    return rounded(out.select("event_id", "number", "value_before", "previous_value", "is_first"), "value_before", digits=4).withColumn("number", F.col("number").cast("long"))


@query("SELECT user_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS bucket, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def tumbling_last(spark, sf_dir):
    hour = F.floor(s.micros(F.col("ts")) / 3_600_000_000).cast("long")
    return ordered.bucket_last(events(spark, sf_dir), ["user_id"], ORDER, hour).select("user_id", "bucket", "event_id", "value")


@query("""WITH a AS (SELECT *, CAST(ts AS DATE) AS day, abs(epoch_us(ts) - (epoch_us(date_trunc('day', ts)) + 43200000000)) AS gap FROM events)
  SELECT user_id, CAST(day AS VARCHAR) AS day, arg_min(event_id, (gap, event_id)) AS event_id, min(gap) AS distance FROM a GROUP BY user_id, day""")
def checkpoint_nearest(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    noon = F.abs(F.pmod(s.micros(F.col("ts")), F.lit(86_400_000_000)) - F.lit(43_200_000_000))
    return ordered.nearest_row(rows, ["user_id", "day"], noon, ["event_id"]).select("user_id", F.col("day").cast("string").alias("day"), "event_id", "distance")


@query("""WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS l,
  row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / 3600000000) ORDER BY ts DESC, event_id DESC) AS b FROM events) SELECT user_id, event_id FROM a WHERE f = 1 OR l = 1 OR b = 1""")
def sampled_states(spark, sf_dir):
    hour = F.floor(s.micros(F.col("ts")) / 3_600_000_000)
    return ordered.sampled_states(events(spark, sf_dir), ["user_id"], ORDER, hour).select("user_id", "event_id")


@query(f"""WITH {RUNS}, b AS (SELECT user_id, run, event_id, value, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n, max(epoch_us(ts)) OVER (PARTITION BY user_id, run) AS e FROM runs),
  c AS (SELECT *, greatest(coalesce(n, e) - t, 0) AS d FROM b), d AS (SELECT *, sum(d) OVER (PARTITION BY user_id, run) AS sd, count(*) OVER (PARTITION BY user_id, run) AS k FROM c)
  SELECT event_id, round(CASE WHEN sd > 0 THEN d / sd ELSE 1.0 / k END, 6) AS weight FROM d""")
def fractional_weights(spark, sf_dir):
    rows = ordered.number_runs(events(spark, sf_dir), ["user_id"], ORDER, ["event_type"]).withColumns({"t": s.micros(F.col("ts")).cast("double"), "one": F.lit(1)})
    ends = rows.groupBy("user_id", "run").agg(F.max("t").alias("e"))
    out = ordered.duration_weights(rows.join(ends, ["user_id", "run"]), ["user_id", "run"], ORDER, F.col("t"), F.col("e"), "one")
    return rounded(out.select("event_id", "weight"), "weight")


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderdate, CASE WHEN lag(o_orderpriority) OVER w IS NULL OR lag(o_orderpriority) OVER w <> o_orderpriority THEN 1 ELSE 0 END AS s FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), b AS (SELECT *, sum(s) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM a)
  SELECT o_custkey, CAST(run AS BIGINT) AS run, min(o_orderpriority) AS o_orderpriority, count(*) AS n_rows, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_o_orderkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_o_orderkey FROM b GROUP BY o_custkey, run""")
def stints(spark, sf_dir):
    return ordered.collapse_runs(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderpriority"])


def supplier_years(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    return lines.groupBy("l_suppkey", "year").agg(F.sum("l_quantity").alias("quantity"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count("*").alias("lines"))


YEARS = "y AS (SELECT l_suppkey, year(l_shipdate) AS year, sum(l_quantity) AS quantity, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS returned, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS lines FROM lineitem GROUP BY ALL)"


@query(f"WITH {YEARS} SELECT a.l_suppkey, CAST(a.year AS INT) AS year, round(a.revenue, 2) AS revenue, round(b.revenue, 2) AS next_revenue FROM y a LEFT JOIN y b ON a.l_suppkey = b.l_suppkey AND b.year = a.year + 1")
def adjacent_period(spark, sf_dir):
    out = ordered.adjacent(supplier_years(spark, sf_dir), ["l_suppkey"], "year", ["revenue"])
    return rounded(out.select("l_suppkey", "year", "revenue", "next_revenue"), "revenue", "next_revenue", digits=2)


@query(f"WITH {YEARS} SELECT a.l_suppkey, CAST(a.year AS INT) AS year, round(b.quantity - a.quantity, 2) AS change, round(sqrt(least(a.lines, b.lines)), 6) AS weight FROM y a JOIN y b ON a.l_suppkey = b.l_suppkey AND b.year = a.year + 1 WHERE least(a.lines, b.lines) >= 5")
def transition_pairs(spark, sf_dir):
    pairs = joins.shifted_self_join(supplier_years(spark, sf_dir).select("l_suppkey", "year", "quantity", "lines"), ["l_suppkey"], "year", ["quantity", "lines"])
    least = F.least("lines", "next_lines")
    return pairs.where(least >= 5).select("l_suppkey", "year", F.round(F.col("next_quantity") - F.col("quantity"), 2).alias("change"), F.round(F.sqrt(least), 6).alias("weight"))


@query(f"WITH {YEARS} SELECT l_suppkey, CAST(year AS INT) AS year, round(avg(quantity) OVER (PARTITION BY l_suppkey ORDER BY year ROWS 2 PRECEDING), 4) AS rows_mean, round(avg(quantity) OVER (PARTITION BY l_suppkey ORDER BY year RANGE 2 PRECEDING), 4) AS span_mean FROM y")
def trailing_means(spark, sf_dir):
    out = ordered.trailing_range_mean(ordered.trailing_mean(supplier_years(spark, sf_dir), ["l_suppkey"], ["year"], ["quantity"], 3), ["l_suppkey"], "year", ["quantity"], 3)
    return rounded(out.select("l_suppkey", "year", F.col("quantity_mean3").alias("rows_mean"), F.col("quantity_span3").alias("span_mean")), "rows_mean", "span_mean", digits=4)


@query("""SELECT o_orderkey, CAST(least(coalesce(date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER w, CAST(o_orderdate AS DATE)), 7), 7) AS INT) AS rest, coalesce(date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER w, CAST(o_orderdate AS DATE)) = 1, false) AS back_to_back
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)""")
def rest_days(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return ordered.rest_days(rows, ["o_custkey"], "day", ["o_orderkey"]).select("o_orderkey", "rest", "back_to_back")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events), b AS (SELECT event_id, ts, user_id, event_type, value, CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY user_id, event_type) AS p,
  coalesce(sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END) OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS m FROM a)
  SELECT event_id, round(m, 4) AS margin_before FROM b WHERE abs(m) <= 300 + floor(8.0 * (1 - p))""")
def undecided_rows(spark, sf_dir):
    margin = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    return rounded(ordered.without_decided(events(spark, sf_dir), ["user_id"], "event_type", ORDER, margin, {0: 300}).select("event_id", "margin_before"), "margin_before", digits=4)


# joins on time and identity ------------------------------------------------------------------------------------------


def run_intervals(spark, sf_dir):
    runs = ordered.collapse_runs(events(spark, sf_dir), ["user_id"], ORDER, ["event_type"], {"started": F.min(s.micros(F.col("ts")))})
    return ordered.adjacent(runs, ["user_id"], "run", ["started"]).select("user_id", "run", F.col("started").alias("start_at"), F.col("next_started").alias("end_at"))


@query(f"""WITH {RUNS}, i AS (SELECT user_id, run, min(epoch_us(ts)) AS a FROM runs GROUP BY ALL), j AS (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY run) AS b FROM i)
  SELECT e.event_id, CAST(j.run AS BIGINT) AS run FROM events e JOIN j ON e.user_id = j.user_id AND j.a <= epoch_us(e.ts) AND (j.b IS NULL OR epoch_us(e.ts) < j.b)""")
def interval_attach(spark, sf_dir):
    left = events(spark, sf_dir).withColumn("at", s.micros(F.col("ts")))
    return joins.disjoint_interval_join(left, run_intervals(spark, sf_dir), ["user_id"], F.col("at"), "start_at", "end_at").select("event_id", "run")


@query(f"""WITH {RUNS}, i AS (SELECT user_id, run, min(epoch_us(ts)) AS a FROM runs GROUP BY ALL), j AS (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY run) AS b FROM i),
  k AS (SELECT e.event_id, j.run, row_number() OVER (PARTITION BY e.event_id ORDER BY j.a DESC, j.run DESC) AS n FROM events e JOIN j ON e.user_id = j.user_id AND j.a <= epoch_us(e.ts) AND (j.b IS NULL OR epoch_us(e.ts) <= j.b))
  SELECT event_id, CAST(run AS BIGINT) AS run FROM k WHERE n = 1""")
def interval_attach_closed(spark, sf_dir):
    left = events(spark, sf_dir).select("user_id", "event_id", s.micros(F.col("ts")).alias("at"))
    return joins.interval_join(left, run_intervals(spark, sf_dir), ["user_id"], F.col("at"), "start_at", "end_at", ["run"], closed=True).select("event_id", "run")


@query("""WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
  j AS (SELECT p.event_id AS purchase_id, v.event_id AS view_id, abs(p.t - v.t) AS gap, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - v.t), v.event_id) AS n FROM p JOIN v USING (user_id) WHERE abs(p.t - v.t) <= 21600000000)
  SELECT purchase_id, view_id, gap FROM j WHERE n = 1""")
def nearest_within(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("t", s.micros(F.col("ts")))
    left = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("t").alias("t_purchase"))
    right = rows.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("t").alias("t_view"))
    return joins.nearest_within(left, right, ["user_id"], "purchase_id", "t_purchase", "t_view", ["view_id"], 21_600_000_000).select("purchase_id", "view_id", "gap")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n, min(l_quantity) AS q FROM lineitem GROUP BY ALL)
  SELECT k.l_orderkey, k.l_linenumber, k.l_returnflag, coalesce(c.n, 0) AS n_candidates, CASE WHEN c.n = 1 THEN c.q END AS quantity FROM (SELECT DISTINCT l_orderkey, l_linenumber, 'R' AS l_returnflag FROM lineitem) k LEFT JOIN c USING (l_orderkey, l_linenumber, l_returnflag)""")
def unique_match_align(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_returnflag"]
    wanted = lines.select("l_orderkey", "l_linenumber", F.lit("R").alias("l_returnflag")).distinct()
    one, rest = joins.unique_matches(wanted, lines.select(*keys, F.col("l_quantity").alias("quantity")), keys)
    return one.withColumn("n_candidates", F.lit(1).cast("long")).unionByName(rest.withColumn("quantity", F.lit(None).cast("double"))).select(*keys, "n_candidates", "quantity")


@query("""WITH k AS (SELECT lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS name_key, p_partkey FROM part), c AS (SELECT name_key, count(DISTINCT p_partkey) AS n, min(p_partkey) AS i FROM k GROUP BY name_key)
  SELECT p_partkey, k.name_key, CASE WHEN n = 1 THEN i END AS resolved FROM k JOIN c USING (name_key)""")
def name_resolve(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_partkey", s.name_key(F.col("p_name"), drop_suffix=False).alias("name_key"))
    known, _ = joins.resolver(named, ["name_key"], "p_partkey")
    return joins.attach_id(named, known.withColumnRenamed("p_partkey", "resolved"), ["name_key"], "resolved").select("p_partkey", "name_key", "resolved")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS a FROM orders WHERE o_totalprice >= 50000), l AS (SELECT l_orderkey AS k, max(l_linestatus) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
  SELECT k, CASE WHEN o.k IS NULL THEN 'missing_left' WHEN l.k IS NULL THEN 'missing_right' WHEN a IS DISTINCT FROM b THEN 'differs' ELSE 'ok' END AS issue FROM o FULL JOIN l USING (k)""")
def full_outer_issue_ledger(spark, sf_dir):
    """Dear orders against orders with a returned line: each feed has orders that the other lacks."""
    left = table(spark, sf_dir, "orders").where("o_totalprice >= 50000").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("a"))
    right = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("b"))
    return checks.full_outer_issues(left, right, ["k"], {"a": "b"}).select("k", "issue")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
  SELECT k, 'left_only' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right_only' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def source_reconcile_anti(spark, sf_dir):
    """Customers with urgent orders against customers with open ones."""
    orders = table(spark, sf_dir, "orders")
    one = lambda where: orders.where(where).select(F.col("o_custkey").alias("k"))
    return checks.reconcile(one("o_orderpriority = '1-URGENT'"), one("o_orderstatus = 'P'"), ["k"])


@query("SELECT l_orderkey, round(max(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END), 2) AS a_l_extendedprice, round(max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 2) AS r_l_extendedprice FROM lineitem GROUP BY 1")
def one_row_per_pair(spark, sf_dir):
    out = joins.sides_to_row(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", ["A", "R"], ["l_extendedprice"])
    return rounded(out, "a_l_extendedprice", "r_l_extendedprice", digits=2)


@query("SELECT c_mktsegment, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal) DESC, c_custkey DESC) AS n FROM customer) WHERE n = 1")
def strongest_row(spark, sf_dir):
    return joins.strongest(table(spark, sf_dir, "customer"), ["c_mktsegment"], F.abs("c_acctbal"), ["c_custkey"]).select("c_mktsegment", "c_custkey", "c_name")


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_event_type, arg_max(event_type, (ts, event_id)) AS last_event_type FROM events GROUP BY 1")
def first_and_last(spark, sf_dir):
    return joins.first_and_last(events(spark, sf_dir), ["user_id"], ORDER, ["event_type"])


@query("""SELECT o_orderkey, o_custkey, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def checked_dimension(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    out = checks.checked_join(orders, customer, ["o_custkey"])
    out = checks.checked_join(out, nation, ["c_nationkey"])
    out = checks.checked_join(out, table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"])
    return out.select("o_orderkey", "o_custkey", "c_mktsegment", "n_name", "r_name")


# quality -------------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT l_orderkey, l_discount > 0.08 AS a, l_quantity > 49 AS b FROM lineitem), k AS (SELECT l_orderkey, count(*) FILTER (WHERE a OR b) AS n_bad, CASE WHEN bool_or(a) AND bool_or(b) THEN 'discount,quantity' WHEN bool_or(a) THEN 'discount' ELSE 'quantity' END AS reasons
  FROM r GROUP BY 1 HAVING bool_or(a OR b)) SELECT l_orderkey, n_bad, reasons FROM k""")
def quarantine_orders(spark, sf_dir):
    rules = {"discount": F.col("l_discount") > 0.08, "quantity": F.col("l_quantity") > 49}
    return checks.quarantine(table(spark, sf_dir, "lineitem"), ["l_orderkey"], rules)[1]


@query("SELECT count(*) AS n_rows, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08 OR l_quantity > 49)")
def quarantine_clean(spark, sf_dir):
    rules = {"discount": F.col("l_discount") > 0.08, "quantity": F.col("l_quantity") > 49}
    clean, _ = checks.quarantine(table(spark, sf_dir, "lineitem"), ["l_orderkey"], rules)
    return rounded(clean.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("l_quantity"), F.lit(None)).alias("quantity")), "quantity", digits=2)


@query("""SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS n_null_keys, count(*) FILTER (WHERE l_discount IS NULL) AS null_l_discount, count(*) FILTER (WHERE l_returnflag IS NULL) AS null_l_returnflag,
  count(*) FILTER (WHERE l_discount NOT BETWEEN 0.0 AND 0.05) AS range_l_discount, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'R')) AS member_l_returnflag, CAST((SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1) AS BIGINT) AS n_repeated FROM lineitem""")
def quality_report(spark, sf_dir):
    return checks.quality_report(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], {"l_discount": (0.0, 0.05)}, {"l_returnflag": ["A", "R"]})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_payloads FROM (SELECT DISTINCT * FROM lineitem) GROUP BY 1, 2 HAVING count(*) > 1")
def dedupe_conflict(spark, sf_dir):
    return checks.collapse_identical(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])[1]


@query("""WITH a AS (SELECT user_id, value, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events)
  SELECT user_id, count(*) FILTER (WHERE value < v) AS clock_backwards, count(*) FILTER (WHERE event_id < e) AS number_backwards, count(event_id) - count(DISTINCT event_id) AS repeated_numbers FROM a GROUP BY 1""")
def order_violations(spark, sf_dir):
    return ordered.order_violations(events(spark, sf_dir), ["user_id"], ORDER, "value", "event_id")


@query("""WITH o AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total, 'orders' AS feed FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
  SELECT * FROM o UNION ALL SELECT c_custkey, round(c_acctbal, 2), 'balance' FROM customer WHERE c_custkey NOT IN (SELECT k FROM o)""")
def preferred_feed(spark, sf_dir):
    first = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("total")).withColumn("feed", F.lit("orders"))
    second = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("total"), F.lit("balance").alias("feed"))
    return rounded(checks.prefer([first, second], ["k"]), "total", digits=2)


# rates ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH {YEARS}, w AS (SELECT unnest([1997, 1998, 2000]) AS window_end) SELECT l_suppkey, CAST(window_end AS INT) AS window_end, round(100.0 * sum(returned) / sum(quantity), 6) AS returned_per_100, round(sum(quantity), 2) AS quantity FROM y JOIN w ON year <= window_end AND year > window_end - 3 GROUP BY ALL""")
def pooled_rates(spark, sf_dir):
    sums = rates.pooled(supplier_years(spark, sf_dir), ["l_suppkey"], "year", [1997, 1998, 2000], 3, ["returned", "quantity"])
    out = rates.per_exposure(sums, {"returned_per_100": "returned"}, "quantity").select("l_suppkey", "window_end", "returned_per_100", "quantity")
    return rounded(rounded(out, "returned_per_100"), "quantity", digits=2)


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS discount FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def weighted_mean_by_group(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(rates.weighted_mean(F.col("l_discount"), F.col("l_quantity")).alias("discount")), "discount")


PAIRS = "p AS (SELECT l_partkey, l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS v, sum(l_quantity) AS e FROM lineitem GROUP BY ALL)"


@query(f"WITH {PAIRS} SELECT l_partkey, l_suppkey, round(CASE WHEN sum(e) OVER w - e > 0 THEN (sum(v) OVER w - v) / (sum(e) OVER w - e) END, 6) AS expected FROM p WINDOW w AS (PARTITION BY l_partkey)")
def leave_one_out(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).alias("v"), F.sum("l_quantity").alias("e"))
    return rounded(rates.leave_one_out(pairs, ["l_partkey"], "v", "e").select("l_partkey", "l_suppkey", "expected"), "expected")


@query(f"WITH {YEARS}, r AS (SELECT *, returned / quantity AS rate FROM y), c AS (SELECT sum(rate * quantity) FILTER (WHERE rate IS NOT NULL) / sum(quantity) FILTER (WHERE rate IS NOT NULL) AS c FROM r) SELECT l_suppkey, CAST(year AS INT) AS year, round(coalesce(quantity / (quantity + 500) * rate + 500 / (quantity + 500) * c, c), 6) AS shrunk FROM r, c")
def shrunk_rate(spark, sf_dir):
    rows = supplier_years(spark, sf_dir).withColumn("rate", s.ratio(F.col("returned"), F.col("quantity")))
    return rounded(rates.shrunk_rate(rows, "rate", "quantity", 500.0, name="shrunk").select("l_suppkey", "year", "shrunk"), "shrunk")


@query(f"WITH {YEARS} SELECT l_suppkey, CAST(year AS INT) AS year, round((coalesce(returned, 0) + 150 * (sum(returned) OVER w / sum(quantity) OVER w)) / (quantity + 150), 6) AS shrunk FROM y WINDOW w AS (PARTITION BY year)")
def shrunken_ratio(spark, sf_dir):
    return rounded(rates.shrunk_ratio(supplier_years(spark, sf_dir), "returned", "quantity", 150.0, ["year"], "shrunk").select("l_suppkey", "year", "shrunk"), "shrunk")


@query(f"WITH {YEARS}, g AS (SELECT year, median(revenue) AS m, quantile_cont(revenue, 0.75) - quantile_cont(revenue, 0.25) AS q, stddev_pop(revenue) AS d FROM y GROUP BY 1) SELECT l_suppkey, CAST(year AS INT) AS year, round(greatest(-5, least(5, (revenue - m) / CASE WHEN q > 1e-12 THEN q WHEN d > 1e-12 THEN d ELSE 1 END)), 6) AS scaled FROM y JOIN g USING (year)")
def robust_scale(spark, sf_dir):
    out = rates.robust_scale(supplier_years(spark, sf_dir), ["year"], ["revenue"])
    return rounded(out.select("l_suppkey", "year", F.col("revenue_scaled").alias("scaled")), "scaled")


@query(f"WITH {YEARS}, g AS (SELECT year, sum(lines * quantity) / sum(lines) AS m, sqrt(greatest(sum(lines * quantity * quantity) / sum(lines) - (sum(lines * quantity) / sum(lines)) ** 2, 0)) AS d FROM y GROUP BY 1) SELECT l_suppkey, CAST(year AS INT) AS year, round(CASE WHEN d > 1e-12 THEN (quantity - m) / d ELSE 0 END, 4) AS z FROM y JOIN g USING (year)")
def weighted_zscore(spark, sf_dir):
    return rounded(rates.weighted_zscore(supplier_years(spark, sf_dir), ["year"], "quantity", "lines", "z").select("l_suppkey", "year", "z"), "z", digits=4)


@query(f"WITH {YEARS} SELECT l_suppkey, CAST(year AS INT) AS year, round(100.0 * (rank() OVER (PARTITION BY year ORDER BY lines) + (count(*) OVER (PARTITION BY year, lines) - 1) / 2.0) / count(*) OVER (PARTITION BY year), 6) AS percentile FROM y")
def avg_rank_percentile(spark, sf_dir):
    return rounded(rates.average_rank_percentile(supplier_years(spark, sf_dir), ["year"], "lines", "percentile").select("l_suppkey", "year", "percentile"), "percentile")


@query("""WITH c AS (SELECT c_mktsegment AS segment, o_orderpriority AS p, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY segment) AS s FROM c)
  SELECT segment, round(coalesce(max(s) FILTER (WHERE p = '1-URGENT'), 0), 6) AS share_0, round(coalesce(max(s) FILTER (WHERE p = '2-HIGH'), 0), 6) AS share_1, round(-sum(s * ln(s)) FILTER (WHERE p IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')), 6) AS entropy FROM t GROUP BY 1""")
def entropy_mix(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("p"), F.lit(1.0).alias("one"))
    out = rates.mix_entropy(rows, ["segment"], "p", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "one")
    return rounded(out.select("segment", "share_0", "share_1", "entropy"), "share_0", "share_1", "entropy")


@query("""WITH m AS (SELECT l_suppkey, year(l_shipdate) AS year, p_brand, count(*) AS a, sum(l_quantity) AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), r AS (SELECT year, p_brand, sum(p) / sum(a) AS rate FROM m WHERE a >= 2 GROUP BY ALL)
  SELECT l_suppkey, CAST(sum(a) AS BIGINT) AS attempts, round(sum(p), 2) AS points, round(sum(a * coalesce(rate, 0)), 4) AS expected, round(sum(p) - sum(a * coalesce(rate, 0)), 4) AS over_expected FROM m LEFT JOIN r USING (year, p_brand) GROUP BY 1""")
def playtype_expected(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", F.year("l_shipdate").alias("year"), "p_brand").agg(F.count("*").alias("a"), F.sum("l_quantity").alias("p"))
    out = rates.expected_from_mix(rows, ["l_suppkey"], ["year"], "p_brand", "a", "p", 2)
    return rounded(rounded(out, "points", digits=2), "expected", "over_expected", digits=4)


@query(f"""WITH {YEARS}, e AS (SELECT year, avg(quantity) AS m FROM y GROUP BY 1), r AS (SELECT l_suppkey, year, quantity - m AS r FROM y JOIN e USING (year) WHERE year BETWEEN 1997 AND 1999)
  SELECT l_suppkey, round(max(r) FILTER (WHERE year = 1999), 4) AS latest, round(max(r) FILTER (WHERE year = 1999) - max(r) FILTER (WHERE year = 1997), 4) AS trend, round(stddev_pop(r), 4) AS volatility FROM r GROUP BY 1""")
def era_relative_trend(spark, sf_dir):
    return rounded(rates.era_profile(supplier_years(spark, sf_dir), ["l_suppkey"], "year", "quantity", 1999), "latest", "trend", "volatility", digits=4)


@query(f"""WITH {YEARS}, n AS (SELECT l_suppkey, year, CASE WHEN lines % 3 = 0 OR year = 1995 THEN NULL ELSE quantity END AS q FROM y), l AS (SELECT year, median(q) AS m FROM n GROUP BY 1) SELECT l_suppkey, CAST(year AS INT) AS year, round(coalesce(q, m, (SELECT median(q) FROM n), 0), 4) AS q FROM n JOIN l USING (year)""")
def median_impute(spark, sf_dir):
    rows = supplier_years(spark, sf_dir).select("l_suppkey", "year", F.when((F.col("lines") % 3 == 0) | (F.col("year") == 1995), None).otherwise(F.col("quantity")).alias("q"))
    return rounded(rates.median_imputed(rows, ["year"], ["q"]).select("l_suppkey", "year", "q"), "q", digits=4)


@query("SELECT CASE WHEN l_quantity <= 10 THEN 'few' WHEN l_quantity <= 30 THEN 'some' ELSE 'many' END AS bin, count(*) AS n, round(avg(l_extendedprice), 2) AS price, round(stddev_samp(l_extendedprice), 2) AS sd FROM lineitem WHERE l_quantity > 0 AND l_quantity <= 50 GROUP BY 1")
def equal_width_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("bin", s.right_closed_bin(F.col("l_quantity"), [0, 10, 30, 50], ["few", "some", "many"])).where("bin is not null")
    return rounded(rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("price"), F.stddev_samp("l_extendedprice").alias("sd")), "price", "sd", digits=2)


@query("""WITH e AS (SELECT unnest(range(1, 10)) AS i, unnest(quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM orders), b AS (SELECT o_orderkey, o_totalprice, 1 + (SELECT count(*) FROM e WHERE edge < o_totalprice) AS bin FROM orders)
  SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM b GROUP BY 1""")
def quantile_calibration(spark, sf_dir):
    rows = ranking.quantile_bins(table(spark, sf_dir, "orders"), "o_totalprice", 10)
    return rounded(rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), "mean", digits=2)


@query(f"""WITH {YEARS}, a AS (SELECT l_suppkey, year, quantity, lines, avg(quantity) OVER (PARTITION BY year) AS p FROM y) SELECT CAST(year AS INT) AS year, count(*) AS n, round(sqrt(sum(lines * (quantity - p) ** 2) / sum(lines)), 4) AS rmse, round(avg(abs(quantity - p)), 4) AS mae FROM a GROUP BY 1""")
def fit_scores(spark, sf_dir):
    rows = supplier_years(spark, sf_dir)
    rows = rows.join(rows.groupBy("year").agg(F.avg("quantity").alias("p")), "year")
    return rounded(rates.fit_scores(rows, ["year"], "quantity", "p", F.col("lines")).select("year", "n", "rmse", "mae"), "rmse", "mae", digits=4)


@query("""WITH a AS (SELECT event_type, CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END AS y, 1 / (1 + exp(-(event_id % 17 - 8) / 4.0)) AS p FROM events), r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY p) + (count(*) OVER (PARTITION BY event_type, p) - 1) / 2.0 AS r FROM a)
  SELECT event_type, round(avg((p - y) ** 2), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY 1""")
def probability_scores(spark, sf_dir):
    p = 1 / (1 + F.exp(-(F.col("event_id") % 17 - 8) / 4.0))
    rows = events(spark, sf_dir).select("event_type", (F.col("value") > 40).cast("int").alias("y"), p.alias("p"))
    return rounded(rates.probability_scores(rows, ["event_type"], "y", "p"), "brier", "log_loss", "accuracy", "auc")


@query(f"""WITH {YEARS}, l AS (SELECT year, 'quantity' AS metric, quantity AS v FROM y UNION ALL SELECT year, 'revenue', revenue FROM y) SELECT CAST(year AS INT) AS year, metric, round(quantile_cont(v, 0.1), 2) AS p10, round(median(v), 2) AS median, round(quantile_cont(v, 0.9), 2) AS p90, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 2) AS iqr FROM l GROUP BY ALL""")
def spread_profile(spark, sf_dir):
    return rounded(rates.spread_profile(supplier_years(spark, sf_dir), ["year"], ["quantity", "revenue"]), "p10", "median", "p90", "iqr", digits=2)


@query(f"WITH {YEARS} SELECT l_suppkey, round(regr_slope(quantity, year), 4) AS slope, round(regr_intercept(quantity, year), 2) AS intercept, count(*) AS n FROM y GROUP BY 1")
def metric_trends(spark, sf_dir):
    return rounded(rounded(rates.line_by_group(supplier_years(spark, sf_dir), ["l_suppkey"], "year", "quantity"), "slope", digits=4), "intercept", digits=2)


@query("""WITH d AS (SELECT o_custkey, o_orderpriority AS st, o_totalprice AS v, 1.0 AS w FROM orders), m AS (SELECT o_custkey, st, avg(v) AS m FROM d GROUP BY ALL), r AS (SELECT st, count(*) / (SELECT count(*) FROM d) AS s FROM d GROUP BY 1)
  SELECT o_custkey, round(sum(m * s) / sum(s), 2) AS standardized FROM m JOIN r USING (st) GROUP BY 1""")
def standardized_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("w", F.lit(1.0))
    total = rows.count()
    mix = rows.groupBy("o_orderpriority").agg((F.count("*") / F.lit(total)).alias("share"))
    return rounded(rates.standardized_mean(rows, ["o_custkey"], "o_orderpriority", "o_totalprice", "w", mix, "share"), "standardized", digits=2)


# ranking -------------------------------------------------------------------------------------------------------------


@query(f"WITH {YEARS}, r AS (SELECT l_suppkey, revenue, lines, row_number() OVER (ORDER BY revenue DESC, lines DESC, l_suppkey) AS rank FROM y WHERE year = 1997 AND lines >= 5) SELECT l_suppkey, round(revenue, 2) AS revenue, rank FROM r WHERE rank BETWEEN 6 AND 15")
def leaderboard_page(spark, sf_dir):
    page = ranking.leaderboard(supplier_years(spark, sf_dir), (F.col("year") == 1997) & (F.col("lines") >= 5), [F.desc("revenue"), F.desc("lines"), F.asc("l_suppkey")], 5, 10)
    return rounded(page.select("l_suppkey", "revenue", F.col("rank").cast("long").alias("rank")), "revenue", digits=2)


@query(f"WITH {YEARS}, r AS (SELECT l_suppkey, year, lines, CASE WHEN quantity > 100 THEN rank() OVER (PARTITION BY year, quantity > 100 ORDER BY lines DESC) END AS rank FROM y) SELECT l_suppkey, CAST(year AS INT) AS year, rank FROM r")
def eligible_rank(spark, sf_dir):
    return ranking.rank_within(supplier_years(spark, sf_dir), ["year"], "lines", F.col("quantity") > 100).select("l_suppkey", "year", "rank")


@query(f"WITH {YEARS} SELECT l_suppkey, CAST(year AS INT) AS year, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY revenue DESC, l_suppkey) AS n FROM y) WHERE n <= 3")
def top_per_group(spark, sf_dir):
    return ranking.top_per_group(supplier_years(spark, sf_dir), ["year"], [F.desc("revenue"), F.asc("l_suppkey")], 3).select("l_suppkey", "year", F.col("rank").cast("long").alias("rank"))


WINDOWS = """b AS (SELECT l_suppkey, min(year) AS lo, max(year) AS hi FROM y GROUP BY 1), w AS (SELECT l_suppkey, unnest(range(lo, hi - 1)) AS window_start FROM b), m AS (SELECT w.l_suppkey, w.window_start, sum(quantity * lines) / sum(lines) AS mean, sum(lines) AS weight FROM w JOIN y ON y.l_suppkey = w.l_suppkey AND year BETWEEN window_start AND window_start + 2 GROUP BY ALL)"""


@query(f"WITH {YEARS}, {WINDOWS}, p AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY mean DESC, window_start) AS n FROM m) SELECT l_suppkey, CAST(window_start AS INT) AS window_start, round(mean, 4) AS mean, rank() OVER (ORDER BY mean DESC) AS peak_rank FROM p WHERE n = 1")
def peaks(spark, sf_dir):
    return rounded(ranking.peaks(supplier_years(spark, sf_dir), ["l_suppkey"], "year", "quantity", "lines", 3).select("l_suppkey", "window_start", "mean", "peak_rank"), "mean", digits=4)


@query("SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'red' THEN 0 WHEN lower(p_name) LIKE 'red%' THEN 1 ELSE 2 END AS match_kind FROM part WHERE lower(p_name) LIKE '%red%' ORDER BY match_kind, p_name, p_partkey LIMIT 20")
def search_ranked(spark, sf_dir):
    return ranking.search(table(spark, sf_dir, "part"), "p_name", "Red", ["p_name", "p_partkey"]).select("p_partkey", "p_name", "match_kind")


@query("""SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey), '') AS order_keys, round(coalesce(sum(o_totalprice), 0), 2) AS total
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def profile_nested(spark, sf_dir):
    """A customer's nested orders, read back: their number, their keys in order and their sum."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_totalprice")
    found = ranking.profile(table(spark, sf_dir, "customer"), "c_custkey", {"orders": (orders, ["o_orderdate", "o_orderkey"])})
    own = F.coalesce("orders", F.array().cast(found.schema["orders"].dataType))
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x["o_totalprice"])
    return found.select("c_custkey", "c_name", F.size(own).cast("long").alias("n_orders"), F.array_join(F.transform(own, lambda x: x["o_orderkey"].cast("string")), ",").alias("order_keys"), F.round(total, 2).alias("total"))


# filters -------------------------------------------------------------------------------------------------------------


@query(f"WITH {YEARS} SELECT a.l_suppkey, CAST(a.year AS INT) AS year, round(sum(b.quantity * b.lines * 0.7 ** (a.year - b.year)) / sum(b.lines * 0.7 ** (a.year - b.year)), 4) AS filtered FROM y a JOIN y b ON a.l_suppkey = b.l_suppkey AND b.year <= a.year GROUP BY a.l_suppkey, a.year")
def decay_filter(spark, sf_dir):
    return rounded(filters.decayed_mean(supplier_years(spark, sf_dir), ["l_suppkey"], "year", "quantity", "lines", 0.7).select("l_suppkey", "year", "filtered"), "filtered", digits=4)


@query(f"""WITH RECURSIVE {YEARS}, o AS (SELECT l_suppkey, year, quantity / 1000.0 AS x, 1.0 / lines AS r, row_number() OVER (PARTITION BY l_suppkey ORDER BY year) AS n, coalesce(year - lag(year) OVER (PARTITION BY l_suppkey ORDER BY year), 0) AS g FROM y),
  k AS (SELECT l_suppkey, year, n, 0.0::DOUBLE AS p, 1.0 / (1.0 + r) * x AS m, r / (1.0 + r) AS v FROM o WHERE n = 1 UNION ALL
  SELECT o.l_suppkey, o.year, o.n, k.m * 0.9 ** g, k.m * 0.9 ** g + (k.v * 0.9 ** (2 * g) + 0.1 * (1 - 0.9 ** (2 * g)) / 0.19) / (k.v * 0.9 ** (2 * g) + 0.1 * (1 - 0.9 ** (2 * g)) / 0.19 + r) * (x - k.m * 0.9 ** g),
  (k.v * 0.9 ** (2 * g) + 0.1 * (1 - 0.9 ** (2 * g)) / 0.19) * r / (k.v * 0.9 ** (2 * g) + 0.1 * (1 - 0.9 ** (2 * g)) / 0.19 + r) FROM k JOIN o ON o.l_suppkey = k.l_suppkey AND o.n = k.n + 1)
  SELECT l_suppkey, CAST(year AS INT) AS year, round(p, 6) AS predicted, round(m, 6) AS filtered, round(v, 6) AS filtered_variance FROM k""")
def kalman_filter(spark, sf_dir):
    rows = supplier_years(spark, sf_dir).select("l_suppkey", "year", (F.col("quantity") / 1000.0).alias("x"), (1.0 / F.col("lines")).alias("r"))
    out = filters.kalman(rows, ["l_suppkey"], "year", "x", "r", phi=0.9, noise=0.1)
    return rounded(out.select("l_suppkey", "year", "predicted", "filtered", "filtered_variance"), "predicted", "filtered", "filtered_variance")


def supplier_games(spark, sf_dir):
    region = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("league"))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").join(region, "l_suppkey")
    side = lambda k, c: F.min(F.when(F.col("l_linenumber") == k, F.struct("l_suppkey", "l_quantity", "l_shipdate")))[c]
    games = lines.groupBy("league", "l_orderkey").agg(F.to_date(F.date_trunc("week", side(1, "l_shipdate"))).alias("day"), side(1, "l_suppkey").alias("home"), side(2, "l_suppkey").alias("away"), (side(1, "l_quantity") - side(2, "l_quantity")).alias("margin"))
    return games.where("home <> away").withColumn("season", F.year("day")).drop("l_orderkey")


@query()
def elo_batched(spark, sf_dir):
    """An order's first two lines are a game of their suppliers, if these are of one region, its league; quantities are the score, and the games of a week are applied together."""
    return rounded(filters.elo(supplier_games(spark, sf_dir), ["league"], "day", "season", "home", "away", "margin"), "home_before", "away_before")


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, month(ts) AS s, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  k AS (SELECT user_id, event_id, n, s, 0.0::DOUBLE AS b, 0.1 * v AS m FROM o WHERE n = 1 UNION ALL
  SELECT o.user_id, o.event_id, o.n, o.s, CASE WHEN o.s <> k.s THEN 0.75 * k.m ELSE k.m END, 0.9 * CASE WHEN o.s <> k.s THEN 0.75 * k.m ELSE k.m END + 0.1 * o.v FROM k JOIN o ON o.user_id = k.user_id AND o.n = k.n + 1)
  SELECT event_id, round(b, 6) AS value_ewma FROM k""")
def ewma_before(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("season", F.month("ts"))
    return rounded(filters.ewma_before(rows, ["user_id"], ORDER, "season", "value").select("event_id", "value_ewma"), "value_ewma")


@query()
def lineup_replay(spark, sf_dir):
    """The five least suppliers of a year start; every line item brings its supplier on (even keys) or takes it off, an order's at once."""
    lines = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), "l_suppkey", "l_orderkey")
    starters = ranking.top_per_group(lines.select("year", "l_suppkey").distinct(), ["year"], [F.asc("l_suppkey")], 5).groupBy("year").agg(F.array_sort(F.collect_list("l_suppkey")).alias("players"))
    marks = lines.withColumn("direction", F.when(F.col("l_suppkey") % 2 == 0, "in").otherwise("out"))
    return filters.replay_lineups(starters, filters.simultaneous(marks, ["year"], ["l_orderkey"], "l_suppkey", "direction"), ["year"], "l_orderkey")


@query("""WITH a AS (SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END AS o FROM events) SELECT event_id, coalesce(o, last_value(o IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(o IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS owner,
  CASE WHEN o IS NOT NULL THEN 'own' WHEN last_value(o IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) IS NOT NULL THEN 'before' WHEN first_value(o IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) IS NOT NULL THEN 'after' ELSE 'none' END AS known_by
  FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def owner_machine(spark, sf_dir):
    anchor = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type"))
    return filters.owner_sequence(events(spark, sf_dir), ["user_id"], ORDER, anchor).select("event_id", "owner", "known_by")


@query(r"""WITH RECURSIVE w AS (SELECT l_suppkey, year(l_shipdate) AS year, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS n, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS r FROM lineitem GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY year) AS i FROM w), k AS (SELECT l_suppkey, year, i, a, n, r FROM o WHERE i = 1 UNION ALL
  SELECT o.l_suppkey, o.year, o.i, CASE WHEN o.year = k.year + 1 THEN 0.6 * k.a + 0.4 * o.a ELSE o.a END, CASE WHEN o.year = k.year + 1 THEN 0.6 * k.n + 0.4 * o.n ELSE o.n END, CASE WHEN o.year = k.year + 1 THEN 0.6 * k.r + 0.4 * o.r ELSE o.r END
  FROM k JOIN o ON o.l_suppkey = k.l_suppkey AND o.i = k.i + 1) SELECT l_suppkey, CAST(year AS INT) AS year, round(a, 6) AS "share_A", round(n, 6) AS "share_N", round(r, 6) AS "share_R" FROM k""")
def affinity_smoothing(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    wide = lines.groupBy("l_suppkey", "year").agg(*[F.avg((F.col("l_returnflag") == f).cast("double")).alias(f"share_{f}") for f in "ANR"])
    return rounded(filters.smoothed_vectors(wide, ["l_suppkey"], "year", ["share_A", "share_N", "share_R"], 0.4).drop("leading"), "share_A", "share_N", "share_R")


# normal equations and resampling -------------------------------------------------------------------------------------


def order_design(spark, sf_dir):
    """An order as a row: its suppliers in one block, its line numbers in another."""
    lines = filters.dealt_by_size(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), ["l_orderkey"])
    rows = lines.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"), F.collect_set("l_linenumber").alias("n"))
    return ridge.lineup_design(rows, "l_orderkey", {"supplier": F.col("s"), "line": F.col("n")})


def order_response(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 1000.0).alias("y"))


DESIGN = "d AS (SELECT DISTINCT l_orderkey, 'supplier' AS b, CAST(l_suppkey AS VARCHAR) AS e FROM lineitem UNION SELECT DISTINCT l_orderkey, 'line', CAST(l_linenumber AS VARCHAR) FROM lineitem)"


@query(f"WITH {DESIGN} SELECT i.b AS block_i, i.e AS entity_i, j.b AS block_j, j.e AS entity_j, CAST(count(*) AS DOUBLE) AS value FROM d i JOIN d j USING (l_orderkey) WHERE j.b < i.b OR (j.b = i.b AND j.e <= i.e) GROUP BY ALL")
def gram_entries(spark, sf_dir):
    return ridge.gram_entries(order_design(spark, sf_dir), "l_orderkey")


@query(f"WITH {DESIGN} SELECT b AS block, e AS entity, round(sum(o_totalprice / 1000.0), 6) AS xy, CAST(count(*) AS DOUBLE) AS exposure FROM d JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def gram_moments(spark, sf_dir):
    return rounded(ridge.moments(order_design(spark, sf_dir), order_response(spark, sf_dir), "l_orderkey", "y"), "xy")


@query("SELECT o_orderpriority, round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 2) AS intercept FROM orders GROUP BY 1")
def ridge_two_param(spark, sf_dir):
    return rounded(rounded(ridge.two_parameters(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_custkey", "o_totalprice"), "slope"), "intercept", digits=2)


@query()
def block_ridge(spark, sf_dir):
    """A coefficient for each supplier, however many."""
    found = packed.equations(order_design(spark, sf_dir), order_response(spark, sf_dir), "l_orderkey", "y", files.scratch(spark))
    beta, mean = found.solve({"supplier": 10.0, "line": 5.0})
    beta, _ = found.recentered(beta, mean, ["supplier", "line"])
    return rounded(ridge.coefficients(spark, found.columns, beta), "beta")


@query(f"WITH {DESIGN} SELECT l_orderkey, round(2.0 + sum(CASE WHEN b = 'supplier' THEN CAST(e AS INT) / 100.0 ELSE 0.5 END), 6) AS predicted, count(*) FILTER (WHERE false) AS unknown FROM d GROUP BY 1")
def row_score_rollup(spark, sf_dir):
    design = order_design(spark, sf_dir)
    beta = design.select("block", "entity").distinct().withColumn("beta", F.when(F.col("block") == "supplier", F.col("entity").cast("int") / 100.0).otherwise(0.5))
    return rounded(ridge.predicted(design, beta, "l_orderkey", 2.0), "predicted")


POISSON = " ".join(f"WHEN u < {e!r} THEN {k}" for k, e in enumerate(resample.poisson_edges()))


@query(f"""WITH s AS (SELECT year(l_shipdate) AS year, l_orderkey, sum(l_discount - l_tax) AS v, count(*) AS n FROM lineitem GROUP BY ALL), d AS (SELECT unnest(range(0, 50)) AS draw),
  u AS (SELECT draw, v, n, CAST(('0x' || substr(md5('7|' || draw || '|' || year || '|' || l_orderkey), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM s, d), w AS (SELECT draw, v, n, CASE {POISSON} ELSE 12 END AS w FROM u),
  m AS (SELECT draw, sum(w * v) / sum(w * n) AS mean FROM w GROUP BY 1)
  SELECT round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS se, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0.0 END) AS p_positive FROM m""")
def cluster_bootstrap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"year": F.year("l_shipdate"), "loss": F.col("l_discount") - F.col("l_tax")})
    return rounded(resample.interval(resample.bootstrap_means(rows, ["year"], "l_orderkey", "loss", 50, 7), (), "mean"), "mean", "se", "low", "high")


# documents -----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.from_json("props", "k bigint")["k"].alias("k"), "value")
    return rounded(rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS DOUBLE) AS number FROM pages")
def html_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), readers.page_number(F.col("url"), r"/([0-9]+)").alias("number"))


@query("""SELECT p_partkey, printf('%010d', p_partkey) AS padded, CASE WHEN p_size >= 40 THEN 'large' WHEN p_size >= 20 THEN 'medium' ELSE 'small' END AS tier, greatest(0.0, p_size - 25.0) AS hinge, printf('PT%02dM%02d.50S', p_size % 12, p_size) AS clock,
  CAST((p_size % 12) * 60 + p_size + 0.5 AS DOUBLE) AS seconds, CAST(CASE WHEN p_size % 6 + 1 <= 4 THEN (p_size % 6) * 720 + 720 ELSE 2880 + (p_size % 6 - 4) * 300 + 300 END - 100.0 AS DOUBLE) AS elapsed FROM part""")
def scalar_functions(spark, sf_dir):
    size = F.col("p_size")
    clock = F.format_string("PT%02dM%02d.50S", size % 12, size)
    return table(spark, sf_dir, "part").select("p_partkey", s.padded_id(F.col("p_partkey")).alias("padded"), s.tier(size, [(40, "large"), (20, "medium")], "small").alias("tier"), s.hinge(size.cast("double"), 25.0).alias("hinge"), clock.alias("clock"), s.iso_seconds(clock).alias("seconds"), s.elapsed_seconds(size % 6 + 1, F.lit(100.0)).alias("elapsed"))


from . import domain, files, forward, lineups, selection  # noqa: E402, F401  they register their queries here
