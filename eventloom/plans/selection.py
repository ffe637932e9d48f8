"""Queries over model selection: projections from earlier seasons, spline columns, signal of hashed ids, published tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from ..operators.joins import shifted_self_join
from ..sources import lineage
from .catalog import YEARS, query, rounded, supplier_years, table
from .files import scratch

FIRST, PHI, STRENGTH = 1999, 0.6, 3.0


@query(f"""WITH {YEARS}, t AS (SELECT a.l_suppkey, a.year, a.year - 1990 + a.l_suppkey % 9 AS age, {PHI} * a.quantity / a.lines AS base, b.quantity / b.lines AS target, sqrt(least(a.lines, b.lines)) AS w FROM y a JOIN y b ON b.l_suppkey = a.l_suppkey AND b.year = a.year + 1),
  r AS (SELECT *, target - base AS r FROM t), k AS (SELECT DISTINCT year AS s FROM t),
  m AS (SELECT s, count(*) AS n, CASE WHEN stddev_pop(age) < 1e-12 THEN 1.0 ELSE stddev_pop(age) END AS sd, sum(w * age) / sum(w) AS ca, sum(w * r) / sum(w) AS cr, sum(w * age * r) - sum(w * age) * sum(w * r) / sum(w) AS xy, sum(w * age * age) - sum(w * age) ** 2 / sum(w) AS xx
    FROM k JOIN r ON r.year < s - 1 GROUP BY s), b AS (SELECT *, xy / sd / (xx / (sd * sd) + {STRENGTH}) / sd AS beta FROM m WHERE s >= {FIRST} AND n >= 2)
  SELECT l_suppkey, CAST(year AS INT) AS year, round(base, 6) AS base, round(base + coalesce(cr - beta * ca + beta * age, 0), 6) AS predicted FROM t LEFT JOIN b ON s = year""")
def residual_projection(spark, sf_dir):
    """A supplier's next mean quantity: a share of this one's, and what earlier years say of its age."""
    rows = supplier_years(spark, sf_dir).select("l_suppkey", "year", (F.col("quantity") / F.col("lines")).alias("x"), "lines")
    pairs = shifted_self_join(rows, ["l_suppkey"], "year", ["x", "lines"]).withColumns({"age": (F.col("year") - 1990 + F.col("l_suppkey") % 9).cast("double"), "w": F.sqrt(F.least("lines", "next_lines"))})
    found = models.residual_projection(pairs, "year", PHI * F.col("x"), "next_x", ["age"], "w", STRENGTH, FIRST)
    return rounded(found.select("l_suppkey", "year", "base", "predicted"), "base", "predicted")


def _basis(i: int, d: int, full: list[str]) -> str:
    """SQL of one basis function by its recursion; full: names of the knots, the outer ones repeated."""
    same = lambda a, b: full[a] == full[b]
    if d == 0:
        return "0.0" if same(i, i + 1) else f"(CASE WHEN x >= {full[i]} AND (x < {full[i + 1]}{f' OR x = {full[i + 1]}' if full[i + 1] == full[-1] else ''}) THEN 1.0 ELSE 0.0 END)"
    left = "0.0" if same(i, i + d) else f"(x - {full[i]}) / ({full[i + d]} - {full[i]}) * {_basis(i, d - 1, full)}"
    right = "0.0" if same(i + 1, i + d + 1) else f"({full[i + d + 1]} - x) / ({full[i + d + 1]} - {full[i + 1]}) * {_basis(i + 1, d - 1, full)}"
    return f"({left} + {right})"


_FULL = ["k0", "k0", "k0", "k1", "k2", "k3", "k3", "k3"]


@query(f"""WITH k AS (SELECT quantile_cont(o_totalprice, 0) AS k0, quantile_cont(o_totalprice, 1 / 3.0::DOUBLE) AS k1, quantile_cont(o_totalprice, 2 / 3.0::DOUBLE) AS k2, quantile_cont(o_totalprice, 1) AS k3 FROM orders), v AS (SELECT o_orderkey, o_totalprice AS x, k.* FROM orders, k)
  SELECT o_orderkey, {', '.join(f'round({_basis(i, 2, _FULL)}, 6) AS s_{i}' for i in range(5))} FROM v""")
def spline_columns(spark, sf_dir):
    """Quadratic basis functions of an order's price, with knots at its exact terciles."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    columns = models.spline_basis(F.col("o_totalprice"), models.exact_knots(orders, "o_totalprice", 4), 2, "s")
    return rounded(orders.select("o_orderkey", *columns), *[f"s_{i}" for i in range(5)])


@query()
def flag_signal(spark, sf_dir):
    """Whether a line's supplier tells more of its return flag than its month and quantity do, on the later part of the orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("supplier"), F.month("l_shipdate").alias("month"), "l_quantity", "l_returnflag", (F.year("l_shipdate") < 2000).alias("train"))
    found = models.added_signal(lines, "train", "l_orderkey", ["month"], ["supplier"], ["l_quantity"], "l_returnflag", draws=50, buckets=1 << 14, strength=1e-4, rounds=20, tolerance=1e-4)
    return rounded(found.select("model", "rows", "log_loss", "brier"), "log_loss", "brier", digits=3)


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1")
def published_orders(spark, sf_dir):
    """The second of two published versions, verified by the sums of its rows' hashes."""
    root, orders = scratch(spark), table(spark, sf_dir, "orders")
    lineage.publish(orders, root)
    lineage.publish(orders.where("o_orderkey % 2 = 1"), root)
    rows = lineage.published(spark, root, verify=True)
    return rounded(rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), "total", digits=2)
