"""Connected components by alternating star contractions on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the least node it knows."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From undirected edges (u, v), (node, label) of every node of an edge; label: the least node of its component.

    Each round halves the depth of the trees, and its edges are written, so no lineage grows.  Self-edges, repeated
    edges and edges in both directions are allowed; null ends are not.
    """
    edges = written(edges.where("u <> v").select("u", "v"), "edges")
    before = None
    for _ in range(most_rounds):
        seen = Observation()
        step = _small_star(_large_star(edges)).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("digest"))
        edges = written(step, "edges")
        now = tuple(seen.get[x] for x in ("n", "digest"))  # gathered while writing
        if now == before or not now[0]:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return stars.unionAll(stars.select(F.col("label").alias("node"), "label").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
