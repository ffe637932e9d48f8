"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; column expressions only.

1. Targets: sources share the total by weight; a target stops at ``most`` times its source, and the excess is shared
   anew (closed form: sorted by cap over weight, capped sources come first).
2. Blocks: a hash permutes each source's documents; equal ranges of the hash are its blocks.  A source passes over
   all its blocks for every whole multiple of its size in the target, and over the first ones for the rest; the
   document on the edge gives just the words that are still missing.
3. Splitting tree: the root holds the number of drawn blocks of each source.  A node deals half of its blocks to its
   left child; how many come from each source is drawn from the multivariate hypergeometric distribution, so the
   quotas stay exact.  The leaves are the output shards, and each takes disjoint runs of the permuted blocks.
4. A shard's draws are shuffled locally by a hash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, word_count, written
from .exact import hypergeometric, let

WEIGHTS = (5.0, 2.0, 1.0)


def hash32(*parts):
    """The first 32 bits of an md5 over the parts' text; reruns agree."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = 3.0) -> DataFrame:
    """From (source, source_size), one row a source: (source, source_size, target)."""
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("total", F.sum("source_size").over(everything))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = capped.withColumn("level", (F.col("total") - before) / rest)
    level = level.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    return level.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def leaf_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """From (source_key, draws), the splitting tree's leaves: (source_key, shard, n), n of the source's draws.

    The tree holds one row a node with one number a source, never a document; it is written after every second level.
    """
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("source_key", F.col("draws").alias("n")))).alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    for level in range(levels):
        if level and level % 2 == 0:
            node = written(node, "mix-tree")  # keeps the plan small
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        start = F.struct(total.alias("population"), F.floor(total / 2).cast("long").alias("draws"), F.array().cast("array<bigint>").alias("left"))

        stem = F.lit(f"{seed}|{level}")

        def deal(acc, x):
            u = (hash32(stem, F.col("node"), x["source_key"]) + 0.5) / F.lit(2.0**32)  # noqa: B023  used at once
            k = hypergeometric(acc["population"], x["n"], acc["draws"], u)
            return let(k, lambda k: F.struct((acc["population"] - x["n"]).alias("population"), (acc["draws"] - k).alias("draws"), F.concat(acc["left"], F.array(k)).alias("left")))

        node = node.withColumn("left", F.aggregate("q", start, deal)["left"])
        child = lambda right: F.transform("q", lambda x, i: F.struct(x["source_key"].alias("source_key"), (x["n"] - F.get("left", i) if right else F.get("left", i)).alias("n")))
        node = node.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), child(False).alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), child(True).alias("q")))).alias("c")).select("c.*")
    return node.select(F.col("node").cast("int").alias("shard"), F.explode("q").alias("x")).select("x.source_key", "shard", "x.n")


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """The leaves by source: (source_key, ends), ends[i]: draws up to shard i."""
    running = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = leaf_quotas(quotas, levels, seed).withColumn("end", F.sum("n").over(running))
    ends = ends.groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("shard", "end"))).alias("ends"))
    return ends.select("source_key", F.transform("ends", lambda x: x["end"]).alias("ends"))


def row_key():
    """A hash of id, source and text; nulls differ from empty values."""
    part = lambda c: F.md5(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).cast("binary"))
    return F.md5(F.concat(part("doc_id"), part("source"), part("text")).cast("binary"))


def source_key():
    """A key for the column source; null differs from the empty text."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def position(seed: int):
    """Where a row lies among its source's: a hash of id and text."""
    return hash32(F.lit(seed), F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _blocks(slim: DataFrame, weights, most: float, block_words: int, shard_words: int, levels: int | None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """From (source, source_key, size, h): slim with its block, targets (a row a source), bases (a row a block: base, the words before it), and the tree's levels."""
    # pre-summed within each task, so a source with a third of all rows reaches the final sum as a few rows
    sizes = slim.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, most).withColumn("source_key", source_key()).drop("source")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("passes", passes).withColumn("rest", F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
    targets = written(targets.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")), "mix-targets")
    if levels is None:
        words = targets.agg(F.sum("source_size")).first()[0] or 0
        levels = max(4, math.ceil(math.log2(max(1.0, words / shard_words))))

    block = F.shiftright(F.col("h") * F.col("blocks"), 32)
    dealt = slim.join(targets.select("source_key", "blocks"), "source_key").withColumn("block", block)
    # words before a block: those of earlier groups of 4,096 blocks, and of earlier blocks of its own group
    sums = written(dealt.groupBy("source_key", "block").agg(F.sum("size").alias("block_size")).withColumn("group", F.shiftright("block", 12)), "mix-sums")
    ahead = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("source_key", "group").agg(F.sum("block_size").alias("n"))
    groups = groups.select("source_key", "group", F.coalesce(F.sum("n").over(ahead("source_key", "group")), F.lit(0)).alias("start"))
    bases = sums.withColumn("base", F.coalesce(F.sum("block_size").over(ahead("source_key", "group", "block")), F.lit(0))).join(groups, ["source_key", "group"])
    bases = bases.select("source_key", "block", (F.col("base") + F.col("start")).alias("base")).join(targets.drop("source_size", "target"), "source_key")
    return dealt, targets, written(bases, "mix-blocks"), levels


def _edges(bases: DataFrame) -> DataFrame:
    """Each source's last block that the rest of its target touches: (source_key, edge, base).  Earlier blocks are taken whole, later ones not at all."""
    return bases.where(F.col("base") < F.col("rest")).groupBy("source_key").agg(F.max("block").alias("edge"), F.max("base").alias("base"))


def _draw_numbers(targets: DataFrame, bases: DataFrame) -> DataFrame:
    """How many blocks each source draws: (source_key, draws)."""
    found = targets.join(_edges(bases), "source_key", "left")
    return found.select("source_key", (F.col("passes") * F.col("blocks") + F.coalesce(F.col("edge") + 1, F.lit(0))).cast("long").alias("draws"))


def leaf_of(ends, draw, levels: int):
    """The leaf that holds a draw's number, down the tree: how many of the 2^levels ends are not above it."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(levels))])
    return F.aggregate(steps, F.lit(0), lambda leaf, step: F.when(F.get(ends, leaf + step - 1) <= draw, leaf + step).otherwise(leaf))


def mixed(docs: DataFrame, *, weights=WEIGHTS, most: float = 3.0, block_words: int = 65_536, shard_words: int = 1 << 26, levels: int | None = None, seed: int = 17, keyed: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, draws (array of copy, shard, words), n_shards.

    keyed adds row_key, which tells rows of one id apart.  levels: of the splitting tree, which has 2^levels shards; if not given, so
    many that a shard has about shard_words words, and 4 at least.

    A null text has size 0, a null source is a source of its own, and a null doc_id hashes as the empty text.
    Equal rows are told apart by their place in the order only, so together they give the same rows in every run.
    Sources without words have target 0.  An empty table gives an empty result.  Other columns are ignored.
    """
    key = ["row_key"] if keyed else []
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), position(seed).alias("h"), *([row_key().alias("row_key")] if keyed else []))
    slim = written(slim.withColumn("source_key", source_key()), "mix-sizes")
    dealt, targets, bases, levels = _blocks(slim, weights, most, block_words, shard_words, levels)

    # a source's draws are numbered pass by pass and block by block; each shard takes the next ones, as many as its leaf says
    running = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leaves = leaf_quotas(_draw_numbers(targets, bases), levels, seed).withColumn("end", F.sum("n").over(running)).where("n > 0")
    numbers = leaves.select("source_key", "shard", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("draw"))
    drawn = bases.select("source_key", "block", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda c: c * F.col("blocks") + F.col("block"))).alias("copy", "draw"))
    shards = drawn.join(numbers, ["source_key", "draw"]).groupBy("source_key", "block").agg(F.map_from_entries(F.collect_list(F.struct("copy", "shard"))).alias("shards"))
    plan = written(bases.join(shards, ["source_key", "block"], "left"), "mix-plan")

    rows = dealt.drop("blocks").join(plan, ["source_key", "block"]).join(targets.select("source_key", "source_size", "target"), "source_key")
    inside = Window.partitionBy("source_key", "block").orderBy("h", "doc_id", "size", *key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    draw = lambda copy, n: F.struct(copy.cast("int").alias("copy"), F.try_element_at("shards", copy.cast("int")).alias("shard"), n.alias("words"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before")))
    whole = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), lambda c: draw(c, F.col("size"))))
    last = F.when(part > 0, F.array(draw(F.col("passes"), part)))
    none = F.array().cast("array<struct<copy:int,shard:int,words:bigint>>")
    draws = F.concat(F.coalesce(whole, none), F.coalesce(last, none))
    return rows.select("doc_id", "source", "size", "source_size", "target", draws.alias("draws"), F.lit(1 << levels).alias("n_shards"), *key)


def sharded(docs: DataFrame, mix: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: docs' columns, copy, shard and words to take, each shard together and shuffled locally.

    doc_id is unique in docs and mix here.
    """
    draws = mix.select("doc_id", F.explode("draws").alias("d")).select("doc_id", F.col("d.copy").alias("copy"), F.col("d.shard").alias("shard"), F.col("d.words").alias("words"))
    own = [c for c in docs.columns if c not in ("copy", "shard", "words")]
    order = hash32(F.lit(seed), F.lit("local"), F.col("doc_id"), F.col("copy"))
    spread = F.pmod(order, F.lit(64))  # a shard is written by many tasks
    return docs.select(*own).join(draws, "doc_id").repartition("shard", spread).sortWithinPartitions("shard", order)


def first_words(text, n):
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, rf"(?<=[^{SPACE}])(?=[{SPACE}])"), 1, n), "")


def _drawn(docs: DataFrame, *, weights=WEIGHTS, most: float = 3.0, block_words: int = 65_536, shard_words: int = 1 << 26, levels: int | None = None, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target and draws, as in mixed(), without a shuffle of the texts.

    A row's draws follow from its source's figures and its block, but in the one block a source that its target cuts; only
    those rows meet in a window.  Rows that are equal in all but other columns are told apart by these.
    """
    slim = written(docs.select("source", source_key().alias("source_key"), word_count(F.col("text")).alias("size"), position(seed).alias("h")), "mix-sizes")
    _, targets, bases, levels = _blocks(slim, weights, most, block_words, shard_words, levels)
    found = targets.join(_edges(bases), "source_key", "left").join(split_quotas(_draw_numbers(targets, bases), levels, seed), "source_key")
    figures = F.struct("source_size", "target", "passes", "rest", "blocks", F.coalesce("edge", F.lit(-1)).alias("edge"), "base", "ends")
    sources = written(found.select(F.col("source_key").alias("_mix_source"), figures.alias("_mix_of")), "mix-sources")

    own = [F.col(f"`{c}`") for c in docs.columns]
    of = F.col("_mix_of")
    rows = docs.select(*own, source_key().alias("_mix_source"), position(seed).alias("_mix_h")).join(sources, "_mix_source")
    rows = rows.withColumn("_mix_block", F.shiftright(F.col("_mix_h") * of["blocks"], 32)).withColumn("size", word_count(F.col("text")))
    cut = (F.col("_mix_block") == of["edge"]) & (F.col("size") > 0)
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    inside = Window.partitionBy("_mix_source").orderBy("_mix_h", "doc_id", "size", row_key(), others).rowsBetween(Window.unboundedPreceding, -1)
    before = of["base"] + F.coalesce(F.sum("size").over(inside), F.lit(0))
    edge = rows.where(cut).withColumn("_mix_part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), of["rest"] - before)))
    rest = rows.where(~cut).withColumn("_mix_part", F.when(F.col("_mix_block") < of["edge"], F.col("size")).otherwise(0).cast("long"))

    def draw(copy, n):
        return F.struct(copy.cast("int").alias("copy"), leaf_of(of["ends"], copy * of["blocks"] + F.col("_mix_block"), levels).alias("shard"), n.alias("words"))

    none = F.array().cast("array<struct<copy:int,shard:int,words:bigint>>")
    whole = F.when(of["passes"] > 0, F.transform(F.sequence(F.lit(0).cast("long"), of["passes"] - 1), lambda c: draw(c, F.col("size"))))
    last = F.when(F.col("_mix_part") > 0, F.array(draw(of["passes"], F.col("_mix_part"))))
    return rest.unionByName(edge).select(*own, "size", of["source_size"].alias("source_size"), of["target"].alias("target"), F.concat(F.coalesce(whole, none), F.coalesce(last, none)).alias("draws"))


def mixture(docs: DataFrame, *, seed: int = 17, **options) -> DataFrame:
    """The mix itself, one row a draw: docs' columns, size, source_size, target, copy, shard and words.

    The text of a draw holds its words only, and n_chars, if there, follows it.  A row that is not drawn at all comes once, with
    null copy, shard and text, and no words, so every row is accounted for; `shard is not null` is the corpus.  Rows of
    a shard lie together in the order of a hash.  Ids may repeat or be null.  The new columns replace those of the same name.
    """
    docs = docs.drop("size", "source_size", "target", "copy", "shard", "words", "draws", "row_key")
    rows = _drawn(docs, seed=seed, **options)
    order = hash32(F.lit(seed), F.lit("local"), F.col("doc_id"), F.col("_d.copy"))
    rows = rows.withColumn("_d", F.explode_outer("draws"))
    words = F.coalesce("_d.words", F.lit(0).cast("long"))
    text = F.when(F.col("_d").isNull(), None).when(words < F.col("size"), first_words(F.col("text"), words.cast("int"))).otherwise(F.col("text"))
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when((F.col("_d").isNull()) | (words < F.col("size")), F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    more = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copy": F.col("_d.copy"), "shard": F.col("_d.shard"), "words": words}
    dealt = rows.select(*[v.alias(c) for c, v in (out | more).items()], order.alias("_order"))
    spread = F.pmod("_order", F.lit(64))  # a shard is written by many tasks
    return dealt.repartition("shard", spread).sortWithinPartitions("shard", "_order").drop("_order")


def mix_digest(docs: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """One row per row of docs: doc_id, keep, size, source_size, target, taken (words of all draws that the tree's leaves hold) and
    shards (those that the draws go to, copy by copy, comma-joined)."""
    dealt = F.filter("draws", lambda d: d["shard"].isNotNull())
    taken = F.aggregate(dealt, F.lit(0).cast("long"), lambda a, d: a + d["words"])
    shards = F.array_join(F.transform(dealt, lambda d: d["shard"].cast("string")), ",")
    return mixed(docs, **options).select("doc_id", *keep, "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))
