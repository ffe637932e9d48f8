"""URL filters by path-template trees.

Fixed rules judge what they fit.  For the rest, every host has a tree of path templates, grown level by level over all
URLs, pre-summed by host and generalised path:

* a segment that is a number, a date, a hash or the like becomes a wildcard of that shape;
* of a node's other branches, those with few labelled URLs are merged, and become a wildcard if the node has more than
  ``most_children`` of them; those whose labelled share of blocked URLs does not differ significantly from their
  siblings' pooled share (two-proportion z test) are merged too; the others stay apart, however many there are: at
  most the labelled URLs over ``support``;
* a template is rejected if its blocked share of labelled URLs, smoothed towards the share of all, reaches ``cut``.

Labels are the verdicts of the rules, or a column of the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hot, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Shapes of variable segments, tried in this order; an extension stays.
SHAPES = (
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "{date}"),
    (r"^[0-9]+(\.[A-Za-z]{1,5})?$", "{n}"),
    (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "{uuid}"),
    (r"^(?=.*[0-9])[0-9a-fA-F]{8,}$", "{hex}"),
    (r"^(?=.*[0-9])[A-Za-z0-9_-]{16,}$", "{id}"),
)
MERGED, FEW, WILD = "{merged}", "{few}", "{any}"


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for a null url or one without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in longest]
    return F.coalesce(*[F.when(f, F.lit(h + p)) for f, (h, p, _) in zip(fits, longest, strict=True)]), F.coalesce(*[F.when(f, F.lit(v)) for f, (_, _, v) in zip(fits, longest, strict=True)])


def shaped(segment: Column) -> Column:
    out = segment
    for pattern, name in reversed(SHAPES):
        extension = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1) if name == "{n}" else F.lit("")
        out = F.when(segment.rlike(pattern), F.concat(F.lit(name), extension)).otherwise(out)
    return out


def shaped_path(path: Column, depth: int) -> Column:
    """The path's segments with variable ones replaced; what lies deeper than depth is whole, as one last segment of its own."""
    found = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shaped)
    return F.when(F.size(found) > depth, F.concat(F.slice(found, 1, depth), F.array(F.array_join(F.slice(found, depth + 1, F.size(found)), "/")))).otherwise(found)


def template_tree(urls: DataFrame, *, most_children: int = 64, support: int = 5, z: float = 1.96) -> DataFrame:
    """From (host, segments, blocked 1/0/null), one row a distinct (host, segments): template, n, n_blocked, n_labelled.

    Grown until no path has a further segment.  A host or level with very many branches, or a branch with very many paths, is
    dealt over several tasks.
    """
    counts = (F.count("*").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).cast("long").alias("n_blocked"), F.count("blocked").alias("n_labelled"))
    rows = written(urls.groupBy("host", "segments").agg(*counts).withColumn("template", F.lit("")), "url-level")
    for level in range(rows.agg(F.max(F.size("segments"))).first()[0] or 0):
        rows = rows.withColumn("child", F.get("segments", F.lit(level)))
        sums = [F.sum(c).alias(c) for c in ("n_blocked", "n_labelled")]
        children = rows.where("child is not null").groupBy("host", "template", "child").agg(*sums, F.count("*").alias("paths"))
        children = written(children.withColumns({"node": F.xxhash64("host", "template"), "branch": F.xxhash64("host", "template", "child")}), "url-branches")
        wide = Hot(children.groupBy("node").agg(F.count("*").alias("n")), "node")
        deep = Hot(children.select("branch", F.col("paths").alias("n")), "branch")
        enough = F.col("n_labelled") >= support
        nodes = children.groupBy("host", "template", "node").agg(F.count_if(~enough & ~F.col("child").startswith("{")).alias("kinds"), F.sum(F.when(enough, F.col("n_blocked"))).alias("all_blocked"), F.sum(F.when(enough, F.col("n_labelled"))).alias("all_labelled"))
        others = F.col("all_labelled") - F.col("n_labelled")
        pooled = F.col("all_blocked") / F.col("all_labelled")
        gap = F.abs(F.col("n_blocked") / F.col("n_labelled") - (F.col("all_blocked") - F.col("n_blocked")) / others)
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n_labelled") + 1 / others))
        apart = F.when(others > 0, gap > z * spread).otherwise(True)  # the only labelled branch has no like
        shape = F.col("child").startswith("{")
        name = F.when(shape, F.col("child")).when(~enough & (F.col("kinds") > most_children), F.lit(WILD)).when(~enough, F.lit(FEW)).when(apart, F.col("child")).otherwise(F.lit(MERGED))
        named = wide.dealt(children, "branch").join(wide.copied(nodes), ["host", "template", "node", "_salt"]).select("host", "template", "child", "branch", name.alias("name"))
        going = deep.dealt(rows.where("child is not null").withColumn("branch", F.xxhash64("host", "template", "child")), "segments")
        grown = going.join(deep.copied(named), ["host", "template", "child", "branch", "_salt"]).withColumn("template", F.concat("template", F.lit("/"), "name"))
        rows = written(grown.select(*rows.drop("child").columns).unionByName(rows.where("child is null").drop("child")), "url-level")
    return rows


def judged(pages: DataFrame, *, rules=RULES, labelled: Column | None = None, cut: float = 0.8, prior_weight: float = 4.0, depth: int = 8, **options) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict, template, purity.

    labelled: 1 (block), 0 (allow) or null a row; if not given, the rules' verdicts.  A null url, or one without
    "://", has an empty host and path and is allowed unless its template is rejected.  Repeated URLs count as often as they
    come; a template without labels has the purity of all labelled rows and is allowed.  An empty table gives
    an empty result, and other columns are ignored.
    """
    host, path = parsed(F.col("url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    own = labelled if labelled is not None else F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0)
    step = pages.withColumns({"host": host, "path": path}) if labelled is not None else pages.select("page_id", "url").withColumns({"host": host, "path": path})
    step = step.withColumns({"rule": rule, "by_rule": verdict}).withColumn("segments", shaped_path(F.col("path"), depth))
    rows = step.select("page_id", "host", "path", "rule", "by_rule", "segments", own.cast("int").alias("blocked"))
    tree = template_tree(rows.select("host", "segments", "blocked"), **options)
    totals = tree.agg(F.sum("n_blocked"), F.sum("n_labelled")).first()
    share = (totals[0] or 0) / (totals[1] or 1)
    sums = tree.groupBy("host", "template").agg(F.sum("n_blocked").alias("b"), F.sum("n_labelled").alias("m"))
    pure = sums.select("host", "template", "m", ((F.col("b") + prior_weight * share) / (F.col("m") + prior_weight)).alias("purity"))
    same = F.xxhash64("host", "segments").alias("same")
    hot = Hot(tree.select(same, "n").groupBy("same").agg(F.sum("n").alias("n")), "same")  # a front page may be a third of all rows
    shared = Hot(tree.groupBy(F.xxhash64("host", "template").alias("node")).agg(F.count("*").alias("n")), "node")
    pure = shared.copied(pure.withColumn("node", F.xxhash64("host", "template")))
    found = shared.dealt(tree.select("host", "segments", "template", same, F.xxhash64("host", "template").alias("node")), "same").join(pure, ["host", "template", "node", "_salt"]).drop("node", "_salt")
    out = hot.dealt(rows.withColumn("same", same), "page_id").join(hot.copied(found), ["host", "segments", "same", "_salt"], "left")
    by_method = F.when((F.col("m") > 0) & (F.col("purity") >= cut), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "template", "purity")
