"""Quality rules with risk-controlled thresholds; column expressions only.

Base figures of a text feed rules of the form "reject if the figure exceeds a cutoff".  A fixed path leads from no rule at
all to the strictest cutoffs: in turn, each rule takes its next stricter cutoff.  For each stratum (language), labelled good
documents show how many the rules of a step would together reject falsely.  A step is certified if, were its true false
rejection rate alpha, so few false rejections would be seen with a probability of at most delta over the number of
strata (exact binomial test).  Steps are tested in the order of the path up to the first that fails, so the steps of
a stratum need no further correction (fixed-sequence testing); Bonferroni corrects for the strata.  With a probability of 1 - delta
no stratum's rules reject more than alpha of its good documents.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, written
from .exact import binomial_tail

WINDOW = 5
#: Rules: the figure as a function of the base figures, and its candidate cutoffs from strict to loose.
RULES = {
    "symbols": (lambda: F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), (0.05, 0.1, 0.15, 0.2, 0.3, 0.5)),
    "dup_lines": (lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), (0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeats": (lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)), (0.05, 0.1, 0.15, 0.2)),
    "upper": (lambda: F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)), (0.2, 0.3, 0.4, 0.6, 0.8)),
    "word_length": (lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), (12.0, 15.0, 20.0, 30.0)),
}


def base_figures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, then n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words of whole texts (null: empty)."""
    value = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(F.col("_text"), F.lit(pattern)).cast("long")
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(rf"[^{SPACE}]"))
    step = docs.select(*keep, value.alias("_text"))
    step = step.select(
        *keep,
        (F.length("_text") - count(rf"[{SPACE}]")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{Lu}").alias("n_upper"),
        lines.alias("_lines"),
        F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))
    step = step.select(
        *keep, "word_chars", "n_symbols", "n_upper",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    # places of all windows sorted by hash; only texts that hold a window twice need them
    placed = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.withColumn("_placed", placed).drop("_windows")
    twice = F.filter("_placed", lambda x, k: (x["h"] == F.get("_placed", k - 1)["h"]) | (x["h"] == F.get("_placed", k + 1)["h"]))
    step = step.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_placed")
    covered = F.aggregate("_starts", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")))["n"]
    return step.select(*keep, "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def path() -> list[dict[str, float]]:
    """The cutoffs by rule after each step: in turn, each rule takes its next stricter cutoff."""
    steps, now = [{}], {}
    for k in range(max(len(cuts) for _, cuts in RULES.values())):
        for name, (_, cuts) in RULES.items():
            if k < len(cuts):
                now = now | {name: cuts[-1 - k]}
                steps.append(now)
    return steps


def certified_cutoffs(figures: DataFrame, labels: DataFrame, *, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """From figures (doc_id, stratum, base figures) and labels (doc_id, good), one row a stratum with a column per rule.

    A rule that is not on at the last certified step is null.  Labelled documents that the base rules reject don't count, as
    the cutoffs only judge the others.  A document with several labels is good only if all of them say so.
    """
    good = labels.where(F.col("good").isNotNull()).groupBy("doc_id").agg(F.min("good").alias("good")).where(F.col("good") == 1)
    seen = figures.where(~base_failed()).join(good.select("doc_id"), "doc_id")
    seen = seen.select("stratum", *[value().alias(f"_{name}") for name, (value, _) in RULES.items()])
    steps = path()
    wrong = lambda step: reduce(or_, [F.col(f"_{name}") > cut for name, cut in step.items()])
    counts = seen.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(wrong(step)).alias(f"x{k}") for k, step in enumerate(steps) if step])
    strata = counts.withColumn("level", delta / F.count("*").over(Window.partitionBy()))  # one row a stratum
    passed = F.array(*[(F.col(f"x{k}") < alpha * F.col("n")) & (binomial_tail(F.col("n"), F.col(f"x{k}"), alpha) <= F.col("level")) for k, step in enumerate(steps) if step])
    failed = F.array_position(passed, F.lit(False))
    strata = strata.withColumn("step", F.when(failed == 0, F.lit(len(steps))).otherwise(failed).cast("int"))
    cut = lambda name: F.element_at(F.array(*[F.lit(step.get(name)).cast("double") for step in steps]), F.col("step"))
    return strata.select("stratum", *[cut(name).alias(f"cut_{name}") for name in RULES])


def judged(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    labels has doc_id and good (0, 1 or null).  Null and empty texts have no words and fail; a null stratum is one of
    its own; a document without an id gets figures but takes no part in choosing cutoffs.  Repeated rows are judged
    one by one.  Without labels every rule is off and only the base rules reject.  An empty table gives none.
    """
    figures = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("stratum"), "text")
    figures = written(base_figures(figures, keep=("doc_id", "stratum")), "quality-figures")
    cuts = written(certified_cutoffs(figures, labels, alpha=alpha, delta=delta), "quality-cutoffs")
    over = F.lit(False)
    for name, (value, _) in RULES.items():
        over = over | F.coalesce(value() > F.col(f"cut_{name}"), F.lit(False))
    out = figures.join(cuts, "stratum", "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept"))
