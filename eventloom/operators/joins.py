"""Joins on time and identity: intervals, nearest rows, unique matches, names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..contracts import ContractError
from .filters import ordered_fold


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str], at: Column, start: str) -> tuple[DataFrame, list[str]]:
    """Both sides as one table of moments: keys, _at, _side (1: left), _l and _r (structs); right rows without a key match nothing."""
    rest = [c for c in right.columns if c not in keys]
    clash = set(rest) & set(left.columns)
    if clash:
        raise ContractError(f"columns on both sides: {sorted(clash)}")
    l_rows = left.select(*keys, at.alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    r_rows = right.dropna(subset=[*keys, start]).select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.struct(*rest).alias("_r"))
    return l_rows.unionByName(r_rows, allowMissingColumns=True), rest


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: Column, start: str, end: str, ties: Sequence[str], *, closed: bool = False, how: str = "inner") -> DataFrame:
    """Each left row with the interval that holds it: start <= at < end, or <= end if closed; null ends are open.

    If intervals overlap, the latest start wins, then the greatest `ties`.  One pass over both sides in order of time: open
    intervals lie on a stack, the latest start on top, and one that has ended never comes back, so the work is linear in the
    rows, however many intervals a key has.  Equal left rows stay apart.  how: inner or left.
    """
    both, rest = _beside(left, right, keys, at, start)
    both = both.withColumns({"_end": F.col(f"_r.{end}"), **{f"_t{k}": F.col(f"_r.{t}") for k, t in enumerate(ties)}})

    def step(stack, row):
        now, side, found, ends = row
        if not side:
            stack.append((ends, found))
            return stack, (None,)
        while stack and now is not None and stack[-1][0] is not None and (stack[-1][0] < now or (stack[-1][0] == now and not closed)):
            stack.pop()
        return stack, (stack[-1][1] if stack and now is not None else None,)

    new = StructType([StructField("_found", both.schema["_r"].dataType)])
    out = ordered_fold(both, keys, ["_at", "_side", *[f"_t{k}" for k in range(len(ties))]], ["_at", "_side", "_r", "_end"], list, step, new)
    out = out.where("_side = 1" if how == "left" else "_side = 1 and _found is not null")
    return out.select("_l.*", *[f"_found.{c}" for c in rest])


def disjoint_interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: Column, start: str, end: str, *, closed: bool = False, how: str = "inner") -> DataFrame:
    """interval_join for intervals that don't overlap: the last interval that began, if it has not ended.

    One shuffle and one sort of both sides, without pairs; empty intervals hold nothing.  how: inner or left.
    """
    both, rest = _beside(left, right, keys, at, start)
    upto = Window.partitionBy(*keys).orderBy("_at", "_side", F.asc_nulls_last(F.col(f"_r.{end}"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = (F.col("_at") <= F.col(f"_found.{end}")) if closed else (F.col("_at") < F.col(f"_found.{end}"))
    out = both.withColumn("_found", F.last("_r", True).over(upto)).where("_side = 1")
    out = out.withColumn("_found", F.when(F.col("_at").isNotNull() & F.col("_found").isNotNull() & (F.col(f"_found.{end}").isNull() | above), F.col("_found")))
    if how == "inner":
        out = out.where("_found is not null")
    return out.select("_l.*", *[f"_found.{c}" for c in rest])


def outside_intervals(left: DataFrame, right: DataFrame, keys: Sequence[str], at: Column, start: str, end: str) -> DataFrame:
    """Left rows that no interval holds: the latest end of all intervals that have begun is not behind them.  One sort of both sides; null ends hold nothing."""
    spans = right.select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end")).where("_end > _start")
    both, _ = _beside(left, spans, keys, at, "_start")
    upto = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("_last", F.max("_r._end").over(upto)).where("_side = 1")
    return rows.where(F.col("_at").isNull() | F.col("_last").isNull() | (F.col("_at") >= F.col("_last"))).select("_l.*")


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, left_at: str, right_at: str, ties: Sequence[str], tolerance: float) -> DataFrame:
    """Each left row with the nearest right row of its keys, at most `tolerance` away; ties go to the least `ties`.

    Only the last right row up to the left one and the first from it on can be nearest; both come from sorted windows over the
    two sides together, so no pairs are formed.
    """
    both, rest = _beside(left, right.withColumn("_when", F.col(right_at)), keys, F.col(left_at), "_when")
    last = [F.desc(F.col(f"_r.{t}")) for t in ties]  # among equal times the least comes last, in either direction
    upto = Window.partitionBy(*keys).orderBy("_at", "_side", *last).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*keys).orderBy(F.desc("_at"), "_side", *last).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumns({"_b": F.last("_r", True).over(upto), "_a": F.last("_r", True).over(after)}).where("_side = 1")
    option = lambda x: F.when(F.abs(F.col("_at") - F.col(f"{x}._when")) <= tolerance, F.struct(F.abs(F.col("_at") - F.col(f"{x}._when")).alias("gap"), *[F.col(f"{x}.{t}").alias(f"_t{k}") for k, t in enumerate(ties)], F.col(x).alias("row")))
    best = found.withColumn("_best", F.least(option("_b"), option("_a"))).where("_best is not null")
    names = [c for c in left.columns if c != left_id]
    return best.select(f"_l.{left_id}", *[f"_l.{c}" for c in names], *[f"_best.row.{c}" for c in rest if c != "_when"], "_best.gap")


def unique_matches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(left rows with the only right row of their key, left rows with none or several and n_candidates)."""
    rest = [c for c in right.columns if c not in keys]
    candidates = right.groupBy(*keys).agg(F.count("*").alias("n_candidates"), *[F.min(c).alias(c) for c in rest])
    both = left.join(candidates, list(keys), "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    return both.where("n_candidates = 1").drop("n_candidates"), both.where("n_candidates <> 1").select(*left.columns, "n_candidates")


def out_of_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], matched: str) -> DataFrame:
    """Rows whose matched place does not lie behind that of the row before."""
    step = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_before", F.lag(matched).over(step)).where(F.col(matched) <= F.col("_before")).drop("_before")


def resolver(df: DataFrame, keys: Sequence[str], ident: str) -> tuple[DataFrame, DataFrame]:
    """(keys that mean one id, keys that mean several and how many)."""
    counts = df.where(F.col(ident).isNotNull()).groupBy(*keys).agg(F.min(ident).alias(ident), F.max(ident).alias("_max"), F.count_distinct(ident).alias("n_ids"))
    return counts.where("n_ids = 1").select(*keys, ident), counts.where("n_ids > 1").select(*keys, "n_ids")


def attach_id(df: DataFrame, known: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """df with missing ids filled from the keys that mean one id."""
    found = known.select(*keys, F.col(ident).alias("_found"))
    if ident not in df.columns:
        df = df.withColumn(ident, F.lit(None).cast(known.schema[ident].dataType))
    return df.join(found, list(keys), "left").withColumn(ident, F.coalesce(ident, "_found")).drop("_found")


def strongest(df: DataFrame, keys: Sequence[str], strength: Column, ties: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest strength."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(strength.alias("_s"), *ties)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def first_and_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a key with each column's first and last value, missing ones skipped."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*[f(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"{n}_{c}") for c in columns for f, n in ((F.min_by, "first"), (F.max_by, "last"))])


def sides_to_row(df: DataFrame, keys: Sequence[str], side: str, values: Sequence, columns: Sequence[str]) -> DataFrame:
    """One row a key from one row a side, by conditional aggregation instead of a self-join."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(side) == v, F.col(c))).alias(f"{str(v).lower()}_{c}") for v in values for c in columns])


def shifted_self_join(df: DataFrame, keys: Sequence[str], period: str, columns: Sequence[str], step: int = 1) -> DataFrame:
    """Rows that have a row of the same key `step` periods on, with both sets of columns."""
    later = df.select(*keys, (F.col(period) - step).alias(period), *[F.col(c).alias(f"next_{c}") for c in columns])
    return df.join(later, [*keys, period])


def teammates(df: DataFrame, keys: Sequence[str], person: str, parts: int = 96) -> DataFrame:
    """Ordered pairs of different members of the same group (a team's season): keys, person, other.

    Members are dealt by a hash of the group and of themselves over `parts` tasks, and meet the group's list there, so a large group's pairs are made by
    many tasks.  The list is gathered once a group; the pairs are as many as the squares of the groups' sizes.
    """
    members = df.select(*keys, person).distinct()
    lists = members.groupBy(*keys).agg(F.array_sort(F.collect_set(person)).alias("_m"))
    dealt = members.repartition(parts, F.xxhash64(*[F.col(k) for k in keys], F.col(person)))
    same = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    both = dealt.join(F.broadcast(lists.withColumnsRenamed({k: f"_g_{k}" for k in keys})), reduce(lambda a, b: a & b, same))
    return both.select(*keys, person, F.explode("_m").alias("other")).where(F.col(person) != F.col("other"))
