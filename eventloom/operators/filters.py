"""Causal filters and ordered state machines per entity.

Recursions run as an ordered fold over sorted partitions, which hold many entities each and go through Python in Arrow batches, so
neither an entity's rows nor a call for each of them are held at once.  Elo alone needs all entities of a league in order; its
group is the league.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def with_fields(df: DataFrame, columns: Sequence[str], **more) -> StructType:
    return StructType([*(df.schema[c] for c in columns), *(StructField(k, v) for k, v in more.items())])


def dealt_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with all rows of a key in one partition, whatever df is made of.

    By a hash of the keys, not by the keys: Spark leaves a repartition by keys out if a join or a union below seems to be dealt by them already, and may then
    replace that join by another at run time, which deals the rows in another way.  An operator in Python states no need of its own, so nothing would restore it.
    """
    return df.repartition(F.xxhash64(*[F.col(f"`{k}`") for k in keys]))


def dealt_by_size(df: DataFrame, keys: Sequence[str], rows: int = 500_000) -> DataFrame:
    """df dealt by its keys over as many tasks as its number of rows asks for, so that a task's memory does not grow with the input.

    A grouping by (some of) the keys and a join by them keep that dealing.  df is counted, so it is a table as read, not a result; a small one is left as it is.
    """
    n = df.count()
    if n <= rows:
        return df
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows)), *keys)


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], start: Callable, step: Callable, new: StructType) -> DataFrame:
    """df and new columns: step(state, values) -> (state, new values) over each key's rows in order, from start().

    values are the row's `columns`, None where null.  Rows are dealt by key and sorted; a key's state is carried from
    batch to batch, so a key of any length is one pass.
    """
    schema = StructType([*df.schema.fields, *new.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        last, state = None, None
        for batch in batches:
            out = []
            own = [batch.column(c).to_pylist() for c in keys]
            for key, values in zip(zip(*own, strict=True), zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
                if key != last:
                    last, state = key, start()
                state, found = step(state, values)
                out.append(found)
            added = [pa.array(x, arrow.field(f.name).type) for f, x in zip(new.fields, zip(*out, strict=True), strict=True)] if out else [pa.array([], arrow.field(f.name).type) for f in new.fields]
            yield pa.RecordBatch.from_arrays([*(c.cast(arrow.field(i).type) for i, c in enumerate(batch.columns)), *added], schema=arrow)

    return dealt_by(df, keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def doubles(*names: str) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


def decayed_mean(df: DataFrame, keys: Sequence[str], period: str, value: str, weight: str, rate: float, name: str = "filtered") -> DataFrame:
    """Adds the mean of all values up to the row, each weighted by weight * rate^(periods since): gaps count.

    Kept as (mean, weight), so no power grows with the length of a stream.  Missing values leave the mean; before the first one it is null.
    """

    def step(state, row):
        at, x, w = row
        last, mean, total = state
        total *= rate ** (at - last) if last is not None else 1.0
        if x is not None and w:
            total += w
            mean = x if mean is None else mean + w / total * (x - mean)
        return (at, mean, total), (mean,)

    return ordered_fold(df, keys, [period], [period, value, weight], lambda: (None, None, 0.0), step, doubles(name))


def accumulated_noise(noise: float, phi: float, gap: Column) -> Column:
    """Process noise over a gap of an AR(1) state."""
    if phi == 1.0:
        return F.lit(noise) * gap
    return noise * (1 - F.pow(F.lit(phi * phi), gap)) / (1 - phi * phi)


def kalman(df: DataFrame, keys: Sequence[str], period: str, value: str, variance: str, *, phi: float, noise: float, prior_mean: float = 0.0, prior_variance: float = 1.0) -> DataFrame:
    """Scalar Kalman filter with AR(1) state per key: adds predicted, filtered and filtered_variance.

    A gap of g periods decays the state by phi^g.  A missing value leaves the prediction; nothing later is used.
    """

    def step(state, row):
        at, x, r = row
        last, mean, var = state
        gap = 0 if last is None else int(at - last)
        if gap:
            mean *= phi**gap
            var = phi ** (2 * gap) * var + (noise * gap if phi == 1.0 else noise * (1 - phi ** (2 * gap)) / (1 - phi * phi))
        predicted = mean
        if x is not None and r is not None:
            gain = var / (var + r)
            mean, var = mean + gain * (x - mean), (1 - gain) * var
        return (at, mean, var), (predicted, mean, var)

    return ordered_fold(df.select(*keys, period, value, variance), keys, [period], [period, value, variance], lambda: (None, prior_mean, prior_variance), step, doubles("predicted", "filtered", "filtered_variance"))


def smoothed_vectors(df: DataFrame, keys: Sequence[str], period: str, columns: Sequence[str], weight: float) -> DataFrame:
    """Exponential smoothing of shares per key, restarted after a gap, renormalised; adds the position of the greatest one."""
    own = [f"_own_{c}" for c in columns]

    def step(state, row):
        at, *x = row
        last, now = state
        fresh = now is None or at != last + 1
        now = x if fresh else [(1 - weight) * a + weight * v for a, v in zip(now, x, strict=True)]
        total = sum(now) or 1.0
        now = [a / total for a in now]
        return (at, now), (*now, max(range(len(now)), key=lambda k: (now[k], -k)))

    raw = df.select(*keys, period, *[F.col(c).alias(o) for c, o in zip(columns, own, strict=True)])
    new = StructType([*doubles(*columns).fields, StructField("leading", LongType())])
    return ordered_fold(raw, keys, [period], [period, *own], lambda: (None, None), step, new).drop(*own)


def elo(games: DataFrame, league: Sequence[str], date: str, season: str, home: str, away: str, margin: str, *, k: float = 20.0, edge: float = 60.0, carry: float = 0.75, start: float = 1500.0) -> DataFrame:
    """Ratings before each game.  Games of one date see the ratings of the day before and are applied together; a new
    season pulls every rating towards the start value."""
    own = [*league, date, season, home, away, margin]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([date, home, away], kind="stable").copy()
        rating: dict = {}
        before, now = [], None
        for _, day in rows.groupby(date, sort=True):
            if now is not None and day[season].iloc[0] != now:
                rating = {t: start + carry * (r - start) for t, r in rating.items()}
            now, change = day[season].iloc[0], {}
            for h, a, m in zip(day[home], day[away], day[margin], strict=True):
                rh, ra = rating.get(h, start), rating.get(a, start)
                before.append((rh, ra))
                if pd.notna(m):
                    step = k * ((1.0 if m > 0 else 0.5 if m == 0 else 0.0) - 1 / (1 + 10 ** ((ra - rh - edge) / 400)))
                    change[h], change[a] = change.get(h, 0.0) + step, change.get(a, 0.0) - step
            for t, c in change.items():
                rating[t] = rating.get(t, start) + c
        rows["home_before"], rows["away_before"] = [b[0] for b in before], [b[1] for b in before]
        return rows

    schema = with_fields(games, own, home_before=DoubleType(), away_before=DoubleType())
    return games.select(*own).groupBy(*league).applyInPandas(fold, schema)


def ewma_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], season: str, value: str, weight: float = 0.1, carry: float = 0.75) -> DataFrame:
    """Exponentially weighted mean of the rows before each one; a new season keeps `carry` of it.

    A missing value counts as 0, and a missing season starts no new one.
    """

    def step(state, row):
        mean, last = state
        now, x = row
        if last is not None and now is not None and last != now:
            mean *= carry
        return (mean * (1 - weight) + (x or 0.0) * weight, now), (mean,)

    return ordered_fold(df, keys, order, [season, value], lambda: (0.0, None), step, doubles(f"{value}_ewma"))


def simultaneous(df: DataFrame, keys: Sequence[str], at: Sequence[str], player: str, direction: str) -> DataFrame:
    """Substitutions of one moment as sets: keys, at, outs, ins (sorted)."""
    side = lambda d: F.array_sort(F.collect_set(F.when(F.col(direction) == d, F.col(player))))
    return df.groupBy(*keys, *at).agg(side("out").alias("outs"), side("in").alias("ins"))


def replay_lineups(starters: DataFrame, moments: DataFrame, keys: Sequence[str], at: str, size: int = 5) -> DataFrame:
    """Stints from starters (keys, players) and moments (keys, at, outs, ins): keys, stint, players, start, end, ok.

    A moment applies if as many leave as come, all who leave are on and none who come is; players in both sets net out.
    Otherwise the lineup stays and ok is false from there on.  A key's moments go by in order and are never gathered, so a key may have any number of them.
    """
    from pyspark.sql.types import BooleanType

    kind, element = moments.schema[at].dataType, starters.schema["players"].dataType
    schema = StructType([*(starters.schema[k] for k in keys), StructField("stint", LongType()), StructField("players", element), StructField("start", kind), StructField("end", kind), StructField("ok", BooleanType())])
    arrow = to_arrow_schema(schema)
    nothing = lambda c, of: F.lit(None).cast(of.schema[c].dataType).alias(c)
    first = starters.select(*keys, F.lit(0).alias("_kind"), "players", nothing(at, moments), nothing("outs", moments), nothing("ins", moments))
    later = moments.join(starters.select(*keys), list(keys), "left_semi").select(*keys, F.lit(1).alias("_kind"), nothing("players", starters), at, "outs", "ins")

    def run(batches):
        key = None
        for batch in batches:
            out = []
            own = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            for now, k, players, moment, outs, ins in zip(own, *(batch.column(c).to_pylist() for c in ("_kind", "players", at, "outs", "ins")), strict=True):
                if k == 0:
                    if key is not None:
                        out.append((*key, n, sorted(on), begun, None, ok))
                    key, on, begun, n = now, set(players), None, 0
                    ok = len(on) == size
                    continue
                outs, ins = set(outs) - set(ins), set(ins) - set(outs)
                if not outs and not ins:
                    continue
                if len(outs) != len(ins) or not outs <= on or ins & on:
                    ok = False
                    continue
                out.append((*key, n, sorted(on), begun, moment, ok))
                on, begun, n = (on - outs) | ins, moment, n + 1
            yield rows_of(out)
        if key is not None:
            yield rows_of([(*key, n, sorted(on), begun, None, ok)])

    def rows_of(out):
        columns = list(zip(*out, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return dealt_by(first.unionByName(later), keys).sortWithinPartitions(*keys, "_kind", at, "outs", "ins").mapInArrow(run, schema)


def backwards(order: Sequence[str]) -> list[Column]:
    """The reverse of an ascending order: looking ahead is looking back there, which Spark does in one pass (a frame that ends behind the row is evaluated anew for each)."""
    return [F.desc_nulls_last(c) for c in order]


def owner_sequence(df: DataFrame, keys: Sequence[str], order: Sequence[str], anchor: Column) -> DataFrame:
    """Adds the owner of each row and how it is known: by its own anchor, the one before, or the next one.

    anchor: the owner where the row itself tells, else null.
    """
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*keys).orderBy(*backwards(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("_a", anchor)
    owner = F.coalesce("_a", F.last("_a", True).over(upto), F.last("_a", True).over(after))
    how = F.when(F.col("_a").isNotNull(), "own").when(F.last("_a", True).over(upto).isNotNull(), "before").when(F.last("_a", True).over(after).isNotNull(), "after").otherwise("none")
    return marked.withColumns({"owner": owner, "known_by": how}).drop("_a")


def filled_between(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """A missing state is filled only if the one before and the one after agree."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(*backwards(order)).rowsBetween(Window.unboundedPreceding, -1)
    left, right = F.last(column, True).over(upto), F.last(column, True).over(after)
    return df.withColumn(column, F.coalesce(F.col(column), F.when(left == right, left)))


def inferred_starters(df: DataFrame, keys: Sequence[str], order: str, player: str, direction: Column) -> DataFrame:
    """Who began: players whose first mark is "out", or who act without ever being marked.  direction: in, out or null."""
    first = df.withColumn("_d", direction).groupBy(*keys, player).agg(F.min_by("_d", F.when(F.col("_d").isNotNull(), F.col(order))).alias("_first"))
    return first.where(F.col("_first").isNull() | (F.col("_first") == "out")).groupBy(*keys).agg(F.array_sort(F.collect_set(player)).alias("players"))


def played_time(stints: DataFrame, keys: Sequence[str], players: str, start: Column, end: Column) -> DataFrame:
    """Seconds that each member of the stints' lineups was on: keys, player, played."""
    rows = stints.withColumn("_d", F.greatest(end - start, F.lit(0.0)))
    return rows.select(*keys, F.explode(players).alias("player"), "_d").groupBy(*keys, "player").agg(F.sum("_d").alias("played"))


def time_gaps(played: DataFrame, official: DataFrame, keys: Sequence[str], tolerance: float = 5.0) -> DataFrame:
    """Players whose time differs from the official one by more than the tolerance: keys, player, played, official, gap."""
    both = played.join(official, [*keys, "player"], "full").na.fill(0.0, ["played", "official"]).withColumn("gap", F.abs(F.col("played") - F.col("official")))
    return both.where(F.col("gap") > tolerance)


def run_sequence(df: DataFrame, keys: Sequence[str], order: Sequence[str], owner: str) -> DataFrame:
    """The owners of a key's runs, in order."""
    from .ordered import collapse_runs

    runs = collapse_runs(df.where(F.col(owner).isNotNull()), keys, order, [owner])
    return runs.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("run", owner))), lambda r: r[owner]).alias("owners"))


def agreement(df: DataFrame, keys: Sequence[str], order: Sequence[str], owner: str, label: str) -> DataFrame:
    """Per key: rows with both, the share that agree, and whether the sequences of runs are the same."""
    rows = df.where(F.col(owner).isNotNull() & F.col(label).isNotNull())
    share = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(owner) == F.col(label)).cast("double")).alias("agreement"))
    a, b = run_sequence(df, keys, order, owner), run_sequence(df, keys, order, label).withColumnRenamed("owners", "labels")
    return share.join(a, list(keys), "left").join(b, list(keys), "left").withColumn("same_runs", F.coalesce(F.col("owners") == F.col("labels"), F.lit(False))).drop("owners", "labels")


def substitutions_from_text(df: DataFrame, text: str, names: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Adds out and in ids of "SUB: A FOR B" (A comes for B), or why not: no_match, unknown_name.

    names: keys, name_key, ident, one id a name key (see joins.resolver).
    """
    from ..functions.scalars import name_key

    part = lambda k: F.nullif(F.regexp_extract(text, r"(?i)SUB:\s*(.+?)\s+FOR\s+(.+?)\s*$", k), F.lit(""))
    rows = df.withColumns({"_in": name_key(part(1)), "_out": name_key(part(2))})
    for side in ("in", "out"):
        found = names.select(*keys, F.col("name_key").alias(f"_{side}"), F.col(ident).alias(f"{side}_{ident}"))
        rows = rows.join(found, [*keys, f"_{side}"], "left")
    why = F.when(F.col("_in").isNull(), "no_match").when(F.col(f"in_{ident}").isNull() | F.col(f"out_{ident}").isNull(), "unknown_name")
    return rows.withColumn("failure", why).drop("_in", "_out")
