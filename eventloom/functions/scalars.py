"""Scalar expressions: ids, clocks, names, predicates with two values, ratios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a regular and of an overtime period, and regular periods.
PERIOD_SECONDS, OVERTIME_SECONDS, PERIODS = 720, 300, 4
#: Letters with marks and what they become, for names.
MARKED = "àáâãäåāăąçćčďđèéêëēėęěģğìíîïīįıķłļñńňņòóôõöøōőŕřśšşșťţțùúûüūůűųýÿžźż"
PLAIN = "aaaaaaaaacccddeeeeeeeeggiiiiiiikllnnnnoooooooorrsssstttuuuuuuuuyyzzz"
#: Suffixes that are no part of a name's key.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
#: Kind of game by the first three digits of its id.
GAME_TYPES = {"002": "regular", "004": "playoffs", "005": "play_in", "006": "cup_final"}


def padded_id(value: Column, width: int = 10) -> Column:
    """Zero-padded id; longer ids stay whole."""
    return F.format_string(f"%0{width}d", value.cast("long"))


def iso_seconds(clock: Column) -> Column:
    """Seconds of "PT11M24.5S"; missing parts are 0, other text null."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(clock, rf"([0-9]+(?:\.[0-9]+)?){unit}", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.when(clock.rlike(r"^PT(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+(?:\.[0-9]+)?S)?$"), part("H") * 3600 + part("M") * 60 + part("S"))


def clock_seconds(clock: Column) -> Column:
    """Seconds of "MM:SS", "SS.t" or an ISO duration; null or blank is 0, other text null."""
    text = F.trim(clock)
    pair = F.split(text, ":")
    plain = F.when(text.rlike(r"^[0-9]+:[0-9]+(\.[0-9]+)?$"), F.get(pair, F.lit(0)).try_cast("double") * 60 + F.get(pair, F.lit(1)).try_cast("double"))
    return F.when(clock.isNull() | (text == ""), 0.0).otherwise(F.coalesce(plain, iso_seconds(text), text.try_cast("double")))


def strict_clock_seconds(clock: Column) -> Column:
    """Seconds of "MM:SS" only."""
    return F.when(clock.rlike(r"^[0-9]+:[0-5][0-9]$"), clock_seconds(clock))


def elapsed_seconds(period: Column, remaining: Column) -> Column:
    """Seconds since the start, from the period and what remains of it."""
    regular = (period - 1) * PERIOD_SECONDS + PERIOD_SECONDS - remaining
    overtime = PERIODS * PERIOD_SECONDS + (period - PERIODS - 1) * OVERTIME_SECONDS + OVERTIME_SECONDS - remaining
    return F.when(period <= PERIODS, regular).otherwise(overtime).cast("double")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def seconds(ts: Column) -> Column:
    return micros(ts) / 1_000_000.0


def name_key(name: Column, drop_suffix: bool = True) -> Column:
    """Lower case without marks, suffix and anything but a-z and 0-9."""
    text = F.translate(F.lower(name), MARKED, PLAIN)
    if drop_suffix:
        text = F.regexp_replace(F.trim(F.regexp_replace(text, r"[.,']", "")), rf"\s+({'|'.join(SUFFIXES)})$", "")
    return F.regexp_replace(text, r"[^a-z0-9]", "")


def mapped(value: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    """A small alias table; values that it lacks stay, or become the default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, value), value if default is None else default)


def game_type(game_id: Column) -> Column:
    return mapped(F.substring(game_id, 1, 3), GAME_TYPES, F.lit("other"))


def first_number_in(text: Column) -> Column:
    """The first signed decimal in a text, thousands separators aside."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, ",", ""), r"[-+]?[0-9]*\.?[0-9]+", 0), F.lit("")).try_cast("double")


def differs(a: Column, b: Column) -> Column:
    """True if the values differ or one is missing (never null)."""
    return F.coalesce(a != b, F.lit(True))


def holds(condition: Column) -> Column:
    """The condition, with null as False."""
    return F.coalesce(condition, F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator over denominator where that is positive, else null."""
    return F.when(denominator > 0, numerator / denominator)


def clipped(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def right_closed_bin(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin (edge, next edge] that holds the value, else null."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        out = F.when((value > low) & (value <= high), F.lit(label)).otherwise(out)
    return out


def tier(value: Column, edges: Sequence[tuple[float, str]], default: str) -> Column:
    """Label of the first edge that the value reaches; edges descend."""
    out = F.lit(default)
    for edge, label in reversed(edges):
        out = F.when(value >= edge, F.lit(label)).otherwise(out)
    return out


def keyword_class(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern found in the text."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def lineups_overlap(first: Sequence[str], second: Sequence[str]) -> Column:
    """Whether two fixed-width lineups share a member (nulls aside)."""
    return holds(F.arrays_overlap(F.array_compact(F.array(*map(F.col, first))), F.array_compact(F.array(*map(F.col, second)))))


def hinge(value: Column, knot: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value - knot))


def age_basis(age: Column, center: float, knots: Sequence[float]) -> list[Column]:
    """Intercept, centred age and hinges."""
    return [F.lit(1.0), age - center, *[hinge(age, k) for k in knots]]


def score_features(margin: Column, remaining: Column, total: float = PERIODS * PERIOD_SECONDS) -> dict[str, Column]:
    """State features for win models: margin over the root of what remains, a late interaction, overtime."""
    left = F.greatest(remaining, F.lit(0.0))
    return {"margin": margin, "share_left": left / total, "pressure": margin / F.sqrt(left + 1), "late": margin * F.exp(-left / 300.0), "overtime": (remaining < 0).cast("int")}


def seconds_to_play(remaining: Column, period_left: Column, overtime: Column) -> Column:
    """What is left of regulation, or of the period in overtime; never below 0, null where the one that counts is null."""
    left = F.when(holds(overtime), period_left).otherwise(remaining).cast("double")
    return F.when(left.isNotNull(), F.greatest(left, F.lit(0.0)))


def fading_features(strengths: dict[str, Column], to_play: Column, total: float = PERIODS * PERIOD_SECONDS) -> dict[str, Column]:
    """Each pregame strength (rating gap, starters, form, rest) as it is and as it fades with the root of the time left."""
    fade = F.sqrt(to_play / total)
    return {k: v for name, c in strengths.items() for k, v in ((name, c), (f"{name}_remaining", c * fade))}


def control_features(home_control: Column, elapsed: Column, to_play: Column, total: float = PERIODS * PERIOD_SECONDS) -> dict[str, Column]:
    """Who has the ball (home 1, away -1, unknown null), its weight near the end, and its growth over regulation."""
    sign = F.when(home_control, 1.0).when(~home_control, -1.0)
    return {"control": sign, "control_pressure": sign / F.sqrt(to_play / 60.0 + 1), "control_late": sign * F.when(elapsed.isNotNull(), F.least(elapsed / total, F.lit(1.0)))}


def neutral_probability(p: Column, mirrored: Column) -> Column:
    """The home side's probability with the home edge taken out."""
    return (p + 1 - mirrored) / 2


def text_points(description: Column, made: Column, free_throw: Column) -> Column:
    """Points that an action's text stands for."""
    return F.when(~holds(made), 0).when(holds(free_throw), 1).when(F.upper(description).contains("3PT"), 3).otherwise(2)


def final_free_throw(sub_type: Column) -> Column:
    """Whether "N of M" has N equal to M."""
    part = lambda k: F.regexp_extract(sub_type, r"([0-9]+) of ([0-9]+)", k)
    return holds((part(1) != "") & (part(1) == part(2)))


def entropy(shares: Sequence[Column]) -> Column:
    """Shannon entropy (natural logarithm) of a row's shares; empty shares add nothing."""
    return sum((F.when(s > 0, -s * F.log(s)).otherwise(0.0) for s in shares), F.lit(0.0))


def decay_weight(age: Column, rate: float) -> Column:
    return F.pow(F.lit(rate), age)
