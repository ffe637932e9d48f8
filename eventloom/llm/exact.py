"""Exact discrete distributions as column expressions (no Python on the executors)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_factorial(n: Column) -> Column:
    """ln n!: from the factorial up to 20, beyond that Stirling's series to the fifth power (error under 1e-12)."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed downwards from its largest term; k is below n * p.

    Terms fall at least as fast as a normal curve of the same deviation, so those further away than 12 deviations are below what
    a double can add; the sum ends there at every size, with the geometric series that bounds the rest.
    """
    top = F.exp(ln_choose(n, k) + k * math.log(p) + (n - k) * math.log1p(-p))
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)  # noqa: E731  term i - 1 over term i
    reach = F.ceil(12 * F.sqrt(n.cast("double") * (p * (1 - p)))) + 60
    steps = F.least(k, reach).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    total = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")),
        start,
        lambda acc, j: F.struct((acc["term"] * ratio(k - j)).alias("term"), (acc["sum"] + acc["term"] * ratio(k - j)).alias("sum")),
    )
    rest = F.when(k > steps, total["term"] * ratio(k - steps) / (1 - ratio(k - steps))).otherwise(0.0)
    return top * (total["sum"] + rest)


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column, sds: int = 9) -> Column:
    """The number of marked items among `draws` without replacement, by inverting the distribution function at u.

    The search starts `sds` standard deviations below the mean, where the mass left out is under 1e-15.
    """

    def bounds(x):
        n, m, d = (x[c].cast("double") for c in ("n", "m", "d"))
        share = m / F.greatest(n, F.lit(1.0))
        spread = F.sqrt(d * share * (1 - share) * (n - d) / F.greatest(n - 1, F.lit(1.0))) * sds + sds
        low = F.greatest(F.lit(0).cast("long"), x["d"] - (x["n"] - x["m"]), F.floor(d * share - spread).cast("long"))
        high = F.least(x["m"], x["d"], F.ceil(d * share + spread).cast("long"))
        return F.struct(x["n"].alias("n"), x["m"].alias("m"), x["d"].alias("d"), x["u"].alias("u"), low.alias("low"), high.alias("high"))

    def search(x):
        first = F.exp(ln_choose(x["m"], x["low"]) + ln_choose(x["n"] - x["m"], x["d"] - x["low"]) - ln_choose(x["n"], x["d"]))
        start = F.struct(x["low"].alias("k"), first.alias("p"), first.alias("cdf"))

        def step(acc, k):
            odds = ((x["m"] - k) * (x["d"] - k)).cast("double") / ((k + 1) * (x["n"] - x["m"] - x["d"] + k + 1))
            return F.when(acc["cdf"] >= x["u"], acc).otherwise(F.struct((k + 1).alias("k"), (acc["p"] * odds).alias("p"), (acc["cdf"] + acc["p"] * odds).alias("cdf")))

        return F.when(x["high"] <= x["low"], x["low"]).otherwise(F.aggregate(F.sequence(x["low"], x["high"] - 1), start, step)["k"])

    return let(let(F.struct(population.alias("n"), marked.alias("m"), draws.alias("d"), u.alias("u")), bounds), search)
