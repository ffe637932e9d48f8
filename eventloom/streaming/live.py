"""Structured Streaming forms of the ordered operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def last_of_windows(stream: DataFrame, key: str, ts: str, order: str, value: str, size: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """The last value of each key and tumbling window; rows later than the watermark are dropped, state with them."""
    windows = stream.withWatermark(ts, late).groupBy(key, F.window(ts, size))
    return windows.agg(F.max_by(value, F.struct(ts, order)).alias(value), F.count("*").alias("n_rows")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), value, "n_rows")


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows of a key without a pause longer than gap: start, end, number."""
    found = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n_rows"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_rows")


def runs(stream: DataFrame, key: str, order: str, by: str, value: str) -> DataFrame:
    """Finished runs of equal `by` per key, in the order in which batches bring rows: key, run, by, first, last, n_rows, total.

    The state is the open run; it is kept until the next one starts.  Rows must come in order between batches, and are
    sorted within one.
    """
    kinds = dict(stream.dtypes)
    out = f"{key} {kinds[key]}, run bigint, {by} {kinds[by]}, first {kinds[order]}, last {kinds[order]}, n_rows bigint, total double"
    state = f"run bigint, {by} {kinds[by]}, first {kinds[order]}, last {kinds[order]}, n_rows bigint, total double"

    def step(ident: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        run = list(held.get) if held.exists else None
        done = []
        for at, what, x in pd.concat(list(frames)).sort_values(order)[[order, by, value]].itertuples(index=False):
            if run is not None and run[1] == what:
                run[3], run[4], run[5] = at, run[4] + 1, run[5] + float(x)
            else:
                if run is not None:
                    done.append((*ident, *run))
                run = [(run[0] if run is not None else 0) + 1, what, at, at, 1, float(x)]
        held.update(tuple(run))
        yield pd.DataFrame(done, columns=[key, "run", by, "first", "last", "n_rows", "total"])

    return stream.groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)
