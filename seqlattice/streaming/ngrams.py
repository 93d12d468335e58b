"""Streamed n-gram statistics: windowed counts under a watermark, and bigrams of each key with kept state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ngrams import BOS


def windowed_counts(stream: DataFrame, time: str, symbol: str, size: str = "7 days", late: str = "1 day") -> DataFrame:
    """(start, symbol, n) of tumbling windows; rows later than the watermark are dropped by it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), F.col(symbol).alias("symbol")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "symbol", "n")


def session_counts(stream: DataFrame, key: str, time: str, gap: str = "1 day", late: str = "1 day") -> DataFrame:
    """(key, start, stop, n) of sessions: a silence of ``gap`` ends one."""
    return stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def keyed_bigrams(stream: DataFrame, key: str, time: str, order: str, symbol: str) -> DataFrame:
    """(key, x, y) of each symbol with the one before it; the last symbol of a key is its only state.

    Rows of one batch are put in order; a row that comes a batch late follows what has come before it.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([time, order])
        before = state.get[0] if state.exists else BOS
        symbols = rows[symbol].tolist()
        state.update((symbols[-1],))
        yield pd.DataFrame({"key": [k[0]] * len(symbols), "x": [before, *symbols[:-1]], "y": symbols})

    return stream.groupBy(F.col(key)).applyInPandasWithState(step, "key long, x string, y string", "last string", "append", GroupStateTimeout.NoTimeout)
