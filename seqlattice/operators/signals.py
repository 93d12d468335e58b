"""Measuring frames of a signal: long tables (key, t, value), segmented and measured by windows and grouped functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def utterances(frames: DataFrame, key: str, time: str, value: str, share: float = 0.3, least_silence: float = 0.2, least_length: float = 0.05) -> DataFrame:
    """(key, utterance, start, stop): runs above a threshold between the 5th and 95th percentile of a key's values.

    A silence of ``least_silence`` ends an utterance; shorter ones than ``least_length`` are noise.
    """
    limits = frames.groupBy(key).agg(F.percentile(value, F.lit(0.05)).alias("low"), F.percentile(value, F.lit(0.95)).alias("high"))
    loud = frames.join(F.broadcast(limits), key).filter(F.col(value) > F.col("low") + share * (F.col("high") - F.col("low")))
    by = Window.partitionBy(key).orderBy(time)
    new = F.coalesce(F.col(time) - F.lag(time).over(by) >= least_silence, F.lit(True)).cast("int")
    numbered = loud.withColumn("__new", new).withColumn("utterance", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "utterance").agg(F.min(time).alias("start"), F.max(time).alias("stop")).filter(F.col("stop") - F.col("start") >= least_length)


def semitones(hertz: Column, reference: float = 100.0) -> Column:
    return 12 * F.log2(hertz / F.lit(reference))


def measured(frames: DataFrame, intervals: DataFrame, key: str, time: str, pitch: str) -> DataFrame:
    """(key, syllable, n, mean, first, last, slope, excursion) of the pitch frames inside each interval, in semitones."""
    inside = frames.join(intervals, [key]).filter((F.col(time) >= F.col("start")) & (F.col(time) < F.col("stop")) & F.col(pitch).isNotNull())
    st = semitones(F.col(pitch))
    return inside.groupBy(key, "syllable").agg(
        F.count("*").alias("n"), F.avg(pitch).alias("mean"), F.min_by(pitch, time).alias("first"), F.max_by(pitch, time).alias("last"), F.regr_slope(st, F.col(time)).alias("slope"), (F.max(st) - F.min(st)).alias("excursion")
    )


def contour(slope: Column, level: Column, steep: float = 10.0) -> Column:
    """F for a falling slope, R for a rising one, else H or L by the level against 0."""
    return F.when(slope <= -steep, "F").when(slope >= steep, "R").when(level >= 0, "H").otherwise("L")


def split_points(energy: np.ndarray, parts: int, least: int) -> list[int]:
    """Where to cut a curve into ``parts`` of ``least`` frames or more, so that the cuts lie lowest in sum."""
    n = len(energy)
    if parts <= 1 or n < parts * least:
        return []
    best = np.full((parts, n), np.inf)
    back = np.zeros((parts, n), int)
    best[0, :] = 0
    best[1, least : n - least + 1] = energy[least : n - least + 1]
    for k in range(2, parts):
        running, where = np.inf, 0
        for i in range(k * least, n - (parts - k) * least + 1):
            if best[k - 1, i - least] < running:
                running, where = best[k - 1, i - least], i - least
            best[k, i], back[k, i] = running + energy[i], where
    i = int(np.argmin(best[parts - 1]))
    cuts = []
    for k in range(parts - 1, 0, -1):
        cuts.append(i)
        i = back[k, i]
    return cuts[::-1]


def split_syllables(frames: DataFrame, key: str, time: str, value: str, parts: str, least: int = 3) -> DataFrame:
    """(key, syllable, start, stop) of each key's frames cut into as many parts as column ``parts`` says; one key is one recording."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time)
        t = rows[time].to_numpy()
        edges = [0, *split_points(rows[value].to_numpy(), int(rows[parts].iloc[0]), least), len(t) - 1]
        return pd.DataFrame({"key": rows[key].iloc[0], "syllable": range(len(edges) - 1), "start": t[edges[:-1]], "stop": t[edges[1:]]})

    return frames.groupBy(key).applyInPandas(cut, "key string, syllable long, start double, stop double").withColumnRenamed("key", key)


def standardised(rows: DataFrame, vector: Column, name: str = "z") -> DataFrame:
    """Rows with an array column less its mean over its deviation."""
    n = F.size(vector)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    mean = total(vector) / n
    sd = F.sqrt(total(F.transform(vector, lambda x: (x - mean) * (x - mean))) / n)
    return rows.withColumn(name, F.transform(vector, lambda x: F.when(sd > 0, (x - mean) / sd).otherwise(0.0)))


def monotone_alignment(cost: np.ndarray, skip: float = 1.0) -> list[tuple[int, int]]:
    """The cheapest pairs (row, column) in rising order; rows and columns may be left out at a price each."""
    n, m = cost.shape
    best = np.zeros((n + 1, m + 1))
    best[:, 0], best[0, :] = skip * np.arange(n + 1), skip * np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i, j] = min(best[i - 1, j - 1] + cost[i - 1, j - 1], best[i - 1, j] + skip, best[i, j - 1] + skip)
    i, j, out = n, m, []
    while i and j:
        if best[i, j] == best[i - 1, j - 1] + cost[i - 1, j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i, j] == best[i - 1, j] + skip:
            i -= 1
        else:
            j -= 1
    return out[::-1]
