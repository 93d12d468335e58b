"""Syllables of languages whose tables aren't known: onsets are learned from the starts of words, and medial clusters divided by them.

Words are strings of one character a sound.  The division is that of clusters, of which a language has few: distinct
clusters meet the learned onsets in one equi-join by suffix, and words only take up the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def learned(words: DataFrame, vowels: str, group: str = "lang", code: str = "code", least: int = 2) -> DataFrame:
    """(group, onset, n): the runs of consonants before the first vowel of at least ``least`` words, each word counted once."""
    onset = F.regexp_extract(code, f"^([^{vowels}]+)[{vowels}]", 1)
    rows = words.select(group, code).distinct().select(group, onset.alias("onset")).filter("onset <> ''")
    return rows.groupBy(group, "onset").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def divided_clusters(words: DataFrame, onsets: DataFrame, vowels: str, group: str = "lang", code: str = "code") -> DataFrame:
    """(group, cluster, onset): of each cluster between vowels the longest end that is a learned onset, empty if none is."""
    medial = F.regexp_extract_all(code, F.lit(f"[{vowels}]([^{vowels}]+)(?=[{vowels}])"), F.lit(1))
    clusters = words.select(group, F.explode(medial).alias("cluster")).distinct()
    ends = clusters.select(group, "cluster", F.explode(F.transform(F.sequence(F.lit(1), F.length("cluster")), lambda i: F.col("cluster").substr(i, F.length("cluster")))).alias("onset"))
    best = ends.join(onsets.select(group, "onset"), [group, "onset"]).groupBy(group, "cluster").agg(F.max_by("onset", F.length("onset")).alias("onset"))
    return clusters.join(best, [group, "cluster"], "left").select(group, "cluster", F.coalesce("onset", F.lit("")).alias("onset"))


def licensed(words: DataFrame, vowels: str, group: str = "lang", code: str = "code", least: int = 2) -> DataFrame:
    """``words`` (one row for each group and code) with ``divided``, its syllables with dots between them.

    A word without a vowel is one syllable; consonants before the first and behind the last vowel stay with these.
    """
    cuts = divided_clusters(words, learned(words, vowels, group, code, least), vowels, group, code)
    pieces = F.regexp_extract_all(code, F.lit(f"([{vowels}][^{vowels}]*)"), F.lit(1))
    lead = F.regexp_extract(code, f"^[^{vowels}]*", 0)
    rows = words.select(group, code, lead.alias("lead"), F.size(pieces).alias("of"), F.posexplode(pieces).alias("pos", "piece"))
    last = F.col("pos") == F.col("of") - 1
    rows = rows.withColumn("cluster", F.when(~last, F.col("piece").substr(F.lit(2), F.length("piece"))))
    cut = rows.join(cuts, [group, "cluster"], "left").withColumn("onset", F.coalesce("onset", F.lit("")))
    shown = F.when(last, F.col("piece")).otherwise(F.concat(F.expr("substring(piece, 1, length(piece) - length(onset))"), F.lit("."), F.col("onset")))
    whole = cut.groupBy(group, code).agg(F.concat(F.first("lead"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("shown")))), lambda x: x["shown"]), "")).alias("divided"))
    return words.join(whole, [group, code], "left").withColumn("divided", F.coalesce("divided", F.col(code)))
