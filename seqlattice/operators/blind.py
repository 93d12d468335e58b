"""Blind orders of stimuli: hashed, with repeats that lie apart and anchors that hold their places.

Nothing is shuffled in a loop: an item's rank comes from a hash of the seed and the item, a repeat draws a slot behind the
item's own, and the final order follows from both.  Rows are numbered by ranges: places within a range, and the counts of
the ranges before it, so that no task sorts everything.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut
from .baselines import uniform

_PLACE = 33  # bits of the place in a partition, in monotonically_increasing_id


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``rows`` with their place in the order, from 0; ties are numbered in any order."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _PLACE)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__here"))  # a row for each range
    before = F.coalesce(F.sum("__here").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    within = F.col("__at").bitwiseAND((1 << _PLACE) - 1)
    return placed.withColumn("__part", part).join(offsets, "__part").withColumn(name, F.col("__before") + within).drop("__at", "__part", "__before")


def _hash(seed: int, what: str, word: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(what), word))


def blind_order(items: DataFrame, word: str = "word", seed: int = 0, repeats: float = 0.1, gap: int = 20, anchors: Iterable[tuple[str, int]] = ()) -> DataFrame:
    """(place, id, word, is_repeat, is_anchor) of distinct items, from place 1 on; the id doesn't show the word.

    A share ``repeats`` of the items, those of the least hashes among the ones with ``gap`` places behind them, come a second
    time, at least ``gap`` places after the first.  ``anchors`` are (word, place): each stands exactly there, and the others
    fill the places between, which only widens gaps.
    """
    fixed = sorted((place, w) for w, place in anchors)
    mine = items.select(F.col(word).alias("word")).filter("word is not null").distinct()
    base = cut(numbered(mine.withColumn("__h", _hash(seed, "order", F.col("word"))), "rank", "__h", "word").select("word", "rank"))
    n = base.count()
    total = n + int(n * repeats) + len(fixed)
    places = [p for p, _ in fixed]
    if len(set(places)) < len(places) or places and not 1 <= places[0] <= places[-1] <= total:
        raise ValueError(f"anchors need places of their own from 1 to {total}")
    early = base.filter(F.col("rank") + gap <= n)
    picked = numbered(early.withColumn("__h", _hash(seed, "repeat", F.col("word"))), "__i", "__h", "word").filter(F.col("__i") < int(n * repeats))
    slot = F.col("rank") + gap + uniform(n - F.col("rank") - gap + 1, seed, "slot", F.col("word"))
    both = base.select("word", F.col("rank").alias("slot"), F.lit(False).alias("is_repeat")).unionByName(picked.select("word", slot.alias("slot"), F.lit(True).alias("is_repeat")))
    ordered = numbered(both.withColumn("__h", _hash(seed, "tie", F.col("word"))), "i", "slot", ~F.col("is_repeat"), "__h", "word")
    passed = F.size(F.filter(F.array(*(F.lit(p - 1 - k) for k, p in enumerate(places))).cast("array<long>"), lambda x: x <= F.col("i"))) if fixed else F.lit(0)
    out = ordered.select((F.col("i") + passed + 1).alias("place"), "word", "is_repeat", F.lit(False).alias("is_anchor"))
    told = items.sparkSession.createDataFrame([(p, w) for p, w in fixed], "place long, word string").select("place", "word", F.lit(False).alias("is_repeat"), F.lit(True).alias("is_anchor"))
    return out.unionByName(told).select("place", F.substring(F.sha1(F.col("word").cast("binary")), 1, 8).alias("id"), "word", "is_repeat", "is_anchor")
