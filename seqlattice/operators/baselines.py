"""Random words to hold a lexicon against: three models of what words would be by chance.

``cv`` draws a skeleton of C and V as often as words have it and fills each place from all consonants or vowels;
``unigram`` draws a length and fills each place from all sounds; ``positional`` does so with the first, the last and the
sounds between counted apart (a word of one sound has only a first).

A draw is a hash of the seed, the number of the try and the place, so the words don't depend on how rows are dealt.
Skeletons and lengths grow with the lexicon: their cumulative shares are summed in 256 parts by hash, and a draw finds its
interval by an equi-join on slices of the whole.  Sounds are as many as the inventory has; they go along as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.inventory import VOWELS
from ..functions.syllables import syllables
from ..sources.storage import cut

MODES = ("cv", "unigram", "positional")
#: Slices of the whole for the join of draws with intervals.
SLICES = 1024
#: What a sampled word must be: anything, divided into syllables somehow, or with legal parts only.
ACCEPT = ("any", "divided", "legal")


def uniform(total: Column | int, *keys: Column | int | str) -> Column:
    """A number below ``total`` for the keys: the first 48 bits of their MD5."""
    text = F.concat_ws(":", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % total


def intervals(counts: DataFrame) -> DataFrame:
    """(symbol, low, high) of (symbol, w): each symbol's part of the sum, in the order of the symbols' MD5."""
    keyed = counts.filter("w > 0").withColumn("h", F.md5("symbol")).withColumn("part", F.substring("h", 1, 2))
    sums = keyed.groupBy("part").agg(F.sum("w").alias("here"))  # 256 rows
    before = F.coalesce(F.sum("here").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum("w").over(Window.partitionBy("part").orderBy("h", "symbol").rowsBetween(Window.unboundedPreceding, 0))
    joined = keyed.withColumn("upto", upto).join(sums.select("part", before.alias("before")), "part")
    return joined.select("symbol", (F.col("before") + F.col("upto") - F.col("w")).alias("low"), (F.col("before") + F.col("upto")).alias("high"))


@dataclass(frozen=True)
class Baseline:
    """A fitted model: ``whole`` (symbol, low, high) of skeletons or lengths; of each kind of place its sounds and their cumulative counts."""

    mode: str
    whole: DataFrame
    total: int
    sounds: dict[str, tuple[list[str], list[int]]]


def fit(words: DataFrame, tokens: str, weight: str, mode: str = "cv") -> Baseline:
    """The model of a lexicon (tokens array, weight)."""
    if mode not in MODES:
        raise ValueError(f"no such model: {mode!r}")
    kind = lambda p: F.when(p.isin(*VOWELS), "V").otherwise("C")
    rows = words.filter(F.size(tokens) > 0)
    symbol = F.concat_ws("", F.transform(tokens, kind)) if mode == "cv" else F.size(tokens).cast("string")
    whole = cut(intervals(rows.groupBy(symbol.alias("symbol")).agg(F.sum(weight).alias("w"))))
    placed = rows.select(F.col(weight).alias("w"), F.size(tokens).alias("size"), F.posexplode(tokens).alias("i", "symbol"))
    place = {"cv": kind(F.col("symbol")), "unigram": F.lit("all"), "positional": F.when(F.col("i") == 0, "first").when(F.col("i") == F.col("size") - 1, "last").otherwise("middle")}[mode]
    sounds: dict[str, tuple[list[str], list[int]]] = {}
    for r in placed.groupBy(place.alias("place"), "symbol").agg(F.sum("w").alias("w")).orderBy("place", "symbol").collect():  # sounds times places
        symbols, upto = sounds.setdefault(r.place, ([], []))
        symbols.append(r.symbol)
        upto.append((upto[-1] if upto else 0) + r.w)
    return Baseline(mode, whole, whole.agg(F.max("high")).first()[0] or 0, sounds)


def _sound(model: Baseline, place: Column, *keys) -> Column:
    """The sound that a draw takes at a place."""
    out = F.lit(None).cast("string")
    for name, (symbols, upto) in model.sounds.items():
        u = uniform(upto[-1], *keys)
        below = F.aggregate(F.array(*map(F.lit, upto)), F.struct(u.alias("u"), F.lit(0).alias("n")), lambda a, x: F.struct(a["u"].alias("u"), (a["n"] + (x <= a["u"]).cast("int")).alias("n")), lambda a: a["n"])
        out = F.when(place == name, F.element_at(F.array(*map(F.lit, symbols)), below + 1)).otherwise(out)
    return out


def spelled(model: Baseline, first: int, last: int, seed: int = 0) -> DataFrame:
    """(try, word) of the tries from ``first`` up to ``last``, whatever the words are."""
    def slice_of(x: Column) -> Column:
        return F.floor(x * SLICES / F.lit(model.total))

    spark = model.whole.sparkSession
    draws = spark.range(first, last).select(F.col("id").alias("try"), uniform(model.total, seed, F.col("id"), "w").alias("u"))
    spread = model.whole.withColumn("slice", F.explode(F.sequence(slice_of(F.col("low")), slice_of(F.col("high")))))
    drawn = draws.withColumn("slice", slice_of(F.col("u"))).join(spread, "slice").filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    if model.mode == "cv":
        places = F.split("symbol", "")
    else:
        n = F.col("symbol").cast("int")
        name = (lambda i: F.lit("all")) if model.mode == "unigram" else (lambda i: F.when(i == 0, "first").when(i == n - 1, "last").otherwise("middle"))
        places = F.transform(F.sequence(F.lit(0), n - 1), name)
    word = F.concat_ws("", F.transform("places", lambda place, i: _sound(model, place, seed, F.col("try"), i)))
    return drawn.select("try", places.alias("places")).select("try", word.alias("word"))


def accepted(words: DataFrame, accept: str) -> DataFrame:
    """The words that can be divided, or whose parts are all legal."""
    if accept == "any":
        return words
    found = words.withColumn("d", syllables(F.col("word"))).filter("d.error is null")
    return (found.filter(F.size("d.notes") == 0) if accept == "legal" else found).drop("d")


def sample(model: Baseline, n: int, seed: int = 0, accept: str = "any", most: int = 200) -> DataFrame:
    """(try, word) of the first ``n`` tries that are accepted; fewer if ``most`` tries a word don't give as many.

    Tries are made in rounds, as many as the words that are still open ask for at the rate seen so far.
    """
    if accept not in ACCEPT:
        raise ValueError(f"no such test: {accept!r}")
    parts, have, at, limit = [], 0, 0, n * most if model.total else 0
    rate = 1.0
    while have < n and at < limit:
        upto = min(limit, at + max(64, math.ceil((n - have) / rate * 1.1)))
        part = cut(accepted(spelled(model, at, upto, seed), accept))
        found = part.count()
        if have + found > n:
            part = part.orderBy("try").limit(n - have)
        parts.append(part)
        rate = max((have + found) / upto, 1 / most)
        have, at = have + found, upto
    if not parts:
        return model.whole.sparkSession.createDataFrame([], "try long, word string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
