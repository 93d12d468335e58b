"""Reports over words: candidates for new words, affixes at their seams, audits, accent rules, designs of stimuli."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment, morphology, prosody
from ..functions.inventory import cv_code, encoded, tokens
from ..functions.patterns import compile_pattern
from ..functions.syllables import syllables
from ..sources.storage import cut
from . import search
from .constraints import violations


def default_fall(parsed: Column, scale: str = "rime") -> Column:
    """Where the accent falls by default: the only syllable, else the first that isn't light and isn't the last, else the last but one."""
    n = F.size(parsed)
    heavy = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: prosody.morae(F.get(parsed, i), scale) > 1)
    return F.when(n == 1, F.lit(0)).otherwise(F.coalesce(F.get(heavy, F.lit(0)), n - 2))


def accent_fall(accent: Column) -> Column:
    """Where an accent falls: at the first F, else at an H before an L; null if it doesn't."""
    at = F.sequence(F.lit(1), F.length(accent))
    falls = F.filter(at, lambda i: (accent.substr(i, F.lit(1)) == "F") | (accent.substr(i, F.lit(2)) == "HL"))
    return F.get(falls, F.lit(0)) - 1


def accent_kind(accent: Column) -> Column:
    """struct(kind, at): F and its place, else HL and the place of that H, else none; places from 0."""
    f, hl = F.instr(accent, "F"), F.instr(accent, "HL")
    return F.struct(F.when(f > 0, "F").when(hl > 0, "HL").otherwise("none").alias("kind"), F.when(f > 0, f - 1).when(hl > 0, hl - 1).alias("at"))


def predicted_accent(weights: Column, rule: str) -> Column:
    """Where a rule puts the accent, by the syllables' weights: of 2 and more is heavy."""
    heavy = F.filter(F.sequence(F.lit(0), F.size(weights) - 1), lambda i: F.get(weights, i) >= 2)
    return {
        "first_heavy": F.coalesce(F.get(heavy, F.lit(0)), F.lit(0)),
        "heaviest": F.array_position(weights, F.array_max(weights)).cast("int") - 1,
        "last_heavy": F.coalesce(F.get(heavy, F.size(heavy) - 1), F.size(weights) - 1),
    }[rule]


#: The rules that are compared.
ACCENT_RULES = ("first_heavy", "heaviest", "last_heavy")


def transcribed(words: DataFrame, word: str = "word", transcription: str = "transcription", accent: str = "accent") -> DataFrame:
    """``words`` with ``s``, the syllables of the spelling as the transcription divides it, ``longer`` and ``doubled`` (places of
    copied vowels and consonants) and ``problem``: a transcription that isn't of the spelling, one that can't be divided, or
    an accent of another length."""
    # written, as what follows looks at both more than once
    parts = cut(words.withColumn("__u", alignment.underlying(F.col(word), F.col(transcription))))
    divided = cut(parts.withColumn("__d", syllables(F.array_join(F.transform("__u", lambda x: x["text"]), "."))))
    places = F.sequence(F.lit(0), F.size("__u") - 1)
    problem = F.when(F.col("__u").isNull(), "not of the spelling").when(F.col("__d.syllables").isNull(), "no division").when(F.length(accent) != F.size("__u"), "another length")
    return divided.select(*words.columns, F.when(problem.isNull(), F.col("__d.syllables")).alias("s"), *(F.when(F.col("__u").isNotNull(), F.filter(places, lambda i: F.get(F.col("__u"), i)[k])).alias(k) for k in ("longer", "doubled")), problem.alias("problem"))


def accent_rules(words: DataFrame, weight: Column | None = None, word: str = "word", transcription: str = "transcription", accent: str = "accent") -> DataFrame:
    """(kind, rule, scale, n, hits, on_heavy, share) of transcribed words, by kind of accent: how often each rule finds the accent
    by each scale, and how often the accented syllable is heavy.  Words with a problem, or without a fall, don't count."""
    rows = transcribed(words.withColumn("__w", weight if weight is not None else F.lit(1)), word, transcription, accent).filter("problem is null").withColumn("a", accent_kind(F.col(accent))).filter("a.at is not null")

    def by_scale(scale: str) -> Column:
        return F.transform("s", lambda x: prosody.compared_weight(x, scale))

    weighed = {k: by_scale(k) for k in prosody.COMPARED}
    tests = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(k).alias("scale"), (predicted_accent(w, r) == F.col("a.at")).alias("hit"), (F.get(w, F.col("a.at")) >= 2).alias("heavy")) for k, w in weighed.items() for r in ACCENT_RULES))
    each = rows.select(F.col("a.kind").alias("kind"), F.col("__w").alias("w"), F.explode(tests).alias("t")).select("kind", "w", "t.*")
    summed = each.groupBy("kind", "rule", "scale").agg(F.sum("w").alias("n"), *(F.sum(F.when(F.col(c), F.col("w")).otherwise(0)).alias(name) for c, name in (("hit", "hits"), ("heavy", "on_heavy"))))
    return summed.withColumn("share", F.col("hits") / F.col("n"))


def accent_accuracy(words: DataFrame, word: str = "word", accent: str = "accent") -> DataFrame:
    """(scale, n, hits, share) of default falls against given accents, by weight scale."""
    parsed = words.withColumn("__s", syllables(F.col(word))["syllables"]).filter("__s is not null")
    parsed = parsed.filter(prosody.valid_accent(F.col(accent), F.col("__s"))).withColumn("__fall", accent_fall(F.col(accent)))
    scales = F.array(*(F.struct(F.lit(s).alias("scale"), (default_fall(F.col("__s"), s) == F.col("__fall")).alias("hit")) for s in prosody.SCALES))
    rows = parsed.select(F.explode(scales).alias("r")).select("r.*")
    return rows.groupBy("scale").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits")).withColumn("share", F.col("hits") / F.col("n"))


def candidate_report(candidates: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Each candidate word: whether it is of the inventory and divides strictly, its four-consonant runs, its spelled form, and how many words are one edit away."""
    s = syllables(F.col(word))
    run = compile_pattern("[C][C][C][C]").count(encoded(F.col(word)))
    near = search.neighbours(candidates.select(F.col(word).alias("form")), lexicon.select(F.col(word).alias("form"))).groupBy(F.col("x").alias(word)).agg(F.count("*").alias("neighbours"), F.min("y").alias("nearest"))
    spelled = F.when(tokens(F.col(word)).isNotNull(), morphology.spelled(F.col(word)))
    base = candidates.select(word).distinct().withColumn("__s", s)
    out = base.select(word, tokens(F.col(word)).isNotNull().alias("spellable"), (F.col("__s.error").isNull() & (F.size("__s.notes") == 0)).alias("strict"), F.col("__s.notes").alias("notes"), (run > 0).alias("long_run"), spelled.alias("spelled"))
    known = lexicon.select(F.col(word)).distinct().withColumn("registered", F.lit(True))
    return out.join(near, word, "left").join(known, word, "left").fillna(0, ["neighbours"]).fillna(False, ["registered"])


def affix_report(stems: DataFrame, affixes: DataFrame, stem: str = "word", affix: str = "affix") -> DataFrame:
    """(affix, join, n, kept_share, forms, new_violations): what joining does to stems, by affix and kind of join.

    The affixes are a small list; each stem is joined with all of them in one scan.
    """
    pairs = stems.select(F.col(stem).alias("s")).crossJoin(F.broadcast(affixes.select(F.col(affix).alias("x"))))
    joined = pairs.select("s", "x", F.explode(F.array(F.struct(F.lit("vowel").alias("join"), morphology.vowel_join(F.col("s"), F.col("x")).alias("form")), F.struct(F.lit("consonant").alias("join"), morphology.consonant_join(F.col("s"), F.col("x")).alias("form")))).alias("j")).select("s", "x", "j.*").filter("form is not null")
    total = lambda c: sum(violations(encoded(F.col(c))).values(), F.lit(0))
    kept = F.startswith("form", F.col("s"))
    added = F.when(kept, F.expr("substring(form, length(s) + 1)"))
    return joined.groupBy(F.col("x").alias("affix"), "join").agg(F.count("*").alias("n"), F.avg(kept.cast("double")).alias("kept_share"), F.count_distinct(added).alias("forms"), F.sum((total("form") > total("s")).cast("long")).alias("new_violations"))


def audit(words: DataFrame, word: str = "word") -> DataFrame:
    """(issue, n) of words that aren't spellable, can't be divided, need the relaxed tables, or break a hard constraint."""
    s = words.select(word).distinct().withColumn("__s", syllables(F.col(word)))
    hard = sum((c > 0).cast("int") for c in list(violations(encoded(F.col(word))).values())[:2])
    issue = F.when(tokens(F.col(word)).isNull(), "not spellable").when(F.col("__s.error").isNotNull(), "no division").when(F.size("__s.notes") > 0, "relaxed tables").when(hard > 0, "hard constraint").otherwise("none")
    return s.groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))


def stimulus_design(factors: dict[str, list[str]], words: DataFrame, word: str = "word", per_cell: int = 2, seed: int = 1) -> DataFrame:
    """(cell, skeleton, word): up to ``per_cell`` words for each combination of an onset, a nucleus and a coda shape of the first syllable.

    A cell's words are taken in a hashed order, so that a design can be repeated; the number for each cell is the feature.
    """
    parsed = words.select(word).distinct().withColumn("__s", syllables(F.col(word))["syllables"]).filter("__s is not null")
    first = F.col("__s")[0]
    shape = F.struct(F.size(first["onset"]).alias("onset"), F.size(first["nucleus"]).alias("nucleus"), F.size(first["coda"]).alias("coda"))
    wanted = F.lit(True)
    for name, values in factors.items():
        wanted = wanted & shape[name].cast("string").isin(values)
    rows = parsed.filter(wanted).select(word, cv_code(F.col(word)).alias("skeleton"), F.concat_ws("-", *(shape[k].cast("string") for k in ("onset", "nucleus", "coda"))).alias("cell"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64(word, F.lit(seed)), word))
    return rows.withColumn("__r", rank).filter(F.col("__r") <= per_cell).drop("__r")


def balance(design: DataFrame) -> DataFrame:
    return design.groupBy("cell").agg(F.count("*").alias("n"))


def blind_order(design: DataFrame, word: str = "word", seed: int = 1) -> DataFrame:
    """(place, id, word): a hashed order and an id that doesn't show the word.  A design is small: one sort numbers it."""
    order = Window.orderBy(F.xxhash64(word, F.lit(seed)), word)
    return design.select(F.row_number().over(order).alias("place"), F.substring(F.sha1(F.col(word)), 1, 8).alias("id"), word)
