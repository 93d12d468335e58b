"""Joining forms, spelling rules and speech, as Column expressions.

Where two forms meet, their runs of vowels (or of consonants) become one run:

- vowels: from the seam leftwards a vowel and the one behind it merge, as long as they are no nucleus in either order; a
  merged vowel is y if one of the two is rounded, else i.  What is left before a nucleus is led by its first vowel and
  the glide j; a single vowel before it keeps only the nucleus's first.
- consonants: each consonant of the left run but the last opens a syllable of its own with a; the last one does too if
  more than one consonant follows, else both become the onset, affricates without their stop.
- where neither form has such a run at the seam, a or n stands between them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .inventory import CODE, CONSONANTS, DIGRAPHS, FUSION, NUCLEUS_PAIRS, PHONEMES, SPELLING, VOWELS, encoded, split, tokens

# Affricates and what is left of them in an onset; what stands between forms that have nothing to join.
OPENED = {"ts": "s", "tc": "c"}
LINK_VOWEL, LINK_CONSONANT, GLIDE, EPENTHETIC = "a", "n", "j", "a"
MERGED, MERGED_ROUND = "i", "y"


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def _decoded(code: Column) -> Column:
    """A word of one character a sound as it is spelled."""
    for p in DIGRAPHS:
        code = F.replace(code, F.lit(CODE[p]), F.lit(p))
    return code


def _codes(spell: str) -> str:
    return "".join(CODE[p] for p in split(spell))


def spelled(word: Column) -> Column:
    """A word of the inventory by the spelling rules: set after set, and within one no result is another rule's start.

    A rule that gives back the end of what it takes applies again there, so it takes any number of what it drops.
    """
    for rules in SPELLING:
        code = encoded(word)
        for taken, given in rules.items():
            dropped = taken.removesuffix(given)
            pattern = _codes(taken) if dropped == taken else f"(?:{_codes(dropped)})+{_codes(given)}"
            code = F.regexp_replace(code, F.lit(pattern), F.lit(_codes(given)))
        word = _decoded(code)
    return word


def _runs(symbols: Column, members: tuple[str, ...], at_end: bool) -> tuple[Column, Column]:
    """(the rest, the run of members) at one end of an array of sounds."""
    n = F.size(symbols)
    inner = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: ~F.coalesce(F.try_element_at(symbols, i).isin(*members), F.lit(True)))
    if at_end:
        kept = F.coalesce(F.array_max(inner), F.lit(0))
        return F.slice(symbols, F.lit(1), kept), F.slice(symbols, kept + 1, n - kept)
    run = F.coalesce(F.array_min(inner) - 1, n)
    return F.slice(symbols, run + 1, n - run), F.slice(symbols, F.lit(1), run)


def _met(a: Column, b: Column) -> Column:
    """The vowels that two vowels become."""
    nuclei = [x + y for x, ys in NUCLEUS_PAIRS.items() for y in ys]
    rounded = [p for p in VOWELS if PHONEMES[p]["round"]]
    merged = F.when(a.isin(*rounded) | b.isin(*rounded), MERGED_ROUND).otherwise(MERGED)
    return F.when(F.concat(a, b).isin(*nuclei), F.array(a, b)).when(F.concat(b, a).isin(*nuclei), F.array(b, a)).otherwise(F.array(merged))


def _vowels_met(left: Column, right: Column) -> Column:
    start = F.struct(right.alias("out"), F.size(left).alias("before"))
    single = F.aggregate(F.reverse(left), start, lambda acc, v: F.when(F.size(acc["out"]) == 1, F.struct(_met(v, acc["out"][0]).alias("out"), (acc["before"] - 1).alias("before"))).otherwise(acc))
    led = F.concat(F.slice(left, 1, 1), F.array(F.lit(GLIDE)), F.slice(single["out"], F.lit(1), F.when(single["before"] == 1, 1).otherwise(F.size(single["out"]))))
    return F.when(single["before"] == 0, single["out"]).otherwise(led)


def _consonants_met(left: Column, right: Column) -> Column:
    opened = _lookup(OPENED)
    last = F.slice(left, F.size(left), F.lit(1))
    alone = F.flatten(F.transform(F.slice(left, F.lit(1), F.size(left) - 1), lambda c: F.array(c, F.lit(EPENTHETIC))))
    pair = F.transform(F.concat(last, right), lambda c: F.coalesce(opened[c], c))
    return F.concat(alone, F.when(F.size(right) == 1, pair).otherwise(F.concat(last, F.array(F.lit(EPENTHETIC)), right)))


def _joined(left: Column, right: Column, members: tuple[str, ...], link: str, met) -> Column:
    rest, a = _runs(tokens(left), members, True)
    more, b = _runs(tokens(right), members, False)
    seam = F.when((F.size(a) > 0) & (F.size(b) > 0), met(a, b)).when((F.size(a) > 0) | (F.size(b) > 0), F.concat(a, b)).otherwise(F.array(F.lit(link)))
    form = spelled(F.concat_ws("", rest, seam, more))
    known = tokens(left).isNotNull() & tokens(right).isNotNull()
    return F.when(known & ((left == "") | (right == "")), F.concat(left, right)).when(known, form)


def vowel_join(left: Column, right: Column) -> Column:
    """Two spellings joined by vowels; null if one isn't of the inventory.  An empty form leaves the other as it is."""
    return _joined(left, right, VOWELS, LINK_VOWEL, _vowels_met)


def consonant_join(left: Column, right: Column) -> Column:
    """Two spellings joined by consonants; null if one isn't of the inventory.  An empty form leaves the other as it is."""
    return _joined(left, right, CONSONANTS, LINK_CONSONANT, _consonants_met)


def to_ipa(symbols: Column) -> Column:
    """Speech of an array of sounds, by built-in functions: a fold that joins pairs, then the end of the word."""
    vowels = [p for p, f in PHONEMES.items() if f["syl"]]
    plosives = [p for p, f in PHONEMES.items() if f["manner"] == "plosive"]
    nasals = [p for p, f in PHONEMES.items() if f["manner"] == "nasal"]
    sound = F.create_map(*(F.lit(x) for p, f in PHONEMES.items() for x in (p, f["ipa"])))
    fused = F.create_map(*(F.lit(x) for kv in FUSION.items() for x in kv))
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("held"))
    # a vowel is held until the next sound shows whether they fuse

    def step(acc: Column, p: Column) -> Column:
        pair = fused[F.concat(acc["held"], p)]
        flushed = F.concat(acc["out"], F.coalesce(sound[acc["held"]], F.lit("")))
        return (
            F.when((acc["held"] != "") & p.isin(vowels) & pair.isNotNull(), F.struct(F.concat(acc["out"], pair).alias("out"), F.lit("").alias("held")))
            .when(p.isin(vowels), F.struct(flushed.alias("out"), p.alias("held")))
            .otherwise(F.struct(F.concat(flushed, sound[p]).alias("out"), F.lit("").alias("held")))
        )

    def spoken(syms: Column) -> Column:
        return F.aggregate(syms, start, step, lambda acc: F.concat(acc["out"], F.coalesce(sound[acc["held"]], F.lit(""))))

    n = F.size(symbols)
    last, before = F.try_element_at(symbols, F.lit(-1)), F.try_element_at(symbols, F.lit(-2))
    stop = F.lit("ʔ")
    alone = last.isin(plosives) & (before.isNull() | before.isin(vowels))
    reduced = last.isin(plosives) & before.isin(nasals)
    return F.when(alone, F.concat(spoken(F.slice(symbols, 1, n - 1)), stop)).when(reduced, F.concat(spoken(F.slice(symbols, 1, n - 2)), stop)).otherwise(spoken(symbols))
