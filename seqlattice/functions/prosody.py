"""Weight of syllables, given as structs of onset, nucleus and coda arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .inventory import PHONEMES, SCALES


def morae(syllable: Column, scale: str = "rime") -> Column:
    """Nucleus 1 or 2, each coda consonant 1, and what the scale gives for onset consonants after the first."""
    extra = F.greatest(F.size(syllable["onset"]) - 1, F.lit(0)) * SCALES[scale]["onset"]
    return F.when(F.size(syllable["nucleus"]) > 1, 2).otherwise(1) + F.size(syllable["coda"]) + extra


def licensing_morae(syllable: Column, scale: str = "rime") -> Column:
    """Morae that can carry a contour: those of the rime, and of the onset only where the scale says so."""
    return morae(syllable, scale if SCALES[scale]["license_onset"] else "rime")


#: What counts beyond the nucleus: every coda consonant or any coda, and onset consonants after the first.
COMPARED = {"rime": {"coda": "each", "onset": False}, "onset": {"coda": "each", "onset": True}, "katakana": {"coda": "any", "onset": True}}


def compared_weight(syllable: Column, scale: str) -> Column:
    """The weight of a syllable by one of the scales that are compared with heard accents."""
    counts, coda = COMPARED[scale], F.size(syllable["coda"])
    extra = F.greatest(F.size(syllable["onset"]) - 1, F.lit(0)) if counts["onset"] else F.lit(0)
    return F.when(F.size(syllable["nucleus"]) == 1, 1).otherwise(2) + (coda if counts["coda"] == "each" else F.least(coda, F.lit(1))) + extra


def weight(n: Column) -> Column:
    return F.when(n <= 1, "light").when(n == 2, "heavy").otherwise("superheavy")


def shape(syllable: Column) -> Column:
    """C and V of a syllable."""
    return F.concat(F.repeat(F.lit("C"), F.size(syllable["onset"])), F.repeat(F.lit("V"), F.size(syllable["nucleus"])), F.repeat(F.lit("C"), F.size(syllable["coda"])))


def valid_accent(accent: Column, syllables: Column) -> Column:
    """Whether an accent is over H, L, F, R and as long as the word has syllables."""
    return F.coalesce(accent.rlike("^[HLFR]*$") & (F.length(accent) == F.size(syllables)), F.lit(False))


def contour_problems(accent: Column, syllables: Column, scale: str = "rime", least: int = 2) -> Column:
    """Places (from 0) of falling or rising syllables with too few licensing morae."""
    at = F.sequence(F.lit(0), F.greatest(F.size(syllables) - 1, F.lit(0)))
    bad = F.filter(at, lambda i: F.substring(accent, i + 1, F.lit(1)).isin("F", "R") & (licensing_morae(F.get(syllables, i), scale) < least))
    return F.when(F.size(syllables) > 0, bad).otherwise(F.array().cast("array<int>"))


def needs_lengthening(syllable: Column) -> Column:
    """Whether a syllable has one vowel and no sonorant right behind it."""
    sonorants = [p for p, f in PHONEMES.items() if f["cons"] and f["son"]]
    return (F.size(syllable["nucleus"]) < 2) & ~F.coalesce(F.get(syllable["coda"], F.lit(0)).isin(*sonorants), F.lit(False))
