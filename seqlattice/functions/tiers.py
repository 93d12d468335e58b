"""Tiers: what a word's phonemes are projected to, each a function of an array column to an array column."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import prosody
from .inventory import CLASS_OF, PHONEMES, SCALES, mapped
from .marked import spelling

Tier = Callable[[Column], Column]


def feature(name: str) -> Tier:
    """The value of a feature: + or - for a binary one, the value itself for others, 0 where it is missing."""
    values = {p: ("+" if f[name] else "-") if isinstance(f.get(name), bool) else f.get(name, "0") for p, f in PHONEMES.items()}
    return lambda symbols: mapped(symbols, values, "0")


TIERS: dict[str, Tier] = {
    "phoneme": lambda symbols: symbols,
    "ipa": lambda symbols: mapped(symbols, {p: f["ipa"] for p, f in PHONEMES.items()}),
    "natural_class": lambda symbols: mapped(symbols, CLASS_OF, "?"),
    "cv": lambda symbols: mapped(symbols, {p: "V" if f["syl"] else "C" for p, f in PHONEMES.items()}),
    "manner": feature("manner"),
    "place": feature("place"),
    "sonority": feature("sonor"),
}


def _classes(part: Column) -> Column:
    return F.array_join(mapped(part, CLASS_OF, "?"), "")


def _weight(scale: str, syllable: Column) -> Column:
    return prosody.weight(prosody.morae(syllable, scale))


def _mora(scale: str, syllable: Column) -> Column:
    return prosody.morae(syllable, scale).cast("string")


def _each(of: Callable[[Column], Column]) -> Tier:
    return lambda syllables: F.transform(syllables, lambda s: of(s))


#: What a divided word's syllables are projected to: functions of an array of (onset, nucleus, coda).
SYLLABLE_TIERS: dict[str, Tier] = {
    "syllable": _each(spelling),
    "syllable_shape": _each(prosody.shape),
    "syllable_class_shape": _each(lambda s: F.concat_ws("-", _classes(s["onset"]), _classes(s["nucleus"]), _classes(s["coda"]))),
    "onset_shape": _each(lambda s: F.when(F.size(s["onset"]) == 0, "∅").otherwise(_classes(s["onset"]))),
    "coda_shape": _each(lambda s: F.when(F.size(s["coda"]) == 0, "∅").otherwise(_classes(s["coda"]))),
    **{f"weight:{k}": _each(partial(_weight, k)) for k in SCALES},
    **{f"mora:{k}": _each(partial(_mora, k)) for k in SCALES},
}


def accent(column: Column) -> Column:
    """The accent tier: its letters, none where there is no accent."""
    return F.when(F.length(column) > 0, F.split(column, "")).otherwise(F.array().cast("array<string>"))


def tier(name: str) -> Tier:
    """A tier by name: of sounds, of syllables, ``accent``, or ``feature:x`` for any feature.

    A tier of sounds takes an array of sounds, one of syllables an array of (onset, nucleus, coda), the accent its string.
    """
    kind, _, rest = name.partition(":")
    if kind == "feature":
        return feature(rest)
    if name == "accent":
        return accent
    if name not in TIERS | SYLLABLE_TIERS:
        raise ValueError(f"no tier {name!r}; there are {', '.join([*TIERS, *SYLLABLE_TIERS])}, accent and feature:NAME")
    return (TIERS | SYLLABLE_TIERS)[name]


def zipped(left: Column, right: Column, mark: str = "/") -> Column:
    """Two tiers joined pairwise; empty where their lengths differ."""
    both = F.zip_with(left, right, lambda a, b: F.concat_ws(mark, a, b))
    return F.when(F.size(left) == F.size(right), both).otherwise(F.array().cast("array<string>"))


def sequence_offsets(symbols: Column, form: Column) -> Column:
    """Letters before each place where the sounds ``form`` begin in ``symbols``, whole sounds only."""
    places = F.sequence(F.lit(1), F.size(symbols) - F.size(form) + 1)
    hits = F.filter(places, lambda i: F.slice(symbols, i, F.size(form)) == form)
    found = F.transform(hits, lambda i: F.length(F.concat_ws("", F.slice(symbols, F.lit(1), i - 1))))
    return F.when((F.size(form) > 0) & (F.size(form) <= F.size(symbols)), found).otherwise(F.array().cast("array<int>"))
