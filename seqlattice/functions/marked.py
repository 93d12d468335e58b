"""Patterns over words divided into syllables: edges of syllables, and tests of where a sound or a syllable stands.

A word's tier is an array of structs, one for each sound (``segments``) or syllable (``syllable_tier``).  Each distinct
test of a pattern becomes one bit; a sound or syllable becomes the character of its bits, and the pattern a regular
expression over these characters, ``.`` between syllables and ``#`` at both ends.  So the whole match is built-in
functions over one string.

Beyond ``patterns``: ``.`` is the edge of a syllable, which sounds otherwise step over; ``<x>`` is a sound or syllable as
spelled; ``σ`` is any syllable; ``#`` takes a place of its own.  Starts are all places but edges of syllables, with the
one behind the last ``#``.  A null tier gives null; an empty one has its two edges.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import prosody
from .inventory import MEMBERS, PHONEMES, split
from .patterns import FEATURES, parse_test, test

#: What a sound knows of its place, and what a syllable knows of itself.
SEGMENT_FIELDS = {
    "role": str, "role_index": int, "syl_index": int, "from_end": int, "initial": bool, "final": bool, "penult": bool,
    "word_initial": bool, "syl_weight": str, "syl_mora": int, "syl_shape": str, "accent": str,
}
SYLLABLE_FIELDS = {
    "unit": str, "onset_size": int, "nucleus_size": int, "coda_size": int, "open": bool, "shape": str, "mora": int, "weight": str,
    "accent": str, "index": int, "initial": bool, "final": bool, "penult": bool, "from_end": int,
}
#: Distinct tests of one pattern; each doubles the alphabet.
BITS = 10
_FIRST = 0x4E00
_ATOM = re.compile(r"\[(?P<spec>[^\]]*)\]|<(?P<spell>[^>]+)>|(?P<mark>[#._σ(|)])|(?P<cls>[A-Z])|(?P<run>[a-z]+)|(?P<times>[?*+]|\{\d*,?\d*\})|\s+")


def _mark(accent: Column | None, i: Column) -> Column:
    letter = F.lit(None).cast("string") if accent is None else accent.substr(i + 1, F.lit(1))
    return F.when(letter != "", letter).alias("accent")


def segments(syllables: Column, accent: Column | None = None) -> Column:
    """The sounds of a divided word with their places; ``opens`` marks the first of a syllable."""
    n = F.size(syllables)

    def sounds(s: Column, i: Column) -> Column:
        morae = prosody.morae(s)

        def part(role: str) -> Column:
            bare = F.lit(role == "onset") | (F.lit(role == "nucleus") & (F.size(s["onset"]) == 0))
            return F.transform(s[role], lambda p, k: F.struct(
                p.alias("spell"), F.lit(role).alias("role"), k.alias("role_index"), i.alias("syl_index"), (n - i).alias("from_end"), (i == 0).alias("initial"), (i == n - 1).alias("final"), (i == n - 2).alias("penult"),
                (F.lit(role == "onset") & (i == 0) & (k == 0)).alias("word_initial"), prosody.weight(morae).alias("syl_weight"), morae.alias("syl_mora"), prosody.shape(s).alias("syl_shape"), _mark(accent, i), (bare & (k == 0)).alias("opens"),
            ))

        return F.concat(part("onset"), part("nucleus"), part("coda"))

    return F.flatten(F.transform(syllables, sounds))


def undivided(tokens: Column) -> Column:
    """The sounds of a word that has no division: no places are known and no syllable has an edge."""
    kinds = {str: "string", int: "int", bool: "boolean"}
    return F.transform(tokens, lambda p: F.struct(p.alias("spell"), *(F.lit(None).cast(kinds[k]).alias(name) for name, k in SEGMENT_FIELDS.items()), F.lit(False).alias("opens")))


def syllable_tier(syllables: Column, accent: Column | None = None) -> Column:
    """The syllables of a divided word with their sizes, weights and places."""
    n = F.size(syllables)

    def one(s: Column, i: Column) -> Column:
        morae = prosody.morae(s)
        return F.struct(
            spelling(s).alias("spell"), F.lit("syllable").alias("unit"), F.size(s["onset"]).alias("onset_size"), F.size(s["nucleus"]).alias("nucleus_size"), F.size(s["coda"]).alias("coda_size"), (F.size(s["coda"]) == 0).alias("open"),
            prosody.shape(s).alias("shape"), morae.alias("mora"), prosody.weight(morae).alias("weight"), _mark(accent, i), i.alias("index"), (i == 0).alias("initial"), (i == n - 1).alias("final"), (i == n - 2).alias("penult"), (n - i).alias("from_end"),
        )

    return F.transform(syllables, one)


def spelling(syllable: Column) -> Column:
    return F.concat_ws("", syllable["onset"], syllable["nucleus"], syllable["coda"])


def _holds(spec: str, symbol: Column, fields: dict[str, type]) -> Column:
    """Whether a sound or syllable passes one test; what it doesn't know is neither + nor -, equals nothing and differs from all."""
    sounds = fields is SEGMENT_FIELDS
    name = spec.lstrip("!")
    if name in MEMBERS:
        return symbol["spell"].isin(*MEMBERS[name]) == F.lit(spec == name) if sounds else F.lit(spec != name)
    negate, sign, name, op, value = parse_test(spec)
    if name in FEATURES and name not in fields:
        if sounds:
            return symbol["spell"].isin(*(p for p, f in PHONEMES.items() if test(spec, f)))
        passed = F.lit(op == "!=")
    elif name not in fields:
        passed = F.lit(op == "!=")
    else:
        have, kind = symbol[name], fields[name]
        if sign or op is None:
            passed = have == F.lit(sign != "-") if kind is bool else F.lit(False)
        elif op in ("=", "!="):
            if kind is bool:
                equal = have == F.lit(value == "true") if value in ("true", "false") else F.lit(False)
            else:
                equal = have.cast("string") == (str(int(value)) if kind is int and value.isdigit() else value)
            equal = F.coalesce(equal, F.lit(False))
            passed = equal if op == "=" else ~equal
        else:
            bound = F.lit(float(value))
            passed = {">": have > bound, "<": have < bound, ">=": have >= bound, "<=": have <= bound}[op] if kind is int else F.lit(False)
    passed = F.coalesce(passed, F.lit(False))
    return ~passed if negate else passed


@dataclass(frozen=True)
class MarkedPattern:
    text: str
    prohibits: bool
    tier: str
    specs: tuple[tuple[str, ...], ...]
    java: str

    def encoded(self, tier: Column) -> Column:
        """The string that the expression is matched with."""
        fields = SEGMENT_FIELDS if self.tier == "segment" else SYLLABLE_FIELDS
        alphabet = F.lit("".join(chr(_FIRST + i) for i in range(2 ** len(self.specs))))

        def letter(symbol: Column) -> Column:
            place = F.lit(1)
            for bit, spec in enumerate(self.specs):
                passed = F.lit(True)
                for one in spec:
                    held = symbol["spell"] == one[1:-1] if one.startswith("<") else _holds(one, symbol, fields)
                    passed = passed & held
                place = place + F.when(passed, 2**bit).otherwise(0)
            own = alphabet.substr(place, F.lit(1))
            return F.when(symbol["opens"] & (symbol["syl_index"] > 0), F.concat(F.lit("."), own)).otherwise(own) if self.tier == "segment" else own

        return F.concat(F.lit("#"), F.array_join(F.transform(tier, letter), ""), F.lit("#"))

    def count(self, tier: Column) -> Column:
        """Places of a tier where the pattern begins."""
        return F.regexp_count(self.encoded(tier), F.lit(rf"(?=(?!\.)(?:{self.java}))"))

    def found(self, tier: Column) -> Column:
        """Whether the pattern begins anywhere."""
        return self.encoded(tier).rlike(rf"(?!\.)(?:{self.java})")


def compile_marked(text: str, tier: str = "segment") -> MarkedPattern:
    """Compile a pattern over the sounds (``segment``) or syllables (``syllable``) of divided words."""
    if tier not in ("segment", "syllable"):
        raise ValueError(f"no tier {tier!r}; there are segment and syllable")
    text = text.strip()
    body = text.removeprefix("*")
    specs: dict[tuple[str, ...], int] = {}
    groups: list[list[list[str]]] = [[[]]]  # open groups, of alternatives, of pieces

    def symbol(spec: tuple[str, ...]) -> str:
        return f"\\.?{{{specs.setdefault(spec, len(specs))}}}" if tier == "segment" else f"{{{specs.setdefault(spec, len(specs))}}}"

    at = 0
    while at < len(body):
        m = _ATOM.match(body, at)
        if not m:
            raise ValueError(f"unexpected {body[at]!r} at {at} in {text!r}")
        pieces, mark = groups[-1][-1], m["mark"]
        if m["spec"] is not None:
            pieces.append(symbol(tuple(s for s in re.split(r"[,\s]+", m["spec"]) if s)))
        elif m["spell"]:
            pieces.append(symbol((m[0],)))
        elif m["cls"]:
            if m["cls"] not in MEMBERS:
                raise ValueError(f"no class {m['cls']!r}")
            pieces.append(symbol((m["cls"],)))
        elif m["run"]:
            sounds = split(m["run"])
            if sounds is None:
                raise ValueError(f"not sounds: {m['run']!r}")
            pieces += [symbol((f"<{p}>",)) for p in sounds]
        elif m["times"]:
            if not pieces:
                raise ValueError(f"nothing to repeat at {at} in {text!r}")
            times = m["times"].replace("{,", "{0,")
            pieces[-1] = f"(?:{pieces[-1]}){times.replace('{', '{{').replace('}', '}}')}"
        elif mark == "(":
            groups.append([[]])
        elif mark in ("|", ")"):
            if len(groups) == 1:
                raise ValueError(f"unexpected {mark!r} at {at} in {text!r}")
            if mark == "|":
                groups[-1].append([])
            else:
                done = groups.pop()
                groups[-1][-1].append("(?:" + "|".join("".join(p) for p in done) + ")")
        elif mark:
            pieces.append({"#": "#", ".": "\\.", "_": "(?:)", "σ": ""}[mark] or symbol(("unit=syllable",)))
        at = m.end()
    if len(groups) > 1:
        raise ValueError(f"unbalanced parentheses in {text!r}")
    if len(specs) > BITS:
        raise ValueError(f"more than {BITS} different tests in {text!r}")
    for one in (one for spec in specs for one in spec if not one.startswith("<")):
        _check(one)
    every = range(2 ** len(specs))
    letters = ["[" + "".join(chr(_FIRST + i) for i in every if i >> bit & 1) + "]" for bit in range(len(specs))]
    return MarkedPattern(text, text.startswith("*"), tier, tuple(specs), "".join(groups[0][0]).format(*letters))


def _check(spec: str) -> None:
    """Errors of a test show when the pattern is compiled, before any session is there."""
    name = spec.lstrip("!")
    if name in MEMBERS:
        if spec != name and name in "OR":
            raise ValueError(f"a class of several features can't be negated: {spec!r}")
        return
    _, _, name, op, value = parse_test(spec)
    if name not in FEATURES and name not in SEGMENT_FIELDS and name not in SYLLABLE_FIELDS:
        raise ValueError(f"neither sounds nor syllables have {name!r}")
    if op in (">", "<", ">=", "<="):
        float(value)
