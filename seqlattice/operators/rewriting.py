"""Ordered rewrite rules over syllabified words: each rule in one pass from the left, then the word is divided anew."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.inventory import MEMBERS, PHONEMES, split
from ..functions.patterns import test
from ..functions.syllables import syllabify

# The correction rules, in order (name, target, replacement, left, right); ``_`` marks no context.
CORRECTIONS = [
    ("voicing_intervocalic", "t", "d", "[+syl]", "[+syl]"),
    ("voicing_intervocalic", "k", "g", "[+syl]", "[+syl]"),
    ("voicing_intervocalic", "p", "b", "[+syl]", "[+syl]"),
    ("voicing_intervocalic", "s", "z", "[+syl]", "[+syl]"),
    ("coda_k_spirantization", "k", "kh", "", "(#|[O])"),
    ("velar_nasal_assimilation", "n", "ng", "", "(k|g|kh)"),
    ("final_nasal_velarization", "[spell=n,initial=false]", "ng", "", "#"),
    ("a_reduction_medial", "[spell=a,initial=false,final=false]", "u", "", ""),
    ("a_reduction_final_closed", "[spell=a,initial=false]", "u", "", "[role=coda] #"),
    ("o_reduction_closed", "[spell=o,initial=false]", "v", "", "[role=coda]"),
    ("coda_l_vocalization", "[spell=l,role=coda]", "w", "", ""),
]


@dataclass(frozen=True)
class Rule:
    name: str
    target: str
    replacement: str
    left: str
    right: str


def segments(spell: str) -> list[dict] | None:
    """The sounds of a word with their features and places in syllables; None if it can't be divided."""
    syllables, _, _ = syllabify(spell)
    if syllables is None:
        return None
    out = []
    for i, parts in enumerate(syllables):
        for role, part in zip(("onset", "nucleus", "coda"), parts, strict=True):
            out += [{**PHONEMES[p], "role": role, "initial": i == 0, "final": i == len(syllables) - 1} for p in part]
    return out


@lru_cache(1000)
def _alternatives(context: str) -> list[list[str]]:
    """A context of one group of alternatives, or a sequence, as lists of atoms."""
    context = context.strip()
    if context.startswith("(") and context.endswith(")"):
        return [re.findall(r"\[[^\]]*\]|#|[a-z]+", a) for a in context[1:-1].split("|")]
    return [re.findall(r"\[[^\]]*\]|#|[a-z]+", context)]


def _atom(atom: str, word: list[dict], i: int) -> bool:
    if atom == "#":
        return i in (-1, len(word))
    if not 0 <= i < len(word):
        return False
    if atom[0] != "[":
        return word[i]["spell"] == atom
    return all((word[i]["spell"] in MEMBERS[t]) if t in MEMBERS else test(t, word[i]) for t in _tests(atom))


@lru_cache(10_000)
def _tests(atom: str) -> list[str]:
    return re.split(r"[,\s]+", atom[1:-1])


def apply_rule(spell: str, rule: Rule, word: list[dict] | None = None) -> tuple[str, int]:
    """(spelling, places changed); contexts are those of the word before.  ``word`` is its segments, if they are known."""
    word = segments(spell) if word is None else word
    if word is None:
        return spell, 0
    out, hits = [], 0
    for i, s in enumerate(word):
        hit = _atom(rule.target, word, i)
        hit = hit and any(all(_atom(a, word, i - len(alt) + k) for k, a in enumerate(alt)) for alt in _alternatives(rule.left))
        hit = hit and any(all(_atom(a, word, i + 1 + k) for k, a in enumerate(alt)) for alt in _alternatives(rule.right))
        hits += hit
        out.append(rule.replacement if hit else s["spell"])
    return "".join(out), hits


def derive(spell: str, rules: list[Rule]) -> tuple[str, list[str]]:
    """(result, names of the rules that changed it)."""
    steps = []
    word = segments(spell)
    for rule in rules:
        if word is None:
            break
        new, hits = apply_rule(spell, rule, word)
        if hits and new != spell:
            steps.append(rule.name)
            spell, word = new, segments(new)
    return spell, steps


def rewritten(word: Column, rules: list[Rule] | None = None) -> Column:
    """struct(result, steps) of a spelling under ordered rules."""
    ordered = rules or [Rule(*r) for r in CORRECTIONS]

    @F.pandas_udf(T.StructType([T.StructField("result", T.StringType()), T.StructField("steps", T.ArrayType(T.StringType()))]))
    def apply(words: pd.Series) -> pd.DataFrame:
        rows = [(None, []) if w is None else derive(w, ordered) if split(w) else (w, []) for w in words]
        return pd.DataFrame({"result": [r for r, _ in rows], "steps": [s for _, s in rows]})

    return apply(word)


def collisions(derived: DataFrame, source: str = "word", result: str = "result") -> DataFrame:
    """(result, n, first, last) of results that two or more sources share."""
    return derived.groupBy(result).agg(F.count("*").alias("n"), F.min(source).alias("first"), F.max(source).alias("last")).filter("n > 1")
