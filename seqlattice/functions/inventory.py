"""The sound inventory that tokenises, classifies and spells words, and Column functions over it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sounds, by spelling.  Consonants have no features of vowels.
SOUNDS = [
    {"spell": "f", "ipa": "f", "manner": "fricative", "place": "labial", "sonor": 4, "syl": False, "cons": True, "son": False, "voi": False, "cont": True, "nas": False, "lat": False},
    {"spell": "s", "ipa": "s", "manner": "fricative", "place": "alveolar", "sonor": 4, "syl": False, "cons": True, "son": False, "voi": False, "cont": True, "nas": False, "lat": False},
    {"spell": "z", "ipa": "z", "manner": "fricative", "place": "alveolar", "sonor": 5, "syl": False, "cons": True, "son": False, "voi": True, "cont": True, "nas": False, "lat": False},
    {"spell": "c", "ipa": "ɕ", "manner": "fricative", "place": "postalveolar", "sonor": 4, "syl": False, "cons": True, "son": False, "voi": False, "cont": True, "nas": False, "lat": False},
    {"spell": "zc", "ipa": "ʑ", "manner": "fricative", "place": "postalveolar", "sonor": 5, "syl": False, "cons": True, "son": False, "voi": True, "cont": True, "nas": False, "lat": False},
    {"spell": "kh", "ipa": "x", "manner": "fricative", "place": "velar", "sonor": 4, "syl": False, "cons": True, "son": False, "voi": False, "cont": True, "nas": False, "lat": False},
    {"spell": "h", "ipa": "h", "manner": "fricative", "place": "glottal", "sonor": 4, "syl": False, "cons": True, "son": False, "voi": False, "cont": True, "nas": False, "lat": False},
    {"spell": "ts", "ipa": "t͡s", "manner": "affricate", "place": "alveolar", "sonor": 3, "syl": False, "cons": True, "son": False, "voi": False, "cont": False, "nas": False, "lat": False},
    {"spell": "tc", "ipa": "t͡ɕ", "manner": "affricate", "place": "postalveolar", "sonor": 3, "syl": False, "cons": True, "son": False, "voi": False, "cont": False, "nas": False, "lat": False},
    {"spell": "p", "ipa": "p", "manner": "plosive", "place": "labial", "sonor": 2, "syl": False, "cons": True, "son": False, "voi": False, "cont": False, "nas": False, "lat": False},
    {"spell": "b", "ipa": "b", "manner": "plosive", "place": "labial", "sonor": 3, "syl": False, "cons": True, "son": False, "voi": True, "cont": False, "nas": False, "lat": False},
    {"spell": "t", "ipa": "t", "manner": "plosive", "place": "alveolar", "sonor": 2, "syl": False, "cons": True, "son": False, "voi": False, "cont": False, "nas": False, "lat": False},
    {"spell": "d", "ipa": "d", "manner": "plosive", "place": "alveolar", "sonor": 3, "syl": False, "cons": True, "son": False, "voi": True, "cont": False, "nas": False, "lat": False},
    {"spell": "k", "ipa": "k", "manner": "plosive", "place": "velar", "sonor": 2, "syl": False, "cons": True, "son": False, "voi": False, "cont": False, "nas": False, "lat": False},
    {"spell": "g", "ipa": "g", "manner": "plosive", "place": "velar", "sonor": 3, "syl": False, "cons": True, "son": False, "voi": True, "cont": False, "nas": False, "lat": False},
    {"spell": "m", "ipa": "m", "manner": "nasal", "place": "labial", "sonor": 6, "syl": False, "cons": True, "son": True, "voi": True, "cont": False, "nas": True, "lat": False},
    {"spell": "n", "ipa": "n", "manner": "nasal", "place": "alveolar", "sonor": 6, "syl": False, "cons": True, "son": True, "voi": True, "cont": False, "nas": True, "lat": False},
    {"spell": "ng", "ipa": "ŋ", "manner": "nasal", "place": "velar", "sonor": 6, "syl": False, "cons": True, "son": True, "voi": True, "cont": False, "nas": True, "lat": False},
    {"spell": "l", "ipa": "l", "manner": "liquid", "place": "alveolar", "sonor": 7, "syl": False, "cons": True, "son": True, "voi": True, "cont": True, "nas": False, "lat": True},
    {"spell": "w", "ipa": "w", "manner": "approximant", "place": "labial", "sonor": 8, "syl": False, "cons": True, "son": True, "voi": True, "cont": True, "nas": False, "lat": False},
    {"spell": "j", "ipa": "j", "manner": "approximant", "place": "palatal", "sonor": 8, "syl": False, "cons": True, "son": True, "voi": True, "cont": True, "nas": False, "lat": False},
    {"spell": "a", "ipa": "a", "manner": "vowel", "place": "alveolar", "sonor": 10, "syl": True, "cons": False, "son": True, "voi": True, "cont": True, "nas": False, "lat": False, "high": False, "low": True, "back": False, "round": False, "central": True},
    {"spell": "o", "ipa": "o", "manner": "vowel", "place": "velar", "sonor": 10, "syl": True, "cons": False, "son": True, "voi": True, "cont": True, "nas": False, "lat": False, "high": False, "low": False, "back": True, "round": True},
    {"spell": "e", "ipa": "e", "manner": "vowel", "place": "palatal", "sonor": 10, "syl": True, "cons": False, "son": True, "voi": True, "cont": True, "nas": False, "lat": False, "high": False, "low": False, "back": False, "round": False},
    {"spell": "i", "ipa": "i", "manner": "vowel", "place": "palatal", "sonor": 10, "syl": True, "cons": False, "son": True, "voi": True, "cont": True, "nas": False, "lat": False, "high": True, "low": False, "back": False, "round": False},
    {"spell": "y", "ipa": "y", "manner": "vowel", "place": "palatal", "sonor": 10, "syl": True, "cons": False, "son": True, "voi": True, "cont": True, "nas": False, "lat": False, "high": True, "low": False, "back": False, "round": True},
    {"spell": "u", "ipa": "ɘ", "manner": "vowel", "place": "velar", "sonor": 10, "syl": True, "cons": False, "son": True, "voi": True, "cont": True, "nas": False, "lat": False, "high": True, "low": False, "back": True, "round": False, "central": True},
    {"spell": "v", "ipa": "u", "manner": "vowel", "place": "velar", "sonor": 10, "syl": True, "cons": False, "son": True, "voi": True, "cont": True, "nas": False, "lat": False, "high": True, "low": False, "back": True, "round": True},
]
PHONEMES: dict[str, dict] = {f["spell"]: f for f in SOUNDS}
VOWELS = tuple(p for p, f in PHONEMES.items() if f["syl"])
CONSONANTS = tuple(p for p, f in PHONEMES.items() if f["cons"])
DIGRAPHS = tuple(p for p in PHONEMES if len(p) == 2)
# Classes by manner, and the order in which a phoneme's class is looked for.
CLASSES = {
    "C": lambda f: f["cons"], "V": lambda f: f["syl"], "S": lambda f: f["manner"] == "fricative", "Q": lambda f: f["manner"] == "affricate",
    "T": lambda f: f["manner"] == "plosive", "N": lambda f: f["manner"] == "nasal", "L": lambda f: f["manner"] == "liquid",
    "J": lambda f: f["manner"] == "approximant", "O": lambda f: f["cons"] and not f["son"], "R": lambda f: f["cons"] and f["son"],
}
CLASS_ORDER = "SQTNLJV"
MEMBERS = {name: tuple(p for p, f in PHONEMES.items() if test(f)) for name, test in CLASSES.items()}
CLASS_OF = {p: next((c for c in CLASS_ORDER if p in MEMBERS[c]), "?") for p in PHONEMES}
# Which classes may follow which in an onset and a coda, and which vowels in a nucleus.
ONSET_PAIRS = {"S": "TNLJ", "T": "LJ", "N": "LJ", "L": "J"}
CODA_PAIRS = {"S": "T", "T": "T", "N": "ST", "L": "TN"}
NUCLEUS_PAIRS = {"a": "aeiyuv", "o": "aoeiyuv", "e": "aeiy", "i": "i", "y": "y", "u": "iyu", "v": "v"}
ONSET_MAX, NUCLEUS_MAX, CODA_MAX = 2, 2, 2
# Morae by scale.
SCALES = {"rime": {"onset": 0, "license_onset": False}, "onset_sensitive": {"onset": 1, "license_onset": True}}
# Spelling rules, in order.
SPELLING = [
    {"sj": "c", "zj": "zc", "tsj": "tc", "tj": "tc", "dj": "zc", "hj": "kh"},
    {"si": "ci", "sy": "cy", "su": "cu", "sv": "cv", "zi": "zci", "zy": "zcy", "zu": "zcu", "zv": "zcv", "tsi": "tci", "tsy": "tcy", "tsu": "tcu", "tsv": "tcv", "ti": "tci", "ty": "tcy", "tu": "tcu", "tv": "tcv", "di": "zci", "dy": "zcy", "du": "zcu", "dv": "zcv", "hi": "khi", "hy": "khy", "hu": "khu", "hv": "khv"},
    {"ji": "i"},
]
# Vowel pairs that fuse in speech.
FUSION = {"ae": "æː", "ea": "æː", "oe": "œː", "oy": "øː", "av": "ɔː", "ov": "oː", "aa": "aː", "oo": "oː", "ee": "eː", "ii": "iː", "yy": "yː", "uu": "ɘː", "vv": "uː"}
# Declared constraints (name, pattern, weight).
CONSTRAINTS = [("MAX-CLUSTER-3", "*[C][C][C][C]", float("inf")), ("NO-DOUBLE-Q-ONSET", "*[Q][C]", float("inf")), ("FINAL-SJV-AE", "*([S]|[J])[+syl,-low,+high]#", 4.0)]

#: One character for each phoneme: digraphs get digits, so that patterns become character classes.
CODE = {p: (str(DIGRAPHS.index(p)) if p in DIGRAPHS else p) for p in PHONEMES}
TOKEN = "(" + "|".join(DIGRAPHS) + "|[" + "".join(p for p in PHONEMES if len(p) == 1) + "])"


def split(spell: str) -> list[str] | None:
    """Longest-match tokens of a spelling; None if a letter isn't in the inventory."""
    out, i = [], 0
    while i < len(spell):
        n = 2 if spell[i : i + 2] in PHONEMES else 1
        if spell[i : i + n] not in PHONEMES:
            return None
        out.append(spell[i : i + n])
        i += n
    return out


def tokens(word: Column) -> Column:
    """Phonemes of a word by longest match; null where a letter isn't in the inventory."""
    found = F.regexp_extract_all(word, F.lit(TOKEN), F.lit(1))
    return F.when(F.concat_ws("", found) == word, found)


def encoded(word: Column) -> Column:
    """A tokenisable word with one character for each phoneme: no digraph ends as another begins, so order is free."""
    for p in DIGRAPHS:
        word = F.replace(word, F.lit(p), F.lit(CODE[p]))
    return word


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def mapped(symbols: Column, values: dict, default: str | None = None) -> Column:
    """Each symbol of an array by a small table."""
    table = _lookup({k: str(v) for k, v in values.items()})
    return F.transform(symbols, lambda p: F.coalesce(table[p], F.lit(default)))


def cv_code(word: Column) -> Column:
    """A tokenisable word as a string of C and V."""
    code = encoded(word)
    vowels, rest = "".join(CODE[p] for p in VOWELS), "".join(CODE[p] for p in CONSONANTS)
    return F.translate(code, vowels + rest, "V" * len(vowels) + "C" * len(rest))


def clusters(word: Column, least: int = 2) -> Column:
    """Runs of ``least`` or more consonants, as spelled: each run once, left to right."""
    run = "((?:" + "|".join(DIGRAPHS) + "|[" + "".join(p for p in CONSONANTS if len(p) == 1) + "])" + f"{{{least},}})"
    return F.regexp_extract_all(word, F.lit(run), F.lit(1))
