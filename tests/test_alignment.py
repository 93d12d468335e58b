import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqlattice.functions import alignment, prosody, syllables, tiers
from seqlattice.functions.inventory import VOWELS, split
from seqlattice.operators import reports
from seqlattice.operators.rewriting import CORRECTIONS, Rule, derive
from seqlattice.plans import texts
from seqlattice.sources.tables import spoken


def _plain(x, y):
    """The whole edit table, then the way back by the moves it holds."""
    def copy(j):
        return j > 1 and y[j - 1] == y[j - 2]

    cost = {(0, 0): (0, "")}
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            ways = []
            if i and j:
                c, s = cost[i - 1, j - 1]
                equal = x[i - 1] == y[j - 1]
                ways.append((c + (0 if equal else 2), 0, s + ("=" if equal else "~")))
            if i:
                c, s = cost[i - 1, j]
                ways.append((c + 2, 1, s + "-"))
            if j:
                c, s = cost[i, j - 1]
                ways.append((c + (1 if copy(j) else 2), 2, s + ("*" if copy(j) else "+")))
            if ways:
                c, _, s = min(ways, key=lambda w: w[:2])
                cost[i, j] = c, s
    return cost[len(x), len(y)]


def _pairs(x, y, steps):
    out, i, j = [], 0, 0
    for s in steps:
        left, right = s in "=~-", s != "-"
        out.append((x[i] if left else None, y[j] if right else None, s == "*"))
        i, j = i + left, j + right
    return out


def test_alignment_equals_the_whole_table(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))) for _ in range(120)] + [("", ""), ("kata", "kaatta")]
    letters = lambda c: F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
    rows = spark.createDataFrame(pairs, "x string, y string").select("x", "y", letters("x").alias("a"), letters("y").alias("b"))
    found = rows.withColumn("w", alignment.alignment(F.col("a"), F.col("b"))).withColumn("p", alignment.aligned_pairs(F.col("a"), F.col("b"), F.col("w.steps")))
    for r in found.collect():
        assert (r.w.cost, r.w.steps) == _plain(r.x, r.y)
        assert [tuple(p) for p in r.p] == _pairs(r.x, r.y, r.w.steps)


def test_correction_pairs_equal_a_plain_count(spark, small):
    expected = Counter()
    for r in spoken(spark, small).collect():
        y = derive(r.word, [Rule(*x) for x in CORRECTIONS])[0]
        if y != r.word:
            for left, right, copy in _pairs(r.word, y, _plain(r.word, y)[1]):
                if left != right:
                    expected[left or "", right or "", copy] += r.n
    assert {(r.left, r.right, r.copy): r.n for r in texts.correction_pairs(spark, small).collect()} == dict(expected)


def _plain_copies(spelled, realized):
    own, at = [], 0
    for i, ch in enumerate(realized):
        if spelled[at : at + 1] == ch:
            own.append(True)
            at += 1
        elif i and realized[i - 1] == ch:
            own.append(False)
        else:
            return None
    if at < len(spelled):
        return None
    for i in range(1, len(own)):
        if realized[i - 1] == realized[i] and realized[i] not in VOWELS and (own[i - 1], own[i]) == (True, False):
            own[i - 1 : i + 1] = False, True
    return own


def test_copies_of_transcriptions(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(150):
        word = "".join(rng.choice("katnio") for _ in range(rng.randint(0, 7)))
        said = "".join(c * rng.choice((1, 1, 2, 3)) for c in word)
        if rng.random() < 0.2:
            said = said[:-1] + rng.choice("kxa")
        at = sorted(rng.sample(range(len(said) + 1), min(len(said), 2)))
        parts = [said[a:b] for a, b in zip([0, *at], [*at, len(said)], strict=True)]
        rows.append((word, ".".join(parts)))
    found = spark.createDataFrame(rows, "w string, t string").withColumn("c", alignment.copied(F.col("w"), F.replace("t", F.lit("."), F.lit("")))).withColumn("u", alignment.underlying(F.col("w"), F.col("t"))).collect()
    for r in found:
        own = _plain_copies(r.w, r.t.replace(".", ""))
        assert r.c == own
        if own is None:
            assert r.u is None
            continue
        expected, at = [], 0
        for s in r.t.split("."):
            mine = own[at : at + len(s)]
            at += len(s)
            gone = [ch for ch, m in zip(s, mine, strict=True) if not m]
            expected.append(("".join(ch for ch, m in zip(s, mine, strict=True) if m), any(ch in VOWELS for ch in gone), any(ch not in VOWELS for ch in gone)))
        assert [tuple(x) for x in r.u] == expected
    assert sum(r.u is None for r in found) > 5


def test_accents_of_transcriptions(spark):
    rows = [("kata", "kaat.ta", "FL"), ("kanta", "kan.taa", "LF"), ("katan", "ka.tan", "LF"), ("paka", "pa.ka", "HL"), ("pa", "po", "F"), ("pa", "pa", "FL"), ("pata", "pa.ta", "LL")]
    words = spark.createDataFrame(rows, "word string, transcription string, accent string")
    told = {(r.word, r.transcription): r for r in reports.transcribed(words).collect()}
    assert told["kata", "kaat.ta"].longer == [0] and told["kata", "kaat.ta"].doubled == [0] and told["pa", "po"].problem == "not of the spelling" and told["pa", "pa"].problem == "another length"
    got = {(r.kind, r.rule, r.scale): (r.n, r.hits, r.on_heavy) for r in reports.accent_rules(words).collect()}
    assert got["F", "first_heavy", "rime"] == (3, 2, 1) and got["F", "last_heavy", "rime"] == (3, 1, 1) and got["HL", "first_heavy", "rime"] == (1, 1, 0) and len(got) == 18
    kinds = spark.createDataFrame([("HLF",), ("LHL",), ("LL",), ("",)], "a string").select(reports.accent_kind(F.col("a")).alias("k")).collect()
    assert [tuple(r.k) for r in kinds] == [("F", 2), ("HL", 1), ("none", None), ("none", None)]


def _all_divisions(word, strict=True):
    """Every way to cut a word at all, kept where each part is allowed."""
    n, out = len(word), []

    def parts(syllable):
        kinds = "".join("V" if p in VOWELS else "C" for p in syllable)
        o = len(kinds) - len(kinds.lstrip("C"))
        v = len(kinds.strip("C"))
        return syllable[:o], syllable[o : o + v], syllable[o + v :]

    for mask in range(1 << (n - 1)):
        cuts = [0, *(i + 1 for i in range(n - 1) if mask >> i & 1), n]
        pieces = [parts(word[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        good = all(len(o) <= 2 and 1 <= len(v) <= 2 and len(c) <= 2 and all(p in VOWELS for p in v) for o, v, c in pieces)
        if good and (not strict or all(syllables.legal_onset(o) and syllables.legal_nucleus(v) and syllables.legal_coda(c) for o, v, c in pieces)):
            out.append(pieces)
    return sorted(out, key=lambda d: [tuple(map(len, s)) for s in d])


@pytest.mark.parametrize("word", ["kata", "paklata", "naistla", "aeia", "kwilwa", "ktk", "tsansta", "mpta"])
def test_divisions_and_scores_equal_all_cuts(word):
    sounds = tuple(split(word))
    for strict in (True, False):
        ways = _all_divisions(sounds, strict)
        assert list(syllables.divisions(sounds, strict=strict)) == ways
        for score, of in ((syllables.onsets_first, lambda d: (sum(len(o) for o, _, _ in d), -len(d), [len(o) for o, _, _ in d])), (syllables.codas_first, lambda d: (sum(len(c) for _, _, c in d), -len(d)))):
            best = max(ways, key=of) if ways else None
            assert syllables.divide(sounds, strict=strict, score=score) == best


def test_divisions_of_rows(spark):
    rows = spark.createDataFrame([("atta",), (None,), ("",), ("qqq",), ("ktka",)], "w string").lateralJoin(syllables.Divisions(F.col("w").outer())).collect()
    assert {(r.w, r.place, r.divided, r.legal) for r in rows} == {("atta", 0, "at.ta", True), ("atta", 1, "att.a", True)}
    own = spark.createDataFrame([("atta",)], "w string").select(syllables.syllables(F.col("w"), lambda o, v, c, rest: ((rest or (0,))[0] + v + (c == 2),))["syllables"].alias("s")).first().s
    assert [("".join(x.onset), "".join(x.coda)) for x in own] == [("", "tt"), ("", "")]


def test_accents_of_any_length(spark):
    word = spark.createDataFrame([("ka" * 80, "L" * 70 + "F" + "L" * 9)], "w string, a string").withColumn("s", syllables.syllables(F.col("w"))["syllables"])
    assert word.select(prosody.contour_problems(F.col("a"), F.col("s")).alias("p")).first().p == [70]


def test_tiers_by_name(spark):
    row = spark.createDataFrame([("kanta", "FL")], "w string, a string").withColumn("s", syllables.syllables(F.col("w"))["syllables"])
    names = ["syllable_shape", "weight:rime", "mora:rime", "onset_shape"]
    got = row.select(*(tiers.tier(n)(F.col("s")).alias(n) for n in names), tiers.tier("accent")(F.col("a")).alias("accent")).first()
    assert [list(x) for x in got] == [["CVC", "CV"], ["heavy", "light"], ["2", "1"], ["T", "T"], ["F", "L"]]
    with pytest.raises(ValueError, match="weight:rime"):
        tiers.tier("nothing")
