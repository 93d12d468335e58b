import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from seqlattice.functions import inventory, marked, morphology, patterns, prosody, significance, syllables, tiers
from seqlattice.operators import constraints, rewriting


def test_inventory():
    assert len(inventory.PHONEMES) == 28 and len(inventory.VOWELS) == 7
    assert inventory.split("notcika") == ["n", "o", "tc", "i", "k", "a"]
    assert inventory.split("tsanknis") == ["ts", "a", "n", "k", "n", "i", "s"]
    assert inventory.split("quiz") is None


def test_native_tokens_equal_split(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("tsckhngzaoeiuvxwlq") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", inventory.tokens(F.col("w")).alias("t"), inventory.encoded(F.col("w")).alias("e")).collect()
    for r in rows:
        parts = inventory.split(r.w)
        assert r.t == parts
        if parts is not None:
            assert r.e == "".join(inventory.CODE[p] for p in parts)


@pytest.mark.parametrize("word, parts", [("likka", "lik.ka"), ("plappe", "plap.pe"), ("telissa", "te.lis.sa"), ("kwilwa", "kwi.lwa"), ("naz.loft", "naz.loft"), ("suis.kant", "suis.kant")])
def test_syllables(word, parts):
    found, notes, error = syllables.syllabify(word)
    assert error is None and not notes
    assert ".".join("".join("".join(p) for p in s) for s in found) == parts


def test_syllables_relaxed_and_rejected():
    assert syllables.syllabify("stcilkant")[1]
    assert syllables.syllabify("dblomboi")[0] is None
    assert syllables.syllabify("xyz")[2] == "not sounds of the inventory"


def _all_divisions(word):
    """Every legal division, shorter parts first."""
    if not word:
        yield []
        return
    vowel = [inventory.PHONEMES[p]["syl"] for p in word]
    for o, u, c in itertools.product(range(3), range(1, 3), range(3)):
        end = o + u + c
        if end > len(word):
            continue
        parts = (word[:o], word[o : o + u], word[o + u : end])
        if any(vowel[:o]) or not all(vowel[o : o + u]) or any(vowel[o + u : end]):
            continue
        if syllables.legal_onset(parts[0]) and syllables.legal_nucleus(parts[1]) and syllables.legal_coda(parts[2]):
            for rest in _all_divisions(word[end:]):
                yield [parts, *rest]


def test_recurrence_equals_enumeration():
    rng = random.Random(7)
    sounds = list(inventory.PHONEMES)
    tried = 0
    while tried < 150:
        word = tuple(rng.choice(sounds) for _ in range(rng.randint(1, 7)))
        every = list(_all_divisions(word))
        best = None
        for d in every:
            key = (sum(len(s[0]) for s in d), -len(d), tuple(len(s[0]) for s in d))
            if best is None or key > best[0]:
                best = (key, d)
        assert syllables.divide(word) == (best[1] if best else None)
        tried += bool(every)


@pytest.mark.parametrize("word, n", [("li", 1), ("mei", 2), ("kin", 2), ("baaf", 3), ("kant", 3)])
def test_morae(spark, word, n):
    row = spark.createDataFrame([(word,)], "w string").select(syllables.syllables(F.col("w"))["syllables"].alias("s"))
    assert row.select(prosody.morae(F.col("s")[0])).first()[0] == n


def test_scales_and_contours(spark):
    rows = spark.createDataFrame([("paklata", "HLL"), ("kwilwa", "FR")], "w string, a string").withColumn("s", syllables.syllables(F.col("w"))["syllables"])
    out = rows.select("w", F.transform("s", lambda x: prosody.morae(x)).alias("r"), F.transform("s", lambda x: prosody.morae(x, "onset_sensitive")).alias("o"), F.size(prosody.contour_problems(F.col("a"), F.col("s"))).alias("p"), F.size(prosody.contour_problems(F.col("a"), F.col("s"), "onset_sensitive")).alias("q"), prosody.valid_accent(F.col("a"), F.col("s")).alias("v")).collect()
    by = {r.w: r for r in out}
    assert list(by["paklata"].r) == [1, 1, 1] and list(by["paklata"].o) == [1, 2, 1]
    assert (by["kwilwa"].p, by["kwilwa"].q) == (2, 0)
    assert by["paklata"].v and by["kwilwa"].v


@pytest.mark.parametrize("pattern, word, n", [("*[C][C][C]", "konstav", 1), ("([S]|[T])[+syl]", "tesav", 2), ("[T]#", "kat", 1), ("[V]?", "ka", 3), ("a", "kakhang", 2), ("#[C]", "kak", 1), ("[!V]", "kat", 2)])
def test_pattern_counts(spark, pattern, word, n):
    compiled = patterns.compile_pattern(pattern)
    assert spark.createDataFrame([(word,)], "w string").select(compiled.count(inventory.encoded(F.col("w")))).first()[0] == n
    code = "".join(inventory.CODE[p] for p in inventory.split(word))
    assert sum(bool(re.compile(compiled.java).match(code, i)) for i in range(len(code) + 1)) == n


@pytest.mark.parametrize("pattern, word, n", [("[C](#|[O])", "kat", 1), ("(#|[V])[T]", "kat", 2), ("(a|#b)", "baba", 3), ("[C]_[V]", "kat", 1), ("[V]_#", "ka", 1), ("#[V]", "kat", 0)])
def test_edges_and_focus(spark, pattern, word, n):
    compiled = patterns.compile_pattern(pattern)
    assert spark.createDataFrame([(word,)], "w string").select(compiled.count(inventory.encoded(F.col("w")))).first()[0] == n


def test_pattern_errors():
    for bad in ("([C]", "[Cx", "qq", "&", "[role=coda]", "[+nothing]"):
        with pytest.raises(ValueError):
            patterns.compile_pattern(bad)


@pytest.mark.parametrize("a, b, vowels, joined", [("kan", "tos", True, "kanatos"), ("kan", "os", True, "kanos"), ("ka", "tos", True, "katos"), ("ka", "in", True, "kain"), ("ats", "tca", False, "asca"), ("", "ka", True, "ka"), ("xq", "ka", True, None), ("ke", "oka", True, "koeka"), ("ki", "eka", True, "keika"), ("kae", "ia", True, "kaia"), ("kai", "ak", True, "kajak"), ("ki", "aek", True, "kijak"), ("kant", "ka", False, "kanatka"), ("kant", "ska", False, "kanataska")])
def test_joins(spark, a, b, vowels, joined):
    join = morphology.vowel_join if vowels else morphology.consonant_join
    assert spark.createDataFrame([(a, b)], "a string, b string").select(join(F.col("a"), F.col("b"))).first()[0] == joined


def test_spelling_rules(spark):
    words = "tuuf diin mesja jiik khi tci tswa sija tita hika zsja jjjia".split()
    rows = spark.createDataFrame(list(enumerate(words)), "i int, w string").orderBy("i").select(morphology.spelled(F.col("w"))).collect()
    assert [r[0] for r in rows] == "tcuuf zciin meca iik khi tci tswa cija tcita khika zca ia".split()


@pytest.mark.parametrize("word, ipa", [("kat", "kaʔ"), ("kant", "kaʔ"), ("kalt", "kalt"), ("t", "ʔ"), ("aeka", "æːka"), ("aaea", "aːæː"), ("aovu", "aoːɘ"), ("tcang", "t͡ɕaŋ"), ("khunoel", "xɘnœːl")])
def test_speech(spark, word, ipa):
    assert spark.createDataFrame([(word,)], "w string").select(morphology.to_ipa(inventory.tokens(F.col("w")))).first()[0] == ipa


def test_tiers(spark):
    row = spark.createDataFrame([("kana",)], "w string").withColumn("t", inventory.tokens(F.col("w")))
    get = lambda name: row.select(tiers.tier(name)(F.col("t"))).first()[0]
    assert get("cv") == ["C", "V", "C", "V"] and get("natural_class") == ["T", "V", "N", "V"]
    assert get("feature:nas") == ["-", "-", "+", "-"] and get("sonority") == ["2", "10", "6", "10"]
    assert get("feature:high") == ["0", "-", "0", "-"]
    assert row.select(tiers.zipped(F.col("t"), tiers.tier("cv")(F.col("t")))).first()[0] == ["k/C", "a/V", "n/C", "a/V"]
    with pytest.raises(ValueError):
        tiers.tier("nothing")


@pytest.mark.parametrize("word, result", [("kalam", "kalum"), ("pataka", "paduga"), ("notcika", "notciga"), ("kankal", "kangkuw")])
def test_rewriting(word, result):
    assert rewriting.derive(word, [rewriting.Rule(*r) for r in rewriting.CORRECTIONS])[0] == result


def test_weights_have_no_gradient_left():
    import numpy as np

    rng = np.random.default_rng(4)
    seen, sampled = rng.poisson(0.4, (40, 3)).astype(float), rng.poisson([1.0, 0.5, 0.3], (500, 3)).astype(float)
    weight = rng.integers(1, 9, 40).astype(float)
    w = constraints.fit_weights(seen, weight, sampled, l2=0.5)
    p = np.exp(-sampled @ w)
    p /= p.sum()
    grad = weight.sum() * ((seen * weight[:, None]).sum(axis=0) / weight.sum() - p @ sampled) + 0.5 * w
    assert (w >= 0).all()
    assert (np.abs(grad[w > 0]) < 1e-4).all() and (grad[w == 0] > -1e-4).all()


def test_binomial():
    assert constraints.binomial_p(5, 10, 0.5) == pytest.approx(1.0)
    assert constraints.binomial_p(0, 10, 0.5) == pytest.approx(2 / 1024)
    assert constraints.binomial_p(0, 10, 0.0) == 1.0 and constraints.binomial_p(1, 10, 0.0) == 0.0
    rng = random.Random(3)
    for _ in range(200):
        n, p = rng.randint(1, 60), rng.choice([rng.random(), 0.5])
        k = rng.randint(0, n)
        mass = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        assert constraints.binomial_p(k, n, p) == pytest.approx(min(1.0, sum(m for m in mass if m <= mass[k] * (1 + 1e-7))), rel=1e-6)
    assert constraints.binomial_p(520_000, 1_000_000, 0.519) == pytest.approx(0.0453, abs=1e-4)


def test_chi_square_tail():
    for x, dof, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (0.0, 4, 1.0)):
        assert significance.chi_square_p(x, dof) == pytest.approx(p, abs=1e-6)


# (pattern, tier, word, places)
MARKED = [
    ("*[C][C][C]", "segment", "konstav", 1), ("[C].[C]", "segment", "likka", 1), ("[C].[C]", "segment", "pata", 0), ("#[C]", "segment", "pata", 1), ("[+syl]#", "segment", "pata", 1), ("[T][L]", "segment", "paklata", 1),
    ("kl", "segment", "paklata", 1), ("<k><l>", "segment", "paklata", 1), ("[-son,+cons][+lat]", "segment", "paklata", 1), ("([S]|[T])[+syl]", "segment", "tesav", 2), ("[!V]", "segment", "pata", 2), ("[]{2}", "segment", "pata", 3),
    ("[weight=superheavy]", "syllable", "suis|kant", 2), ("[final=true]", "syllable", "suis|kant", 1), ("[penult=true]", "syllable", "suis|kant", 1), ("[+cons,role=coda]", "segment", "naz|loft", 3), ("[+cons,role=onset]", "segment", "naz|loft", 2),
    ("σ{2}", "syllable", "pakata", 2), ("σ", "segment", "pakata", 0), ("[V]?", "segment", "ka", 5), ("#", "segment", "ka", 2), (".[C]", "segment", "pata", 0), ("a_.[C]", "segment", "pata", 1), ("[role!=coda]", "segment", "kat", 2),
    ("[high!=true]", "segment", "kit", 2), ("[-high]", "segment", "kit", 0), ("[!+high]", "segment", "kit", 2), ("[syl_mora>2]", "segment", "kant", 4), ("[shape=CVC]#", "syllable", "pakat", 1), ("<ka>", "syllable", "pakata", 1), ("kat*[V]", "segment", "kattta", 1),
]


def test_marked_patterns(spark):
    words = spark.createDataFrame([(w,) for w in sorted({w for _, _, w, _ in MARKED})], "w string").withColumn("s", syllables.syllables(F.col("w"))["syllables"])
    tiered = words.select("w", marked.segments(F.col("s")).alias("segment"), marked.syllable_tier(F.col("s")).alias("syllable"))
    compiled = [(marked.compile_marked(p, t), F.col(t)) for p, t, _, _ in MARKED]
    rows = {r[0]: r for r in tiered.select("w", *(f for c, t in compiled for f in (c.count(t), c.found(t)))).collect()}
    for i, (pattern, tier, word, n) in enumerate(MARKED):
        assert (pattern, tier, word, rows[word][1 + 2 * i], rows[word][2 + 2 * i]) == (pattern, tier, word, n, n > 0)


def test_marked_edge_cases(spark):
    count = marked.compile_marked("[C][C]").count(marked.undivided(inventory.tokens(F.col("w"))))
    rows = spark.createDataFrame([("kst",), ("",), (None,)], "w string").select(count.alias("n")).collect()
    assert [r.n for r in rows] == [2, 0, None]
    accented = marked.compile_marked("[accent=F]").count(marked.segments(F.col("s"), F.col("a")))
    rows = spark.createDataFrame([("kata", "HF"), ("kata", ""), ("kata", None)], "w string, a string").withColumn("s", syllables.syllables(F.col("w"))["syllables"]).select(accented.alias("n")).collect()
    assert [r.n for r in rows] == [2, 0, 0]
    for bad in ("([C]", "[C])", "*|", "qq", "&", "[+nothing]", "[!R]", "+", "[index>x]", "X"):
        with pytest.raises(ValueError):
            marked.compile_marked(bad)


def test_syllable_tiers(spark):
    row = spark.createDataFrame([("paklata",)], "w string").select(syllables.syllables(F.col("w"))["syllables"].alias("s"))
    got = row.select(*(t(F.col("s")).alias(k) for k, t in tiers.SYLLABLE_TIERS.items())).first().asDict()
    assert got["syllable"] == ["pa", "kla", "ta"] and got["syllable_class_shape"] == ["T-V-", "TL-V-", "T-V-"]
    assert got["onset_shape"] == ["T", "TL", "T"] and got["coda_shape"] == ["∅"] * 3 and got["mora:onset_sensitive"] == ["1", "2", "1"]


@pytest.mark.parametrize("bad", ["{2}a", "a{2", "a{3,1}", "a{}", "a{x}", "[+syl", "(*a)", "a|?", "a**", "_+"])
def test_patterns_that_are_refused(bad):
    with pytest.raises(ValueError):
        patterns.compile_pattern(bad)


def test_counted_repeats(spark):
    rows = spark.createDataFrame([("taat",), ("taaat",), ("tt",)], "w string")
    counts = {p: [r.n for r in rows.select(patterns.compile_pattern(p).count(F.col("w")).alias("n")).collect()] for p in ("ta{,2}t", "ta{2,}t", "ta{3}t", "ta{0,1}t", "t(aa){,1}t")}
    assert counts == {"ta{,2}t": [1, 0, 1], "ta{2,}t": [1, 1, 0], "ta{3}t": [0, 1, 0], "ta{0,1}t": [0, 0, 1], "t(aa){,1}t": [1, 0, 1]}
