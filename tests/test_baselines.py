import math
from collections import Counter

import pytest

from seqlattice.functions.inventory import CLASS_OF, CONSTRAINTS, VOWELS, split
from seqlattice.functions.syllables import syllabify
from seqlattice.operators import baselines, constraints
from seqlattice.plans import texts
from seqlattice.sources.tables import spoken


def _words(spark, counts):
    return spark.createDataFrame([(w, split(w), n) for w, n in counts.items()], "word string, tokens array<string>, n long")


TOY = {"pata": 5, "pakata": 3, "tsaka": 2, "a": 4, "meide": 1, "kwil": 2}


@pytest.mark.parametrize("mode", baselines.MODES)
def test_draws_are_the_same_however_rows_are_dealt(spark, mode):
    words = _words(spark, TOY)
    one = sorted(map(tuple, baselines.spelled(baselines.fit(words, "tokens", "n", mode), 0, 400, 7).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        two = sorted(map(tuple, baselines.spelled(baselines.fit(words.repartition(5, "word"), "tokens", "n", mode), 0, 400, 7).repartition(3).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == two and [t for t, _ in one] == list(range(400))
    assert one != sorted(map(tuple, baselines.spelled(baselines.fit(words, "tokens", "n", mode), 0, 400, 8).collect()))


def test_shares_of_each_model(spark):
    words = _words(spark, TOY)
    drawn = {m: [r.word for r in baselines.spelled(baselines.fit(words, "tokens", "n", m), 0, 6000, 3).collect()] for m in baselines.MODES}
    total = sum(TOY.values())

    def near(found, share):
        assert found / 6000 == pytest.approx(share, abs=4 * math.sqrt(share * (1 - share) / 6000) + 1e-9)

    skeleton = lambda w: "".join("V" if p in VOWELS else "C" for p in w)
    seen = Counter()
    for w, n in TOY.items():
        seen[skeleton(split(w))] += n
    # a sound of two letters may arise from two sounds, so skeletons are those of the letters' sounds without ts
    plain = [w for w in drawn["cv"] if "ts" not in w]
    assert {skeleton(split(w)) for w in plain} <= set(seen)
    near(sum(w in ("a", "e", "i") for w in drawn["cv"]), 4 / total)
    first = Counter()
    for w, n in TOY.items():
        first[split(w)[0]] += n
    near(sum(w[0] == "m" for w in drawn["positional"]), first["m"] / total)
    near(sum(w.startswith("p") for w in drawn["positional"]), first["p"] / total)
    sounds = Counter()
    for w, n in TOY.items():
        for p in split(w):
            sounds[p] += n
    near(sum(w.startswith("p") for w in drawn["unigram"]), sounds["p"] / sum(sounds.values()))


@pytest.mark.parametrize("accept", baselines.ACCEPT)
def test_rejection_keeps_the_first_accepted_tries(spark, accept):
    model = baselines.fit(_words(spark, TOY), "tokens", "n", "unigram")
    tries = sorted(map(tuple, baselines.spelled(model, 0, 2000, 1).collect()))

    def good(word):
        found, notes, _ = syllabify(word)
        return accept == "any" or found is not None and (accept == "divided" or not notes)

    expected = [x for x in tries if good(x[1])][:150]
    assert len(expected) == 150
    assert sorted(map(tuple, baselines.sample(model, 150, 1, accept).collect())) == expected


def test_tries_end(spark):
    model = baselines.fit(_words(spark, {"ktk": 2, "p": 1}), "tokens", "n", "cv")
    assert baselines.sample(model, 3, accept="divided").count() == 0
    assert baselines.sample(model, 3).count() == 3
    empty = baselines.fit(_words(spark, {"pata": 1}).limit(0), "tokens", "n")
    assert baselines.sample(empty, 5).count() == 0
    for bad in (lambda: baselines.fit(_words(spark, TOY), "tokens", "n", "x"), lambda: baselines.sample(model, 1, accept="x")):
        with pytest.raises(ValueError):
            bad()


def test_gain_on_top_of_a_grammar(spark):
    words = spark.createDataFrame([("pata", 50), ("kata", 40), ("mana", 30), ("asta", 4), ("paat", 9)], "word string, n long")
    drawn = ["pata", "asta", "akta", "kapa", "apsa", "mana", "aspta", "tata", "paa", "qaat"[1:], "tsaat", "tcka"] * 5
    samples = spark.createDataFrame([(w,) for w in drawn], "word string")
    grammar = [("vv", "*[V][V]", 0.7), ("hard", "*[Q][C]", math.inf)]
    row = constraints.evaluated(words, "word", "n", samples, "word", [("cc", "*[C][C]", 1.0)], grammar=grammar).first()

    def counts(w):
        kinds = ["V" if p in VOWELS else "C" for p in split(w)]
        pairs = [a + b for a, b in zip(kinds, kinds[1:], strict=False)]
        hard = any(CLASS_OF[a] == "Q" and b == "C" for a, b in zip(split(w), kinds[1:], strict=False))
        return pairs.count("VV"), pairs.count("CC"), hard

    lexicon = [(counts(r.word), r.n) for r in words.collect()]
    random = [counts(w) for w in drawn]
    n = sum(k for _, k in lexicon)

    def mean(x, y):
        return sum(k * (x * v + y * c) for (v, c, _), k in lexicon) / n

    def log_z(x, y, legal):
        of = [r for r in random if not (legal and r[2])]
        return math.log(sum(math.exp(-x * v - y * c) for v, c, _ in of) / len(of))

    x, y, step = 1.0, 1.0, 0.5  # coordinate search for the fit over all samples
    loss = lambda x, y: n * (mean(x, y) + log_z(x, y, False)) + 0.01 / 2 * (x * x + y * y)
    while step > 1e-6:
        better = min(((max(0, x + a), max(0, y + b)) for a in (-step, 0, step) for b in (-step, 0, step)), key=lambda p: loss(*p))
        if better == (x, y):
            step /= 2
        x, y = better
    expected = (-mean(x, y) - log_z(x, y, True)) - (-mean(0.7, 0) - log_z(0.7, 0, True))
    assert row.gain == pytest.approx(expected, abs=1e-5)


def test_evaluation_by_model_equals_a_plain_count(spark, small):
    """Every count of every candidate and model, from the words themselves."""
    words = [(r.tokens, r.n) for r in spoken(spark, small).collect()]
    rows = {(r["mode"], r["name"]): r for r in texts.constraint_evaluation_models(spark, small).collect()}
    assert len(rows) == 3 * len(constraints.candidates())
    n = sum(k for _, k in words)

    def hits(tokens, name):
        classes = [CLASS_OF[p] for p in tokens]
        at = [i for i in range(len(classes) - 1) if classes[i] + classes[i + 1] == name[:2]]
        return len([i for i in at if not name[2:] or (i == 0 if name[2] == "<" else i == len(classes) - 2)])

    for mode in baselines.MODES:
        table = spark.createDataFrame([("".join(t), t, k) for t, k in words], "word string, tokens array<string>, n long")
        drawn = [split(r.word) for r in baselines.sample(baselines.fit(table, "tokens", "n", mode), 4000, accept="divided").collect()]
        assert len(drawn) == 4000
        for name, _, _ in constraints.candidates():
            seen, random = [(hits(t, name), k) for t, k in words], [hits(t, name) for t in drawn]
            o, e = sum(v * k for v, k in seen), sum(random) / 4000 * n
            wo, we = sum(k for v, k in seen if v), sum(map(bool, random)) / 4000 * n
            r = rows[mode, name]
            assert (r.observed, r.words_seen) == (o, wo) and r.expected == pytest.approx(e) and r.words_expected == pytest.approx(we)
            assert r.log_odds == pytest.approx(math.log(((wo + 0.5) / (n - wo + 0.5)) / ((we + 0.5) / (n - we + 0.5)))) and r.oe == (pytest.approx(o / e) if e else None)
            assert r.gain >= -1e-3
    assert CONSTRAINTS[0][2] == math.inf
