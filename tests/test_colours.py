import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from seqlattice.functions import colours
from seqlattice.plans import texts

V, LETTERS = colours.COLOURS, "oaeiukfhsclmtn"


def _parts(word):
    """Vowels, and the two flags of each wall."""
    found, walls, run = [], [], ""
    for c in word + "o":
        if c in V:
            walls.append([all(x in p for x in run) for p in colours.PASSES])
            found.append(c)
            run = ""
        else:
            run += c
    return found[:-1], walls


def _islands(n, walls, j):
    out = []
    for i in range(n):
        if i and walls[i][j]:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def _settled(word, bg):
    found, walls = _parts(word)
    new = [list(V[v]) for v in found]
    for j in (0, 1):
        for isle in _islands(len(found), walls, j):
            outside = isle[0] == 0 and walls[0][j] or isle[-1] == len(found) - 1 and walls[-1][j]
            for i in isle:
                new[i][j] = bg[j] if outside else sum(V[found[k]][j] for k in isle) / len(isle)
    return [V[v] for v in found], new


def _harmony(word, k, dominant):
    found, walls = _parts(word)
    n = len(found)
    root = set(range(k))
    sources = set(range(n)) - root if dominant else root
    out = []
    for i in range(n):
        if i in sources:
            out.append(found[i])
            continue
        own, now = V[found[i]], list(V[found[i]])
        for j in (0, 1):
            isle = next(x for x in _islands(n, walls, j) if i in x)
            near = sorted((abs(i - s), s not in root, s) for s in isle if s in sources)
            if near:
                now[j] = V[found[near[0][2]]][j]
        order = list(V)
        best = min(order, key=lambda v: (round(math.dist(V[v], now), 9), any(now[j] != own[j] and V[v][j] != now[j] for j in (0, 1)), sum((a - b) ** 2 for a, b in zip(V[v], own)), order.index(v)))
        out.append(best)
    it = iter(out)
    return "".join(next(it) if c in V else c for c in word)


def _words():
    rng = random.Random(4)
    return ["", "k", "a", "melon", "kakin", "kikikiki", "kanomel", "meloma"] + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 11))) for _ in range(150)]


def test_colours_settle_and_move(spark):
    rows = spark.createDataFrame([(w,) for w in _words()], "w string")
    isles = [colours.islands(F.col("w"), j) for j in (0, 1)]
    found = rows.select("w", colours.good_backgrounds(isles).alias("good"), *(colours.transport(isles, bg).alias(f"t{i}") for i, bg in enumerate([(0.5, 0.0), (1.0, 1.0)])), colours.repeats(F.col("w")).alias("ocp"), colours.dispersion(F.col("w")).alias("d"))
    for r in found.collect():
        good = []
        for i, bg in enumerate(colours.BACKGROUNDS):
            _, new = _settled(r.w, bg)
            if all(abs(a - b) < 1e-9 for x in new for a, b in zip(x, new[0], strict=True)):
                good.append(i)
        assert r.good == good, r.w
        for i, bg in enumerate([(0.5, 0.0), (1.0, 1.0)]):
            before, new = _settled(r.w, bg)
            assert r[f"t{i}"] == pytest.approx(sum(abs(a - b) for x, y in zip(before, new, strict=True) for a, b in zip(x, y, strict=True)))
        mine = _parts(r.w)[0]
        assert r.ocp == sum(a == b for a, b in itertools.pairwise(mine))
        assert r.d == (pytest.approx(min(math.dist(V[a], V[b]) for a, b in itertools.combinations(mine, 2))) if len(mine) > 1 else None)


def test_harmony(spark):
    rng = random.Random(7)
    rows = spark.createDataFrame([(w, rng.randint(0, 4)) for w in _words()], "w string, k int")
    for r in rows.select("w", "k", colours.harmony(F.col("w"), F.col("k")).alias("root"), colours.harmony(F.col("w"), F.col("k"), True).alias("suffix")).collect():
        assert (r.root, r.suffix) == (_harmony(r.w, r.k, False), _harmony(r.w, r.k, True)), r
    golden = spark.createDataFrame([("kanomel", 2), ("meloma", 2)], "w string, k int").select(colours.harmony(F.col("w"), F.col("k")).alias("a"), colours.harmony(F.col("w"), F.col("k"), True).alias("b")).collect()
    # m stops the first component: e takes 0 from o and is i; before a dominant a, o takes 1 and is a, and e at (0, 1) is nearest to u
    assert golden[0].a == "kanomil" and golden[1].b == "mulama"


def test_sources_on_both_sides(spark):
    """The nearest source wins, of two as near that of the root."""
    row = spark.createDataFrame([("alilo",), ("olila",)], "w string")
    for flags in itertools.product((False, True), repeat=2):
        root = F.array(F.lit(flags[0]), F.lit(False), F.lit(flags[1]))
        got = [r.h for r in row.select(colours.harmonised(F.col("w"), F.array(F.lit(True), F.lit(False), F.lit(True)), root).alias("h")).collect()]
        second = flags == (False, True)
        assert got == [["a", "o" if second else "a", "o"], ["o", "a" if second else "o", "a"]]


def test_queries_equal_a_plain_count(spark, small):
    found = texts.colour_report(spark, small).collect()
    assert len(found) > 10
    for r in found:
        good = [i for i, bg in enumerate(colours.BACKGROUNDS) if (lambda new: all(abs(a - b) < 1e-9 for x in new for a, b in zip(x, new[0], strict=True)))(_settled(r.word, bg)[1])]
        k = (len(_parts(r.word)[0]) + 1) // 2
        assert (r.n_good, r.by_root, r.by_suffix) == (len(good), _harmony(r.word, k, False), _harmony(r.word, k, True))
