"""Bands of the quality rules, recomputed one document after the other."""

import math
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seqlattice.llm import quality_rules

LEAST = 10


def _bin(x):
    return round(math.log1p(x) * quality_rules.BINS)


def _median(values):
    return math.expm1(statistics.median_low(sorted(map(_bin, values))) / quality_rules.BINS)


def _bands(rows, value, group, scale):
    """class -> (level, low, high, away) of one figure, plainly; ``group`` gives a row's language and what it shares."""
    own, shared = defaultdict(list), defaultdict(list)
    for r in rows:
        own[group(r)].append(r)
        shared[group(r)[1:]].append(r)
    mids = {k: _median([value(r) for r in v]) for k, v in own.items() if len(v) >= LEAST}

    def away(of, mid):
        return _median([abs(value(r) - mid) * scale(r) for r in of])

    out = {}
    for k, v in own.items():
        others = [m for m in mids if m[1:] == k[1:]]
        if k in mids:
            out[k] = ("own", mids[k], mids[k], away(v, mids[k]))
        elif others:
            out[k] = ("script", min(mids[m] for m in others), max(mids[m] for m in others), max(away(own[m], mids[m]) for m in others))
        else:
            mid = _median([value(r) for r in shared[k[1:]]])
            out[k] = ("pooled", mid, mid, away(shared[k[1:]], mid))
    return out


@pytest.fixture(scope="module")
def measured(spark):
    rng = random.Random(7)
    rows = []
    for i in range(260):
        lang = rng.choice(["en"] * 8 + ["de"] * 5 + ["xx", None, "zh", "ja"])
        script = "han" if lang in ("zh", "ja") else "latin"
        n = rng.choice([60, 90, 200, 300, 5000])
        rows.append((i, str(i), lang, n, 300 if i % 31 else 5, 0, n, 4.0 + rng.random(), 0.02 * rng.random(), 0.6 + 0.2 * rng.random(), script))
    return spark.createDataFrame(rows, "doc_id long, tx string, lang string, n_tokens long, n_words long, n_repeat_words long, word_chars long, chars_per_token double, byte_share double, token_entropy double, script string")


def test_bands_equal_plain_ones(measured):
    with_size = measured.withColumns({"size_class": F.floor(F.log2("n_tokens")).cast("int"), "base_failed": quality_rules.base_failed()})
    steady = with_size.filter("not base_failed")
    rows = steady.collect()
    got = {(r.lang, r.script, r["size"], r.figure): r for r in quality_rules.bands_of(steady, LEAST).collect()}
    fixed = lambda r: (r.lang, r.script, quality_rules.ANY_SIZE)
    plain = {
        "chars_per_token": _bands(rows, lambda r: r.chars_per_token, fixed, lambda r: math.sqrt(r.n_tokens)),
        "byte_share": _bands(rows, lambda r: r.byte_share, fixed, lambda r: 1),
        "token_entropy": _bands(rows, lambda r: r.token_entropy, lambda r: (r.lang, r.script, r.size_class), lambda r: 1),
    }
    assert {(*k, f) for f, of in plain.items() for k in of} == set(got)
    levels = set()
    for figure, of in plain.items():
        for k, (level, low, high, away) in of.items():
            r = got[*k, figure]
            assert (r.level, r.low, r.high) == (level, pytest.approx(low), pytest.approx(high))
            assert figure == "byte_share" or r.away == pytest.approx(away)
            levels.add(level)
    assert levels == {"own", "script", "pooled"}


def test_rare_languages_are_no_way_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("bcdfghjkqvwxz") for _ in range(rng.randint(3, 9))) for _ in range(300))
    clean = docs.filter("lang = 'en'").join(spark.read.parquet(f"{small}/labels.parquet").filter("quality = 1"), "doc_id").filter("length(text) > 600").orderBy("doc_id").first().text
    odd = spark.createDataFrame([(10**9 + i, t, lang) for i, (t, lang) in enumerate((t, lang) for t in (noise, clean) for lang in ("en", "xx", None))], "doc_id long, text string, lang string")
    judged = {r.doc_id - 10**9: r for r in quality_rules.quality_rules(docs.unionByName(odd)).filter("doc_id >= 1000000000").collect()}
    assert not any(r.base_failed for r in judged.values())
    assert [judged[i].kept for i in range(6)] == [False] * 3 + [True] * 3


def test_lone_documents_and_none(spark):
    one = spark.createDataFrame([(1, "some plain words that stand here alone " * 1 + " ".join(f"word{i}" for i in range(40)), None)], "doc_id long, text string, lang string")
    assert [r.kept for r in quality_rules.quality_rules(one).collect()] == [True]
    assert quality_rules.quality_rules(one.limit(0)).count() == 0
