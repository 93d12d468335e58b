import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.operators import reports, signals
from seqlattice.sources import lexicons, sinks


def _word(i, entry, up=(), down=()):
    return {"id": i, "entry": entry, "category": "n", "translations": [], "upper_covers": list(up), "lower_covers": list(down)}


@pytest.fixture
def dictionary(tmp_path):
    words = [_word(0, "語彙", down=[1]), _word(1, "kata", [0], [2]), None, _word(3, "pako"), _word(2, "kamo", [1])]
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"words": words}), encoding="utf-8")
    return str(path)


def test_dictionary(spark, dictionary):
    assert lexicons.dictionary(spark, dictionary).count() == 4
    assert {r.word for r in lexicons.dictionary_entries(spark, dictionary).collect()} == {"kata", "kamo"}
    assert {r.word for r in lexicons.dictionary_entries(spark, dictionary, None).collect()} == {"kata", "kamo", "pako"}
    assert {r.word for r in lexicons.read(spark, dictionary).collect()} == {"kata", "kamo"}


def test_nested_dictionary(spark, tmp_path):
    path = tmp_path / "z.json"
    path.write_text(json.dumps({"words": [{"entry": {"form": "kata"}, "translations": [{"forms": ["house"]}]}, {"entry": {"form": "K-x"}, "translations": []}, None]}))
    assert [(r.word, r.gloss) for r in lexicons.read(spark, str(path)).collect()] == [("kata", "house")]


def test_accent_sheet(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("単語\t翻訳\t音節化・長短\t高低\t確信度\neto\tx\te.too|e.to\tLF|LH\t2\nkan\ty\t\tH\t1\n", encoding="utf-8")
    rows = lexicons.read(spark, str(path)).collect()
    assert [(r.word, r.accent, r.underlying, list(r.alternatives), list(r.lengthened)) for r in rows] == [("e.too", "LF", "eto", ["e.to"], [1])]


def test_lists_and_forms(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# a comment\nkata\nK1\n\npako\n")
    assert [r.word for r in lexicons.read(spark, str(tmp_path / "w.txt")).collect()] == ["kata", "pako"]
    (tmp_path / "f.csv").write_text("ID,Language_ID,Value,Segments\n1,a,x,p a + t a\n2,a,x,p a _ t a\n3,b,x,k o\n")
    assert [list(r.segments) for r in lexicons.cross_language_forms(spark, str(tmp_path / "f.csv"), "a").collect()] == [["p", "a", "t", "a"]]
    (tmp_path / "c.txt").write_text("# head\nccc\t*[C][C][C]\tsegment\n[V]#\nx\t[T] # end\n")
    assert [tuple(r) for r in lexicons.candidate_lines(spark, str(tmp_path / "c.txt")).collect()] == [("ccc", "*[C][C][C]", "segment"), ("[V]#", "[V]#", "segment"), ("x", "[T]", "segment")]
    (tmp_path / "i.txt").write_text("p a\n\nk o s\n")
    assert [list(r.segments) for r in lexicons.ipa_words(spark, str(tmp_path / "i.txt")).collect()] == [["p", "a"], ["k", "o", "s"]]


def test_rules():
    text = '[[rules]]\nname="a"\nrule="[spell=l] -> w / _ #"\n[[rules]]\nname="b"\nmap={t="d"}\ncontext="[+syl] _ [+syl]"\n[[rules]]\nname="c"\nrule="x -> y"\nenabled=false\n'
    assert lexicons.rules(text) == [("a", "[spell=l]", "w", "", "#"), ("b", "t", "d", "[+syl]", "[+syl]")]


def test_corpus_keeps_rejected_words(spark):
    out = lexicons.corpus(spark.createDataFrame([("kata",), ("xq",), ("dblomboi",)], "word string"))
    assert [r.word for r in out.words.collect()] == ["kata"]
    assert {r.word for r in out.rejected.collect()} == {"xq", "dblomboi"}


def test_intervals(spark):
    rows = spark.createDataFrame([("r", 0.5, 1.0, "a"), ("r", 1.5, 2.0, "b")], "rec string, start double, stop double, label string")
    filled = sinks.filled_intervals(rows, "rec", end=3.0).orderBy("start")
    assert [(r.start, r.stop, r.label) for r in filled.collect()] == [(0.0, 0.5, ""), (0.5, 1.0, "a"), (1.0, 1.5, ""), (1.5, 2.0, "b"), (2.0, 3.0, "")]
    assert sinks.interval_text(filled, "rec").first().text.count("intervals") == 5


def test_tsv_round_trip(spark, tmp_path):
    sinks.write_tsv(spark.createDataFrame([("a", 1)], "x string, y int"), str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).first().x == "a"
    assert "a\\_b & 1" in sinks.latex_table([["a_b", "1"]], ["x", "y"])


def test_utterances_and_pitch(spark):
    t = np.arange(0, 3, 0.01)
    loud = ((t > 0.5) & (t < 1.0)) | ((t > 1.6) & (t < 2.4))
    frames = spark.createDataFrame([("r", float(x), 60.0 if y else 10.0, float(100 * 2 ** (x / 12))) for x, y in zip(t, loud, strict=True)], "rec string, t double, v double, f0 double")
    spans = signals.utterances(frames, "rec", "t", "v").orderBy("start").collect()
    assert [(round(r.start, 1), round(r.stop, 1)) for r in spans] == [(0.5, 1.0), (1.6, 2.4)]
    intervals = spark.createDataFrame([("r", 0, 0.5, 1.0)], "rec string, syllable int, start double, stop double")
    assert signals.measured(frames, intervals, "rec", "t", "f0").first().slope == pytest.approx(1.0)


def test_split_points():
    energy = np.array([5, 5, 1, 5, 5, 5, 0, 5, 5, 5.0])
    assert signals.split_points(energy, 3, 2) == [2, 6]
    assert signals.split_points(energy, 1, 2) == []
    assert signals.monotone_alignment(np.array([[0, 9, 9], [9, 9, 0.0]])) == [(0, 0), (1, 2)]


def test_reports(spark):
    words = spark.createDataFrame([("kata", "FL"), ("kanta", "LF"), ("paklata", "LFL")], "word string, accent string")
    assert {r.scale for r in reports.accent_accuracy(words).collect()} == {"rime", "onset_sensitive"}
    report = {r.word: r for r in reports.candidate_report(spark.createDataFrame([("kato",), ("xq",)], "word string"), words).collect()}
    assert report["kato"].strict and report["kato"].neighbours == 1 and not report["xq"].spellable
    affixes = spark.createDataFrame([("os",)], "affix string")
    assert reports.affix_report(words, affixes).count() == 2
    assert {r.issue for r in reports.audit(spark.createDataFrame([("kata",), ("xq",)], "word string")).collect()} == {"none", "not spellable"}
    design = reports.stimulus_design({"onset": ["1"], "nucleus": ["1"], "coda": ["0", "1"]}, words)
    assert design.count() == 3 and reports.balance(design).agg(F.sum("n")).first()[0] == 3
    assert [r.place for r in reports.blind_order(design).orderBy("place").collect()] == [1, 2, 3]
