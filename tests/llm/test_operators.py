import os
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.llm import decontaminate, html_extract, license_scan, line_dedup, minhash, quality_rules, segmentation, substring_dedup, suffix_dedup, token_counts
from seqlattice.llm.common import LOWER, WordHashes, components, materialize, tokenizer_path
from seqlattice.sources.storage import shared_dir

SCHEMA = "doc_id long, text string, n_lines string, lang string"
LONG = "one very long line that several documents hold in common"


def _docs(spark, *texts, ids=None):
    """Documents with a column whose name clashes with results."""
    return spark.createDataFrame([(i, t, "x", "en") for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


EDGE = [None, "", " ", "\n\n", "word", "a\x85b é ñ", "same text " * 30, "same text " * 30, "x" * 5000]


def _all_operators(docs, benchmark):
    return {
        "lines": lambda: line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs)),
        "passages": lambda: substring_dedup.substring_dedup(docs),
        "quality": lambda: quality_rules.quality_rules(docs),
        "tokens": lambda: token_counts.token_counts(docs),
        "leaks": lambda: decontaminate.decontaminate(docs, benchmark),
        "pieces": lambda: segmentation.encode(docs),
        "suffixes": lambda: suffix_dedup.suffix_dedup(docs),
        "near": lambda: minhash.minhash_dedup(docs),
        "licences": lambda: license_scan.license_scan(docs),
    }


@pytest.mark.parametrize("name", ["lines", "passages", "quality", "tokens", "leaks", "pieces", "suffixes", "near", "licences"])
def test_nulls_ties_empty_and_repeated_rows(spark, name):
    long = " ".join(f"word{i * i % 40009}" for i in range(60_000))
    rows = _docs(spark, *EDGE, long).unionByName(_docs(spark, "word", None, ids=[4, None]))
    rows = rows.withColumns({c: F.lit(1) for c in ("raw", "h", "t1", "t2", "key", "rep", "root", "tx", "doc", "row", "n_words", "script", "__lines", "a", "b")})
    benchmark = spark.createDataFrame([(1, "same text same text"), (None, "word"), (3, None)], "item_id long, text string")
    out = _all_operators(rows, benchmark)[name]()
    n = len(out.collect())
    assert n == rows.count() if name != "passages" else n >= 1
    empty = _all_operators(rows.limit(0), benchmark)[name]()
    assert out.columns == empty.columns and empty.count() == 0
    if name == "leaks":
        assert decontaminate.decontaminate(rows, benchmark.limit(0)).filter(F.col("__n_hit") > 0).count() == 0


def test_lines_stay_in_the_largest_document(spark):
    docs = _docs(spark, f"{LONG}\nfirst", f"  {LONG.upper()}  \nsecond\n{LONG}", f"x\n{LONG}\n{LONG}", f"{LONG[:20]}\nshort")
    out = {r.doc_id: r["__lines"] for r in line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs)).collect()}
    assert out[0].text == "first" and out[1].text == "second" and out[1].n_dropped == 2
    assert out[2].n_dropped == 0 and out[3].n_dropped == 0


def test_a_key_across_ranges_is_settled_once():
    """The streamed part, cut at any place, gives what a plain count gives."""
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted(((rng.randint(0, 3), 0, -rng.randint(0, 6), 0, p) for p in range(60)))
    rows = [(a, b, -c, d, p) for a, b, c, d, p in rows]
    holders = {}
    for k, _, doc, _, _ in rows:
        holders.setdefault(k, set()).add(doc)
    expected = {(doc, p) for k, _, doc, _, p in rows if len(holders[k]) >= 3 and doc != max(holders[k])}
    for cut in range(0, 61, 7):
        # a range boundary never divides one document's rows of a key
        while 0 < cut < 60 and rows[cut][:3] == rows[cut - 1][:3]:
            cut += 1
        drops, open_, sums = set(), [], {}
        for part in (rows[:cut], rows[cut:]):
            batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in part[j : j + 5]], pa.int64()) for i in range(5)], names=list("abcde")) for j in range(0, len(part), 5)]
            for out in line_dedup._settle(iter(batches), 3):
                for kind, h1, h2, doc, _, pos in zip(*(c.to_pylist() for c in out.columns), strict=True):
                    if kind == line_dedup._DROP:
                        drops.add((doc, pos))
                    elif kind == line_dedup._OPEN:
                        open_.append((h1, h2, doc, pos))
                    else:
                        n, top = sums.get((h1, h2), (0, doc))
                        sums[h1, h2] = (n + pos, max(top, doc))
        drops |= {(doc, pos) for h1, h2, doc, pos in open_ if sums[h1, h2][0] >= 3 and doc != sums[h1, h2][1]}
        assert drops == expected, cut


def test_bitmaps_round_trip():
    for at in ([0], [3, 17], [7, 8, 15], list(range(40))):
        keep = line_dedup.unpack_bitmap(line_dedup.pack_bitmap(at), 50)
        assert np.flatnonzero(~keep).tolist() == at


def test_suffix_arrays_equal_sorting():
    rng = random.Random(5)
    for _ in range(60):
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 60))) for _ in range(4)]
        length = rng.choice([3, 5, 9, 17])
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for t, hit in zip(texts, suffix_dedup.repeated_windows(texts, length), strict=True):
            assert hit.tolist() == [seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)]


def test_periodic_and_shared_text_is_removed(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    unique = [" ".join(word() for _ in range(80)) for _ in range(4)]
    shared = " ".join(word() for _ in range(60))
    texts = [unique[0] + shared + unique[1], shared[:300] + unique[2], "ab" * 400, unique[3], unique[3]]
    out = {r.doc_id: r for r in suffix_dedup.suffix_dedup(_docs(spark, *texts)).collect()}
    windows = Counter(t.encode()[i : i + 200] for t in texts for i in range(len(t) - 199))
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if windows[t.encode()[p : p + 200]] > 1:
                gone[p : p + 200] = True
        assert out[i].n_removed == gone.sum(), i


def test_large_groups_are_dealt_out_by_windows(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(50))
    texts = [" ".join(word() for _ in range(40)) + passage[rng.randint(0, 60) :] + " ".join(word() for _ in range(40)) for _ in range(12)]
    rows = lambda: sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(_docs(spark, *texts).repartition(3)).collect())
    whole = rows()
    assert sum(r[1] for r in whole) > 0
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    assert rows() == whole


def test_streamed_stretches_are_let_go_in_parts(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted({(rng.randint(0, 2), rng.randint(0, 4), rng.randint(0, 9), 0, rng.randint(0, 9), 5, 0) for _ in range(120)})

    def run(held, size):
        monkeypatch.setattr(suffix_dedup, "HELD", held)
        batches = (pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[j : j + size]], pa.int64()) for i in range(7)], names=list("abcdefg")) for j in range(0, len(rows), size))
        whole, asked = set(), set()
        for out in suffix_dedup._meet(batches):
            for kind, mh, sw, t1, _, start, _, _ in zip(*(c.to_pylist() for c in out.columns), strict=True):
                (whole if kind == suffix_dedup._WHOLE else asked).add((mh, sw, t1, start) if kind == suffix_dedup._WHOLE else (mh, sw))
        return whole, asked

    whole, asked = run(10**6, 7)
    for held, size in ((1, 5), (10, 7), (30, 11)):
        parts, more = run(held, size)
        assert parts == whole and asked <= more


def test_stretches_hold_every_window_once():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab \n") for _ in range(n)) for n in (200, 350, 900)] + [b"a" * 700]
    doc, start, n, mh, _, _ = suffix_dedup.stretches(texts)
    covered = Counter((int(d), int(s) + i) for d, s, k in zip(doc, start, n, strict=True) for i in range(k))
    assert covered == Counter({(d, i): 1 for d, t in enumerate(texts) for i in range(len(t) - 199)})
    by_window = {}
    for d, s, k, m in zip(doc, start, n, mh, strict=True):
        for i in range(k):
            window = texts[d][s + i : s + i + 200]
            assert by_window.setdefault(window, m) == m


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(120)] for _ in range(4)]
    texts = []
    for b in base:
        for edits in (0, 0, 1, 2, 3, 4, 6, 9):
            words = list(b)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"e{rng.random()}"
            texts.append(" ".join(words))
    texts += ["a b c", "A b c", "a b d", "", None]
    sets = [set(minhash.shingles((t or "").encode(), WordHashes()).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and _jaccard(sets[i], sets[j]) >= 0.85:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    out = {r.doc_id: r.component_id for r in minhash.minhash_dedup(_docs(spark, *texts)).collect()}
    assert [out[i] for i in range(len(texts))] == root


def test_pairs_of_any_size_meet():
    """Sets on both sides of any size share two collections as often as their similarity says."""
    rng = np.random.default_rng(11)
    for n in (8, 40, 62, 63, 64, 80, 300):
        missed = 0
        for _ in range(300):
            whole = np.unique(rng.integers(1, 1 << 63, n, np.uint64))
            other = np.append(whole[: n - max(1, n // 16)], rng.integers(1, 1 << 63, max(1, n // 16), np.uint64))
            missed += int((minhash.half_keys(whole) == minhash.half_keys(other)).sum() < 2)
        assert missed <= 1, n
    whole = np.unique(rng.integers(1, 1 << 63, 64, np.uint64))
    assert (minhash.half_keys(whole) == minhash.half_keys(whole[:63])).sum() >= 2


def test_all_pairs_of_middle_sizes(spark):
    rng = random.Random(41)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(44, 94))]
        texts += [" ".join(words), " ".join(words[:-1]), " ".join([*words, *(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 9)))])]
    sets = [set(minhash.shingles(t.encode(), WordHashes()).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _jaccard(sets[i], sets[j]) >= 0.85:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    out = {r.doc_id: r.component_id for r in minhash.minhash_dedup(_docs(spark, *texts)).collect()}
    assert [out[i] for i in range(len(texts))] == root


def test_groups_are_gone_through_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(40):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(100)] = f"e{rng.random()}"
        texts.append(" ".join(words))
    whole = sorted((r.doc_id, r.component_id) for r in minhash.minhash_dedup(_docs(spark, *texts)).collect())
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert sorted((r.doc_id, r.component_id) for r in minhash.minhash_dedup(_docs(spark, *texts)).collect()) == whole


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_decontamination_in_blocks(spark, monkeypatch):
    docs = _docs(spark, "the quick brown fox jumps over the lazy dog and then it sleeps", "short item here", "nothing to see")
    items = spark.createDataFrame([(1, "The QUICK brown fox, jumps over the lazy dog and"), (2, "short item"), (3, "absent words only")], "item_id long, text string")
    one = decontaminate.decontaminate(docs, items)
    many = decontaminate.decontaminate(docs, items, block_words=1)
    monkeypatch.setattr(decontaminate, "STEP_BLOCKS", 2)
    steps = decontaminate.decontaminate(docs, items, block_words=1)
    for out in (one, many, steps):
        rows = {r.doc_id: r for r in out.collect()}
        assert [rows[i]["__n_hit"] for i in range(3)] == [10, 2, 0]
        assert {m.item_id for m in rows[0]["__matches"]} == {"1"} and rows[1]["__matches"][0].doc_start == 0
        assert rows[0]["n_lines"] == "x"


def test_longest_matches_are_whole():
    item = [f"w{i}" for i in range(40)]
    items = decontaminate.Items([("a", " ".join(item).encode())])
    hits, found = items.search([[b"x", *(w.encode() for w in item[5:30]), b"y"]])[0]
    assert hits.tolist() == list(range(1, 26))
    assert found == [{"item_id": "a", "item_start": 5, "doc_start": 1, "n_words": 25}]


def test_suffix_search_equals_plain_windows():
    rng = random.Random(17)
    for size in (1, 3, 10):
        words = [f"w{i}" for i in range(4)]
        items = [(str(i), [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 12, 40]))]) for i in range(12)]
        texts = [[rng.choice([*words, "other"]) for _ in range(rng.randint(0, 120))] for _ in range(15)]
        got = decontaminate.Items([(i, " ".join(ws).encode()) for i, ws in items], size).search([[w.encode() for w in t] for t in texts])
        for t, (hits, found) in zip(texts, got, strict=True):
            expected, names = set(), set()
            for i, ws in items:
                n = min(size, len(ws))
                windows = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
                at = [p for p in range(len(t) - n + 1) if tuple(t[p : p + n]) in windows]
                expected |= {p + k for p in at for k in range(n)}
                names |= {i} if at else set()
            assert set(hits.tolist()) == expected and {m["item_id"] for m in found} == names
            of = dict(items)
            for m in found:
                a, b, n = m["item_start"], m["doc_start"], m["n_words"]
                assert of[m["item_id"]][a : a + n] == t[b : b + n]
                before, after = (of[m["item_id"]][a - 1], t[b - 1]) if a and b else (0, 1), (of[m["item_id"]][a + n : a + n + 1], t[b + n : b + n + 1])
                if len(of[m["item_id"]]) >= size:
                    assert before[0] != before[1] and (after[0] != after[1] or not after[0])


def test_a_long_item_takes_little_memory():
    import tracemalloc

    rng = random.Random(18)
    item = " ".join(f"w{rng.randint(0, 10**5)}" for _ in range(20_000)).encode()
    tracemalloc.start()
    items = decontaminate.Items([("a", item)])
    hits, found = items.search([item.split()[100:15_000]])[0]
    assert len(hits) == 14_900 and [(m["item_start"], m["n_words"]) for m in found] == [(100, 14_900)]
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()


def test_chains_are_best_by_plain_recurrence():
    rng = random.Random(6)
    for _ in range(80):
        points = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(1, 25))})
        score = []
        for i, (x, y) in enumerate(points):
            score.append(max([1.0] + [score[j] + 1 - 0.02 * (x - a + y - b) for j, (a, b) in enumerate(points[:i]) if a < x and b < y]))
        best = max(score)
        first = substring_dedup.chains([p[0] for p in points], [p[1] for p in points], gap=0.02, least=1)[0]
        got = 1.0
        for i, j in zip(first, first[1:], strict=False):
            got += 1 - 0.02 * (points[j][0] - points[i][0] + points[j][1] - points[i][1])
        assert got == pytest.approx(best)


def test_fuzzy_passages(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passage = [word() for _ in range(80)]
    fuzzy = list(passage)
    fuzzy[20] = "changed"
    del fuzzy[50]
    texts = [" ".join([*(word() for _ in range(60)), *passage, *(word() for _ in range(60))]), " ".join([*(word() for _ in range(30)), *fuzzy, *(word() for _ in range(40))]), " ".join(word() for _ in range(200))]
    rows = substring_dedup.substring_dedup(_docs(spark, *texts)).collect()
    assert [(r.doc_id, r.other_doc_id, r.kind) for r in rows] == [(1, 0, "passage")]
    assert (rows[0].other_start, rows[0].other_stop, rows[0].start, rows[0].stop) == (60, 140, 30, 109)
    assert rows[0].identity == pytest.approx(78 / 80)


def _windows_in_passages(spark, texts, size=51):
    """Repeated windows of ``size`` words that lie in no passage of their document, and the rows."""
    holders = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - size + 1):
            holders.setdefault(tuple(t[p : p + size]), []).append((i, p))
    need = {x for h in holders.values() if len({i for i, _ in h}) > 1 for x in h}
    rows = substring_dedup.substring_dedup(_docs(spark, *map(" ".join, texts)).repartition(3)).collect()
    for r in rows:
        assert r.identity >= 0.8 and min(r.stop - r.start, r.other_stop - r.other_start) >= 40
        if r.identity == 1.0:
            assert texts[r.doc_id][r.start : r.stop] == texts[r.other_doc_id][r.other_start : r.other_stop]
    spans = [x for r in rows for x in ((r.doc_id, r.start, r.stop), (r.other_doc_id, r.other_start, r.other_stop))]
    assert need
    return {(i, p) for i, p in need if not any(i == d and a <= p and p + size <= b for d, a, b in spans)}, rows


def test_several_passages_in_one_pair(spark):
    rng = random.Random(31)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    for size, between in ((300, 400), (60, 60), (3000, 7000)):
        one, two = words(size), words(size)
        texts = [words(30) + one + words(between) + two + words(9), words(5) + one + words(between) + two, words(80)]
        missed, rows = _windows_in_passages(spark, texts)
        assert not missed
        assert [(r.start, r.stop) for r in sorted(rows, key=lambda r: r.start)] == [(5, 5 + size), (5 + size + between, 5 + 2 * size + between)]


def test_mosaics_and_repeats(spark):
    """Passages of pieces that other documents hold, in other orders, and twice in one text."""
    rng = random.Random(32)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage = words(60)
    pieces = [passage[i : i + rng.randint(12, 20)] for i in range(0, 48, 4)]
    texts = [p + words(40) for p in pieces] + [words(20) + passage + words(20), words(7) + passage + words(11) + passage, passage[:55] + words(3) + passage[20:]]
    tiles = [words(17) for _ in range(8)]
    texts += [sum((rng.choice(tiles) for _ in range(9)), []) + words(10) for _ in range(25)]
    missed, _ = _windows_in_passages(spark, texts)
    assert not missed


def test_recall_of_fuzzy_passages(spark):
    """Of passages of 60 words with a word in eight or a random share of words changed nearly all are found."""
    rng = random.Random(33)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    texts, pairs = [], 100
    for k in range(pairs):
        passage = words(60)
        other = list(passage)
        for i in range(k % 8, 60, 8) if k % 2 else rng.sample(range(60), 9):
            other[i] = f"e{rng.random()}"
        texts += [words(30) + passage + words(30), words(20) + other + words(25)]
    rows = substring_dedup.substring_dedup(_docs(spark, *map(" ".join, texts))).collect()
    assert all(r.doc_id == r.other_doc_id + 1 and r.other_doc_id % 2 == 0 for r in rows)
    assert len({r.doc_id for r in rows}) >= 0.9 * pairs


def test_passages_of_frequent_lines(spark):
    """Other documents are the first holders of every line; still each repeated window of 51 words lies in a passage."""
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    lines = [words(22) for _ in range(3)]
    texts = [words(50) + lines[i % 3] + words(50) for i in range(120)]
    texts += [words(40) + sum(lines, []) + words(30), words(20) + lines[1] + words(60) + sum(lines, []) + words(10)]
    holders = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - 51 + 1):
            holders.setdefault(tuple(t[p : p + 51]), []).append((i, p))
    need = {x for h in holders.values() if len({i for i, _ in h}) > 1 for x in h}
    rows = substring_dedup.substring_dedup(_docs(spark, *map(" ".join, texts)).repartition(3)).collect()
    spans = [x for r in rows for x in ((r.doc_id, r.start, r.stop), (r.other_doc_id, r.other_start, r.other_stop))]
    assert need and all(any(i == d and a <= p and p + 51 <= b for d, a, b in spans) for i, p in need)
    assert [(r.doc_id, r.other_doc_id, r.start, r.stop, r.other_start, r.other_stop) for r in rows] == [(121, 120, 102, 168, 40, 106)]


@pytest.mark.parametrize(("pairs", "holders"), [(30, 2), (8, 40)])
def test_fuzzy_passages_beside_holders_of_their_lines(spark, pairs, holders):
    """Other documents hold the lines of a passage; still the two texts that share it, with a word in eight changed, are linked."""
    rng = random.Random(34)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    shared, lines = [], []
    for _ in range(pairs):
        passage = words(96)
        other = list(passage)
        for i in range(3, 96, 8):
            other[i] = f"e{rng.random()}"
        shared += [words(30) + passage + words(30), words(20) + other + words(25)]
        lines += [words(20) + passage[i : i + 24] + words(20) for i in range(0, 96, 24) for _ in range(holders)]
    texts = lines + shared
    rng.shuffle(lines)
    rows = substring_dedup.substring_dedup(_docs(spark, *map(" ".join, texts)).repartition(3)).collect()
    found = {(r.other_doc_id - len(lines), r.doc_id - len(lines)) for r in rows}
    assert {(2 * k, 2 * k + 1) for k in range(pairs)} == found


def test_a_chain_is_aligned_once(spark, monkeypatch):
    """What the rounds over open seeds bring together again isn't aligned again, and of both texts only the words around a chain are."""
    rng = random.Random(34)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    tiles = [words(24) for _ in range(6)]
    texts = [words(300) + tiles[i % 6] + words(300) for i in range(240)]
    texts += [words(20) + sum((rng.sample(tiles, 4)), []) + words(20) for _ in range(8)]
    aligned, plain = [], substring_dedup._aligned

    def watched(found, texts):
        aligned.append(found)
        return plain(found, texts)

    monkeypatch.setattr(substring_dedup, "_aligned", watched)
    rows = substring_dedup.substring_dedup(_docs(spark, *map(" ".join, texts)).repartition(3)).collect()
    chains = [(r.a, r.b, *r.blocks) for found in aligned for r in found.select("a", "b", "blocks").collect()]
    assert rows and len(aligned) > 2 and len(chains) == len(set(chains))


def test_used_tables_go(spark):
    """Tables that nothing reads any more are deleted while the operator runs."""
    rng = random.Random(41)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    line, passage = words(24), words(60)
    texts = [" ".join(words(80) + line + words(40)) for _ in range(40)] + [" ".join(words(20) + passage + line) for _ in range(3)]
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert {(r.doc_id, r.other_doc_id) for r in substring_dedup.substring_dedup(_docs(spark, *texts)).collect()} >= {(41, 40), (42, 40), (42, 41)}
    left = {name.rpartition("-")[0] for name in set(os.listdir(folder)) - before}
    assert "texts" in left and not left & {"seeds", "matches", "open", "windows"}


def test_shuffle_files_go_with_a_whole_table(spark):
    def shuffled():
        return {f for d, _, names in os.walk(str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0])) for f in names if f.startswith("shuffle_")}

    known = shuffled()
    some = materialize(spark.range(1000).repartition(5, "id"), "some")
    for _ in range(50):
        if not shuffled() - known:
            break
        time.sleep(0.2)
    assert not {f for f in shuffled() - known if f.endswith(".data")}
    assert some.count() == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_an_alignment_needs_only_the_words_around_its_chain():
    rng = random.Random(37)
    near = substring_dedup.REACH
    for _ in range(200):
        a = np.array([rng.randint(0, 10**6) for _ in range(900)], np.uint32)
        b = np.array([rng.randint(0, 10**6) for _ in range(900)], np.uint32)
        x, y, n = rng.randint(0, 600), rng.randint(0, 600), rng.randint(20, 280)
        b[y : y + n] = a[x : x + n]
        for k in rng.sample(range(n), n // 12):
            b[y + k] = 10**7 + k
        at = sorted(rng.sample(range(n - 5), 2))
        blocks = [x + at[0], y + at[0], at[1] - at[0] + 5]
        begin_a, begin_b = max(0, blocks[0] - near), max(0, blocks[1] - near)
        stop_a, stop_b = blocks[0] + blocks[2] + near, blocks[1] + blocks[2] + near
        assert substring_dedup.align(blocks, a[begin_a:stop_a], begin_a, b[begin_b:stop_b], begin_b) == substring_dedup.align(blocks, a, 0, b)


def test_every_pair_of_a_small_group(spark):
    """Each two of twelve texts share the passage, and each two are a row."""
    rng = random.Random(35)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage = words(70)
    texts = [words(10 + i) + passage + words(40) for i in range(12)]
    rows = substring_dedup.substring_dedup(_docs(spark, *map(" ".join, texts)).repartition(3)).collect()
    assert {(r.other_doc_id, r.doc_id) for r in rows} == {(i, j) for j in range(12) for i in range(j)}


def test_seeds_meet_whatever_the_batches():
    """Of shared seeds all places meet up to a number, all meet the first one above it; batches of any size give the same."""
    import pyarrow as pa

    rng = random.Random(36)
    rows = sorted({(rng.randint(0, 9), rng.randint(0, 12), rng.randint(0, 3)) for _ in range(160)} | {(20, 1, k) for k in range(9)})
    shared = [r for r in rows if len({t for h, t, _ in rows if h == r[0]}) > 1]
    few, sizes = 16, Counter(h for h, _, _ in shared)
    expected = Counter()
    for h in sizes:
        own = [r[1:] for r in shared if r[0] == h]
        for i, x in enumerate(own if sizes[h] <= few else own[:1]):
            expected.update((min(x, y), max(x, y)) for y in own[i + 1 :] if x[0] != y[0])
    for step in (1, 3, 7, 50, 1000):
        batches = lambda x: (pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*x[i : i + step], strict=True)], names=["h", "t", "at"]) for i in range(0, len(x), step))  # noqa: B023, E731
        kept = [r for b in substring_dedup._shared(batches(sorted(rows * 2))) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert kept == shared
        met = [r for b in substring_dedup._met(batches(kept), few) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert Counter(((a, x), (b, y)) for _, a, x, b, y in met if a is not None) == expected
        assert sorted((h, t, at) for h, a, _, t, at in met if a is None) == [r for r in shared if sizes[r[0]] > few]


def test_every_segmentation_is_drawn_once():
    vocab = segmentation.vocabulary(tokenizer_path(segmentation.MODEL))
    found = segmentation.sample([b"of the"], np.array([5], np.uint64), vocab, 100)[0]
    ids = {tuple(f[0].tolist()) for f in found}
    assert len(ids) == len(found) == 32
    assert np.exp([f[1] for f in found]).sum() == pytest.approx(1.0)
    assert all(vocab.decode(f[0]) == b"of the" for f in found)
    assert all(f[3] == 0.0 for f in found)
    assert all(a[2] >= b[2] for a, b in zip(found, found[1:], strict=False))


def test_long_words_are_cut_where_no_piece_crosses():
    vocab = segmentation.vocabulary(tokenizer_path(segmentation.MODEL))
    whole = ("international" * 30).encode()
    parts = segmentation.words_of(whole, vocab)
    assert b"".join(parts) == b" " + whole
    places = np.cumsum([len(p) for p in parts])[:-1].tolist()
    for text, cuts in ((b" " + whole, places), (b" " + "\ue000".encode() * 200, None)):
        if cuts is None:
            parts = segmentation.words_of(text[1:], vocab)
            cuts = np.cumsum([len(p) for p in parts])[:-1].tolist()
            assert cuts and b"".join(parts) == text
        for p in set(vocab.pieces):
            at = text.find(p) if len(p) > 1 else -1
            while at >= 0:
                assert not any(at < c < at + len(p) for c in cuts)
                at = text.find(p, at + 1)
    long = segmentation.sample([b"the" * 30000], np.array([1], np.uint64), vocab, 2)[0]
    assert len(long) == 2 and all(vocab.decode(f[0]) == b"the" * 30000 for f in long)


def test_draws_follow_their_probabilities():
    vocab = segmentation.vocabulary(tokenizer_path(segmentation.MODEL))
    every = {tuple(f[0].tolist()): np.exp(f[1]) for f in segmentation.sample([b"the"], np.array([1], np.uint64), vocab, 50)[0]}
    seeds = np.random.default_rng(3).integers(0, 1 << 63, 6000).astype(np.uint64)
    drawn = segmentation.sample([b"the"] * 6000, seeds, vocab, 2)
    first, second = (Counter(tuple(d[i][0].tolist()) for d in drawn) for i in (0, 1))
    for ids, p in every.items():
        assert first[ids] / 6000 == pytest.approx(p, abs=0.02)
        after = sum(q * p / (1 - q) for other, q in every.items() if other != ids)
        assert second[ids] / 6000 == pytest.approx(after, abs=0.02)


@pytest.mark.parametrize("text", ["plain text", "  two  spaces ", "line\nline", "ünïcödé 漢字 \U0001f9ff", "x" * 900, "\x00\x7f▁"])
def test_round_trip(spark, text):
    docs = _docs(spark, text)
    row = segmentation.encode(docs).select(F.explode("samples").alias("s")).select(segmentation.decode(F.col("s.ids")).alias("t"), "s.decoded").first()
    assert row.t == text and row.decoded


def test_a_batch_is_segmented_in_little_memory():
    """What is held beside a batch doesn't grow with it, and the samples don't depend on how it is cut."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(37)
    texts = [" ".join(rng.choice(["some", "words", "cut", f"w{rng.randint(0, 10**6)}"]) for _ in range(1200)).encode() for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(range(600), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "seed", "raw"])
    path = tokenizer_path(segmentation.MODEL)
    vocab = segmentation.vocabulary(path)
    tracemalloc.start()
    rows = [r for b in segmentation._encode(iter([batch]), path, 2, False) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["doc_id"] for r in rows] == list(range(600)) and [r["n_bytes"] for r in rows] == [len(t) for t in texts]
    assert [[s["log_prob"] for s in r["samples"]] for r in rows[-3:]] == [[f[1] for f in found] for found in segmentation.sample(texts[-3:], np.arange(597, 600, dtype=np.uint64), vocab)]
    assert peak < 110_000_000


def test_samples_depend_on_the_key_only(spark):
    docs = _docs(spark, *["some words to be cut into pieces"] * 6)
    a = sorted((r.doc_id, str(r.samples)) for r in segmentation.encode(docs.repartition(5)).collect())
    b = sorted((r.doc_id, str(r.samples)) for r in segmentation.encode(docs.coalesce(1)).collect())
    assert a == b and len({x for _, x in a}) > 1


def test_special_strings_and_unicode_tokens(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(token_counts.VOCABULARY))
    texts = ["<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "don't  I'LL x y", "é ́e", "12 345 ٠", "ab " * 300]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(_docs(spark, *texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


PAGES = {
    "menus": ('<body><nav><a href=x>Home</a></nav><div class="content"><h1>Title</h1><p>A sentence stands here. It is long.</p><div class="ad">Buy now. Cheap.</div></div><div class="sidebar"><p>Other things to read. See more.</p></div></body>', "Title A sentence stands here. It is long."),
    "article": ('<article><header>top</header><h1>T</h1><p>A</p><p>B <b>b</b>.<p>C<form>Sign up<button>go</button></form><section class="comments"><p>Nice one. Great.</p></section></article><footer>end</footer>', "T A B b. C"),
    "references": ("<article><p>x &amp; y\n\t&lt;z&gt;</p><!-- no --><script>var a='</p>'</script></article>", "x & y <z>"),
    "empty": ("", ""),
    "unclosed": ("<article><p><b>One.<br><p>Two", "One. Two"),
}


@pytest.fixture(scope="module")
def weights(small):
    import pyarrow.parquet as pq

    return html_extract.fit([html_extract.parse(p) for p in pq.read_table(f"{small}/pages.parquet")["html"].to_pylist() if p])


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages(weights, name):
    page = html_extract.parse(PAGES[name][0])
    content = html_extract.Forest([page]).marginals(*weights)[0] > 0.5
    assert html_extract.text_of(page, content) == PAGES[name][1]


def _main_text(page, weights):
    parsed = html_extract.parse(page)
    return html_extract.text_of(parsed, html_extract.Forest([parsed]).marginals(*weights)[0] > 0.5)


@pytest.mark.parametrize(("inside", "left"), [
    ("one <!--> two", "one two"), ("one <!---> two", "one two"), ("one <!-- a > b --> two", "one two"), ("one <!-- a --!> two", "one two"), ("one <!-- <p> --> two <!---->three", "one two three"),
    ("one <!x> two <?php 1 ?> three", "one two three"), ("one <!-- a -- > b", "one"), ("one <!--", "one"), ("one <!-- a --!> two --> three", "one two --> three"),
])
def test_comments_end_as_in_browsers(inside, left):
    page = html_extract.parse(f"<div>{inside}")
    assert " ".join(" ".join(t for _, t in page.pieces).split()) == left


def test_broken_quotes_and_deep_nesting(weights):
    page = '<article><p>One.</p><p>Two. </p><p title="x>Broken quote here. It goes on.</p><p>After all. Yes.</p></article>'
    assert _main_text(page, weights) == "One. Two. Broken quote here. It goes on. After all. Yes."
    assert _main_text('<article><p title="a>b">One. Two.</p></article>', weights) == "One. Two."
    for depth in (100, 300, 3000):
        page = "<article>" + "<div>" * depth + "<p>Deep text here. It is.</p>" + "</div>" * depth + "<p>Next one. Yes.</p></article><footer>end</footer>"
        assert _main_text(page, weights) == "Deep text here. It is. Next one. Yes."


@pytest.mark.parametrize("part", ["<a '", "<a =", '<a ="', '="><a "', "<", "<div>", "</p>", "<!--", "<script>", "<li>", "class= ", "&amp"])
def test_bad_pages_take_linear_time(part):
    import time

    begin = time.perf_counter()
    html_extract.parse("<a " + part * (1_000_000 // len(part)))
    assert time.perf_counter() - begin < 5


def test_marginals_equal_enumeration(weights):
    import itertools

    page = html_extract.parse("<div><p>Some text. More.</p><ul><li><a>x</a></li></ul></div>")
    forest = html_extract.Forest([page])
    w, pair = weights
    unary = forest.x @ w
    n = len(page.parent)
    total, on = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = np.exp(sum(unary[i] * y[i] for i in range(n)) + sum(pair[forest.edge[i], y[page.parent[i]], y[i]] for i in range(1, n)))
        total += s
        on += s * np.array(y)
    assert forest.marginals(w, pair)[0] == pytest.approx(on / total)


def test_pages_with_nulls(spark):
    rows = [(1, None, "<article><p>Text.</p></article>", "x"), (1, None, "<article><p>Text.</p></article>", "x"), (2, "u", None, None), (None, "v", "", "y"), (3, "w", "<article><p>" + "Long. " * 50_000 + "</p></article>", "z")]
    rows = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.text[:5], r.n_chars) for r in html_extract.html_extract(rows).collect()) == [("", 0), ("", 0), ("Long.", 299_999), ("Text.", 5), ("Text.", 5)]
    assert html_extract.html_extract(rows.limit(0)).count() == 0


def test_partial_licence_text(spark):
    from seqlattice.llm.licenses import TEMPLATES

    words = TEMPLATES["MIT text"].split()
    words[30] = "changed"
    del words[60:62]
    text = "Some code. " + " ".join(words) + " The end."
    rows = license_scan.license_scan(_docs(spark, text, "no licence at all", "Permission is hereby granted")).collect()
    found = {r.doc_id: r.matches for r in rows}
    assert [m.license for m in found[0]] == ["MIT text"] and 0.9 < found[0][0].coverage < 1 and found[0][0].start_word == 2
    assert not found[1] and not found[2]


def test_repeated_and_adjoining_notices():
    from seqlattice.llm.common import WordHashes
    from seqlattice.llm.licenses import TEMPLATES

    index, hashes = license_scan.Index(TEMPLATES), WordHashes()
    scan = lambda text: [m["license"] for m in index.scan(hashes.of(decontaminate.words_of(text.encode())))]
    assert scan("All rights reserved. " * 200) == ["Proprietary"] * 200
    assert scan("All rights reserved by one of us. " * 50) == ["Proprietary"] * 50
    assert scan("Licensed under CC BY 4.0\n" * 100) == ["CC-BY short"] * 100
    row = "Licensed under the Apache License, Version 2.0\nLicensed under the BSD License\nLicensed under the BSD License\nLicensed under the MIT License"
    assert scan(row) == ["Apache-2.0", "BSD reference", "BSD reference", "MIT reference"]


def test_bands_reject_what_a_vocabulary_does_not_fit(spark):
    rng = random.Random(5)
    plain = [" ".join(rng.choice("the house is near a small river and people like to walk there every day".split()) for _ in range(300)) for _ in range(60)]
    odd = " ".join("".join(rng.choice("qxzjvkw#*") for _ in range(9)) for _ in range(300))
    short = " ".join(plain[0].split()[:30]), " ".join(odd.split()[:30])
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(_docs(spark, *plain, odd, *short)).collect()}
    assert not out[60] and all(out[i] for i in range(60)) and out[61] and not out[62]
    assert LOWER[65] == 97
