"""License scans: an inverted index of winnowed template fingerprints, then banded alignment of the candidates.

A fingerprint is the hash of ``GRAM`` consecutive words; of each ``WINNOW`` consecutive fingerprints of a template the
least is kept, and all of a template too short for that.  Every fingerprint of a document is looked up, hits are put
together by template and diagonal, in clusters of at most ``BAND`` diagonals, and the template is aligned with that part
of the document inside a band, again before and behind a match as far as the part goes.  Templates of few words are also
looked up by pairs of words, two of which must lie near one diagonal.  A match is reported with the share of the template's
words that are matched and its span of words in the document.

The index is broadcast; its size is that of the templates, which are a parameter of at most ``MOST_WORDS`` words.

Defined cases: null and empty texts have no matches; repeated rows are scanned each by itself; an empty table gives no
rows.  Of matches that overlap one stays: that of more matched words, then of more coverage, then by name and place.  Only
the id and text columns are read, so other columns can't clash.  A text of any length is scanned whole, in one task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, record_batch, text_bytes, window_hashes
from .decontaminate import words_of
from .licenses import TEMPLATES

GRAM, WINNOW, BAND, LEAST_COVERAGE = 3, 4, 8, 0.8
#: Templates of at most this many words are looked up by pairs of words too, two of which must lie near one diagonal.
SHORT, PAIR = 12, 2
MOST_WORDS = 1_000_000


def fingerprints(hashes: np.ndarray) -> list[tuple[int, int]]:
    """(fingerprint, place) of a template: the least, rightmost, of each window."""
    grams = window_hashes(hashes, GRAM)
    if len(grams) <= WINNOW:
        return [(int(g), i) for i, g in enumerate(grams)]
    kept = {i + WINNOW - 1 - int(np.argmin(grams[i : i + WINNOW][::-1])) for i in range(len(grams) - WINNOW + 1)}
    return [(int(grams[i]), i) for i in sorted(kept)]


class Postings:
    """An inverted index: sorted hashes of ``size`` words, each with its template and place."""

    def __init__(self, size: int, found: list[tuple[int, int, int]]):
        self.size = size
        self.grams = np.array([f[0] for f in sorted(found)], np.uint64)
        self.template = np.array([f[1] for f in sorted(found)], np.int64)
        self.place = np.array([f[2] for f in sorted(found)], np.int64)

    def hits(self, doc: np.ndarray) -> list[tuple[int, int]]:
        """(template, diagonal) of each hit, in order."""
        grams = window_hashes(doc, self.size)
        low, high = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        n = high - low
        at = np.repeat(np.arange(len(grams)), n)
        entry = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at]
        template, diagonal = self.template[entry], at - self.place[entry]
        order = np.lexsort((diagonal, template))
        return list(zip(template[order].tolist(), diagonal[order].tolist(), strict=True))


class Index:
    def __init__(self, templates: dict[str, str]):
        hashes = WordHashes()
        self.names = sorted(templates)
        self.words = [hashes.of(words_of(templates[k].encode())) for k in self.names]
        assert sum(map(len, self.words)) <= MOST_WORDS, "too many template words for a broadcast"
        self.winnowed = Postings(GRAM, [(g, t, i) for t, w in enumerate(self.words) for g, i in fingerprints(w)])
        self.pairs = Postings(PAIR, [(int(g), t, i) for t, w in enumerate(self.words) if len(w) <= SHORT for i, g in enumerate(window_hashes(w, PAIR))])

    def scan(self, doc: np.ndarray) -> list[dict]:
        places = clusters(self.winnowed.hits(doc), 1) | clusters(self.pairs.hits(doc), 2)
        found = {m for t, d in sorted(places) for m in self.aligned(doc, t, d)}
        return best_of([dict(zip(("license", "coverage", "n_matched", "start_word", "end_word"), m, strict=True)) for m in found])

    def aligned(self, doc: np.ndarray, t: int, d: int) -> Iterator[tuple]:
        """The matches of a template around a diagonal: the best, then those on either side of it."""
        words = self.words[t]
        open_ = [(max(0, d - BAND), min(len(doc), d + len(words) + 2 * BAND))]
        while open_:
            begin, end = open_.pop()
            if end - begin < LEAST_COVERAGE * len(words):
                continue
            matched, first, last = align(words, doc[begin:end], d - begin)
            if matched >= LEAST_COVERAGE * len(words):
                yield self.names[t], matched / len(words), matched, begin + first, begin + last + 1
                open_ += [(begin, begin + first), (begin + last + 1, end)]


def clusters(hits: list[tuple[int, int]], least: int) -> set[tuple[int, int]]:
    """(template, first diagonal) of the runs of at most ``BAND`` diagonals with at least ``least`` hits."""
    out, held, n = set(), (-1, 0), 0
    for t, d in hits:
        if t != held[0] or d - held[1] > BAND:
            held, n = (t, d), 0
        n += 1
        if n == least:
            out.add(held)
    return out


def best_of(found: list[dict]) -> list[dict]:
    """Of matches that overlap, those with more matched words, then more coverage, then by name."""
    kept: list[dict] = []
    starts: list[int] = []
    for m in sorted(found, key=lambda m: (-m["n_matched"], -m["coverage"], m["license"], m["start_word"])):
        at = bisect_left(starts, m["start_word"])
        if (at == 0 or kept[at - 1]["end_word"] <= m["start_word"]) and (at == len(kept) or m["end_word"] <= starts[at]):
            kept.insert(at, m)
            starts.insert(at, m["start_word"])
    return kept


def align(template: np.ndarray, part: np.ndarray, diagonal: int, band: int = 2 * BAND) -> tuple[int, int, int]:
    """(words matched, first, last matched place in ``part``) of the best alignment within the band.

    2 for a match, -1 for a word that is changed, left out or put in; the template is aligned as a whole, the ends of
    ``part`` are free.
    """
    low = [max(0, i + diagonal - band) for i in range(len(template))]
    wide = len(part)
    # of each place: (score, words matched, first matched place, last matched place)
    before = [(0, 0, -1, -1)] * (wide + 1)
    for i, word in enumerate(template.tolist()):
        now = [(-(i + 1), 0, -1, -1)] * (wide + 1)
        for j in range(low[i], min(wide, i + diagonal + band + 1)):
            a = before[j]
            if part[j] == word:
                best = (a[0] + 2, a[1] + 1, j if a[2] < 0 else a[2], j)
            else:
                best = (a[0] - 1, *a[1:])
            up, left = before[j + 1], now[j]
            if up[0] - 1 > best[0]:
                best = (up[0] - 1, *up[1:])
            if left[0] - 1 > best[0]:
                best = (left[0] - 1, *left[1:])
            now[j + 1] = best
        before = now
    _, matched, first, last = max(before, key=lambda b: (b[0], -b[3]))
    return matched, first, last


_MATCH = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int32()), ("start_word", pa.int32()), ("end_word", pa.int32())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("matches", pa.list_(_MATCH))])


def _scan(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    index, hashes = Index(shared.value), WordHashes()
    for batch in batches:
        counts, matches = [], []
        for raw in batch.column(1).to_pylist():
            doc = hashes.of(words_of(raw))
            counts.append(len(doc))
            matches.append(index.scan(doc) if len(doc) >= GRAM else [])
        yield record_batch(_OUT, batch.column(0), counts, matches)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words and the matches of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(templates or TEMPLATES)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("raw"))
    return rows.mapInArrow(partial(_scan, shared=shared), "doc_id long, n_words long, matches array<struct<license:string,coverage:double,n_matched:int,start_word:int,end_word:int>>")
