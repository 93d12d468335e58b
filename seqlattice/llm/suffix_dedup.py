"""Suffix-array dedup: bytes under any string of ``length`` bytes that also starts somewhere else go.

Equal strings of that length have the same least k-mer hash (their minimizer), so consecutive windows of one minimizer
travel together as one stretch, under that hash.  Stretches that are equal as a whole are settled by their own hashes;
of the others under a shared minimizer, the text is fetched, and each task makes suffix arrays of what it holds: the
suffixes smaller than their successors are sorted directly, the rest induced by scans over the buckets of first bytes,
and adjacent common prefixes of ``length`` bytes mark the windows that repeat.  Matches never cross documents, as no
window does.

Hot groups: a text that several rows hold is taken once in each task and is removed as a whole by its count; of equal
stretches each task sends one on.  The unequal stretches of one minimizer go to one suffix array up to ``GROUP`` of
them; of a larger group every window is dealt out by a 128-bit hash, equal ones of a task as one row.

Defined cases: a null text counts as empty; texts shorter than ``length`` stay as they are.  Rows that repeat wholly are
copies of each other like any other copies.  An empty table gives no rows.  Only the id and text columns are read, so
other columns can't clash.  A text of any length is read whole, in one task, and sent on in stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_slots, key_filter, materialize, may_hold, mix, record_batch, released, text_bytes

LENGTH, KMER = 200, 48
#: Windows of a stretch, bytes that are hashed at once, and bytes of a suffix array (a larger group is one array).
STRETCH, CHUNK, ARRAY_BYTES = 4096, 1_500_000, 1_500_000

_BYTE = np.random.default_rng(8).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SPAN = "t1 long, t2 long, start int, n int"
_STRETCH = "kind int, mh long, sw long, t1 long, t2 long, start int, n int, flags int"
_STRETCH_ARROW = pa.schema([("kind", pa.int32()), ("mh", pa.int64()), ("sw", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("flags", pa.int32())])
#: Kinds of rows: a stretch whose windows all repeat; a stretch under its minimizer; one whose text is needed.
_WHOLE, _STRETCH_ROW, _ASKED = 0, 1, 2
#: Flags of a stretch: it may repeat a window in itself; its windows are known to repeat; it is of a group beyond GROUP;
#: it is one window of such a group, by its hash; its windows are settled.
_INNER, _KNOWN, _HOT, _WINDOW, _SETTLED = 1, 2, 4, 8, 16
#: Stretches of one minimizer that one suffix array takes; of a larger group the windows are dealt out by their hashes.
GROUP = 20_000
#: Rows of one minimizer that are held while they are streamed.
HELD = 200_000


def kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` bytes (k a multiple of 16), by doubling."""
    h, width, mult = _BYTE[data], 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while width < 16:
            h = h[:-width] * mult + h[width:]
            mult, width = mult * mult + np.uint64(0x632BE59BD9B4E018), 2 * width
        out = h[: len(data) - k + 1].copy()
        for at in range(16, k, 16):
            out = out * mult + h[at : at + len(out)]
    return mix(out)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` consecutive values."""
    have = 1
    out = values
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1]) if have < width else out


def stretches(texts: list[bytes], length: int = LENGTH, k: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, minimizer, hash of the stretch, flags) of all windows of the texts, each ``length`` bytes at least."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    begins = np.cumsum(sizes) - sizes
    h = kmer_hashes(data, k)
    w = length - k + 1
    least = _sliding(h, w, np.minimum)
    most = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    anchors = np.flatnonzero(h == most[: len(h)])
    twice = np.append(h[anchors[1:]] == h[anchors[:-1]], False)
    seen = np.append(0, np.cumsum(twice))

    valid = np.zeros(len(data) + 1, np.int8)
    np.add.at(valid, begins, 1)
    np.subtract.at(valid, begins + sizes - length + 1, 1)
    at = np.flatnonzero(np.cumsum(valid)[: len(least)] > 0)
    doc = np.repeat(np.arange(len(texts)), sizes - length + 1)
    new = np.append(True, (least[at[1:]] != least[at[:-1]]) | (doc[1:] != doc[:-1]))
    run = np.flatnonzero(new)
    long_runs = np.diff(np.append(run, len(at)))
    if (long_runs > STRETCH).any():
        run = np.concatenate([np.arange(a, a + n, STRETCH) for a, n in zip(run, long_runs, strict=True)])
    n = np.diff(np.append(run, len(at)))
    first = at[run]
    inner = seen[np.maximum(np.searchsorted(anchors, first + n - 1 + w - 1, "right") - 1, 0)] - seen[np.searchsorted(anchors, first)] > 0
    inner |= n > w
    view = memoryview(joined)
    digest = xxhash.xxh3_64_intdigest
    whole = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (first + n - 1 + length).tolist(), strict=True)], np.uint64)
    return doc[run], first - begins[doc[run]], n, least[first], whole, inner.astype(np.int32) * _INNER


@released
def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The stretches of a task's texts, each text once; of equal stretches one goes on and the others are settled."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        t1, t2 = (batch.column(i).to_pylist() for i in range(2))
        texts: list[bytes] = []
        keys: list[tuple[int, int]] = []
        room = 0
        rows = zip(t1, t2, batch.column(2).to_pylist(), strict=True)
        for a, b, raw in rows:
            if len(raw) >= length and (a, b) not in seen:
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add((a, b))
                texts.append(raw)
                keys.append((a, b))
                room += len(raw)
            if room >= CHUNK:
                yield from _cut_chunk(texts, keys, length)
                texts, keys, room = [], [], 0
        if texts:
            yield from _cut_chunk(texts, keys, length)


def _cut_chunk(texts: list[bytes], keys: list[tuple[int, int]], length: int) -> Iterator[pa.RecordBatch]:
    doc, start, n, mh, sw, flags = stretches(texts, length)
    t1, t2 = np.array(keys, np.int64).T
    order = np.lexsort((sw, mh))
    doc, start, n, mh, sw, flags = (x[order] for x in (doc, start, n, mh, sw, flags))
    same = np.append((mh[1:] == mh[:-1]) & (sw[1:] == sw[:-1]) & (n[1:] == n[:-1]), False)
    again = np.append(False, same[:-1])
    known = same | again
    flags = flags | np.where(known, _KNOWN, 0).astype(np.int32)
    for kind, pick in ((_WHOLE, known), (_STRETCH_ROW, ~again)):
        if pick.any():
            yield record_batch(_STRETCH_ARROW, np.full(int(pick.sum()), kind, np.int32), mh[pick].view(np.int64), sw[pick].view(np.int64), t1[doc[pick]], t2[doc[pick]], start[pick].astype(np.int32), n[pick].astype(np.int32), flags[pick])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams stretches sorted by minimizer, hash and place: settles equal ones, asks for the text of the others.

    Held between batches are the rows of the last minimizer, up to ``HELD`` of them: of more, what lies before the last
    hash is let go as rows of a group of many, and rows of one hash become one.
    """
    held, many = np.empty((7, 0), np.int64), None
    for batch in batches:
        now = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(7)])
        rows = np.concatenate([held, now], axis=1)
        if not rows.shape[1]:
            continue
        others = np.flatnonzero(rows[0] != rows[0, -1])
        last = int(others[-1]) + 1 if len(others) else 0
        held = rows[:, last:]
        yield from _meet_rows(rows[:, :last], many)
        if held.shape[1] > HELD:
            held = held[:, np.append(True, (held[:6, 1:] != held[:6, :-1]).any(axis=0))]
            others = np.flatnonzero((held[1] != held[1, -1]) | (held[5] != held[5, -1]))
            if len(others):
                many = held[0, -1]
                yield from _meet_rows(held[:, : others[-1] + 1], many)
                held = held[:, others[-1] + 1 :]
            if held.shape[1] > 1:
                open_ = held[6] & _KNOWN == 0
                if open_.any():
                    yield _stretch_rows(_WHOLE, held[:, open_], 0)
                held = held[:, :1].copy()
                held[6] |= _KNOWN
    yield from _meet_rows(held, many)


def _stretch_rows(kind: int, rows: np.ndarray, flags: np.ndarray | int) -> pa.RecordBatch:
    mh, sw, t1, t2, start, n, _ = rows
    return record_batch(_STRETCH_ARROW, np.full(len(mh), kind, np.int32), mh, sw, t1, t2, start.astype(np.int32), n.astype(np.int32), np.broadcast_to(np.asarray(flags, np.int32), len(mh)))


def _meet_rows(rows: np.ndarray, many_of: int | None = None) -> Iterator[pa.RecordBatch]:
    """Of whole groups; of the minimizer ``many_of`` there are other stretches than these."""
    if not rows.shape[1]:
        return
    fresh = np.append(True, (rows[:6, 1:] != rows[:6, :-1]).any(axis=0))  # the same stretch of the same text, from several tasks
    rows = rows[:, fresh]
    mh, sw, _, _, _, n, flags = rows
    new_mh = np.append(True, mh[1:] != mh[:-1])
    new_sw = new_mh | np.append(True, (sw[1:] != sw[:-1]) | (n[1:] != n[:-1]))
    of_sw = np.cumsum(new_sw) - 1
    sw_at = np.flatnonzero(new_sw)
    known = (np.diff(np.append(sw_at, len(mh))) > 1) | (np.bitwise_or.reduceat(flags, sw_at) & _KNOWN > 0)
    settle = known[of_sw] & (flags & _KNOWN == 0)
    group = np.cumsum(new_mh)[sw_at] - 1  # of each distinct stretch: its minimizer
    g_at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    inner = flags[sw_at] & _INNER > 0
    forced = mh[sw_at[g_at]] == many_of if many_of is not None else np.zeros(len(g_at), bool)
    many = np.diff(np.append(g_at, len(sw_at))) > 1
    open_ = forced | np.logical_or.reduceat(~known, g_at) & (many | np.logical_or.reduceat(inner & ~known, g_at))
    asked = sw_at[open_[group]]
    for kind, pick in ((_WHOLE, np.flatnonzero(settle)), (_ASKED, asked)):
        if len(pick):
            yield _stretch_rows(kind, rows[:, pick], np.where(known[of_sw[pick]], _KNOWN, 0))


@released
def _pick_texts(batches: Iterator[pa.RecordBatch], wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows (t1, t2, raw) whose text may be wanted, each text once in a task."""
    words, seen = wanted.value, set()
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("raw", pa.binary())])
    for batch in batches:
        keep = may_hold(words, batch.column(3))
        for i in np.flatnonzero(keep):
            key = (batch.column(0)[int(i)].as_py(), batch.column(1)[int(i)].as_py())
            if key in seen:
                keep[i] = False
            else:
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(key)
        some = batch.filter(pa.array(keep))
        yield record_batch(schema, some.column(0), some.column(1), some.column(2))


_SLICE = "mh long, t1 long, t2 long, start int, n int, flags int, raw binary"
_SLICE_ARROW = pa.schema([("mh", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("flags", pa.int32()), ("raw", pa.binary())])


@released
def _slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The texts of the stretches asked for; of hot groups, one row for each different window of a batch."""
    for batch in batches:
        out: list[tuple] = []
        windows: dict[bytes, list[tuple[int, int, int, bool]]] = {}
        for t1, t2, raw, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for a in asked:
                start, n, flags = a["start"], a["n"], a["flags"]
                if not flags & _HOT:
                    out.append((a["mh"], t1, t2, start, n, flags, raw[start : start + n - 1 + length]))
                    continue
                for at in range(start, start + n):
                    windows.setdefault(xxhash.xxh3_128_digest(raw[at : at + length]), []).append((t1, t2, at, bool(flags & _KNOWN)))
        for digest, places in windows.items():
            key = int.from_bytes(digest[:8], "little", signed=True)
            many = len(places) > 1
            t1, t2, at, known = places[0]
            out.append((key, t1, t2, at, 1, _WINDOW | (_KNOWN if known or many else 0), digest))
            if many:
                out += [(key, t1, t2, at, 1, _SETTLED, b"") for t1, t2, at, known in places if not known]
        if out:
            yield record_batch(_SLICE_ARROW, *zip(*out, strict=True))


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The suffix array of ``text`` by two-stage sorting, exact in the first ``depth`` bytes.

    ``text`` is of uint8; 0 ends a string and is in none, and the last byte is 0.  Suffixes end at the next 0.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    # smaller than the successor: the next other byte is larger; a 0 is smaller than all
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    nxt = change[np.searchsorted(change, np.arange(n))]
    smaller = np.append(text[:-1] < text[1:], True)[nxt]
    smaller[ends] = True

    eight = np.zeros(n + 8, np.uint64)
    for i in range(8):
        eight[: n - i] |= text[i:].astype(np.uint64) << np.uint64(56 - 8 * i)
    mask = np.array([0, *((0xFFFFFFFFFFFFFFFF << (64 - 8 * i)) & 0xFFFFFFFFFFFFFFFF for i in range(1, 9))], np.uint64)

    def key(at: np.ndarray, deep: int) -> np.ndarray:
        rest = left[at] - deep
        return eight[np.minimum(at + deep, n)] & mask[np.clip(rest, 0, 8)]

    direct = np.flatnonzero(smaller)
    keys = key(direct, 0)
    order = np.argsort(keys, kind="stable")
    direct, keys = direct[order], keys[order]
    tied = np.append(False, keys[1:] == keys[:-1])  # equal to the one before in all bytes so far
    for deep in range(8, depth + 8, 8):
        part = tied | np.append(tied[1:], False)
        at = np.flatnonzero(part)
        if not len(at):
            break
        group = np.cumsum(~tied[at])
        keys = key(direct[at], deep)
        order = np.lexsort((keys, group))
        direct[at], keys, group = direct[at][order], keys[order], group[order]
        tied[at] = np.append(False, (keys[1:] == keys[:-1]) & (group[1:] == group[:-1]) & (keys[1:] != 0))

    counts = np.bincount(text, minlength=256)
    tails = np.cumsum(counts)
    heads = tails - counts
    n_small = np.bincount(text[direct], minlength=256)
    out = np.empty(n, np.int64)
    byte = text[direct]
    out[tails[byte] - n_small[byte] + np.arange(len(direct)) - (np.cumsum(n_small) - n_small)[byte]] = direct

    def induce(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            new = np.bincount(first, minlength=256)
            out[heads[first] + np.arange(len(first)) - (np.cumsum(new) - new)[first]] = before
            heads[:] += new

    starts = tails - counts
    for c in np.flatnonzero(counts):
        done = starts[c]
        while done < heads[c]:
            now = heads[c]
            induce(out[done:now].copy())
            done = now
        induce(out[tails[c] - n_small[c] : tails[c]])
    return out


def common_prefixes(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each place's string has in common with the one before it in ``places``, up to ``depth``."""
    out = np.zeros(len(places), np.int64)
    padded = np.append(text, np.zeros(depth, text.dtype))
    at = np.arange(1, len(places))
    for step in range(0, depth, 8):
        width = min(8, depth - step)
        if not len(at):
            break
        a, b = (padded[(p[:, None] + np.arange(step, step + width))] for p in (places[at], places[at - 1]))
        same = (a == b) & (a != 0)
        n = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        out[at] += n
        at = at[n == width]
    return out


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each text: for each of its windows, whether the same string is a window elsewhere in the texts."""
    joined = np.minimum(np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8), 255) + np.uint8(1)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    window = np.zeros(len(joined) + 1, np.int8)
    np.add.at(window, begins, 1)
    np.subtract.at(window, begins + np.maximum(sizes - length + 1, 0), 1)
    is_window = np.cumsum(window)[:-1] > 0
    order = suffix_array(joined, length)
    places = order[is_window[order]]
    twin = common_prefixes(joined, places, length) >= length
    twin |= np.append(twin[1:], False)
    hit = np.zeros(len(joined), bool)
    hit[places[twin]] = True
    return [hit[b : b + max(s - length + 1, 0)] for b, s in zip(begins, sizes, strict=True)]


_SPAN_ARROW = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


@released
def _sort_suffixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over whole groups of one minimizer, several small groups together."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= ARRAY_BYTES and row[0] != held[-1][0]:
                yield from _mark(held, length)
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        yield from _mark(held, length)


def _mark(rows: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    out = [r[1:5] for r in rows if r[5] & _SETTLED]
    same: dict[bytes, list[tuple]] = {}
    for r in rows:
        if r[5] & _WINDOW:
            same.setdefault(r[6], []).append(r)
    for equal in same.values():
        if len(equal) > 1:
            out += [r[1:5] for r in equal if not r[5] & _KNOWN]
    texts = [r for r in rows if not r[5] & (_WINDOW | _SETTLED)]
    for (_, t1, t2, start, _, flags, _), hit in zip(texts, repeated_windows([r[6] for r in texts], length) if texts else [], strict=True):
        if flags & _KNOWN or not hit.any():
            continue
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        out += [(t1, t2, start + int(a), int(b - a)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    if out:
        yield record_batch(_SPAN_ARROW, *zip(*out, strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of what the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RESULT = "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>"
_RESULT_ARROW = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


@released
def _remove(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t1, t2, raw, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs = merged([(s["start"], s["start"] + s["n"] - 1 + length) for s in found])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out.append((t1, t2, sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [{"start": a, "stop": b} for a, b in runs]))
        if out:
            yield record_batch(_RESULT_ARROW, *zip(*out, strict=True))


def _keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text, F.lit(1)).alias("t1"), F.xxhash64(text, F.lit(2), text).alias("t2")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs of every row."""
    context = docs.sparkSession.sparkContext
    text = F.col(text_col)
    t1, t2 = _keys(F.coalesce(text, F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), t1, t2, text_bytes(text).alias("raw"))
    keyed = rows.select("t1", "t2", "raw")

    def texts_of(keys: DataFrame) -> DataFrame:
        wanted = context.broadcast(key_filter(keys, "t1"))
        return keyed.withColumn("slots", filter_slots(F.col("t1"))).mapInArrow(partial(_pick_texts, wanted=wanted), "t1 long, t2 long, raw binary")

    cut = materialize(keyed.filter(F.octet_length("raw") >= length).mapInArrow(partial(_cut, length=length), _STRETCH), "stretches")
    shared = cut.filter(F.col("kind") == _STRETCH_ROW).drop("kind").repartition("mh").sortWithinPartitions("mh", "sw", "n", "t1", "t2", "start")
    met = materialize(shared.select("mh", "sw", "t1", "t2", "start", "n", "flags").mapInArrow(_meet, _STRETCH), "met")

    asked = met.filter(F.col("kind") == _ASKED)
    hot = asked.groupBy("mh").count().filter(F.col("count") > GROUP).select("mh", F.lit(_HOT).alias("hot"))
    asked = asked.join(hot, "mh", "left").withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("hot", F.lit(0))))
    of_text = materialize(asked.groupBy("t1", "t2").agg(F.collect_list(F.struct("mh", "start", "n", "flags")).alias("asked")), "asked")
    fetched = texts_of(of_text).join(of_text, ["t1", "t2"]).dropDuplicates(["t1", "t2"])
    sliced = fetched.select("t1", "t2", "raw", "asked").mapInArrow(partial(_slices, length=length), _SLICE)
    sorted_ = sliced.repartition("mh").sortWithinPartitions("mh").mapInArrow(partial(_sort_suffixes, length=length), _SPAN)
    whole = cut.filter(F.col("kind") == _WHOLE).unionByName(met.filter(F.col("kind") == _WHOLE)).select("t1", "t2", "start", "n")

    sized = materialize(rows.select("doc_id", "t1", "t2", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("whole_sha256")), "sizes")
    copies = sized.filter(F.col("n_bytes") >= length).groupBy("t1", "t2").count().filter("count > 1").select("t1", "t2", F.lit(True).alias("copied"))
    spans = whole.unionByName(sorted_).join(copies, ["t1", "t2"], "left_anti")
    spans = materialize(spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "n")).alias("found")), "spans")
    cutting = texts_of(spans).join(spans, ["t1", "t2"]).dropDuplicates(["t1", "t2"])
    removed = cutting.select("t1", "t2", "raw", "found").mapInArrow(partial(_remove, length=length), _RESULT)

    out = sized.join(copies, ["t1", "t2"], "left").join(removed, ["t1", "t2"], "left")
    gone = F.coalesce("copied", F.lit(False))
    return out.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(gone, F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("stop")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>"))).alias("spans"),
    )
