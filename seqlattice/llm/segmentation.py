"""Sampled subword segmentations without replacement, and their decoding.

A text's segmentations into pieces of a public vocabulary form a lattice.  A piece's weight is 1 / (rank + ``RANK``), a
Zipf law over the ranks that a byte-pair vocabulary carries in place of probabilities; bytes weigh least and stand only
where a character has no piece.  Backward sums over the lattice give every piece its probability at its place.

Gumbel top-k by A-star: the root has a Gumbel value; the best-first search follows a path down, each step drawn in
proportion, the path keeping the value; at every step all other pieces together form one region, whose greatest value
is one truncated Gumbel draw of its whole mass.  The region of the greatest value is opened next, and so on: the
samples come out in falling order of perturbed log probability, none twice.  The value of the next region, which isn't
opened, is the threshold of the inclusion scores 1 - exp(-exp(log p - threshold)), given as logarithms.

Draws are hashes of the row key, the sample's number and the place in the text, so a row's samples don't depend on how
rows are dealt.  Lattices are made once for each distinct word of a block of text: no piece crosses from a word into
the space before the next.  Decoding joins the pieces' bytes; an encoding's pieces always decode to its text.

Defined cases: a null or empty text has no segmentations.  Texts with fewer segmentations than asked for return all.
Words longer than ``LONGEST`` bytes are cut only where no piece of the vocabulary crosses.  Rows with equal keys and texts return equal samples.
An empty table gives no rows.  Of equal values the sample found first comes first.  Only the id and text columns are
read, so other columns can't clash.  A text of any length is cut whole, in one task, word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_array, mix, record_batch, released, text_bytes, tokenizer_path

MODEL = "piece_bpe_32k.model"
SAMPLES, RANK = 2, 10.0
LONGEST = 256
#: Bytes of text whose lattices are held at once; samples don't depend on it.
BLOCK = 500_000
_WORD = re.compile(rb"\n| *[^ \n]+| +")
_WIDTH = np.array([1] * 0x80 + [2] * 0x60 + [3] * 0x10 + [4] * 0x10, np.int8)  # of a character, by its first byte
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The pieces of a model as bytes (a space for the model's space mark), their weights, and a trie over bytes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.byte_id = np.zeros(256, np.int32)
        self.pieces: list[bytes] = [b""] * size
        plain: list[tuple[bytes, int]] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.pieces[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[i] = piece.replace("▁", " ").encode()
                plain.append((self.pieces[i], i))
        self.weight = np.full(size, -np.log(size + RANK) - 2.0)
        ranks = np.array([i for _, i in plain])
        self.weight[ranks] = -np.log(ranks - ranks.min() + RANK)
        used = sorted({b for p, _ in plain for b in p})
        self.column = np.full(256, len(used), np.int32)  # the last column is for bytes that no piece has
        self.column[used] = np.arange(len(used))
        nodes: dict[bytes, int] = {b"": 0}
        for p, _ in plain:
            for i in range(1, len(p) + 1):
                nodes.setdefault(p[:i], len(nodes))
        self.next = np.full((len(nodes), len(used) + 1), -1, np.int32)
        for p, node in nodes.items():
            if p:
                self.next[nodes[p[:-1]], self.column[p[-1]]] = node
        self.ends = np.full(len(nodes), -1, np.int32)
        for p, i in plain:
            self.ends[nodes[p]] = i

        sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.flat, self.size, self.place = np.frombuffer(b"".join(self.pieces), np.uint8), sizes, np.cumsum(sizes) - sizes

    def parts(self, word: bytes) -> list[bytes]:
        """The word, cut at the first character behind each ``LONGEST`` bytes that no piece reaches over."""
        data = np.frombuffer(word, np.uint8)
        columns, n = self.column[data], len(data)
        reach = np.arange(n, dtype=np.int64)
        at = np.flatnonzero(data & 0xC0 != 0x80)
        node, deep = np.zeros(len(at), np.int32), 0
        while len(at):
            node = self.next[node, columns[at + deep]]
            at, node = at[node >= 0], node[node >= 0]
            deep += 1
            ending = at[self.ends[node] >= 0]
            reach[ending] = ending + deep
            at, node = at[at + deep < n], node[at + deep < n]
        free = (data & 0xC0 != 0x80) & np.append(True, np.maximum.accumulate(reach)[:-1] <= np.arange(1, n))
        out, begin = [], 0
        for cut in np.flatnonzero(free).tolist():
            if cut - begin >= LONGEST:
                out.append(word[begin:cut])
                begin = cut
        return [*out, word[begin:]]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        end = np.cumsum(size)
        at = np.repeat(self.place[ids] - end + size, size)
        at += np.arange(len(at))
        return self.flat[at].tobytes()[1:]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def words_of(raw: bytes, vocab: Vocabulary) -> list[bytes]:
    """Words with the spaces before them; one space goes before the text, as the model has it."""
    words = _WORD.findall(b" " + raw)
    if max(map(len, words)) <= LONGEST:
        return words
    out = []
    for w in words:
        out += vocab.parts(w) if len(w) > LONGEST else [w]
    return out


class Index(dict):
    """A number for each distinct word, in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Lattices:
    """The lattices of distinct words, laid out one behind the other: a node for each byte, edges in order of nodes."""

    def __init__(self, words: list[bytes], vocab: Vocabulary):
        sizes = np.array([len(w) for w in words], np.int64)
        self.base = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        stop = np.repeat((self.base + sizes).astype(np.int32), sizes)
        columns = vocab.column[data]
        at, node = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
        starts, ends, ids = [], [], []
        single = np.zeros(n, bool)
        lead = data & 0xC0 != 0x80
        width = _WIDTH[data]
        at = at[lead]
        node = node[lead]
        deep = 0
        while len(at):
            node = vocab.next[node, columns[at + deep]]
            live = node >= 0
            at, node = at[live], node[live]
            deep += 1
            found = vocab.ends[node]
            hit = np.flatnonzero(found >= 0)
            here = at[hit]
            starts.append(here)
            ends.append(here + np.int32(deep))
            ids.append(found[hit])
            if deep <= 4:
                single[here[width[here] == deep]] = True
            more = at + deep < stop[at]
            at, node = at[more], node[more]
        # characters without a piece: their bytes
        first = np.maximum.accumulate(np.where(lead, np.arange(n, dtype=np.int32), 0))
        spelled = np.flatnonzero(~single[first]).astype(np.int32)
        starts.append(spelled)
        ends.append(spelled + 1)
        ids.append(vocab.byte_id[data[spelled]])
        # of a node, the longest piece first: mostly the likeliest
        start, end, piece = (np.concatenate(x[::-1]) for x in (starts, ends, ids))
        order = np.argsort(start, kind="stable")
        self.start, self.end, self.piece = start[order], end[order], piece[order]
        weight = vocab.weight[self.piece]
        count = np.bincount(self.start, minlength=n)
        self.first = np.cumsum(count) - count

        # backward sums, from the last bytes of words to their first
        beta = np.full(n + 1, -np.inf)
        final = self.end == stop[self.start]
        from_end = (stop[self.start] - self.start).astype(np.uint16 if sizes.max(initial=0) < 1 << 16 else np.uint32)
        by_end = np.argsort(from_end, kind="stable")
        cuts = np.flatnonzero(np.diff(from_end[by_end])) + 1
        total = np.empty(len(self.start))
        for edges in np.split(by_end, cuts) if len(by_end) else []:
            value = weight[edges] + np.where(final[edges], 0.0, beta[np.minimum(self.end[edges], n)])
            total[edges] = value
            nodes = self.start[edges]
            new = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
            beta[nodes[new]] = np.logaddexp.reduceat(value, new)
        self.log_p = total - beta[self.start]
        del total, weight, by_end, from_end, final
        p = np.exp(self.log_p)
        # sums within each node, edge by edge, so that they don't depend on what lies before the node
        cum = p.copy()
        nodes = np.flatnonzero(count > 1)
        k = 1
        while len(nodes):
            at = self.first[nodes] + k
            cum[at] += cum[at - 1]
            k += 1
            nodes = nodes[count[nodes] > k]
        self.cum = cum.astype(np.float32)
        self.cum[self.first[self.start] + count[self.start] - 1 == np.arange(len(self.start))] = np.inf
        del cum, nodes
        self.count = count
        self.length = (self.end - self.start).astype(np.int32)
        rest = np.where(p < 1, np.log1p(-np.minimum(p, 1 - 1e-16)), -np.inf)
        rest[self.count[self.start] == 1] = -np.inf
        self.rest = rest.astype(np.float32)  # log of a node's mass beside an edge
        del self.start, self.end

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        e = self.first[node]
        open_ = np.flatnonzero(u > self.cum[e])
        while len(open_):
            e[open_] += 1
            open_ = open_[u[open_] > self.cum[e[open_]]]
        return e

    def all_but(self, node: int, taken: list[int], u: float) -> tuple[int, float]:
        """One of a node's other edges, in proportion, and the log of their mass beside it."""
        edges = np.arange(self.first[node], self.first[node] + self.count[node])
        edges = edges[~np.isin(edges, taken)]
        p = np.exp(self.log_p[edges])
        k = min(int(np.searchsorted(np.cumsum(p), u * p.sum(), side="right")), len(edges) - 1)
        rest = p.sum() - p[k]
        return int(edges[k]), float(np.log(rest)) if len(edges) > 1 and rest > 0 else -np.inf


def _uniform(seed: np.ndarray, round_: int, place: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(seed + (place.astype(np.uint64) * np.uint64(4) + np.uint64(kind)) * _GOLD + np.uint64(round_ + 1) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _below(bound: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A Gumbel value, bounded: the largest of a region in which another has ``bound``."""
    return -np.logaddexp(-bound, -value)


def sample(texts: list[bytes], seeds: np.ndarray, vocab: Vocabulary, k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Of each text up to ``k`` samples (ids, log probability, perturbed value, log inclusion score)."""
    live = [i for i, t in enumerate(texts) if t]
    out: list[list] = [[] for _ in texts]
    if not live:
        return out
    split = [words_of(texts[i], vocab) for i in live]
    index = Index()
    kinds = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64)
    lattices = Lattices(list(index), vocab)
    word_size = np.array([len(w) for w in index], np.int64)[kinds]
    word_at = np.cumsum(word_size) - word_size
    n = int(word_size.sum())
    words_in = np.array([len(ws) for ws in split])
    first_word = np.cumsum(words_in) - words_in
    doc_at = word_at[first_word]
    doc_end = np.append(doc_at[1:], n)
    word_doc = np.repeat(np.arange(len(live)), words_in)
    seed = np.asarray(seeds, np.uint64)[live]
    value = _gumbel(_uniform(seed, 0, np.zeros(len(live), np.int64), 2))

    def walk(word: np.ndarray, begin: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, edge) of a path through each word from byte ``begin`` on."""
        places, edges = [], []
        while len(word):
            node = lattices.base[kinds[word]] + begin
            place = word_at[word] + begin
            doc = word_doc[word]
            e = lattices.draw(node, _uniform(seed[doc], round_, place - doc_at[doc], 0))
            places.append(place)
            edges.append(e)
            begin = begin + lattices.length[e]
            more = begin < word_size[word]
            word, begin = word[more], begin[more]
        return np.concatenate(places), np.concatenate(edges)

    def finish(place: np.ndarray, edge: np.ndarray, before: np.ndarray, bound: np.ndarray, round_: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list]]:
        """Order a round's steps by place; their log probabilities, and each text's best ``m`` regions beside them."""
        path = np.full(n, -1, np.int64)
        path[place] = edge
        place = np.flatnonzero(path >= 0)
        edge = path[place]
        doc = np.searchsorted(doc_at, place, side="right") - 1
        log_p = lattices.log_p[edge]
        new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        phi = np.empty(len(log_p))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(doc)], strict=True):  # text by text: sums don't depend on the block
            phi[a:b] = np.cumsum(log_p[a:b])
        phi += before[doc] - log_p
        region = phi + lattices.rest[edge]
        g = _below(bound[doc], region + _gumbel(_uniform(seed[doc], round_, place - doc_at[doc], 1)))
        g[np.isneginf(region)] = -np.inf
        regions: list[list] = [[] for _ in live]
        for _ in range(m):
            best = np.maximum.reduceat(g, new)
            top = g == np.repeat(best, np.diff(np.append(new, len(doc))))
            top = np.flatnonzero(top & (g > -np.inf))
            top = top[np.append(True, doc[top[1:]] != doc[top[:-1]])] if len(top) else top
            for t in top.tolist():
                regions[doc[t]].append((float(g[t]), int(place[t]), float(phi[t]), [int(edge[t])]))
            g[top] = -np.inf
        ends = phi + log_p
        last = np.append(new[1:], len(doc)) - 1
        return place, edge, doc, doc[last], ends[last], regions

    zeros = np.zeros(len(live))
    place, edge = walk(np.arange(len(kinds)), np.zeros(len(kinds), np.int64), 0)
    place, edge, doc, _, log_p, pools = finish(place, edge, zeros, value, 0, k)
    cuts = np.searchsorted(place, doc_at)
    paths = [list(zip([place[a:b]], [edge[a:b]], strict=True))[0] for a, b in zip(cuts, np.append(cuts[1:], len(place)), strict=True)]
    found: list[list] = [[(paths[d], float(log_p[d]), float(value[d]))] for d in range(len(live))]
    # of a region: value, place, log probability before it, edges taken out, path that it leaves
    pools = [[(*r, paths[d]) for r in pool] for d, pool in enumerate(pools)]
    for round_ in range(1, k):
        opened = []
        for d, pool in enumerate(pools):
            if not pool:
                continue
            best = max(range(len(pool)), key=lambda i: pool[i][0])
            g, at, phi, taken, path = pool.pop(best)
            word = int(np.searchsorted(word_at, at, side="right") - 1)
            node = int(lattices.base[kinds[word]] + at - word_at[word])
            here = np.array([at - doc_at[d]])
            e, rest = lattices.all_but(node, taken, float(_uniform(seed[d : d + 1], round_, here, 3)[0]))
            if rest > -np.inf:
                draw = phi + rest + float(_gumbel(_uniform(seed[d : d + 1], round_, here, 2))[0])
                pool.append((float(_below(np.float64(g), np.float64(draw))), at, phi, [*taken, e], path))
            opened.append((d, g, at, word, phi, e, path))
        if not opened:
            break
        words, begins = [], []
        before, bound = zeros.copy(), zeros.copy()
        for d, g, at, word, phi, e, _ in opened:
            after = at - word_at[word] + int(lattices.length[e])
            rest_words = np.arange(word + (after >= word_size[word]), first_word[d] + words_in[d])
            start = np.zeros(len(rest_words), np.int64)
            if after < word_size[word]:
                start[0] = after
            words.append(rest_words)
            begins.append(start)
            before[d], bound[d] = phi + float(lattices.log_p[e]), g
        words_, begins_ = np.concatenate(words), np.concatenate(begins)
        tails: dict[int, tuple] = {}
        if len(words_):
            place, edge = walk(words_, begins_, round_)
            place, edge, doc, of, log_p, regions = finish(place, edge, before, bound, round_, k - round_)
            low, high = np.searchsorted(place, doc_at), np.searchsorted(place, doc_end)
            ends = dict(zip(of.tolist(), log_p.tolist(), strict=True))
            tails = {d: (place[low[d] : high[d]], edge[low[d] : high[d]], ends[d], regions[d]) for d in ends}
        for d, g, at, _, _, e, path in opened:
            keep = path[0] < at
            tail_place, tail_edge, end, new = tails.get(d, (np.empty(0, np.int64), np.empty(0, np.int64), before[d], []))
            whole = (np.concatenate([path[0][keep], [at], tail_place]), np.concatenate([path[1][keep], [e], tail_edge]))
            found[d].append((whole, float(end), g))
            pools[d] += [(*r, whole) for r in new]
    for d, i in enumerate(live):
        threshold = max((r[0] for r in pools[d]), default=-np.inf)
        for (_, edges), log_p_, g in found[d]:
            out[i].append((lattices.piece[edges], log_p_, g, log_inclusion(log_p_, threshold)))
    return out


def log_inclusion(log_p: float, threshold: float) -> float:
    """log(1 - exp(-exp(log_p - threshold)))."""
    x = log_p - threshold
    if x == np.inf or x > 5:
        return 0.0
    return float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else float(x)


_SAMPLE = "array<struct<ids:array<int>,n_pieces:int,sha256:string,decoded:boolean,log_prob:double,value:double,log_inclusion:double>>"
_SAMPLE_ARROW = pa.struct([("ids", pa.list_(pa.int32())), ("n_pieces", pa.int32()), ("sha256", pa.string()), ("decoded", pa.bool_()), ("log_prob", pa.float64()), ("value", pa.float64()), ("log_inclusion", pa.float64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("samples", pa.list_(_SAMPLE_ARROW))])


@released
def _encode(batches: Iterator[pa.RecordBatch], path: str, k: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in batches:
        ids, seeds = batch.column(0), batch.column(1).to_numpy().view(np.uint64)
        widths = pc.binary_length(batch.column(2)).to_pylist()
        at = 0
        while at < len(widths):
            end, room = at, BLOCK
            while end < len(widths) and (end == at or widths[end] <= room):
                room -= widths[end]
                end += 1
            raws = batch.column(2).slice(at, end - at).to_pylist()
            found = sample(raws, seeds[at:end], vocab, k)
            flat = [(p, vocab.decode(p) == raw, *rest) for raw, samples in zip(raws, found, strict=True) for p, *rest in samples]
            pieces = [f[0] for f in flat]
            sizes = [len(p) for p in pieces]
            none = pa.nulls(len(flat), pa.list_(pa.int32()))
            ids_array = list_array(pa.array(np.concatenate([np.empty(0, np.int32), *pieces])), sizes) if with_ids else none
            hashes = [hashlib.sha256(p.astype("<i4").tobytes()).hexdigest() for p in pieces]
            log_p, values, inclusion = (pa.array([f[i] for f in flat], pa.float64()) for i in (2, 3, 4))
            struct = pa.StructArray.from_arrays([ids_array, pa.array(sizes, pa.int32()), pa.array(hashes, pa.string()), pa.array([f[1] for f in flat], pa.bool_()), log_p, values, inclusion], fields=list(_SAMPLE_ARROW))
            yield record_batch(_OUT, ids.slice(at, end - at), widths[at:end], list_array(struct, [len(x) for x in found]))
            at = end


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, model_dir: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_bytes and up to ``k`` distinct sampled segmentations of each row, seeded by its id.

    A sample has its piece ids (null unless ``with_ids``), their number and SHA-256 as little-endian 32-bit numbers,
    whether they decode to the text, its log probability, perturbed value and log inclusion score.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.lit(7)).alias("seed"), text_bytes(F.col(text_col)).alias("raw"))
    return rows.mapInArrow(partial(_encode, path=tokenizer_path(MODEL, model_dir), k=k, with_ids=with_ids), f"doc_id long, n_bytes long, samples {_SAMPLE}")


def decode(ids: Column, model_dir: str | None = None) -> Column:
    """The text of a column of piece ids."""
    path = tokenizer_path(MODEL, model_dir)

    @F.pandas_udf(T.StringType())
    def texts(column: pd.Series) -> pd.Series:
        vocab = vocabulary(path)
        return column.map(lambda x: None if x is None else vocab.decode(np.asarray(x, np.int64)).decode("utf-8", "replace"))

    return texts(ids)
