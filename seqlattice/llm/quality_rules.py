"""Quality rules: base counts of a text, and how well a public vocabulary fits it.

Fertility figures, each over the words of a whole text under a byte-fallback vocabulary: characters a token, share of
byte-fallback tokens, and the entropy of the tokens over the greatest it can be.  The rejection band of a figure lies
around the median of all documents of a language and script that pass the base rules:

- characters a token: ``width`` standard errors, of a spread of one token that is itself learned (the median deviation
  times the root of the number of tokens) and of ``DRIFT`` of the median, so that short texts have wider bands;
- byte-fallback share: the same with the spread of a share, and ``BYTE_ALLOWANCE``;
- token entropy: ``width`` robust deviations around the median of texts with as many tokens, by powers of two.

Every document that passes the base rules is judged, however short: its bands are as wide as its number of tokens asks
for.  Medians are those of counted bins, so they don't depend on how rows are dealt to tasks.

A language and script (for entropy: also a size) with fewer than ``least`` documents isn't judged by itself, as a lone
document is its own median.  It is held against the classes of its script that have as many: from the least of their medians
to the greatest, with the widest of their spreads.  Where the script has no such class, all its documents are one class.

Defined cases: a null or empty text has no words and fails the base rules.  A null language is a class of its own,
and with few documents judged by its script.  Repeated rows are measured and count each by itself.  An empty table gives
no rows.  Only the id, text and language columns are read, so other columns can't clash.  A text of any length is measured
whole, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, materialize, record_batch, released, text_bytes, text_key, tokenizer_path

SYMBOLS = b"#*$%&|<>"
MODEL = "piece_bpe_32k.model"
BAND_WIDTH = 6.0
#: Least spread of one token in characters; differences between texts of one language, as a share of the median.
LEAST_SPREAD, DRIFT = 0.5, 0.005
BYTE_ALLOWANCE, LEAST_ENTROPY_SPREAD = 0.01, 0.015
#: Documents that a class needs to be judged by itself.
LEAST_DOCS = 10
CACHE_WORDS = 150_000

_COUNTS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]
_FIGURES = [("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64()), ("script", pa.string())]


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words inside windows of ``size`` words that the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    width, mult = 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = h * np.uint64(0xD6E8FEB86659FD93) ^ (h >> np.uint64(32))
        while width < size:
            h = h[:-width] * mult + h[width:]
            mult, width = mult * mult + np.uint64(2), 2 * width
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    starts = np.zeros(len(words) + 1, np.int32)
    at = np.union1d(order[1:][same], order[:-1][same])
    starts[at] += 1
    np.subtract.at(starts, at + size, 1)
    return int((np.cumsum(starts)[:-1] > 0).sum())


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    in_words = raw.translate(None, WHITE)
    chars = len(in_words) if in_words.isascii() else len(in_words.decode("utf-8", "replace"))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else ()
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


class WordPieces(dict):
    """word -> its token ids, two bytes each; kept up to a number of words, then begun anew."""

    def __init__(self, model: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        assert self.model.vocab_size() < 1 << 16
        self.bytes = [i for i in range(self.model.vocab_size()) if self.model.is_byte(i)]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = np.array(self.model.encode(word.decode("utf-8", "replace")), np.uint16).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


#: Parts of the code space that name a script, by first code point.
_SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1E00, "latin"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other")]
_SCRIPT_FROM = np.array([a for a, _ in _SCRIPTS], np.uint32)


def script_of(raw: bytes) -> str:
    """The script of most letters outside ASCII, if those are more than the ASCII letters; else latin."""
    if raw.isascii():
        return "latin"
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    wide = points[points >= 0x80]
    ascii_letters = int((((points | 32) >= 97) & ((points | 32) <= 122) & (points < 0x80)).sum())
    counts = np.bincount(np.searchsorted(_SCRIPT_FROM, wide, side="right") - 1, minlength=len(_SCRIPTS))
    by_name: dict[str, int] = {}
    for (_, name), n in zip(_SCRIPTS, counts.tolist(), strict=True):
        by_name[name] = by_name.get(name, 0) + n
    by_name["latin"] += ascii_letters
    return max(sorted(by_name), key=lambda k: by_name[k])


def fertility(raw: bytes, words: list[bytes], chars: int, pieces: WordPieces, is_byte: np.ndarray) -> tuple[int, float | None, float | None, float | None, str]:
    if not words:
        return 0, None, None, None, script_of(raw)
    tokens = np.frombuffer(b"".join(map(pieces.__getitem__, words)), np.uint16)
    n = len(tokens)
    counts = np.bincount(tokens)
    counts = counts[counts > 0]
    entropy = float(np.log2(n) - (counts * np.log2(counts)).sum() / n)
    return n, chars / n, float(is_byte[tokens].sum()) / n, entropy / float(np.log2(n)) if n > 1 else 1.0, script_of(raw)


@released
def _measure(batches: Iterator[pa.RecordBatch], schema: pa.Schema, text_at: int, model: str | None) -> Iterator[pa.RecordBatch]:
    pieces = WordPieces(model) if model else None
    is_byte = np.zeros(1 << 16, bool)
    if pieces is not None:
        is_byte[pieces.bytes] = True
    for batch in batches:
        counts, figures = [], []
        for raw in batch.column(text_at).to_pylist():
            words = raw.split()
            counts.append(base_counts(raw, words))
            if pieces is not None:
                figures.append(fertility(raw, words, counts[-1][1], pieces, is_byte))
        rest = [c for i, c in enumerate(batch.columns) if i != text_at]
        yield record_batch(schema, *rest, *(list(zip(*counts, strict=True)) or [[]] * len(_COUNTS)), *((list(zip(*figures, strict=True)) or [[]] * len(_FIGURES)) if model else ()))


def _spark_type(kind: pa.DataType) -> T.DataType:
    return {pa.int64(): T.LongType(), pa.float64(): T.DoubleType(), pa.string(): T.StringType(), pa.binary(): T.BinaryType()}[kind]


def measure(docs: DataFrame, keep: dict[str, Column], text_col: str = "text", model_dir: str | None = None, fertile: bool = True) -> DataFrame:
    """The base counts and fertility figures of each row, beside the columns ``keep`` (long, string or binary)."""
    picked = docs.select(*(c.alias(k) for k, c in keep.items()), text_bytes(F.col(text_col)).alias("__raw"))
    new = _COUNTS + (_FIGURES if fertile else [])
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(k, kinds[t]) for k, t in picked.dtypes if k != "__raw"] + new)
    spark_schema = T.StructType([T.StructField(f.name, _spark_type(f.type)) for f in schema])
    model = tokenizer_path(MODEL, model_dir) if fertile else None
    return picked.mapInArrow(partial(_measure, schema=schema, text_at=len(keep), model=model), spark_schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


_CLASS = ["lang", "script", "size", "figure"]
#: Figures that are compared at every length of text stand at this size.
ANY_SIZE = -1

#: Bins of a median for each factor e of 1 + value.
BINS = 2_000


def _binned(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of ``value``, a number from 0 on, in bins of equal width in log(1 + value): at most some 20,000 of a class."""
    bins = rows.select(*keys, F.round(F.log1p("value") * BINS).cast("long").alias("bin")).filter("bin IS NOT NULL")
    return bins.groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def _middle(bins: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, ``name``, n): the bin that the middle row of a class falls into, and the rows of the class."""
    of_class = Window.partitionBy(*keys)
    below = F.sum("n").over(of_class.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = bins.withColumns({"below": below, "total": F.sum("n").over(of_class)}).filter(2 * F.col("below") >= F.col("total"))
    return middle.groupBy(*keys).agg(F.expm1(F.min("bin") / BINS).alias(name), F.first("total").alias("n"))


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join by keys of which the language may be null."""
    named = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(named, met, "left").drop(*(f"__{k}" for k in keys))


def _figures(rows: DataFrame) -> DataFrame:
    """(class, n_tokens, value): a row for each figure of a document."""
    each = (("chars_per_token", F.lit(ANY_SIZE)), ("byte_share", F.lit(ANY_SIZE)), ("token_entropy", F.col("size_class")))
    told = F.array(*(F.struct(F.lit(k).alias("figure"), size.cast("int").alias("size"), F.col(k).alias("value")) for k, size in each))
    return rows.select("lang", "script", "n_tokens", F.inline(told))


def bands_of(steady: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(class, level, low, high, away): the medians that a class is judged by, and the spread around them.

    ``level`` is ``own`` for a class of at least ``least`` documents; ``script`` where other languages of the script have
    such classes, with the least and the greatest of their medians; else ``pooled``, all documents of the script as one.
    Two passes over the documents; everything else works on tables of bins and classes, which are written.
    """
    counted = materialize(_binned(_figures(steady), _CLASS), "bins")
    shared = _CLASS[1:]
    own = _middle(counted, _CLASS, "mid")
    pooled = _middle(counted.groupBy(*shared, "bin").agg(F.sum("n").alias("n")), shared, "pooled").drop("n")
    of_script = Window.partitionBy(*shared)
    large = F.when(F.col("n") >= least, F.col("mid"))
    ends = own.withColumns({"least": F.min(large).over(of_script), "most": F.max(large).over(of_script)})
    level = F.when(F.col("n") >= least, "own").when(F.col("least").isNotNull(), "script").otherwise("pooled")

    def end(of_others: str) -> Column:
        return F.when(F.col("level") == "own", F.col("mid")).when(F.col("level") == "script", F.col(of_others)).otherwise(F.col("pooled"))

    told = _with(ends, pooled, shared).withColumn("level", level)
    classes = materialize(told.select(*_CLASS, "level", end("least").alias("low"), end("most").alias("high")), "classes")

    of_level = F.when(F.col("level") == "own", F.col("lang"))
    scaled = F.when(F.col("figure") == "chars_per_token", F.sqrt(F.col("n_tokens").cast("double"))).otherwise(F.lit(1.0))
    learnt = classes.filter("level <> 'script' and figure <> 'byte_share'").select(*_CLASS, "level", "low")
    near = _with(_figures(steady).filter("figure <> 'byte_share'"), learnt, _CLASS).filter("low is not null")
    near = near.select("level", of_level.alias("of"), *shared, (F.abs(F.col("value") - F.col("low")) * scaled).alias("value"))
    keys = ["level", "of", *shared]
    away = _middle(_binned(near, keys), keys, "away").drop("n")
    met = _with(classes.withColumn("of", of_level), away, keys).drop("of")
    widest = F.max(F.when(F.col("level") == "own", F.col("away"))).over(of_script)
    return materialize(met.withColumn("away", F.when(F.col("level") == "script", widest).otherwise(F.col("away"))), "bands")


def judge(measured: DataFrame, width: float = BAND_WIDTH, least: int = LEAST_DOCS) -> DataFrame:
    """``measured`` with base_failed, in_band and kept; the bands come from all of its documents that pass the base rules.

    The tables of classes are written before they are joined, so that the planner knows how small they are.
    """
    rows = measured.withColumns({"base_failed": base_failed(), "size_class": F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))).cast("int")})
    bands = bands_of(rows.filter(~F.col("base_failed")), least)

    def band(figure: str, *names: str) -> list[Column]:
        return [F.max(F.when(F.col("figure") == figure, F.col(c))).alias(f"{c}_{figure}") for c in names]

    fixed = bands.filter(F.col("size") == ANY_SIZE).groupBy("lang", "script").agg(*band("chars_per_token", "low", "high", "away"), *band("byte_share", "high"))
    sized = bands.filter("figure = 'token_entropy'").select("lang", "script", F.col("size").alias("size_class"), *(F.col(c).alias(f"{c}_token_entropy") for c in ("low", "high", "away")))
    met = _with(_with(rows, fixed, ["lang", "script"]), sized, ["lang", "script", "size_class"])

    root = F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))
    of_token = F.greatest(F.lit(LEAST_SPREAD), 1.4826 * F.col("away_chars_per_token"))

    def chars_error(mid: str) -> Column:
        return width * F.sqrt((of_token / root) ** 2 + (DRIFT * F.col(mid)) ** 2)

    chars = (F.col("chars_per_token") >= F.col("low_chars_per_token") - chars_error("low_chars_per_token")) & (F.col("chars_per_token") <= F.col("high_chars_per_token") + chars_error("high_chars_per_token"))
    mid_bytes = F.col("high_byte_share")
    bytes_ = F.col("byte_share") - mid_bytes <= width * (F.sqrt(mid_bytes * (1 - mid_bytes)) / root + BYTE_ALLOWANCE)
    entropy_error = width * F.greatest(F.lit(LEAST_ENTROPY_SPREAD), 1.4826 * F.col("away_token_entropy"))
    entropies = (F.col("token_entropy") >= F.col("low_token_entropy") - entropy_error) & (F.col("token_entropy") <= F.col("high_token_entropy") + entropy_error)
    in_band = F.coalesce(chars & bytes_ & entropies, F.lit(False))
    return met.select(*rows.columns, in_band.alias("in_band")).withColumn("kept", ~F.col("base_failed") & F.col("in_band"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model_dir: str | None = None, width: float = BAND_WIDTH, least: int = LEAST_DOCS) -> DataFrame:
    """Counts, figures and verdict of every document.  ``tx`` beside the id names the text, should an id come twice."""
    keep = {"doc_id": F.col(id_col).cast("long"), "tx": text_key(F.col(text_col)), "lang": F.col(lang_col).cast("string")}
    measured = materialize(measure(docs, keep, text_col, model_dir), "fertility")
    return judge(measured, width, least)
