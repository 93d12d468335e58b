"""N-gram statistics of symbol sequences.

Sequences come as rows of an array column, or as ordered rows of a long table (one symbol a row).  Counts are long
tables (ctx, sym, n): a grouped count with partial aggregation, so hot n-grams are summed up before the shuffle.  What
follows works on counts, whose size is that of the alphabet, not of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.significance import chi_square_tail

BOS, EOS = "<s>", "</s>"


def ngram_counts(rows: DataFrame, symbols: Column, n: int = 2, weight: Column | None = None, edges: bool = True) -> DataFrame:
    """(ctx array, sym, n): n-grams of an array column; empty sequences are left out."""
    syms = F.concat(F.array_repeat(F.lit(BOS), n - 1), symbols, F.array(F.lit(EOS))) if edges else symbols
    kept = rows.filter(F.size(symbols) > 0).select(syms.alias("s"), (weight if weight is not None else F.lit(1)).cast("long").alias("w")).filter(F.size("s") >= n)
    shifted = F.arrays_zip(*(F.slice("s", i + 1, F.size("s") - n + 1) for i in range(n)))
    grams = kept.select(F.explode(shifted).alias("g"), "w").select(*(F.col("g")[str(i)].alias(f"g{i}") for i in range(n)), "w")
    counted = grams.groupBy(*(f"g{i}" for i in range(n))).agg(F.sum("w").alias("n"))
    return counted.select(F.array(*(f"g{i}" for i in range(n - 1))).cast("array<string>").alias("ctx"), F.col(f"g{n - 1}").alias("sym"), "n")


def ordered_ngram_counts(rows: DataFrame, key: str, order: list[str], symbol: str, n: int = 2) -> DataFrame:
    """(ctx array, sym, n) of a long table: each key's symbols in order, with edges; nothing is collected to an array."""
    by = Window.partitionBy(key).orderBy(*order)
    before = [F.coalesce(F.lag(symbol, i).over(by), F.lit(BOS)) for i in range(n - 1, 0, -1)]
    last = F.lead(F.lit(1)).over(by).isNull()
    step = rows.select(F.array(*before).alias("ctx"), F.col(symbol).alias("sym"), last.alias("last"))
    end = F.array(F.struct("ctx", "sym"), F.struct(F.slice(F.concat("ctx", F.array("sym")), 2, n - 1).alias("ctx"), F.lit(EOS).alias("sym")))
    grams = step.select(F.explode(F.when(F.col("last"), end).otherwise(F.slice(end, 1, 1))).alias("g"))
    return grams.groupBy("g.ctx", "g.sym").agg(F.count("*").alias("n"))


def contexts(counts: DataFrame) -> DataFrame:
    """(ctx, n_ctx)."""
    return counts.groupBy("ctx").agg(F.sum("n").alias("n_ctx"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """(sym, n_sym): what follows a context; the end mark is one of them, the begin mark isn't."""
    return counts.groupBy("sym").agg(F.sum("n").alias("n_sym"))


def probabilities(counts: DataFrame, alpha: float = 0.1, size: int | None = None) -> DataFrame:
    """Counts with n_ctx and p = (n + alpha) / (n_ctx + alpha * V); V is the observed vocabulary unless given."""
    v = F.lit(size) if size is not None else F.col("v")
    sized = counts.join(contexts(counts), "ctx")
    if size is None:
        sized = sized.crossJoin(F.broadcast(vocabulary(counts).agg(F.count("*").alias("v"))))
    return sized.withColumn("p", (F.col("n") + F.lit(alpha)) / (F.col("n_ctx") + F.lit(alpha) * v)).drop("v")


def transition_matrix(counts: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Every context with every symbol: n, smoothed p and raw p (0 for a context without counts).

    Contexts and symbols of a fixed alphabet: the product is that of two small tables.
    """
    ctx, vocab = contexts(counts), vocabulary(counts).select("sym")
    cells = ctx.crossJoin(F.broadcast(vocab.withColumn("v", F.count("*").over(Window.partitionBy())))).join(counts, ["ctx", "sym"], "left").fillna(0, ["n"])
    smoothed = (F.col("n") + F.lit(alpha)) / (F.col("n_ctx") + F.lit(alpha) * F.col("v"))
    raw = F.when(F.col("n_ctx") > 0, F.col("n") / F.col("n_ctx")).otherwise(0.0)
    return cells.select("ctx", "sym", "n", smoothed.alias("p_smooth"), raw.alias("p_raw"))


def pmi(counts: DataFrame, least: int = 1) -> DataFrame:
    """Counts with pmi = log2(n * N / (n_ctx * n_sym)); null under ``least``."""
    total = counts.agg(F.sum("n").alias("total"))
    joined = counts.join(contexts(counts), "ctx").join(vocabulary(counts), "sym").crossJoin(F.broadcast(total))
    value = F.log2(F.col("n").cast("double") * F.col("total") / (F.col("n_ctx").cast("double") * F.col("n_sym")))
    return joined.select("ctx", "sym", "n", "n_ctx", "n_sym", F.when(F.col("n") >= least, value).alias("pmi"))


def pmi_extremes(counts: DataFrame, least: int = 2, top: int = 30) -> DataFrame:
    """(side, place, ctx, sym, n, pmi): the ``top`` strongest and weakest pairs that occur ``least`` times; ties by symbols."""
    known = pmi(counts, least).filter("pmi IS NOT NULL").select("ctx", "sym", "n", "pmi")

    def side(name: str, order: Column) -> DataFrame:
        picked = known.orderBy(order, "ctx", "sym").limit(top)
        return picked.select(F.lit(name).alias("side"), F.row_number().over(Window.orderBy(order, "ctx", "sym")).alias("place"), "ctx", "sym", "n", "pmi")

    return side("top", F.round("pmi", 9).desc()).unionByName(side("bottom", F.round("pmi", 9).asc()))


def feature_agreement(triples: DataFrame, features: dict[str, dict[str, str]], least: int = 10, margin: float = 0.1) -> DataFrame:
    """(c, feature, n, agreement, chance, mark) of counted triples (u, c, v): how often both sides have one value of a feature.

    ``chance`` is that of two independent draws from all sides; the mark is + or - where the two differ by more than
    ``margin``.  A middle with fewer than ``least`` triples is left out.
    """
    spark = triples.sparkSession
    values = F.broadcast(spark.createDataFrame([(f, x, v) for f, of in features.items() for x, v in of.items()], "feature string, x string, value string"))
    sides = triples.select(F.explode(F.array("u", "v")).alias("x"), "n").groupBy("x").agg(F.sum("n").alias("n"))
    shares = sides.join(values, "x").groupBy("feature", "value").agg(F.sum("n").cast("double").alias("n"))
    chance = shares.groupBy("feature").agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("chance"))
    left, right = values.withColumnsRenamed({"x": "u", "value": "__u"}), values.withColumnsRenamed({"x": "v", "value": "__v"})
    met = triples.join(left, "u").join(right, ["feature", "v"]).groupBy("c", "feature").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("__u") == F.col("__v"), F.col("n")).otherwise(0)).alias("same"))
    away = F.col("agreement") - F.col("chance")
    out = met.filter(F.col("n") >= least).join(chance, "feature").withColumn("agreement", F.col("same") / F.col("n"))
    return out.select("c", "feature", "n", "agreement", "chance", F.when(away > margin, "+").when(away < -margin, "-").otherwise("").alias("mark"))


def entropies(counts: DataFrame) -> DataFrame:
    """One row: h, h_cond, mi and redundancy in bits."""
    total = counts.agg(F.sum("n").cast("double").alias("total"))
    p_sym = F.col("n_sym") / F.col("total")
    marginal = vocabulary(counts).crossJoin(F.broadcast(total)).agg((-F.sum(p_sym * F.log2(p_sym))).alias("h"), F.count("*").alias("vocab"))
    joint = F.col("n") / F.col("total")
    conditional = counts.join(contexts(counts), "ctx").crossJoin(F.broadcast(total)).agg((-F.sum(joint * F.log2(F.col("n") / F.col("n_ctx")))).alias("h_cond"), F.count("*").alias("n_grams_seen"))
    both = marginal.crossJoin(conditional).withColumn("mi", F.col("h") - F.col("h_cond"))
    return both.withColumn("redundancy", F.when(F.col("h") == 0, 0.0).otherwise(F.col("mi") / F.col("h")))


def gaps(counts: DataFrame, least_expected: float = 1.0) -> DataFrame:
    """(ctx, sym, expected) of cells that never occur though ``least_expected`` or more would; empty if there are none."""
    total = counts.agg(F.sum("n").cast("double").alias("total"))
    cells = contexts(counts).crossJoin(F.broadcast(vocabulary(counts))).crossJoin(F.broadcast(total))
    expected = F.col("n_ctx") * F.col("n_sym") / F.col("total")
    return cells.join(counts, ["ctx", "sym"], "left_anti").select("ctx", "sym", expected.alias("expected")).filter(F.col("expected") >= least_expected)


def scored(grams: DataFrame, key: str, model: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(key, n_grams, log2_p, normalised) of long n-grams (key, ctx, sym) under a model of counts; unseen cells are smoothed."""
    p = probabilities(model, alpha).select("ctx", "sym", "p")
    sizes = contexts(model).crossJoin(F.broadcast(vocabulary(model).agg(F.count("*").alias("v"))))
    unseen = F.lit(alpha) / (F.coalesce("n_ctx", F.lit(0)) + F.lit(alpha) * F.col("v"))
    joined = grams.join(F.broadcast(sizes), "ctx", "left").join(F.broadcast(p), ["ctx", "sym"], "left")
    score = F.sum(F.log2(F.coalesce("p", unseen)))
    return joined.groupBy(key).agg(F.count("*").alias("n_grams"), score.alias("log2_p")).withColumn("normalised", F.col("log2_p") / F.col("n_grams"))


def long_grams(rows: DataFrame, key: str, order: list[str], symbol: str) -> DataFrame:
    """(key, pos, ctx, sym): bigrams of ordered rows with edges, one row each."""
    by = Window.partitionBy(key).orderBy(*order)
    step = rows.select(key, F.row_number().over(by).alias("pos"), F.coalesce(F.lag(symbol).over(by), F.lit(BOS)).alias("prev"), F.col(symbol).alias("cur"), F.lead(symbol).over(by).isNull().alias("last"))
    grams = F.array(F.struct("pos", F.array("prev").alias("ctx"), F.col("cur").alias("sym")), F.struct((F.col("pos") + 1).alias("pos"), F.array("cur").alias("ctx"), F.lit(EOS).alias("sym")))
    return step.select(key, F.explode(F.when(F.col("last"), grams).otherwise(F.slice(grams, 1, 1))).alias("g")).select(key, "g.pos", "g.ctx", "g.sym")


def distribution(rows: DataFrame, symbol: Column, weight: Column | None = None) -> DataFrame:
    """(symbol, n, freq)."""
    counted = rows.select(symbol.alias("symbol"), (weight if weight is not None else F.lit(1)).cast("long").alias("w")).groupBy("symbol").agg(F.sum("w").alias("n"))
    return counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("total")))).select("symbol", "n", (F.col("n") / F.col("total")).alias("freq"))


def positional_distribution(rows: DataFrame, position: Column, symbol: Column, group: Column | None = None) -> DataFrame:
    """(pos, symbol, n, freq): freq is the share within a position."""
    counted = rows.select(position.alias("pos"), symbol.alias("symbol")).groupBy("pos", "symbol").agg(F.count("*").alias("n"))
    return counted.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy("pos")))


def cooccurrence(rows: DataFrame, left: Column, right: Column, least: int = 0) -> DataFrame:
    """(x, y, n) with every pair of values; cells under ``least`` are 0."""
    counted = rows.select(left.alias("x"), right.alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    cells = counted.select("x").distinct().crossJoin(counted.select("y").distinct()).join(counted, ["x", "y"], "left").fillna(0, ["n"])
    return cells.withColumn("n", F.when(F.col("n") >= least, F.col("n")).otherwise(0))


def chi_square(cells: DataFrame) -> DataFrame:
    """One row of a dense table (x, y, n): chi2, dof, p_value, cramers_v, n_total; with one degree of freedom Yates' correction."""
    by_x, by_y, whole = Window.partitionBy("x"), Window.partitionBy("y"), Window.partitionBy()
    sides = cells.agg(F.countDistinct("x").alias("r"), F.countDistinct("y").alias("c"))
    expected = cells.select("n", (F.sum("n").over(by_x) * F.sum("n").over(by_y) / F.sum("n").over(whole)).alias("e"))
    joined = expected.crossJoin(F.broadcast(sides)).withColumn("dof", (F.col("r") - 1) * (F.col("c") - 1))
    off = F.abs(F.col("n") - F.col("e"))
    off = F.when(F.col("dof") == 1, off - F.least(F.lit(0.5), off)).otherwise(off)
    summed = joined.groupBy("dof", "r", "c").agg(F.sum(off * off / F.col("e")).alias("chi2"), F.sum("n").alias("n_total"))
    v = F.sqrt(F.col("chi2") / (F.col("n_total") * (F.least("r", "c") - 1)))
    return summed.select("chi2", "dof", chi_square_tail(F.col("chi2"), F.col("dof")).alias("p_value"), v.alias("cramers_v"), "n_total")


def sessions(rows: DataFrame, key: str, time: str, gap_seconds: float) -> DataFrame:
    """(key, session, n, start, stop): a new session after a silence of ``gap_seconds`` or more."""
    by = Window.partitionBy(key).orderBy(time)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    silence = seconds - F.lag(seconds).over(by)
    marked = rows.withColumn("__new", F.coalesce(silence >= gap_seconds, F.lit(True)).cast("int"))
    numbered = marked.withColumn("session", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(time).alias("start"), F.max(time).alias("stop"))
