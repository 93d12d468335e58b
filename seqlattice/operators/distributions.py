"""Comparing distributions: rank statistics, divergences, summary ratios and rank laws."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut, dropped, swept


def _plateaus(counts: DataFrame, group: str) -> DataFrame:
    """(group, n, types, before, total): how many symbols have a count, how many have a higher one, and the sum of all.

    A window goes over the different counts of a group, which are few (their sum is at most the total), not its symbols.
    """
    by = Window.partitionBy(group)
    equal = counts.groupBy(group, "n").agg(F.count("*").alias("types"))
    above = F.sum("types").over(by.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("types")
    return equal.select(group, "n", "types", above.alias("before"), F.sum(F.col("n") * F.col("types")).over(by).alias("total"))


def rank_stats(counts: DataFrame, group: str, top: int = 10) -> DataFrame:
    """One row for each group of (group, symbol, n): types, tokens, shares of the first ranks, entropy, geometric p."""
    f, m, before = F.col("n") / F.col("total"), F.col("types"), F.col("before")
    first = F.least(m, F.greatest(F.lit(top) - before, F.lit(0)))
    out = _plateaus(counts, group).groupBy(group).agg(
        F.sum(m).alias("n_types"), F.sum(F.col("n") * m).alias("n_tokens"), F.sum(f * first).alias("top_share"), F.max(f).alias("top1"),
        (-F.sum(m * f * F.log2(f))).alias("h_bits"), (1 / F.sum(f * (m * before + m * (m + 1) / 2))).alias("p_geo"),
    )
    return out.withColumn("h_rel", F.when(F.col("n_types") > 1, F.col("h_bits") / F.log2("n_types")).otherwise(1.0))


def js_divergence(counts: DataFrame, group: str) -> DataFrame:
    """(left, right, js): Jensen-Shannon divergence in bits of every pair of groups of (group, symbol, n).

    Each symbol brings its share in each group to its pairs of groups: the groups are few, the symbols are grouped once.
    """
    totals = counts.groupBy(group).agg(F.sum("n").alias("total"))
    shares = counts.join(totals, group).withColumn("f", F.col("n") / F.col("total"))
    groups = totals.select(group)
    pairs = groups.select(F.col(group).alias("left")).crossJoin(groups.select(F.col(group).alias("right"))).filter("left < right")
    by_symbol = shares.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct(group, "f"))).alias("by"))
    p, q = F.coalesce(F.try_element_at("by", "left"), F.lit(0.0)), F.coalesce(F.try_element_at("by", "right"), F.lit(0.0))
    m = (p + q) / 2
    part = F.when(p > 0, 0.5 * p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, 0.5 * q * F.log2(q / m)).otherwise(0.0)
    return by_symbol.crossJoin(F.broadcast(pairs)).groupBy("left", "right").agg(F.sum(part).alias("js"))


#: Bins that values are counted in before one bin is sorted.
BINS = 4096


def falling_values(rows: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """(share, value): the value at place int(n * share) of all values in falling order.

    Equal values are counted first; counted bins show which one holds a place, and only that one is put in order.
    """
    values = cut(rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")))
    ends = values.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("all")).first()
    if not ends["all"]:
        return rows.sparkSession.createDataFrame([], "share double, value double")
    width = (ends.high - ends.low) or 1.0
    binned = values.withColumn("bin", F.least(F.floor((F.col("value") - F.lit(ends.low)) / width * BINS), F.lit(BINS - 1)))
    above, out = 0, []
    asked = sorted((min(int(ends["all"] * s), ends["all"] - 1), s) for s in shares)
    for r in binned.groupBy("bin").agg(F.sum("n").alias("n")).orderBy(F.desc("bin")).collect():
        out += [(s, k, r.bin, above) for k, s in asked if above <= k < above + r.n]
        above += r.n
    places = rows.sparkSession.createDataFrame(out, "share double, place long, bin long, above long")
    seen = F.sum("n").over(Window.partitionBy("share").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("above")
    return binned.join(places, "bin").withColumn("seen", seen).filter(F.col("seen") > F.col("place")).groupBy("share").agg(F.max("value").alias("value"))


def score_summary(scores: DataFrame, column: str, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """One row: mean, population deviation, and the value at place int(n * share) of the falling list for each share."""
    at = falling_values(scores, column, shares).agg(*(F.max(F.when(F.col("share") == s, F.col("value"))).alias(f"q{round(100 * s)}") for s in shares))
    return scores.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"), F.count("*").alias("n")).crossJoin(at)


#: Ranks that are summed at a time.
BLOCK = 1 << 20
# Of each law: where its parameters start, and their bounds.
LAWS = {
    "zipf": (lambda f: [f, 1.0], [-np.inf, -np.inf], [np.inf, np.inf]),
    "yule": (lambda f: [f, 0.5, 0.95], [0.0, 0.0, 1e-9], [np.inf, 5.0, 1.0]),
    "sigurd": (lambda f: [0.9], [0.01], [0.9999]),
    "borodovsky": (lambda f: [], [], []),
}


def predicted(law: str, t: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
    """What a rank law gives for ranks ``r`` of ``n``."""
    if law == "zipf":
        return t[0] / r ** t[1]
    if law == "yule":
        return t[0] / r ** t[1] * t[2] ** r
    if law == "sigurd":
        return (1 - t[0]) * t[0] ** (r - 1) / (1 - t[0] ** n)
    return (math.log(n + 1) - np.log(r)) / n


def _blocks(f: np.ndarray):
    for at in range(0, len(f), BLOCK):
        yield np.arange(at + 1, min(at + BLOCK, len(f)) + 1, dtype=float), f[at : at + BLOCK]


def _error(law: str, t: np.ndarray, f: np.ndarray) -> float:
    return sum(float(((part - predicted(law, t, r, len(f))) ** 2).sum()) for r, part in _blocks(f))


def log_r2(law: str, t: list[float], f: np.ndarray) -> float:
    """R2 of the logarithms, where both are positive."""
    n, total, squares, off = 0, 0.0, 0.0, 0.0
    for r, part in _blocks(np.sort(np.asarray(f, float))[::-1]):
        p = predicted(law, np.asarray(t), r, len(f))
        seen = (part > 0) & (p > 0)
        log = np.log(part[seen])
        n, total, squares, off = n + len(log), total + log.sum(), squares + (log**2).sum(), off + ((log - np.log(p[seen])) ** 2).sum()
    spread = squares - total**2 / n if n else 0.0
    return float(1 - off / spread) if spread > 1e-12 else float("nan")


def rank_law_fits(freqs: list[float], steps: int = 200) -> dict[str, tuple[list[float], float]]:
    """Fits of four rank laws to falling relative frequencies by damped Gauss-Newton steps, with R2; the last has no parameters."""
    f = np.sort(np.asarray(freqs, float))[::-1]
    spread = float(((f - f.mean()) ** 2).sum()) or 1.0
    out: dict[str, tuple[list[float], float]] = {}
    for law, (start, least, most) in LAWS.items():
        t, damp = np.array(start(f[0]), float), 1e-3
        best = _error(law, t, f)
        for _ in range(steps if len(t) else 0):
            left, right = np.zeros((len(t), len(t))), np.zeros(len(t))
            for r, part in _blocks(f):
                base = predicted(law, t, r, len(f))
                slopes = np.stack([(predicted(law, t + h, r, len(f)) - predicted(law, t - h, r, len(f))) / 2e-6 for h in np.eye(len(t)) * 1e-6], axis=1)
                left += slopes.T @ slopes
                right += slopes.T @ (part - base)
            now = np.clip(t + np.linalg.solve(left + damp * np.diag(np.diag(left) + 1e-12), right), least, most)
            error = _error(law, now, f)
            if np.isfinite(error) and error < best:
                done = best - error <= 1e-15 * best
                t, best, damp = now, error, damp / 3
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e12:
                    break
        out[law] = (t.tolist(), 1 - best / spread)
    return out


def rank_laws(counts: DataFrame, group: str) -> DataFrame:
    """(group, law, parameters, r2, r2_log), fitted to all ranks of each group.

    What comes to a group's task are its different counts and how many symbols have each; ranks are summed in blocks.
    """
    equal = counts.groupBy(group, "n").agg(F.count("*").alias("types"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", ascending=False)
        f = np.repeat(rows["n"].to_numpy(float) / float((rows["n"] * rows["types"]).sum()), rows["types"])
        fits = rank_law_fits(f)
        return pd.DataFrame({group: rows[group].iloc[0], "law": list(fits), "parameters": [t for t, _ in fits.values()], "r2": [r for _, r in fits.values()], "r2_log": [log_r2(k, t, f) for k, (t, _) in fits.items()]})

    return equal.groupBy(group).applyInPandas(fit, f"{group} string, law string, parameters array<double>, r2 double, r2_log double")


#: Rows of sequences of one length that one task shuffles as a whole; of more, a task shuffles two places at a time.
WHOLE = 1 << 20
#: Rows of counts that a job makes at most, if a draw makes no more.
COUNTED = 20_000_000
_PAIR = "draw long, prev string, sym string, n long"
_PAIR_ARROW = pa.schema([("draw", pa.int64()), ("prev", pa.string()), ("sym", pa.string()), ("n", pa.int64())])


def permutation_null(rows: DataFrame, key: str, pos: str, symbol: str, draws: int = 200, seed: int = 11) -> DataFrame:
    """One row: observed mutual information of adjacent symbols, its null by shuffles, and p = (1 + #>=) / (1 + draws).

    A draw shuffles symbols among sequences of one length at one place: each draw is a random order within (length,
    place), by hashes.  Rows are dealt by length, and all draws are gone through where they lie, so that only counts of
    neighbours leave a task.  Where these are many, several jobs share the draws.
    """
    spark = rows.sparkSession
    base = cut(_placed(rows, key, pos, symbol))
    dealt = _grouped(base).repartition("grp").sortWithinPartitions("grp", "k", "pos").select("grp", "pos", "follows", F.xxhash64("k", "pos").alias("mark"), "sym")
    seen = base.agg(F.count("*").alias("n"), F.countDistinct("sym").alias("symbols"), F.countDistinct("len").alias("lengths")).first()
    at_once = max(1, min(draws + 1, COUNTED // max(1, min(seen.n, (seen.symbols + 1) ** 2 * seen.lengths))))
    found: list[tuple] = []
    for first in range(0, draws + 1, at_once):
        counts = dealt.mapInArrow(partial(_shuffled_pairs, draws=range(first, min(first + at_once, draws + 1)), seed=seed), _PAIR)
        with swept(spark):
            found += [tuple(r) for r in _information(counts.groupBy("draw", "prev", "sym").agg(F.sum("n").cast("double").alias("n"))).collect()]
    dropped(base)
    mi = spark.createDataFrame(found, "draw long, mi double")
    seen = mi.filter("draw = 0").select(F.col("mi").alias("observed"))
    null = mi.filter("draw > 0").crossJoin(F.broadcast(seen))
    return null.groupBy("observed").agg(F.avg("mi").alias("null_mean"), F.stddev_pop("mi").alias("null_sd"), ((1 + F.sum((F.col("mi") >= F.col("observed")).cast("int"))) / (1 + F.count("*"))).alias("p_value"))


def _placed(rows: DataFrame, key: str, pos: str, symbol: str) -> DataFrame:
    """(k, len, pos, before, sym): each symbol with its sequence's length and the place before it."""
    length = F.count("*").over(Window.partitionBy(key))
    base = rows.select(F.col(key).alias("k"), F.col(pos).alias("pos"), F.col(symbol).cast("string").alias("sym"), length.alias("len")).filter("pos is not null")
    before = F.lag("pos").over(Window.partitionBy("k").orderBy("pos"))
    return base.select("k", "len", "pos", before.alias("before"), "sym")


def _grouped(base: DataFrame) -> DataFrame:
    """(grp, k, pos, follows, sym): the rows of a length are a group, or those of two neighbouring places where they are many.

    ``follows``: its pair with the row before it, of the same sequence, is counted in this group.
    """
    sizes = base.groupBy("len").agg((F.count("*") > WHOLE).alias("many"))
    base = base.join(sizes, "len")
    whole = base.filter("not many").select(F.col("len").alias("grp"), "k", "pos", F.col("before").isNotNull().alias("follows"), "sym")
    many = base.filter("many")
    pairs = many.filter("before is not null").select("len", F.col("before").alias("low"), F.col("pos").alias("high")).distinct()
    places = pairs.select("len", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("pos"))
    here = F.coalesce((F.col("before") == F.col("low")) & (F.col("pos") == F.col("high")), F.lit(False))
    return whole.unionByName(many.join(places, ["len", "pos"]).select(F.xxhash64("len", "low", "high").alias("grp"), "k", "pos", here.alias("follows"), "sym"))


def _information(pairs: DataFrame) -> DataFrame:
    """(draw, mi) from (draw, prev, sym, n)."""
    x, y, all_ = Window.partitionBy("draw", "prev"), Window.partitionBy("draw", "sym"), Window.partitionBy("draw")
    total = F.sum("n").over(all_)
    part = F.col("n") / total * F.log2(F.col("n") * total / (F.sum("n").over(x) * F.sum("n").over(y)))
    return pairs.select("draw", part.alias("part")).groupBy("draw").agg(F.sum("part").alias("mi"))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def _ended(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def draw_hashes(marks: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for columns hashed to ``marks`` so far, then a long ``draw`` and an int ``seed``."""
    with np.errstate(over="ignore"):
        one = _turned(np.array([draw], np.int64).view(np.uint64) * _P2, 31) * _P1
        h = _ended(_turned((marks.view(np.uint64) + (_P5 + np.uint64(8))) ^ one, 27) * _P1 + _P4)
        two = np.uint64(seed & 0xFFFFFFFF) * _P1
        return _ended(_turned((h + (_P5 + np.uint64(4))) ^ two, 23) * _P2 + _P3).view(np.int64)


def _shuffled_pairs(batches: Iterator[pa.RecordBatch], draws: range, seed: int) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by group, sequence and place; holds a group's.  (draw, prev, sym, n): its neighbours in each draw."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        if held and held[-1].column(0)[0].as_py() != group[0]:
            yield from _group_pairs(held, draws, seed)
            held = []
        for start, stop in zip(edges, edges[1:], strict=False):
            if start:
                yield from _group_pairs(held, draws, seed)
                held = []
            held.append(batch.slice(start, stop - start))
    if held:
        yield from _group_pairs(held, draws, seed)


def _group_pairs(held: list[pa.RecordBatch], draws: range, seed: int) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks()
    names = rows.column("sym").combine_chunks().dictionary_encode()
    v = len(names.dictionary) + 1
    place, marks = rows.column("pos").to_numpy(), rows.column("mark").to_numpy()
    codes = names.indices.fill_null(v - 1).to_numpy(zero_copy_only=False)  # a null is the last
    order = np.argsort(place, kind="stable")
    went = np.empty(len(order), np.int64)
    went[order] = np.arange(len(order))
    later = np.flatnonzero(rows.column("follows").to_numpy())
    left, right = went[later - 1], went[later]
    place, marks, codes = place[order], marks[order], codes[order].astype(np.int64)
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    sizes = np.diff(np.append(starts, len(place)))
    known = pa.array([*names.dictionary.to_pylist(), None], pa.string())
    for draw in draws:
        dealt = codes
        if draw:
            h = draw_hashes(marks, draw, seed)
            if (sizes == sizes[0]).all():
                dealt = np.take_along_axis(codes.reshape(len(sizes), -1), np.argsort(h.reshape(len(sizes), -1), axis=1, kind="stable"), axis=1).ravel()
            else:
                dealt = np.concatenate([codes[a : a + n][np.argsort(h[a : a + n], kind="stable")] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        cells = dealt[left] * v + dealt[right]
        if v * v <= 1 << 16:
            n = np.bincount(cells, minlength=v * v)
            cells = np.flatnonzero(n)
            n = n[cells]
        else:
            cells, n = np.unique(cells, return_counts=True)
        seen = cells // v < v - 1
        cells, n = cells[seen], n[seen]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), draw, np.int64)), known.take(pa.array(cells // v)), known.take(pa.array(cells % v)), pa.array(n.astype(np.int64))], schema=_PAIR_ARROW)
