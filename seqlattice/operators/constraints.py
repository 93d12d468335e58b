"""Weighted constraints over words: violations, harmony, fitted weights, and tests against random words."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.inventory import CONSTRAINTS, CLASS_ORDER, encoded
from ..functions.patterns import compile_pattern
from ..functions.significance import binomial_p


def violations(code: Column, constraints: list[tuple[str, str, float]] = CONSTRAINTS) -> dict[str, Column]:
    """A count Column for each constraint, all in one scan."""
    return {name: compile_pattern(pattern).count(code).cast("long") for name, pattern, _ in constraints}


def harmony(counts: dict[str, Column], constraints: list[tuple[str, str, float]] = CONSTRAINTS) -> Column:
    """The weighted sum of violations; infinite where one of infinite weight is violated."""
    soft = sum((counts[n] * F.lit(w) for n, _, w in constraints if math.isfinite(w)), F.lit(0.0))
    hard = [counts[n] > 0 for n, _, w in constraints if not math.isfinite(w)]
    out = soft
    for h in hard:
        out = F.when(h, F.lit(float("inf"))).otherwise(out)
    return out


def explained(counts: dict[str, Column], constraints: list[tuple[str, str, float]] = CONSTRAINTS) -> Column:
    """The violated constraints as an array of (name, violations, contribution), the greatest contribution first.

    A hard constraint contributes infinity; ties keep the order in which the constraints are declared.
    """
    rows = [F.struct((-F.when(counts[n] > 0, F.lit(w)).otherwise(0.0) * (F.lit(1) if math.isinf(w) else counts[n])).alias("less"), F.lit(i).alias("place"), F.lit(n).alias("name"), counts[n].alias("violations")) for i, (n, _, w) in enumerate(constraints)]
    seen = F.array_sort(F.filter(F.array(*rows), lambda x: x["violations"] > 0))
    return F.transform(seen, lambda x: F.struct(x["name"].alias("name"), x["violations"].alias("violations"), (-x["less"]).alias("contribution")))


def candidates() -> list[tuple[str, str, float]]:
    """Every pair of classes anywhere, at the start and at the end of a word."""
    return [(f"{a}{b}{edge}", f"*{'#' if edge == '<' else ''}[{a}][{b}]{'#' if edge == '>' else ''}", 1.0) for a in CLASS_ORDER for b in CLASS_ORDER for edge in ("", "<", ">")]


def totals(words: DataFrame, word: str, weight: str, constraints: list[tuple[str, str, float]]) -> DataFrame:
    """(name, violations, words): sums over all words of a table with a count, in one scan for all constraints."""
    counts = violations(encoded(F.col(word)), constraints)
    summed = words.agg(*(F.sum(c * F.col(weight)).alias(f"v{i}") for i, c in enumerate(counts.values())), *(F.sum(F.when(c > 0, F.col(weight)).otherwise(0)).alias(f"w{i}") for i, c in enumerate(counts.values())))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"v{i}").alias("violations"), F.col(f"w{i}").alias("words")) for i, n in enumerate(counts)))
    return summed.select(F.inline(rows))


def fit_weights(seen: np.ndarray, weight: np.ndarray, sampled: np.ndarray, l2: float = 1.0, steps: int = 400, many: np.ndarray | None = None) -> np.ndarray:
    """MaxEnt weights, not negative, of violation vectors (rows) against those of random words: projected Newton steps.

    ``many`` says how often each random vector was drawn; once each if it isn't given.
    """
    n, k = float(weight.sum()), seen.shape[1]
    many = np.ones(len(sampled)) if many is None else many
    mean = (seen * weight[:, None]).sum(axis=0) / n
    w = np.zeros(k)
    for _ in range(steps):
        logs = -sampled @ w
        p = many * np.exp(logs - logs.max())
        p /= p.sum()
        expected = p @ sampled
        grad = n * (mean - expected) + l2 * w
        centred = sampled - expected
        hess = n * (centred.T * p) @ centred + l2 * np.eye(k)
        free = ~((w <= 0) & (grad > 0))
        if not free.any() or np.abs(grad[free]).max() < 1e-9 * max(1.0, n):
            break
        step = np.zeros(k)
        step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
        scale = 1.0
        value = n * (mean @ w) + n * _log_z(sampled, w, many) + l2 / 2 * w @ w
        while scale > 1e-6:
            now = np.maximum(w - scale * step, 0)
            if n * (mean @ now) + n * _log_z(sampled, now, many) + l2 / 2 * now @ now <= value + 1e-12:
                break
            scale /= 2
        if np.abs(now - w).max() < 1e-12:
            break
        w = now
    return w


def _log_z(sampled: np.ndarray, w: np.ndarray, many: np.ndarray) -> float:
    logs = -sampled @ w
    return float(logs.max() + np.log((many * np.exp(logs - logs.max())).sum() / many.sum()))


def grouped_vectors(words: DataFrame, word: str, weight: str | None, constraints: list[tuple[str, str, float]], most: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Distinct violation vectors with their weight: what the driver fits is bounded by the number of vectors."""
    counts = violations(encoded(F.col(word)), constraints)
    grouped = words.select(F.array(*counts.values()).alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")).groupBy("v").agg(F.sum("w").alias("w"))
    rows = grouped.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct violation vectors; fit fewer constraints at once")
    return np.array([r.v for r in rows], float).reshape(len(rows), len(constraints)), np.array([r.w for r in rows], float)


def maxent(words: DataFrame, word: str, weight: str, samples: DataFrame, sample: str, constraints: list[tuple[str, str, float]], l2: float = 1.0) -> DataFrame:
    """(name, weight) fitted on all words against random ones."""
    seen, w = grouped_vectors(words, word, weight, constraints)
    drawn, many = grouped_vectors(samples, sample, None, constraints)
    fitted = fit_weights(seen, w, drawn, l2, many=many)
    return words.sparkSession.createDataFrame([(n, float(x)) for (n, _, _), x in zip(constraints, fitted, strict=True)], "name string, weight double")


Histogram = dict[tuple[tuple[int, ...], int, bool], int]


def count_histograms(words: DataFrame, word: str, weight: str, constraints: list[tuple[str, str, float]], grammar: list[tuple[str, str, float]] = (), most: int = 10_000) -> dict[str, Histogram]:
    """Of each constraint how many words have which violations: of the grammar's soft constraints, of it, and whether of a hard one.

    One scan serves all constraints; the driver gets a row for each distinct violation of each, ``most`` for each at most.
    """
    counts = violations(encoded(F.col(word)), [*grammar, *(("+" + n, p, w) for n, p, w in constraints)])
    soft = F.array(*(counts[n] for n, _, w in grammar if math.isfinite(w))).cast("array<long>")
    hard = F.lit(False)
    for n, _, w in grammar:
        hard = hard | (counts[n] > 0) if math.isinf(w) else hard
    found = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), counts["+" + n].alias("v")) for n, _, _ in constraints)), lambda x: x["v"] > 0)
    every = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("v")))
    rows = words.select(F.col(weight).alias("w"), soft.alias("soft"), hard.alias("hard"), F.explode(F.concat(every, found)).alias("x"))
    grouped = rows.groupBy("x.name", "x.v", "soft", "hard").agg(F.sum("w").alias("w")).limit(most * (len(constraints) + 1) + 1).collect()
    if len(grouped) > most * (len(constraints) + 1):
        raise ValueError("too many distinct violations; take a smaller grammar")
    out: dict[str, Histogram] = {n: {(tuple(r.soft), 0, r.hard): r.w for r in grouped if r.name is None} for n, _, _ in constraints}
    for r in grouped:
        if r.name is not None:
            of, key = out[r.name], (tuple(r.soft), r.hard)
            of[key[0], r.v, key[1]] = r.w
            of[key[0], 0, key[1]] -= r.w
    return out


def log_likelihood(seen: np.ndarray, weight: np.ndarray, sampled: np.ndarray, many: np.ndarray, w: np.ndarray) -> float:
    """Mean log likelihood of words under weights, against random words; what both have in common is left out."""
    logs = -sampled @ w
    log_z = logs.max() + np.log((many * np.exp(logs - logs.max())).sum() / many.sum())
    return float(-(weight * (seen @ w)).sum() / weight.sum() - log_z)


#: Fixed values: (verdict, p below, ratio above, ratio below), the first that holds; none is "indistinct".
VERDICTS = [("avoided", 0.01, None, 0.5), ("weakly avoided", 0.05, None, 0.8), ("preferred", 0.01, 1.5, None)]
#: Expected at least so often, and never seen: "absolute".
NEVER = 3


def verdict(observed: float, expected: float, p: float) -> str:
    """What the numbers say of a candidate."""
    if observed == 0 and expected >= NEVER:
        return "absolute"
    ratio = observed / expected if expected > 0 else math.nan
    holds = (name for name, most_p, above, below in VERDICTS if p < most_p and (above is None or ratio > above) and (below is None or ratio < below))
    return next((name for name in holds if not math.isnan(ratio)), "indistinct")


def evaluated(words: DataFrame, word: str, weight: str, samples: DataFrame, sample: str, constraints: list[tuple[str, str, float]], l2: float = 0.01, grammar: list[tuple[str, str, float]] = (), seen: dict[str, Histogram] | None = None) -> DataFrame:
    """(name, observed, expected, oe, words_seen, words_expected, log_odds, p_value, gain, verdict) of each candidate, best gain first.

    ``gain`` is what the constraint adds to the mean log likelihood of ``grammar`` as declared, when all soft weights are
    fitted anew with it.  Random words that violate a hard constraint have no part in the likelihoods, though in the fit.
    The driver holds, of each candidate, how many words have which violations; ``seen`` are those of the words, where
    they are known from an evaluation against other samples.
    """
    spark = words.sparkSession
    seen = seen or count_histograms(words, word, weight, constraints, grammar)
    drawn = count_histograms(samples.withColumn("__w", F.lit(1).cast("long")), sample, "__w", constraints, grammar)
    n, m = words.agg(F.sum(weight)).first()[0] or 0, max(1, samples.count())
    base = np.array([w for _, _, w in grammar if math.isfinite(w)] + [0.0])
    rows = []
    for name, _, _ in constraints:
        o, e = (sum(v * w for (_, v, _), w in of[name].items()) for of in (seen, drawn))
        wo, we = (sum(w for (_, v, _), w in of[name].items() if v) for of in (seen, drawn))
        e, rate = e / m * n, we / m
        odds = math.log(((wo + 0.5) / (n - wo + 0.5)) / ((rate * n + 0.5) / (n - rate * n + 0.5)))
        p = binomial_p(wo, n, rate)
        (a, wa, _), (b, wb, legal) = (_vectors(of[name], len(base)) for of in (seen, drawn))
        gain = 0.0
        if n and len(b) and legal.any():
            fitted = fit_weights(a, wa, b, l2, many=wb)
            gain = log_likelihood(a, wa, b[legal], wb[legal], fitted) - log_likelihood(a, wa, b[legal], wb[legal], base)
        rows.append((name, int(o), float(e), float(o / e) if e else None, int(wo), float(rate * n), odds, p, gain, verdict(o, e, p)))
    schema = "name string, observed long, expected double, oe double, words_seen long, words_expected double, log_odds double, p_value double, gain double, verdict string"
    return spark.createDataFrame(sorted(rows, key=lambda r: -r[8]), schema)


def _vectors(histogram: Histogram, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Violation vectors (the grammar's soft constraints, the candidate), their weights, and which violate no hard constraint."""
    rows = [((*soft, v), w, not hard) for (soft, v, hard), w in sorted(histogram.items()) if w]
    return np.array([r[0] for r in rows], float).reshape(len(rows), size), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], bool)
