"""Queries over the event, conversation, order and label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import distributions, monotone, ngrams
from ..sources.storage import cut
from ..sources.tables import table

_GRAMS = """
seqs AS (SELECT user_id, event_type AS sym, row_number() OVER w AS pos, lag(event_type) OVER w AS prev, lead(event_type) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
grams AS (SELECT user_id, pos, coalesce(prev, '<s>') AS x, sym AS y FROM seqs UNION ALL SELECT user_id, pos + 1, sym, '</s>' FROM seqs WHERE nxt IS NULL),
counts AS (SELECT x, y, count(*) AS n FROM grams GROUP BY x, y),
cx AS (SELECT x, sum(n) AS nx FROM counts GROUP BY x), cy AS (SELECT y, sum(n) AS ny FROM counts GROUP BY y),
total AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM counts), size AS (SELECT count(*) AS v FROM cy)
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")


def _bigrams(spark: SparkSession, sf_dir: str, n: int = 2) -> DataFrame:
    """The counts, written: several branches of a query read them."""
    return cut(ngrams.ordered_ngram_counts(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type", n))


def bigram_pmi_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _bigrams(spark, sf_dir)
    p = ngrams.probabilities(counts).select("ctx", "sym", F.round("p", 6).alias("p_smooth"))
    return ngrams.pmi(counts).join(p, ["ctx", "sym"]).select(F.col("ctx")[0].alias("x"), F.col("sym").alias("y"), "n", F.round("pmi", 6).alias("pmi"), "p_smooth")


def event_transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = ngrams.transition_matrix(_bigrams(spark, sf_dir))
    return matrix.select(F.col("ctx")[0].alias("x"), F.col("sym").alias("y"), "n", F.round("p_smooth", 6).alias("p_smooth"), F.round("p_raw", 6).alias("p_raw"))


def event_entropy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngrams.entropies(_bigrams(spark, sf_dir))
    sequences = _events(spark, sf_dir).agg(F.countDistinct("user_id").alias("n_sequences"))
    return out.crossJoin(sequences).select("n_sequences", "vocab", "n_grams_seen", *(F.round(c, 4).alias(c) for c in ("h", "h_cond", "mi", "redundancy")))


def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngrams.gaps(_bigrams(spark, sf_dir, 3), 0.5)
    return found.select(F.concat_ws(" ", "ctx").alias("ctx"), F.col("sym").alias("sym"), F.round("expected", 2).alias("expected"))


def event_sequence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = ngrams.long_grams(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")
    return ngrams.scored(grams, "user_id", _bigrams(spark, sf_dir)).select("user_id", "n_grams", F.round("log2_p", 4).alias("log2_p"), F.round("normalised", 6).alias("normalised"))


def event_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = ngrams.long_grams(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")
    scores = ngrams.scored(grams, "user_id", _bigrams(spark, sf_dir))
    summary = distributions.score_summary(scores, "normalised")
    return summary.select(F.col("n").alias("n"), *(F.round(c, 6).alias(c) for c in summary.columns if c != "n"))


def event_weakest_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = ngrams.long_grams(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")
    p = ngrams.probabilities(_bigrams(spark, sf_dir)).select("ctx", "sym", F.log2("p").alias("log_p"))
    rows = grams.join(p, ["ctx", "sym"])
    least = F.min(F.struct(F.round("log_p", 9).alias("log_p"), "pos", F.col("ctx")[0].alias("x"), F.col("sym").alias("y"))).alias("m")
    return rows.groupBy("user_id").agg(least).select("user_id", F.col("m.pos").alias("pos"), F.col("m.x").alias("x"), F.col("m.y").alias("y"), F.round("m.log_p", 6).alias("log_p"))


def event_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.distribution(table(spark, sf_dir, "events"), F.col("event_type")).select("symbol", "n", F.round("freq", 6).alias("freq"))


def event_positional_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = _events(spark, sf_dir).select(back.alias("pos"), "event_type")
    return ngrams.positional_distribution(rows, F.col("pos"), F.col("event_type")).select("pos", "symbol", "n", F.round("freq", 6).alias("freq"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 86_400.0).select("user_id", F.col("session").cast("long").alias("session"), "n", "start", "stop")


def event_value_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median_value"), F.round(F.percentile("value", F.lit(0.05)), 6).alias("p5"), F.round(F.stddev_pop("value"), 6).alias("sd"))


def role_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ngrams.ordered_ngram_counts(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "text"], "role")
    return ngrams.probabilities(counts).join(ngrams.contexts(counts).drop("n_ctx"), "ctx").select(F.col("ctx")[0].alias("x"), F.col("sym").alias("y"), "n", F.round(F.col("n") / F.col("n_ctx"), 6).alias("p_raw"), F.round("p", 6).alias("p_smooth"))


def role_length_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    size = F.when(F.length("text") < 100, "short").when(F.length("text") < 400, "middle").otherwise("long")
    return ngrams.cooccurrence(rows, F.col("role"), size, 2)


def flag_cooccurrence_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ngrams.cooccurrence(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_linestatus"))
    return ngrams.chi_square(cells).select(F.round("chi2", 4).alias("chi2"), "dof", F.round("cramers_v", 6).alias("cramers_v"), "n_total")


def label_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    cells = ngrams.cooccurrence(rows, F.col("quality"), F.col("toxic"))
    return ngrams.chi_square(cells).select(F.round("chi2", 4).alias("chi2"), "dof", F.round("cramers_v", 6).alias("cramers_v"), "n_total")


def segment_priority_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return rows.cube("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("long").alias("level"))


def permutation_null_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _events(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return distributions.permutation_null(rows, "user_id", "pos", "event_type")


def rank_laws_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))
    return distributions.rank_laws(rows.groupBy(F.lit("events").alias("unit"), "symbol").agg(F.sum("n").alias("n")), "unit")


def utterance_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's purchases, sized by value, aligned in order with the spans of their views and clicks: by how many spans
    each purchase takes, and how many spans are left out."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.coalesce("value", F.lit(0.0)).alias("value"), (F.unix_micros(F.col("ts").cast("timestamp")) / 6e8).alias("at"))
    by = Window.partitionBy("user_id").orderBy("at", "event_id")
    items = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.row_number().over(by).alias("place"), (1 + F.floor(F.abs("value")) % 5).alias("size"))
    heard = events.filter("event_type in ('view', 'click')").select(F.col("user_id").alias("key"), F.col("at").alias("start"), (F.col("at") + F.abs("value") / 100).alias("stop"))
    found = monotone.aligned(items, heard)
    took = F.when(F.col("item").isNull(), 0).otherwise(F.coalesce(F.col("last") - F.col("first") + 1, F.lit(-1)))
    return found.groupBy("key", took.cast("long").alias("took")).agg(F.count("*").alias("n"), F.sum("first").alias("places"))


QUERIES = {f.__name__: f for f in (
    bigram_pmi_events, event_transition_matrix, event_entropy_summary, event_gaps, event_sequence_score, event_score_summary, event_weakest_transition, event_distribution, event_positional_dist,
    event_sessions, event_value_by_type, role_transition, role_length_cooccurrence, flag_cooccurrence_chi2, label_cooccurrence, segment_priority_grouping, permutation_null_mi, rank_laws_events, utterance_alignment,
)}

_SCORES = f"""WITH {_GRAMS},
p AS (SELECT x, y, (n + 0.1) / (nx + 0.1 * v) AS p FROM counts JOIN cx USING (x), size),
scores AS (SELECT user_id, count(*) AS n_grams, sum(log2(CAST(p AS DOUBLE))) AS log2_p FROM grams JOIN p USING (x, y) GROUP BY user_id)
"""


def _chi(cells: str) -> str:
    return f"""
WITH t AS ({cells}), sx AS (SELECT x, sum(n) AS a FROM t GROUP BY x), sy AS (SELECT y, sum(n) AS b FROM t GROUP BY y),
cells AS (SELECT coalesce(t.n, 0) AS n, CAST(a * b AS DOUBLE) / (SELECT sum(n) FROM t) AS e FROM sx CROSS JOIN sy LEFT JOIN t ON t.x = sx.x AND t.y = sy.y),
d AS (SELECT (SELECT count(*) FROM sx) AS r, (SELECT count(*) FROM sy) AS c),
s AS (SELECT sum(CASE WHEN (r - 1) * (c - 1) = 1 THEN power(abs(n - e) - least(0.5, abs(n - e)), 2) ELSE power(n - e, 2) END / e) AS chi2, sum(n) AS n_total FROM cells, d)
SELECT round(chi2, 4) AS chi2, (r - 1) * (c - 1) AS dof, round(sqrt(chi2 / (n_total * (least(r, c) - 1))), 6) AS cramers_v, CAST(n_total AS BIGINT) AS n_total FROM s, d"""


ORACLES = {
    "bigram_pmi_events": f"WITH {_GRAMS} SELECT x, y, n, round(log2(n * t / (nx * ny)), 6) AS pmi, round(CAST((n + 0.1) / (nx + 0.1 * v) AS DOUBLE), 6) AS p_smooth FROM counts JOIN cx USING (x) JOIN cy USING (y), total, size",
    "event_transition_matrix": f"WITH {_GRAMS} SELECT cx.x, cy.y, coalesce(n, 0) AS n, round(CAST((coalesce(n, 0) + 0.1) / (nx + 0.1 * v) AS DOUBLE), 6) AS p_smooth, round(coalesce(n, 0) / CAST(nx AS DOUBLE), 6) AS p_raw FROM cx CROSS JOIN cy CROSS JOIN size LEFT JOIN counts c ON c.x = cx.x AND c.y = cy.y",
    "event_entropy_summary": f"""WITH {_GRAMS}, h AS (SELECT -sum(ny / t * log2(ny / t)) AS h, count(*) AS vocab FROM cy, total),
      hc AS (SELECT -sum(n / t * log2(CAST(n AS DOUBLE) / nx)) AS h_cond, count(*) AS n_grams_seen FROM counts JOIN cx USING (x), total)
      SELECT (SELECT count(DISTINCT user_id) FROM events) AS n_sequences, vocab, n_grams_seen, round(h, 4) AS h, round(h_cond, 4) AS h_cond, round(h - h_cond, 4) AS mi, round((h - h_cond) / h, 4) AS redundancy FROM h, hc""",
    "event_gaps": """WITH seqs AS (SELECT user_id, event_type AS sym, lag(event_type, 2) OVER w AS p2, lag(event_type) OVER w AS p1, lead(event_type) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      grams AS (SELECT coalesce(p2, '<s>') || ' ' || coalesce(p1, '<s>') AS x, sym AS y FROM seqs UNION ALL SELECT coalesce(p1, '<s>') || ' ' || sym, '</s>' FROM seqs WHERE nxt IS NULL),
      counts AS (SELECT x, y, count(*) AS n FROM grams GROUP BY x, y), cx AS (SELECT x, sum(n) AS nx FROM counts GROUP BY x), cy AS (SELECT y, sum(n) AS ny FROM counts GROUP BY y)
      SELECT cx.x AS ctx, cy.y AS sym, round(CAST(nx * ny AS DOUBLE) / (SELECT sum(n) FROM counts), 2) AS expected FROM cx CROSS JOIN cy WHERE NOT EXISTS (SELECT 1 FROM counts c WHERE c.x = cx.x AND c.y = cy.y) AND CAST(nx * ny AS DOUBLE) / (SELECT sum(n) FROM counts) >= 0.5""",
    "event_sequence_score": _SCORES + "SELECT user_id, n_grams, round(log2_p, 4) AS log2_p, round(log2_p / n_grams, 6) AS normalised FROM scores",
    "event_score_summary": _SCORES + ", s AS (SELECT log2_p / n_grams AS z FROM scores) SELECT count(*) AS n, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS sd, " + ", ".join(f"round(list_reverse_sort(list(z))[CAST(floor(count(*) * {q}) AS BIGINT) + 1], 6) AS q{round(100 * q)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM s",
    "event_weakest_transition": _SCORES + ", r AS (SELECT user_id, pos, x, y, round(log2(CAST(p AS DOUBLE)), 9) AS lp, row_number() OVER (PARTITION BY user_id ORDER BY round(log2(CAST(p AS DOUBLE)), 9), pos) AS k FROM grams JOIN p USING (x, y)) SELECT user_id, pos, x, y, round(lp, 6) AS log_p FROM r WHERE k = 1",
    "event_distribution": "SELECT event_type AS symbol, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS freq FROM events GROUP BY event_type",
    "event_positional_dist": "WITH r AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos, event_type AS symbol FROM events) SELECT pos, symbol, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY pos) AS DOUBLE), 6) AS freq FROM r GROUP BY pos, symbol",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 86400 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
      SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS start, max(ts) AS stop FROM s GROUP BY user_id, session""",
    "event_value_by_type": "SELECT event_type, count(*) AS n, round(median(value), 6) AS median_value, round(quantile_cont(value, 0.05), 6) AS p5, round(stddev_pop(value), 6) AS sd FROM events GROUP BY event_type",
    "role_transition": """WITH q AS (SELECT conv_id, role, lag(role) OVER w AS prev, lead(role) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
      g AS (SELECT coalesce(prev, '<s>') AS x, role AS y FROM q UNION ALL SELECT role, '</s>' FROM q WHERE nxt IS NULL), c AS (SELECT x, y, count(*) AS n FROM g GROUP BY x, y)
      SELECT x, y, n, round(n / CAST(sum(n) OVER (PARTITION BY x) AS DOUBLE), 6) AS p_raw, round(CAST((n + 0.1) / (sum(n) OVER (PARTITION BY x) + 0.1 * (SELECT count(DISTINCT y) FROM c)) AS DOUBLE), 6) AS p_smooth FROM c""",
    "role_length_cooccurrence": """WITH r AS (SELECT role AS x, CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 400 THEN 'middle' ELSE 'long' END AS y FROM conversations),
      c AS (SELECT x, y, count(*) AS n FROM r GROUP BY x, y) SELECT a.x, b.y, CASE WHEN coalesce(c.n, 0) >= 2 THEN c.n ELSE 0 END AS n FROM (SELECT DISTINCT x FROM r) a CROSS JOIN (SELECT DISTINCT y FROM r) b LEFT JOIN c ON c.x = a.x AND c.y = b.y""",
    "flag_cooccurrence_chi2": _chi("SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "label_cooccurrence": _chi("SELECT quality AS x, toxic AS y, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2"),
    "segment_priority_grouping": "SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(grouping(c_mktsegment, o_orderpriority) AS BIGINT) AS level FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY CUBE (c_mktsegment, o_orderpriority)",
}
