"""Ranked search over entries, neighbours by edit distance, differences between versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score(entry: Column, texts: Column, needle: str) -> Column:
    """100, 60 or 40 where the entry is, begins with or holds the needle; 80 or 30 where a text is or holds it."""
    e, n = F.lower(entry), needle.lower()
    on_entry = F.when(e == n, 100).when(F.startswith(e, F.lit(n)), 60).when(F.contains(e, F.lit(n)), 40).otherwise(0)
    on_texts = F.when(F.exists(texts, lambda t: F.lower(t) == n), 80).when(F.exists(texts, lambda t: F.contains(F.lower(t), F.lit(n))), 30).otherwise(0)
    return on_entry + on_texts


def search(rows: DataFrame, key: str, entry: str, texts: Column, needles: list[str], limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of the rows that hold every needle, best first: key, entry, score, n_matches.

    The page is a top-k (at most 100 rows behind the offset); the number of matches is one more aggregate.
    """
    blob = F.lower(F.concat_ws("\n", F.col(entry), texts))
    hit = rows.select(F.col(key), F.col(entry), texts.alias("__texts"), blob.alias("__blob"))
    total = F.lit(0)
    for needle in needles:
        hit = hit.filter(F.contains("__blob", F.lit(needle.lower())))
        total = total + score(F.col(entry), F.col("__texts"), needle)
    found = hit.select(key, entry, total.alias("score"))
    page = found.orderBy(F.desc("score"), key).offset(max(0, offset)).limit(max(1, min(limit, 100)))
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("n_matches"))))


def distance_limit(left: Column, right: Column) -> Column:
    """The greatest distance of similar forms: a quarter of the longer one's length, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.greatest(F.length(left), F.length(right)) / 4)).cast("int")


def deletions(form: Column) -> Column:
    """The form and what is left of it without one character."""
    cut = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.concat(F.substring(form, 1, 0), form.substr(F.lit(1), i - 1), form.substr(i + 1, F.length(form))))
    return F.array_distinct(F.array_append(cut, form))


def neighbours(left: DataFrame, right: DataFrame, form: str = "form") -> DataFrame:
    """(x, y, distance) of distinct forms at most one edit apart: equal after one deletion on either side or none.

    An equi-join on deletion keys and one exact check; a frequent key only meets forms that differ in one place.
    """
    a = left.select(F.col(form).alias("x")).distinct().select("x", F.explode(deletions(F.col("x"))).alias("k"))
    b = right.select(F.col(form).alias("y")).distinct().select("y", F.explode(deletions(F.col("y"))).alias("k"))
    pairs = a.join(b, "k").filter("x <> y").select("x", "y").distinct()
    return pairs.select("x", "y", F.levenshtein("x", "y", 1).alias("distance")).filter("distance >= 0")


def similar_pairs(forms: DataFrame, form: str = "form") -> DataFrame:
    """(x, y, distance) with x < y of distinct forms within ``distance_limit`` of one another.

    The limit m of a pair hangs on its longer form only.  That form is cut into m + 1 pieces, of which m edits leave one
    whole, at most m places away in the other: an equi-join on longer length, piece and place, and one exact check.
    """
    known = forms.select(F.col(form).alias("form")).filter("form is not null").distinct().withColumn("n", F.length("form"))
    limit = lambda n: F.greatest(F.lit(1), F.floor(n / 4)).cast("int")
    cut = lambda n, k: F.floor(k * n / (limit(n) + 1)).cast("int")  # noqa: E731  where piece k begins
    one = known.select(F.col("form").alias("long"), F.col("n").alias("size"), F.explode(F.sequence(F.lit(0), limit(F.col("n")))).alias("k"))
    begin, end = cut(F.col("size"), F.col("k")), cut(F.col("size"), F.col("k") + 1)
    one = one.select("long", "size", "k", F.col("long").substr(begin + 1, end - begin).alias("piece"))
    # longer lengths that a form may meet: size - n <= limit(size), so size <= 4 n / 3 + 1
    other = known.select(F.col("form").alias("short"), "n", F.explode(F.sequence(F.col("n"), F.floor(F.col("n") * 4 / 3).cast("int") + 1)).alias("size")).filter(F.col("size") - F.col("n") <= limit(F.col("size")))
    other = other.select("short", "n", "size", F.explode(F.sequence(F.lit(0), limit(F.col("size")))).alias("k"))
    begin, end = cut(F.col("size"), F.col("k")), cut(F.col("size"), F.col("k") + 1)
    other = other.select("short", "n", "size", "k", (end - begin).alias("wide"), F.explode(F.sequence(begin - limit(F.col("size")), begin + limit(F.col("size")))).alias("at"))
    other = other.filter((F.col("at") >= 0) & (F.col("at") + F.col("wide") <= F.col("n"))).select("short", "size", "k", F.col("short").substr(F.col("at") + 1, F.col("wide")).alias("piece")).distinct()
    pairs = one.join(other, ["size", "k", "piece"]).filter("long <> short").select(F.least("long", "short").alias("x"), F.greatest("long", "short").alias("y")).distinct()
    return pairs.select("x", "y", F.levenshtein("x", "y").alias("distance")).filter(F.col("distance") <= distance_limit(F.col("x"), F.col("y")))


def similar_to(rows: DataFrame, entry: str, queries: list[str]) -> DataFrame:
    """(query, form, distance) of forms within ``distance_limit`` of a few given ones; the scan is cut by length first."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(q.lower(),) for q in queries], "query string")
    forms = rows.select(F.lower(F.col(entry)).alias("form")).distinct()
    pairs = forms.join(F.broadcast(asked), (F.col("form") != F.col("query")) & (F.abs(F.length("form") - F.length("query")) <= distance_limit(F.col("form"), F.col("query"))))
    return pairs.select("query", "form", F.levenshtein("query", "form").alias("distance"), distance_limit(F.col("form"), F.col("query")).alias("most")).filter("distance <= most").drop("most")


def difference(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, fields): add, delete or update, with the names of the fields that differ."""
    b = before.select(F.col(key), F.struct(*fields).alias("b"))
    a = after.select(F.col(key), F.struct(*fields).alias("a"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields)))
    joined = b.join(a, key, "full").select(key, F.when(F.col("b").isNull(), "add").when(F.col("a").isNull(), "delete").when(F.size(changed) > 0, "update").alias("change"), F.when(F.col("b").isNotNull() & F.col("a").isNotNull(), changed).alias("fields"))
    return joined.filter("change is not null")


def best(rows: DataFrame, group: str, vector: list[str]) -> DataFrame:
    """The rows of each group with the lexicographically least vector, ties kept."""
    return rows.withColumn("__r", F.rank().over(Window.partitionBy(group).orderBy(*vector))).filter("__r = 1").drop("__r")
