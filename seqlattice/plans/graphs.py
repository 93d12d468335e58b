"""Queries over the customer, nation, region, supplier, part and embedding tables: graphs, search, similarity, changes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.inventory import DIGRAPHS, tokens
from ..operators import graph, mutations, search
from ..sources import versions
from ..sources.storage import shared_dir
from ..sources.tables import table, words_of
from .texts import _ALPHABET, _code


def geo_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entry, category) of the graph of places and their customers and suppliers."""
    parts = [("region", "r", "r_regionkey", "r_name"), ("nation", "n", "n_nationkey", "n_name"), ("customer", "c", "c_custkey", "c_name"), ("supplier", "s", "s_suppkey", "s_name")]
    rows = [table(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.col(n).alias("entry"), F.lit(t).alias("category")) for t, p, k, n in parts]
    root = spark.range(1).select(F.lit("root").alias("id"), F.lit("root").alias("entry"), F.lit("root").alias("category"))
    out = root
    for r in rows:
        out = out.unionByName(r)
    return out


def geo_covers(spark: SparkSession, sf_dir: str, shortcuts: bool = False) -> DataFrame:
    """(child, parent): region below root, nation below region, customer and supplier below nation.

    With ``shortcuts``, every fifth customer also stands directly below the region and the root.
    """
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")

    def edge(rows: DataFrame, child: Column, parent: Column) -> DataFrame:
        return rows.select(child.alias("child"), parent.alias("parent"))

    def key(prefix: str, column: str) -> Column:
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    out = edge(region, key("r", "r_regionkey"), F.lit("root")).unionByName(edge(nation, key("n", "n_nationkey"), key("r", "n_regionkey")))
    out = out.unionByName(edge(customer, key("c", "c_custkey"), key("n", "c_nationkey"))).unionByName(edge(supplier, key("s", "s_suppkey"), key("n", "s_nationkey")))
    if shortcuts:
        fifth = customer.filter(F.col("c_custkey") % 5 == 0).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        out = out.unionByName(edge(fifth, key("c", "c_custkey"), key("r", "n_regionkey"))).unionByName(edge(fifth, key("c", "c_custkey"), F.lit("root")))
    return out


def geo_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(geo_covers(spark, sf_dir)).select("child", "ancestor", F.col("depth").cast("long").alias("depth"))


def geo_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies above and below each node: how much, and the nearest five."""
    found = graph.contexts(graph.closure(geo_covers(spark, sf_dir)), 5)
    return found.select("node", "direction", "n", F.array_join("first", ",").alias("first"), "truncated")


def geo_redundant_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.redundant(geo_covers(spark, sf_dir, shortcuts=True))


def geo_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule violations of the graph with shortcuts once some nations are gone, which leaves references open."""
    words = geo_words(spark, sf_dir).filter(~(F.col("id").startswith("n") & (F.substring("id", 2, 9).try_cast("int") % 7 == 3)))
    return graph.issues(words, geo_covers(spark, sf_dir, shortcuts=True))


def geo_category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, covers = geo_words(spark, sf_dir), geo_covers(spark, sf_dir)
    roots = words.join(covers.select(F.col("child").alias("id")).distinct(), "id", "left_anti").groupBy("category").agg(F.count("*").alias("n_roots"))
    return words.groupBy("category").agg(F.count("*").alias("n")).join(roots, "category", "left").fillna(0, ["n_roots"])


def geo_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of each node by kind, with the node's entry; a reference without a word is marked missing."""
    words = geo_words(spark, sf_dir).select(F.col("id").alias("parent"), "entry")
    covers = geo_covers(spark, sf_dir)
    counted = covers.groupBy("parent", F.substring("child", 1, 1).alias("kind")).agg(F.count("*").alias("n"))
    return counted.join(words, "parent", "left").select("parent", "kind", "n", F.coalesce("entry", F.lit("?")).alias("entry"), F.col("entry").isNull().alias("missing"))


def geo_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes below two regions once every tenth customer also stands below the nation that follows its own."""
    customer = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 10 == 0)
    second = customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("child"), F.concat(F.lit("n"), ((F.col("c_nationkey") + 1) % 25).cast("string")).alias("parent"))
    covers = geo_covers(spark, sf_dir).unionByName(second)
    branches = table(spark, sf_dir, "region").select(F.lit("by_region").alias("partition"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("branch"))
    return graph.disjointness_violations(graph.closure(covers), branches)


def geo_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What refers to each nation and region, by field, with the first three."""
    fields = [("customer.nation", "customer", "c_custkey", "c_nationkey", "n"), ("supplier.nation", "supplier", "s_suppkey", "s_nationkey", "n"), ("nation.region", "nation", "n_nationkey", "n_regionkey", "r")]
    sources = {f: (table(spark, sf_dir, t).select(F.col(k).cast("string").alias("key"), F.concat(F.lit(kind), F.col(r).cast("string")).alias("ref")), "key", "ref") for f, t, k, r, kind in fields}
    return graph.references(sources, 3).withColumn("first", F.array_join("first", ","))


def geo_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the deletion of one nation touches, orders of its customers included."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target"))
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("target", F.lit("order").alias("field"), F.col("o_orderkey").cast("string").alias("source"))
    return graph.neighbourhood("n4", geo_covers(spark, sf_dir), orders)


def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers that are no longer live: those of negative balance count as deleted."""
    live = table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    return graph.dangling(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", live, "c_custkey").select("o_orderkey", "o_custkey")


def part_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return search.search(rows, "p_partkey", "p_name", F.array("p_brand", "p_type"), ["a"], limit=20, offset=5)


def part_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = table(spark, sf_dir, "part").select(F.lower("p_name").alias("form"))
    return search.neighbours(forms, forms).filter("x < y").select("x", "y", F.col("distance").cast("long").alias("distance"))


def part_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names within the limit that grows with their length; ``part_neighbours`` has those one edit apart."""
    forms = table(spark, sf_dir, "part").select(F.lower("p_name").alias("form"))
    return search.similar_pairs(forms).select("x", "y", F.col("distance").cast("long").alias("distance"))


def word_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words one edit away from a word of the documents."""
    asked = table(spark, sf_dir, "benchmark").select(F.explode(words_of(F.col("text"))).alias("form"))
    known = table(spark, sf_dir, "documents").select(F.explode(words_of(F.col("text"))).alias("form"))
    return search.neighbours(asked, known).groupBy("x").agg(F.count("*").alias("n"), F.min("y").alias("first"), F.max("y").alias("last"))


def prefix_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(words_of(F.col("text"))).alias("word")).distinct()
    spelled = words.withColumn("tokens", tokens(F.col("word"))).filter("tokens is not null")
    return graph.prefix_covers(spelled, "word", "tokens")


def prefix_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived covers of the benchmark's words against a stored version that knew only words of odd length."""
    rows = table(spark, sf_dir, "benchmark").select(F.explode(words_of(F.col("text"))).alias("word"))

    def covers(of: DataFrame) -> DataFrame:
        spelled = of.select("word").distinct().withColumn("tokens", tokens(F.col("word"))).filter("tokens is not null")
        return graph.prefix_covers(spelled, "word", "tokens").withColumnRenamed("word", "child")

    found = graph.cover_mismatches(covers(rows), covers(rows.filter(F.length("word") % 2 == 1)))
    return found.select("child", F.array_join("expected", ",").alias("expected"), F.array_join("actual", ",").alias("actual"))


def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against a version in which some are gone, new or have moved."""
    now = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    before = now.filter("c_custkey % 11 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    after = now.filter("c_custkey % 13 <> 0")
    return search.difference(before, after, "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"]).select("c_custkey", "change", F.array_join("fields", ",").alias("fields"))


def template_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's standardised product with the mean vector of its label."""
    rows = table(spark, sf_dir, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    template = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("template"))

    def total(column: Column) -> Column:
        return F.aggregate(column, F.lit(0.0), lambda a, x: a + x)

    v = F.transform("embedding", lambda x: x.cast("double"))
    dot = total(F.zip_with(v, F.col("template"), lambda a, b: a * b))
    norm = F.sqrt(total(F.transform(v, lambda x: x * x))) * F.sqrt(total(F.transform("template", lambda x: x * x)))
    return rows.join(F.broadcast(template), "label").select("vec_id", "label", F.round(dot / norm, 6).alias("similarity"))


def patched_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes that a patch of five operations makes to the graph of places: all of them, or none with the reasons."""
    words, covers = geo_words(spark, sf_dir), geo_covers(spark, sf_dir)

    def above(node: str) -> list[str]:
        return sorted(mutations.parents_of(covers, node))

    patch = [
        {"op": "add", "id": "r9", "entry": "NEW REGION", "category": "region", "upper_covers": ["root"]},
        {"op": "set_upper_covers", "id": "n1", "from": above("n1"), "to": ["r9"]},
        {"op": "set_fields", "id": "n2", "expect": {"category": "nation"}, "set": {"entry": "RENAMED"}},
        {"op": "set_upper_covers", "id": "n3", "from": above("n3"), "to": [*above("n3"), "root"]},
        {"op": "delete", "id": "n4", "reconnect": "parents"},
    ]
    result = mutations.apply_patch(words, covers, patch)
    return search.difference(mutations.with_parents(words, covers), mutations.with_parents(result.words, result.covers), "id", ["entry", "category", "parents"]).select("id", "change", F.array_join("fields", ",").alias("fields"))


def geo_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest cycle of each region once some nations, and some customers, also stand above it."""
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("n"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("r"), "n_nationkey")
    customer = table(spark, sf_dir, "customer").filter("c_custkey % 50 = 7").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    wrong = nation.filter("n_nationkey % 12 = 1").select(F.col("r").alias("child"), F.col("n").alias("parent")).unionByName(customer.select(F.col("r").alias("child"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("parent")))
    return graph.cycle_paths(geo_covers(spark, sf_dir).unionByName(wrong)).select("root", F.array_join("path", " ").alias("path"))


def transacted_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a patch with deletions in a row, a quote, references and states changes, as read from the version it publishes."""
    words, covers = geo_words(spark, sf_dir).withColumn("quote_of", F.lit(None).cast("string")), geo_covers(spark, sf_dir)
    key = F.col("o_custkey") % 25
    refs = table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("ships to").alias("field"), F.concat(F.lit("n"), key.cast("string")).alias("ref"))
    states = covers.filter(F.col("child").rlike("[05]$")).withColumn("state", F.lit("claimed"))
    root = f"{shared_dir(spark)}/geo-{uuid.uuid4().hex}"
    base = versions.publish(spark, root, {"words": words, "covers": covers, "references": refs, "states": states}, None)
    before = mutations.Patched(*(versions.read(spark, root, n) for n in ("words", "covers", "references", "states")))
    after = mutations.apply_patch(before.words, before.covers, [
        {"op": "delete", "id": "n5", "reconnect": "parents", "reference_policy": "remove"},
        {"op": "materialize_quote", "id": "entry:root", "as": "q0"},
        {"op": "delete", "id": "r0", "reconnect": "parents"},
        {"op": "add", "id": "r9", "entry": "NEW REGION", "upper_covers": ["r1"]},
        {"op": "set_fields", "id": "r9", "expect": {"category": "region"}, "set": {"category": "zone"}},
        {"op": "set_upper_covers", "id": "n6", "from": sorted({"root" if p == "r0" else p for p in mutations.parents_of(covers, "n6")}), "to": ["r9", "r1", "root"]},
    ], before.references, before.states)
    versions.publish(spark, root, {"words": after.words, "covers": after.covers, "references": after.references, "states": after.states}, base)
    now = mutations.Patched(*(versions.read(spark, root, n) for n in ("words", "covers", "references", "states")))
    changed = mutations.changes(before, now, ["entry", "category", "quote_of"]).select("id", "change", F.array_join("fields", ",").alias("fields"))
    for name, columns in (("references", ["id", "ref"]), ("states", ["child", "parent"])):
        gone = getattr(before, name).join(getattr(now, name), columns, "left_anti")
        changed = changed.unionByName(gone.select(F.col(columns[0]).alias("id"), F.lit(f"drop {name}").alias("change"), F.col(columns[1]).alias("fields")))
    return changed


QUERIES = {f.__name__: f for f in (
    geo_closure, geo_context, geo_redundant_edges, geo_issues, geo_category_stats, geo_child_counts, geo_disjointness, geo_references, geo_deletion, dangling_refs, part_search, part_neighbours, part_similar, word_neighbours, prefix_covers, prefix_mismatches, customer_changes,
    template_similarity, patched_geo, geo_cycles, transacted_geo,
)}

_EDGES = """edges AS (SELECT 'r' || r_regionkey AS child, 'root' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""
_SHORT = """short AS (SELECT * FROM edges UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 = 0
  UNION ALL SELECT 'c' || c_custkey, 'root' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 = 0)"""
_WORDS = """words AS (SELECT 'root' AS id, 'root' AS entry, 'root' AS category UNION ALL SELECT 'r' || r_regionkey, r_name, 'region' FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier' FROM supplier)"""


def _closure(edges: str, name: str = "closed") -> str:
    return f"{name} AS (SELECT child, parent AS ancestor FROM {edges} UNION SELECT {name}.child, e.parent FROM {name} JOIN {edges} e ON e.child = {name}.ancestor)"


ORACLES = {
    "geo_closure": f"WITH RECURSIVE {_EDGES}, up AS (SELECT child, parent AS ancestor, 1 AS depth FROM edges UNION ALL SELECT up.child, e.parent, depth + 1 FROM up JOIN edges e ON e.child = up.ancestor) SELECT child, ancestor, CAST(min(depth) AS BIGINT) AS depth FROM up GROUP BY 1, 2",
    "geo_context": f"""WITH RECURSIVE {_EDGES}, up AS (SELECT child, parent AS ancestor, 1 AS depth FROM edges UNION ALL SELECT up.child, e.parent, depth + 1 FROM up JOIN edges e ON e.child = up.ancestor),
      c AS (SELECT child, ancestor, min(depth) AS depth FROM up GROUP BY 1, 2), b AS (SELECT child AS node, 'up' AS direction, ancestor AS other, depth FROM c UNION ALL SELECT ancestor, 'down', child, depth FROM c),
      r AS (SELECT *, row_number() OVER (PARTITION BY node, direction ORDER BY depth, other) AS place, count(*) OVER (PARTITION BY node, direction) AS n FROM b)
      SELECT node, direction, n, string_agg(other, ',' ORDER BY place) AS first, n > 5 AS truncated FROM r WHERE place <= 5 GROUP BY node, direction, n""",
    "geo_redundant_edges": f"WITH RECURSIVE {_EDGES}, {_SHORT}, {_closure('short')} SELECT DISTINCT s.child, s.parent FROM short s WHERE EXISTS (SELECT 1 FROM short v JOIN closed c ON c.child = v.parent WHERE v.child = s.child AND v.parent <> s.parent AND c.ancestor = s.parent)",
    "geo_issues": f"""WITH RECURSIVE {_EDGES}, {_SHORT}, {_WORDS}, live AS (SELECT * FROM words WHERE NOT (id LIKE 'n%' AND TRY_CAST(substr(id, 2) AS INT) % 7 = 3)), {_closure('short')}
      SELECT 'DANGLING_REFERENCE' AS code, 'error' AS severity, child AS id, parent AS ref FROM short WHERE parent NOT IN (SELECT id FROM live)
      UNION ALL SELECT 'DUPLICATE_ENTRY_IN_CATEGORY', 'warning', min(id), max(id) FROM live GROUP BY category, entry HAVING count(*) > 1
      UNION ALL SELECT DISTINCT 'CYCLE', 'error', child, child FROM closed WHERE child = ancestor
      UNION ALL SELECT DISTINCT 'REDUNDANT_COVER', 'error', s.child, s.parent FROM short s WHERE EXISTS (SELECT 1 FROM short v JOIN closed c ON c.child = v.parent WHERE v.child = s.child AND v.parent <> s.parent AND c.ancestor = s.parent)""",
    "geo_category_stats": f"WITH {_EDGES}, {_WORDS} SELECT category, count(*) AS n, count(*) FILTER (id NOT IN (SELECT child FROM edges)) AS n_roots FROM words GROUP BY category",
    "geo_child_counts": f"WITH {_EDGES}, {_WORDS}, c AS (SELECT parent, substr(child, 1, 1) AS kind, count(*) AS n FROM edges GROUP BY 1, 2) SELECT parent, kind, n, coalesce(entry, '?') AS entry, entry IS NULL AS missing FROM c LEFT JOIN words ON id = parent",
    "geo_disjointness": f"""WITH RECURSIVE {_EDGES}, two AS (SELECT * FROM edges UNION ALL SELECT 'c' || c_custkey, 'n' || ((c_nationkey + 1) % 25) FROM customer WHERE c_custkey % 10 = 0), {_closure('two')},
      b AS (SELECT 'r' || r_regionkey AS branch FROM region), bad AS (SELECT child AS node FROM closed JOIN b ON branch = ancestor GROUP BY child HAVING count(DISTINCT branch) > 1)
      SELECT node, 'by_region' AS "partition" FROM bad WHERE NOT EXISTS (SELECT 1 FROM closed c JOIN bad u ON u.node = c.ancestor WHERE c.child = bad.node)""",
    "dangling_refs": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
    "part_search": """WITH h AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'a' THEN 100 WHEN starts_with(lower(p_name), 'a') THEN 60 WHEN contains(lower(p_name), 'a') THEN 40 ELSE 0 END
        + CASE WHEN lower(p_brand) = 'a' OR lower(p_type) = 'a' THEN 80 WHEN contains(lower(p_brand), 'a') OR contains(lower(p_type), 'a') THEN 30 ELSE 0 END AS score FROM part WHERE contains(lower(concat_ws(chr(10), p_name, p_brand, p_type)), 'a'))
      SELECT *, (SELECT count(*) FROM h) AS n_matches FROM (SELECT * FROM h ORDER BY score DESC, p_partkey LIMIT 20 OFFSET 5)""",
    "part_neighbours": "WITH f AS (SELECT DISTINCT lower(p_name) AS form FROM part) SELECT a.form AS x, b.form AS y, levenshtein(a.form, b.form) AS distance FROM f a JOIN f b ON a.form < b.form AND abs(length(a.form) - length(b.form)) <= 1 AND levenshtein(a.form, b.form) <= 1",
    "part_similar": "WITH f AS (SELECT DISTINCT lower(p_name) AS form FROM part) SELECT a.form AS x, b.form AS y, levenshtein(a.form, b.form) AS distance FROM f a JOIN f b ON a.form < b.form AND levenshtein(a.form, b.form) <= greatest(1, greatest(length(a.form), length(b.form)) // 4)",
    "word_neighbours": """WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS x FROM benchmark), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS y FROM documents),
      da AS (SELECT DISTINCT x, k FROM (SELECT x, unnest(list_append(list_transform(range(1, length(x) + 1), lambda i: substr(x, 1, i - 1) || substr(x, i + 1)), x)) AS k FROM a)),
      db AS (SELECT DISTINCT y, k FROM (SELECT y, unnest(list_append(list_transform(range(1, length(y) + 1), lambda i: substr(y, 1, i - 1) || substr(y, i + 1)), y)) AS k FROM b)),
      p AS (SELECT DISTINCT x, y FROM da JOIN db USING (k) WHERE x <> y AND levenshtein(x, y) <= 1) SELECT x, count(*) AS n, min(y) AS "first", max(y) AS "last" FROM p GROUP BY x""",
    "customer_changes": """WITH b AS (SELECT c_custkey, c_name, c_nationkey + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0), a AS (SELECT * FROM customer WHERE c_custkey % 13 <> 0)
      SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'add' WHEN a.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS change, CASE WHEN a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL THEN 'c_nationkey' END AS fields
      FROM b FULL JOIN a ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_nationkey <> b.c_nationkey""",
    "template_similarity": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY label, i), t AS (SELECT label, list(m ORDER BY i) AS t FROM p GROUP BY label)
      SELECT vec_id, label, round(list_dot_product(v, t) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(t, t))), 6) AS similarity FROM e JOIN t USING (label)""",
}
_TOK = f"regexp_extract_all(word, '{'|'.join(DIGRAPHS)}|[{_ALPHABET}]')"
ORACLES["prefix_covers"] = f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), s AS (SELECT word, {_code('word')} AS code FROM w WHERE array_to_string({_TOK}, '') = word),
  p AS (SELECT a.word, arg_max(b.word, length(b.code)) AS parent FROM s a JOIN s b ON length(b.code) < length(a.code) AND starts_with(a.code, b.code) GROUP BY a.word) SELECT word, parent FROM s LEFT JOIN p USING (word)"""
ORACLES["patched_geo"] = f"""WITH RECURSIVE {_EDGES}, {_WORDS}, parted AS (SELECT child, parent FROM edges WHERE child NOT IN ('n1', 'n4') AND parent <> 'n4' UNION SELECT 'r9', 'root' UNION SELECT 'n1', 'r9' UNION SELECT 'n3', 'root'
    UNION SELECT a.child, b.parent FROM edges a JOIN edges b ON a.parent = b.child WHERE b.child = 'n4'), {_closure('parted')},
  patched AS (SELECT * FROM parted p WHERE NOT EXISTS (SELECT 1 FROM parted v JOIN closed c ON c.child = v.parent WHERE v.child = p.child AND v.parent <> p.parent AND c.ancestor = p.parent)),
  renamed AS (SELECT id, CASE WHEN id = 'n2' THEN 'RENAMED' ELSE entry END AS entry, category FROM words WHERE id <> 'n4' UNION ALL SELECT 'r9', 'NEW REGION', 'region'),
  b AS (SELECT id, entry, category, (SELECT string_agg(parent, ' ' ORDER BY parent) FROM edges WHERE child = id) AS parents FROM words), a AS (SELECT id, entry, category, (SELECT string_agg(parent, ' ' ORDER BY parent) FROM patched WHERE child = id) AS parents FROM renamed)
  SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'add' WHEN a.id IS NULL THEN 'delete' ELSE 'update' END AS change,
    CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN concat_ws(',', CASE WHEN a.entry <> b.entry THEN 'entry' END, CASE WHEN a.category <> b.category THEN 'category' END, CASE WHEN a.parents IS DISTINCT FROM b.parents THEN 'parents' END) END AS fields
  FROM b FULL JOIN a ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.entry <> b.entry OR a.category <> b.category OR a.parents IS DISTINCT FROM b.parents"""
ORACLES["prefix_mismatches"] = f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), s AS (SELECT word, {_code('word')} AS code FROM w WHERE array_to_string({_TOK}, '') = word), o AS (SELECT * FROM s WHERE length(word) % 2 = 1),
  e AS (SELECT a.word, arg_max(b.word, length(b.code)) AS parent FROM s a JOIN s b ON length(b.code) < length(a.code) AND starts_with(a.code, b.code) GROUP BY a.word),
  f AS (SELECT a.word, arg_max(b.word, length(b.code)) AS parent FROM o a JOIN o b ON length(b.code) < length(a.code) AND starts_with(a.code, b.code) GROUP BY a.word)
  SELECT word AS child, coalesce(e.parent, '') AS expected, coalesce(f.parent, '') AS actual FROM e FULL JOIN f USING (word) WHERE e.parent IS DISTINCT FROM f.parent"""
ORACLES["geo_references"] = """WITH r AS (SELECT 'n' || c_nationkey AS target, 'customer.nation' AS field, CAST(c_custkey AS VARCHAR) AS source FROM customer UNION SELECT 'n' || s_nationkey, 'supplier.nation', CAST(s_suppkey AS VARCHAR) FROM supplier
  UNION SELECT 'r' || n_regionkey, 'nation.region', CAST(n_nationkey AS VARCHAR) FROM nation), p AS (SELECT *, row_number() OVER (PARTITION BY target, field ORDER BY source) AS i FROM r WHERE target IS NOT NULL)
  SELECT target, field, count(*) AS n, string_agg(source, ',' ORDER BY source) FILTER (i <= 3) AS first FROM p GROUP BY 1, 2"""
ORACLES["geo_deletion"] = f"""WITH {_EDGES} SELECT 'parent' AS relation, parent AS other FROM edges WHERE child = 'n4' UNION SELECT 'child', child FROM edges WHERE parent = 'n4'
  UNION SELECT 'reference:order', CAST(o_orderkey AS VARCHAR) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 4"""
ORACLES["geo_cycles"] = f"""WITH RECURSIVE {_EDGES}, e AS (SELECT * FROM edges UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation WHERE n_nationkey % 12 = 1
    UNION SELECT 'r' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 = 7), {_closure('e')},
  roots AS (SELECT a.child AS root FROM closed a JOIN closed b ON b.child = a.ancestor AND b.ancestor = a.child GROUP BY a.child HAVING min(a.ancestor) = a.child),
  walk AS (SELECT root, [root, parent] AS path FROM roots JOIN e ON child = root UNION ALL SELECT root, list_append(path, parent) FROM walk JOIN e ON child = path[-1] WHERE path[-1] <> root AND len(path) < 6)
  SELECT root, array_to_string(path, ' ') AS path FROM walk WHERE path[-1] = root QUALIFY row_number() OVER (PARTITION BY root ORDER BY len(path), path) = 1"""
ORACLES["transacted_geo"] = f"""WITH RECURSIVE {_EDGES}, {_WORDS},
  moved AS (SELECT child, CASE WHEN parent = 'n5' THEN (SELECT parent FROM edges WHERE child = 'n5') ELSE parent END AS parent FROM edges WHERE child NOT IN ('n5', 'r0', 'n6')),
  parted AS (SELECT child, CASE WHEN parent = 'r0' THEN 'root' ELSE parent END AS parent FROM moved UNION SELECT 'r9', 'r1' UNION SELECT 'n6', 'r9'),
  w AS (SELECT *, NULL AS quote_of FROM words),
  v AS (SELECT * FROM w WHERE id NOT IN ('n5', 'r0') UNION ALL SELECT 'q0', '⌜root⌝', 'root', 'root' UNION ALL SELECT 'r9', 'NEW REGION', 'zone', NULL),
  b AS (SELECT *, (SELECT string_agg(parent, ' ' ORDER BY parent) FROM edges WHERE child = id) AS parents FROM w), a AS (SELECT *, (SELECT string_agg(parent, ' ' ORDER BY parent) FROM parted WHERE child = id) AS parents FROM v)
  SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'add' WHEN a.id IS NULL THEN 'delete' ELSE 'update' END AS change, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'parents' END AS fields
  FROM b FULL JOIN a ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.parents IS DISTINCT FROM b.parents
  UNION ALL SELECT 'o' || o_orderkey, 'drop references', 'n5' FROM orders WHERE o_orderkey % 10 = 0 AND o_custkey % 25 = 5
  UNION ALL SELECT child, 'drop states', parent FROM edges x WHERE regexp_matches(child, '[05]$') AND NOT EXISTS (SELECT 1 FROM parted p WHERE p.child = x.child AND p.parent = x.parent)"""
