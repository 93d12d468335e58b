"""Rules of an ontology's records: placement, kinds, properties of relations, axioms.

Words come as rows of ``SCHEMA``; every rule is a filter, a join or a grouped count over exploded records, and all give
rows (code, severity, id, ref).  References are checked by left joins with the live words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

# Names in the data.
PLACED, UNDECIDED = "配置", "上位未決"
CONSTRUCTOR, FEATURE = "コンストラクタ", "素性"
LOWERING, DEFINITION, FORMULA = "引き下げ", "定義", "式"

SCHEMA = """id BIGINT, entry STRING, category STRING, arguments ARRAY<BIGINT>, is_function BOOLEAN, upper_covers ARRAY<BIGINT>,
  partitions ARRAY<STRUCT<key: STRING, kind: STRING, disjoint: BOOLEAN, exhaustive: BOOLEAN>>, cover_states ARRAY<STRUCT<parent: BIGINT, state: STRING, partition: STRING>>,
  generator STRUCT<tArity: INT, isFunc: BOOLEAN>, dent ARRAY<BIGINT>, quote_of BIGINT,
  meta_props STRUCT<functional: ARRAY<INT>, total_on: ARRAY<STRUCT<node: BIGINT, arg: INT>>, symmetric: BOOLEAN, transitive: BOOLEAN, elidable: ARRAY<INT>>,
  axioms ARRAY<STRUCT<kind: STRING, relation: BIGINT, hub: BIGINT, projections: ARRAY<BIGINT>, genus: BIGINT, differentia: ARRAY<STRUCT<relation: BIGINT, value: BIGINT>>, text: STRING, refs: ARRAY<BIGINT>>>"""


def _issue(rows: DataFrame, code: str, severity: str = "error", ref: Column | None = None) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("id").cast("bigint").alias("id"), (ref if ref is not None else F.lit(None)).cast("bigint").alias("ref"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def states(words: DataFrame) -> DataFrame:
    """(id, parent, state, partition) of every cover; a cover without a record is placed."""
    covers = words.select("id", F.explode("upper_covers").alias("parent"))
    records = words.select("id", F.explode("cover_states").alias("r")).select("id", "r.*").dropDuplicates(["id", "parent"])
    return covers.join(records, ["id", "parent"], "left").withColumn("state", F.coalesce("state", F.lit(PLACED)))


def asserted(words: DataFrame) -> DataFrame:
    """(child, parent) of the covers that state that one is the other: not those left undecided."""
    return states(words).filter(F.col("state") != UNDECIDED).select(F.col("id").alias("child"), "parent")


def child_states(words: DataFrame) -> DataFrame:
    """(parent, state, n)."""
    return states(words).groupBy("parent", "state").agg(F.count("*").alias("n"))


def branches(words: DataFrame) -> DataFrame:
    """(partition, branch): words that take part in a disjoint partition of a parent; constructor partitions always are."""
    own = words.select(F.col("id").alias("parent"), F.explode("partitions").alias("p")).filter((F.col("p.kind") == CONSTRUCTOR) | F.coalesce("p.disjoint", F.lit(False))).select("parent", F.col("p.key").alias("partition"))
    taken = states(words).filter((F.col("state") == PLACED) & F.col("partition").isNotNull())
    return taken.join(own, ["parent", "partition"]).select(F.concat_ws("/", F.col("parent").cast("string"), "partition").alias("partition"), F.col("id").alias("branch"))


def placement_issues(words: DataFrame) -> DataFrame:
    partitions = words.select("id", F.explode("partitions").alias("p"))
    records = words.select("id", "upper_covers", F.explode("cover_states").alias("r")).select("id", "upper_covers", "r.*")
    known = words.select(F.col("id").alias("parent"), F.explode("partitions").alias("p")).select("parent", F.col("p.key").alias("partition")).distinct()
    covered = records.filter(F.array_contains(F.coalesce("upper_covers", F.array().cast("array<bigint>")), F.col("parent")))
    named = covered.filter("partition is not null")
    nodes = graph.disjointness_violations(graph.closure(asserted(words)), branches(words)).select(F.col("node").alias("id"), F.split("partition", "/")[0].alias("of"))
    return _all([
        _issue(partitions.filter(F.coalesce("p.key", F.lit("")) == ""), "INVALID_PARTITION"),
        _issue(partitions.filter(~F.col("p.kind").isin(CONSTRUCTOR, FEATURE)), "INVALID_PARTITION"),
        _issue(partitions.groupBy("id", "p.key").count().filter("count > 1"), "DUPLICATE_PARTITION"),
        _issue(records.groupBy("id", "parent").count().filter("count > 1"), "DUPLICATE_COVER_STATE", ref=F.col("parent")),
        _issue(records.filter("parent is null"), "INVALID_COVER_STATE"),
        _issue(records.filter(F.col("parent").isNotNull()).join(covered.select("id", "parent").distinct(), ["id", "parent"], "left_anti"), "COVER_STATE_NOT_A_COVER", ref=F.col("parent")),
        _issue(covered.filter(~F.coalesce("state", F.lit("")).isin(PLACED, UNDECIDED)), "INVALID_COVER_STATE", ref=F.col("parent")),
        _issue(named.filter(F.col("state") == UNDECIDED), "PARTITION_ON_UNPLACED", ref=F.col("parent")),
        _issue(named.filter(F.col("state") == PLACED).join(known, ["parent", "partition"], "left_anti"), "UNKNOWN_PARTITION", ref=F.col("parent")),
        _issue(nodes, "DISJOINT_PARTITION_VIOLATION", ref=F.col("of")),
    ])


def signature(arguments: Column, is_function: Column) -> Column:
    """struct(arity, function); null where it isn't set or a function has no argument."""
    arity = F.coalesce(F.size(arguments), F.lit(0))
    arity = F.when(arity < 0, 0).otherwise(arity)
    return F.when(is_function.isNotNull() & ~(is_function & (arity == 0)), F.struct(arity.alias("arity"), is_function.alias("function")))


def generated(words: DataFrame) -> DataFrame:
    """(id, kind): words whose category and signature are those that a kind generates; one equi-join."""
    kinds = words.filter("generator is not null").select(F.col("id").alias("kind"), "category", F.col("generator.tArity").alias("arity"), F.col("generator.isFunc").alias("function"))
    sig = signature(F.col("arguments"), F.col("is_function"))
    signed = words.select("id", "category", sig.alias("s")).filter("s is not null").select("id", "category", "s.arity", "s.function")
    return signed.join(kinds, ["category", "arity", "function"]).select("id", "kind")


def kind_members(words: DataFrame) -> DataFrame:
    """(kind, id, shown, source): members by signature and by stated fact.

    A word is shown as a quotation of itself unless it is a quoting word, or a constant that is a member by fact; a word
    that another one quotes is left to that one, as far as its signature goes.
    """
    by_signature = generated(words)
    facts = words.select("id", F.explode("dent").alias("kind"))
    quoting = words.filter("quote_of is not null").select("id", F.col("quote_of").alias("source_id"))
    held = quoting.select(F.col("source_id").alias("id")).distinct()
    constants = words.filter(F.coalesce(F.col("is_function"), F.lit(False)) & (F.size("arguments") == 1)).select("id")
    plain = words.join(quoting.select("id"), "id", "left_anti").select("id")
    word, quote = F.lit("word"), F.lit("quote")

    quoted = by_signature.select(F.col("id").alias("source_id"), "kind").join(quoting, "source_id").select("kind", "id")
    of_quoting = quoted.withColumn("source", F.lit("signature")).unionByName(facts.join(quoting.select("id"), "id").join(quoted, ["id", "kind"], "left_anti").select("kind", "id", F.lit("fact").alias("source"))).select("kind", "id", word.alias("shown"), "source")
    itself = by_signature.join(held, "id", "left_anti").select("kind", "id", quote.alias("shown"), F.lit("signature").alias("source"))
    own_facts = facts.join(plain, "id").distinct()
    constant_facts = own_facts.join(constants, "id").select("kind", "id", word.alias("shown"), F.lit("fact").alias("source"))
    other_facts = own_facts.join(constants, "id", "left_anti").join(itself.select("kind", "id"), ["kind", "id"], "left_anti").select("kind", "id", quote.alias("shown"), F.lit("fact").alias("source"))
    shown_itself = itself.join(constant_facts.select("kind", "id"), ["kind", "id"], "left_anti")
    return _all([of_quoting, shown_itself, constant_facts, other_facts])


def kind_issues(words: DataFrame) -> DataFrame:
    live = words.select(F.col("id").alias("ref"))
    facts = words.select("id", "quote_of", F.explode("dent").alias("ref"))
    quoting = words.filter("quote_of is not null")
    dead = quoting.select("id", F.col("quote_of").alias("ref")).join(live, "ref", "left_anti")
    alive = quoting.join(live.withColumnRenamed("ref", "quote_of"), "quote_of", "left_semi")
    constant = F.coalesce(F.col("is_function"), F.lit(False)) & (F.size("arguments") == 1)
    own = generated(words).select(F.col("id").alias("of"), F.col("kind").alias("ref"))
    sources = words.filter(F.size("dent") > 0).select(F.col("id").alias("quote_of"))
    return _all([
        _issue(words.filter("generator is not null and (generator.tArity is null or generator.tArity < 0 or generator.isFunc is null)"), "INVALID_GENERATOR"),
        _issue(facts.join(live, "ref", "left_anti"), "INVALID_DENT", ref=F.col("ref")),
        _issue(facts.groupBy("id", "ref").count().filter("count > 1"), "DUPLICATE_DENT", ref=F.col("ref")),
        _issue(facts.withColumn("of", F.coalesce("quote_of", "id")).join(own, ["of", "ref"]), "DENT_ALREADY_GENERATED", "warning", F.col("ref")),
        _issue(dead, "INVALID_QUOTE_OF", ref=F.col("ref")),
        _issue(alive.filter(~constant), "QUOTE_NOT_CONSTANT", "warning"),
        _issue(alive.filter(F.size("upper_covers") > 0), "QUOTE_WITH_COVERS", "warning"),
        _issue(alive.join(sources, "quote_of", "left_semi"), "DENT_ON_QUOTED_SOURCE", "warning", F.col("quote_of")),
        _issue(alive.groupBy("quote_of").agg(F.max("id").alias("id"), F.count("*").alias("n")).filter("n > 1"), "DUPLICATE_QUOTE", ref=F.col("quote_of")),
    ])


def property_issues(words: DataFrame) -> DataFrame:
    """Rules of what a relation says of itself: only two-place words have properties, and what may be left out is determined."""
    have = words.filter("meta_props is not null")
    args = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<int>")), lambda a: ~a.isin(1, 2))
    total = have.select("id", "arguments", F.explode("meta_props.total_on").alias("t")).select("id", F.col("t.node").alias("node"), F.col("t.arg").alias("arg"), F.try_element_at("arguments", F.col("t.arg")).alias("domain"))
    live = words.select(F.col("id").alias("node"))
    above = graph.closure(asserted(words)).select(F.col("child").alias("node"), F.col("ancestor").alias("domain"))
    good = total.filter(F.col("arg").isin(1, 2)).join(live, "node", "left_semi")
    elidable = have.select("id", "meta_props", F.explode("meta_props.elidable").alias("arg"))
    functional = F.array_contains(F.coalesce("meta_props.functional", F.array().cast("array<int>")), F.col("arg"))
    totals = F.exists(F.coalesce(F.col("meta_props.total_on"), F.array().cast("array<struct<node:bigint,arg:int>>")), lambda t: t["arg"] == F.col("arg"))
    return _all([
        _issue(have.filter((F.size("arguments") != 2) | F.coalesce(F.col("is_function"), F.lit(False))), "META_PROPS_ON_NON_RELATION"),
        _issue(have.filter(args("meta_props.functional") | args("meta_props.elidable")), "INVALID_META_PROPS"),
        _issue(total.filter(~F.coalesce("arg", F.lit(0)).isin(1, 2)), "INVALID_META_PROPS", ref=F.col("node")),
        _issue(total.join(live, "node", "left_anti"), "INVALID_META_PROPS", ref=F.col("node")),
        _issue(good.filter("domain is not null and node <> domain").join(above, ["node", "domain"], "left_anti"), "TOTAL_ON_OUTSIDE_DOMAIN", "warning", F.col("node")),
        _issue(elidable.filter(~functional | ~totals), "ELIDABLE_NOT_DETERMINED", "warning"),
    ])


def axiom_references(words: DataFrame) -> DataFrame:
    """(id, at, ref) of every word that an axiom names."""
    rows = words.select("id", F.posexplode("axioms").alias("at", "a"))
    empty = F.array().cast("array<bigint>")
    refs = (
        F.when(F.col("a.kind") == LOWERING, F.concat(F.array("a.relation", "a.hub"), F.coalesce("a.projections", empty)))
        .when(F.col("a.kind") == DEFINITION, F.concat(F.array("a.genus"), F.flatten(F.transform(F.coalesce("a.differentia", F.array().cast("array<struct<relation:bigint,value:bigint>>")), lambda d: F.array(d["relation"], d["value"])))))
        .when(F.col("a.kind") == FORMULA, F.coalesce("a.refs", empty))
    )
    return rows.select("id", "at", F.explode(refs).alias("ref"))


def axiom_issues(words: DataFrame) -> DataFrame:
    rows = words.select("id", F.posexplode("axioms").alias("at", "a"))
    count = lambda c: F.greatest(F.size(c), F.lit(0))
    live = words.select(F.col("id").alias("ref"))
    above = graph.closure(asserted(words)).select(F.col("child").alias("id"), F.col("ancestor").alias("ref"))
    genus = rows.filter(F.col("a.kind") == DEFINITION).select("id", F.col("a.genus").alias("ref")).join(live, "ref", "left_semi")
    return _all([
        _issue(rows.filter(~F.coalesce("a.kind", F.lit("")).isin(LOWERING, DEFINITION, FORMULA)), "INVALID_AXIOM"),
        _issue(rows.filter((F.col("a.kind") == LOWERING) & (F.coalesce(count("a.projections"), F.lit(0)) != 2)), "INVALID_AXIOM"),
        _issue(rows.filter((F.col("a.kind") == DEFINITION) & (F.coalesce(count("a.differentia"), F.lit(0)) == 0)), "DEFINITION_WITHOUT_DIFFERENTIA", "warning"),
        _issue(rows.filter((F.col("a.kind") == FORMULA) & (F.trim(F.coalesce("a.text", F.lit(""))) == "")), "INVALID_AXIOM"),
        _issue(rows.filter(F.col("a.kind") == FORMULA), "AXIOM_OUTSIDE_SCHEMA", "warning"),
        _issue(axiom_references(words).join(live, "ref", "left_anti"), "INVALID_AXIOM", ref=F.col("ref")),
        _issue(genus.join(above, ["id", "ref"], "left_anti"), "DEFINITION_GENUS_NOT_ANCESTOR", "warning", F.col("ref")),
    ])


def pruned_axioms(words: DataFrame) -> DataFrame:
    """Words without the axioms that name a word that is gone."""
    gone = axiom_references(words).filter("ref is not null").join(words.select(F.col("id").alias("ref")), "ref", "left_anti").groupBy("id").agg(F.collect_set("at").alias("gone"))
    kept = F.filter("axioms", lambda a, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    return words.join(gone, "id", "left").withColumn("axioms", kept).drop("gone")


def pruned_states(words: DataFrame) -> DataFrame:
    """Words without the states of covers that are no more."""
    return words.withColumn("cover_states", F.filter("cover_states", lambda r: F.array_contains("upper_covers", r["parent"])))


def validated(words: DataFrame) -> DataFrame:
    """All issues.  References, repeats and cycles come first: if one of these is an error, the rules on records wait."""
    covers = words.select(F.col("id").alias("child"), F.explode("upper_covers").alias("parent"))
    first = graph.issues(words.select("id", "entry", "category"), covers).select("code", "severity", F.col("id").cast("bigint").alias("id"), F.col("ref").cast("bigint").alias("ref"))
    if not first.filter("severity = 'error'").isEmpty():
        return first
    return _all([first, placement_issues(words), kind_issues(words), property_issues(words), axiom_issues(words)])
