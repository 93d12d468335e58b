"""Ordered graphs of covers (child, parent): reachability, cycles, reduction, and the rules that a graph must keep."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut, dropped


#: Steps after which the tables found so far become one.
STEPS = 32


def closure(edges: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """(child, ancestor, depth): every ancestor with its least depth, at any depth.  Stops when a step finds nothing new.

    A step joins what the last one found with the edges; what is known already is dropped, so cycles end too.  Lineage
    is cut by a written table every step.
    """
    if skip is not None:
        edges = edges.join(skip, ["child", "parent"], "left_anti")
    edges = cut(edges.select("child", "parent").distinct())
    found = edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    last = found
    for depth in count(2):
        step = last.join(edges.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("child", F.col("parent").alias("ancestor")).distinct()
        new = step.join(found.select("child", "ancestor"), ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth))
        new = cut(new)
        if new.isEmpty():
            break
        found, last = found.unionByName(new), new
        if depth % STEPS == 0:
            found = cut(found)
    return found


def on_cycle(closed: DataFrame) -> DataFrame:
    """Nodes that reach themselves."""
    return closed.filter(F.col("child") == F.col("ancestor")).select(F.col("child").alias("node")).distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """The covers, a written table, without those that lead from where none comes or to where none goes on; again while any goes."""
    before, left = None, edges.count()
    while left and left != before:
        onward = edges.join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        kept = cut(onward.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("child", "parent"))
        dropped(edges)
        edges, before, left = kept, left, kept.count()
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the least of a node and all below it, by hash, so that a chain of cycles falls apart in a few rounds."""
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    labels = cut(nodes.select("node", F.struct(F.xxhash64("node").alias("hash"), "node").alias("colour"), F.lit(True).alias("moved")))
    while not labels.filter("moved").isEmpty():
        up = labels.filter("moved").select(F.col("node").alias("child"), "colour").join(edges, "child")
        least = up.groupBy(F.col("parent").alias("node")).agg(F.min("colour").alias("least"))
        moved = F.coalesce(F.col("least") < F.col("colour"), F.lit(False))
        now = cut(labels.join(least, "node", "left").select("node", F.when(moved, F.col("least")).otherwise(F.col("colour")).alias("colour"), moved.alias("moved")))
        dropped(labels)
        labels = now
    return labels


def _below(start: DataFrame, edges: DataFrame, by: str, shortest: bool = False) -> DataFrame:
    """(by, node, depth): each start (by, node), and what lies below it within the covers (by, child, parent), with the least number of steps.

    ``shortest``: a start isn't there at once but when a cycle leads to it, and what is further away than that isn't looked for.
    """
    last = start.select(by, "node", F.lit(0).alias("depth"))
    found = None if shortest else last
    for depth in count(1):
        step = edges.join(last.select(by, F.col("node").alias("parent")), [by, "parent"]).select(by, F.col("child").alias("node")).distinct()
        new = step if found is None else step.join(found.select(by, "node"), [by, "node"], "left_anti")
        new = cut(new.select(by, "node", F.lit(depth).alias("depth")))
        if new.isEmpty():
            return new if found is None else found
        found = new if found is None else found.unionByName(new)
        last = new.join(new.join(start, [by, "node"], "left_semi").select(by), by, "left_anti") if shortest else new
        if depth % STEPS == 0:
            found = cut(found)


def _cyclic(edges: DataFrame) -> DataFrame:
    """(root, child, parent): the covers within each set of nodes that reach one another, by its least node.

    No pairs of nodes are made: covers that can't lie on a cycle go; each node takes the least colour of all below it; of
    a colour, the nodes that lead to the one it is named after are a set; the covers between the others are gone through again.
    """
    edges = edges.filter("child is not null and parent is not null").select("child", "parent").distinct()
    left, out = cut(edges), None
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            return left.select(F.col("child").alias("root"), "child", "parent") if out is None else out
        labels = _coloured(left)
        ends = [labels.select(F.col("node").alias(side), F.col("colour").alias(f"{side}_colour")) for side in ("child", "parent")]
        inner = cut(left.join(ends[0], "child").join(ends[1], "parent").filter("child_colour = parent_colour").select(F.col("child_colour").alias("colour"), "child", "parent"))
        named = inner.select("colour", F.col("colour.node").alias("node")).distinct()
        sets = _below(named, inner, "colour").select("colour", "node")
        within = inner.join(sets.select("colour", F.col("node").alias("child")), ["colour", "child"], "left_semi").join(sets.select("colour", F.col("node").alias("parent")), ["colour", "parent"], "left_semi")
        roots = sets.groupBy("colour").agg(F.min("node").alias("root"))
        part = cut(within.join(roots, "colour").select("root", "child", "parent"))
        out = part if out is None else out.unionByName(part)
        rest = inner.join(sets.select(F.col("node").alias("child")), "child", "left_anti").join(sets.select(F.col("node").alias("parent")), "parent", "left_anti")
        rest = cut(rest.select("child", "parent"))
        dropped(left, inner, labels)
        left = rest


def cycle_paths(edges: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(root, path): of each set of nodes that reach one another, a shortest cycle through its least node, which stands at both ends.

    From the root of each set, steps go down until the root is met again, so each node met has the least number of steps to it;
    then each step up goes to the parent that is nearest to the root again, the least one of several.  All cycles are walked
    at once, a join a step.  A closure that is at hand, ``closed``, only tells which nodes lie on cycles.
    """
    if closed is not None:
        cyclic = on_cycle(closed)
        for side in ("child", "parent"):
            edges = edges.join(cyclic.withColumnRenamed("node", side), side, "left_semi")
    ups = cut(_cyclic(edges))
    roots = cut(ups.select("root", F.col("root").alias("node")).distinct())
    to_root = _below(roots, ups, "root", shortest=True)
    way = to_root.filter("node = root").select("root", "node", F.col("depth").alias("left"), F.array("root").alias("path"))
    done = None
    ups = ups.select("root", F.col("child").alias("node"), F.col("parent").alias("next"))
    while True:
        ended = way.filter("left = 1").select("root", F.concat("path", F.array("root")).alias("path"))
        done = ended if done is None else done.unionByName(ended)
        going = way.filter("left > 1")
        if going.isEmpty():
            return done
        near = to_root.select("root", F.col("node").alias("next"), F.col("depth").alias("rest"))
        onward = going.join(ups, ["root", "node"]).join(near, ["root", "next"]).filter("rest = left - 1")
        way = cut(onward.groupBy("root", "left", "path").agg(F.min("next").alias("node")).select("root", "node", (F.col("left") - 1).alias("left"), F.concat("path", F.array("node")).alias("path")))


def redundant(edges: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """Covers (child, parent) that another path implies.  In a graph without cycles all of them can go at once."""
    closed = closure(edges) if closed is None else closed
    other = edges.select("child", F.col("parent").alias("via"))
    up = closed.select(F.col("child").alias("via"), F.col("ancestor").alias("parent"))
    return other.join(up, "via").filter(F.col("via") != F.col("parent")).join(edges.select("child", "parent"), ["child", "parent"]).select("child", "parent").distinct()


def reduced(edges: DataFrame) -> DataFrame:
    """The covers without the redundant ones."""
    return edges.join(redundant(edges), ["child", "parent"], "left_anti")


def dangling(refs: DataFrame, ref: str, live: DataFrame, key: str) -> DataFrame:
    """Rows whose reference isn't among the live keys; a null reference is none."""
    return refs.filter(F.col(ref).isNotNull()).join(live.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def references(sources: dict[str, tuple[DataFrame, str, str]], limit: int = 50) -> DataFrame:
    """(target, field, n, first): what refers to each target, by field: how many rows, and the ``limit`` smallest of them.

    A source is (rows, key, reference), all strings, where the reference may be an array; nulls refer to nothing, and a
    row that names a target twice counts once.  Rows are ranked before they are gathered.
    """
    found = None
    for field, (rows, key, ref) in sources.items():
        target = F.explode(ref) if dict(rows.dtypes)[ref].startswith("array") else F.col(ref)
        part = rows.select(F.col(key).alias("source"), target.alias("target"), F.lit(field).alias("field")).filter("target is not null").distinct()
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("target", "field").orderBy("source"))
    first = found.withColumn("place", place).filter(F.col("place") <= limit).groupBy("target", "field").agg(F.array_sort(F.collect_list("source")).alias("first"))
    return found.groupBy("target", "field").agg(F.count("*").alias("n")).join(first, ["target", "field"])


def neighbourhood(node: str, covers: DataFrame, refs: DataFrame) -> DataFrame:
    """(relation, other) of all that a node's deletion touches: parents, children, and rows of (target, field, source)."""
    up = covers.filter(F.col("child") == node).select(F.lit("parent").alias("relation"), F.col("parent").alias("other"))
    down = covers.filter(F.col("parent") == node).select(F.lit("child").alias("relation"), F.col("child").alias("other"))
    named = refs.filter(F.col("target") == node).select(F.concat(F.lit("reference:"), F.col("field")).alias("relation"), F.col("source").alias("other"))
    return up.unionByName(down).unionByName(named).distinct()


def asymmetric(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """(child, parent, missing): covers that only one of the two directions states."""
    a, b = upper.select("child", "parent"), lower.select("child", "parent")
    return a.exceptAll(b).withColumn("missing", F.lit("lower")).unionByName(b.exceptAll(a).withColumn("missing", F.lit("upper")))


def prefix_covers(words: DataFrame, word: str = "word", tokens: str | None = None) -> DataFrame:
    """(word, parent): the longest other word that is a proper prefix, by sounds if ``tokens`` names an array column.

    Every word is exploded to its prefixes, which then meet the words in one equi-join; no pairs are compared.
    """
    seq = F.col(tokens) if tokens else F.split(F.col(word), "")
    base = words.select(F.col(word).alias("word"), seq.alias("seq")).filter(F.size("seq") > 0).dropDuplicates(["word"])
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.size("seq") - 1), lambda n: F.slice("seq", 1, n)))
    prefixes = base.filter(F.size("seq") > 1).select("word", cut.alias("seq"))
    known = base.select("seq", F.col("word").alias("parent"))
    best = prefixes.join(known, "seq").groupBy("word").agg(F.max_by("parent", F.size("seq")).alias("parent"))
    return base.select("word").join(best, "word", "left")


def cover_mismatches(derived: DataFrame, stored: DataFrame) -> DataFrame:
    """(child, expected, actual): children whose stored parents aren't the derived ones, both as sorted arrays.

    Children are those of either table; to derive anew is to store ``derived`` for them.
    """
    def parents(covers: DataFrame, name: str) -> DataFrame:
        return covers.filter("parent is not null").groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias(name))

    none = F.array().cast("array<string>")
    both = parents(derived, "expected").join(parents(stored, "actual"), "child", "full")
    return both.select("child", F.coalesce("expected", none).alias("expected"), F.coalesce("actual", none).alias("actual")).filter("expected <> actual")


def disjointness_violations(closed: DataFrame, branches: DataFrame) -> DataFrame:
    """(node, partition): nodes under two or more branches (partition, branch) of a partition, where no parent already is."""
    own = branches.select("partition", "branch", F.col("branch").alias("node"))
    below = closed.select(F.col("child").alias("node"), F.col("ancestor").alias("branch")).join(branches, "branch").select("partition", "branch", "node")
    bad = own.unionByName(below).groupBy("node", "partition").agg(F.countDistinct("branch").alias("n")).filter("n > 1").select("node", "partition")
    inherited = closed.select(F.col("child").alias("node"), F.col("ancestor").alias("up")).join(bad.select(F.col("node").alias("up"), "partition"), "up").select("node", "partition")
    return bad.join(inherited, ["node", "partition"], "left_anti")


def issues(words: DataFrame, covers: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(code, severity, id, ref) of a graph's words (id, entry, category) and covers (child, parent).

    The cheap rules first: missing references, self covers and repeated entries; redundancy and cycles from one closure.
    """
    live = words.select("id").distinct()
    gone = covers.select(F.col("child").alias("id"), F.col("parent").alias("ref")).join(live.select(F.col("id").alias("ref")), "ref", "left_anti")
    closed = closure(covers) if closed is None else closed

    def issue(rows: DataFrame, code: str, severity: str) -> DataFrame:
        return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "id", "ref")

    twins = words.groupBy("category", "entry").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.max("id").alias("ref")).filter("n > 1")
    cycles = on_cycle(closed).select(F.col("node").alias("id"), F.col("node").alias("ref"))
    extra = redundant(covers, closed).select(F.col("child").alias("id"), F.col("parent").alias("ref"))
    return issue(gone, "DANGLING_REFERENCE", "error").unionByName(issue(twins, "DUPLICATE_ENTRY_IN_CATEGORY", "warning")).unionByName(issue(cycles, "CYCLE", "error")).unionByName(issue(extra, "REDUNDANT_COVER", "error"))


def contexts(closed: DataFrame, limit: int = 50) -> DataFrame:
    """(node, direction, n, first, truncated): how many nodes lie above and below each, the nearest ``limit``, and whether more do.

    A node's list is ranked before it is gathered, so no list is longer than ``limit``.
    """
    up = closed.select(F.col("child").alias("node"), F.lit("up").alias("direction"), F.col("ancestor").alias("other"), "depth")
    down = closed.select(F.col("ancestor").alias("node"), F.lit("down").alias("direction"), F.col("child").alias("other"), "depth")
    both = up.unionByName(down)
    place = F.row_number().over(Window.partitionBy("node", "direction").orderBy("depth", "other"))
    first = both.withColumn("place", place).filter(F.col("place") <= limit).groupBy("node", "direction").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"]).alias("first"))
    return both.groupBy("node", "direction").agg(F.count("*").alias("n")).join(first, ["node", "direction"]).withColumn("truncated", F.col("n") > limit)
