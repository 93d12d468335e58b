"""Merkle manifest: a hash tree over the rows of a data set, with a proof for each row.

A row's leaf is the SHA-256 of its columns.  In each group (a source) the leaves ascend by id; while more than one node
remains, every 16 consecutive nodes become the hash of their concatenation.  What remains is the group's subroot; the
subroots, ascending by group, become the root in the same way.

A node's place is its rank, and a digit of the rank (base 16) is its place among its siblings.  In blocks of 16 ** 3
ranks the digits are grouped away one after the other, the last one first: each grouping hashes the nodes of one parent
and nests them in it, so a block ends as one row that holds its whole subtree.  A block is bounded, whatever the group:
a group with a third of all rows is many blocks.  Where a group has more than one block, the blocks' hashes are the
nodes of the next tree, whose ranks are known already.  Proofs come from the nested rows: ``transform`` goes down and
``explode`` gives a row for each leaf, so no leaf is joined with anything; only blocks (one row for 4096 leaves) meet
the path above them.

Ranks come from one range shuffle by (group, id): a row's place in its partition, and a count for each partition and
group, of which there are as many as partitions and groups together.

Defined cases: a null column is hashed as ``-``, so it differs from an empty text.  A null id stands first in its
group, a null group first of all.  Rows of equal ids are ordered by their leaf; rows that repeat wholly are leaves of
their own, and stand beside one another.  An empty table gives no rows.  Only the named columns are read, so others may
have any name.  Texts of any length are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Nodes of a run, and digits of a block: 16 ** 3 leaves.
FANOUT, DIGITS = 16, 3
_BITS = 4
BLOCK = FANOUT**DIGITS
#: Of ``monotonically_increasing_id``: bits of the place in a partition.
_PLACE = 33


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_hash(columns: list[Column]) -> Column:
    """Each value by its number of UTF-8 bytes and itself, ``-`` for null, so that no two rows are written alike."""
    texts = [c.cast("string") for c in columns]
    return sha(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda digest, step: sha(F.concat(step["before"], digest, step["after"])))


def proof_hash(path: Column) -> Column:
    """Of all siblings, level by level, from left to right."""
    return sha(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their ``rank`` in the group (from 0) and the group's size ``n``; (group, order) decides on places."""
    sorted_ = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = materialize(sorted_.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", _PLACE).alias("part")
    counts = placed.groupBy(part, group).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    by_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("here").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(counts.select("part", group, (before - F.col("first")).alias("shift"), F.sum("here").over(by_group).alias("n")), "offsets")
    return placed.withColumn("part", part).join(offsets, ["part", group]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _depth(n: Column) -> Column:
    """Levels above n nodes: 0 for one, 1 up to 16, 2 up to 256 and so on."""
    return F.when(n <= 1, 0).otherwise(F.ceil((F.length(F.conv((n - 1).cast("string"), 10, 2)) / _BITS))).cast("int")


def _parent(level: int, nodes: Column) -> Column:
    """The hash of a run, or its only node where the group has no such level."""
    digests = F.transform(nodes, lambda x: x["digest"])
    return F.when(F.col("depth") >= level, sha(F.array_join(digests, ""))).otherwise(digests[0])


def _blocks(nodes: DataFrame, group: str) -> DataFrame:
    """(group, block, n, digest, nodes) of nodes (group, rank, n, digest, item): the digits of the rank are grouped away."""
    digit = {level: F.shiftright("rank", _BITS * (level - 1)).bitwiseAND(FANOUT - 1).cast("int").alias(f"d{level}") for level in range(1, DIGITS + 1)}
    block = F.shiftright("rank", _BITS * DIGITS).alias("block")
    rows = nodes.select(group, block, "n", _depth(F.col("n")).alias("depth"), *digit.values(), "digest", "item").repartition(group, "block")
    inner = "item"
    for level in range(1, DIGITS + 1):
        keys = [group, "block", "n", "depth", *(f"d{i}" for i in range(level + 1, DIGITS + 1))]
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(f"d{level}", "digest", inner))).alias("nodes"))
        rows = rows.withColumn("digest", _parent(level, F.col("nodes")))
        inner = "nodes"
    return materialize(rows.select(group, "block", "n", "depth", "digest", "nodes"), "blocks")


def _step(level: int, siblings: Column, place: Column) -> Column:
    """The siblings at one level as an array of no or one step (before, after): none where the group has no such level."""
    def joined(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda x: x["digest"]), "")

    before, after = joined(F.slice(siblings, 1, place)), joined(F.slice(siblings, place + 2, FANOUT))
    return F.when(F.col("depth") >= level, F.array(F.struct(before.alias("before"), after.alias("after")))).otherwise(F.array().cast("array<struct<before:string,after:string>>"))


def _leaves(blocks: DataFrame, *keep: str) -> DataFrame:
    """One row for each node of the blocks: its ``item``, digest, rank and ``path`` up to the block's hash, and the columns of ``keep``."""
    def down(level: int, nodes: Column, above: Column, rank: Column) -> Column:
        def one(x: Column) -> Column:
            place = x[f"d{level}"]
            path, at = F.concat(_step(level, nodes, place), above), rank * FANOUT + place
            if level == 1:
                return F.struct(x["item"].alias("item"), x["digest"].alias("digest"), at.alias("rank"), path.alias("path"))
            return down(level - 1, x["nodes"], path, at)

        found = F.transform(nodes, one)
        return found if level == 1 else F.flatten(found)

    top = F.col("path") if "path" in blocks.columns else F.array().cast("array<struct<before:string,after:string>>")
    return blocks.select(*keep, F.explode(down(DIGITS, F.col("nodes"), top, F.col("block"))).alias("leaf")).select(*keep, "leaf.*")


def _tree(nodes: DataFrame, group: str) -> DataFrame:
    """Blocks of ranked nodes, each with the ``path`` from its hash up to the group's ``top``."""
    levels = [_blocks(nodes, group)]
    while levels[-1].filter(F.col("n") > BLOCK).limit(1).count():
        blocks = levels[-1].filter(F.col("n") > BLOCK)
        above = blocks.select(group, F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), "digest", F.lit(None).cast("boolean").alias("item"))
        levels.append(_blocks(above, group))
    none = F.array().cast("array<struct<before:string,after:string>>")
    known = levels.pop().withColumns({"path": none, "top": F.col("digest")})
    for blocks in reversed(levels):
        paths = _leaves(known, group, "top").select(group, F.col("rank").alias("block"), "path", "top")
        joined = blocks.join(paths, [group, "block"], "left")
        known = joined.withColumns({"path": F.coalesce("path", none), "top": F.coalesce("top", "digest")})
    return known


def merkle_manifest(docs: DataFrame, leaf: Column, group: Column, order: Column, keep: dict[str, Column] | None = None) -> DataFrame:
    """(leaf, subroot, root, path) of each row, and the columns of ``keep``; ``path`` holds (before, after) for each level.

    The group's key is the group's text behind a ``1``, or ``0`` for null: nulls come first, the others by their bytes.
    """
    key = F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))
    rows = docs.select(key.alias("g"), order.alias("o"), leaf.alias("digest"), F.struct(*(c.alias(k) for k, c in (keep or {"none": F.lit(None).cast("boolean")}).items())).alias("item"))
    leaves = materialize(rows, "leaves")  # the range shuffle reads its input twice: not the texts
    blocks = _tree(ranked(leaves, "g", ["o", "digest"]), "g")
    tops = blocks.filter(F.col("block") == 0).select(F.lit("").alias("all"), F.col("g"), F.col("top").alias("digest"))
    over = _tree(ranked(tops, "all", ["g"]).withColumn("item", F.struct("g")), "all")
    above = _leaves(over, "top").select(F.col("item.g").alias("g"), F.col("path").alias("upper"), F.col("top").alias("root"))
    joined = blocks.withColumnRenamed("top", "subroot").join(above, "g").withColumn("path", F.concat("path", "upper"))
    out = _leaves(joined, "subroot", "root")
    return out.select(*(F.col("item")[k].alias(k) for k in keep or {}), F.col("digest").alias("leaf"), "subroot", "root", "path")

