"""Patches of a graph of words: a list of operations with preconditions, applied as a whole or not at all.

A patch is small, the tables are not.  The words that its operations name, with their parents, are read once; the
operations run one after the other over these few rows, each with its preconditions, and leave a log: rows that replace
others, words that are gone, and what stands in for a deleted parent.  The log is then folded over the tables in one pass:
a child that no operation names goes through the deletions of its parents in their order.  Each table is written once.
The result counts only if the graph's rules hold afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut
from . import graph, search

#: Columns that say what a word is: no operation sets them.
FIXED = ("id", "quote_of")


class PatchError(ValueError):
    """A precondition failed or the result breaks a rule; nothing is changed."""


@dataclass(frozen=True)
class Patched:
    """The tables after a patch; ``derived`` (child, expected, actual) are the covers that were derived anew."""

    words: DataFrame
    covers: DataFrame
    references: DataFrame | None = None
    states: DataFrame | None = None
    derived: DataFrame | None = None
    removed: DataFrame | None = None


def with_parents(words: DataFrame, covers: DataFrame) -> DataFrame:
    """Words with the sorted list of their parents."""
    parents = covers.groupBy(F.col("child").alias("id")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    return words.join(parents, "id", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))


def lower_covers(covers: DataFrame) -> DataFrame:
    """(parent, n, child, place): the other direction of the covers, each parent's children in order."""
    by = Window.partitionBy("parent")
    return covers.select("parent", "child").distinct().select("parent", F.count("*").over(by).alias("n"), "child", F.row_number().over(by.orderBy("child")).alias("place"))


def parents_of(covers: DataFrame, node: str) -> set[str]:
    return {r.parent for r in covers.filter(F.col("child") == node).select("parent").distinct().collect()}


def changes(before: Patched, after: Patched, fields: list[str]) -> DataFrame:
    """(id, change, fields): words that were added, deleted or updated; ``parents`` is a field like the columns named."""
    return search.difference(with_parents(before.words, before.covers), with_parents(after.words, after.covers), "id", [*fields, "parents"])


@dataclass
class _Log:
    """The few rows that operations name, and what became of them."""

    columns: list[str]
    words: dict[str, dict]
    #: Of each named word its parents, and whether a parent stands in for a deleted one.
    parents: dict[str, dict[str, bool]]
    #: Words above some word that no operation names.
    peopled: set[str]
    #: (word, what names it) by references of words that no operation names, and of named ones.
    referenced: set[str]
    refers: list[tuple[str, str]]
    written: set[str] = field(default_factory=set)
    gone: dict[str, str] = field(default_factory=dict)
    stand_in: list[tuple[str, list[str]]] = field(default_factory=list)

    def resolve(self, ref: str) -> dict:
        by, value = ("entry", ref[6:]) if ref.startswith("entry:") else ("id", ref.removeprefix("id:"))
        found = [w for w in self.words.values() if w[by] == value]
        if len(found) != 1:
            raise PatchError(f"{ref}: {'no word' if not found else 'more than one word'}")
        return found[0]

    def new(self, id_: str, above: list[str], **fields) -> None:
        if id_ in self.words:
            raise PatchError(f"{id_} is taken")
        unknown = set(fields) - set(self.columns)
        if unknown:
            raise PatchError(f"words have no {', '.join(sorted(unknown))}")
        self.words[id_] = dict.fromkeys(self.columns) | fields | {"id": id_}
        self.parents[id_] = dict.fromkeys(above, False)
        self.written.add(id_)
        self.gone.pop(id_, None)

    def add(self, op: dict) -> None:
        above = [self.resolve(p) for p in op.get("upper_covers", [])]
        kinds = {r["category"] for r in above}
        if not op.get("category") and len(kinds) != 1:
            raise PatchError(f"{op['id']}: its category can't be told from its parents")
        self.new(op["id"], [r["id"] for r in above], entry=op["entry"], category=op.get("category") or kinds.pop(), **op.get("fields", {}))

    def set_fields(self, op: dict) -> None:
        row = self.resolve(op["id"])
        for name, value in op.get("expect", {}).items():
            if row.get(name) != value:
                raise PatchError(f"{row['id']}.{name} is {row.get(name)!r}, not {value!r}")
        for name, value in op["set"].items():
            if name in FIXED or name not in self.columns:
                raise PatchError(f"{name} can't be set")
            row[name] = value
        self.written.add(row["id"])

    def set_upper_covers(self, op: dict) -> None:
        node = self.resolve(op["id"])["id"]
        to = [self.resolve(p)["id"] for p in op["to"]]
        if node in to:
            raise PatchError(f"{node} can't be above itself")
        if set(self.parents[node]) != set(op["from"]):
            raise PatchError(f"{node}: its parents aren't {op['from']}")
        self.parents[node] = dict.fromkeys(to, False)

    def delete(self, op: dict) -> None:
        node = self.resolve(op["id"])["id"]
        reconnect, policy = op.get("reconnect", "none") == "parents", op.get("reference_policy", "reject")
        below = [c for c, up in self.parents.items() if node in up]
        if not reconnect and policy == "reject" and (below or node in self.peopled):
            raise PatchError(f"{node} has words below it")
        if policy == "reject" and (node in self.referenced or any(ref == node and id_ in self.words and id_ != node for id_, ref in self.refers)):
            raise PatchError(f"{node} is referred to")
        up = list(self.parents.pop(node)) if reconnect else self.parents.pop(node) and []
        for child in below:
            own = self.parents[child]
            del own[node]
            own.update({p: True for p in up if p != child and p not in own})
        if node in self.peopled:
            self.peopled.remove(node)
            self.peopled.update(up)
        self.stand_in.append((node, up))
        del self.words[node]
        self.written.discard(node)
        self.gone[node] = policy

    def materialize_quote(self, op: dict) -> None:
        """The word's name as a word of its own, a constant; what tells the word's kind moves there."""
        if "quote_of" not in self.columns:
            raise PatchError("words have no quote_of")
        row = self.resolve(op["id"])
        if row["quote_of"] is not None:
            raise PatchError(f"{row['entry']} is a quote itself")
        live = [i for i, w in self.words.items() if w["quote_of"] == row["id"]]
        if live:
            raise PatchError(f"{row['entry']} is quoted by {live[0]} already")
        extra = {"arguments": [op["as"]], "is_function": True, "dent": row.get("dent")}
        self.new(op["as"], [], entry=f"⌜{row['entry']}⌝", category=op.get("category") or row["category"], quote_of=row["id"], **{k: v for k, v in extra.items() if k in self.columns})
        if row.get("dent") is not None:
            row["dent"] = None
            self.written.add(row["id"])


_OPERATIONS = {f.__name__: f for f in (_Log.add, _Log.set_fields, _Log.set_upper_covers, _Log.delete, _Log.materialize_quote)}


def _named(patch: list[dict]) -> tuple[list[str], list[str]]:
    """Ids and entries that the operations name."""
    refs = [r for op in patch for r in (op.get("id"), op.get("as"), *op.get("upper_covers", []), *op.get("to", []), *op.get("from", [])) if r is not None]
    return [r.removeprefix("id:") for r in refs if not r.startswith("entry:")], [r[6:] for r in refs if r.startswith("entry:")]


def _read_log(words: DataFrame, covers: DataFrame, references: DataFrame | None, patch: list[dict]) -> _Log:
    """What the patch names: its words, their quotes, the parents of both, and whether others stand below or refer to them."""
    ids, entries = _named(patch)
    mine = F.col("id").isin(ids) | F.col("entry").isin(entries)
    mine = mine | F.col("quote_of").isin(ids) if "quote_of" in words.columns else mine
    rows = {r.id: r.asDict() for r in words.filter(mine).collect()}
    parents: dict[str, dict[str, bool]] = {i: {} for i in rows}
    above = covers.filter(F.col("child").isin(list(rows)))
    for r in above.select("child", "parent").distinct().collect():
        parents[r.child][r.parent] = False
    deleted = {r for op in patch if op.get("op") == "delete" for r in rows if r in (op["id"], op["id"].removeprefix("id:")) or f"entry:{rows[r]['entry']}" == op["id"]}
    upward = list(deleted | {p for d in deleted for p in parents[d]})
    peopled = {r.parent for r in covers.filter(F.col("parent").isin(upward) & ~F.col("child").isin(list(rows))).select("parent").distinct().collect()} if upward else set()
    referenced, refers = set(), []
    if references is not None and deleted:
        near = references.filter(F.col("ref").isin(list(deleted)))
        referenced = {r.ref for r in near.filter(~F.col("id").isin(list(rows))).select("ref").distinct().collect()}
        refers = [(r.id, r.ref) for r in near.filter(F.col("id").isin(list(rows))).select("id", "ref").distinct().collect()]
    return _Log(words.columns, rows, parents, peopled, referenced, refers)


def _folded(covers: DataFrame, log: _Log, named: list[str]) -> DataFrame:
    """(child, parent, linked) after the log; ``linked`` where a parent stands in for a deleted one."""
    others = covers.select("child", "parent").filter(~F.col("child").isin(named))
    spark = covers.sparkSession
    own = spark.createDataFrame([(c, p, linked) for c, up in log.parents.items() for p, linked in up.items()], "child string, parent string, linked boolean")
    out = others.withColumn("linked", F.lit(False))
    if log.stand_in:
        hit = others.filter(F.col("parent").isin([n for n, _ in log.stand_in])).select("child").distinct()
        lists = others.join(hit, "child", "left_semi").groupBy("child").agg(F.collect_set(F.struct("parent", F.lit(False).alias("linked"))).alias("up"))
        events = F.array(*(F.struct(F.lit(n).alias("node"), F.array(*(F.struct(F.lit(p).alias("parent"), F.lit(True).alias("linked")) for p in up)).cast("array<struct<parent:string,linked:boolean>>").alias("up")) for n, up in log.stand_in))

        def step(up: Column, event: Column) -> Column:
            without = F.filter(up, lambda x: x["parent"] != event["node"])
            return F.when(F.exists(up, lambda x: x["parent"] == event["node"]), F.concat(without, event["up"])).otherwise(up)

        folded = lists.select("child", F.explode(F.aggregate(events, F.col("up"), step)).alias("x")).select("child", "x.parent", "x.linked").filter("child <> parent")
        out = out.join(hit, "child", "left_anti").unionByName(folded)
    return out.unionByName(own).groupBy("child", "parent").agg(F.min("linked").alias("linked"))


def _derived(words: DataFrame, covers: DataFrame, sequences: Column) -> tuple[DataFrame, DataFrame]:
    """Covers between the words of ``sequences`` by the longest prefix of their entries, and what that changed."""
    mine = cut(words.filter(sequences).select("id", "entry"))
    by_entry = mine.groupBy(F.col("entry").alias("parent")).agg(F.min("id").alias("up"))
    found = graph.prefix_covers(mine, "entry").filter("parent is not null").join(by_entry, "parent").join(mine, F.col("word") == F.col("entry")).select(F.col("id").alias("child"), F.col("up").alias("parent"))
    inside = covers.join(mine.select(F.col("id").alias("child")), "child", "left_semi").join(mine.select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent")
    found = cut(found)
    return covers.join(inside, ["child", "parent"], "left_anti").unionByName(found), graph.cover_mismatches(found, inside)


def apply_patch(words: DataFrame, covers: DataFrame, patch: list[dict], references: DataFrame | None = None, states: DataFrame | None = None, sequences: Column | None = None) -> Patched:
    """All operations in order, covers derived anew, the reduction, and what lost its cover; raises PatchError if a rule is broken.

    Operations: ``add``, ``set_fields``, ``set_upper_covers``, ``delete``, ``materialize_quote``.  ``words`` has id, entry,
    category and any further columns; ``references`` (id, field, ref) hold off a deletion or go with it, by the operation's
    ``reference_policy``; ``states`` (child, parent, state) stay only where the cover does; ``sequences`` picks the words whose
    covers follow from their entries.
    """
    log = _read_log(words, covers, references, patch)
    named = list(log.words)
    for op in patch:
        if op.get("op") not in _OPERATIONS:
            raise PatchError(f"no operation {op.get('op')!r}")
        _OPERATIONS[op["op"]](log, op)
    rows = [tuple(log.words[i][c] for c in words.columns) for i in sorted(log.written)]
    kept = words.filter(~F.col("id").isin([*log.written, *log.gone]))
    new_words = cut(kept.unionByName(words.sparkSession.createDataFrame(rows, words.schema)))
    tagged = _folded(covers, log, [*named, *log.parents])
    edges = tagged.select("child", "parent")
    if any(up for _, up in log.stand_in):
        # a parent that stands in must not lie below the child
        tagged = cut(tagged)
        plain = tagged.filter("not linked").select("child", "parent")
        against = graph.closure(plain).select(F.col("ancestor").alias("child"), F.col("child").alias("parent"))
        edges = plain.unionByName(tagged.filter("linked").select("child", "parent").join(against, ["child", "parent"], "left_anti"))
    derived = None
    if sequences is not None:
        edges, derived = _derived(new_words, edges, sequences)
    edges = cut(edges)
    closed = graph.closure(edges)
    cycle = graph.cycle_paths(edges, closed).limit(1).collect()
    if cycle:
        raise PatchError(f"a cycle: {' -> '.join(cycle[0].path)}")
    removed = graph.redundant(edges, closed)
    new_covers = cut(edges.join(removed, ["child", "parent"], "left_anti"))
    broken = graph.issues(new_words, new_covers, closed).filter("severity = 'error'").limit(5).collect()
    if broken:
        raise PatchError("; ".join(f"{r.code} {r.id} {r.ref}" for r in broken))
    if references is not None and log.gone:
        drop = [n for n, policy in log.gone.items() if policy == "remove"]
        references = cut(references.filter(~F.col("id").isin(list(log.gone)) & ~F.col("ref").isin(drop)))
    if states is not None:
        states = cut(states.join(new_covers, ["child", "parent"], "left_semi"))
    return Patched(new_words, new_covers, references, states, derived, removed)
