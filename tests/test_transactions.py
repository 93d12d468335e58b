import random
import uuid

import pytest
from pyspark.sql import functions as F

from seqlattice.operators import graph, mutations
from seqlattice.sources import versions
from seqlattice.sources.storage import shared_dir

WORDS = "id string, entry string, category string, quote_of string, dent array<string>, rank int"


def _tables(spark):
    words = spark.createDataFrame([("0", "root", "t", None, None, 1), ("1", "animal", "n", None, ["k"], 2), ("2", "cat", "n", None, None, 3), ("3", "tom", "n", None, None, 4)], WORDS)
    return words, spark.createDataFrame([("1", "0"), ("2", "1"), ("3", "2")], "child string, parent string")


def test_quotes(spark):
    words, covers = _tables(spark)
    out = mutations.apply_patch(words, covers, [{"op": "materialize_quote", "id": "entry:animal", "as": "q"}, {"op": "set_fields", "id": "q", "set": {"rank": 9}}])
    rows = {r.id: r for r in out.words.collect()}
    assert (rows["q"].entry, rows["q"].category, rows["q"].quote_of, rows["q"].dent, rows["q"].rank) == ("⌜animal⌝", "n", "1", ["k"], 9)
    assert rows["1"].dent is None and rows["2"].rank == 3 and len(rows) == 5
    for again in ({"op": "materialize_quote", "id": "1", "as": "p"}, {"op": "materialize_quote", "id": "q", "as": "p"}, {"op": "set_fields", "id": "q", "set": {"quote_of": "2"}}):
        with pytest.raises(mutations.PatchError):
            mutations.apply_patch(out.words, out.covers, [again])


def test_references_and_states(spark):
    words, covers = _tables(spark)
    refs = spark.createDataFrame([("3", "arguments", "2"), ("9", "relations", "2"), ("2", "relations", "1"), ("9", "relations", "0")], "id string, field string, ref string")
    states = covers.withColumn("state", F.lit("claimed"))
    deletion = {"op": "delete", "id": "2", "reconnect": "parents"}
    with pytest.raises(mutations.PatchError, match="referred"):
        mutations.apply_patch(words, covers, [deletion], refs)
    out = mutations.apply_patch(words, covers, [deletion | {"reference_policy": "remove"}], refs, states)
    assert sorted(map(tuple, out.references.collect())) == [("9", "relations", "0")]
    assert sorted(map(tuple, out.covers.collect())) == [("1", "0"), ("3", "1")]
    assert [tuple(r) for r in out.states.collect()] == [("1", "0", "claimed")]
    kept = mutations.apply_patch(words, covers, [deletion | {"reference_policy": "keep"}], refs)
    assert sorted(map(tuple, kept.references.collect())) == [("3", "arguments", "2"), ("9", "relations", "0"), ("9", "relations", "2")]


def test_a_cycle_is_named(spark):
    with pytest.raises(mutations.PatchError, match="1 -> 3 -> 2 -> 1"):
        mutations.apply_patch(*_tables(spark), [{"op": "set_upper_covers", "id": "1", "from": ["0"], "to": ["3"]}])


def test_sequences_are_derived_anew(spark):
    words = spark.createDataFrame([(str(i), e, "s", None, None, 0) for i, e in enumerate(["", "t", "ta", "tan", "x"])], WORDS)
    covers = spark.createDataFrame([("1", "0"), ("2", "0"), ("3", "1"), ("4", "0")], "child string, parent string")
    out = mutations.apply_patch(words, covers, [{"op": "add", "id": "5", "entry": "tano", "category": "s"}], sequences=F.col("entry") != "")
    assert sorted(map(tuple, out.covers.collect())) == [("1", "0"), ("2", "1"), ("3", "2"), ("4", "0"), ("5", "3")]
    assert {(r.child, tuple(r.expected), tuple(r.actual)) for r in out.derived.collect()} == {("2", ("1",), ()), ("3", ("2",), ("1",)), ("5", ("3",), ())}
    assert [tuple(r) for r in mutations.lower_covers(out.covers).filter("parent = '0'").orderBy("place").collect()] == [("0", 2, "1", 1), ("0", 2, "4", 2)]


def _plain(parents, patch):
    """The same operations one after the other over a dict of sets, then the reduction."""
    up = {c: set(p) for c, p in parents.items()}

    def reaches(a, b, seen=()):
        return any(p == b or reaches(p, b, (*seen, a)) for p in up.get(a, ()) if p not in seen)

    for op in patch:
        if op["op"] == "add":
            up[op["id"]] = set(op["upper_covers"])
        elif op["op"] == "set_upper_covers":
            up[op["id"]] = set(op["to"])
        else:
            gone = up.pop(op["id"])
            for c, p in up.items():
                if op["id"] in p:
                    p.remove(op["id"])
                    p |= gone - {c}
    return {(c, p) for c, ps in up.items() for p in ps if not any(q != p and reaches(q, p) for q in ps)}


@pytest.mark.parametrize("seed", range(3))
def test_equals_one_operation_after_the_other(spark, seed):
    rng = random.Random(seed)
    parents = {str(i): set(map(str, rng.sample(range(i), min(i, rng.randint(0, 3))))) for i in range(40)}
    now = {c: set(p) for c, p in parents.items()}
    patch, alive, new = [], [str(i) for i in range(40)], 40
    for _ in range(9):
        kind = rng.choice(["add", "set", "delete", "delete"])
        if kind == "add":
            patch.append({"op": "add", "id": str(new), "entry": f"w{new}", "category": "n", "upper_covers": rng.sample(alive, 2)})
            now[str(new)] = set(patch[-1]["upper_covers"])
            alive.append(str(new))
            new += 1
            continue
        node = rng.choice(alive)
        if kind == "set":
            to = [a for a in rng.sample(alive, 3) if int(a) < int(node)]
            patch.append({"op": "set_upper_covers", "id": node, "from": sorted(now[node]), "to": to})
            now[node] = set(to)
        else:
            patch.append({"op": "delete", "id": node, "reconnect": "parents"})
            alive.remove(node)
            gone = now.pop(node)
            for c, p in now.items():
                if node in p:
                    p.remove(node)
                    p |= gone - {c}
    words = spark.createDataFrame([(i, f"w{i}", "n", None, None, 0) for i in parents], WORDS)
    covers = spark.createDataFrame([(c, p) for c, ps in parents.items() for p in ps], "child string, parent string")
    out = mutations.apply_patch(words, covers, patch)
    assert {tuple(r) for r in out.covers.collect()} == _plain(parents, patch)
    assert {r.id for r in out.words.collect()} == set(alive)


def test_versions(spark):
    root = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    one, two = (spark.createDataFrame([(i, str(i)) for i in r], "a int, b string") for r in (range(50), range(51)))
    assert versions.current(spark, root) is None
    v1 = versions.publish(spark, root, {"t": one}, None)
    assert versions.current(spark, root) == v1 and versions.read(spark, root, "t").count() == 50
    assert versions.version_of({"t": one.repartition(7).orderBy(F.desc("a")).select("b", "a")}) == v1 != versions.version_of({"t": two})
    assert versions.table_hash(one) != versions.table_hash(one.unionByName(one.limit(1)))
    nulls = spark.createDataFrame([(None, ""), (1, None)], "a int, b string")
    assert versions.table_hash(nulls) != versions.table_hash(spark.createDataFrame([(None, None), (1, "")], "a int, b string"))
    for base in (None, "x"):
        with pytest.raises(versions.StaleBaseError):
            versions.publish(spark, root, {"t": two}, base)
    assert versions.publish(spark, root, {"t": one}, v1) == v1
    v2 = versions.publish(spark, root, {"t": two}, v1)
    with pytest.raises(versions.StaleBaseError):
        versions.publish(spark, root, {"t": one}, v1)
    assert versions.current(spark, root) == v2 and versions.read(spark, root, "t").count() == 51
    assert versions.publish(spark, root, {"t": one}, v2) == v1 and versions.publish(spark, root, {"t": two}, v1) == v2


def test_a_failure_leaves_the_old_version(spark):
    root = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    one = spark.createDataFrame([(1,)], "a int")
    v1 = versions.publish(spark, root, {"t": one}, None)
    bad = one.select(F.raise_error(F.lit("no")).alias("a"))
    with pytest.raises(Exception, match="no"):
        versions.publish(spark, root, {"t": bad}, v1)
    assert versions.current(spark, root) == v1
    assert versions.publish(spark, root, {"t": one.unionByName(one)}, v1) == versions.current(spark, root) != v1


def test_cycle_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("b", "d"), ("d", "e"), ("x", "x"), ("p", "q"), ("q", "r"), ("r", "s"), ("s", "p"), ("q", "s"), ("t", "p"), ("u", None)], "child string, parent string")
    assert {r.root: r.path for r in graph.cycle_paths(edges).collect()} == {"a": list("abca"), "x": ["x", "x"], "p": list("pqsp")}
    assert graph.cycle_paths(edges.filter("child in ('d', 't')")).count() == 0


def test_cycle_paths_without_a_closure(spark, monkeypatch):
    """Random graphs and a hub with 2000 nodes on cycles against plain searches; the pairs of what reaches what are never made."""
    rng = random.Random(5)
    edges = [("h", f"h{i}") for i in range(2000)] + [(f"h{i}", "h") for i in range(2000)] + [(f"i{i}", "h") for i in range(50)]
    for g in range(12):
        edges += [(f"{g}-{rng.randrange(14)}", f"{g}-{rng.randrange(14)}") for _ in range(rng.choice((8, 14, 20, 30)))]
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)

    def above(node):
        seen, last = set(), {node}
        while last:
            last = {y for x in last for y in up.get(x, ())} - seen
            seen |= last
        return seen

    reach = {x: above(x) for x in up if not x.startswith(("h", "i"))} | {"h": above("h")}
    need = {}
    for root in reach:
        if root in reach[root] and not any(y < root and root in reach.get(y, ()) for y in reach[root]):
            paths = [[root]]
            while root not in need:
                last = {}
                for p in paths:
                    for y in up.get(p[-1], ()):
                        last[y] = min(last.get(y, [*p, y]), [*p, y])
                paths = list(last.values())
                need |= {root: last[root]} if root in last else {}

    def no_pairs(*args):
        raise AssertionError("a closure")

    monkeypatch.setattr(graph, "closure", no_pairs)
    found = graph.cycle_paths(spark.createDataFrame(edges, "child string, parent string")).collect()
    assert {r.root: r.path for r in found} == need and len(found) == len(need) > 12
