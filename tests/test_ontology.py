import pytest

from seqlattice.operators import ontology as o


def _words(spark, *rows):
    base = {"entry": None, "category": "n", "arguments": [1], "is_function": False, "upper_covers": [], "partitions": None, "cover_states": None, "generator": None, "dent": None, "quote_of": None, "meta_props": None, "axioms": None}
    return spark.createDataFrame([{**base, "entry": f"e{r['id']}", **r} for r in rows], o.SCHEMA)


def _codes(issues):
    return sorted((r.code, r.id) for r in issues.collect())


KIND = {"key": "kind", "kind": "コンストラクタ", "disjoint": None, "exhaustive": None}


def _state(parent, partition=None, state="配置"):
    return {"parent": parent, "state": state, "partition": partition}


@pytest.fixture
def animals(spark):
    return _words(
        spark, {"id": 0, "partitions": [KIND]},
        {"id": 1, "upper_covers": [0], "cover_states": [_state(0, "kind")]}, {"id": 2, "upper_covers": [0], "cover_states": [_state(0, "kind")]},
        {"id": 3, "upper_covers": [1, 2]}, {"id": 4, "upper_covers": [3]},
    )


def test_disjoint_branches(animals):
    assert _codes(o.placement_issues(animals)) == [("DISJOINT_PARTITION_VIOLATION", 3)]
    assert _codes(o.validated(animals)) == [("DISJOINT_PARTITION_VIOLATION", 3)]
    assert {(r.parent, r.state): r.n for r in o.child_states(animals).collect()}[(0, "配置")] == 2


def test_undecided_covers_state_nothing(spark):
    words = _words(spark, {"id": 0, "partitions": [KIND]}, {"id": 1, "upper_covers": [0], "cover_states": [_state(0, "kind")]}, {"id": 2, "upper_covers": [0], "cover_states": [_state(0, "kind")]}, {"id": 3, "upper_covers": [1, 2], "cover_states": [_state(2, None, "上位未決")]})
    assert _codes(o.placement_issues(words)) == []


def test_placement_records(spark):
    words = _words(
        spark, {"id": 0, "partitions": [KIND, KIND, {**KIND, "key": ""}, {**KIND, "key": "x", "kind": "?"}]},
        {"id": 1, "upper_covers": [0], "cover_states": [_state(0, "none"), _state(0), _state(9)]},
        {"id": 2, "upper_covers": [0], "cover_states": [_state(0, "kind", "上位未決")]}, {"id": 3, "upper_covers": [0], "cover_states": [_state(0, None, "?")]},
    )
    assert _codes(o.placement_issues(words)) == [("COVER_STATE_NOT_A_COVER", 1), ("DUPLICATE_COVER_STATE", 1), ("DUPLICATE_PARTITION", 0), ("INVALID_COVER_STATE", 3), ("INVALID_PARTITION", 0), ("INVALID_PARTITION", 0), ("PARTITION_ON_UNPLACED", 2), ("UNKNOWN_PARTITION", 1)]
    assert [len(r.cover_states) for r in o.pruned_states(words).filter("id = 1").collect()] == [2]


def test_kinds(spark):
    words = _words(
        spark, {"id": 0, "generator": {"tArity": 1, "isFunc": False}, "arguments": [0, 0]}, {"id": 1}, {"id": 2, "arguments": [0, 0]},
        {"id": 3, "is_function": True, "dent": [0]}, {"id": 4, "is_function": True, "quote_of": 1}, {"id": 5, "category": "other"},
    )
    assert sorted(tuple(r) for r in o.kind_members(words).collect()) == [(0, 3, "word", "fact"), (0, 4, "word", "signature")]
    assert _codes(o.kind_issues(words)) == []
    bad = _words(spark, {"id": 0, "generator": {"tArity": -1, "isFunc": False}}, {"id": 1, "dent": [7, 0, 0]}, {"id": 2, "quote_of": 9}, {"id": 3, "quote_of": 1, "upper_covers": [0]}, {"id": 4, "quote_of": 1, "is_function": True})
    assert _codes(o.kind_issues(bad)) == [("DENT_ON_QUOTED_SOURCE", 3), ("DENT_ON_QUOTED_SOURCE", 4), ("DUPLICATE_DENT", 1), ("DUPLICATE_QUOTE", 4), ("INVALID_DENT", 1), ("INVALID_GENERATOR", 0), ("INVALID_QUOTE_OF", 2), ("QUOTE_NOT_CONSTANT", 3), ("QUOTE_WITH_COVERS", 3)]


def test_properties_of_relations(spark):
    props = {"functional": [1], "total_on": [{"node": 2, "arg": 1}], "symmetric": True, "transitive": None, "elidable": [1, 2]}
    words = _words(spark, {"id": 0}, {"id": 1, "upper_covers": [0]}, {"id": 2}, {"id": 3, "arguments": [0, 0], "meta_props": props}, {"id": 4, "meta_props": {**props, "functional": [3], "total_on": [{"node": 9, "arg": 1}], "elidable": []}})
    assert _codes(o.property_issues(words)) == [("ELIDABLE_NOT_DETERMINED", 3), ("INVALID_META_PROPS", 4), ("INVALID_META_PROPS", 4), ("META_PROPS_ON_NON_RELATION", 4), ("TOTAL_ON_OUTSIDE_DOMAIN", 3)]


def _axiom(kind, **fields):
    return {"kind": kind, "relation": None, "hub": None, "projections": None, "genus": None, "differentia": None, "text": None, "refs": None, **fields}


def test_axioms(spark):
    words = _words(
        spark, {"id": 0}, {"id": 1, "upper_covers": [0], "axioms": [_axiom("定義", genus=0, differentia=[{"relation": 2, "value": 0}]), _axiom("定義", genus=2)]},
        {"id": 2, "axioms": [_axiom("引き下げ", relation=0, hub=1, projections=[0]), _axiom("式", text=" ", refs=[8]), _axiom("?")]},
    )
    assert _codes(o.axiom_issues(words)) == [("AXIOM_OUTSIDE_SCHEMA", 2), ("DEFINITION_GENUS_NOT_ANCESTOR", 1), ("DEFINITION_WITHOUT_DIFFERENTIA", 1), ("INVALID_AXIOM", 2), ("INVALID_AXIOM", 2), ("INVALID_AXIOM", 2), ("INVALID_AXIOM", 2)]
    assert {r.id: len(r.axioms) for r in o.pruned_axioms(words).filter("axioms is not null").collect()} == {1: 2, 2: 2}


def test_rules_on_records_wait_for_references(spark):
    words = _words(spark, {"id": 0}, {"id": 1, "upper_covers": [5], "quote_of": 9})
    assert _codes(o.validated(words)) == [("DANGLING_REFERENCE", 1)]
