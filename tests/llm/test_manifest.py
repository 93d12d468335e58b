import hashlib

import pytest
from pyspark.sql import functions as F

from seqlattice.llm import manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _climb(digests, fanout):
    """The root and each node's (before, after) by level."""
    paths, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            first = i // fanout * fanout
            path.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])))
        at = [i // fanout for i in at]
        nodes = [_h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def _plain(rows, fanout=16):
    groups = {}
    for doc, source, text in rows:
        groups.setdefault(source, []).append(((doc is not None, doc or 0), _h(*map(_field, (doc, source, text))), doc))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: _climb([leaf for _, leaf, _ in sorted(groups[s])], fanout) for s in order}
    root, tops = _climb([subs[s][0] for s in order], fanout)
    return sorted(((str(doc), leaf, subs[s][0], root, below + above) for s, above in zip(order, tops, strict=True) for (_, leaf, doc), below in zip(sorted(groups[s]), subs[s][1], strict=True)), key=str)


def _got(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, rank long, digest string").repartition(5)
    leaf = manifest.leaf_hash([F.col(c) for c in ("doc_id", "source", "text")])
    found = manifest.merkle_manifest(docs, leaf, F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id")})
    folded = found.withColumns({"folded": manifest.fold(F.col("leaf"), F.col("path")), "proof": manifest.proof_hash(F.col("path"))}).collect()
    assert all(r.folded == r.root for r in folded)
    assert all(r.proof == _h("".join(s.before + s.after for s in r.path)) for r in folded)
    return sorted(((str(r.doc_id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in folded), key=str)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17, 1], [3, 300, 0, 40]])
def test_equals_a_plain_tree(spark, sizes):
    rows = [(1000 * s + 7 * i % 997, f"s{s}", f"text {i}") for s, n in enumerate(sizes) for i in range(n)]
    assert _got(spark, rows) == _plain(rows)


def test_blocks_above_blocks(spark, monkeypatch):
    """Blocks of one digit: trees of blocks of blocks, over a large group and over many groups."""
    monkeypatch.setattr(manifest, "DIGITS", 1)
    monkeypatch.setattr(manifest, "BLOCK", manifest.FANOUT)
    rows = [(i, "large", "t") for i in range(700)] + [(i, f"s{i:03}", "t") for i in range(300)]
    assert _got(spark, rows) == _plain(rows)


def test_defined_cases(spark):
    rows = [(1, None, None), (None, None, ""), (None, "", "é" * 40_000), (2, "", None), (2, "", "A"), (2, "", "A"), (3, "z", "\n"), (3, "é", "b")]
    assert _got(spark, rows) == _plain(rows)
    assert _got(spark, []) == []


def test_leaves_tell_null_from_empty_and_columns_apart(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("", None), (None, ""), ("-", None)], "x string, y string")
    assert rows.select(manifest.leaf_hash([F.col("x"), F.col("y")]).alias("h")).distinct().count() == 5


def test_a_change_is_seen(spark):
    rows = [(i, f"s{i % 3}", f"text {i}") for i in range(60)]
    roots = {r[3] for r in _got(spark, rows)}
    assert len(roots) == 1 and roots != {r[3] for r in _got(spark, [*rows[:-1], (59, "s2", "Text 59")])}
