from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqlattice.operators import issues


def _matched(text):
    """Closing place of each opening brace, by a stack; places from 1."""
    out, stack = {}, []
    for i, c in enumerate(text, 1):
        if c == "{":
            out[i] = None
            stack.append(i)
        elif c == "}" and stack:
            out[stack.pop()] = i
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text("{}ab\n", max_size=40), min_size=1, max_size=6))
def test_braces_match_as_with_a_stack(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "file long, text string")
    got = issues.braces(issues._texts(rows, "file", "text")).collect()
    assert {(r.file, r.opening): r.closing for r in got} == {(k, o): c for k, t in enumerate(texts) for o, c in _matched(t).items()}


TEXT = r"""% @issue ISSUE-7
\todo{one {nested
and} on
  more lines} rest }
%@issue ISSUE-12

a \memo{first} b \fixme{second}
% @issue ISSUE-9


\todo{too far}
  % \todo{commented}
\memo{never tracked}
% @issue ISSUE-3
\fixme{open {end}
"""


def _files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t, "clash") for i, t in enumerate(texts)], "file string, text string, line string")


def test_scan(spark):
    got = {r.id: (r.line, r.type, r.text) for r in issues.scan(_files(spark, TEXT, None, "", TEXT.replace("\n", "\r\n").replace("ISSUE-", "ISSUE-10"))).collect()}
    assert got["ISSUE-7"] == (1, "todo", "one {nestedand} on\n  more lines")
    assert got["ISSUE-12"] == (5, "fixme", "second")
    assert got["ISSUE-9"] == (8, "?", "")
    assert got["ISSUE-3"] == (14, "fixme", "open {end}")
    assert {k: got["ISSUE-10" + k[6:]] for k in list(got) if len(k) < 9} == {k: v for k, v in got.items() if len(k) < 9}


def test_untagged_and_new_ids(spark):
    files = _files(spark, TEXT, r"\todo{x}")
    found = issues.scan(files)
    open_ = issues.untagged(files)
    assert sorted((r.file, r.line, r.content) for r in open_.collect()) == [("f0", 7, r"a \memo{first} b \fixme{second}"), ("f0", 11, r"\todo{too far}"), ("f1", 1, r"\todo{x}")]
    assert [r.id for r in issues.assigned(open_, found).orderBy("file", "line").collect()] == ["ISSUE-013", "ISSUE-014", "ISSUE-015"]
    assert issues.next_id(found.limit(0)).first().next == 1
    assert issues.assigned(open_.limit(0), found).count() == 0


def test_ids_on_one_side(spark):
    known = spark.createDataFrame([("ISSUE-7",), ("ISSUE-99",), (None,)], "id string")
    got = {(r.id, r.only_in) for r in issues.unsynchronised(issues.scan(_files(spark, TEXT)), known).collect()}
    assert got == {("ISSUE-12", "texts"), ("ISSUE-9", "texts"), ("ISSUE-3", "texts"), ("ISSUE-99", "list")}


def test_no_files(spark):
    none = _files(spark, TEXT).filter(F.lit(False))
    assert issues.scan(none).count() == issues.untagged(none).count() == 0
