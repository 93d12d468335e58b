import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, small):
    from seqlattice.llm import decontaminate, line_dedup, minhash, quality_rules
    from seqlattice.llm.common import materialize, table

    docs = table(spark, small, "documents")
    (_, quality), (_, lines), (_, near), (_, benchmark), (_, pieces) = pipeline.STAGES

    one = materialize(quality(spark, docs, small), "t")
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept

    two = materialize(lines(spark, one, small), "t")
    text = {r.doc_id: r["__lines"].text for r in line_dedup.apply_bitmaps(one, line_dedup.line_dedup(one)).collect()}
    assert two.columns == docs.columns and {r.doc_id: r.text for r in two.collect()} == text
    assert two.filter(F.length("text") != F.col("n_chars")).count() == 0

    three = materialize(near(spark, two, small), "t")
    rows = minhash.minhash_dedup(two).collect()
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == sorted({r.component_id for r in rows})

    four = materialize(benchmark(spark, three, small), "t")
    leaks = {r.doc_id for r in decontaminate.decontaminate(three, table(spark, small, "benchmark")).filter("__n_hit > 0").collect()}
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()} - leaks

    five = pieces(spark, four, small).collect()
    assert len(five) == four.count() and all(s.decoded and s.n_pieces == len(s.ids) for r in five for s in r.samples)


def test_run_equals_the_stages(spark, small):
    out = pipeline.run(spark, small)
    assert 0 < out.count() < spark.read.parquet(f"{small}/documents.parquet").count()


def test_repeated_rows_and_nulls(spark, small):
    rows = [(1, "a b c " * 12, "en", "s", 72), (1, "a b c " * 12, "en", "s", 72), (None, None, None, None, None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
    assert pipeline.STAGES[2][1](spark, docs, small).filter("doc_id = 1").count() == 1


def test_one_row_of_each_group_stays(spark, small):
    words = [f"w{i}" for i in range(80)]
    near = " ".join([*words[:79], "other"])
    rows = [(1, " ".join(words)), (1, near), (2, near), (3, "something else " * 9), (3, "quite another text of its own"), (None, near), (None, "alone and without a name")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in pipeline.STAGES[2][1](spark, docs, small).collect()]
    assert sorted(str(i) for i, _ in kept) == ["1", "3", "3", "None"] and {t for i, t in kept if i is None} == {"alone and without a name"}


def test_empty_tables_long_texts_and_clashing_columns(spark, small):
    from seqlattice.llm.common import table

    clash = {c: F.lit("x") for c in ("__lines", "__n_hit", "__n_words", "__kept_row", "row", "tx", "kept", "in_band", "rep", "root", "raw", "doc", "bitmap", "n_dropped")}
    docs = table(spark, small, "documents").limit(30).withColumns(clash)
    long = docs.limit(1).withColumns({"doc_id": F.lit(10**6).cast("long"), "text": F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("word"), F.xxhash64(i).cast("string"))))})
    docs = docs.unionByName(long)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.count() <= 31 and stage(spark, docs.limit(0), small).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), small).count() == 0
