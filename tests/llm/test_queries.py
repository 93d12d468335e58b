import pytest
from pyspark.sql import functions as F

from seqlattice.llm import queries
from seqlattice.llm.oracles import ORACLES

from ..compare import assert_same, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    assert_same(queries.queries()[name](spark, small), connect(small), ORACLES[name])


def test_there_is_one_query_for_each_operator():
    assert {int(k[2:].split("_")[0]) for k in queries.queries()} == set(range(1, 14))


def test_base_counts_equal_sql(spark, small):
    """The base of the quality rules; the verdict needs a tokenizer."""
    sql = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
    g AS (SELECT doc_id, w, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
    r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
    l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(w) AS base_failed
    FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)"""
    got = queries.op4_quality_rules(spark, small)
    assert_same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), connect(small), sql)
    assert got.filter("base_failed AND kept").count() == 0


def test_quality_keeps_clean_documents(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet").filter("quality = 1")
    judged = queries.op4_quality_rules(spark, small).join(labels, "doc_id").filter("NOT base_failed")
    assert judged.count() > 0 and judged.filter("NOT kept").count() == 0


def test_token_counts_equal_the_library(spark, small):
    from tokenizers import Tokenizer

    from seqlattice.llm.common import tokenizer_path
    from seqlattice.llm.token_counts import VOCABULARY

    library = Tokenizer.from_file(tokenizer_path(VOCABULARY))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op5_token_counts(spark, small).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_licences_equal_plain_search(spark, small):
    lines = ["licensed under the apache license, version 2.0", "released under the mit license", "licensed under cc by-nc 4.0", "this work is licensed under the gnu general public license, version 3", "all rights reserved"]
    texts = {r.doc_id: (r.text or "").lower() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op10_license_scan(spark, small).collect():
        assert r.n_matches == sum(texts[r.doc_id].count(x) for x in lines)


def test_pages_equal_the_article(spark, small):
    import html
    import re

    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in queries.op3_html_extraction(spark, small).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)
        plain = re.sub(r"[ \t\n\x0b\f\r]+", " ", html.unescape(re.sub(r"<[^>]*>", " ", article[1]))).strip(" ")
        assert (r.text, r.n_chars) == (plain, len(plain))


def test_samples_decode_and_differ(spark, small):
    for r in queries.op7_sentencepiece(spark, small).collect():
        assert all(s.decoded for s in r.samples)
        assert len({s.sha256 for s in r.samples}) == len(r.samples)
        assert [s.value for s in r.samples] == sorted((s.value for s in r.samples), reverse=True)


def test_samples_have_their_pieces(spark, small):
    """The whole segmentations are in the rows: the library decodes them to the text, and the figures are theirs."""
    import hashlib

    import numpy as np
    import sentencepiece

    from seqlattice.llm.common import tokenizer_path

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op7_sentencepiece(spark, small).collect():
        assert len(r.samples) == 2 * (texts[r.doc_id] != "")
        for s in r.samples:
            assert model.decode(s.ids) == texts[r.doc_id] and len(s.ids) == s.n_pieces
            assert hashlib.sha256(np.array(s.ids, "<i4").tobytes()).hexdigest() == s.sha256


def test_long_shared_passages_are_found(spark, small):
    from collections import defaultdict

    texts = {r.doc_id: (r.text or "").lower().split() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    holders = defaultdict(set)
    for i, words in texts.items():
        for p in range(len(words) - 50):
            holders[tuple(words[p : p + 51])].add(i)
    need = set().union(*(h for h in holders.values() if len(h) > 1))
    found = queries.op2_substring_dedup(spark, small)
    got = {x for r in found.select("doc_id", "other_doc_id").collect() for x in r}
    assert need <= got
    assert found.filter(F.col("doc_id") <= F.col("other_doc_id")).count() == 0
