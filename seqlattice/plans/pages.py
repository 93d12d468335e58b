"""Queries over pages as marked text: comments become tags, paragraphs markers, and other elements braces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import issues
from ..sources.tables import table

#: (pattern, what stands for it): Java's and RE2's expressions agree on these.
_RULES = (
    (r"<!-- ad ([0-9]+) -->", "\n% @issue ISSUE-{1}\n"),
    (r"<h1[^>]*>", "\n\\memo{{"),
    (r"<div[^>]*>", "\\fixme{{"),
    (r"<p[^>]*>", "\n\\todo{{"),
    (r"</(h1|div|p)>", "}}\n"),
    (r"<(b|i|em|a|li|ul|nav|article)( [^>]*)?>", "{{"),
    (r"</(b|i|em|a|li|ul|nav|article)>", "}}"),
)


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): the pages as marked text."""
    text = F.col("html")
    for pattern, new in _RULES:
        text = F.regexp_replace(text, pattern, new.format(None, "$1").replace("\\", "\\\\"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), text.alias("text"))


def page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of marked pages with the whole text in the braces of their markers."""
    return issues.scan(marked_pages(spark, sf_dir)).withColumn("line", F.col("line").cast("long"))


def page_untagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers without a tag, with the ids they get."""
    pages = marked_pages(spark, sf_dir)
    return issues.assigned(issues.untagged(pages), issues.scan(pages)).withColumn("line", F.col("line").cast("long"))


def page_unsynchronised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of pages that the list of labelled numbers lacks, and those of the list without a tag."""
    known = table(spark, sf_dir, "labels").select(F.concat(F.lit("ISSUE-"), F.col("doc_id").cast("string")).alias("id"))
    return issues.unsynchronised(issues.scan(marked_pages(spark, sf_dir)), known)


QUERIES = {f.__name__: f for f in (page_issues, page_untagged, page_unsynchronised)}

_TEXT = "html"
for _pattern, _new in _RULES:
    _quoted = _new.format(None, "\\1").replace("\\", "\\\\").replace("\\\\1", "\\1").replace("\n", "'||chr(10)||'")
    _TEXT = f"regexp_replace({_TEXT}, '{_pattern}', '{_quoted}', 'g')"
_LINES = rf"""marked AS (SELECT page_id AS file, string_split({_TEXT}, chr(10)) AS l FROM pages WHERE html IS NOT NULL),
  lines AS (SELECT file, l, CAST(i AS BIGINT) AS line, l[i] AS content, nullif(regexp_extract(l[i], '%\s*@issue\s+(ISSUE-[0-9]+)', 1), '') AS id FROM (SELECT file, l, unnest(range(1, len(l) + 1)) AS i FROM marked))"""
_LAST = r"'^(.*\\(todo|memo|fixme)\{)'"
# depth is counted from each marker on, not over the whole page
_ISSUES = rf"""{_LINES},
  tags AS (SELECT *, CASE WHEN regexp_matches(coalesce(l[line + 1], ''), {_LAST}) THEN line + 1 WHEN regexp_matches(coalesce(l[line + 2], ''), {_LAST}) THEN line + 2 END AS below FROM lines WHERE id IS NOT NULL),
  rest AS (SELECT file, line, id, regexp_extract(l[below], {_LAST}, 2) AS type, substr(l[below], length(regexp_extract(l[below], {_LAST}, 1)) + 1) || array_to_string(l[below + 1:], chr(10)) AS rest FROM tags),
  chars AS (SELECT file, line, i, substr(rest, i, 1) AS c FROM (SELECT *, unnest(range(1, length(rest) + 1)) AS i FROM rest)),
  depths AS (SELECT file, line, i, 1 + sum(CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY file, line ORDER BY i) AS depth FROM chars),
  ends AS (SELECT file, line, min(i) AS e FROM depths WHERE depth = 0 GROUP BY ALL),
  issues AS (SELECT file, line, id, coalesce(nullif(type, ''), '?') AS type, coalesce(regexp_replace(substr(rest, 1, coalesce(e - 1, length(rest))), '^\s+|\s+$', '', 'g'), '') AS text FROM rest LEFT JOIN ends USING (file, line))"""
ORACLES = {
    "page_issues": f"WITH {_ISSUES} SELECT * FROM issues",
    "page_untagged": rf"""WITH {_LINES}, untagged AS (SELECT file, line, regexp_replace(content, '^\s+|\s+$', '', 'g') AS content FROM lines
      WHERE regexp_matches(content, '\\(todo|fixme)\{{') AND (line = 1 OR NOT regexp_matches(l[line - 1], '%\s*@issue\s+ISSUE-[0-9]+')) AND NOT regexp_matches(content, '^\s*%')),
      numbered AS (SELECT *, row_number() OVER (ORDER BY file, line) + coalesce((SELECT max(CAST(substr(id, 7) AS BIGINT)) FROM lines), 0) AS k FROM untagged)
      SELECT file, line, content, 'ISSUE-' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INTEGER), '0') AS id FROM numbered""",
    "page_unsynchronised": f"WITH {_LINES}, ids AS (SELECT DISTINCT id FROM lines WHERE id IS NOT NULL), known AS (SELECT DISTINCT 'ISSUE-' || doc_id AS id FROM labels) SELECT coalesce(i.id, k.id) AS id, CASE WHEN k.id IS NULL THEN 'texts' ELSE 'list' END AS only_in FROM ids i FULL JOIN known k ON i.id = k.id WHERE i.id IS NULL OR k.id IS NULL",
}
