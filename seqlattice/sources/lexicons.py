"""Readers of word lists in several formats, each to rows of words with a column of reasons for those that fail.

Every reader declares its schema and works on any path that Spark can open.
"""

from __future__ import annotations

import tomllib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.inventory import tokens
from ..functions.syllables import syllables
from ..operators import graph

ROOT = "語彙"
#: Fields of a dictionary's words that the readers and rules use.
WORD = """id BIGINT, entry STRING, category STRING, translations ARRAY<STRING>, simple_translations ARRAY<STRING>, tags ARRAY<STRING>, upper_covers ARRAY<BIGINT>, lower_covers ARRAY<BIGINT>, arguments ARRAY<BIGINT>,
  is_function BOOLEAN, display_root BOOLEAN, contents ARRAY<STRUCT<title: STRING, text: STRING>>, relations ARRAY<STRUCT<title: STRING, entry: BIGINT>>,
  partitions ARRAY<STRUCT<key: STRING, kind: STRING, disjoint: BOOLEAN, exhaustive: BOOLEAN>>, cover_states ARRAY<STRUCT<parent: BIGINT, state: STRING, partition: STRING>>, quote_of BIGINT"""


class Corpus(NamedTuple):
    """Words that can be divided into syllables, and those that can't with the reason."""

    words: DataFrame
    rejected: DataFrame


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The live words of a dictionary file: its slots of null are deleted words and are left out."""
    fields = ", ".join(f"{f.strip().split(' ', 1)[0]}: {f.strip().split(' ', 1)[1]}" for f in _fields(WORD))
    read = spark.read.schema(f"words ARRAY<STRUCT<{fields}>>").option("multiLine", True).json(path)
    return read.select(F.explode("words").alias("w")).filter("w is not null").select("w.*")


def _fields(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def covers(words: DataFrame) -> DataFrame:
    """(child, parent) of a dictionary's upper covers."""
    return words.select(F.col("id").alias("child"), F.explode("upper_covers").alias("parent"))


def dictionary_entries(spark: SparkSession, path: str, root: str | None = ROOT) -> DataFrame:
    """(word): distinct entries of a-z at or below the parentless word ``root``; all of them if that is None."""
    words = dictionary(spark, path)
    if root is not None:
        top = words.filter((F.col("entry") == root) & (F.size(F.coalesce("upper_covers", F.array().cast("array<bigint>"))) == 0)).select(F.col("id").alias("ancestor"))
        down = words.select(F.explode("lower_covers").alias("child"), F.col("id").alias("parent"))
        below = graph.closure(down).join(top, "ancestor", "left_semi").select(F.col("child").alias("id")).unionByName(top.select(F.col("ancestor").alias("id")))
        words = words.join(below, "id", "left_semi")
    return words.filter(F.col("entry").rlike("^[a-z]+$")).select(F.col("entry").alias("word")).distinct()


def zpdic_entries(spark: SparkSession, path: str) -> DataFrame:
    """(word, gloss) of a dictionary of nested forms; duplicates are kept."""
    schema = "words ARRAY<STRUCT<entry: STRUCT<form: STRING>, translations: ARRAY<STRUCT<forms: ARRAY<STRING>>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("words").alias("w")).filter("w is not null")
    gloss = F.coalesce(F.try_element_at(F.try_element_at("w.translations", F.lit(1))["forms"], F.lit(1)), F.lit(""))
    return rows.select(F.col("w.entry.form").alias("word"), gloss.alias("gloss")).filter(F.col("word").rlike("^[a-z]+$"))


def lengthened(underlying: Column, surface: Column) -> Column:
    """Places of syllables (from 0) with a doubled vowel that the underlying form lacks."""
    double = "([aoeiyuv])\\1"
    have = F.regexp_extract_all(underlying, F.lit(double), F.lit(1))
    parts = F.split(surface, "\\.")
    return F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: (F.regexp_extract(F.get(parts, i), double, 1) != "") & ~F.array_contains(have, F.regexp_extract(F.get(parts, i), double, 1)))


def accent_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(word, accent, underlying, gloss, confidence, alternatives, alternative_accents, lengthened) of a sheet of transcriptions.

    Fields may hold alternatives between bars: the first is taken.  Rows without a division or an accent are left out.
    """
    sheet = spark.read.option("sep", "\t").option("header", True).csv(path)
    trimmed = {c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in sheet.columns}
    pick = lambda name: trimmed.get(name, F.lit(""))
    parts = lambda c: F.filter(F.transform(F.split(c, "\\|"), F.trim), lambda x: x != "")
    rows = sheet.select(pick("単語").alias("underlying"), pick("翻訳").alias("gloss"), pick("確信度").alias("confidence"), parts(pick("音節化・長短")).alias("s"), parts(pick("高低")).alias("a"))
    rows = rows.filter((F.col("underlying") != "") & (F.size("s") > 0) & (F.size("a") > 0))
    word = F.col("s")[0]
    return rows.select(
        word.alias("word"), F.col("a")[0].alias("accent"), "underlying", "gloss", "confidence", F.slice("s", 2, F.size("s")).alias("alternatives"), F.slice("a", 2, F.size("a")).alias("alternative_accents"), lengthened(F.col("underlying"), word).alias("lengthened")
    )


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a file of one word a line; lines that begin with # are comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("word"))
    return lines.filter(~F.col("word").startswith("#") & F.col("word").rlike("^[a-z]+$"))


def ipa_words(spark: SparkSession, path: str) -> DataFrame:
    """(segments) of a file of one word a line, its segments between spaces."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.split(F.trim("value"), "\\s+").alias("segments"))


def cross_language_forms(spark: SparkSession, path: str, language: str) -> DataFrame:
    """(segments) of one language of a table of forms: boundary marks go, equal forms count once."""
    rows = spark.read.option("header", True).csv(path).filter(F.col("Language_ID") == language)
    segments = F.filter(F.split(F.trim(F.coalesce("Segments", F.lit(""))), "\\s+"), lambda s: ~s.isin("", "+", "_", "-"))
    return rows.select(segments.alias("segments")).filter(F.size("segments") > 0).dropDuplicates(["segments"])


def candidate_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, pattern, tier) of a file of one to three fields a line; # begins a comment at a line's start or after a space."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "(^|\\s)#.*$", "")).alias("line")).filter("line <> ''")
    fields = lines.select(F.split("line", "\t+").alias("f"))
    get = lambda i: F.trim(F.get("f", F.lit(i)))
    many = F.size("f") > 1
    return fields.select(get(0).alias("name"), F.when(many, get(1)).otherwise(get(0)).alias("pattern"), F.coalesce(get(2), F.lit("segment")).alias("tier"))


def rules(text: str) -> list[tuple[str, str, str, str, str]]:
    """(name, target, replacement, left, right) of rewrite rules in TOML: one rule, or a map in one context; disabled ones go."""
    out = []
    for r in tomllib.loads(text).get("rules", []):
        if not r.get("enabled", True):
            continue
        if "rule" in r:
            change, _, context = r["rule"].partition("/")
            source, _, target = change.partition("->")
            pairs = [(source.strip(), target.strip())]
        elif "map" in r:
            pairs, context = list(r["map"].items()), r.get("context", "")
        else:
            raise ValueError(f"rule {r['name']!r} has neither rule nor map")
        left, _, right = context.partition("_")
        out += [(r["name"], a, "" if b in ("∅", "") else b, left.strip(), right.strip()) for a, b in pairs]
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Words of a file by its name and, for JSON, by the shape of its first word."""
    if path.endswith(".tsv"):
        return accent_sheet(spark, path)
    if path.endswith(".json"):
        entry = spark.read.option("multiLine", True).json(path).schema["words"].dataType.elementType["entry"].dataType
        return zpdic_entries(spark, path) if entry.typeName() == "struct" else dictionary_entries(spark, path)
    return word_list(spark, path)


def corpus(rows: DataFrame, word: str = "word") -> Corpus:
    """Words with their sounds, syllables and notes; words that can't be divided go to the rejected with the reason."""
    parsed = rows.withColumn("__s", syllables(F.col(word)))
    good = parsed.filter(F.col("__s.error").isNull()).select(*rows.columns, tokens(F.regexp_replace(word, "[.|]", "")).alias("tokens"), F.col("__s.syllables").alias("syllables"), F.col("__s.notes").alias("notes"))
    bad = parsed.filter(F.col("__s.error").isNotNull()).select(F.col(word).alias("word"), F.col("__s.error").alias("reason"))
    return Corpus(good, bad)
