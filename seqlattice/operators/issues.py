r"""Marked issues in texts: tags in comments, the markers below them, and what stands in a marker's braces.

A tag is a comment ``% @issue NAME-12``; it belongs to the first of the two lines behind it with a marker (``\todo{...}``,
``\memo{...}`` or ``\fixme{...}``; of several in a line, the last).  Braces are matched set-wise: an opening brace and its
closing one are neighbours among the braces of their level, so one running sum and one look ahead match all of a text, and
a text with many markers is gone through once.

File names are keys: rows of one name must not differ.  Null texts have no lines; ``\r\n`` and ``\r`` end lines as ``\n`` does.
A marker that is never closed goes to the end of its text.  Texts aren't shortened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blind import numbered

#: The markers, and those that need a tag.
MARKERS, TRACKED = ("todo", "memo", "fixme"), ("todo", "fixme")


def _texts(files: DataFrame, file: str, text: str) -> DataFrame:
    return files.select(F.col(file).alias("file"), F.regexp_replace(F.col(text), "\r\n?", "\n").alias("__text")).filter("__text is not null").distinct()


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _tag(line: Column, prefix: str) -> Column:
    """The id in a line's comment; null without one."""
    found = F.regexp_extract(line, rf"%\s*@issue\s+({prefix}-[0-9]+)", 1)
    return F.when(found != "", found)


def _marker(line: Column, names: tuple[str, ...]) -> tuple[Column, Column]:
    """(name, place of the opening brace from 1) of a line's last marker; nulls without one."""
    pattern = rf"^(?s)(.*\\({'|'.join(names)})\{{)"
    name = F.regexp_extract(line, pattern, 2)
    return F.when(name != "", name), F.when(name != "", F.length(F.regexp_extract(line, pattern, 1)))


def lines_of(texts: DataFrame) -> DataFrame:
    """(file, line from 1, begin, content): ``begin`` counts the characters before a line."""
    rows = texts.select("file", F.posexplode(F.split("__text", "\n")).alias("i", "content"))
    before = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", (F.col("i") + 1).alias("line"), F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0)).alias("begin"), "content")


def braces(texts: DataFrame) -> DataFrame:
    """(file, opening, closing, level) of all opening braces, by places from 1; ``closing`` is null where there is none."""
    pieces = F.regexp_extract_all(F.col("__text"), F.lit(r"([^{}]*[{}])"), F.lit(1))
    rows = texts.select("file", F.posexplode(pieces).alias("i", "piece")).select("file", "i", F.length("piece").alias("n"), (F.right("piece", F.lit(1)) == "{").alias("opens"))
    so_far = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("opens"), 1).otherwise(-1)
    placed = rows.select("file", "i", "opens", F.sum("n").over(so_far).alias("at"), F.sum(step).over(so_far).alias("depth"))
    level = F.when(F.col("opens"), F.col("depth")).otherwise(F.col("depth") + 1)
    of_level = Window.partitionBy("file", "level").orderBy("i")
    return placed.withColumn("level", level).withColumn("next", F.lead("at").over(of_level)).filter("opens").select("file", F.col("at").alias("opening"), F.col("next").alias("closing"), "level")


def scan(files: DataFrame, file: str = "file", text: str = "text", prefix: str = "ISSUE") -> DataFrame:
    """(file, line, id, type, text) of all tags; type ``?`` and an empty text where no marker follows.

    The line break behind the marker's own line isn't part of the text.
    """
    texts = _texts(files, file, text)
    name, brace = _marker(F.col("content"), MARKERS)
    lines = lines_of(texts).select("file", "line", _tag(F.col("content"), prefix).alias("id"), name.alias("type"), (F.col("begin") + brace).alias("opening"))
    of_file = Window.partitionBy("file").orderBy("line")

    def below(c: str) -> Column:
        return F.coalesce(F.lead(c, 1).over(of_file), F.lead(c, 2).over(of_file))

    tags = lines.select("file", "line", "id", below("type").alias("type"), below("opening").alias("opening")).filter("id is not null")
    matched = tags.join(braces(texts).select("file", "opening", "closing"), ["file", "opening"], "left")
    end = F.coalesce(F.col("closing"), F.length("__text") + 1)
    inside = F.substring(F.col("__text"), F.col("opening") + 1, (end - F.col("opening") - 1).cast("int"))
    joined = F.regexp_replace(inside, r"^([^\n]*)\n", "$1")
    return matched.join(texts, "file").select("file", "line", "id", F.coalesce("type", F.lit("?")).alias("type"), F.coalesce(_stripped(joined), F.lit("")).alias("text"))


def untagged(files: DataFrame, file: str = "file", text: str = "text", prefix: str = "ISSUE") -> DataFrame:
    """(file, line, content) of the markers that need a tag, have none in the line before, and don't stand in a comment."""
    name, _ = _marker(F.col("content"), TRACKED)
    rows = lines_of(_texts(files, file, text)).withColumns({"__name": name, "__tag": F.lag(_tag(F.col("content"), prefix)).over(Window.partitionBy("file").orderBy("line"))})
    return rows.filter("__name is not null and __tag is null").select("file", "line", _stripped(F.col("content")).alias("content")).filter(~F.startswith("content", F.lit("%")))


def _number(of: Column) -> Column:
    return F.regexp_extract(of, "([0-9]+)$", 1).cast("long")


def next_id(issues: DataFrame) -> DataFrame:
    """One row: the least number above all that are taken."""
    return issues.agg((F.coalesce(F.max(_number(F.col("id"))), F.lit(0)) + 1).alias("next"))


def assigned(open_: DataFrame, issues: DataFrame, prefix: str = "ISSUE") -> DataFrame:
    """``open_`` with new ids, in the order of file and line, from the next free number on."""
    placed = numbered(open_, "__i", "file", "line").crossJoin(F.broadcast(next_id(issues)))  # one row
    return placed.withColumn("id", F.concat(F.lit(f"{prefix}-"), F.lpad((F.col("next") + F.col("__i")).cast("string"), F.greatest(F.lit(3), F.length((F.col("next") + F.col("__i")).cast("string"))), F.lit("0")))).drop("__i", "next")


def unsynchronised(issues: DataFrame, known: DataFrame) -> DataFrame:
    """(id, only_in): ids that are in one of the two only, ``texts`` or ``list``."""
    sides = issues.select("id", F.lit(True).alias("a"), F.lit(False).alias("b")).unionByName(known.select("id", F.lit(False).alias("a"), F.lit(True).alias("b")))
    both = sides.filter("id is not null").groupBy("id").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return both.filter("a <> b").select("id", F.when(F.col("a"), "texts").otherwise("list").alias("only_in"))
