"""Writers: tables with a header, JSON by group, interval files, and table text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).json(path)


def filled_intervals(intervals: DataFrame, key: str, stop: str = "stop", start: str = "start", label: str = "label", end: float | None = None) -> DataFrame:
    """(key, start, stop, label) with an empty interval in every gap, at the beginning, and up to ``end``."""
    by = Window.partitionBy(key).orderBy(start)
    before = F.coalesce(F.lag(stop).over(by), F.lit(0.0))
    last = F.lead(start).over(by).isNull()
    rows = intervals.select(key, start, stop, label, before.alias("__before"), last.alias("__last"))
    parts = F.array(
        F.when(F.col("__before") < F.col(start), F.struct(F.col("__before").alias("start"), F.col(start).alias("stop"), F.lit("").alias("label"))),
        F.struct(F.col(start).alias("start"), F.col(stop).alias("stop"), F.col(label).alias("label")),
        F.when(F.col("__last") & (F.lit(end) > F.col(stop)), F.struct(F.col(stop).alias("start"), F.lit(end).alias("stop"), F.lit("").alias("label"))),
    )
    return rows.select(key, F.explode(F.array_compact(parts)).alias("i")).select(key, "i.*")


def interval_text(filled: DataFrame, key: str) -> DataFrame:
    """(key, text): one tier of intervals in the text form of interval files."""
    by = Window.partitionBy(key).orderBy("start")
    line = F.format_string('        intervals [%d]:\n            xmin = %s\n            xmax = %s\n            text = "%s"', F.row_number().over(by), F.col("start").cast("string"), F.col("stop").cast("string"), F.replace("label", F.lit('"'), F.lit('""')))
    rows = filled.select(key, "start", line.alias("line"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "line"))), lambda s: s["line"]), "\n").alias("text"))


def latex_table(rows: list[list[str]], header: list[str]) -> str:
    """A small table as text; what it shows is a bounded summary."""
    escape = lambda x: str(x).replace("&", "\\&").replace("_", "\\_")
    lines = [" & ".join(map(escape, r)) + " \\\\" for r in [header, *rows]]
    return "\\begin{tabular}{" + "l" * len(header) + "}\n" + "\n".join(lines) + "\n\\end{tabular}"
