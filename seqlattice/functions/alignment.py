"""Alignment of two sequences of symbols: the cheapest edits, and transcriptions that copy sounds of a spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .inventory import VOWELS

#: What a step costs.  A copy is a symbol of the right side that repeats the one before it.
MATCH, COPY, OTHER = 0, 1, 2
_CELL = "struct<cost:int,steps:string>"


def alignment(left: Column, right: Column) -> Column:
    """struct(cost, steps) of the cheapest way from one array to another.

    Steps are ``=`` (equal), ``~`` (another symbol), ``-`` (only left), ``+`` (only right), ``*`` (only right, a copy).
    Of equal costs the way whose last step is = or ~ wins, then -, then + or *.

    A fold over ``left`` keeps one row of the edit table; each cell has its cost and the steps that led to it, so nothing
    else of the table is kept.
    """
    def cell(cost: Column, steps: Column) -> Column:
        return F.struct(cost.cast("int").alias("cost"), steps.alias("steps"))

    def inserted(before: Column, j: Column) -> Column:
        """A symbol of ``right`` (place j from 1) behind a cell."""
        copy = (j > 1) & (F.get(right, j - 1) == F.get(right, j - 2))
        return cell(before["cost"] + F.when(copy, COPY).otherwise(OTHER), F.concat(before["steps"], F.when(copy, "*").otherwise("+")))

    def places(row_start: Column, step) -> Column:
        """A row from its first cell on: each next cell from the place and the cells so far."""
        js = F.when(F.size(right) > 0, F.sequence(F.lit(1), F.size(right))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(js, F.array(row_start).cast(f"array<{_CELL}>"), lambda row, j: F.concat(row, F.array(step(row, j))).cast(f"array<{_CELL}>"))

    first = places(cell(F.lit(0), F.lit("")), lambda row, j: inserted(F.element_at(row, -1), j))

    def next_row(row: Column, symbol: Column) -> Column:
        def step(now: Column, j: Column) -> Column:
            above, diagonal = F.get(row, j), F.get(row, j - 1)
            equal = F.get(right, j - 1) == symbol
            ways = [
                cell(diagonal["cost"] + F.when(equal, MATCH).otherwise(OTHER), F.concat(diagonal["steps"], F.when(equal, "=").otherwise("~"))),
                cell(above["cost"] + OTHER, F.concat(above["steps"], F.lit("-"))),
                inserted(F.element_at(now, -1), j),
            ]
            least = F.least(*(w["cost"] for w in ways))
            return F.when(ways[0]["cost"] == least, ways[0]).when(ways[1]["cost"] == least, ways[1]).otherwise(ways[2])

        above = F.get(row, F.lit(0))
        return places(cell(above["cost"] + OTHER, F.concat(above["steps"], F.lit("-"))), step)

    return F.aggregate(left, first, next_row, lambda row: F.element_at(row, -1))


def aligned_pairs(left: Column, right: Column, steps: Column) -> Column:
    """array of (left, right, copy): the symbols that a way pairs; null on the side that has none."""
    pair = "array<struct<left:string,right:string,copy:boolean>>"
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.array().cast(pair).alias("pairs"))

    def step(at: Column, kind: Column) -> Column:
        has_left, has_right = kind.isin("=", "~", "-"), kind != "-"
        new = F.struct(F.when(has_left, F.get(left, at["i"])).alias("left"), F.when(has_right, F.get(right, at["j"])).alias("right"), (kind == "*").alias("copy"))
        return F.struct((at["i"] + has_left.cast("int")).alias("i"), (at["j"] + has_right.cast("int")).alias("j"), F.concat(at["pairs"], F.array(new)).cast(pair).alias("pairs"))

    chars = F.when(F.length(steps) > 0, F.split(steps, "")).otherwise(F.array().cast("array<string>"))
    return F.aggregate(chars, start, step, lambda at: at["pairs"])


def copied(spelled: Column, realized: Column) -> Column:
    """Of each letter of a transcription whether the spelling has it; null where it isn't the spelling with letters repeated.

    Of a doubled consonant the first one counts as the copy, so that the onset keeps its own.
    """
    letters = F.when(F.length(realized) > 0, F.split(realized, "")).otherwise(F.array().cast("array<string>"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<boolean>").alias("own"), F.lit(True).alias("fits"), F.lit("").alias("last"), letters.alias("letters"), spelled.alias("spelled"), F.length(spelled).alias("size"))

    def step(state: Column, letter: Column) -> Column:
        own = F.substring(state["spelled"], state["at"] + 1, F.lit(1)) == letter
        fits = state["fits"] & (own | (letter == state["last"]))
        return F.struct((state["at"] + own.cast("int")).alias("at"), F.concat(state["own"], F.array(own)).alias("own"), fits.alias("fits"), letter.alias("last"), *(state[k].alias(k) for k in ("letters", "spelled", "size")))

    # a copy behind its consonant changes places with it, from left to right
    none = F.struct(F.array().cast("array<boolean>").alias("own"), F.lit("").alias("last"))

    def swap(state: Column, x: Column) -> Column:
        before = F.element_at(F.concat(F.array(F.lit(False)), state["own"]), -1)
        moves = (x["letter"] == state["last"]) & ~x["letter"].isin(*VOWELS) & before & ~x["own"]
        kept = F.when(moves, F.concat(F.slice(state["own"], 1, F.greatest(F.size(state["own"]) - 1, F.lit(0))), F.array(F.lit(False), F.lit(True)))).otherwise(F.concat(state["own"], F.array(x["own"])))
        return F.struct(kept.alias("own"), x["letter"].alias("last"))

    def settled(read: Column) -> Column:
        both = F.zip_with(read["letters"], read["own"], lambda letter, own: F.struct(letter.alias("letter"), own.alias("own")))
        return F.when(read["fits"] & (read["at"] == read["size"]), F.aggregate(both, none, swap, lambda state: state["own"]))

    return F.aggregate(letters, start, step, settled)


def underlying(spelled: Column, transcribed: Column) -> Column:
    """array of (text, longer, doubled) for the syllables of a transcription with ``.`` between them: its letters that the
    spelling has, and whether it copies a vowel or a consonant; null where the two don't fit."""
    kind = "array<struct<text:string,longer:boolean,doubled:boolean>>"
    # the marks go along in the state, so that they are found once and not for each syllable
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"), copied(spelled, F.replace(transcribed, F.lit("."), F.lit(""))).alias("own"))

    def step(state: Column, syllable: Column) -> Column:
        letters = F.when(F.length(syllable) > 0, F.split(syllable, "")).otherwise(F.array().cast("array<string>"))
        tagged = F.zip_with(letters, F.slice(state["own"], state["at"] + 1, F.size(letters)), lambda letter, mine: F.struct(letter.alias("letter"), mine.alias("own")))
        text = F.array_join(F.transform(F.filter(tagged, lambda x: x["own"]), lambda x: x["letter"]), "")
        part = F.struct(text.alias("text"), F.exists(tagged, lambda x: ~x["own"] & x["letter"].isin(*VOWELS)).alias("longer"), F.exists(tagged, lambda x: ~x["own"] & ~x["letter"].isin(*VOWELS)).alias("doubled"))
        return F.struct((state["at"] + F.size(letters)).alias("at"), F.concat(state["out"], F.array(part)).cast(kind).alias("out"), state["own"].alias("own"))

    return F.aggregate(F.split(transcribed, r"\."), start, step, lambda state: F.when(state["own"].isNotNull(), state["out"]))
