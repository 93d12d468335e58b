"""Words as coloured places between walls: what colours settle to, which words are well formed, and vowels in harmony.

A vowel has a colour of two components.  A cluster of consonants is a wall that lets a component through or not: where all
its consonants do.  Of a component, vowels without an opaque wall between them are an island; one that an outer wall opens
to the background takes the background's value, any other settles at the mean of its vowels.

All is said by arrays of a word: its vowels, its clusters (one more), and of a component each vowel's island number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours of vowels, and which components a consonant lets through.
COLOURS = {"o": (1.0, 0.0), "a": (1.0, 1.0), "e": (0.0, -1.0), "i": (0.0, 0.0), "u": (0.5, 0.5)}
PASSES = ("kscl", "fhsclmtn")
#: Backgrounds that are tried: a grid as far as its colours are real, then the vowels' own.
GRID = ((0, 0.25, 0.5, 0.75, 1), (-1, -0.5, 0, 0.5, 1))
NEAR = 1e-9
BACKGROUNDS = [(float(a), float(b)) for a in GRID[0] for b in GRID[1] if 0 <= a - b <= 1] + list(COLOURS.values())

_VOWELS = "".join(COLOURS)
_LETTERS = "".join(sorted(set(_VOWELS + PASSES[0] + PASSES[1])))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: inside a lambda a column's expression is worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_set(word: Column) -> Column:
    """Whether a word has letters of the model only."""
    return word.rlike(f"^[{_LETTERS}]*$")


def vowels(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit(f"([{_VOWELS}])"), F.lit(1))


def _open(word: Column, j: int) -> Column:
    """Of each wall, from the word's start to its end, whether it lets component ``j`` through."""
    return F.transform(F.split(word, f"[{_VOWELS}]", -1), lambda cluster: cluster.rlike(f"^[{PASSES[j]}]*$"))


def _value(vowel: Column, j: int) -> Column:
    out = F.lit(None).cast("double")
    for letter, colour in COLOURS.items():
        out = F.when(vowel == letter, colour[j]).otherwise(out)
    return out


def islands(word: Column, j: int) -> Column:
    """array of (values, settled): the islands of component ``j`` in order; ``settled`` is the mean, null where the background decides."""
    kind = "array<struct<first:int,values:array<double>>>"

    def step(found: Column, x: Column) -> Column:
        """A vowel and the wall before it: into the last island, or one of its own."""
        last = F.element_at(found, -1)
        own = F.struct(x["i"].alias("first"), F.array(x["v"]).alias("values"))
        grown = F.struct(last["first"].alias("first"), F.concat(last["values"], F.array(x["v"])).alias("values"))
        return F.when((x["i"] == 0) | ~x["open"], F.concat(found, F.array(own))).otherwise(F.concat(F.slice(found, 1, F.size(found) - 1), F.array(grown))).cast(kind)

    def settled(of: Column) -> Column:
        n = F.size(of["vowels"])
        placed = F.transform(F.arrays_zip(of["vowels"].alias("v"), F.slice(of["walls"], 1, n).alias("open")), lambda x, i: F.struct(i.alias("i"), _value(x["v"], j).alias("v"), x["open"].alias("open")))

        def settle(x: Column) -> Column:
            outside = (x["first"] == 0) & F.get(of["walls"], F.lit(0)) | (x["first"] + F.size(x["values"]) == n) & F.get(of["walls"], n)
            mean = F.aggregate(x["values"], F.lit(0.0), lambda a, v: a + v) / F.size(x["values"])
            return F.struct(x["values"].alias("values"), F.when(~outside, mean).alias("settled"))

        return F.transform(F.aggregate(placed, F.array().cast(kind), step), settle)

    return _let(F.struct(vowels(word).alias("vowels"), _open(word, j).alias("walls")), settled)


def good_backgrounds(islands_by_component: list[Column]) -> Column:
    """The backgrounds (by place in BACKGROUNDS) under which all vowels of a word settle at one colour; all where it has none."""
    def fits(of: Column, value: float) -> Column:
        settled = F.transform(of, lambda x: F.coalesce(x["settled"], F.lit(value)))
        return F.forall(settled, lambda x: F.abs(x - F.get(settled, F.lit(0))) < NEAR)

    tests = [F.when(reduce(lambda a, b: a & b, (fits(of, v) for of, v in zip(islands_by_component, bg, strict=True))), i) for i, bg in enumerate(BACKGROUNDS)]
    return F.array_compact(F.array(*tests))


def transport(islands_by_component: list[Column], background: tuple[float, float]) -> Column:
    """How far all colours move, by the sum of both components."""
    def moved(of: Column, value: float) -> Column:
        each = F.flatten(F.transform(of, lambda x: F.transform(x["values"], lambda v: F.abs(v - F.coalesce(x["settled"], F.lit(value))))))
        return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)

    return reduce(lambda a, b: a + b, (moved(of, v) for of, v in zip(islands_by_component, background, strict=True)))


def repeats(word: Column) -> Column:
    """Neighbouring vowels of one colour."""
    v = vowels(word)
    return F.size(F.filter(F.transform(v, lambda x, i: F.coalesce(x == F.get(v, i + 1), F.lit(False))), lambda x: x))


def dispersion(word: Column) -> Column:
    """The least distance between the colours of two vowels; null below two vowels."""
    v = vowels(word)
    kinds = F.array_sort(F.array_distinct(v))

    def distance(x: Column, y: Column) -> Column:
        return F.sqrt((_value(x, 0) - _value(y, 0)) ** 2 + (_value(x, 1) - _value(y, 1)) ** 2)

    least = F.array_min(F.flatten(F.transform(kinds, lambda x: F.transform(F.filter(kinds, lambda y: y > x), lambda y: distance(x, y)))))
    return F.when(F.size(v) < 2, F.lit(None).cast("double")).when(F.size(kinds) < F.size(v), F.lit(0.0)).otherwise(least)


def _nearest(word: Column, j: int, sources: Column, root: Column) -> Column:
    """Of each vowel the place of the source that component ``j`` comes from: the nearest one in its island, of two as near
    the one in the root, else the earlier; null where the island has none.

    Two running folds carry the last source seen, from the left and from the right; an opaque wall clears it.
    """
    def found(of: Column) -> Column:
        at = F.when(F.size(of["sources"]) > 0, F.sequence(F.lit(0), F.size(of["sources"]) - 1)).otherwise(F.array().cast("array<int>"))

        def run(order: Column, wall: Callable[[Column], Column]) -> Column:
            def step(seen: Column, i: Column) -> Column:
                before = F.when(F.get(of["walls"], wall(i)), F.element_at(F.concat(F.array(F.lit(None).cast("int")), seen), -1))
                return F.concat(seen, F.array(F.when(F.get(of["sources"], i), i).otherwise(before))).cast("array<int>")

            return F.aggregate(order, F.array().cast("array<int>"), step)

        def choose(x: Column, i: Column) -> Column:
            a, b = x["a"], x["b"]
            to_left, to_right = i - a, b - i
            second = (to_right < to_left) | (to_right == to_left) & F.get(of["root"], b) & ~F.get(of["root"], a)
            return F.when(a.isNull(), b).when(b.isNull(), a).when(second, b).otherwise(a)

        both = F.arrays_zip(run(at, lambda i: i).alias("a"), F.reverse(run(F.reverse(at), lambda i: i + 1)).alias("b"))
        return F.transform(both, choose)

    return _let(F.struct(_open(word, j).alias("walls"), sources.alias("sources"), root.alias("root")), found)


def harmonised(word: Column, sources: Column, root: Column) -> Column:
    """The vowels after their colours came from sources (an array of booleans, as ``root``): each becomes the vowel of the
    nearest colour.

    Of several as near, those that agree in the components that changed, then those nearest to the vowel's own colour, then
    the first of COLOURS.
    """
    def new(of: Column, x: Column, i: Column) -> Column:
        own = [_value(x["v"], j) for j in (0, 1)]
        now = [F.coalesce(_value(F.get(of["v"], x[f"s{j}"]), j), own[j]) for j in (0, 1)]

        def far(colour: tuple[float, float], of: list[Column]) -> Column:
            return (of[0] - colour[0]) ** 2 + (of[1] - colour[1]) ** 2

        ranked = []
        for k, (letter, colour) in enumerate(COLOURS.items()):
            off = reduce(lambda a, b: a | b, ((now[j] != own[j]) & (F.abs(now[j] - colour[j]) >= NEAR) for j in (0, 1)))
            ranked.append(F.struct(F.round(F.sqrt(far(colour, now)), 9).alias("far"), off.alias("off"), far(colour, own).alias("moved"), F.lit(k).alias("k"), F.lit(letter).alias("letter")))
        return F.when(F.get(of["sources"], i), x["v"]).otherwise(F.array_min(F.array(*ranked))["letter"])

    def all_new(of: Column) -> Column:
        return F.transform(F.arrays_zip(of["v"].alias("v"), of["s0"].alias("s0"), of["s1"].alias("s1")), lambda x, i: new(of, x, i))

    return _let(F.struct(vowels(word).alias("v"), sources.alias("sources"), *(_nearest(word, j, sources, root).alias(f"s{j}") for j in (0, 1))), all_new)


def respelled(word: Column, new_vowels: Column) -> Column:
    """The word with other vowels in the places of its own."""
    clusters = F.split(word, f"[{_VOWELS}]", -1)
    return F.array_join(F.flatten(F.transform(F.arrays_zip(clusters.alias("c"), new_vowels.alias("v")), lambda x: F.array(x["c"], F.coalesce(x["v"], F.lit(""))))), "")


def harmony(word: Column, root_vowels: Column, dominant_suffix: bool = False) -> Column:
    """The whole word's form: colours come from the first ``root_vowels`` vowels, or from those behind them."""
    root = F.transform(vowels(word), lambda v, i: i < root_vowels)
    sources = F.transform(root, lambda r: ~r) if dominant_suffix else root
    return respelled(word, harmonised(word, sources, root))
