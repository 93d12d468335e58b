"""Sound patterns compiled to regular expressions over words of one character a phoneme.

A pattern is a sequence of ``[feature tests]`` or ``[Class]``, alternatives ``(a|b)``, lower-case literals, ``#`` for
either edge of a word wherever it stands, ``_`` for the place of a change, which has no width, and the quantifiers
``? * + {n} {m,n}``; a leading ``*`` marks a prohibition.  Matches are counted by the places where they begin, so they may
overlap.  Tests of features that no sound has, and marks of syllables, are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .inventory import CODE, MEMBERS, PHONEMES, split

FEATURES = frozenset(k for f in PHONEMES.values() for k in f)
_TEST = re.compile(r"(!?)([+-]?)([a-z_]+)(?:(!=|>=|<=|=|>|<)([A-Za-z0-9_.]+))?$")


def parse_test(spec: str) -> tuple:
    """(negate, sign, name, op, value) of a feature test."""
    m = _TEST.match(spec)
    if not m:
        raise ValueError(f"not a feature test: {spec!r}")
    return m.groups()


def test(spec: str, features: dict) -> bool:
    """Whether features pass a test.  A missing feature is neither + nor - and differs from every value; ``!`` turns a failed test into a passed one."""
    negate, sign, name, op, value = parse_test(spec)
    if name not in FEATURES and name not in features:
        raise ValueError(f"no sound has the feature {name!r}")
    have = features.get(name)
    if sign:
        passed = have is (sign == "+")
    elif op in ("=", "!="):
        text = str(have).lower() if isinstance(have, bool) else str(have)
        passed = (have is not None and text == value) == (op == "=")
    elif op:
        number = have is not None and not isinstance(have, bool) and isinstance(have, int | float)
        passed = number and {">": have > float(value), "<": have < float(value), ">=": have >= float(value), "<=": have <= float(value)}[op]
    else:
        passed = bool(have)
    return passed != bool(negate)


def segment(spec: str, features: dict) -> bool:
    """Whether features pass all tests of ``[...]``; capitals name classes."""
    for part in re.split(r"[,\s]+", spec.strip()):
        if part.lstrip("!") in MEMBERS:
            if (features["spell"] in MEMBERS[part.lstrip("!")]) == part.startswith("!"):
                return False
        elif not test(part, features):
            return False
    return True


@dataclass(frozen=True)
class Pattern:
    text: str
    prohibits: bool
    java: str

    def count(self, code: Column) -> Column:
        """Places of an encoded word where the pattern begins; the place behind the last sound counts as well."""
        return F.regexp_count(code, F.lit(f"(?={self.java})"))


def _class(members: list[str]) -> str:
    return "[" + "".join(CODE[p] for p in members) + "]" if members else "(?!)"


def _quantifier(body: str, i: int, text: str) -> tuple[str, int]:
    """A quantifier as Java writes it, and the place behind it; ``{,n}`` is from none to n."""
    if body[i] != "{":
        return body[i], i + 1
    m = re.compile(r"\{(\d*)(,?)(\d*)\}").match(body, i)
    if not m or not (m[1] or m[3]) or m[1] and m[3] and int(m[1]) > int(m[3]):
        raise ValueError(f"not a quantifier at {i} in {text!r}")
    return f"{{{m[1] or 0}{m[2]}{m[3]}}}", m.end()


def compile_pattern(text: str) -> Pattern:
    """Compile a pattern over features of the inventory."""
    body = text[1:] if text.startswith("*") else text
    out, i, depth = [], 0, 0
    repeats = False  # whether a quantifier may follow
    while i < len(body):
        c = body[i]
        if c in "?*+{":
            if not repeats:
                raise ValueError(f"nothing to repeat at {i} in {text!r}")
            quantifier, i = _quantifier(body, i, text)
            out.append(quantifier)
            repeats = False
            continue
        repeats = c not in "(|_" and not c.isspace()
        if c == "[":
            end = body.find("]", i)
            if end < 0:
                raise ValueError(f"no ] after {i} in {text!r}")
            out.append(_class([p for p, f in PHONEMES.items() if segment(body[i + 1 : end], f)]))
            i = end + 1
        elif c == "#":
            out.append("(?:^|$)")
            i += 1
        elif c in "(|)":
            depth += (c == "(") - (c == ")")
            out.append("(?:" if c == "(" else c)
            i += 1
        elif c.isupper():
            out.append(_class(list(MEMBERS[c])))
            i += 1
        elif c.islower():
            run = re.match(r"[a-z]+", body[i:])[0]
            parts = split(run)
            if parts is None:
                raise ValueError(f"not sounds: {run!r}")
            out.append("".join(CODE[p] for p in parts))
            i += len(run)
        elif c == "_" or c.isspace():
            i += 1
        else:
            raise ValueError(f"unexpected {c!r} at {i} in {text!r}")
    if depth:
        raise ValueError(f"unbalanced parentheses in {text!r}")
    return Pattern(text, text.startswith("*"), "".join(out))
