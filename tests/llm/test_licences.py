"""License scans against all changes of a word."""

import pytest

from seqlattice.llm import license_scan
from seqlattice.llm.common import WordHashes
from seqlattice.llm.decontaminate import words_of
from seqlattice.llm.licenses import TEMPLATES


@pytest.fixture(scope="module")
def scan():
    index, hashes = license_scan.Index(TEMPLATES), WordHashes()
    return lambda text: index.scan(hashes.of(words_of(text.encode())))


def test_matches_on_either_side(scan):
    a, b = "Released under the Foo License.", "Released under the MIT License."
    for text in (f"{a} {b}", f"{b} {a}", f"{a} {b} {a}"):
        found = scan(text)
        assert [m["start_word"] for m in found] == [5 * i for i in range(len(found))] and len(found) == text.count("Released")
        assert {m["license"] for m in found} == {"MIT"}


@pytest.mark.parametrize("how", ["changed", "left out", "put in"])
def test_one_change_in_short_templates(scan, how):
    """Each template of 5 to 12 words is found at its coverage whichever word is changed; words put in don't lower it."""
    for name, text in TEMPLATES.items():
        words = [w.decode() if isinstance(w, bytes) else w for w in words_of(text.encode())]
        if not 5 <= len(words) <= license_scan.SHORT:
            continue
        for i in range(len(words)):
            new = words[:i] + {"changed": ["zebra"], "left out": [], "put in": ["zebra", words[i]]}[how] + words[i + 1 :]
            found = scan("some words before it " + " ".join(new) + " and more of them behind")
            assert found, (name, how, i)
            best = found[0]
            assert best["coverage"] >= license_scan.LEAST_COVERAGE
            same = len(words) if how == "put in" else len(words) - 1
            assert best["n_matched"] >= same, (name, how, i, found)


def test_two_pairs_are_needed(scan):
    assert scan("it was released under great pressure and then the rights of others were reserved") == []
    assert scan("") == scan("all") == []
