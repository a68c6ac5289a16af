"""Titles of prose meet in pairs of blocks, not once for each short segment that they share."""

import random

import pytest

from paperloom.operators import titles
from tests.test_semantics import lcs_ratio
from tests.test_titles import edited


@pytest.mark.parametrize("least", [88.0, 96.0])
def test_blocks_and_segments_against_all_pairs(spark, monkeypatch, least):
    """Many small blocks; at 96 long titles are looked up by segments and short ones meet in blocks."""
    monkeypatch.setattr(titles, "BLOCK_TITLES", 7)
    monkeypatch.setattr(titles, "BLOCK_CHARS", 500)
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (3, 9, 20, 24, 29, 60, 70, 150)]
    texts = sorted({edited(rng, rng.choice(stems), 5) for _ in range(130)} - {""}, key=lambda t: (t[::-1], t))
    got = {(r.a, r.b): r.score for r in titles.similar(spark.createDataFrame(list(enumerate(texts)), "ord long, t string"), least).collect()}
    near = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if 2 * min(len(texts[i]), len(texts[j])) >= (len(texts[i]) + len(texts[j])) * least / 100 - 1]
    want = {(i, j): s for i, j in near if (s := lcs_ratio(texts[i], texts[j])) >= least}
    assert got == pytest.approx(want) and len(want) > 30


def test_short_segments_are_not_looked_up(spark, monkeypatch):
    """At 88 % segments have three or four characters, which most titles of prose share."""
    monkeypatch.setattr(titles, "by_segments", lambda *_: pytest.fail("looked up"))
    syllables = ["th", "er", "an", "on", "the ", "ing ", "ed ", "ou"]
    rng = random.Random(4)
    prose = ["".join(rng.choice(syllables) for _ in range(60)) for _ in range(40)]
    rows = list(enumerate(prose + [prose[0] + "x"]))
    assert [(r.a, r.b) for r in titles.similar(spark.createDataFrame(rows, "ord long, t string"), 88.0).collect()] == [(0, 40)]
