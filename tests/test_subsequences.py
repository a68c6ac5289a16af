"""Ratios of many pairs at once, and how titles are dealt to pairs of blocks."""

import random
import time

import numpy as np
import pytest

from paperloom.operators import subsequences, titles
from tests.test_semantics import lcs_ratio
from tests.test_titles import edited


@pytest.mark.parametrize("least", [70.0, 88.0, 100.0])
def test_many_pairs_as_one_by_one(monkeypatch, least):
    monkeypatch.setattr(subsequences, "FEW", 0)
    monkeypatch.setattr(subsequences, "PAIRS", 500)
    rng = random.Random(int(least))
    stems = ["".join(rng.choice("abcdé😀gh ") for _ in range(n)) for n in (1, 2, 5, 20, 63, 64, 65, 128, 130)]
    texts = [t for _ in range(90) if (t := edited(rng, rng.choice(stems), rng.choice([2, 12, 40])))]
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if len(texts[i]) <= len(texts[j])]
    got = subsequences.Texts(texts, texts, least).ratios(*np.array(pairs).T)
    want = [s if 2 * len(texts[i]) >= least / 100 * (len(texts[i]) + len(texts[j])) - 1 and (s := lcs_ratio(texts[i], texts[j])) >= least else 0.0 for i, j in pairs]
    assert got.tolist() == pytest.approx(want) and sum(s > 0 for s in want) > 80


def test_strangers_with_the_same_letters_are_fast():
    """Titles that letter counts can't tell apart: far less time than one by one, and few long ones don't take longer."""
    rng = random.Random(5)
    letters = list("thereininsoundofthingsation " * 12)
    texts = ["".join(rng.sample(letters, len(letters))) for _ in range(120)]
    a, b = np.array([(i, j) for i in range(120) for j in range(i + 1, 120)]).T
    began = time.process_time()
    assert not subsequences.Texts(texts, texts, 88.0).ratios(a, b).any()
    many = time.process_time() - began
    began = time.process_time()
    assert not any(subsequences.ratio(texts[i], texts[j], 88.0) for i, j in zip(a[:700].tolist(), b[:700].tolist()))
    assert many < 5 * (time.process_time() - began)  # 7140 pairs in less than half the time of each
    long = ["".join(rng.choices("abcdefgh ", k=20000)) for _ in range(2)]
    began = time.process_time()
    assert subsequences.Texts(long[:1], long[1:], 88.0).ratios(np.array([0]), np.array([0])).tolist() == [0.0]
    assert time.process_time() - began < 5


def test_each_pair_of_blocks_once():
    """A block of a band meets each block of its own band once, and titles come to each pair of blocks once."""
    blocks, reach = {20: 3, 21: 2}, {20: [20, 21], 21: [21]}
    dealt = {(k, i): list(titles.targets(k, i, blocks, reach)) for k in blocks for i in range(blocks[k])}
    assert all(len({t[:4] for t in ts}) == len(ts) for ts in dealt.values())
    owners = {}
    for block, ts in dealt.items():
        for t in ts:
            owners.setdefault(t[:4], {})[block] = t[4]
    assert len(owners) == 3 * 4 // 2 + 3 * 2 + 2 * 3 // 2
    for (rb, ri, sb, si), found in owners.items():
        assert found == ({(rb, ri): False} if (rb, ri) == (sb, si) else {(rb, ri): False, (sb, si): True})
