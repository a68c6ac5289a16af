"""Circulant MinHash: its estimates, its recall, and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import jaccard, minhash
from tests.llm.test_operators import DOCS, by_id, frame, linked, prose
from tests.llm.test_operators import corpus  # noqa: F401


def test_signature_is_minwise():
    """Coordinates agree as often as sets are alike, whatever the shift; permutations lose nothing."""
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 260, dtype=np.uint64)
    for both in (40, 120, 180):
        agree = []
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, 260, dtype=np.uint64))
            a, b = x[:both + (len(x) - both) // 2], np.concatenate([x[:both], x[both + (len(x) - both) // 2 :]])
            agree.append((minhash.signature(a, 64) == minhash.signature(b, 64)).mean())
        assert abs(np.mean(agree) - both / 260) < 0.03
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(minhash.sigma(x))) == len(np.unique(minhash.pi(x.copy()))) == len(x)
    # One permutation, shifted in a circle: coordinate k of a set is coordinate 0 of the set k places on.
    places = minhash.sigma(pool)
    assert minhash.signature(pool, 9)[7] == minhash.pi(places - np.uint64(7)).min()


def test_bands_recall_and_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = x[:370], x[30:]
        assert 0.84 < len(np.intersect1d(a, b)) / 400 < 0.86
        met += bool(set(minhash.bands_of(a).tolist()) & set(minhash.bands_of(b).tolist()))
    assert met == 300
    whole = minhash.signature(x, 140)
    monkeypatch.setattr(minhash, "GRID", 1000)
    assert (minhash.signature(x, 140) == whole).all()


@pytest.mark.parametrize("paired", [48, 3])
def test_near_duplicates(spark, corpus, monkeypatch, paired):  # noqa: F811
    """Families of near copies, odd rows, clashing columns; bands of many owners take the other way."""
    monkeypatch.setattr(minhash, "PAIRED", paired)
    monkeypatch.setattr(minhash, "BLOCK", 2048 if paired > 3 else 4)
    rng = random.Random(4)
    base = prose(rng, 120, [f"w{k}" for k in range(900)]).split()
    copies = []
    for k in range(30):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = f"x{k}"
        copies.append(" ".join(t))
    texts = [*corpus, "one", "ONE", corpus[20], *copies, " ".join(f"v{k}" for k in range(20_000))]
    df = frame(spark, texts).withColumn("component_id", F.lit("clash")).withColumn("bits", F.lit(1))
    want = {i: (n, c, i == c) for i, (n, c) in linked(texts, 5, 85).items()}
    assert by_id(minhash.near_duplicates(df), "n_shingles", "component_id", "kept") == want and len({c for _, c, _ in want.values()}) < len(texts) - 30


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", "en", "s"), (7, "a b c d e f", "en", "s"), (7, "a b c d e f", "en", "s"), (3, "A B C D E F", "en", "s"), (9, None, None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert got == sorted([(None, 2, 3, None), (7, 2, 3, False), (7, 2, 3, False), (3, 2, 3, True), (9, 0, 9, True)], key=repr)
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_bitmaps_never_part_linked_sets():
    rng = random.Random(7)
    passed = 0
    for _ in range(400):
        n = rng.choice([3, 40, 64, 120, 130, 500])
        a = {rng.getrandbits(63) for _ in range(n)}
        b = set(a)
        for _ in range(rng.randint(0, n // 4)):
            b.discard(next(iter(b))) if rng.random() < 0.5 else b.add(rng.getrandbits(63))
        c = {rng.getrandbits(63) for _ in range(n)}
        x, y, z = (np.array(sorted(s), np.uint64) for s in (a, b, c))
        bits = [jaccard.parity_bits(s) for s in (x, y, z)]
        both = len(a & b)
        if b and 100 * both >= 80 * (len(a) + len(b) - both):
            assert jaccard.may_link(len(a), bits[0], len(b), bits[1], 80) and minhash.forest([1, 2], [len(a), len(b)], bits[:2], 80) == ([1], [2])
        passed += n > 20 and jaccard.may_link(len(a), bits[0], len(c), bits[2], 80)
    assert passed == 0
