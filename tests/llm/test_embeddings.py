"""Hard negatives and whitening against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import negatives, whitening
from paperloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, score long, x string, n int"


def frame(spark, rows):
    """Rows with clashing extra columns."""
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA)


def usable(r):
    return r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])


def whole(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


def hard_negatives(rows, k=5, low=80):
    """Every score of every anchor."""
    data = list({(i, label, tuple(whole(v))) for i, v, label in rows if i is not None and label is not None and usable((i, v))})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = collections.Counter()
    for i, label, x in data:
        if i % 100:
            continue
        order = lambda rs: sorted(((-dot(x, y), j) for j, _, y in rs))
        same = order(r for r in data if r[1] == label and r[0] != i and len(r[2]) == len(x))[:k]
        others = order(r for r in data if r[1] != label and len(r[2]) == len(x))
        for p, j in same:
            window = [(s, m) for s, m in others if low * -p <= 100 * -s <= 100 * -p][:k]
            out.update((i, j, rank, m, -p, -s) for rank, (s, m) in enumerate(window, 1))
    return out


def mined(df, **more):
    return collections.Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in negatives.mine(df, F.col("vec_id") % 100 == 0, **more).collect())


@pytest.fixture(scope="module")
def vectors():
    """Clusters, copies, ties, and rows that take no part."""
    rng = random.Random(5)
    hubs = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(0, 3000, 10):
        hub = rng.choice(hubs)
        rows.append((i, [c + rng.gauss(0, 0.1) for c in hub] if rng.random() < 0.8 else hub, rng.randrange(3)))
    rows += [(5, None, 1), (15, [0.1, None, 0.2, 0.3, 0.4, 0.5], 1), (25, [float("nan")] + hubs[0][1:], 1), (100, [float("inf")] * 6, 2), (None, hubs[0], 1), (200, hubs[1], None), (35, [], 1), (300, [], 1), (45, [], 2), (400, [0.5, 0.5], 0), (55, [0.5, 0.25], 0), (65, [0.5, 0.2], 1)]
    return rows + [rows[20]] * 3 + [(600, hubs[2], 7), (600, hubs[3], 7)]


def test_negatives_against_brute_force(spark, vectors, monkeypatch):
    want = hard_negatives(vectors)
    assert mined(frame(spark, vectors)) == want and len(want) > 200
    # Small zones, bundles, groups and tasks: the same rows from many of each.
    for name, value in {"PART_ROWS": 40, "ZONE_ENTRIES": 60, "BUNDLE": 1, "GROUP": 3, "GROUPS": 2, "MAPS": 3, "READERS": 2}.items():
        monkeypatch.setattr(negatives, name, value)
    assert mined(frame(spark, vectors)) == want
    assert mined(frame(spark, vectors), k_positives=3, k_negatives=3, low=95) == hard_negatives(vectors, k=3, low=95)


def test_negatives_of_nothing(spark, vectors):
    assert not mined(frame(spark, [])) and not mined(frame(spark, vectors[:1])) and not mined(frame(spark, [(5, None, 1)]))


def test_zones_are_chosen_by_bounds(spark):
    """In clustered data most zones are left out, and none that holds a result."""
    rng = np.random.default_rng(2)
    hubs = rng.normal(size=(24, 8))
    x = np.repeat(hubs, 150, axis=0) + rng.normal(size=(3600, 8)) * 0.02
    rows = [(i, v, int(rng.integers(3))) for i, v in enumerate(x.tolist())]
    zones = negatives.zones_of(whitening.whole_entries(frame(spark, rows).select(F.col("vec_id").alias("id"), F.col("label").cast("long"), (F.col("vec_id") % 100 == 0).alias("anchor"), "embedding"), "embedding").select("id", "label", "anchor", "x"))
    groups = negatives.groups_of(zones, 5)
    picks = negatives.chosen(groups, zones, True)
    read = sum(len(p["at"]) for r in picks.collect() for p in r.picks)
    # Zones hold up to 1024 rows here, so neighbours on the curve share them; all of them for all anchors would be:
    assert 36 <= read <= 36 * zones.count()
    want = hard_negatives(rows)
    assert mined(frame(spark, rows)) == want


def test_hilbert_curve():
    """Neighbours on the curve are neighbours in space: each step changes one dimension by one."""
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.indices((1 << bits,) * d).reshape(d, -1).T
        order = cells[np.argsort(np.array([int.from_bytes(k) for k in negatives.hilbert(cells, bits)]), kind="stable")]
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("kind", ["random", "few", "low rank", "equal"])
def test_spectrum(kind):
    """Rank-one updates and merges against the scatter matrix of all vectors."""
    rng = np.random.default_rng(3)
    x = rng.integers(-90, 90, size=({"few": 7}.get(kind, 150), 12))
    if kind == "low rank":
        x[:, 6:] = x[:, :6] * 2
    if kind == "equal":
        x = np.concatenate([np.eye(12, dtype=int) * 50, -np.eye(12, dtype=int) * 50])
    whole_one, parts = whitening.Spectrum(12), [whitening.Spectrum(12) for _ in range(4)]
    for i, row in enumerate(x):
        whole_one.add(row)
        parts[i % 3].add(row)
    for p in parts[1:]:
        parts[0].merge(p)
    c = x - x.mean(axis=0)
    for s in (whole_one, parts[0]):
        assert s.n == len(x) and (s.sums == x.sum(axis=0)).all()
        assert np.allclose((s.vectors * s.values) @ s.vectors.T, c.T @ c, atol=1e-8 * (c * c).sum())
        assert np.allclose(s.vectors.T @ s.vectors, np.eye(12), atol=1e-12) and np.allclose(s.values, np.linalg.eigvalsh(c.T @ c), atol=1e-9 * (c * c).sum())


def check_whitened(got, rows, k=4):
    by_width = collections.defaultdict(list)
    for r in rows:
        if usable(r) and r[1]:
            by_width[len(r[1])].append((r[0], tuple(whole(r[1]))))
    left = collections.defaultdict(list)
    for r in got:
        left[r.vec_id].append(r)
    assert len(got) == sum(len(v) * min(k, w) for w, v in by_width.items())
    for width, members in by_width.items():
        fit = np.array(sorted({x for _, x in members}), float)
        n, mean, sums = len(fit), fit.mean(axis=0), [sum(int(x[j]) for x in {x for _, x in members}) for j in range(width)]
        values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
        order = np.argsort(-values)[:k]
        sign = {}
        for i, x in members:
            mine = [r for r in left[i] if r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums)) and r.n == n]
            for c, o in enumerate(order, 1):
                r = next(r for r in mine if r.component == c)
                if values[o] < 1e-9 * max(values.sum(), 1e-9):
                    assert r.whitened is None and not r.explained
                    continue
                assert abs(r.explained - values[o] / values.sum()) < 1e-10 and r.identity_error < 1e-9
                y = (np.array(x) - mean) @ vectors[:, o] / np.sqrt(values[o])
                if abs(y) > 1e-6:
                    sign.setdefault(c, np.sign(y) * np.sign(r.whitened))
                assert abs(y - sign.get(c, 1) * r.whitened) < 1e-6


def test_whitening_against_brute_force(spark, vectors):
    rng = np.random.default_rng(4)
    spread = [(i, (v * np.arange(1, 8)).tolist(), 1) for i, v in enumerate(rng.normal(size=(200, 7)) * 0.1)]
    rows = spread + [spread[3]] * 5 + [(None, spread[9][1], 2), (900, None, 1), (901, [float("nan")] * 7, 1), (902, [None] * 7, 1), (903, [], 1), (904, [0.5, 0.25], 1), (905, [0.5, 0.25], 1)]
    check_whitened(whitening.whiten(frame(spark, rows)).collect(), rows)
    check_whitened(whitening.whiten(frame(spark, rows).repartition(29, "vec_id")).collect(), rows)


def test_whitening_of_little(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.1, 0.2, 0.3, 0.9], 1), (2, [0.5, 0.1, 0.2, 0.3, 0.9], 1)])).collect()
    assert len(one) == 8 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)


def test_whitening_query(spark):
    """The whole table of the smallest size."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitened(QUERIES["op12_embedding_whitening"](spark, sf).collect(), rows)
