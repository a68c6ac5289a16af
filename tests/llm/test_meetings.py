"""Near copies are told once or a few times, not by each bucket that holds one of their common keys."""

import functools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import jaccard
from tests.llm.test_operators import by_id, frame, linked


def test_labels_are_told_once():
    keys, ids, labels = np.array([1] * 4 + [2] * 20, np.uint64), np.array([1, 2, 3, 4, *range(1, 21)]), np.array([1, 1, 3, 3, *[1, 1, 3, 3] * 5])
    pairs, stars = jaccard.met_pairs(keys, ids, 16, labels)
    assert pairs.tolist() == [[1, 3], [1, 4], [2, 3], [2, 4]] and stars.tolist() == [[1, 3]]
    pairs, stars = jaccard.met_pairs(keys, ids, 16)
    assert len(pairs) == 6 and stars.tolist() == [[1, k] for k in range(2, 21)]


@pytest.mark.parametrize("size", [6, 40])
def test_near_copies_are_told_by_few_keys(spark, monkeypatch, size):
    rng, texts, told, plain = random.Random(size), [], [], jaccard.meetings

    def counted(chunks):
        def rows(table: pa.Table) -> pa.Table:
            got = [jaccard.unpacked(*x) for x in zip(*(table.column(c).to_pylist() for c in ("n_keys", "n_ids", "packed")))]
            keys, ids, labels = (np.concatenate(c) for c in zip(*got))
            return pa.table({"n": [sum(map(len, jaccard.met_pairs(keys, ids, jaccard.PAIRED, labels)))]})

        told.append(chunks.groupBy("bucket").applyInArrow(rows, "n long").agg(F.sum("n")).first()[0])
        return plain(chunks)

    monkeypatch.setattr(jaccard, "meetings", counted)
    for _ in range(240 // size):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for _ in range(size):
            k = rng.randrange(300)
            texts.append(" ".join(words[:k] + [f"x{rng.randrange(10**6)}"] + words[k + 1 :]))
    docs = frame(spark, texts)
    rows = jaccard.materialize(jaccard.sets(docs, 5, functools.partial(jaccard.signatures, shells=jaccard.Shells(80)), "doc_id", "text", 64))
    edges = jaccard.edges_of(rows, jaccard.nodes_of(rows), 80)
    assert edges.count() > 0 and sum(told) < 4 * jaccard.LEADING * len(texts)
    assert by_id(jaccard.link(docs, 5, 80), "n_shingles", "component_id") == linked(texts, 5, 80)
