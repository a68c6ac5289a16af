"""The segment-index join of titles against the full table of common subsequences."""

import random

import pytest

from paperloom.operators import dedup, titles
from tests.test_semantics import lcs_ratio


def edited(rng, t, most, letters="abcd "):
    out = list(t)
    for _ in range(rng.randint(0, most)):
        k = rng.randrange(len(out) + 1)
        if rng.random() < 0.5 and len(out) > 1:
            out.pop(min(k, len(out) - 1))
        else:
            out.insert(k, rng.choice(letters))
    return "".join(out)


@pytest.mark.parametrize("least", [70, 88, 95])
def test_segments_hold(least):
    """Similar titles keep all segments but as many as they have edits, where the index looks for them; scores are exact."""
    rng, similar = random.Random(least), 0
    for _ in range(1500):
        a = "".join(rng.choice("abcd ") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30, 60, 150])))
        b = edited(rng, a, 1 + len(a) // 4)
        want, got = lcs_ratio(a, b), titles.ratio(a, b, least)
        assert got == (pytest.approx(want) if want >= least else 0)
        if want >= least:
            similar += 1
            r, s = sorted((a, b), key=len)
            found, laid = {}, titles.laid(s, least)
            for k, j, key in titles.sought(r, least):
                if k == titles.band(len(s)):
                    found[j] = found.get(j, False) or key in laid
            most = titles.edits(len(r), len(s), least)
            assert len(found) > most and sum(found.values()) >= len(found) - most and titles.in_place(r, s, least)
    assert similar > 200


@pytest.mark.parametrize("least", [75.0, 88.0])
def test_join_against_all_pairs(spark, least):
    rng = random.Random(int(least))
    stems = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (1, 4, 9, 25, 25, 60, 60, 180)] + ["synthesis of zinc oxide in water", "é ß ütf grün"]
    texts = [edited(rng, rng.choice(stems), 12) for _ in range(150)] + ["", "x" * 3000, "x" * 2990 + "y" * 10]
    got = {(r.a, r.b): r.score for r in titles.similar(spark.createDataFrame(list(enumerate(texts)), "ord long, t string"), least).collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    names = sorted((i, t) for t, i in first.items() if t)
    want = {(i, j): lcs_ratio(s, t) for k, (i, s) in enumerate(names) for j, t in names[k + 1 :] if 2 * min(len(s), len(t)) >= (len(s) + len(t)) * least / 100 - 1 and len(s) < 1000 and lcs_ratio(s, t) >= least}
    want[151, 152] = titles.ratio(texts[151], texts[152], least)
    assert got == pytest.approx(want) and len(want) > 50


def test_few_pairs_are_compared(spark):
    """Of titles as they are, under 1 % of all pairs have enough segments in place to be compared."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    named = docs.selectExpr("doc_id AS ord", "split(text, '\n')[0] AS title").select("ord", dedup.normalize_title("title").alias("t")).where("t <> ''")
    groups = dedup.cut(named.groupBy("t").agg({"ord": "min"}).withColumnRenamed("min(ord)", "ord"))
    text = {r.ord: r.t for r in groups.collect()}
    met = titles.candidates(groups, 88.0).collect()
    compared = sum(titles.in_place(text[r.r], text[r.s], 88.0) for r in met)
    assert compared < 0.01 * len(text) * (len(text) - 1) / 2 and len(met) < 0.02 * len(text) * (len(text) - 1) / 2


def test_no_titles(spark):
    assert titles.similar(spark.createDataFrame([(1, ""), (2, None)], "ord long, t string")).count() == 0
    with pytest.raises(ValueError):
        titles.similar(spark.createDataFrame([], "ord long, t string"), 60.0)
