"""Comparison by hash sums, and phrase dictionaries."""

import random

from pyspark.sql import functions as F

from paperloom.operators import dictionary, metrics, reconcile


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_differences_are_those_of_except_all(spark, monkeypatch):
    rng = random.Random(1)
    data = [(rng.randrange(300), rng.choice([None, "a", "b"]), rng.choice([None, 0.5, 1.5]), rng.choice([None, 1])) for _ in range(900)]
    schema = "k long, s string, x double, y int"
    other = list(data)
    other[3], other[500] = (data[3][0], "new", None, None), (9999, None, None, 1)
    other += [data[10], data[10]]
    del other[700:703]
    one, two = spark.createDataFrame(data, schema), spark.createDataFrame(other, schema).repartition(3)
    for limit in (1_000_000, 0):  # at 0 the tree is descended to its last level
        monkeypatch.setattr(reconcile, "ROWS", limit)
        for key in (["k"], None):
            assert rows(reconcile.differences(one, two, key)) == rows(metrics.differences(one, two)) != []


def test_equal_tables_are_compared_without_their_rows(spark):
    one = spark.range(5000).withColumn("s", F.when(F.col("id") % 7 > 0, "x"))
    two = one.repartition(5).orderBy(F.desc("id"))
    assert reconcile.differences(one, two, ["id"]).count() == 0
    found = reconcile.differing(one, two.withColumn("s", F.when(F.col("id") == 77, "y").otherwise(F.col("s"))), ["id"], 1).collect()
    assert len(found) == 1 and found[0].n < 40  # one range of 4096
    assert reconcile.differences(one.limit(0), two.limit(0)).count() == 0


def test_nulls_count_by_their_column(spark):
    one, two = spark.createDataFrame([(None, 1), (2, None)], "a int, b int"), spark.createDataFrame([(1, None), (None, 2)], "a int, b int")
    assert reconcile.differences(one, two, ["a"]).count() == 4


TEXTS = ["Zinc acetate dihydrate and zinc\nacetate; ZINC-acetate!", None, "", "zincacetate azinc acetate", "İ zinc (acetate) 日本 語", "iron oxide iron oxide", "a b c d e"]
TERMS = ["zinc acetate", "Zinc acetate  dihydrate", "zinc", "日本", "oxide iron", "iron oxide", "b c", "c d e", "", None, "ZINC"]


def found(spark, **more):
    texts, terms = spark.createDataFrame(list(enumerate(TEXTS)), "doc long, text string"), spark.createDataFrame([(t,) for t in TERMS], "term string")
    return sorted((r.doc, r.word_start, r.word_end, r.term, r.start, r.end) for r in dictionary.find_terms(texts, "doc", "text", terms, **more).collect())


def test_phrases(spark, monkeypatch):
    longest = found(spark)
    assert [r[:4] for r in longest] == [(0, 0, 3, "zinc acetate dihydrate"), (0, 4, 6, "zinc acetate"), (0, 6, 8, "zinc acetate"), (4, 1, 3, "zinc acetate"), (4, 3, 4, "日本"), (5, 0, 2, "iron oxide"), (5, 2, 4, "iron oxide"), (6, 1, 3, "b c")]
    assert [TEXTS[d][a:b] for d, _, _, _, a, b in longest] == ["Zinc acetate dihydrate", "zinc\nacetate", "ZINC-acetate", "zinc (acetate", "日本", "iron oxide", "iron oxide", "b c"]
    everywhere = found(spark, overlapping=True)
    assert {(5, 1, 3, "oxide iron"), (6, 2, 5, "c d e"), (0, 0, 1, "zinc"), (3, 1, 2, "zinc")} & {r[:4] for r in everywhere} == {(5, 1, 3, "oxide iron"), (6, 2, 5, "c d e"), (0, 0, 1, "zinc")}
    monkeypatch.setattr(dictionary, "PART_CHARS", 20)  # several automata: the same matches
    assert found(spark) == longest and found(spark, overlapping=True) == everywhere


def test_a_hundred_thousand_terms(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    terms = sorted({" ".join(word() for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(130_000)})
    assert len(terms) >= 100_000
    docs = [(i, " ".join(word() for _ in range(200)) + " " + rng.choice(terms)) for i in range(50)]
    known = set(terms)
    want = sorted((i, k, n) for i, t in docs for w in [t.split()] for n in (1, 2, 3) for k in range(len(w) - n + 1) if " ".join(w[k : k + n]) in known)
    got = dictionary.find_terms(spark.createDataFrame(docs, "doc long, text string"), "doc", "text", spark.createDataFrame([(t,) for t in terms], "term string"), overlapping=True)
    assert sorted((r.doc, r.word_start, r.word_end - r.word_start) for r in got.collect()) == want != []
