"""Comparisons, indexes and notes that move no more than they need."""

from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import metrics, reconcile
from paperloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_more_rows_are_more_tasks(spark, monkeypatch):
    one = spark.createDataFrame([(k % 50, None if k % 7 == 0 else k % 3) for k in range(200)], "a int, b int")
    monkeypatch.setattr(metrics, "DELTA_ROWS", 10)
    out = metrics.snapshot_delta(one.where("a < 40"), one.where("a >= 10"), ["a", "b"])
    keys = lambda df: {tuple(r) for r in df.collect()}
    before, after = keys(one.where("a < 40")), keys(one.where("a >= 10"))
    assert tuple(out.first()) == (len(after - before), len(before - after)) and ", 32)" in plan(out)  # 160 rows of either side


def test_ranges_are_summed_without_a_join(spark):
    one = spark.range(500).withColumn("s", F.when(F.col("id") % 7 > 0, "x"))
    two = one.where("id <> 3").unionByName(one.where("id = 4"))
    assert "Join" not in plan(reconcile.differing(one, two, ["id"], 1))
    got = sorted(tuple(r) for r in reconcile.differences(one, two, ["id"]).collect())
    assert got == [(3, "x", "stored"), (4, "x", "expected")]


def test_inverted_index(spark):
    rows = spark.createDataFrame([("b a b c a b",), ("",), (None,), ("é",)], "t string").select(text.inverted_index(text.words(F.col("t"))).alias("index"))
    assert [r["index"] for r in rows.collect()] == [{"a": [1, 4], "b": [0, 2, 5], "c": [3]}, {}, None, {"é": [0]}]
    back = spark.createDataFrame([("b a b c a b",)], "t string").select(text.abstract_from_index(text.inverted_index(text.words(F.col("t")))).alias("t"))
    assert back.first().t == "b a b c a b" and "Exchange" not in plan(QUERIES["abstract_rebuild"](spark, SF))


def test_notes_are_made_once(spark):
    assert plan(QUERIES["note_amounts"](spark, SF)).count("Join ") <= 3  # names, entities, conditions
