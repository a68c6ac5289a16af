"""What graph queries leave out: groups of each pair and recipe, tables that they don't read, shuffles of entities."""

from paperloom.operators import graph, stored_graph
from paperloom.sources import surrogates

SF = "/root/testdata/sf0.001"
ENTITY = "recipe_id long, pos int, name string, role string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_counted_without_a_group_of_each_recipe(spark):
    rows = spark.createDataFrame([(1, k, n, "SOLVENT") for k, n in enumerate("abab")] + [(2, 0, "a", "SOLVENT"), (2, 1, "b", "REACTANT"), (2, 2, "c", "PRODUCT"), (3, 0, "a", "SOLVENT")], ENTITY)
    got = graph.cooccurrence_counts(rows)
    assert sorted(tuple(r) for r in got.collect()) == [("chem::a", "chem::b", 2, 4), ("chem::b", "chem::a", 1, 1)]
    assert "recipe_id" not in plan(got).split("explode")[0]  # no keys above the pairs but the pairs
    want = graph.cooccurrence_pairs(rows).groupBy("source", "target").agg({"recipe_id": "count", "writes": "sum"})
    assert sorted(tuple(r) for r in want.collect()) == sorted(tuple(r) for r in got.collect())


def test_entities_stay_by_recipe(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        by_recipe = surrogates.entities(spark, SF).groupBy("recipe_id").count()
        assert plan(by_recipe).count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_tables_and_kinds_that_are_named(spark):
    rows = spark.createDataFrame([(1, 0, "a", "SOLVENT"), (1, 1, "b", "SOLVENT")], ENTITY)
    recipes = spark.createDataFrame([(1, "PASSED", "t")], "recipe_id long, validation_status string, title string")
    store = stored_graph.StoredGraph(spark, buckets=2).write(rows, recipes, ("uses",))
    assert store.recipes_of("a").count() == 1 and not spark.catalog.tableExists(f"{store.name}_ends")
    store.drop()
    log = stored_graph.GraphLog(spark, kinds=("labels", "nodes"))
    log.apply(rows.selectExpr("*", "1 AS sign"))
    log.apply(rows.where("pos = 0").selectExpr("*", "-1 AS sign"))
    log.compact()
    assert [(r.node_id, r.reaction_count) for r in log.nodes().collect()] == [("chem::b", 1)] and sorted(log.schemas) == ["labels", "nodes"]
