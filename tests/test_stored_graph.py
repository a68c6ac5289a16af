"""Stored adjacency without shuffles; the incremental graph against a full recompute after random changes."""

import random

import pytest

from paperloom.operators import graph, stored_graph

ENTITY = "recipe_id long, pos int, name string, role string"
ROLES = ["REACTANT", "SOLVENT", "PRODUCT", "ADDITIVE", "CATALYST"]


def some(rng, ids, names=12):
    return {i: [(i, pos, f"Chem {rng.randrange(names)}", rng.choice(ROLES)) for pos in range(rng.randint(1, 6))] for i in ids}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def kept(spark):
    rng = random.Random(3)
    recipes = some(rng, range(60))
    entities = spark.createDataFrame([e for r in recipes.values() for e in r], ENTITY)
    rows = spark.createDataFrame([(i, rng.choice(["PASSED", "FAILED", "CORRECTED"]), f"t{i}") for i in recipes], "recipe_id long, validation_status string, title string")
    return stored_graph.StoredGraph(spark, buckets=4).write(entities, rows), entities, rows


def test_reads_need_no_shuffle(kept):
    store, entities, rows = kept
    edges = graph.all_edges(entities)
    key = lambda df: sorted((r.source, r.target, r.relationship_type, r.width, r.n_recipes) for r in df.collect())
    chosen = lambda c: c.isin("chem::chem_1", "chem::chem_2", "rxn::7")
    hop = store.hop(chosen)
    assert "Exchange" not in plan(hop) and key(hop) == key(edges.where(chosen(edges.source) | chosen(edges.target))) != []
    mine = store.recipes_of(" CHEM 1")
    assert "Exchange" not in plan(mine)
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # else plans without a join don't tell which buckets they read
    store.spark.conf.set(auto, "false")
    assert "SelectedBucketsCount: 1 out of 4" in plan(store.recipes_of(" CHEM 1"))
    store.spark.conf.unset(auto)
    assert sorted(r.recipe_id for r in mine.collect()) == sorted(r.recipe_id for r in graph.recipes_for_chemical(rows, entities, "chem 1").collect())
    near = store.neighbours("chem 1", 5)
    assert "hashpartitioning" not in plan(near) and near.collect() == graph.cooccurring(entities, "chem 1", 5).collect()
    for df in (store.loose_ends(), store.degrees()):
        assert "Exchange" not in plan(df) and "SortMergeJoin" in plan(df)
    lost = {(r.source, r.target) for r in store.loose_ends().collect()}
    failed = {f"rxn::{r.recipe_id}" for r in rows.where("validation_status = 'FAILED'").collect()}
    assert lost == {(r.source, r.target) for r in edges.collect() if r.source in failed or r.target in failed} and lost
    assert sum(r.out_n for r in store.degrees().collect()) + len([1 for s, t in lost if s in failed]) == edges.count()


def test_tables_are_replaced_and_dropped(spark, kept):
    _, entities, rows = kept
    store = stored_graph.StoredGraph(spark, buckets=2)
    for part in (entities, entities.where("recipe_id < 10")):
        store.write(part, rows)
    assert store.table("uses").agg({"recipe_id": "max"}).first()[0] == 9
    store.drop()
    assert not spark.catalog.tableExists(f"{store.name}_ends")


def same(log, entities):
    rows = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.select(*c).collect())
    assert rows(log.pairs(), "source", "target", "weight", "width", "n_recipes") == rows(graph.cooccurrence_edges(entities), "source", "target", "weight", "width", "n_recipes")
    assert rows(log.roles(), "source", "target", "relationship_type", "writes") == rows(graph.role_edges(entities), "source", "target", "relationship_type", "writes")
    assert rows(log.nodes(), "node_id", "label", "role", "color", "reaction_count", "size") == rows(graph.chemical_nodes(entities), "node_id", "label", "role", "color", "reaction_count", "size")


def test_random_changes_equal_a_recompute(spark):
    """Recipes come, go and are replaced; a batch that is delivered twice, and summing up, change nothing."""
    rng, live = random.Random(8), {}
    log = stored_graph.GraphLog(spark)
    table = lambda rs: spark.createDataFrame([e for r in rs.values() for e in r], ENTITY)
    for step in range(4):
        gone = rng.sample(sorted(live), len(live) // 3)
        come = some(rng, [*rng.sample(gone, len(gone) // 2), *range(100 * step, 100 * step + 12)])
        changes = [(*e, -1) for i in gone for e in live[i]] + [(*e, 1) for r in come.values() for e in r]
        before = table(live)
        live = {i: r for i, r in live.items() if i not in gone} | come
        batch = log.apply(spark.createDataFrame(changes, ENTITY + ", sign int"))
        if step == 2:
            log.apply(spark.createDataFrame(changes, ENTITY + ", sign int"), batch)
        had, has = ({(r.source, r.target) for r in graph.cooccurrence_edges(t).collect()} for t in (before, table(live)))
        assert {(r.source, r.target, r.change) for r in log.delta("pairs").collect()} == {(*e, 1) for e in has - had} | {(*e, -1) for e in had - has}
        if step == 2:
            log.compact()
            with pytest.raises(ValueError):
                log.apply(spark.createDataFrame(changes, ENTITY + ", sign int"), batch)
    same(log, table(live))
    log.apply(spark.createDataFrame([(*e, -1) for r in live.values() for e in r], ENTITY + ", sign int"))
    assert log.pairs().count() == log.nodes().count() == log.roles().count() == 0
