"""The property graph of substances, procedures and papers, and its queries.

An edge is known by (source, target): of several written types the last holds. Every
table is derived from current recipes, so there are no stale edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edge type of each role; products point the other way.
RELATIONS = {"REACTANT": "IS_REACTANT_IN", "SOLVENT": "IS_SOLVENT_IN", "CATALYST": "IS_CATALYST_IN", "ADDITIVE": "IS_ADDITIVE_IN", "PRODUCT": "PRODUCES"}
COLOURS = {"REACTANT": "#4A90D9", "SOLVENT": "#7ED321", "CATALYST": "#F5A623", "PRODUCT": "#D0021B", "ADDITIVE": "#9B9B9B", "UNKNOWN": "#9B9B9B"}


def lookup(mapping: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def chemical_id(name: Column) -> Column:
    return F.concat(F.lit("chem::"), F.replace(F.trim(F.lower(name)), F.lit(" "), F.lit("_")))


def reaction_id(recipe_id: Column) -> Column:
    return F.concat(F.lit("rxn::"), recipe_id.cast("string"))


def paper_id(doi: Column, title: Column) -> Column:
    named = F.translate(doi, "/.", "__")
    return F.concat(F.lit("paper::"), F.coalesce(named, F.substring(F.md5(F.lower(title)), 1, 12)))


def paper_label(title: Column) -> Column:
    return F.when(F.length(title) > 40, F.concat(F.substring(title, 1, 40), F.lit("..."))).otherwise(title)


def role_edges(entities: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """source, target, relationship_type, recipe_id, further keys: a product's edge starts at the reaction, others end there."""
    chem, rxn = chemical_id(F.col("name")), reaction_id(F.col("recipe_id"))
    product = F.col("role") == "PRODUCT"
    written = entities.select(F.when(product, rxn).otherwise(chem).alias("source"), F.when(product, chem).otherwise(rxn).alias("target"), "recipe_id", "pos", "role", *keys)
    last = written.groupBy("source", "target", "recipe_id", *keys).agg(F.max_by("role", "pos").alias("role"), F.count("*").alias("writes"))
    return last.select("source", "target", lookup(RELATIONS, F.col("role"), RELATIONS["REACTANT"]).alias("relationship_type"), "recipe_id", "writes", *keys)


def pairs_inside(entities: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """recipe_id, further keys of a recipe, and p, its array of (source, target) of non-product entities, in entity order.

    Pairs are made inside the recipe's own array, so there is no self-join.
    """
    chem = entities.where(F.col("role") != "PRODUCT").select("recipe_id", *keys, F.struct("pos", chemical_id(F.col("name")).alias("id")).alias("e"))
    inside = chem.groupBy("recipe_id", *keys).agg(F.array_sort(F.collect_list("e")).alias("es"))
    pairs = F.flatten(F.transform("es", lambda a: F.transform(F.filter("es", lambda b: (b["pos"] > a["pos"]) & (b["id"] != a["id"])), lambda b: F.struct(a["id"].alias("source"), b["id"].alias("target")))))
    return inside.select("recipe_id", *keys, pairs.alias("p"))


def cooccurrence_pairs(entities: DataFrame) -> DataFrame:
    """source, target, recipe_id, writes of each pair of a recipe."""
    return pairs_inside(entities).select("recipe_id", F.explode("p").alias("p")).groupBy("p.source", "p.target", "recipe_id").agg(F.count("*").alias("writes"))


def cooccurrence_counts(entities: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """source, target, keys, n_recipes and writes of each pair over all recipes.

    The first of equal pairs is marked inside the recipe's array, so recipes are counted without a group of each pair and recipe.
    """
    first = lambda ps, p, k: F.when((k > 0) & (F.get(ps, k - 1) == p), 0).otherwise(1)
    # A list of one, so that pairs are made and sorted once.
    marked = F.get(F.transform(F.array(F.array_sort("p")), lambda ps: F.transform(ps, lambda p, k: F.struct(p["source"].alias("source"), p["target"].alias("target"), first(ps, p, k).alias("first")))), 0)
    rows = pairs_inside(entities, keys).select(*keys, F.explode(marked).alias("p"))
    return rows.groupBy("p.source", "p.target", *keys).agg(F.sum("p.first").alias("n_recipes"), F.count("*").alias("writes"))


def cooccurrence_edges(entities: DataFrame) -> DataFrame:
    """source, target, weight, width, n_recipes; an edge written once is 1 wide, else half its weight."""
    out = cooccurrence_counts(entities)
    weight = F.greatest(F.col("n_recipes"), F.lit(1)).cast("double")
    return out.select("source", "target", weight.alias("weight"), F.when(F.col("writes") == 1, 1.0).otherwise(weight / 2).alias("width"), "n_recipes")


def paper_edges(recipes: DataFrame) -> DataFrame:
    """reaction -> paper for recipes with a doi, title or url (recipe_id, doi, title, url)."""
    known = recipes.where(F.coalesce("doi", "title", "url").isNotNull())
    return known.select(reaction_id(F.col("recipe_id")).alias("source"), paper_id(F.col("doi"), F.coalesce("title", F.lit("Unknown"))).alias("target"), F.lit("SOURCED_FROM").alias("relationship_type")).distinct()


def all_edges(entities: DataFrame) -> DataFrame:
    """Role and co-occurrence edges in one shape: source, target, relationship_type, weight, width, n_recipes."""
    roles = role_edges(entities).select("source", "target", "relationship_type", F.lit(1.0).alias("weight"), F.when(F.col("writes") == 1, 1.0).otherwise(0.5).alias("width"), F.lit(0).cast("long").alias("n_recipes"))
    return roles.unionByName(cooccurrence_edges(entities).withColumn("relationship_type", F.lit("CO_OCCURS_WITH")))


def chemical_nodes(entities: DataFrame) -> DataFrame:
    """node_id, label, role, colour, reaction_count, size; label and role are the last written."""
    rows = entities.select(chemical_id(F.col("name")).alias("node_id"), "name", "role", "recipe_id", F.struct("recipe_id", "pos").alias("at"))
    out = rows.groupBy("node_id").agg(F.max_by("name", "at").alias("label"), F.max_by("role", "at").alias("role"), F.countDistinct("recipe_id").alias("reaction_count"))
    return out.select("node_id", "label", "role", lookup(COLOURS, F.col("role"), COLOURS["UNKNOWN"]).alias("color"), "reaction_count", F.least(F.lit(5) + 2 * F.col("reaction_count"), F.lit(50)).alias("size"))


def solvents_for_products(entities: DataFrame, examples: int = 3) -> DataFrame:
    """Of each product: its solvents with frequency, share in percent and the first `examples` recipes.

    Both hops over role edges stay inside a recipe, so products and solvents meet in its own arrays.
    """
    last = role_edges(entities).where(F.col("relationship_type").isin("PRODUCES", "IS_SOLVENT_IN"))
    made = F.col("relationship_type") == "PRODUCES"
    inside = last.groupBy("recipe_id").agg(F.collect_list(F.when(made, F.col("target"))).alias("products"), F.collect_list(F.when(~made, F.col("source"))).alias("solvents"))
    met = inside.select("recipe_id", F.explode("products").alias("product_id"), "solvents").select("recipe_id", "product_id", F.explode("solvents").alias("solvent_id"))
    first = met.withColumn("k", F.row_number().over(Window.partitionBy("product_id", "solvent_id").orderBy("recipe_id"))).where(F.col("k") <= examples)
    first = first.groupBy("product_id", "solvent_id").agg(F.array_sort(F.collect_list("recipe_id")).alias("example_recipe_ids"))
    out = met.groupBy("product_id", "solvent_id").agg(F.count("*").alias("frequency")).join(first, ["product_id", "solvent_id"])
    names = chemical_nodes(entities).select("node_id", "label")
    share = 100.0 * F.col("frequency") / F.sum("frequency").over(Window.partitionBy("product_id"))
    out = out.withColumn("percentage", F.round(share, 1))
    out = out.join(names.withColumnsRenamed({"node_id": "solvent_id", "label": "solvent_name"}), "solvent_id").join(names.withColumnsRenamed({"node_id": "product_id", "label": "product_name"}), "product_id")
    return out.select("product_name", "solvent_name", "frequency", "percentage", "example_recipe_ids")


def listed(pairs: DataFrame, keys: list[str], width: int = 1000) -> DataFrame:
    """Sorted, distinct recipe ids of each key in parts of at most `width` numbers: keys, part, recipe_ids.

    A part holds the ids of one range, so parts in order are the sorted list, and no key's list is gathered whole.
    """
    part = F.floor(F.col("recipe_id") / width)
    return pairs.groupBy(*keys, part.alias("part")).agg(F.array_sort(F.collect_set("recipe_id")).alias("recipe_ids"))


def node_recipes(entities: DataFrame) -> DataFrame:
    """node_id, part, recipe_ids of each chemical."""
    return listed(entities.select(chemical_id(F.col("name")).alias("node_id"), "recipe_id"), ["node_id"])


def edge_recipes(entities: DataFrame) -> DataFrame:
    """source, target, part, recipe_ids of each co-occurrence edge."""
    return listed(cooccurrence_pairs(entities).select("source", "target", "recipe_id"), ["source", "target"])


def label_search(nodes: DataFrame, part: str) -> DataFrame:
    """Nodes whose label holds `part`, in any case."""
    return nodes.where(F.contains(F.lower("label"), F.lit(part.lower())))


def recipes_for_chemical(recipes: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """Stored recipes with the chemical in any role."""
    mine = entities.where(chemical_id(F.col("name")) == chemical_id(F.lit(name))).select("recipe_id")
    return recipes.join(mine, "recipe_id", "left_semi")


def participation(entities: DataFrame) -> DataFrame:
    """chem, recipe_id once each, products too."""
    return entities.select(chemical_id(F.col("name")).alias("chem"), "recipe_id").distinct()


def cooccurring(entities: DataFrame, name: str, limit: int | None = 10) -> DataFrame:
    """Chemicals that share recipes with `name`, products included: count, and types of edges between the two."""
    me = chemical_id(F.lit(name))
    part = participation(entities)
    shared = part.where(F.col("chem") == me).select("recipe_id").join(part.where(F.col("chem") != me), "recipe_id").groupBy("chem").agg(F.count("*").alias("co_occurrence_count"))
    near = cooccurrence_pairs(entities).where((F.col("source") == me) | (F.col("target") == me))
    types = near.select(F.when(F.col("source") == me, F.col("target")).otherwise(F.col("source")).alias("chem"), F.lit("CO_OCCURS_WITH").alias("t"))
    types = types.groupBy("chem").agg(F.array_join(F.array_sort(F.collect_set("t")), "+").alias("relationship_types"))
    names = chemical_nodes(entities).select(F.col("node_id").alias("chem"), F.col("label").alias("chemical_name"))
    out = shared.join(types, "chem", "left").join(names, "chem").select("chemical_name", "co_occurrence_count", F.coalesce("relationship_types", F.lit("")).alias("relationship_types"))
    return out if limit is None else out.orderBy(F.desc("co_occurrence_count"), "chemical_name").limit(limit)


def shared_recipes(entities: DataFrame) -> DataFrame:
    """All pairs a < b of chemicals with the number of recipes they share."""
    part = entities.select("recipe_id", chemical_id(F.col("name")).alias("chem")).groupBy("recipe_id").agg(F.array_sort(F.collect_set("chem")).alias("cs"))
    pairs = F.flatten(F.transform("cs", lambda a: F.transform(F.filter("cs", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return part.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


def connected_edges(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges that touch a selected node (column `id`): two equi-joins instead of one with an or."""
    out = edges.join(selected.select(F.col("id").alias("source")), "source", "left_semi")
    into = edges.join(selected.select(F.col("id").alias("target")), "target", "left_semi").join(selected.select(F.col("id").alias("source")), "source", "left_anti")
    return out.unionByName(into.select(*out.columns))


def guarded(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends both exist (column `id` of nodes), and the others."""
    kept = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    lost_source = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_anti")
    lost_target = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_anti")
    return kept, lost_source.unionByName(lost_target.select(*lost_source.columns))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per node and edge in the shape a graph view takes."""
    n = nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.to_json(F.struct(F.col("node_id").alias("id"), "label", "color", "size")).alias("json"))
    e = edges.select(F.lit("edge").alias("kind"), F.concat_ws("->", "source", "target").alias("id"), F.to_json(F.struct(F.col("source").alias("from"), F.col("target").alias("to"), F.col("relationship_type").alias("label"), "width")).alias("json"))
    return n.unionByName(e)


def graph_stats(entities: DataFrame) -> DataFrame:
    """Counts of nodes by type, and of edges."""
    nodes = chemical_nodes(entities).agg(F.count("*").alias("chemicals"))
    rxn = entities.agg(F.countDistinct("recipe_id").alias("reactions"))
    edges = all_edges(entities).agg(F.count("*").alias("edges"))
    one = lambda df: df.withColumn("k", F.lit(1))  # noqa: E731  rows of one line each
    return one(nodes).join(one(rxn), "k").join(one(edges), "k").select("chemicals", "reactions", (F.col("chemicals") + F.col("reactions")).alias("nodes"), "edges")
