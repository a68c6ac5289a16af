"""The graph as tables that are kept: an adjacency in buckets, and rollups that follow changes.

`StoredGraph` writes nodes, edges under both of their ends, and the recipes of each chemical into
buckets by node, sorted in them. A hop, a chemical's recipes or its neighbours then read buckets,
and checks of ends join bucket with bucket: no rows are shuffled.

`GraphLog` keeps signed counts of what recipes contribute. A batch of added and removed recipes
costs what these recipes cost; the rest isn't looked at, and a count of zero is an edge or node that is gone.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from paperloom.operators import graph
from paperloom.session import scratch_path


#: Tables of a stored graph.
PARTS = ("nodes", "ends", "uses", "near")


class StoredGraph:
    """Tables `<name>_nodes`, `_ends`, `_uses` and `_near` of the session's catalog, with their files in the shared folder."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 32) -> None:
        self.spark, self.name, self.buckets = spark, name or f"graph_{uuid4().hex}", buckets

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def keep(self, part: str, rows: DataFrame) -> None:
        """Each task writes one bucket, so a bucket is one sorted file."""
        rows = rows.repartition(self.buckets, "node_id").sortWithinPartitions("node_id")
        rows.write.bucketBy(self.buckets, "node_id").sortBy("node_id").option("path", scratch_path(self.spark, part)).mode("overwrite").saveAsTable(f"{self.name}_{part}")

    def write(self, entities: DataFrame, recipes: DataFrame, parts: tuple[str, ...] = PARTS) -> StoredGraph:
        """All tables anew, or those that are named. recipes: recipe_id, validation_status and title; those that failed have no node."""
        for part in parts:
            self.keep(part, getattr(self, f"made_{part}")(entities, recipes))
        return self

    @staticmethod
    def made_nodes(entities: DataFrame, recipes: DataFrame) -> DataFrame:
        stored = recipes.where("validation_status <> 'FAILED'")
        reactions = stored.select(graph.reaction_id(F.col("recipe_id")).alias("node_id"), F.col("title").alias("label"), F.lit("REACTION").alias("role"))
        return graph.chemical_nodes(entities).unionByName(reactions, allowMissingColumns=True)

    @staticmethod
    def made_ends(entities: DataFrame, recipes: DataFrame) -> DataFrame:
        ways = F.explode(F.array(F.struct(F.col("source").alias("node_id"), F.col("target").alias("other"), F.lit(True).alias("out")), F.struct(F.col("target").alias("node_id"), F.col("source").alias("other"), F.lit(False).alias("out"))))
        return graph.all_edges(entities).select(ways.alias("w"), "relationship_type", "weight", "width", "n_recipes").select("w.*", "relationship_type", "weight", "width", "n_recipes")

    @staticmethod
    def made_uses(entities: DataFrame, recipes: DataFrame) -> DataFrame:
        return graph.participation(entities).join(recipes, "recipe_id").select(F.col("chem").alias("node_id"), "recipe_id", "validation_status", "title")

    @staticmethod
    def made_near(entities: DataFrame, recipes: DataFrame) -> DataFrame:
        both = F.explode(F.array(F.struct(F.col("a").alias("node_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("node_id"), F.col("a").alias("other"))))
        types = graph.cooccurrence_edges(entities).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.lit("CO_OCCURS_WITH").alias("relationship_types")).distinct()
        near = graph.shared_recipes(entities).join(types, ["a", "b"], "left").select(both.alias("w"), F.col("shared").alias("co_occurrence_count"), F.coalesce("relationship_types", F.lit("")).alias("relationship_types"))
        names = graph.chemical_nodes(entities).select(F.col("node_id").alias("other"), F.col("label").alias("chemical_name"))
        return near.select("w.*", "co_occurrence_count", "relationship_types").join(names, "other")

    def drop(self) -> None:
        for part in PARTS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")

    def hop(self, chosen: Callable[[Column], Column]) -> DataFrame:
        """Edges that touch nodes whose id is chosen, each once."""
        ends = self.table("ends").where(chosen(F.col("node_id")) & (F.col("out") | ~chosen(F.col("other"))))
        return as_edges(ends)

    def recipes_of(self, chemical: str) -> DataFrame:
        """recipe_id, validation_status and title of all recipes with the chemical in any role: one bucket."""
        return self.table("uses").where(F.col("node_id") == id_of(self.spark, chemical)).drop("node_id")

    def neighbours(self, chemical: str, limit: int = 10) -> DataFrame:
        """Chemicals that most recipes have along with it: one bucket."""
        rows = self.table("near").where(F.col("node_id") == id_of(self.spark, chemical)).select("chemical_name", "co_occurrence_count", "relationship_types")
        return rows.orderBy(F.desc("co_occurrence_count"), "chemical_name").limit(limit)

    def loose_ends(self) -> DataFrame:
        """Ends of edges, as edges with `missing`, whose node isn't there: buckets of both tables meet."""
        lost = self.table("ends").join(self.table("nodes").select("node_id").hint("merge"), "node_id", "left_anti")
        return as_edges(lost, F.col("node_id").alias("missing"))

    def degrees(self) -> DataFrame:
        """node_id, label, out_n, in_n and neighbours of each node: grouped and joined where the buckets lie."""
        counts = self.table("ends").groupBy("node_id").agg(F.count_if("out").alias("out_n"), F.count_if(~F.col("out")).alias("in_n"))
        return self.table("nodes").select("node_id", "label").join(counts.hint("merge"), "node_id", "left").select("node_id", "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("out_n", "in_n")])


def id_of(spark: SparkSession, chemical: str) -> str:
    """The node id as a value: only a filter by value picks its bucket before reading."""
    return spark.range(1).select(graph.chemical_id(F.lit(chemical))).first()[0]


def as_edges(ends: DataFrame, *more: Column) -> DataFrame:
    source, target = F.when(F.col("out"), F.col("node_id")).otherwise(F.col("other")), F.when(F.col("out"), F.col("other")).otherwise(F.col("node_id"))
    return ends.select(source.alias("source"), target.alias("target"), "relationship_type", "weight", "width", "n_recipes", *more)


class GraphLog:
    """Signed contributions by batch, in folders of their own; a batch that is written again replaces itself.

    A removed recipe is given with the entities that it was added with. `base` is the batch up to which
    compact() has summed. A log keeps all kinds of counts, or those that are named.
    """

    KEYS = {"pairs": ["source", "target"], "roles": ["source", "target", "relationship_type", "recipe_id", "writes"], "nodes": ["node_id"], "labels": ["node_id", "recipe_id", "pos", "name", "role"]}
    COUNTS = {"pairs": ["n_recipes", "writes"], "roles": ["n"], "nodes": ["n_recipes"], "labels": ["n"]}

    def __init__(self, spark: SparkSession, folder: str | None = None, last: int = -1, base: int = -1, kinds: tuple[str, ...] = ("pairs", "roles", "labels", "nodes")) -> None:
        self.spark, self.folder, self.last, self.base, self.kinds = spark, folder or scratch_path(spark, "graph-log"), last, base, kinds
        self.schemas: dict = {}

    def apply(self, changes: DataFrame, batch: int | None = None) -> int:
        """Entities of added (sign 1) and removed (sign -1) recipes."""
        batch = self.last + 1 if batch is None else batch
        if batch <= self.base:
            raise ValueError("this batch has been summed up")
        for kind in sorted(self.kinds):  # labels before nodes
            path = f"{self.folder}/{kind}/batch={batch}"
            if kind == "nodes" and "labels" in self.kinds:
                # A chemical of a recipe has one label, so labels tell how many recipes come and go.
                labels = self.spark.read.schema(self.schemas["labels"]).parquet(f"{self.folder}/labels/batch={batch}")
                rows = labels.select("node_id", F.lit(1).alias("sign"), F.col("n").alias("n_recipes"))
            else:
                rows = self.contributions(changes, kind)
            signed = [F.sum(F.col("sign") * (F.col(c) if c in rows.columns else 1)).cast("long").alias(c) for c in self.COUNTS[kind]]
            out = rows.groupBy(*self.KEYS[kind]).agg(*signed).where(" or ".join(f"{c} <> 0" for c in self.COUNTS[kind]))
            self.schemas[kind] = out.schema
            out.write.mode("overwrite").parquet(path)
        self.last = max(self.last, batch)
        return batch

    @staticmethod
    def contributions(changes: DataFrame, kind: str) -> DataFrame:
        """What recipes add or take away, with the sign: a recipe that is replaced has both."""
        if kind == "pairs":
            return graph.cooccurrence_counts(changes, ("sign",))
        if kind == "roles":
            return graph.role_edges(changes, ("sign",))
        rows = changes.select(graph.chemical_id(F.col("name")).alias("node_id"), "recipe_id", "pos", "name", "role", "sign")
        last = rows.groupBy("node_id", "recipe_id", "sign").agg(F.max_by(F.struct("pos", "name", "role"), "pos").alias("l")).select("node_id", "recipe_id", "sign", "l.*")
        return last if kind == "labels" else last.select("node_id", "sign")

    def summed(self, kind: str, upto: int | None = None, since: int | None = None) -> DataFrame:
        """Counts of all batches, of those up to one, or of those since one; zeros are gone."""
        rows = self.spark.read.schema(StructType([*self.schemas[kind], StructField("batch", LongType())])).parquet(f"{self.folder}/{kind}")
        rows = rows.where(F.col("batch") >= self.base)
        rows = rows if upto is None else rows.where(F.col("batch") <= upto)
        rows = rows if since is None else rows.where(F.col("batch") >= since)
        out = rows.groupBy(*self.KEYS[kind]).agg(*[F.sum(c).alias(c) for c in self.COUNTS[kind]])
        return out.where(" or ".join(f"{c} <> 0" for c in self.COUNTS[kind]))

    def pairs(self) -> DataFrame:
        """Co-occurrence edges, as graph.cooccurrence_edges() makes them of all recipes that are there."""
        weight = F.col("n_recipes").cast("double")
        return self.summed("pairs").select("source", "target", weight.alias("weight"), F.when(F.col("writes") == 1, 1.0).otherwise(weight / 2).alias("width"), "n_recipes")

    def roles(self) -> DataFrame:
        return self.summed("roles").select("source", "target", "relationship_type", "recipe_id", "writes")

    def nodes(self) -> DataFrame:
        """Chemicals, as graph.chemical_nodes() makes them; the label is that of the last recipe that is there."""
        counts = self.summed("nodes").select("node_id", F.col("n_recipes").alias("reaction_count"))
        last = self.summed("labels").groupBy("node_id").agg(F.max_by(F.struct("name", "role"), "recipe_id").alias("l"))
        rows = counts.join(last, "node_id").select("node_id", F.col("l.name").alias("label"), F.col("l.role").alias("role"), "reaction_count")
        return rows.select("node_id", "label", "role", graph.lookup(graph.COLOURS, F.col("role"), graph.COLOURS["UNKNOWN"]).alias("color"), "reaction_count", F.least(F.lit(5) + 2 * F.col("reaction_count"), F.lit(50)).alias("size"))

    def delta(self, kind: str, batch: int | None = None) -> DataFrame:
        """Keys that the batch added (1) or removed (-1); only keys that it touched are summed."""
        batch, key, count = self.last if batch is None else batch, self.KEYS[kind], self.COUNTS[kind][0]
        now = self.summed(kind, upto=batch, since=batch).select(*key, F.col(count).alias("by"))
        before = self.summed(kind, upto=batch - 1).join(now.select(*key), key, "left_semi")
        both = now.join(before.select(*key, F.col(count).alias("had")), key, "left").withColumn("had", F.coalesce("had", F.lit(0)))
        change = F.when((F.col("had") == 0) & (F.col("by") > 0), 1).when((F.col("had") > 0) & (F.col("had") + F.col("by") == 0), -1)
        return both.select(*key, change.alias("change")).where("change is not null")

    def compact(self) -> None:
        """Sums the batches so far into the last one; what was read before stays until the new files are there."""
        for kind in self.kinds:
            path, whole = f"{self.folder}/{kind}/batch={self.last}", f"{self.folder}/_summed_{kind}_{uuid4().hex}"
            self.summed(kind).write.parquet(whole)
            of = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            files = of(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            files.delete(of(path), True)
            if not files.rename(of(whole), of(path)):
                raise OSError(f"{whole} can't be moved to {path}")
        self.base = self.last
