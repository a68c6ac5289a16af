"""Paper deduplication: exact by DOI, then fuzzy by title, with an order-sensitive record merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import normalize_title
from paperloom.operators import titles
from paperloom.session import cut

FIELDS = ("title", "doi", "source_db", "citation_count", "year", "abstract")


def missing(c: Column, kind: str) -> Column:
    """Null, an empty text and an empty list are missing; 0 and false are not."""
    return c.isNull() | ((c == "") if kind == "string" else (F.size(c) == 0) if kind.startswith("array") else F.lit(False))


def merged(papers: DataFrame, key: str, fields: tuple[str, ...] = FIELDS, order: str = "ord") -> DataFrame:
    """One row per key: records folded in order. The richer one wins, a tie goes to the earlier, gaps are filled from the other.

    source_db of both are put together as an ordered, distinct list with +. What is folded has all the fields that any
    record so far had, so a record that has the same fields as an earlier one neither wins nor fills a gap; it counts by
    its source only. So the first record of each set of fields and source is all that a key's fold needs, however many
    records there are, and these are found before the shuffle.
    """
    kinds = dict(papers.dtypes)
    inside = [f for f in fields if f != key]
    there = sum([F.when(missing(F.col(f), kinds[f]), 0).otherwise(1 << i) for i, f in enumerate(inside)], F.lit(0))
    source = F.col("source_db") if "source_db" in inside else F.lit("")
    records = papers.select(key, there.alias("there"), source.alias("source"), F.struct(order, *inside).alias("r"))
    firsts = records.groupBy(key, "there", "source").agg(F.min_by("r", F.col(f"r.{order}")).alias("r"), F.count("*").alias("n"))
    lists = firsts.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rs"), F.sum("n").cast("int").alias("n_merged"))
    rich = lambda r: sum([F.when(missing(r[f], kinds[f]), 0).otherwise(1) for f in inside], F.lit(0))

    def fold(a: Column, b: Column) -> Column:
        first = rich(a) >= rich(b)
        out = [a[order].alias(order)]
        for f in inside:
            one, two = F.when(first, a[f]).otherwise(b[f]), F.when(first, b[f]).otherwise(a[f])
            value = F.when(missing(one, kinds[f]), two).otherwise(one)
            if f == "source_db":
                both = F.array_join(F.array_distinct(F.split(F.concat_ws("+", one, two), r"\+")), "+")
                value = F.when(one.isNotNull() & two.isNotNull() & (one != two), both).otherwise(value)
            out.append(value.alias(f))
        return F.struct(*out)

    folded = F.aggregate(F.slice("rs", 2, F.greatest(F.size("rs") - 1, F.lit(0))), F.get("rs", 0), fold)
    return lists.select(key, folded.alias("r"), "n_merged").select(key, "r.*", "n_merged")


def exact_dedup(papers: DataFrame) -> DataFrame:
    """Papers with a DOI, one per DOI."""
    return merged(papers.where(F.col("doi").isNotNull()), "doi")


def fuzzy_leaders(papers: DataFrame, least: float = 88.0) -> DataFrame:
    """(ord, leader): a paper without DOI belongs to the first DOI group with a similar title, else to the first
    earlier leader without DOI that is similar, else it leads. DOI groups lead themselves, known by their first ord.

    Leaders are found in rounds: a paper is decided as soon as all similar papers before it are. This is the
    outcome of taking the papers one by one, not that of connected components.
    """
    # Of an abstract only whether it is there counts for which title a DOI group gets.
    known = papers.where(F.col("doi").isNotNull()).withColumn("abstract", F.substring("abstract", 1, 1))
    groups = merged(known, "doi").select("ord", normalize_title(F.col("title")).alias("t"), F.lit(True).alias("lead"))
    rest = papers.where(F.col("doi").isNull()).select("ord", normalize_title(F.col("title")).alias("t"), F.lit(False).alias("lead"))
    rows = cut(groups.unionByName(rest))
    first = rows.where("t <> ''").groupBy("t").agg(F.min(F.when(F.col("lead"), F.col("ord"))).alias("led"), F.min(F.when(~F.col("lead"), F.col("ord"))).alias("free"))
    # Each distinct title stands as its DOI group's first row and as its first free row.
    names = first.select(F.col("t"), F.least("led", "free").alias("rep"), "led", "free")
    pairs = cut(titles.similar(rows.select("ord", "t"), least))
    named = names.select("rep", "led", "free")
    two_way = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = two_way.join(named.withColumnsRenamed({"rep": "a", "led": "_l", "free": "me"}), "a").join(named.withColumnsRenamed({"rep": "b"}), "b").select("me", "led", "free")
    own = named.select(F.col("free").alias("me"), "led", F.lit(None).cast("long").alias("free"))
    links = cut(links.unionByName(own).where("me is not null"))
    by_doi = links.where("led is not null").groupBy("me").agg(F.min("led").alias("leader"))
    state = names.where("free is not null").select(F.col("free").alias("me")).join(by_doi, "me", "left").select("me", "leader", F.lit(False).alias("leads"))
    before = links.where("free < me").select("me", F.col("free").alias("other")).distinct()
    before = cut(before)
    state = cut(state)
    while not state.where("leader is null").isEmpty():
        seen = before.join(state.select(F.col("me").alias("other"), F.col("leader").alias("ol"), F.col("leads").alias("oleads")), "other")
        facts = seen.groupBy("me").agg(F.count_if(F.col("ol").isNull()).alias("open"), F.min(F.when(F.col("oleads"), F.col("other"))).alias("lead"), F.min(F.when(F.col("ol").isNull(), F.col("other"))).alias("first_open"))
        now = state.join(facts, "me", "left")
        # An earlier leader decides once no paper before it is open; with none open and no leader the paper leads.
        joins = F.col("lead").isNotNull() & (F.col("first_open").isNull() | (F.col("lead") < F.col("first_open")))
        alone = F.coalesce(F.col("open"), F.lit(0)) == 0
        leader = F.coalesce(F.col("leader"), F.when(joins, F.col("lead")).when(alone, F.col("me")))
        state = cut(now.select("me", leader.alias("leader"), (F.col("leads") | (F.col("leader").isNull() & alone & F.col("lead").isNull())).alias("leads")))
    by_title = names.join(state.select(F.col("me").alias("free"), "leader"), "free").select("t", "leader")
    found = rows.where("not lead").join(by_title, "t", "left").select("ord", F.coalesce("leader", "ord").alias("leader"))
    return found.unionByName(rows.where("lead").select("ord", F.col("ord").alias("leader")))
