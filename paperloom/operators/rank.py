"""Relevance, top papers, and the choice of a text source per paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Text sources by priority, and the least length of an abstract that is one.
ACQUIRERS = (("pmc", 1), ("arxiv", 2), ("openalex_abstract", 20), ("semantic_scholar_abstract", 21))
MIN_ABSTRACT = 50


def relevance(target: str, synonyms: list[str], as_of_year: int) -> Column:
    age = F.lit(as_of_year) - F.col("year")
    recent = F.when(F.coalesce(F.col("year"), F.lit(0)) == 0, 0.0).when(age <= 2, 0.15).when(age <= 5, 0.10).when(age <= 10, 0.05).otherwise(0.0)
    title = F.lower("title")
    named = F.when(F.contains(title, F.lit(target.lower())), 0.15) if target else F.when(F.lit(False), 0.0)
    for s in synonyms:
        named = named.when(F.contains(title, F.lit(s.lower())), 0.08)
    flag = lambda c, v: F.when(F.coalesce(F.col(c), F.lit(False)), v).otherwise(0.0)
    cited = F.least(F.log10(F.coalesce(F.col("citation_count"), F.lit(0)) + 1) / 5.0, F.lit(0.20))
    return F.least(flag("has_experimental_section", 0.30) + flag("open_access", 0.20) + cited + recent + F.coalesce(named, F.lit(0.0)), F.lit(1.0))


def top_papers(papers: DataFrame, target: str, synonyms: list[str], as_of_year: int, k: int = 15) -> DataFrame:
    """The k most relevant papers; equal scores in input order. A distributed top-k, without a full sort."""
    return papers.withColumn("relevance_score", relevance(target, synonyms, as_of_year)).orderBy(F.desc("relevance_score"), "ord").limit(k)


def acquisition(papers: DataFrame) -> DataFrame:
    """(ord, method): the first text source by priority that has something for the paper."""
    has_abstract = F.length("abstract") > MIN_ABSTRACT
    can = {"pmc": F.col("pubmed_central_id").isNotNull(), "arxiv": F.col("arxiv_id").isNotNull(), "openalex_abstract": has_abstract, "semantic_scholar_abstract": F.col("semantic_scholar_id").isNotNull() & has_abstract}
    first = F.coalesce(*[F.when(can[name], name) for name, _ in sorted(ACQUIRERS, key=lambda a: a[1])])
    return papers.select("ord", first.alias("method")).where("method is not null")


def waterfall(papers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate chunks (ord, method, priority, …) of the first method by priority that gave any, per paper."""
    first = candidates.where(F.length("text") > 0).groupBy("ord").agg(F.min("priority").alias("priority"))
    return papers.select("ord").join(first, "ord").join(candidates, ["ord", "priority"])


def first_chunks(chunks: DataFrame, k: int) -> DataFrame:
    """The first k chunks of each paper in chunk order; the limit is applied before the shuffle too."""
    order = Window.partitionBy("paper").orderBy("chunk_ord")
    return chunks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
