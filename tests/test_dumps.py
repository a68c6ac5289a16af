"""Dumps of services: split files, broken records, missing sources, all in one pass."""

import json

from pyspark.sql import functions as F

from paperloom.sources import dumps


def article(k, body=""):
    return f'<PubmedArticle><MedlineCitation><PMID Version="1">{k}</PMID><Article><ArticleTitle>Title <i>no</i>\n {k} &amp; more</ArticleTitle>{body}</Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/{k}</ArticleId></ArticleIdList></PubmedData></PubmedArticle>'


def test_a_dump_of_many_splits(spark, tmp_path):
    """Records that cross the borders of splits are read once, by the task in whose split they begin."""
    (tmp_path / "p.xml").write_text('<?xml version="1.0"?>\n<PubmedArticleSet>' + "\n".join(article(k, f"<Abstract><AbstractText>{'word ' * 40}</AbstractText></Abstract>") for k in range(700)) + "</PubmedArticleSet>\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = dumps.pubmed_rows(spark, str(tmp_path / "p.xml"))
        got = rows.withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len({r.part for r in got}) > 10
    assert sorted((int(r.pubmed_id), r.title, r.error) for r in got) == [(k, f"Title no {k} & more", None) for k in range(700)]


def test_a_broken_record_costs_no_other(spark, tmp_path):
    bad = "<PubmedArticle><PMID>7</PMID><ArticleTitle>Broken <b>oops</ArticleTitle></PubmedArticle>"
    (tmp_path / "p.xml").write_text(f"<PubmedArticleSet><PubmedArticle/>{article(1)}{bad}{article(2)}<PubmedArticle >{article(3)[15:]}<PubmedArticle><PMID>4</PMID><Article")
    rows = dumps.pubmed_rows(spark, str(tmp_path / "p.xml")).collect()
    assert sorted(r.pubmed_id for r in rows if r.error is None) == ["1", "2", "3"]
    broken = sorted(r.record for r in rows if r.error)
    assert len(broken) == 2 and "<PMID>4</PMID><Article" in broken[0] and "oops" in broken[1] and all(r.file.endswith("p.xml") for r in rows)


def test_namespaces(spark, tmp_path):
    entry = "<entry><id>http://arxiv.org/abs/2101.00001v2</id><title>A\n  title</title><arxiv:doi>10.2/y</arxiv:doi><author><name> Ann </name><arxiv:affiliation>X</arxiv:affiliation></author><published>2021-01-02</published><summary>Said.</summary><link title='doi' href='https://doi.org/10.2/y'/></entry>"
    (tmp_path / "a.xml").write_text(f'<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>feed</title>{entry}<entry><title/></entry></feed>')
    rows = dumps.arxiv_rows(spark, str(tmp_path / "a.xml")).collect()
    assert [(r.title, r.arxiv_id, r.doi, r.authors, r.year, r.abstract, r.error) for r in rows] == [("A title", "2101.00001", "https://doi.org/10.2/y", ["Ann"], 2021, "Said.", None)]


def test_landing_counts_what_it_writes(spark, tmp_path):
    """One write gives papers and faults, and their numbers by source are those of the tables."""
    (tmp_path / "p.xml").write_text(article(1) + "<PubmedArticle><b></PubmedArticle>" + article(2))
    (tmp_path / "o.json").write_text("\n".join([json.dumps({"results": [{"id": "W1", "title": "T"}, {"id": "W2"}]}), '{"results": [', json.dumps({"results": []}), json.dumps({"other": 1})]))
    landed = dumps.land(spark, {"pubmed": str(tmp_path / "p.xml"), "openalex": str(tmp_path / "o.json"), "arxiv": str(tmp_path / "none")}, lines=True, folder=str(tmp_path / "out"))
    assert landed.counts == {"pubmed": (2, 1), "arxiv": (0, 1), "openalex": (1, 1)}
    for table, at in ((landed.papers, 0), (landed.faults, 1)):
        assert {r.source_db: r["count"] for r in table.groupBy("source_db").count().collect()} == {k: v[at] for k, v in landed.counts.items() if v[at]}
    fault = {r.source_db: r for r in landed.faults.collect()}
    assert fault["arxiv"].record is None and "none" in fault["arxiv"].file and fault["openalex"].record == '{"results": [' and [r.source_ord for r in landed.papers.select("source_ord").distinct().orderBy("source_ord").collect()] == [0, 2]
    assert dumps.land(spark, {}).papers.count() == 0
