"""Dumped payloads, model outputs, URLs, names, notes and text sources. Payloads are made of parts, orders and documents, then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.functions import chem, model_json, text, urls
from paperloom.operators import chunking, dictionary, extract, metrics, rank
from paperloom.operators import validate as rules
from paperloom.plans.registry import ENTITIES, PAPERS, RECIPES, having, query
from paperloom.session import scratch_path
from paperloom.sources import dumps, events, notes, pages, quarantine
from paperloom.sources import surrogates as tables


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size"))


def dumped(rows: Column, df: DataFrame, kind: str) -> str:
    """Writes one payload a line, and tells where."""
    path = scratch_path(df.sparkSession, kind)
    df.select(rows.alias("value")).write.text(path)
    return path


def k() -> Column:
    return F.col("k").cast("string")


#: One element or response per part; every fiftieth is cut off.
PUBMED = lambda: F.concat(
    F.lit("<PubmedArticle><PMID>"), k(), F.lit("</PMID><ArticleTitle>"), "name", F.lit(" <i>"), "kind", F.lit("</i></ArticleTitle><Abstract><AbstractText>"), "brand", F.lit("</AbstractText><AbstractText>was "),
    F.when(F.col("k") % 3 == 0, "heated").otherwise("kept"), F.lit("</AbstractText></Abstract><Author><LastName>"), "brand", F.lit("</LastName><ForeName>A</ForeName></Author><PubDate><Year>"),
    (F.col("size") + 1950).cast("string"), F.lit("</Year></PubDate><ArticleId IdType=\"doi\">10.1/X"), k(), F.when(F.col("k") % 50 == 7, "</ArticleId></Broken>").otherwise("</ArticleId>"),
    F.when(F.col("k") % 2 == 0, F.concat(F.lit("<ArticleId IdType=\"pmc\">PMC"), k(), F.lit("</ArticleId>"))).otherwise(""), F.lit("</PubmedArticle>"),
)
ARXIV = lambda: F.concat(
    F.lit("<entry xmlns=\"http://www.w3.org/2005/Atom\"><id>http://arxiv.org/abs/2101."), k(), F.lit("v"), F.col("size").cast("string"), F.lit("</id><title>"), "name", F.lit("   of "), "kind",
    F.lit("</title><summary>It was "), F.when(F.col("k") % 3 == 0, "stirred").otherwise("kept"), F.lit(".</summary><author><name>"), "brand", F.lit("</name></author><published>"), (F.col("size") + 1950).cast("string"),
    F.lit("-01-02</published><link title=\"doi\" href=\"https://doi.org/10.2/Y"), k(), F.lit("\"/></entry>"),
)
OPENALEX = lambda: F.regexp_replace(F.to_json(F.struct(F.array(F.struct(
    F.concat(F.lit("W"), k()).alias("id"), F.when(F.col("k") % 4 == 0, "").otherwise(F.col("name")).alias("title"), F.col("kind").alias("display_name"), F.concat(F.lit("https://doi.org/10.3/Z"), k()).alias("doi"),
    (F.col("size") + 1950).alias("publication_year"), F.col("size").alias("cited_by_count"), F.struct((F.col("k") % 2 == 0).alias("is_oa"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("https://x.org/"), k())).alias("oa_url")).alias("open_access"),
    F.array(F.struct(F.struct(F.col("brand").alias("display_name")).alias("author"))).alias("authorships"), F.create_map(F.lit("made"), F.array(F.lit(1), F.lit(3)), F.lit("we"), F.array(F.lit(0)), F.lit("it"), F.array(F.lit(2))).alias("abstract_inverted_index"),
)).alias("results"))), F.when(F.col("k") % 50 == 7, r"\}\]\}$").otherwise("^$"), "")
SCHOLAR = lambda: F.to_json(F.struct(F.array(F.struct(
    F.concat(F.lit("s"), k()).alias("paperId"), F.col("name").alias("title"), F.col("kind").alias("abstract"), (F.col("size") + 1950).alias("year"), F.col("size").alias("citationCount"), (F.col("k") % 2 == 0).alias("isOpenAccess"),
    F.when(F.col("k") % 2 == 0, F.struct(F.concat(F.lit("https://y.org/"), k()).alias("url"))).alias("openAccessPdf"), F.struct(F.concat(F.lit("10.4/Q"), k()).alias("DOI"), F.concat(F.lit("2101."), k()).alias("ArXiv")).alias("externalIds"),
    F.array(F.struct(F.col("brand").alias("name"))).alias("authors"),
)).alias("data")))


def shown(papers: DataFrame, *columns: str) -> DataFrame:
    return papers.select(*columns, F.array_join("authors", ",").alias("authors"), F.col("year").cast("long").alias("year"), "abstract", "open_access", "open_access_url", "has_experimental_section")


@query("""SELECT p_name || ' ' || p_type AS title, '10.1/X' || p_partkey AS doi, CAST(p_partkey AS VARCHAR) AS pubmed_id, CASE WHEN p_partkey % 2 = 0 THEN 'PMC' || p_partkey END AS pubmed_central_id, 'A ' || p_brand AS authors,
  CAST(p_size + 1950 AS BIGINT) AS year, p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' was heated' ELSE ' was kept' END AS abstract, p_partkey % 2 = 0 AS open_access,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || p_partkey || '/' ELSE 'https://pubmed.ncbi.nlm.nih.gov/' || p_partkey || '/' END AS open_access_url, p_partkey % 3 = 0 AS has_experimental_section
FROM part WHERE p_partkey % 50 <> 7""")
def pubmed_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(dumps.pubmed(spark, dumped(PUBMED(), parts(spark, sf_dir), "pubmed")), "title", "doi", "pubmed_id", "pubmed_central_id")


@query("""SELECT p_name || ' of ' || p_type AS title, 'https://doi.org/10.2/Y' || p_partkey AS doi, '2101.' || p_partkey AS arxiv_id, p_brand AS authors, CAST(p_size + 1950 AS BIGINT) AS year,
  CASE WHEN p_partkey % 3 = 0 THEN 'It was stirred.' ELSE 'It was kept.' END AS abstract, TRUE AS open_access, 'https://ar5iv.org/abs/2101.' || p_partkey AS open_access_url, p_partkey % 3 = 0 AS has_experimental_section FROM part""")
def arxiv_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(dumps.arxiv(spark, dumped(ARXIV(), parts(spark, sf_dir), "arxiv")), "title", "doi", "arxiv_id")


@query("""SELECT CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_name END AS title, 'https://doi.org/10.3/Z' || p_partkey AS doi, 'W' || p_partkey AS openalex_id, CAST(p_size AS BIGINT) AS citation_count, p_brand AS authors,
  CAST(p_size + 1950 AS BIGINT) AS year, 'we made it made' AS abstract, p_partkey % 2 = 0 AS open_access, CASE WHEN p_partkey % 2 = 0 THEN 'https://x.org/' || p_partkey ELSE 'W' || p_partkey END AS open_access_url, FALSE AS has_experimental_section
FROM part WHERE p_partkey % 50 <> 7""")
def openalex_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dumps.openalex(spark, dumped(OPENALEX(), parts(spark, sf_dir), "openalex"), lines=True)
    return shown(found.withColumn("citation_count", F.col("citation_count").cast("long")), "title", "doi", "openalex_id", "citation_count")


@query("""SELECT p_name AS title, '10.4/q' || p_partkey AS doi, '2101.' || p_partkey AS arxiv_id, 's' || p_partkey AS semantic_scholar_id, p_brand AS authors, CAST(p_size + 1950 AS BIGINT) AS year, p_type AS abstract, p_partkey % 2 = 0 AS open_access,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://y.org/' || p_partkey ELSE 'https://www.semanticscholar.org/paper/s' || p_partkey END AS open_access_url, FALSE AS has_experimental_section FROM part""")
def scholar_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(dumps.semantic_scholar(spark, dumped(SCHOLAR(), parts(spark, sf_dir), "scholar"), lines=True), "title", "doi", "arxiv_id", "semantic_scholar_id")


@query("""WITH s AS (SELECT unnest(['pubmed', 'arxiv', 'openalex', 'semantic_scholar']) AS source_db, unnest([0, 1, 2, 3]) AS o)
SELECT source_db, o::BIGINT AS source_ord, (SELECT count(*) FROM part WHERE source_db IN ('arxiv', 'semantic_scholar') OR p_partkey % 50 <> 7) AS papers_n,
  (SELECT count(*) FROM part WHERE (source_db IN ('arxiv', 'semantic_scholar') OR p_partkey % 50 <> 7) AND (source_db = 'arxiv' OR p_partkey % 2 = 0)) AS open_n,
  CASE WHEN source_db IN ('arxiv', 'semantic_scholar') THEN 0 ELSE (SELECT count(*) FROM part WHERE p_partkey % 50 = 7) END AS broken_n, '10.' || (o + 1) || '/' AS doi_prefix FROM s""")
def collected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four services as one table of papers, DOIs normalised; broken records are counted, the rest is read."""
    rows = parts(spark, sf_dir)
    paths = {"pubmed": dumped(PUBMED(), rows, "pubmed"), "arxiv": dumped(ARXIV(), rows, "arxiv"), "openalex": dumped(OPENALEX(), rows, "openalex"), "semantic_scholar": dumped(SCHOLAR(), rows, "scholar")}
    landed = dumps.land(spark, paths, lines=True)
    bad = spark.createDataFrame([(name, n) for name, (_, n) in landed.counts.items()], "source_db string, broken_n long")
    prefix = landed.papers.groupBy("source_db").agg(F.max("source_ord").cast("long").alias("source_ord"), F.min(F.regexp_extract("doi", r"^10\.\d/", 0)).alias("doi_prefix"))
    return dumps.source_stats(landed.papers).join(prefix, "source_db").join(bad, "source_db")


@query("""SELECT 'pubmed' AS source_db, p_partkey AS k, 'record' AS kind FROM part WHERE p_partkey % 50 = 7 UNION ALL SELECT 'openalex', p_partkey, 'record' FROM part WHERE p_partkey % 50 = 7
UNION ALL SELECT 'semantic_scholar', NULL, 'source' """)
def source_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for what can't be read: broken records with their text, and a source whose dump isn't there."""
    rows = parts(spark, sf_dir)
    paths = {"pubmed": dumped(PUBMED(), rows, "pubmed"), "arxiv": dumped(ARXIV(), rows, "arxiv"), "openalex": dumped(OPENALEX(), rows, "openalex"), "semantic_scholar": f"{sf_dir}/no such dump"}
    faults = dumps.land(spark, paths, lines=True).faults
    number = F.regexp_extract(F.coalesce("record", F.lit("")), r"10\.\d/[XYZ](\d+)", 1).try_cast("long")
    return faults.select("source_db", number.alias("k"), F.when(F.col("record").isNull(), "source").otherwise("record").alias("kind"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, 'Synthesis of ' || p_name AS section, 11::BIGINT + 2 * len(string_split(p_name, ' ')) + len(string_split(p_type, ' ')) AS n_words FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'methods', 10::BIGINT + len(string_split(p_name, ' ')) FROM part WHERE p_partkey % 2 = 0""")
def fulltext_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested sections of articles: one by its title, one by its type, one that is neither."""
    many = F.lit("one two three four five six seven eight nine ten ")
    xml = F.concat(
        F.lit("<article><sec><title>Synthesis of "), "name", F.lit("</title><p>"), many, "name", F.lit(" </p><p>"), "kind", F.lit("</p></sec>"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit('<sec sec-type="Methods"><p>'), many, "name", F.lit("</p></sec>"))).otherwise(""), F.lit("<sec><title>Results</title><p>"), many, F.lit("</p></sec></article>"),
    )
    found = dumps.pmc_sections(parts(spark, sf_dir).select("k", xml.alias("xml")), "k", "xml", 10)
    return found.select("key", "section", F.size(text.words(F.col("text"))).cast("long").alias("n_words"))


SHAPES = (
    '{"entities": [{"name": "%s", "role": "REACTANT", "quantity": "%s g"}]}', '```json\n{"entities": [{"name": "%s", "role": "SOLVENT", "quantity": {"value": "%s", "unit": "mL"}}]}\n```', 'Here it is:\n[{"name": "%s", "role": "PRODUCT", "quantity": %s}]\nDone.',
    "{'entities': [{name: '%s', 'role': 'CATALYST', 'moles': '%s mmol', 'quantity': None,}", '{"chemicals": [{"name": "unknown", "role": "REACTANT"}, {"name": "%s", "role": "ADDITIVE", "notes": "%s"},]}', "No list for %s today, %s.",
)


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs about parts, in six shapes."""
    said = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("k") % len(SHAPES) + 1).cast("int"))
    return parts(spark, sf_dir).select("k", F.replace(F.regexp_replace(said, "(?s)^(.*?)%s", F.lit("$1~")), F.lit("~"), F.col("name")).alias("raw"), F.col("size")).select("k", F.replace("raw", F.lit("%s"), F.col("size").cast("string")).alias("raw"))


@query("""SELECT p_partkey AS k, p_name AS name, ['REACTANT', 'SOLVENT', 'PRODUCT', 'CATALYST', 'ADDITIVE'][p_partkey % 6 + 1] AS role, CASE WHEN p_partkey % 6 < 2 THEN p_size::DOUBLE END AS value, CASE p_partkey % 6 WHEN 0 THEN 'g' WHEN 1 THEN 'mL' END AS unit,
  CASE WHEN p_partkey % 6 = 3 THEN p_size::DOUBLE END AS moles, [1, 2, 5, 3, 5][p_partkey % 6 + 1]::BIGINT AS step FROM part WHERE p_partkey % 6 <> 5 AND NOT (p_partkey % 6 = 4)""")
def model_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of model outputs by the ladder; notes that are numbers make an entity bad."""
    good, _ = model_json.typed_and_failed(outputs(spark, sf_dir))
    return good.select("k", F.explode("entities").alias("e"), F.col("step").cast("long").alias("step")).select("k", "e.name", "e.role", "e.quantity.value", "e.quantity.unit", F.col("e.moles.value").alias("moles"), "step")


@query("SELECT p_partkey AS k FROM part WHERE p_partkey % 6 >= 4")
def model_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_json.typed_and_failed(outputs(spark, sf_dir))[1].select("k")


@query("SELECT event_id, props AS text FROM events")
def unfenced_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 3
    said = F.when(n == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(n == 1, F.concat(F.lit("```"), "props", F.lit("```"))).otherwise(F.concat(F.lit("  "), "props"))
    return tables.table(spark, sf_dir, "events").select("event_id", model_json.unfenced(said).alias("text"))


#: Pages' URLs, some of them changed to what a check has to find.
VARIANT = """CASE page_id % 6 WHEN 0 THEN replace(url, '://', '//') WHEN 1 THEN 'ftp://x.org/' || page_id WHEN 2 THEN 'https://doi.org/10.1234/a' || page_id || ').,' WHEN 3 THEN 'https://pubs.acs.org/doi/pdf/10.1021/b' || page_id ELSE url END"""


def variant() -> Column:
    n, page = F.col("page_id") % 6, F.col("page_id").cast("string")
    return (
        F.when(n == 0, F.replace("url", F.lit("://"), F.lit("//"))).when(n == 1, F.concat(F.lit("ftp://x.org/"), page)).when(n == 2, F.concat(F.lit("https://doi.org/10.1234/a"), page, F.lit(").,")))
        .when(n == 3, F.concat(F.lit("https://pubs.acs.org/doi/pdf/10.1021/b"), page)).otherwise(F.col("url"))
    )


@query(f"""WITH u AS (SELECT page_id, {VARIANT} AS url, page_id % 12 = 4 AS gone, page_id % 7 + 96 AS n_words, lower(substr(html, 1, 5000)) AS head FROM pages)
SELECT page_id, page_id % 6 >= 2 AS valid, CASE page_id % 6 WHEN 2 THEN '10.1234/a' || page_id WHEN 3 THEN '10.1021/b' || page_id END AS doi,
  CASE WHEN page_id % 6 < 2 THEN 'INVALID_URL' WHEN page_id % 6 = 3 THEN 'PAYWALL_DETECTED' WHEN gone THEN 'HTTP_ERROR' WHEN n_words < 100 THEN 'EXTRACTION_FAILED' END AS error,
  CASE WHEN page_id % 6 < 2 THEN 'invalid source URL' ELSE '[Open original paper](' || url || ')' END AS link, CASE WHEN page_id % 6 IN (2, 3) THEN 5 ELSE 2 END::BIGINT AS alternatives FROM u""")
def url_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity, DOI, first fault, link and open alternatives of each page's URL."""
    rows = tables.table(spark, sf_dir, "pages").select("page_id", variant().alias("url"), F.when(F.col("page_id") % 12 != 4, "text").alias("html"), (F.col("page_id") % 7 + 96).alias("n_words"))
    doi = urls.doi(F.col("url"))
    return rows.select(
        "page_id", urls.is_valid(F.col("url")).alias("valid"), doi.alias("doi"), urls.input_error(F.col("url"), F.col("html"), F.col("n_words")).alias("error"), urls.link(F.col("url")).alias("link"),
        F.size(urls.alternatives(doi)).cast("long").alias("alternatives"),
    )


@query("""SELECT page_id, page_id % 4 >= 2 OR contains(lower(url), 'login') OR contains(lower(substr(html, 1, 5000)), 'purchase access') AS paywalled FROM pages""")
def paywall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the status of the response: 401 and 403 are paywalls."""
    status = F.element_at(F.array(*map(F.lit, (200, 404, 401, 403))), (F.col("page_id") % 4 + 1).cast("int"))
    return tables.table(spark, sf_dir, "pages").select("page_id", urls.paywalled_response(F.col("url"), F.col("html"), status).alias("paywalled"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE '10.5/ab' || o_orderkey END AS doi FROM orders")
def normalized_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 5
    bare = F.concat(F.lit("10.5/AB"), F.col("o_orderkey").cast("string"))
    said = F.when(n == 0, F.concat(F.lit(" https://doi.org/"), bare)).when(n == 1, F.concat(F.lit("http://dx.doi.org/"), bare)).when(n == 2, F.concat(F.lit("DOI:"), bare)).when(n == 3, F.concat(bare, F.lit(" "))).otherwise(" ")
    return tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text.normalize_doi(said).alias("doi"))


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 5 > 1 THEN p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'Zn(OAc)2·2H2O' WHEN p_partkey % 3 = 1 THEN 'H2O' END AS formula,
  ['nitrogen', 'argon', 'air', 'oxygen', 'steam'][p_partkey % 5 + 1] AS atmosphere FROM part""")
def checked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are none, formulas that are none, names of atmospheres."""
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("k") % len(xs) + 1).cast("int"))
    name = F.when(F.col("k") % 5 == 0, "N/A ").when(F.col("k") % 5 == 1, "  Unknown").otherwise(F.concat(F.lit(" "), "name"))
    return parts(spark, sf_dir).select("k", chem.checked_name(name).alias("name"), chem.formula(pick("Zn(OAc)2·2H2O", "H2O", "water, pure")).alias("formula"), chem.atmosphere_name(pick("N2", " Ar", "ambient", "o2", "Steam")).alias("atmosphere"))


@query("SELECT p_partkey AS k, replace(p_name, ' ', '_') || '_x_' || p_size AS file_name FROM part")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("["), "name", F.lit("]: (x)/ "), F.col("size").cast("string"), F.lit("?"))
    return parts(spark, sf_dir).select("k", text.file_name(said).alias("file_name"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN round((n // 2) * 0.000000075::DOUBLE + (n - n // 2) * 0.0000003::DOUBLE, 12) ELSE 0.0::DOUBLE END AS cost FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS n FROM lineitem)")
def cost_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.floor("l_extendedprice")
    provider = F.when(F.col("l_returnflag") == "N", "gemini").otherwise("local")
    return tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(chem.cost(provider, tokens), 12).alias("cost"))


@query(having(ENTITIES, select="""
SELECT recipe_id, CASE recipe_id % 2 WHEN 0 THEN 'Sol-Gel' ELSE 'Reflux' END || ' synthesis of ' || coalesce(arg_min(name, pos) FILTER (role = 'PRODUCT'), 'unknown product') AS title FROM ents GROUP BY 1"""))
def recipe_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.entities(spark, sf_dir).groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "role"))).alias("es"))
    technique = F.when(F.col("recipe_id") % 2 == 0, "sol-gel").otherwise("reflux")
    return rows.select("recipe_id", extract.recipe_title(technique, F.col("es")).alias("title"))


@query("""WITH c AS (SELECT doc_id AS ord, 1 AS priority, 'pmc' AS method, CASE WHEN doc_id % 14 = 0 THEN '' ELSE text END AS text FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, 2, 'arxiv', text FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 20, 'openalex_abstract', text FROM documents WHERE length(text) > 50)
SELECT ord, method, priority::BIGINT AS priority, length(text) AS n_chars FROM c WHERE length(text) > 0 QUALIFY priority = min(priority) OVER (PARTITION BY ord)""")
def waterfall_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first text source by priority that gives something; some of the first source's answers are empty."""
    docs = tables.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "ord")
    source = lambda name, rows, said: rows.select("ord", F.lit(name).alias("method"), F.lit(dict(rank.ACQUIRERS)[name]).alias("priority"), said.alias("text"))
    found = source("pmc", docs.where("ord % 7 = 0"), F.when(F.col("ord") % 14 == 0, "").otherwise(F.col("text")))
    found = found.unionByName(source("arxiv", docs.where("ord % 5 = 0"), F.col("text"))).unionByName(source("openalex_abstract", docs.where(F.length("text") > 50), F.col("text")))
    return rank.waterfall(docs, found).select("ord", "method", F.col("priority").cast("long").alias("priority"), F.length("text").cast("long").alias("n_chars"))


@query(having(RECIPES, select="""
SELECT sink, validation_status, count(*) AS n FROM (SELECT 'graph' AS sink, validation_status FROM recipes WHERE validation_status IN ('PASSED', 'CORRECTED') UNION ALL SELECT 'runs', validation_status FROM recipes) GROUP BY 1, 2"""))
def persisted_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, runs = events.split_persist(tables.recipes(spark, sf_dir))
    both = graph.withColumn("sink", F.lit("graph")).unionByName(runs.withColumn("sink", F.lit("runs")))
    return both.groupBy("sink", "validation_status").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'text_short' WHEN p_partkey % 4 = 1 THEN 'text_blank' WHEN p_size > 25 THEN 'density' END AS fault FROM part""")
def chunk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of chunks: too short before trimming, blank, or with a score out of range."""
    n = F.col("k") % 4
    said = F.when(n == 0, "too short").when(n == 1, " " * 60).otherwise(F.concat("name", F.lit(" " + "x" * 50)))
    return parts(spark, sf_dir).select("k", F.get(schemas.chunk_faults(said, F.col("size") / 25.0), 0).alias("fault"))


@query("""SELECT p_partkey AS k, p_name || ',' || p_type AS names FROM part""")
def cleaned_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.array("name", F.lit("  "), F.concat(F.lit(" "), "kind", F.lit(" ")), F.lit(""), "name", F.lit(None))
    return parts(spark, sf_dir).select("k", F.array_join(metrics.cleaned_list(given), ",").alias("names"))


UNION = [["the", "of"], ["of", "und", "der"], ["que", "the"]]


@query("SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-zA-Zµ°%]+')), ['the', 'of', 'und', 'der', 'que'])) AS hits FROM documents")
def vocabulary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of a union of lexicons in each text."""
    words = text.vocabulary_union(*UNION)
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.hits(text.tokens(F.col("text")), words).cast("long").alias("hits"))


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+'))) AS term FROM documents)
SELECT doc_id, term FROM w JOIN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+')) AS term FROM benchmark) USING (term)""".replace("\\\\", "\\"))
def term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark as a large dictionary, found in all documents."""
    words = tables.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))).alias("term"))
    return extract.term_matches(tables.table(spark, sf_dir, "documents"), "doc_id", "text", words)


PHRASES = """
phrases AS (SELECT DISTINCT unnest([w[1] || ' ' || w[2], w[1] || ' ' || w[2] || ' ' || w[3], w[2] || ' ' || w[3] || ' ' || w[4] || ' ' || w[5]]) AS term FROM (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+') AS w FROM benchmark) WHERE len(w) >= 5),
flat AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+') AS w FROM documents)),
ahead AS (SELECT doc_id, k, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS d FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
hits AS (SELECT doc_id, k - 1 AS word_start, n, term FROM (SELECT doc_id, k, unnest([2, 3, 4]) AS n, unnest([a || ' ' || b, a || ' ' || b || ' ' || c, a || ' ' || b || ' ' || c || ' ' || d]) AS term FROM ahead) JOIN phrases USING (term))"""


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two, three and four words from the beginnings of the benchmark's items."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}\p{Pc}]+"), F.lit(0))
    rows = tables.table(spark, sf_dir, "benchmark").select(w.alias("w")).where(F.size("w") >= 5)
    some = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    return rows.select(F.explode(F.array(some(1, 2), some(1, 3), some(2, 4))).alias("term"))


@query(having(PHRASES, select="SELECT doc_id, term, word_start::BIGINT AS word_start FROM hits"))
def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of the phrases in all documents."""
    found = dictionary.find_terms(tables.table(spark, sf_dir, "documents"), "doc_id", "text", phrases(spark, sf_dir), overlapping=True)
    return found.select("doc_id", "term", F.col("word_start").cast("long").alias("word_start"))


@query(having("RECURSIVE " + PHRASES.strip(), """longest AS (SELECT doc_id, word_start, max(n) AS n, arg_max(term, n) AS term FROM hits GROUP BY 1, 2),
kept AS (SELECT doc_id, word_start, n, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY word_start) AS r FROM longest) WHERE r = 1
  UNION ALL SELECT doc_id, word_start, n, term FROM (SELECT l.*, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.word_start) AS r FROM kept k JOIN longest l ON l.doc_id = k.doc_id AND l.word_start >= k.word_start + k.n) WHERE r = 1)""", select="SELECT doc_id, term, word_start::BIGINT AS word_start FROM kept"))
def longest_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the phrases that don't overlap, the leftmost and longest first."""
    found = dictionary.find_terms(tables.table(spark, sf_dir, "documents"), "doc_id", "text", phrases(spark, sf_dir))
    return found.select("doc_id", "term", F.col("word_start").cast("long").alias("word_start"))


@query("""SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN 'Hint ' || page_id END, 'my file ' || page_id) AS title FROM pages""")
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Hint "), F.col("page_id").cast("string"))).alias("hint"), F.concat(F.lit("/up/my_file-"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("path"))
    return rows.select("page_id", chunking.document_title("hint", "path").alias("title"))


@query(having(ENTITIES, select="""
SELECT 'chemical' AS note_type, replace(trim(name), ' ', '_') || '.md' AS file_name, '# ' || trim(name) || chr(10) || chr(10) || '## Appears In Reactions' || chr(10) || string_agg(DISTINCT '- [[' || recipe_id || ']] as ' || role, chr(10) ORDER BY '- [[' || recipe_id || ']] as ' || role) AS content
FROM ents GROUP BY trim(name)"""))
def chemical_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.chemical_notes(tables.entities(spark, sf_dir))


@query(having(PAPERS, select="""
SELECT ord, '# ' || title || chr(10) || chr(10) || '**DOI:** ' || coalesce(doi, 'unknown') || chr(10) || '**Year:** ' || year || chr(10) || '**Source DB:** ' || coalesce(source_db, 'unknown') || chr(10) || '**URL:** unknown' AS content FROM papers WHERE title IS NOT NULL"""))
def paper_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.papers(spark, sf_dir).where("title is not null")
    made = notes.paper_notes(rows.withColumn("title", F.concat(F.col("ord").cast("string"), F.lit("|"), "title")))
    return made.select(F.regexp_extract("content", r"^# (\d+)\|", 1).cast("long").alias("ord"), F.regexp_replace("content", r"^# \d+\|", "# ").alias("content"))


@query(having(ENTITIES, RECIPES, select="""
SELECT 'chemical' AS note_type, count(DISTINCT trim(name)) AS notes FROM ents UNION ALL SELECT 'paper', count(*) FILTER (text IS NOT NULL) FROM documents UNION ALL SELECT 'recipe', count(*) FROM recipes"""))
def note_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by type over all three kinds."""
    entities = tables.entities(spark, sf_dir)
    made = notes.recipe_notes(rules.assemble(tables.recipes(spark, sf_dir), entities, tables.conditions(spark, sf_dir)))
    made = made.unionByName(notes.chemical_notes(entities)).unionByName(notes.paper_notes(tables.papers(spark, sf_dir).where("title is not null")))
    return metrics.note_counts(made).select("note_type", "notes")


@query(having(RECIPES, select="SELECT recipe_id, validation_status, cost_usd FROM recipes WHERE recipe_id % 97 = 5"))
def stored_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recipe store is written, some ids are refused as file names, and recipes are looked up by id."""
    path = scratch_path(spark, "store")
    named = tables.recipes(spark, sf_dir).select(F.col("recipe_id").cast("string").alias("recipe_id"), "validation_status", "cost_usd")
    unsafe = named.select(F.concat(F.lit("a/"), "recipe_id").alias("recipe_id"), "validation_status", "cost_usd")
    events.write_recipes(notes.safe_ids(named.unionByName(unsafe)), path)
    wanted = named.where(F.col("recipe_id").cast("long") % 97 == 5).select("recipe_id").unionByName(unsafe.select("recipe_id"))
    return spark.read.parquet(path).join(wanted, "recipe_id", "left_semi").select(F.col("recipe_id").cast("long").alias("recipe_id"), "validation_status", "cost_usd")


#: Pages made of parts in a task.
PAGES_A_TASK = 1000


@query("""WITH p AS (SELECT p_partkey AS page_id, p_partkey % 8 AS s FROM part)
SELECT page_id, unnest(generate_series(1, least(s, 5))) AS place, 'experimental_section' AS section, 904::BIGINT AS n_words FROM p WHERE s > 0
UNION ALL SELECT page_id, unnest([1, 2, 3]), unnest(['paragraph_2', 'paragraph_4', 'paragraph_0']), unnest([503, 502, 501])::BIGINT FROM p WHERE s = 0""")
def page_chunk_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article texts with up to seven procedures, of which five count; pages without any give their three densest paragraphs."""
    s = F.col("k") % 8
    filler = F.trim(F.repeat(F.lit("w "), 900))
    procedure = lambda j: F.concat_ws("\n\n", F.concat(F.lit("Synthesis of sample "), j.cast("string")), filler)
    plain = lambda n: F.concat(F.repeat(F.lit("zinc "), n), F.trim(F.repeat(F.lit("w "), 500)))
    dull = F.concat_ws("\n\n", plain(1), F.lit("too short"), plain(3), plain(0), plain(2))
    said = F.when(s == 0, dull).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(s, F.lit(1))), procedure), "\n\n"))
    rows = parts(spark, sf_dir).select("k")
    # A part makes some 14 KB of text, so a small file of parts is dealt to many tasks before.
    rows = rows.repartition(-(-rows.count() // PAGES_A_TASK) or 1, "k")
    found = pages.page_chunks(rows.select(F.col("k").alias("page_id"), said.alias("text")), vocabulary=["zinc"])
    return found.select("page_id", F.col("place").cast("long").alias("place"), "section", F.col("n_words").cast("long").alias("n_words"))


@query("""WITH d AS (SELECT doc_id AS ord, text, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)
SELECT ord, CASE WHEN ord % 3 = 0 AND n >= 49 THEN 'Experimental' ELSE 'abstract' END AS section, CASE WHEN ord % 3 = 0 AND n >= 49 THEN 'ARXIV_HTML' ELSE 'ABSTRACT_ONLY' END AS method,
  CASE WHEN ord % 3 = 0 AND n >= 49 THEN n + 1 ELSE n END AS n_words FROM d WHERE ord % 3 = 0 AND n >= 49 OR length(text) > 50""".replace("\\\\", "\\"))
def fulltext_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document has a page with its text under a heading; where that is missing or too short the abstract counts."""
    docs = tables.table(spark, sf_dir, "documents")
    plain = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("ord"), F.concat(F.lit("<h1>Paper</h1><p>x</p><h2>Experimental</h2><p>"), plain, F.lit("</p><h2>Results</h2><p>none</p>")).alias("html"))
    found = pages.fulltext_chunks(docs.select(F.col("doc_id").alias("ord"), F.col("text").alias("abstract")), html)
    return found.select("ord", "section", "method", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("long").alias("n_words"))


@query("""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS title, CASE WHEN doc_id % 13 = 0 THEN 1800 ELSE 2000 END AS year, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE 1 END AS cites FROM documents),
f AS (SELECT doc_id, title IS NULL OR trim(title) = '' AS t, year < 1900 AS y, cites < 0 AS n FROM c)
SELECT 'rows' AS kind, count(*) AS observed, count(*) AS kept FROM f UNION ALL SELECT 'good', count(*) FILTER (NOT (t OR y OR n)), count(*) FILTER (NOT (t OR y OR n)) FROM f
UNION ALL SELECT 'title', count(*) FILTER (t), count(*) FILTER (t) FROM f UNION ALL SELECT 'year', count(*) FILTER (y), count(*) FILTER (y) FROM f UNION ALL SELECT 'citation_count', count(*) FILTER (n), count(*) FILTER (n) FROM f UNION ALL SELECT 'relevance_score', 0, 0""")
def quarantined_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with planted faults: what was counted while they were written, and what the tables hold."""
    rows = tables.papers(spark, sf_dir).select(
        "ord", F.when(F.col("ord") % 11 != 0, F.col("title")).alias("title"), F.when(F.col("ord") % 13 == 0, 1800).otherwise(2000).alias("year"), F.when(F.col("ord") % 7 == 0, -1).otherwise(1).alias("citation_count"), F.lit(None).cast("double").alias("relevance_score"),
    )
    got = quarantine.sorted_papers(rows)
    observed = spark.createDataFrame(sorted(got.counts.items()), "kind string, observed long")
    kinds = got.rejected.select(F.explode("faults").alias("kind")).unionByName(got.good.select(F.lit("good").alias("kind"))).unionByName(got.good.select("ord").union(got.rejected.select("ord")).select(F.lit("rows").alias("kind")))
    return observed.join(kinds.groupBy("kind").agg(F.count("*").alias("kept")), "kind", "left").select("kind", "observed", F.coalesce("kept", F.lit(0)).alias("kept"))
