"""Papers, chunks, text gates, extraction, pages and plans. The corpus holds no chemistry, so lexicons are made of its own words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import chem, model_json, text, urls
from paperloom.operators import chunking, dedup, extract, rank
from paperloom.plans.registry import PAPERS, having, query
from paperloom.sources import dumps, pages, plans
from paperloom.sources import surrogates as tables

#: Words of the corpus in the places of the default lexicons.
UNITS, VERBS, NOUNS, OFF, VOCABULARY = ["the", "und"], ["of", "les"], ["and", "que", "der"], ["scum", "idiot", "clown", "pathetic"], ["with", "para"]
LEXICONS = {"english": ["the", "of", "and", "that"], "french": ["les", "des", "est", "une"], "german": ["und", "der", "die", "nicht"], "spanish": ["los", "que", "por", "una"]}
#: Letters outside ASCII become _, a word character that no pattern names: RE2 knows word borders of ASCII only.
PLAIN = r"regexp_replace(text, '[^\x00-\x7F]', '_', 'g')"
WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
TOKENS = r"list_distinct(regexp_extract_all(lower(text), '[a-zA-Zµ°%]+'))"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def hits(words: list[str]) -> str:
    return f"len(list_intersect(tok, {sql_list(words)}))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents")


GATED = f"""
g AS (SELECT doc_id, {TOKENS} AS tok, len({WORDS}) AS n, len(regexp_extract_all({PLAIN}, '\\b[A-Z][a-z]?\\d*(?:[A-Z][a-z]?\\d*)+\\b')) AS formulas FROM documents),
s AS (SELECT *, CASE WHEN n >= 20 THEN (2 * {hits(UNITS)} + 2 * {hits(VERBS)} + {hits(NOUNS)} + 1.5::DOUBLE * formulas) / n * 100 END AS score FROM g)"""


@query(having(GATED, select=f"""
SELECT doc_id, round(score, 6) AS score, coalesce(({hits(VOCABULARY)} > 0 OR {hits(UNITS)} > 0 OR formulas > 0 OR ({hits(NOUNS)} >= 2 AND {hits(OFF)} = 0)) AND NOT ({hits(OFF)} > 3 AND score < 1.0) AND score >= 5, false) AS is_match FROM s"""))
def chem_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.round(text.gate_score(t, UNITS, VERBS, NOUNS), 6).alias("score"), text.gate(t, 5.0, VOCABULARY, UNITS, VERBS, NOUNS, OFF).alias("is_match"))


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS tok FROM documents), s AS (SELECT doc_id, {", ".join(f"{hits(lex)} AS {name}" for name, lex in LEXICONS.items())} FROM t)
SELECT doc_id, CASE greatest({", ".join(LEXICONS)}) WHEN 0 THEN 'unknown' {" ".join(f"WHEN {name} THEN '{name}'" for name in LEXICONS)} END AS domain FROM s""")
def domain_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.domain(F.col("text"), LEXICONS).alias("domain"))


DENSE = r"""
(len(regexp_extract_all(plain, '\b[A-Z][a-z]?\d*(?:[A-Z][a-z]?\d*)*\b')) + len(regexp_extract_all(plain, '(?i)\b\d+\.?\d*\s*(?:mg|g|kg|mL|L|mmol|mol|M|wt%|vol%)\b'))
 + len(regexp_extract_all(plain, '(?i)\b(?:dissolved|stirred|heated|refluxed|filtered|washed|dried|added|mixed)\b')) + len(regexp_extract_all(plain, '(?i)\b(?:solution|mixture|suspension|precipitate|catalyst|solvent|reactant)\b'))) * 0.3::DOUBLE"""


@query(rf"""WITH p AS (SELECT doc_id, unnest(range(len(ps))) AS paragraph, unnest(ps) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)),
d AS (SELECT *, {PLAIN} AS plain, len({WORDS}) AS n FROM p), w AS (SELECT *, regexp_extract_all(plain, '\b\w+\b') AS ws FROM d WHERE n >= 20),
s AS (SELECT doc_id, paragraph, least(({DENSE} + 0.5::DOUBLE * len(list_filter(ws, lambda x: lower(x) IN ('with', 'para')))) / len(ws) * 100, 1.0::DOUBLE) AS density FROM w)
SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph, round(density, 6) AS density FROM s WHERE density > 0.1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY density DESC, paragraph) <= 10""")
def density_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten densest lines of each document; the corpus has no blank lines, so lines stand for paragraphs."""
    out = chunking.densest(documents(spark, sf_dir), "doc_id", "text", 10, 0.1, 20, "\n", VOCABULARY)
    return out.select("doc_id", "paragraph", F.round("density", 6).alias("density"))


@query("SELECT doc_id, contains(lower(text), 'the of') OR contains(lower(text), 'de la') OR contains(lower(text), 'in der') AS experimental FROM documents")
def experimental_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.experimental(F.col("text"), ("the of", "de la", "in der")).alias("experimental"))


@query(r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(plain, '(?i)\bthe\b') THEN 'The:SOLVENT' END, CASE WHEN regexp_matches(plain, '(?i)\bund\b') THEN 'Und:SOLVENT' END,
  nullif(regexp_extract(plain, '(?i)\b(of the)\b', 1), '') || ':REACTANT', nullif(regexp_extract(plain, '(?i)\b(and)\b', 1), '') || ':PRODUCT'], lambda x: x IS NOT NULL), ',') AS entities
FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS plain FROM documents)""")
def dictionary_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.dictionary_entities(F.col("text"), ("the", "und"), (("of the", "REACTANT"), ("and", "PRODUCT")))
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.transform(found, lambda e: F.concat_ws(":", e["name"], e["role"])), ",").alias("entities"))


@query("""WITH t AS (SELECT p_partkey AS id, p_name || ' (' || p_size || ' g, ' || p_retailprice || ' mmol) stirred at ' || p_size || '°C for ' || p_size || ' min under nitrogen, ' || p_size || ' bar' AS text, p_size AS s, p_retailprice AS r FROM part)
SELECT id, s::DOUBLE AS quantity, r AS moles FROM t""")
def align_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedure texts made of parts; amounts behind the part's name go to their slots."""
    rows = procedures(spark, sf_dir)
    got = chem.aligned(chem.window_after(F.col("text"), F.col("name")))
    return rows.select("id", got["quantity"]["value"].alias("quantity"), got["moles"]["value"].alias("moles"))


def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    said = F.concat("p_name", F.lit(" ("), size, F.lit(" g, "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit(" mmol) stirred at "), size, F.lit("°C for "), size, F.lit(" min under nitrogen, "), size, F.lit(" bar"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), said.alias("text"))


@query("SELECT p_partkey AS id, p_size::DOUBLE AS temperature, round(p_size / 60.0::DOUBLE, 6) AS duration, 'nitrogen' AS atmosphere, NULL::VARCHAR AS technique, round(p_size * 0.986923::DOUBLE, 6) AS pressure FROM part")
def extract_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = extract.conditions(F.col("text"))
    return procedures(spark, sf_dir).select("id", c["temperature_celsius"].alias("temperature"), F.round(c["duration_hours"], 6).alias("duration"), c["atmosphere"].alias("atmosphere"), c["technique"].alias("technique"), F.round(c["pressure_atm"], 6).alias("pressure"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS value, CASE l_linenumber % 3 WHEN 0 THEN 'mL' WHEN 1 THEN 'mM' END AS unit FROM lineitem WHERE l_linenumber % 3 <> 2 UNION ALL SELECT l_orderkey, l_linenumber, NULL, NULL FROM lineitem WHERE l_linenumber % 3 = 2")
def parse_quantity_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written as texts such as `3.0 ML`, `3.0mm` or `3.0 bananas` and read back."""
    k = F.col("l_linenumber") % 3
    said = F.concat(F.col("l_quantity").cast("string"), F.when(k == 0, " ML").when(k == 1, "mm").otherwise(" bananas"))
    q = chem.quantity(said)
    return tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q["value"].alias("value"), q["unit"].alias("unit"))


@query("SELECT r_name, CASE r_regionkey WHEN 0 THEN 'mL' WHEN 1 THEN 'M' WHEN 2 THEN 'µg' WHEN 3 THEN 'wt%' ELSE r_name END AS unit, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def unit_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = tables.table(spark, sf_dir, "nation"), tables.table(spark, sf_dir, "region")
    k = F.col("r_regionkey")
    said = F.when(k == 0, "ML").when(k == 1, "m").when(k == 2, "UG").when(k == 3, "WT%").otherwise(F.col("r_name"))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("r_name", chem.unit(said).alias("unit"), "n_name")


@query(f"SELECT doc_id, array_to_string({WORDS}, ' ') AS abstract FROM documents")
def abstract_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are turned into inverted indexes, word to positions, and back."""
    index = documents(spark, sf_dir).select("doc_id", text.inverted_index(text.words(F.col("text"))).alias("index"))
    return index.select("doc_id", text.abstract_from_index(F.col("index")).alias("abstract"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 1 + event_id % 3 AS step FROM events")
def model_json_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as model outputs: as they are, in a fence with talk around, or cut off before the end."""
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise(F.regexp_replace("props", r"\}$", ","))
    rows = tables.table(spark, sf_dir, "events").select("event_id", said.alias("raw"))
    rows = rows.withColumn("raw", F.when(k == 2, F.regexp_replace("raw", ",$", "")).otherwise(F.col("raw")))
    out = model_json.parsed(rows)
    return out.select("event_id", F.get_json_object("json", "$.k").cast("int").alias("k"), F.col("step").cast("long").alias("step"))


@query(having(PAPERS, select=r"""SELECT ord, trim(regexp_replace(regexp_replace(lower(title), '[!-/:-@\[-`{-~]', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM papers"""))
def title_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.papers(spark, sf_dir).select("ord", text.normalize_title(F.col("title")).alias("title"))


@query(having(PAPERS, select="SELECT ord, coalesce('doi:' || doi, 'title:' || substr(md5(lower(trim(title))), 1, 12)) AS key FROM papers"))
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.papers(spark, sf_dir).select("ord", text.dedup_key(F.col("doi"), F.col("title")).alias("key"))


@query("SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR) || '::' || lower(trim(lang))), 1, 16) AS chunk_id FROM documents")
def chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.chunk_id(F.col("doc_id").cast("string"), F.col("lang")).alias("chunk_id"))


@query(having(PAPERS, select="""
SELECT doi, count(*) AS n_merged, arg_min(title, ord) AS title, min(ord) AS first_ord, string_agg(DISTINCT source_db, '+' ORDER BY source_db) AS sources FROM papers WHERE doi IS NOT NULL GROUP BY 1"""))
def exact_dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a text share a DOI, so all their fields but the source are equal and the first one stays richest."""
    out = dedup.exact_dedup(tables.papers(spark, sf_dir))
    sources = F.array_join(F.array_sort(F.array_distinct(F.split("source_db", r"\+"))), "+")
    return out.select("doi", F.col("n_merged").cast("long").alias("n_merged"), "title", F.col("ord").alias("first_ord"), sources.alias("sources"))


@query()
def fuzzy_title_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-sensitive leaders of similar titles; tested against taking papers one by one."""
    return dedup.fuzzy_leaders(tables.papers(spark, sf_dir).select("ord", "title", "doi", "source_db", "citation_count", "year", "abstract"))


@query(having(PAPERS, select="""
, s AS (SELECT ord, CASE WHEN has_experimental_section THEN 0.30 ELSE 0 END::DOUBLE + CASE WHEN open_access THEN 0.20 ELSE 0 END::DOUBLE + least(log10(citation_count + 1) / 5.0::DOUBLE, 0.20::DOUBLE)
  + CASE WHEN 2024 - year <= 2 THEN 0.15 WHEN 2024 - year <= 5 THEN 0.10 WHEN 2024 - year <= 10 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN contains(lower(title), 'the') THEN 0.15 WHEN contains(lower(title), 'les') THEN 0.08 ELSE 0 END::DOUBLE AS score FROM papers)
SELECT ord, round(least(score, 1.0::DOUBLE), 6) AS relevance_score FROM s ORDER BY least(score, 1.0::DOUBLE) DESC, ord LIMIT 15"""))
def rank_papers_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rank.top_papers(tables.papers(spark, sf_dir), "the", ["les"], 2024)
    return out.select("ord", F.round("relevance_score", 6).alias("relevance_score"))


@query("""WITH c AS (SELECT doc_id AS ord, CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN 2 WHEN length(text) > 50 THEN 20 END AS priority FROM documents)
SELECT ord, CASE priority WHEN 1 THEN 'pmc' WHEN 2 THEN 'arxiv' ELSE 'openalex_abstract' END AS method FROM c WHERE priority IS NOT NULL""")
def acquisition_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = {"pubmed_central_id": F.when(F.col("ord") % 7 == 0, "PMC1"), "arxiv_id": F.when(F.col("ord") % 5 == 0, "1"), "semantic_scholar_id": F.lit("s")}
    return rank.acquisition(tables.papers(spark, sf_dir).withColumns(ids))


@query("SELECT doc_id, source AS paper, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 3")
def topk_chunks_per_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.col("source").alias("paper"), F.col("doc_id").alias("chunk_ord"))
    return rank.first_chunks(rows, 3).select("doc_id", "paper", F.col("rank").cast("long").alias("rank"))


@query("SELECT source AS source_db, count(*) AS papers_n, count(*) FILTER (doc_id % 2 = 0) AS open_n FROM documents GROUP BY 1")
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dumps.source_stats(tables.papers(spark, sf_dir))


@query("SELECT doc_id AS ord, 'abstract' AS section, md5(text) AS digest FROM documents WHERE length(text) > 50")
def abstract_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dumps.abstract_chunks(tables.papers(spark, sf_dir)).select("ord", "section", F.md5("text").alias("digest"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), p AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(CASE WHEN len(ws) > 1500 THEN CAST(ceil((len(ws) - 150) / 1350.0) AS BIGINT) ELSE 1 END)) AS k FROM w)
SELECT doc_id, k + 1 AS part, least(1500, n - k * 1350) AS n_words, ws[k * 1350 + 1] AS first_word, ws[least(k * 1350 + 1500, n)] AS last_word FROM p""")
def word_chunks_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.word_chunks(documents(spark, sf_dir), "doc_id", "text")
    return out.select("doc_id", F.col("part").cast("long").alias("part"), F.size("words").cast("long").alias("n_words"), F.get("words", 0).alias("first_word"), F.get("words", F.size("words") - 1).alias("last_word"))


@query(f"SELECT doc_id, greatest(1, CAST(floor(len({WORDS}) * 1.3::DOUBLE) AS INTEGER)) AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.token_estimate(F.col("text"), F.lit("")).alias("tokens"))


@query()
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.articles(tables.table(spark, sf_dir, "pages"))


@query()
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_sections(pages.articles(tables.table(spark, sf_dir, "pages")), vocabulary=VOCABULARY, signals=("the ", "der ", "les "), measure=re.compile(r"\w"), verb=re.compile(r"(?i)\b(?:of|und|que)\b"))


@query()
def headed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.headed_sections(tables.table(spark, sf_dir, "pages"), pattern=re.compile(r"(?i)\b(?:the|of|der|les|la)\b"))


STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches({STRIPPED.format("x")}, '^(?:The|Der|Les|La)(?:[^\p{{L}}\p{{N}}_]|$)')), true) AS i FROM l),
s AS (SELECT doc_id, {STRIPPED.format("ls[i]")} AS head, {STRIPPED.format("array_to_string(list_prepend(" + STRIPPED.format("ls[i]") + ", ls[i + 1:]), chr(10))")} AS text FROM f WHERE i > 0)
SELECT doc_id, 0::INTEGER AS section, trim(trim(trim(head, '#'), '*')) AS name, text FROM s WHERE len({WORDS}) >= 50""")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents hold no closing headings, so the SQL needs the first opening line only; handmade ones are tested apart."""
    return chunking.experimental_sections(documents(spark, sf_dir), "doc_id", "text", openings=[r"^(?:The|Der|Les|La)\b"])


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS domain, CASE WHEN contains(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), 'example.com') THEN 'Example Press' END AS publisher,
  contains(lower(url), 'login') OR contains(lower(substr(html, 1, 5000)), 'purchase access') AS by_response FROM pages""")
def paywall_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "pages")
    return rows.select("page_id", urls.domain(F.col("url")).alias("domain"), urls.publisher(F.col("url"), {"example.com": "Example Press"}).alias("publisher"), urls.paywalled_response(F.col("url"), F.col("html")).alias("by_response"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://ar5iv.org/abs/2101.' || page_id ELSE url END AS url FROM pages""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "pages").withColumn("url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://arxiv.org/pdf/2101."), F.col("page_id").cast("string"), F.lit("v2.pdf"))).otherwise(F.col("url")))
    return rows.select("page_id", urls.normalize(F.col("url")).alias("url"))


@query(r"""WITH t AS (SELECT item_id, trim(text) AS text, array_to_string(list_filter(string_split_regex(lower(trim(text)), '\s+'), lambda x: x <> '' AND x NOT IN ('synthesis', 'of', 'how', 'to', 'make', 'prepare', 'synthesize', 'show', 'me', 'find', 'routes', 'for')), ' ') AS target FROM benchmark)
SELECT item_id, source, coalesce(nullif(target, ''), text) AS target, coalesce(nullif(target, ''), text) || ' synthesis experimental methods' AS query FROM t CROSS JOIN (VALUES ('arxiv'), ('openalex'), ('pubmed'), ('semantic_scholar')) s(source)""")
def search_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items stand for raw questions."""
    return plans.search_plans(tables.table(spark, sf_dir, "benchmark"), dumps.SOURCES, "item_id", "text")
