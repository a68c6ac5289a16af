"""Dumped payloads of four literature services as one table of papers, and their full-text sections."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paperloom.functions.text import abstract_from_index, experimental, normalize_doi
from paperloom.schemas import PAPERS
from paperloom.session import scratch_path

#: Words of the first service's own experimental flag, and titles of methods sections.
PUBMED_SIGNALS = ("synthesis", "prepared", "dissolved", "stirred", "heated", "refluxed", "filtered", "experimental", "procedure", "temperature", "reaction", "mmol")
SECTION_TITLES = ("experimental", "experimental section", "experimental methods", "materials and methods", "methods", "synthesis", "preparation", "experimental details", "synthetic procedures")
SOURCES = ("pubmed", "arxiv", "openalex", "semantic_scholar")


def shaped(rows: DataFrame, source: str) -> DataFrame:
    """The papers table's columns in order, those that a source lacks as null, and the fault; papers have titles."""
    rows = rows.withColumn("source_db", F.lit(source))
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(f"{PAPERS}, {FAULT}") if f.name != "ord"]
    return rows.select(*columns).where((F.coalesce("title", F.lit("")) != "") | F.col("error").isNotNull())


#: What a record of an XML service gives.
XML_FIELDS = {
    "pubmed": ("PubmedArticle", "title string, doi string, pubmed_id string, pubmed_central_id string, authors array<string>, year int, abstract string"),
    "arxiv": ("entry", "title string, doi string, arxiv_id string, authors array<string>, year int, abstract string"),
}
#: Of a row that can't be read: why, its text, and the file it stands in.
FAULT = "error string, record string, file string"
PREFIX = re.compile(r"(?:</?|\s)([A-Za-z_][\w.-]*):[A-Za-z_]")


def element(text: str, tag: str) -> ElementTree.Element | None:
    """The element that `text`, cut off before its end tag, holds, without namespaces; None if it holds none."""
    opened = re.search(rf"<(?:[\w.-]+:)?{tag}(?:\s[^<>]*)?(?<!/)>", text)
    if opened is None:
        return None
    prefixes = "".join(f' xmlns:{p}="{p}"' for p in sorted(set(PREFIX.findall(text))) if p not in ("xml", "xmlns"))
    found = ElementTree.fromstring(f"<records{prefixes}>{text[opened.start():]}</{tag}></records>")
    if len(found) != 1:
        raise ElementTree.ParseError("more than one element")
    for e in found.iter():
        e.tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    return found[0]


def said(e: ElementTree.Element | None) -> str | None:
    return (" ".join("".join(e.itertext()).split()) or None) if e is not None else None


def year_of(text: str | None) -> int | None:
    found = re.match(r"\d{4}", text or "", re.ASCII)
    return int(found[0]) if found else None


def pubmed_fields(record: ElementTree.Element) -> tuple:
    ids = {e.get("IdType"): said(e) for e in record.iter("ArticleId")}  # the last of a type
    people = (" ".join(filter(None, (said(next(a.iter(part), None)) for part in ("ForeName", "LastName")))) for a in record.iter("Author"))
    parts = filter(None, map(said, record.iter("AbstractText")))
    year = next((y for d in record.iter("PubDate") for y in d.findall("Year")), None)
    return said(next(record.iter("ArticleTitle"), None)), ids.get("doi"), said(next(record.iter("PMID"), None)), ids.get("pmc"), [p for p in people if p], year_of(said(year)), " ".join(parts) or None


def arxiv_fields(record: ElementTree.Element) -> tuple:
    own = lambda tag: " ".join((record.findtext(tag) or "").split()) or None  # noqa: E731  not of nested tags
    link = next((e.get("href") for e in record.findall("link") if e.get("title") == "doi"), None)
    known = re.search(r"arxiv\.org/abs/(.+?)(?:v\d+)?$", own("id") or "")
    people = ((n.text or "").strip() for n in record.findall("author/name"))
    return own("title"), link or None, known[1] if known else None, [p for p in people if p], year_of(own("published")), own("summary")


def xml_records(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A row for each element: its fields, or why it can't be read.

    The end tag separates records, so files are split between tasks and a broken record costs no other one.
    Each record is parsed once.
    """
    tag, fields = XML_FIELDS[source]
    schema = StructType.fromDDL(f"{fields}, {FAULT}")
    read = {"pubmed": pubmed_fields, "arxiv": arxiv_fields}[source]
    nothing = (None,) * (len(schema) - 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = element(text, tag)
                    if found is not None:
                        rows.append((*read(found), None, None, file))
                except ElementTree.ParseError as exc:
                    rows.append((*nothing, str(exc), text, file))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=to_arrow_schema(schema))

    return spark.read.text(path, lineSep=f"</{tag}>").select("value", "_metadata.file_path").mapInArrow(run, schema)


def pubmed_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    page = F.when(F.col("pubmed_central_id").isNotNull(), F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), "pubmed_central_id", F.lit("/"))).otherwise(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pubmed_id", F.lit("/")))
    rows = xml_records(spark, path, "pubmed").withColumns({"open_access": F.col("pubmed_central_id").isNotNull(), "open_access_url": page, "has_experimental_section": experimental(F.coalesce("abstract", F.lit("")), PUBMED_SIGNALS)})
    return shaped(rows, "pubmed")


def arxiv_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    rows = xml_records(spark, path, "arxiv").withColumns({"open_access": F.lit(True), "open_access_url": F.concat(F.lit("https://ar5iv.org/abs/"), "arxiv_id"), "has_experimental_section": experimental(F.coalesce("abstract", F.lit("")))})
    return shaped(rows, "arxiv")


OPENALEX = (
    "_corrupt_record string, results array<struct<id:string,title:string,display_name:string,doi:string,publication_year:int,cited_by_count:int,open_access:struct<is_oa:boolean,oa_url:string>,"
    "authorships:array<struct<author:struct<display_name:string>>>,abstract_inverted_index:map<string,array<int>>>>"
)
SCHOLAR = (
    "_corrupt_record string, data array<struct<paperId:string,title:string,abstract:string,url:string,year:int,citationCount:int,isOpenAccess:boolean,openAccessPdf:struct<url:string>,"
    "externalIds:struct<DOI:string,ArXiv:string,PubMed:string>,authors:array<struct<name:string>>>>"
)


def responses(spark: SparkSession, path: str, schema: str, data: str, lines: bool) -> DataFrame:
    """`r`, the records of a JSON service's responses, one a file or one a line; a response that can't be read is a fault."""
    rows = spark.read.schema(schema).json(path, multiLine=not lines).select("*", F.col("_metadata.file_path").alias("file"))
    fault = F.col("_corrupt_record").isNotNull() & F.col(data).isNull()
    rows = rows.select(F.explode_outer(data).alias("r"), F.when(fault, "no JSON").alias("error"), F.when(fault, F.col("_corrupt_record")).alias("record"), "file")
    return rows.where("r is not null or error is not null")


def openalex_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    rows = responses(spark, path, OPENALEX, "results", lines).select("r.*", "error", "record", "file").select(
        F.coalesce(F.nullif("title", F.lit("")), "display_name").alias("title"), "doi", F.col("id").alias("openalex_id"), F.col("publication_year").alias("year"),
        F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n, F.lit("")) != "").alias("authors"), F.nullif(abstract_from_index(F.col("abstract_inverted_index")), F.lit("")).alias("abstract"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("open_access"), F.coalesce("open_access.oa_url", "id").alias("open_access_url"), F.coalesce("cited_by_count", F.lit(0)).alias("citation_count"), "error", "record", "file",
    )
    return shaped(rows.withColumn("has_experimental_section", experimental(F.coalesce("abstract", F.lit("")))), "openalex")


def scholar_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    page = F.coalesce("openAccessPdf.url", "url", F.concat(F.lit("https://www.semanticscholar.org/paper/"), "paperId"))
    rows = responses(spark, path, SCHOLAR, "data", lines).select("r.*", "error", "record", "file").select(
        "title", F.nullif(F.lower("externalIds.DOI"), F.lit("")).alias("doi"), F.col("externalIds.ArXiv").alias("arxiv_id"), F.col("externalIds.PubMed").alias("pubmed_id"), F.col("paperId").alias("semantic_scholar_id"),
        "year", F.nullif("abstract", F.lit("")).alias("abstract"), F.filter(F.transform("authors", lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "").alias("authors"),
        F.coalesce("isOpenAccess", F.lit(False)).alias("open_access"), page.alias("open_access_url"), F.coalesce("citationCount", F.lit(0)).alias("citation_count"), "error", "record", "file",
    )
    return shaped(rows.withColumn("has_experimental_section", experimental(F.coalesce("abstract", F.lit("")))), "semantic_scholar")


ROWS = {"pubmed": pubmed_rows, "arxiv": arxiv_rows, "openalex": openalex_rows, "semantic_scholar": scholar_rows}


def source_rows(spark: SparkSession, name: str, path: str, lines: bool = False) -> DataFrame:
    """Papers of a source and its faults; a dump that isn't there is one fault."""
    try:
        return ROWS[name](spark, path, lines=lines)
    except AnalysisException as exc:
        fault = spark.createDataFrame([(str(exc).split("\n")[0], None, path)], FAULT)
        return shaped(fault, name)


def papers_of(rows: DataFrame) -> DataFrame:
    return rows.where("error is null").drop("error", "record", "file")


def pubmed(spark: SparkSession, path: str) -> DataFrame:
    return papers_of(pubmed_rows(spark, path))


def arxiv(spark: SparkSession, path: str) -> DataFrame:
    return papers_of(arxiv_rows(spark, path))


def openalex(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return papers_of(openalex_rows(spark, path, lines))


def semantic_scholar(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return papers_of(scholar_rows(spark, path, lines))


class Landed(NamedTuple):
    """What one pass over the dumps gave: papers, faults, and how many there are of either, by source."""

    papers: DataFrame
    faults: DataFrame
    counts: dict[str, tuple[int, int]]


def land(spark: SparkSession, paths: dict[str, str], lines: bool = False, folder: str | None = None) -> Landed:
    """All sources in order with `source_ord`, DOIs normalised; what can't be read is set aside.

    Each dump is read and parsed once: papers and faults are written to `folder` apart, and counted on the way.
    A source that fails, or a part of it, gives faults; the others go on.
    """
    rows = None
    for k, name in enumerate(SOURCES):
        if name in paths:
            one = source_rows(spark, name, paths[name], lines).withColumns({"source_ord": F.lit(k), "doi": normalize_doi(F.col("doi"))})
            rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        rows = shaped(spark.createDataFrame([], FAULT), "").withColumn("source_ord", F.lit(0))
    rows = rows.withColumn("fault", F.col("error").isNotNull())
    folder = folder or scratch_path(spark, "landed")
    counts, names = Observation(), [n for n in SOURCES if n in paths]
    seen = [F.count_if((F.col("source_db") == n) & (F.col("fault") == bad)).alias(f"{n}:{bad}") for n in names for bad in (False, True)]
    (rows.observe(counts, *seen) if seen else rows).write.partitionBy("fault").parquet(folder)
    back = spark.read.schema(rows.schema).parquet(folder)
    faults = back.where("fault").select("source_db", "source_ord", "file", "error", "record")
    return Landed(back.where("not fault").drop("fault", "error", "record", "file"), faults, {n: (counts.get[f"{n}:False"], counts.get[f"{n}:True"]) for n in names} if seen else {})


def source_stats(papers: DataFrame) -> DataFrame:
    return papers.groupBy("source_db").agg(F.count("*").alias("papers_n"), F.count_if(F.col("open_access")).alias("open_n"))


def pmc_sections(rows: DataFrame, key_col: str, xml_col: str, min_words: int = 50) -> DataFrame:
    """(key, section, text) of methods sections; nested sections each give their own, so regular expressions won't do."""

    def sections(xml: str) -> Iterator[tuple[str, str]]:
        try:
            root = ElementTree.fromstring(xml)
        except ElementTree.ParseError:
            return
        for sec in root.iter("sec"):
            kind = (sec.get("sec-type") or "").lower()
            head = sec.find("title")
            title = " ".join("".join(head.itertext()).split()) if head is not None else ""
            low = title.lower()
            if "method" in kind or "material" in kind or low in SECTION_TITLES or "synthesis" in low or "experimental" in low:
                text = " ".join("".join(sec.itertext()).split())
                if len(text.split()) >= min_words:
                    yield title or "methods", text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(k, *s) for k, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in sections(xml or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*got) if got else ((),) * 3)], names=["key", "section", "text"])

    return rows.select(F.col(key_col).cast("string"), xml_col).mapInArrow(run, "key string, section string, text string")


def abstract_chunks(papers: DataFrame, least: int = 50) -> DataFrame:
    """A chunk of each abstract that is longer than `least` characters."""
    return papers.where(F.length("abstract") > least).select("ord", F.lit("abstract").alias("section"), F.lit("ABSTRACT_ONLY").alias("method"), F.col("abstract").alias("text"))
