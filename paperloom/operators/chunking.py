"""Word windows and section chunks of plain document text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import density, words

CHUNK_WORDS, OVERLAP = 1500, 150


def word_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """(id, part, name suffix, chunk): windows of `size` words that share `overlap`; short texts stay as they are."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), words(F.col(text_col)).alias("ws"))
    n, step = F.size("ws"), size - overlap
    parts = F.when(n > size, F.ceil((n - overlap) / step)).otherwise(1).cast("int")
    out = rows.select(id_col, "text", "ws", n.alias("n"), F.explode(F.sequence(F.lit(1), parts)).alias("part"))
    own = F.slice("ws", (F.col("part") - 1) * step + 1, size)
    chunk = F.when(F.col("n") > size, F.array_join(own, " ")).otherwise(F.col("text"))
    return out.select(id_col, "part", F.when(F.col("part") > 1, F.concat(F.lit("_part_"), F.col("part").cast("string"))).otherwise("").alias("suffix"), own.alias("words"), chunk.alias("chunk"))


def densest(docs: DataFrame, id_col: str, text_col: str, k: int, least: float, min_words: int = 50, split: str = r"\n{2,}", vocabulary: list[str] | None = None) -> DataFrame:
    """The k densest paragraphs of each document; equal densities in text order."""
    parts = docs.select(id_col, F.posexplode(F.split(text_col, split)).alias("paragraph", "text"))
    score = density(F.col("text"), vocabulary) if vocabulary is not None else density(F.col("text"))
    rows = parts.where(F.size(words(F.col("text"))) >= min_words).withColumn("density", score).where(F.col("density") > least)
    order = Window.partitionBy(id_col).orderBy(F.desc("density"), "paragraph")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Headings that open an experimental section, and lines that close one.
OPENING = [
    r"(?i)^#{1,4}\s*(experimental\s*(?:section|methods?|procedures?|details?)?|materials?\s+and\s+methods?|synthesis\s+(?:of\s+\w+|procedures?)?|preparation\s+of|synthetic\s+procedures?)\s*$",
    r"(?i)\*{1,2}(experimental\s*(?:section|methods?)?|materials?\s+and\s+methods?|synthesis\s+of\s+\w+)\*{1,2}",
    r"^(EXPERIMENTAL(?:\s+SECTION)?|MATERIALS\s+AND\s+METHODS|SYNTHESIS\s+OF\s+\w+|SYNTHETIC\s+PROCEDURE)\s*$",
    r"(?i)^\d+\.?\s+(experimental\s*(?:section|methods?)?|materials?\s+and\s+methods?|synthesis\s+of)\s*$",
    r"(?i)^\d+\.\d+\.?\s+(synthesis|preparation|fabrication|nanoparticle|experimental|materials?)\b",
    r"(?i)\*{2}(\d+\.\d+\.?\s+(?:synthesis|preparation|fabrication|experimental).*?)\*{2}",
]
SUBSECTION = r"^\d+\.\d+\.?\s+[A-Z]|^\*{2}\d+\.\d+\.?\s+"
HEADER = rf"^#{{1,3}}\s+\w|^\d+\.\s+[A-Z]|{SUBSECTION}"


def experimental_sections(docs: DataFrame, id_col: str, text_col: str, min_words: int = 50, openings: list[str] = OPENING, max_sections: int = 10) -> DataFrame:
    """(id, section, name, text): from an opening heading to a sub-section, or to any header more than three lines on.

    A heading only opens a section outside of one, so lines are taken in order in a task. A
    document gives its first `max_sections` sections, of these the ones with enough words.
    """
    opening, sub, header = [re.compile(p) for p in openings], re.compile(SUBSECTION), re.compile(HEADER)

    def sections(text: str) -> Iterator[tuple[str, str]]:
        name, start, part = None, 0, []
        for i, raw in enumerate(text.split("\n")):
            line = raw.strip()
            if name is not None and (sub.match(line) or header.match(line) and i > start + 3):
                yield name, "\n".join(part).strip()
                name = None
            if name is None and any(p.search(line) for p in opening):
                name, start, part = line.strip("#").strip("*").strip(), i, [line]
            elif name is not None:
                part.append(raw)
        if name is not None:
            yield name, "\n".join(part).strip()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, n, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, (n, t) in enumerate(islice(sections(text or ""), max_sections)) if len(t.split()) >= min_words]
            cols = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()))], names=[id_col, "section", "name", "text"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"`{id_col}` long, section int, name string, text string")


#: Chunks of an uploaded document at most, what its paragraphs must pass where it has no section, and what is said of it.
UPLOAD_CHUNKS, UPLOAD_DENSITY = 10, 0.1
UPLOAD = {"source_db": "user_upload", "open_access": True, "completeness": "FULL_TEXT", "method": "USER_UPLOAD"}


def uploaded_chunks(docs: DataFrame, id_col: str, text_col: str, path_col: str, hint_col: str | None = None, min_words: int = 50, vocabulary: list[str] | None = None) -> DataFrame:
    """(id, place, section, text, n_words, title, source_db, open_access, completeness, method) of uploaded documents.

    Experimental sections, long ones in windows; documents without any give their paragraphs above UPLOAD_DENSITY, cut
    likewise. Windows that are too short go, then the UPLOAD_CHUNKS densest count, equal ones in text order.
    """
    score = lambda c: density(c, vocabulary) if vocabulary is not None else density(c)

    def cut(rows: DataFrame) -> DataFrame:
        """Windows of rows (doc, k, section, text) with enough words."""
        parts = word_chunks(rows.withColumn("_row", F.struct("doc", "k", "section")), "_row", "text").select("_row.*", "part", F.concat("_row.section", "suffix").alias("named"), F.col("chunk").alias("text"))
        return parts.drop("section").withColumns({"n_words": F.size(words(F.col("text"))), "density": score(F.col("text"))}).where(F.col("n_words") >= min_words)

    found = experimental_sections(docs, id_col, text_col, min_words, max_sections=1 << 30)
    sections = cut(found.select(F.col(id_col).alias("doc"), F.col("section").alias("k"), F.col("name").alias("section"), "text"))
    rest = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(sections.select("doc").distinct(), "doc", "left_anti")
    paragraphs = rest.select("doc", F.posexplode(F.split("text", r"\n{2,}")).alias("k", "text")).select("doc", "k", F.concat(F.lit("paragraph_"), F.col("k").cast("string")).alias("section"), "text")
    rows = sections.unionByName(cut(paragraphs).where(F.col("density") > UPLOAD_DENSITY))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("density"), "k", "part"))).where(F.col("place") <= UPLOAD_CHUNKS)
    titles = docs.select(F.col(id_col).cast("long").alias("doc"), document_title(hint_col, path_col).alias("title"))
    return rows.join(titles, "doc").select(F.col("doc").alias(id_col), "place", F.col("named").alias("section"), "text", "n_words", "title", *[F.lit(v).alias(c) for c, v in UPLOAD.items()])


def document_title(hint: str | None, path: str):
    """The hint, or the file's name with spaces for _ and -."""
    stem = F.regexp_replace(F.regexp_extract(F.col(path), r"([^/]+?)(?:\.[^./]+)?$", 1), "[_-]", " ")
    return F.coalesce(F.col(hint), stem) if hint else stem
