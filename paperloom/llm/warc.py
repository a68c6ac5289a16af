"""WARC archives: written as text files with records as lines, read back by boundary chains.

Writing: a record is one string, its line separator is the blank lines that end a record,
so Spark's text writer makes archives on any file system, each compressed by gzip. Payloads
are not shuffled: repeated digests are found in narrow rows and sent to the pages, or, above
`broadcast_rows` of them, met by a join.

Reading: Spark's text reader takes the magic as its separator and splits archives into
blocks (a compressed archive is one). Each row between two magics is a *candidate*: its
offset in the file is a running sum of lengths, and its header's length gives the offset of
its successor. Pointer jumping from offset 0, over one narrow table of links, doubles the
proven part of each chain in every round. Candidates that no chain reaches are magic inside
payloads, and go back into the payload they were cut from. Only then are texts read again;
blocks that have moved in between, as they can with archives that aren't compressed, fail
the job instead of giving a wrong digest.

Defined results: null html is an empty payload; null or odd urls lose their control
characters; of equal payloads of `min_dedup` bytes or more that with the smallest page_id
(null last) is the response, with its repeated rows; a null page_id stays null; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import discard, materialize, scratch_path

#: Fixed values of the format.
MAGIC, CRLF, END = "WARC/1.0\r\n", "\r\n", "\r\n\r\n"
#: Repeated digests (about 100 bytes each) up to which they are sent to all tasks, and parts of a digest's pages beyond.
BROADCAST_ROWS, SALTS = 300_000, 64


def with_targets(pages: DataFrame, min_dedup: int, id_col: str, html_col: str, url_col: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page, url, html, bytes, digest and the page that a revisit refers to (null: response)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha2(html, 256).alias("digest"))
    # Only digests seen more than once meet the rows; the sums are made before the shuffle.
    firsts = rows.where(F.col("bytes") >= min_dedup).groupBy(F.unhex("digest").alias("key")).agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    firsts, rows = materialize(firsts), rows.withColumn("key", F.unhex("digest"))
    if firsts.count() <= broadcast_rows:
        rows = rows.join(F.broadcast(firsts), "key", "left")
    else:  # a digest may have very many pages, so its pages are dealt to several tasks
        firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page", "url"), F.lit(SALTS)).cast("int")).join(firsts, ["key", "salt"], "left")
    return rows.withColumn("target", F.when(F.col("page").isNull() | (F.col("page") != F.col("first")), F.col("first")))


def record(rows: DataFrame) -> DataFrame:
    """One string per row: header and payload, without the blank lines that end it."""
    revisit = F.col("target").isNotNull()
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(name(F.col("page")), F.lit("<urn:page:>"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"\p{Cntrl}", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.concat(F.lit("WARC-Refers-To: "), name(F.col("target"))),  # null, so left out, for responses
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    return rows.select(F.concat(F.lit(MAGIC), F.concat_ws(CRLF, *lines), F.lit(END), payload).alias("value"))


def write(
    pages: DataFrame, path: str, min_dedup: int = 100, records_per_file: int = 1024, id_col: str = "page_id", html_col: str = "html", url_col: str = "url",
    broadcast_rows: int = BROADCAST_ROWS, compression: str = "gzip",
) -> None:
    """Write one record per row under `path`."""
    out = record(with_targets(pages, min_dedup, id_col, html_col, url_col, broadcast_rows))
    out.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


HEADER = "file string, block long, k long, off long, size long, next long, page long, type string, refers long, bytes long, digest string, length long, whole boolean, mark string"
FIELDS = ("warc-type", "warc-record-id", "warc-refers-to", "warc-payload-digest", "warc-payload-length", "content-length")


def fields(head: str) -> dict[str, str]:
    got = {}
    for line in head.split(CRLF):
        name, sep, value = line.partition(":")
        if sep and name.lower() in FIELDS:
            got.setdefault(name.lower(), value.strip())
    return got


def number(text: str | None) -> int | None:
    text = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.isascii() and text.removeprefix("-").isdigit() else None


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every row between two magics with its place in its block and, as far as its header tells, its successor."""
    rows = spark.read.option("lineSep", MAGIC).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, off, k = None, 0, 0
        for batch in batches:
            out = []
            for text, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != at:
                    at, off, k = (file, block), 0, 0
                data = text.encode("utf-8")
                size = len(data) + len(MAGIC)
                head, sep, _ = text.partition(END)
                got = fields(head) if sep else {}
                n = number(got.get("content-length"))
                row = {"file": file, "block": block, "k": k, "off": off, "size": size, "whole": False}
                if n is not None and n >= 0:
                    start = len(head.encode("utf-8")) + len(END)
                    body = data[start : start + n]
                    row |= {"next": off + start + n + len(END), "page": number(got.get("warc-record-id")), "type": got.get("warc-type"), "refers": number(got.get("warc-refers-to")), "length": n}
                    row |= {"whole": len(data) >= start + n, "bytes": number(got.get("warc-payload-length")), "digest": got.get("warc-payload-digest", "").removeprefix("sha256:"), "mark": sha256(body).hexdigest()}
                out.append(row)
                off, k = off + size, k + 1
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return rows.mapInArrow(run, HEADER)


SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in HEADER.split(", "))])


def with_bases(found: DataFrame) -> DataFrame:
    """One row per block: file, block, fid (a number of the file) and base, what the blocks ahead of it add up to."""
    sums = found.groupBy("file", "block").agg(F.sum("size").alias("n")).withColumn("k", F.monotonically_increasing_id())
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(sums.select("file", "block", F.min("k").over(Window.partitionBy("file")).alias("fid"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")))


def placed(found: DataFrame, bases: DataFrame) -> DataFrame:
    """Adds the file's number and absolute offsets: what a block's rows add up to moves the blocks behind it."""
    # A row starts behind its magic; the row before a file's first magic is no record and would start below 0.
    moved = found.join(bases, ["file", "block"])
    return moved.withColumn("start", F.col("base") + F.col("off") - len(MAGIC)).withColumn("next", F.col("base") + F.col("next")).where("start >= 0")


def reachable(links: DataFrame) -> DataFrame:
    """(fid, start) of all records on the chain from offset 0, by pointer jumping.

    Round r adds the records up to 2^r links further; the longest chain a file can hold sets the rounds.
    """
    most = links.groupBy("fid").count().agg(F.max("count")).first()[0] or 1
    known, jump = links.where("start = 0").select("fid", "start"), links
    old: tuple[DataFrame, ...] = ()
    for _ in range(ceil(log2(most)) if most > 1 else 0):
        ahead = known.join(jump, ["fid", "start"]).select("fid", F.col("next").alias("start"))
        far = jump.select("fid", F.col("start").alias("next"), F.col("next").alias("far"))
        # A start is added once: the chain has no cycle, and what is ahead of the known part is new.
        known = materialize(known.unionByName(ahead.join(links.select("fid", "start"), ["fid", "start"], "left_semi")))
        jump = materialize(jump.join(far, ["fid", "next"]).select("fid", "start", F.col("far").alias("next")))
        discard(*old)
        old = (known, jump)
    return known


def rebuilt(spark: SparkSession, path: str, marked: DataFrame) -> DataFrame:
    """fid, start, joined: digests of the payloads that hold magic, from their pieces in order."""
    cut = marked.where("real and not whole").select("fid", F.col("start").alias("owner"), F.col("next").alias("until"), "length")
    pieces = materialize(marked.select("fid", "file", "block", "k", "start").join(cut, "fid").where("start >= owner and start < until"))
    n = pieces.count()
    if n == 0:
        return spark.createDataFrame([], "fid long, start long, joined string")
    pieces = pieces.withColumnsRenamed({"file": "f", "block": "b", "k": "i"})
    texts = spark.read.option("lineSep", MAGIC).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, k = None, 0
        for batch in batches:
            ks = []
            for place in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at, k = (place, 0) if place != at else (at, k + 1)
                ks.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ks, pa.int64())], names=["value", "file", "block", "k"])

    rows = texts.mapInArrow(numbered, "value string, file string, block long, k long")
    pieces = F.broadcast(pieces) if n <= 100_000 else pieces
    met = rows.join(pieces, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")) & (F.col("k") == F.col("i")))
    whole = met.groupBy("fid", "owner", "length").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))  # one record's payload
    text = F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC)
    head = F.octet_length(F.substring_index(text, END, 1)) + len(END)
    body = F.substring(F.encode(text, "UTF-8"), head + 1, F.col("length").cast("int"))
    return whole.select("fid", F.col("owner").alias("start"), F.when(F.octet_length(body) == F.col("length"), F.sha2(body, 256)).alias("joined"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified of every true record.

    Digests of responses are taken from the bytes read. A revisit has its response's in its
    header, and is verified if a response of that page was read with that digest.
    """
    found = materialize(candidates(spark, path))
    found = placed(found, with_bases(found))
    links = materialize(found.where("next is not null").select("fid", "start", "next"))
    true = reachable(links)
    marked = found.join(true.withColumn("real", F.lit(True)), ["fid", "start"], "left")
    out = marked.where("real").join(rebuilt(spark, path, marked), ["fid", "start"], "left")
    revisit = F.col("type") == "revisit"
    lost = F.raise_error(F.lit("blocks of an archive changed between two scans; write it compressed, or read it again")).cast("string")
    body = F.when(F.col("whole"), F.col("mark")).when(F.col("joined").isNotNull(), F.col("joined")).otherwise(lost)
    digest = F.when(revisit, F.col("digest")).otherwise(body)
    size = F.when(revisit, F.col("bytes")).otherwise(F.col("length"))
    out = materialize(out.select(
        F.col("page").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"),
        F.when(revisit, F.col("refers")).alias("refers_to"), (digest == F.col("digest")).alias("same"),
    ))
    held = out.where("record_type = 'response' and same").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct().withColumn("held", F.lit(True))
    # Responses refer to nothing, so only revisits meet.
    out = out.join(held, ["refers_to", "payload_digest"], "left")
    verified = F.when(F.col("record_type") == "revisit", F.coalesce("held", F.lit(False))).otherwise(F.col("same"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", verified.alias("verified"))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write `pages` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, **options)
    return read(spark, path)
