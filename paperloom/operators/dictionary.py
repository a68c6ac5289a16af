"""Large dictionaries of words and phrases in one pass over the texts, by an Aho-Corasick automaton.

Texts and terms are read as sequences of lower-case words, so a term matches whole words only,
whatever stands between them. The automaton walks a text once and tells every term that ends at a
word; of matches that overlap the leftmost is kept, of these the longest. A dictionary too large
for one automaton (PART_CHARS) is dealt into parts by hash; each is a pass, and overlaps between
parts are settled by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = regex.compile(r"[\p{L}\p{M}\p{N}\p{Pc}]+")
#: Characters of the terms of one automaton; it takes some hundred bytes a character in each worker.
PART_CHARS = 20_000_000
FOUND = "term string, word_start int, word_end int, start int, end int"


def spelled(text: str | None) -> str:
    """The words in lower case with a space after each."""
    return "".join(w + " " for w in WORD.findall((text or "").lower()))


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for t in terms:
        if key := spelled(t):
            found.add_word(key, key)
    found.make_automaton()
    return found


def occurrences(text: str, terms: ahocorasick.Automaton) -> Iterator[tuple[str, int, int, int, int]]:
    """(term, first word, behind the last word, start, end) of all whole-word matches; places are in the text as given."""
    # Lower case may be longer than what it is made of, so words are looked up in the text itself.
    places = [m.span() for m in WORD.finditer(text)]
    words = [text[a:b].lower() + " " for a, b in places]
    starts, n = {0: 0}, 0
    for k, w in enumerate(words, 1):
        n += len(w)
        starts[n] = k
    for last, term in terms.iter("".join(words)):
        first = starts.get(last + 1 - len(term))
        if first is not None:
            behind = starts[last + 1]
            yield term[:-1], first, behind, places[first][0], places[behind - 1][1]


def settled(rows: list[tuple]) -> list[tuple]:
    """Of matches that overlap the leftmost, then the longest; (..., first word, behind the last word, start, end)."""
    out, free = [], 0
    for r in sorted(rows, key=lambda r: (r[-4], -r[-3])):
        if r[-4] >= free:
            out.append(r)
            free = r[-3]
    return out


def find_terms(texts: DataFrame, id_col: str, text_col: str, terms: DataFrame, overlapping: bool = False) -> DataFrame:
    """(id, term, word_start, word_end, start, end) of the terms (column `term`) in all texts; ends are exclusive, places from 0.

    Null and blank texts and terms give no rows; terms spelled alike are one.
    """
    kind = dict(texts.dtypes)[id_col]
    distinct = terms.where("term is not null").select("term").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("n")).first().n
    n_parts = max(1, -(-size // PART_CHARS))
    sc, out = texts.sparkSession.sparkContext, None
    for k in range(n_parts):
        part = distinct.where(F.pmod(F.xxhash64("term"), F.lit(n_parts)) == k) if n_parts > 1 else distinct
        shared = sc.broadcast([r.term for r in part.toLocalIterator()])  # at most PART_CHARS characters, give or take the hash's luck

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = automaton(shared.value)
            for batch in batches:
                rows = []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text and len(found):
                        here = list(occurrences(text, found))
                        rows += [(i, *r) for r in (here if overlapping or n_parts > 1 else settled(here))]
                columns = zip(*rows) if rows else ((),) * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.string(), *[pa.int32()] * 4))], names=["id", *(f.split()[0] for f in FOUND.split(", "))])

        one = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {FOUND}")
        out = one if out is None else out.unionByName(one)
    if n_parts > 1 and not overlapping:

        def settle(table: pa.Table) -> pa.Table:
            rows = settled([tuple(r.values()) for r in table.to_pylist()])
            return pa.Table.from_pylist([dict(zip(table.schema.names, r)) for r in rows], schema=table.schema)

        out = out.groupBy("id").applyInArrow(settle, out.schema)
    elif n_parts > 1:
        out = out.distinct()  # a term may be in several parts, spelled otherwise
    return out.withColumnRenamed("id", id_col)
