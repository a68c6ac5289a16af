"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Every n-gram of the benchmark is counted over all documents. An item's n-grams are rare
unless far more frequent (over 4 times, plus 10) than the commonest of its rarest
`rare_share`. A second pass finds n-grams in the documents; around them the item is aligned
with the text (match 2, mismatch and gap -1). Counts can't tell an everyday phrase from what
is left of an item in many edited copies, so places with frequent n-grams only are aligned
too, unless too few words of the item stand there for any alignment to reach `least`: the
counts decide what a place costs, never the result. The score is the best local alignment
over that of an exact copy; from `least` up it is a leak. Words are letters and digits,
lower case.

The benchmark is handled in blocks of `block_words` words, each small enough to be sent to
all tasks; every block meets all documents.

Defined results: null texts hold no words; items of fewer than `n` words are too short to
be told from chance and match nothing; equal item texts give a row each; repeated rows
give repeated rows; null ids stay null; an empty table on either side gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import text_batches

WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
MATCH, MISS, GAP = 2, -1, 1


class Items:
    """A block of benchmark items with the index of their n-grams; sent to tasks as it is."""

    def __init__(self, rows: list[tuple[int, str | None]], n: int) -> None:
        self.n = n
        found = [(i, WORD.findall((t or "").lower())) for i, t in rows]
        found = [(i, w) for i, w in found if len(w) >= n]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in found for w in ws}))}
        self.names = [i for i, _ in found]
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in found]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        keys = [self.keys(w) for w in self.words] or [np.zeros(0, np.uint64)]
        self.grams, at = np.unique(np.concatenate(keys), return_inverse=True)
        item = np.concatenate([np.full(len(k), x) for x, k in enumerate(keys)]).astype(np.int64)
        place = np.concatenate([np.arange(len(k)) for k in keys]).astype(np.int64)
        order = np.argsort(at, kind="stable")
        self.item, self.place = item[order], place[order]
        self.bounds = np.searchsorted(at[order], np.arange(len(self.grams) + 1))
        self.seed = np.ones(len(self.grams), bool)

    def keys(self, ids: np.ndarray) -> np.ndarray:
        h = ids.astype(np.uint64) + np.uint64(1)
        out = h[: len(h) - self.n + 1].copy()
        for k in range(1, self.n):
            out = out * BASE + h[k : len(h) - self.n + 1 + k]
        return out

    def read(self, text: str) -> np.ndarray:
        """Word numbers of a text; -1 for words that no item has."""
        get = self.vocabulary.get
        words = WORD.findall(text.lower())
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, n-grams) of the benchmark's n-grams in a text."""
        n = self.n
        if len(ids) < n or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = np.cumsum(np.concatenate([[0], ids >= 0]))
        at = np.flatnonzero(known[n:] - known[:-n] == n)
        if not len(at):
            return at, at
        h = (ids + 1).astype(np.uint64)
        keys = h[at]
        for k in range(1, n):
            keys = keys * BASE + h[at + k]
        pos = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        right = self.grams[pos] == keys
        return at[right], pos[right]

    def keep_rarest(self, counts: dict[int, int], share: float) -> None:
        freq = np.zeros(len(self.grams), np.int64)
        for k, n in counts.items():
            freq[k] = n
        self.seed[:] = False
        gram = np.repeat(np.arange(len(self.grams)), np.diff(self.bounds))
        order = np.argsort(self.item, kind="stable")
        for own in np.split(gram[order], np.flatnonzero(np.diff(self.item[order])) + 1) if len(gram) else ():
            f = freq[own]
            usual = np.sort(f)[max(0, int(np.ceil(share * len(f))) - 1)]
            self.seed[own[f <= 4 * usual + 10]] = True


def best_end(text: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Score and end, in the text, of the best local alignment; a row of the table at a time."""
    steps = GAP * np.arange(len(text))
    above = np.zeros(len(text), np.int64)
    best, end = 0, 0
    for w in item.tolist():
        diagonal = np.concatenate([[0], above[:-1]]) + np.where(text == w, MATCH, MISS)
        row = np.maximum(np.maximum(diagonal, above - GAP), 0)
        row = np.maximum.accumulate(row + steps) - steps  # gaps along the text
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top + 1
        above = row
    return best, end


def enough(text: np.ndarray, item: np.ndarray, least: float) -> bool:
    """False if no alignment of the item can reach `least` in the text: too few of its words within the longest span of one."""
    known = np.cumsum(np.concatenate([[0], np.isin(text, item)]))
    # 2 m - x >= 2 least L for m <= L matches and x other words of the text
    span = min(len(text), int((3 - 2 * least) * len(item)) + 1)
    return bool((known[span:] - known[: len(known) - span]).max() >= least * len(item))


def places(items: Items, at: np.ndarray, gram: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, least start, greatest start) of runs of n-grams of an item: where copies would begin by them."""
    n = items.bounds[gram + 1] - items.bounds[gram]
    which = np.repeat(items.bounds[gram] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    item, place, doc = items.item[which], items.place[which], np.repeat(at, n)
    order = np.lexsort((doc, item))
    item, place, doc = item[order], place[order], doc[order]
    cut = np.flatnonzero((item[1:] != item[:-1]) | (doc[1:] - doc[:-1] > items.sizes[item[1:]])) + 1
    heads = np.concatenate([[0], cut])
    start = doc - place
    return zip(item[heads].tolist(), np.minimum.reduceat(start, heads).tolist(), np.maximum.reduceat(start, heads).tolist())


def aligned(items: Items, ids: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, end word) of the items that a text holds."""
    at, gram = items.hits(ids)
    out: dict[int, tuple[float, int, int]] = {}
    for rare in (True, False):
        mine = items.seed[gram] == rare
        if not mine.any():
            continue
        for k, lo, hi in places(items, at[mine], gram[mine]):
            if not rare and out.get(k, (0.0,))[0] == 1:
                continue
            words = items.words[k]
            slack = max(2, len(words) // 4)
            # Seeds may be of several copies in a row, so the window spans all of them.
            a, b = max(0, lo - slack), min(len(ids), hi + len(words) + slack)
            part, full = ids[a:b], MATCH * len(words)
            if not rare and not enough(part, words, least):
                continue
            have, need = Counter(part.tolist()), Counter(words.tolist())
            if MATCH * sum(min(c, have[w]) for w, c in need.items()) < least * full:
                continue
            score, end = best_end(part, words)
            if score >= least * full and score / full > out.get(k, (0.0,))[0]:
                _, back = best_end(part[:end][::-1], words[::-1])
                out[k] = (score / full, a + end - back, a + end)
    return [(k, *v) for k, v in out.items()]


def with_seeds(rows: DataFrame, items: Items, rare_share: float) -> Items:
    """Counts the block's n-grams over all texts (last column of `rows`) and marks each item's rarest as seeds."""
    first = rows.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(first.value.grams), np.int64)
        for batch in batches:
            for text in batch.column(0):
                seen[np.unique(first.value.hits(first.value.read(text.as_py() or ""))[1])] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["gram", "n"])

    counts = text_batches(rows).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most the block's n-grams
    items.keep_rarest({r.gram: r.n for r in counts}, rare_share)
    return items


def blocks(benchmark: DataFrame, n: int, block_words: int, item_col: str, item_text_col: str) -> Iterator[Items]:
    """The benchmark in parts of about `block_words` words, each small enough for driver and tasks."""
    test = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    size = test.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("n")).first().n
    n_blocks = max(1, -(-size // block_words))
    for k in range(n_blocks):
        mine = test.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        yield Items(sorted([(r.item, r.text) for r in mine.collect()], key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), n)


def leaks(
    docs: DataFrame, benchmark: DataFrame, n: int = 4, rare_share: float = 0.6, least: float = 0.5, block_words: int = 500_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document and benchmark item that it holds: score and the words that align best."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    out = None
    for items in blocks(benchmark, n, block_words, item_col, item_text_col):
        shared = rows.sparkSession.sparkContext.broadcast(with_seeds(rows.select(text_col), items, rare_share))

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                got = []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    got += [(i, items.names[k], score, a, b) for k, score, a, b in aligned(items, items.read(text.as_py() or ""), least)]
                cols = zip(*got) if got else ((),) * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))], names=[id_col, "item_id", "score", "first_word", "end_word"])

        part = rows.mapInArrow(match, f"`{id_col}` long, item_id long, score double, first_word int, end_word int")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, n: int = 4, rare_share: float = 0.6, least: float = 0.5, block_words: int = 500_000,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Rows of `docs`, all columns, that hold no benchmark item."""
    column, out = docs.columns.index(text_col), docs
    for items in blocks(benchmark, n, block_words, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(with_seeds(docs.select(text_col), items, rare_share))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                yield batch.filter(pa.array([not aligned(items, items.read(t.as_py() or ""), least) for t in batch.column(column)], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
