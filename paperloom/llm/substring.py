"""Removal of repeated 20-word windows by super-k-mer partitioning.

A window's minimiser is the smallest hash of its GRAM-word grams. Consecutive windows that
share one form a super-k-mer: its words travel once, packed as one string, to the bucket
of the minimiser. There all windows are sorted by hash, windows of one hash are compared
byte by byte, and every window but the first by (id, start) is a repeat.

Before anything is sent, repeats inside a chunk of documents are marked on the spot and
only first occurrences travel, so a passage that very many documents share reaches its
bucket once a chunk. Minimisers of more than about 1/HOT of all super-k-mers, whose
windows differ around a common phrase, are split: their windows travel singly to the
bucket of their own hash. A survey of every SURVEY-th text, by hash, finds them and the
number of buckets. The survey decides where windows meet, never which; all rows are read.

Defined results: null text has no words; null ids come last and count as one document;
rows that share an id are one document, and equal windows at the same start of it are not
repeats of each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from paperloom.llm.common import text_batches

WINDOW, GRAM = 20, 3
HOT, SURVEY = 1000, 16
#: Bytes of text handled together in a task, and bytes of text whose windows a bucket should hold.
CHUNK_BYTES, BUCKET_BYTES = 8_000_000, 3_000_000
#: Longer words are hashed one by one.
LONG_WORD = 128
LAST = (1 << 63) - 1
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def product(a: np.uint64, b: np.uint64) -> np.uint64:
    return np.uint64(int(a) * int(b) & 0xFFFFFFFFFFFFFFFF)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of the n items from each position, by doubling."""
    out, done, power = np.zeros(len(h), np.uint64), 0, np.uint64(1)
    part, width, step = h, 1, BASE
    while n:
        if n & 1:
            out = out[: len(part) - done] + power * part[done:] if done else part.copy()
            power, done = product(power, step), done + width
        n >>= 1
        if n:
            part, width, step = part[: len(part) - width] + step * part[width:], 2 * width, product(step, step)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def edges(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if not len(x):
        return iter(())
    cut = (np.flatnonzero(x[1:] != x[:-1]) + 1).tolist()
    return zip([0, *cut], [*cut, len(x)])


class Words:
    """Words of some texts as one string, each followed by a single space, with places, owners and hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        gap = SPACES[raw]
        begin = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        end = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
        self.owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="right")
        self.size = end - begin
        keep = ~gap
        keep[end] = True
        text = raw[keep]
        text[SPACES[text]] = 32
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.text = text.tobytes()
        self.hash = self.hashed(text)

    def hashed(self, text: np.ndarray) -> np.ndarray:
        """A polynomial of the bytes of each word: the k-th byte of all words that long at once, longest words first."""
        short = np.minimum(self.size, LONG_WORD).astype(np.uint8)
        order = np.argsort(255 - short, kind="stable")
        start, h = self.start[order], np.zeros(len(order), np.uint64)
        left = np.cumsum(np.bincount(short, minlength=LONG_WORD + 1)[::-1])[::-1]  # words of at least so many bytes
        for k in range(LONG_WORD):
            n = int(left[k + 1]) if k + 1 <= LONG_WORD else 0
            if not n:
                break
            h[:n] = h[:n] * BASE + text[start[:n] + k] + np.uint64(1)
        out = np.empty(len(order), np.uint64)
        out[order] = h
        for k in np.flatnonzero(self.size >= LONG_WORD).tolist():
            out[k] = xxh3_64_intdigest(self.text[self.start[k] : self.start[k] + self.size[k]])
        return mixed(out)

    def span(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The strings from word to word."""
        return [self.text[a:b] for a, b in zip(self.start[first].tolist(), (self.start[last] + self.size[last]).tolist())]

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows from word a and from word b are the same."""
        w = WINDOW - 1
        size_a = self.start[a + w] + self.size[a + w] - self.start[a]
        out = size_a == self.start[b + w] + self.size[b + w] - self.start[b]
        at, text = np.flatnonzero(out), self.text
        for k, x, y, n in zip(at.tolist(), self.start[a[at]].tolist(), self.start[b[at]].tolist(), size_a[at].tolist()):
            if text[x : x + n] != text[y : y + n]:
                out[k] = False
        return out


class Chunk:
    """Some documents in (id, key) order, with the windows that lie inside one document."""

    def __init__(self, docs: list[tuple[int, int, bytes]]) -> None:
        docs.sort(key=lambda d: (d[0], d[1]))
        self.ids, self.keys = (np.array([d[k] for d in docs], np.int64) for k in (0, 1))
        self.words = Words([d[2] for d in docs])
        owner, n = self.words.owner, len(self.words.owner) - WINDOW + 1
        self.first = np.searchsorted(owner, np.arange(len(docs)))
        self.at = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :]) if n > 0 else np.zeros(0, np.int64)
        if len(self.at):
            self.of = owner[self.at]
            self.window = grams(self.words.hash, WINDOW)[self.at]
            self.mini = sliding_min(mixed(grams(self.words.hash, GRAM)), WINDOW - GRAM + 1)[self.at]

    def runs(self, keep: np.ndarray, route: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last, among the kept windows, of each super-k-mer."""
        at, of, by = self.at[keep], self.of[keep], route[keep]
        cut = np.flatnonzero((np.diff(at) != 1) | (by[1:] != by[:-1]) | (of[1:] != of[:-1]))
        return np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(at) - 1]])


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Rows (id, key, text) in lists of about `most` bytes."""
    part, size = [], 0
    for batch in batches:
        for i, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            part.append((i, key, text.as_py()))
            size += len(part[-1][2])
            if size >= most:
                yield part
                part, size = [], 0
    if part:
        yield part


def intervals(start: np.ndarray) -> bytes:
    """Sorted window starts -> first and end of the words they cover."""
    cut = np.flatnonzero(np.diff(start) > 1)
    first, last = start[np.concatenate([[0], cut + 1])], start[np.concatenate([cut, [len(start) - 1]])]
    return np.stack([first, last + WINDOW], 1).astype(np.int32).tobytes()


def survey(rows: DataFrame, every: int, hot: int, chunk_bytes: int) -> tuple[int, list[int]]:
    """About how many bytes of text there are, and the minimisers to split, at most 4 `hot`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in chunks(batches, chunk_bytes):
            size, c = sum(len(d[2]) for d in docs), Chunk(docs)
            keys, n, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
            if len(c.at):
                first, _ = c.runs(np.ones(len(c.at), bool), c.mini)
                total = len(first)
                keys, n = np.unique(c.mini[first], return_counts=True)
                big = n * 2 * hot >= total
                keys, n = keys[big], n[big]
            kinds = ["bytes", "runs", *["mini"] * len(keys)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([None, None, *keys.view(np.int64).tolist()], pa.int64()), pa.array([size, total, *n.tolist()], pa.int64())], names=["kind", "mini", "n"])

    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0)
    sums = text_batches(some).mapInArrow(run, "kind string, mini long, n long").groupBy("kind", "mini").agg(F.sum("n").alias("n"))
    got = sums.orderBy(F.col("kind") == "mini", F.desc("n"), "mini").limit(2 + 4 * hot).collect()
    total = {r.kind: r.n for r in got if r.kind != "mini"}
    return total.get("bytes", 0) * every, [r.mini for r in got if r.kind == "mini" and r.n > 1 and r.n * 4 * hot >= total["runs"]]


PACKED = "bucket long, places binary, words binary, n_runs long, n_bytes long"


def pack(rows: DataFrame, n_buckets: int, split_at: list[int], chunk_bytes: int) -> DataFrame:
    """Super-k-mers by bucket; and the repeats found inside chunks, as rows without words.

    places: id, key, start and number of words of each super-k-mer, four whole numbers.
    """
    split = np.array(sorted(split_at), np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd", compression_level=5)
        for docs in chunks(batches, chunk_bytes):
            c = Chunk(docs)
            if not len(c.at):
                continue
            start = c.at - c.first[c.of]
            # Stable, so equal windows keep the order of (id, start) if ids differ.
            order = np.argsort(c.window, kind="stable")
            a, b = order[:-1], order[1:]
            same = np.flatnonzero(c.window[a] == c.window[b])
            a, b = a[same], b[same]
            before = (c.ids[c.of[a]] < c.ids[c.of[b]]) | (start[a] < start[b]) & (c.ids[c.of[a]] == c.ids[c.of[b]])
            repeat = np.zeros(len(c.at), bool)
            repeat[b[c.words.equal(c.at[a], c.at[b]) & before]] = True
            out: list[tuple] = []
            for lo, hi in edges(c.of[repeat]):
                k = c.of[repeat][lo]
                out.append((int(c.ids[k] % n_buckets), np.array([c.ids[k], c.keys[k]]).tobytes(), intervals(start[repeat][lo:hi]), 0, 0))
            if not repeat.all():
                kept = ~repeat
                route = np.where(np.isin(c.mini, split), mixed(c.window), c.mini) if len(split) else c.mini
                first, last = c.runs(kept, route)
                at, who = c.at[kept], c.of[kept][first]
                begin, end = at[first], at[last] + WINDOW
                to = (route[kept][first] % np.uint64(n_buckets)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                begin, end, who, to = begin[by], end[by], who[by], to[by]
                places = np.stack([c.ids[who], c.keys[who], begin - c.first[who], end - begin], 1)
                texts = c.words.span(begin, end - 1)
                for lo, hi in edges(to):
                    data = b" ".join(texts[lo:hi])
                    out.append((int(to[lo]), pa.compress(places[lo:hi].T.tobytes(), "zstd", asbytes=True), zstd.compress(data, asbytes=True), hi - lo, len(data)))
            for k in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[k : k + 1000]), (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["bucket", "places", "words", "n_runs", "n_bytes"])

    return text_batches(rows).mapInArrow(run, PACKED)


COVER = "id long, key long, cover binary"


def repeats(table: pa.Table) -> pa.Table:
    """Of one bucket: (id, key, covered words) of the windows that also start earlier."""
    found: list[tuple[int, int, bytes]] = []
    packed = []
    for row in table.to_pylist():
        if row["n_bytes"]:
            packed.append(row)
        else:
            i, key = np.frombuffer(row["places"], np.int64).tolist()
            found.append((i, key, row["words"]))
    if packed:
        found += repeated(packed)
    return pa.table({"id": pa.array([f[0] for f in found], pa.int64()), "key": pa.array([f[1] for f in found], pa.int64()), "cover": pa.array([f[2] for f in found], pa.binary())})


def repeated(packed: list[dict]) -> Iterator[tuple[int, int, bytes]]:
    texts, places = [], []
    for row in packed:
        text = pa.decompress(row["words"], row["n_bytes"], "zstd", asbytes=True)
        texts.append(text)
        places.append(np.frombuffer(pa.decompress(row["places"], 32 * row["n_runs"], "zstd", asbytes=True), np.int64).reshape(4, -1))
    words = Words(texts)
    ids, keys, starts, sizes = np.concatenate(places, 1)
    n = sizes - WINDOW + 1
    run = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(sizes) - sizes)[run] + inner
    h = grams(words.hash, WINDOW)[at]
    order = np.argsort(h)
    twin = np.zeros(len(order), bool)
    twin[1:] = h[order[1:]] == h[order[:-1]]
    twin[:-1] |= twin[1:].copy()
    order = order[twin]  # only windows whose hash occurs again are compared
    if not len(order):
        return
    doc, start = ids[run[order]], starts[run[order]] + inner[order]
    by = np.lexsort((start, doc, h[order]))
    order, doc, start = order[by], doc[by], start[by]
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    rest = np.flatnonzero(~new)
    again = np.zeros(len(order), bool)
    equal = words.equal(at[order[rest]], at[order[head[rest]]])
    again[rest] = equal & ((doc[rest] != doc[head[rest]]) | (start[rest] != start[head[rest]]))
    for k in np.unique(head[rest[~equal]]):  # different windows of one hash: by their words
        firsts: dict[bytes, tuple[int, int]] = {}
        for p in range(k, len(order)):
            if p > k and new[p]:
                break
            w, place = words.span(at[order[p : p + 1]], at[order[p : p + 1]] + WINDOW - 1)[0], (int(doc[p]), int(start[p]))
            again[p] = firsts.setdefault(w, place) != place
    doc, start, key = doc[again], start[again], keys[run[order[again]]]
    by = np.lexsort((start, key, doc))
    doc, start, key = doc[by], start[by], key[by]
    cut = (np.flatnonzero((doc[1:] != doc[:-1]) | (key[1:] != key[:-1])) + 1).tolist()
    for lo, hi in zip([0, *cut], [*cut, len(doc)]) if len(doc) else ():
        yield int(doc[lo]), int(key[lo]), intervals(np.unique(start[lo:hi]))


def dedup_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, every: int = SURVEY, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Per row: id, n_words, n_removed and the text that is kept, its words joined by spaces."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    size, split_at = survey(rows, every, hot, chunk_bytes)
    cover = pack(rows, max(8, size // bucket_bytes), split_at, chunk_bytes).groupBy("bucket").applyInArrow(repeats, COVER)
    cover = cover.groupBy("id", "key").agg(F.collect_list("cover").alias("cover"))  # a document's own intervals
    joined = rows.join(cover, ["id", "key"], "left").select("id", "text", "cover")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, gone, kept = [], [], [], []
            for i, text, parts in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2)):
                words, parts = text.as_py().split(), parts.as_py()  # of bytes: at space and 09 to 0D
                n = len(words)
                if parts:
                    spans = np.concatenate([np.frombuffer(p, np.int32).reshape(-1, 2) for p in parts])
                    depth = np.bincount(spans[:, 0], minlength=n + 1) - np.bincount(spans[:, 1], minlength=n + 1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(depth)[:n] <= 0).tolist()]
                ids.append(None if i == LAST else i)
                sizes.append(n)
                gone.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"`{id_col}` long, n_words long, n_removed long, kept string")
