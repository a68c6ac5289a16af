"""An exact join of similar titles: by an index of segments, or in blocks where segments are too short to tell.

Titles are alike at an indel ratio of `least` per cent or more, so the shorter one, r, and the
longer one, s, differ by at most t = (1 - least / 100) (|r| + |s|) inserted or deleted characters.
r is cut into more segments than that. One edit spoils one segment at most, so all but t of the
segments stand in s unchanged, moved by no more than the characters deleted or inserted before
them. Titles meet by segment, place and length:

- s lays down each of its substrings as a key of length band, place and text; r looks for its
  segments in each band that a partner can be in, at the places within the shift;
- of r's segments the t + 1 that fewest titles have are looked up, since one of any t + 1 must
  be there. Segments that no title has count among them, and most titles have t + 1 of these;
- what meets must be alike in letter counts, then have as many segments in place as the bound
  asks, and is compared last, along a band of the table of common subsequences.

Keys are hashes: a collision can add a candidate, never lose a pair. `least` is above 200 / 3:
titles that are less alike need not share any segment.

Segments of fewer than SELECTIVE characters stand in most titles of prose, so that each title would
meet most others, once for each segment. Where a length band has such segments, its titles meet
the shorter ones of near lengths in pairs of blocks instead. A pair of blocks is all that a task holds: lengths
and letter counts of a block are compared at once, and what they leave is compared as text right there, many pairs
at a time (`subsequences.py`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from paperloom.operators.subsequences import Texts, edits, ratio, shifts
from paperloom.session import cut

#: Letters whose counts are compared before titles are.
COUNTED = "etaoinshrdlucmfwypvbgkqjxz "
#: Characters of a segment from which on it is looked up; most titles and characters of a block.
SELECTIVE, BLOCK_TITLES, BLOCK_CHARS = 6, 4000, 1_500_000
#: Pairs that wait for being compared together, and characters of titles in a batch that is dealt.
WAITING, DEALT_CHARS = 1 << 19, 4_000_000


def longest_partner(n: int, least: float) -> int:
    return int(n * (200 - least) / least + 1e-9)


def band(n: int) -> int:
    """Number of the length band: single lengths at first, then each a fifth longer than the one before."""
    k, lo = 0, 1
    while n >= (hi := max(lo + 1, lo * 6 // 5)):
        k, lo = k + 1, hi
    return k


@lru_cache(maxsize=4096)
def layout(k: int, least: float) -> tuple[int, int, int, int]:
    """Of a band of longer titles: least and most length, segment length of the shorter ones, and width of a place."""
    lo = 1
    for _ in range(k):
        lo = max(lo + 1, lo * 6 // 5)
    hi = max(lo + 1, lo * 6 // 5) - 1
    shortest = next(n for n in range(max(1, int(lo * least / (200 - least)) - 1), lo + 1) if longest_partner(n, least) >= lo)
    size = min(n // (edits(n, min(hi, longest_partner(n, least)), least) + 1) for n in range(shortest, hi + 1))
    return lo, hi, max(1, size), max(16, edits(hi, hi, least))


def key(k: int, place: int, text: str) -> int:
    return xxh3_64_intdigest(text.encode(), seed=k << 32 | place) - (1 << 63)


def laid(t: str, least: float) -> set[int]:
    """Keys of all substrings of a title that a shorter one's segments can be."""
    k = band(len(t))
    _, _, size, width = layout(k, least)
    return {key(k, i // width, t[i : i + size]) for i in range(len(t) - size + 1)}


def sought(t: str, least: float) -> Iterator[tuple[int, int, int]]:
    """(band, segment, key) that a title looks for in the bands of its longer partners."""
    n = len(t)
    for k in range(band(n), band(longest_partner(n, least)) + 1):
        lo, hi, size, width = layout(k, least)
        m = min(hi, longest_partner(n, least))
        left, right = max(shifts(n, max(n, lo), least)[0], 0), shifts(n, m, least)[1]
        for j in range(n // size):
            for place in range(max(0, j * size - left) // width, (min(m - size, j * size + right)) // width + 1):
                yield k, j, key(k, place, t[j * size : (j + 1) * size])


def in_place(r: str, s: str, least: float) -> bool:
    """Whether as many segments of r stand in s, within their shift, as the bound asks."""
    size = layout(band(len(s)), least)[2]
    left, right = shifts(len(r), len(s), least)
    n = len(r) // size
    spare = edits(len(r), len(s), least)
    for j in range(n):
        if s.find(r[j * size : (j + 1) * size], max(0, j * size - left), j * size + right + size) < 0:
            spare -= 1
            if spare < 0:
                return False
    return True


def selective(k: int, least: float) -> bool:
    return layout(k, least)[2] >= SELECTIVE


def band_of(n: Column) -> Column:
    starts = [1]
    while starts[-1] < 1 << 31:
        starts.append(max(starts[-1] + 1, starts[-1] * 6 // 5))
    return F.size(F.filter(F.lit(starts[:-1]), lambda lo: lo <= n)) - 1


def blocks_of(groups: DataFrame) -> dict[int, int]:
    """How many blocks the titles of each length band make."""
    n = F.length("t")
    sizes = groups.groupBy(band_of(n).alias("band")).agg(F.count("*").alias("titles"), F.sum(n).alias("chars")).collect()
    return {r.band: max(-(-r.titles // BLOCK_TITLES), -(-r.chars // BLOCK_CHARS)) for r in sizes}


def letters(texts: list[str]) -> np.ndarray:
    """Counts of the counted letters, and of all others, of each text."""
    counts = np.array([[t.count(ch) for ch in COUNTED] for t in texts], np.int32).reshape(len(texts), len(COUNTED))
    return np.column_stack([counts, np.array([len(t) for t in texts], np.int32) - counts.sum(axis=1)])


def targets(k: int, own: int, blocks: dict[int, int], reach: dict[int, list[int]]) -> Iterator[tuple[int, int, int, int, bool]]:
    """(rb, ri, sb, si, second) of the pairs of blocks that a title of this block of a band is in, and whether in the second of both."""
    for b in reach[k]:
        if b != k:
            yield from ((k, own, b, j, False) for j in range(blocks[b]))
        else:
            yield from ((k, min(own, j), k, max(own, j), j < own) for j in range(blocks[k]))
    for b in blocks:
        if b != k and k in reach[b]:
            yield from ((b, i, k, own, True) for i in range(blocks[b]))


def met(one: list[tuple[int, int, str]], two: list[tuple[int, int, str]], least: float, alike: str, scored: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(r, s, score) of titles (length, ord, text) of two lists, s not shorter, that are alike in letter counts.

    `alike` tells which of titles as long as each other count: "all", "none", or "earlier", those where r is before s.
    """
    if not one or not two:
        return
    n, m, r, s = (np.array([x[k] for x in rows], np.int64) for k, rows in ((0, one), (0, two), (1, one), (1, two)))
    kind = np.int16 if n[-1] + m[-1] < 1 << 15 else np.int32
    counts, theirs = letters([x[2] for x in one]).astype(kind), np.ascontiguousarray(letters([x[2] for x in two]).T.astype(kind))
    texts = Texts([x[2] for x in one], [x[2] for x in two], least) if scored else None

    def told(a: list[int], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right = np.repeat(np.array(a, np.int64), [len(x) for x in b]), np.concatenate(b)
        score = texts.ratios(left, right) if texts else np.full(len(left), least)
        kept = np.flatnonzero(score >= least)
        return r[left[kept]], s[right[kept]], score[kept] if scored else np.zeros(len(kept))

    a, b, waiting = [], [], 0
    lows, highs = np.searchsorted(m, n, side="right" if alike == "none" else "left"), np.searchsorted(m, [longest_partner(int(x), least) + 1 for x in n])
    for i, (lo, hi) in enumerate(zip(lows.tolist(), highs.tolist())):
        if lo >= hi:
            continue
        differ = theirs[:, lo:hi] - counts[i][:, None]
        near = np.abs(differ, out=differ).sum(axis=0, dtype=kind) <= (100 - least) / 100 * (n[i] + m[lo:hi]) + 1e-6
        if alike == "earlier":
            near &= (m[lo:hi] > n[i]) | (r[i] < s[lo:hi])
        if len(found := np.flatnonzero(near) + lo):
            a.append(i)
            b.append(found)
            waiting += len(found)
            if waiting >= WAITING:
                yield told(a, b)
                a, b, waiting = [], [], 0
    if a:
        yield told(a, b)


def by_blocks(groups: DataFrame, least: float, blocks: dict[int, int], scored: bool) -> DataFrame:
    """(r, s, score) of titles alike in letter counts, s in a band that isn't looked up; if `scored`, of those with a ratio of `least`."""
    reach = {k: [b for b in range(k, band(longest_partner(layout(k, least)[1], least)) + 1) if b in blocks and not selective(b, least)] for k in blocks}
    names = ["rb", "ri", "sb", "si", "second", "ord", "t"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[tuple[int, int], pa.RecordBatch] = {}
        for batch in batches:
            parts, size = [], 0
            for ord_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = band(len(t))
                own = key(0, 0, t) % blocks[k]
                if (to := lists.get((k, own))) is None:
                    columns = zip(*targets(k, own, blocks, reach)) if reach[k] or any(k in reach[b] for b in blocks) else ((),) * 5
                    to = lists[k, own] = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [pa.int32()] * 4 + [pa.bool_()])], names=names[:5])
                n = to.num_rows
                parts.append((to, pa.repeat(pa.scalar(ord_, pa.int64()), n), pa.repeat(pa.scalar(t, pa.string()), n)))
                size += n * (len(t) + 32)
                if size > DEALT_CHARS:
                    yield dealt_batch(parts)
                    parts, size = [], 0
            if parts:
                yield dealt_batch(parts)

    def dealt_batch(parts: list[tuple[pa.RecordBatch, pa.Array, pa.Array]]) -> pa.RecordBatch:
        columns = [pa.concat_arrays([p[0].column(c) for p in parts]) for c in range(5)] + [pa.concat_arrays([p[c] for p in parts]) for c in (1, 2)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def meet(task: tuple, table: pa.Table) -> pa.Table:
        rb, ri, sb, si = (x.as_py() for x in task)
        got = sorted((len(t), ord_, second, t) for second, ord_, t in zip(*(table.column(c).to_pylist() for c in ("second", "ord", "t"))))
        one, two = ([(n, ord_, t) for n, ord_, second, t in got if second == which] for which in (False, True))
        if rb != sb:
            found = met(one, two, least, "all", scored)
        elif ri == si:
            found = met(one, one, least, "earlier", scored)
        else:
            # Blocks of a band: of titles as long as each other, those of the first count as the shorter ones.
            found = chain(met(one, two, least, "all", scored), met(two, one, least, "none", scored))
        r, s, score = (np.concatenate(c) for c in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *found))
        return pa.table({"r": r, "s": s, "score": score})

    task = names[:4]
    n_tasks = sum(blocks[k] * (blocks[b] if b != k else (blocks[k] + 1) / 2) for k in blocks for b in reach[k])
    dealt = groups.select("ord", "t").mapInArrow(deal, "rb int, ri int, sb int, si int, second boolean, ord long, t string")
    return dealt.repartition(max(8, min(2000, int(n_tasks))), *task).groupBy(*task).applyInArrow(meet, "r long, s long, score double")


def candidates(groups: DataFrame, least: float) -> DataFrame:
    """(r, s) of titles (ord, t) that meet by a segment or in blocks, alike in letter counts."""
    blocks = blocks_of(groups)
    return by_segments(groups, least).select("r", "s").unionByName(by_blocks(groups, least, blocks, False).select("r", "s"))


def by_segments(groups: DataFrame, least: float) -> DataFrame:
    """(r, s) of titles (ord, t) that meet by a segment, alike in letter counts, s in a band that is looked up."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ord_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = list(laid(t, least)) if selective(band(len(t)), least) else []
                yield pa.RecordBatch.from_arrays([pa.array([ord_] * len(keys), pa.int64()), pa.array(keys, pa.int64())], names=["s", "key"])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ord_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, n = laid(t, least), len(t)
                rows = [(ord_, k, j, x, int(x in own), edits(n, min(layout(k, least)[1], longest_partner(n, least)), least)) for k, j, x in sought(t, least) if selective(k, least)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((),) * 6)], names=["r", "band", "segment", "key", "own", "edits"])

    texts = groups.select("ord", "t")
    laid_down = texts.mapInArrow(lay, "s long, key long")
    owners = laid_down.groupBy("key").agg(F.count("*").alias("n"))
    probes = texts.mapInArrow(seek, "r long, band long, segment long, key long, own long, edits long")
    # Titles that have the segment, in any place that it can be moved to.
    counted = probes.join(owners, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)) - F.col("own"))
    by_segment = counted.groupBy("r", "band", "segment").agg(F.sum("n").alias("n"), F.max("edits").alias("edits"), F.collect_list(F.when(F.col("n") > 0, F.col("key"))).alias("keys"))
    rank = Window.partitionBy("r", "band").orderBy("n", "segment")
    rare = by_segment.withColumn("k", F.row_number().over(rank)).where((F.col("k") <= F.col("edits") + 1) & (F.col("n") > 0))
    met = rare.select("r", F.explode("keys").alias("key")).distinct().join(laid_down, "key").where("r <> s").select("r", "s").distinct()
    n = F.length("t")
    counts = F.array(*[n - F.length(F.replace("t", F.lit(ch), F.lit(""))) for ch in COUNTED])
    narrow = lambda k: groups.select(F.col("ord").alias(k), n.alias(f"n_{k}"), counts.alias(f"c_{k}"))
    differ = F.aggregate(F.zip_with("c_r", "c_s", lambda x, y: F.abs(x - y)), F.lit(0), lambda a, x: a + x)
    both = met.join(narrow("r"), "r").join(narrow("s"), "s").where((F.col("n_r") < F.col("n_s")) | ((F.col("n_r") == F.col("n_s")) & (F.col("r") < F.col("s"))))
    return both.where(differ <= (100 - least) / 100 * (F.col("n_r") + F.col("n_s")) + 1e-6).select("r", "s")


def similar(titles: DataFrame, least: float = 88.0) -> DataFrame:
    """(a, b, score), a before b, of distinct titles (ord, t) with a ratio of `least` or more; equal ones count as one, under their first ord."""
    if not 200 / 3 < least <= 100:
        raise ValueError("least must be above 66.67, and 100 at most")
    groups = cut(titles.where("t <> ''").groupBy("t").agg(F.min("ord").alias("ord")))
    blocks = blocks_of(groups)
    found = by_blocks(groups, least, blocks, True)
    if any(selective(k, least) for k in blocks):
        found = found.unionByName(looked_up(groups, least))
    return found.select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b"), "score")


def looked_up(groups: DataFrame, least: float) -> DataFrame:
    """(r, s, score) of titles (ord, t) with a ratio of `least` or more, s in a band that is looked up."""
    text = lambda k: groups.select(F.col("ord").alias(k), F.col("t").alias(f"t_{k}"))
    full = by_segments(groups, least).join(text("r"), "r").join(text("s"), "s").select("r", "s", "t_r", "t_s")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [ratio(x, y, least) if in_place(x, y, least) else 0.0 for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], names=["r", "s", "score"]).filter(pa.array([g >= least for g in got], pa.bool_()))

    return full.mapInArrow(score, "r long, s long, score double")
