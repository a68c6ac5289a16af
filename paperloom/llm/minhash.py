"""Near duplicates by circulant MinHash.

A set of shingle hashes gets `bands` x `rows` signature coordinates from two permutations of the
64-bit numbers. The first one, sigma, scatters the set over all places. Coordinate k is the least
value that the second one, pi, has at these places once it is shifted by k places in a circle:
min pi(sigma(x) - k), so no third permutation is needed. `rows` coordinates in a row make a
band; equal bands of two documents make them candidates.

Candidates are confirmed on full sets. Up to PAIRED owners of a band are candidates two by
two; those that the bitmaps of their sets tell apart for sure go. Of bands with more owners the
bitmaps are searched in blocks, each document that is reached only once, so near copies of one
text cost no more than their number. What is left forms small regions, in which exact Jaccard
similarities are counted and linked.

Two sets of similarity s are candidates with probability 1 - (1 - s^rows)^bands: at the default
28 bands of 5 rows all but 7 in 10^8 of those at 0.85; a miss counts only if no other path joins
the two. Candidates are never capped.

Defined results: as those of jaccard.link. A null or blank text has an empty set, linked with
nothing and kept; a null id names no component, but gets that of its equals, `kept` is null; rows that
share an id are one node; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import jaccard
from paperloom.llm.common import materialize

BANDS, ROWS = 28, 5
#: The first permutation's key, and the second's two odd factors.
SIGMA, PI = np.uint64(0x8F1BBCDCCA62C1D6), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Owners of a band up to which each two of them are candidates.
PAIRED = 48
#: Documents of a band in a block, and hashes times coordinates that are counted at once.
BLOCK, GRID = 2048, 1 << 17


def sigma(x: np.ndarray) -> np.ndarray:
    return jaccard.mixed(x + SIGMA)


def pi(place: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers; works on the array that it is given."""
    place ^= place >> np.uint64(30)
    place *= PI[0]
    place ^= place >> np.uint64(27)
    place *= PI[1]
    place ^= place >> np.uint64(31)
    return place


def signature(items: np.ndarray, n: int) -> np.ndarray:
    """n coordinates of a set that isn't empty."""
    places, shifts = sigma(items), np.arange(n, dtype=np.uint64)
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, GRID // n)
    for lo in range(0, len(places), step):
        np.minimum(out, pi(places[None, lo : lo + step] - shifts[:, None]).min(axis=1), out=out)
    return out


def bands_of(items: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band of the signature."""
    values = signature(items, bands * rows).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * jaccard.MIX
    for k in range(rows):
        key = jaccard.mixed(key * jaccard.BASE + values[:, k])
    return key


def owners(rows: DataFrame) -> DataFrame:
    """(key, a, b): pairs of owners of a key of few, with a null key; of a key of many each owner as `a`, with a null b."""

    def far(table: pa.Table) -> pa.Table:
        got = [jaccard.unpacked(*x) for x in zip(*(table.column(c).to_pylist() for c in ("n_keys", "n_ids", "packed")))]
        keys, ids, _ = (np.concatenate(c) for c in zip(*got))
        pairs, _ = jaccard.met_pairs(keys, ids, PAIRED)
        order = np.argsort(keys, kind="stable")
        count = np.unique(keys, return_counts=True)[1]
        many = order[np.repeat(count > PAIRED, count)]
        n, m = len(pairs), len(many)
        return pa.table({
            "key": pa.array(np.concatenate([np.zeros(n, np.int64), keys[many].view(np.int64)]), pa.int64(), mask=np.arange(n + m) < n),
            "a": pa.array(np.concatenate([pairs[:, 0], ids[many]]), pa.int64()), "b": pa.array(np.concatenate([pairs[:, 1], np.zeros(m, np.int64)]), pa.int64(), mask=np.arange(n + m) >= n),
        })

    return jaccard.dealt(rows).groupBy("bucket").applyInArrow(far, "key long, a long, b long")


def reached(crowd: DataFrame, rows: DataFrame, num: int) -> DataFrame:
    """(a, b) of nodes of a key of many (key, a): a forest over all pairs whose bitmaps let them be linked.

    Each two nodes of a key meet in a pair of blocks. There, a node that is reached is asked for once.
    """
    bits = rows.where("set is not null").select(F.col("id").alias("a"), "n_shingles", "bits")
    sizes = crowd.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    rows = crowd.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("a"), "n")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "a").join(bits, "a")

    def run(table: pa.Table) -> pa.Table:
        nodes, sizes, maps = (table.column(c).to_pylist() for c in ("a", "n_shingles", "bits"))
        return pa.table(dict(zip("ab", (pa.array(x, pa.int64()) for x in forest(nodes, sizes, maps, num)))))

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def forest(nodes: list[int], sizes: list[int], maps: list[bytes], num: int) -> tuple[list[int], list[int]]:
    """Edges that connect all sets which their bitmaps let be linked, directly or over others."""
    size = np.array(sizes)
    # All bitmaps are folded to the shortest one's places; what the short ones let pass is asked of the long ones.
    words = min(map(len, maps)) // 8
    grid = np.stack([np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, words), axis=0) for m in maps])
    left, a, b = np.arange(len(nodes)), [], []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            differ = np.bitwise_count(grid[left] ^ grid[x]).sum(axis=1)
            near = (differ * (100 + num) <= (size[left] + size[x]) * (100 - num)) & (100 * np.minimum(size[left], size[x]) >= num * np.maximum(size[left], size[x]))
            near[near] = [jaccard.may_link(sizes[x], maps[x], sizes[y], maps[y], num) for y in left[near]]
            found, left = left[near].tolist(), left[~near]
            a += [nodes[x]] * len(found)
            b += [nodes[y] for y in found]
            todo += found
    return a, b


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 85, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links, itself included), kept (it is that id)."""
    found = materialize(jaccard.sets(docs, n, partial(bands_of, bands=bands, rows=rows), id_col, text_col, max(8, docs.count() // jaccard.DOCS_PER_BUCKET)))
    nodes = jaccard.nodes_of(found)
    met = materialize(owners(found))
    pairs = jaccard.named(met.where("key is null").select("a", "b").distinct(), found, nodes, "a", "b").where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    crowd = materialize(jaccard.named(met.where("key is not null").select("key", "a"), found, nodes, "a").distinct())
    edges = jaccard.linkable(pairs, found, num).unionByName(reached(crowd, found, num))
    links = jaccard.region_links(jaccard.regions_of(docs, edges, n, id_col, text_col), num, jaccard.TASK_ROWS, 3)
    return jaccard.labelled(found, nodes, links, id_col).withColumn("kept", F.col(id_col) == F.col("component_id"))
