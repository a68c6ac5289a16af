"""Exact Jaccard join of shingle sets in metric space.

Sets are linked at Jaccard similarity `num`/100 or more, that is within distance
eps = 1 - num/100 of a metric. Four steps, each exact:

1. Equal sets become one node, named by its smallest id.
2. Nodes without a partner leave. Seen from the empty set as pivot, a set's symmetric
   difference distance is its size, so linked sets lie in the same or neighbouring size
   shells; sets near a shell's border are copied to the next one. In a shell, shingles are
   dealt into parts by hash, more of them than linked sets have differences, so linked sets
   agree on a whole part. Owners of a part meet pair by pair if they are few; pairs whose
   parity bitmaps differ in more bits than linked sets have differences go. Owners of a part
   that many share all meet its smallest owner. This is done twice: first with each set's
   smallest keys, of which near copies share some, then with all keys, but only for owners
   that the first time hasn't connected. So near copies, which share most of their keys, aren't told by
   each of them. What is left in pairs, with all that it has pairs with, forms regions; no link
   crosses them.
3. In each region of more than two nodes, pivots (members with the smallest hashes) make
   Voronoi cells. A node is copied to every cell whose pivot is at most 2 eps further than its
   own; by the triangle inequality each linked pair meets in the cell of either one. One more
   site, the outside, is at distance OUTSIDE eps from every node: a constant changes by nothing
   between linked nodes, as the triangle inequality asks. Nodes that are far from all pivots
   are its cell, and are not copied to cells that they share nothing with. Cells are cut again
   with new pivots, until they hold at most two nodes or stop getting smaller.
4. Nodes within eps of a pivot are linked by it, and pairs that are connected already aren't
   looked at again. What is left in a cell is counted together. Links give components.

Cells of up to `task_rows` nodes are cut inside a task, larger ones over the cluster by the
same rules. Where a large cell doesn't get smaller, blocks of it meet pairwise, without the
pairs of nodes that its busiest pivot has linked.

Defined results: a null or blank text has an empty set, linked with nothing (component: its
own id); a null id has no component and takes part in no link; rows that share an id are
one node; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from paperloom.llm.common import materialize, settled, text_batches

BASE = np.uint64(0x9E3779B97F4A7C15)
SQUARE = np.uint64(0x9E3779B97F4A7C15**2 & 0xFFFFFFFFFFFFFFFF)
MIX = np.uint64(0xD6E8FEB86659FD93)
DICTIONARY = 300_000
#: Largest cell that one task joins, most pivots of a larger one, and rows up to which a semi join may broadcast its ids.
TASK_ROWS, PIVOTS, BROADCAST_ROWS = 2048, 64, 500_000
#: Distance of the outside in eps: above 2, so that a pivot is in no reach of it; little above, so that strangers (distance 1) are in no reach of a pivot.
OUTSIDE = 2.25


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * BASE
    return h ^ (h >> np.uint64(32))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, n: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; words end at space and 09 to 0D, A-Z are lower-cased, as bytes do."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(hashes) > DICTIONARY:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(words) < n:
        return np.array([xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * BASE + h[k : len(h) - n + 1 + k]
    return np.unique(mixed(out))


class Shells:
    """Size shells with their numbers of parts, for links at num/100 or more."""

    def __init__(self, num: int) -> None:
        self.num, self.lo, self.hi = num, [1], []
        while self.lo[-1] < 1 << 40:
            self.hi.append(max(self.lo[-1], int(self.lo[-1] / min(0.75, num / 100))))
            self.lo.append(self.hi[-1] + 1)
        # |A xor B| <= (|A| + |B|) (1 - j) / (1 + j) for similarity j
        self.most = [2 * h * (100 - num) // (100 + num) for h in self.hi]

        # So many that a set in the shell has some 1.2 times as many non-empty parts as it can have differences.
        self.parts = [2 + lo * 16 * (100 - num) // (10 * num) for lo in self.lo]

    def of(self, size: int) -> Iterator[int]:
        """Shells of a set: its own, and the next if a larger linked set can be there; none where only equal sets are linked."""
        k = int(np.searchsorted(self.lo, size, side="right")) - 1
        for s in (k, k + 1):
            if (s == k or size * 100 // self.num >= self.lo[s]) and self.most[s]:
                yield s


ROUNDS = 6


def signatures(items: np.ndarray, shells: Shells, frequent: np.ndarray | None = None) -> np.ndarray:
    """Keys of a set, one per shell and part that isn't empty.

    Shingles of `frequent` (sorted) are left out at first, so that strangers don't meet in a passage that very many
    documents have: what two sets differ in gets no more by that.

    A set of s elements differs from a linked one in at most d = s (100 - num) / num. Of its
    parts that aren't empty all but d are equal in both, so if there are more than d, the two
    share a key. Sets with fewer deal their elements again by another hash; if both are such
    sets, they meet there. Sets that have too few in all rounds take T + 2 parts, T being the
    most differences in the shell, and pairs of empty parts as keys too: they agree on two parts.
    """
    out = []
    most = len(items) * (100 - shells.num) // shells.num
    rare = items
    if frequent is not None and len(frequent):
        rare = items[frequent[np.minimum(np.searchsorted(frequent, items), len(frequent) - 1)] != items]

    def deal(salt: int, parts: int, items: np.ndarray = items) -> np.ndarray:
        """Adds the keys of one deal, and gives the parts that aren't empty."""
        if not len(items):
            return items
        part = ((mixed(items + np.uint64(salt)) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        heads = np.flatnonzero(np.diff(part[order], prepend=-1))
        ids = part[order][heads].astype(np.uint64)
        sums = np.add.reduceat(mixed(items[order] ^ np.uint64(salt)), heads)
        out.append(mixed(sums * BASE + ids + np.uint64(salt)))
        return ids

    for shell in shells.of(len(items)):
        if len(deal((shell + 1) * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF, shells.parts[shell], rare)) > most:
            continue
        for k in range(ROUNDS):
            if len(deal(((shell * 8 + k) + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF, shells.parts[shell])) > most:
                break
        else:
            salt, parts = ((shell * 8 + 7) + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF, shells.most[shell] + 2
            gone = np.setdiff1d(np.arange(parts, dtype=np.uint64), deal(salt, parts))
            a, b = np.triu_indices(len(gone), 1)
            out.append(mixed(mixed(gone[a] + np.uint64(salt)) * SQUARE + gone[b]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


#: One in so many documents is surveyed; a shingle that so many of these have is frequent; most that are kept.
SURVEYED, FREQUENT, MOST_FREQUENT = 16, 3, 200_000


def frequent_shingles(docs: DataFrame, n: int, text_col: str) -> np.ndarray:
    """Sorted hashes of the shingles that most documents have. They steer which keys sets meet by, never what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), n, hashes).view(np.int64))], names=["h"])

    some = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SURVEYED)) == 0)
    counts = text_batches(some).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").toPandas()
    return np.sort(found["h"].to_numpy(np.int64).view(np.uint64))


def planes(x: np.ndarray) -> bytes:
    """Sorted whole numbers as the bytes of their differences, first bytes first, so that zeros are together."""
    gaps = np.diff(x.astype(np.uint64), prepend=np.uint64(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, n).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def packed(keys: np.ndarray, owner: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> tuple[int, int, bytes]:
    """Sorted keys with the ids of their owners and these ids' labels as one string; how many keys and ids it has."""
    used, at = np.unique(owner, return_inverse=True)
    order = np.argsort(ids[used], kind="stable")
    named, place = ids[used][order], np.argsort(order, kind="stable")[at]
    apart = (named - labels[used][order]).view(np.uint8).reshape(-1, 8).T.tobytes()
    data = planes(keys) + planes(named.view(np.uint64)) + apart + place.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(keys), len(named), pa.compress(data, "zstd", asbytes=True)


def unpacked(n: int, m: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, their owners and the owners' labels."""
    raw = pa.decompress(data, 12 * n + 16 * m, "zstd", asbytes=True)
    place = np.frombuffer(raw[8 * n + 16 * m :], np.uint8).reshape(4, n).T.copy().view(np.uint32).ravel()
    named = unplaned(raw[8 * n : 8 * (n + m)], m).view(np.int64)
    labels = named - np.frombuffer(raw[8 * (n + m) : 8 * n + 16 * m], np.uint8).reshape(8, m).T.copy().view(np.int64).ravel()
    return unplaned(raw[: 8 * n], n), named[place], labels[place]


#: Owners of a key up to which each two of them are a pair. A pair comes from as many buckets as it shares keys in, so few.
PAIRED = 16


def met_pairs(keys: np.ndarray, ids: np.ndarray, paired: int, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(id, larger id) of owners of a key with unlike labels, once each: all pairs of up to `paired` owners, in a second
    list the smallest of more with the smallest of each other label. Without labels each id is its own.
    """
    labels = ids if labels is None else labels
    order = np.lexsort((ids, keys))
    keys, ids, labels = keys[order], ids[order], labels[order]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
    keys, ids, labels = keys[fresh], ids[fresh], labels[fresh]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    starts = np.flatnonzero(first)
    count = np.diff(np.append(starts, len(keys)))
    size, head = np.repeat(count, count), np.repeat(starts, count)
    many = np.flatnonzero((size > paired) & (labels != labels[head]))
    many = many[np.lexsort((ids[many], labels[many], head[many]))]
    many = many[np.concatenate([[True], (head[many][1:] != head[many][:-1]) | (labels[many][1:] != labels[many][:-1])])[: len(many)]]
    stars = np.stack([ids[head[many]], ids[many]], 1)
    few = np.flatnonzero((size > 1) & (size <= paired))
    pairs = [np.zeros((0, 2), np.int64)]
    for step in range(1, paired):
        at = few[few + step < head[few] + size[few]]
        if not len(at):
            break
        at = at[labels[at] != labels[at + step]]
        pairs.append(np.unique(np.stack([ids[at], ids[at + step]], 1), axis=0))
    return np.unique(np.concatenate(pairs), axis=0), np.unique(stars, axis=0) if len(stars) else stars


def parity_bits(items: np.ndarray) -> bytes:
    """A bit for each place, of a power of two of at least 64 and the set's size: whether an odd number of hashes fall there.

    Each difference of two sets turns one bit, so they have at least as many differences as bits that differ.
    """
    n = max(64, 1 << (len(items) - 1).bit_length())
    odd = np.bincount((mixed(items) >> np.uint64(17)).astype(np.int64) & (n - 1), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, n: int) -> int:
    """The bitmap of the same set with n places."""
    x, m = int.from_bytes(bits, "little"), 8 * len(bits)
    while m > n:
        m //= 2
        x = (x >> m) ^ (x & (1 << m) - 1)
    return x


def may_link(a: int, a_bits: bytes, b: int, b_bits: bytes, num: int) -> bool:
    """Whether sets of these sizes and bitmaps can be linked; halves of the longer bitmap are laid on each other first."""
    if 100 * min(a, b) < num * max(a, b):
        return False
    n = 8 * min(len(a_bits), len(b_bits))
    return (folded(a_bits, n) ^ folded(b_bits, n)).bit_count() * (100 + num) <= (a + b) * (100 - num)


FOUND = "id long, n_shingles long, set binary, bits binary, keys binary, n_buckets int"
CHUNK_CHARS, CHUNK_KEYS, DOCS_PER_BUCKET = 8_000_000, 1_000_000, 2000


def sets(docs: DataFrame, n: int, keys_of: Callable[[np.ndarray], np.ndarray], id_col: str, text_col: str, n_buckets: int) -> DataFrame:
    """A row per document: id, n_shingles, set (its 128-bit digest, null if empty), bits, sorted keys and the number of
    buckets that keys will be dealt to. Of equal sets of a chunk of documents only the first has keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, size = Hashes(), set(), 0
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1)):
                text = text.as_py()
                items = shingle_set(text, n, hashes)
                digest = xxh3_128_digest(items.tobytes()) if len(items) else None
                keys = None
                if digest is not None and i is not None and digest not in seen:
                    seen.add(digest)
                    keys = np.sort(keys_of(items)).tobytes()
                rows.append((i, len(items), digest, parity_bits(items) if len(items) else None, keys, n_buckets))
                size += len(text or "")
                if size >= CHUNK_CHARS:
                    seen, size = set(), 0
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=[f.split()[0] for f in FOUND.split(", ")])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return text_batches(rows).mapInArrow(run, FOUND)


def dealt(rows: DataFrame, first: int | None = None) -> DataFrame:
    """bucket, n_keys, n_ids, packed: the keys of a chunk of `rows` (of sets, and label, if there is one) for one bucket,
    packed; of each row all keys, or the `first` smallest.
    """
    label = F.coalesce("label", "id") if "label" in rows.columns else F.col("id")

    def found(keys: list[np.ndarray], ids: list[int], labels: list[int], n_buckets: int) -> pa.RecordBatch:
        own = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
        names, marks, all_keys = np.array(ids, np.int64), np.array(labels, np.int64), np.concatenate(keys)
        to = (mixed(all_keys) % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((all_keys, to))
        all_keys, own, to = all_keys[order], own[order], to[order]
        cut = np.concatenate([np.flatnonzero(np.diff(to, prepend=-1)), [len(to)]])
        out = [(int(to[lo]), *packed(all_keys[lo:hi], own[lo:hi], names, marks)) for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist())]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 4, types)], names=["bucket", "n_keys", "n_ids", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, labels, size, n_buckets = [], [], [], 0, 1
        for batch in batches:
            for i, mark, n_buckets, data in zip(*(c.to_pylist() for c in batch.columns)):
                keys.append(np.frombuffer(data, np.uint64)[:first])
                ids.append(i)
                labels.append(mark)
                size += len(keys[-1])
                if size >= CHUNK_KEYS:
                    yield found(keys, ids, labels, n_buckets)
                    keys, ids, labels, size = [], [], [], 0
        if ids:
            yield found(keys, ids, labels, n_buckets)

    some = rows.where("keys is not null").select("id", label.alias("label"), "n_buckets", "keys")
    return text_batches(some).mapInArrow(run, "bucket long, n_keys int, n_ids int, packed binary")


def meetings(chunks: DataFrame) -> DataFrame:
    """(a, b, star) of documents with unlike labels that share a key; star tells that b stands for others, too, that have the key."""

    def far(table: pa.Table) -> pa.Table:
        got = [unpacked(*x) for x in zip(*(table.column(c).to_pylist() for c in ("n_keys", "n_ids", "packed")))]
        keys, ids, labels = (np.concatenate(c) for c in zip(*got))
        pairs, stars = met_pairs(keys, ids, PAIRED, labels)
        both = np.concatenate([pairs, stars])
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64()), "star": pa.array(np.arange(len(both)) >= len(pairs))})

    return chunks.groupBy("bucket").applyInArrow(far, "a long, b long, star boolean").groupBy("a", "b").agg(F.max("star").alias("star"))


def linkable(pairs: DataFrame, rows: DataFrame, num: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sizes and bitmaps let them be linked."""
    of = lambda k: rows.where("set is not null").select(F.col("id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [may_link(*x, num) for x in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    met = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    return met.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): of nodes joined by links (a, b), directly or over others, root is the smallest.

    Rounds of hooking each root to the smallest root next to it, then halving the paths.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both)
    label = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root")
    label = materialize(label)
    while True:
        other = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").join(label.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        hook = other.where("rb < ra").groupBy(F.col("ra").alias("root")).agg(F.min("rb").alias("to"))
        hook = materialize(hook)
        if hook.isEmpty():
            return label
        label = label.join(hook, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        for _ in range(2):  # a root may itself have been hooked
            up = label.select(F.col("node").alias("root"), F.col("root").alias("up"))
            label = materialize(label.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))


def overlaps(members: list[np.ndarray], pivots: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets with those at `pivots`, counted together."""
    m = len(members)
    _, item = np.unique(np.concatenate(members), return_inverse=True)
    row = np.repeat(np.arange(m), [len(x) for x in members])
    order = np.argsort(item, kind="stable")
    item, row = item[order], row[order]
    shared = np.bincount(item)[item] > 1
    item, row = item[shared], row[shared]
    both = np.zeros((m, len(pivots)), np.float32)
    if len(item):
        item = np.cumsum(np.diff(item, prepend=item[0]) != 0)
        step = max(64, min(4096, (1 << 22) // m))
        for lo in range(0, int(item[-1]) + 1, step):
            a, b = np.searchsorted(item, [lo, lo + step])
            grid = np.zeros((m, step), np.float32)
            grid[row[a:b], item[a:b] - lo] = 1
            both += grid @ grid[pivots].T
    sizes = np.array([len(x) for x in members])
    both = both.astype(np.int64)
    both[pivots, np.arange(len(pivots))] = sizes[pivots]
    return both


def windows(both: np.ndarray, sizes: np.ndarray, pivot_sizes: np.ndarray, num: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which sets are linked to which pivots, each set's home (the last is the outside), and the cells within its 2 eps window."""
    either = sizes[:, None] + pivot_sizes[None, :] - both
    eps = (100 - num) / 100
    far = np.column_stack([1 - both / either, np.full(len(sizes), OUTSIDE * eps)])
    home = far.argmin(axis=1)
    reach = far <= far.min(axis=1, keepdims=True) + 2 * eps + 1e-9
    return 100 * both >= num * either, home, reach


class Forest:
    """Which rows are connected, and the links that connected them."""

    def __init__(self, n: int) -> None:
        self.up, self.links = list(range(n)), []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        rx, ry = self.root(x), self.root(y)
        if rx != ry:
            self.up[max(rx, ry)] = min(rx, ry)
            self.links.append((x, y))

    def connected(self, rows: np.ndarray) -> bool:
        return len({self.root(x) for x in rows.tolist()}) < 2


class Region:
    """The join of some sets, cut into cells by pivots of its own; `n_cuts` and `n_cells` tell how often."""

    def __init__(self, nodes: list[int], members: list[np.ndarray], own: np.ndarray, num: int) -> None:
        self.members, self.own, self.num = members, own, num
        self.sizes = np.array([len(x) for x in members])
        self.rank = mixed(np.array(nodes, np.int64).view(np.uint64))
        self.forest = Forest(len(nodes))
        self.n_cuts = self.n_cells = 0
        self.cut(np.arange(len(nodes)), own)

    def count(self, rows: np.ndarray, own: np.ndarray) -> None:
        """Links of a cell that isn't cut any further."""
        if not own.any() or self.forest.connected(rows):
            return
        both = overlaps([self.members[i] for i in rows], np.arange(len(rows)))
        sizes = self.sizes[rows]
        linked = 100 * both >= self.num * (sizes[:, None] + sizes[None, :] - both)
        for i, j in zip(*np.nonzero(np.triu(linked & (own[:, None] | own[None, :]), 1))):
            self.forest.join(int(rows[i]), int(rows[j]))

    def cut(self, rows: np.ndarray, own: np.ndarray) -> None:
        if not own.any() or self.forest.connected(rows):
            return
        m = len(rows)
        if m <= 2:
            self.count(rows, own)
            return
        pivots = np.sort(np.argsort(self.rank[rows], kind="stable")[: int(np.ceil(np.sqrt(m)))])
        both = overlaps([self.members[i] for i in rows], pivots)
        linked, home, reach = windows(both, self.sizes[rows], self.sizes[rows][pivots], self.num)
        self.n_cuts += 1
        for x, k in zip(*np.nonzero(linked)):
            self.forest.join(int(rows[pivots[k]]), int(rows[x]))
        if m > 8 and reach.sum(axis=0).max() > 0.8 * m:  # it doesn't get smaller
            self.count(rows, own)
            return
        self.rank[rows] = mixed(self.rank[rows])  # the next cut has other pivots
        for k in range(reach.shape[1]):
            cell = np.flatnonzero(reach[:, k])
            if len(cell) == m:
                self.count(rows, own & (home == k))
            elif len(cell) > 1:
                self.n_cells += 1
                self.cut(rows[cell], own[cell] & (home[cell] == k))


def joined_cells(cells: DataFrame, num: int, n_tasks: int) -> DataFrame:
    """Links (a, b) that connect what is linked in each cell; small cells share tasks."""

    def run(table: pa.Table) -> pa.Table:
        got: dict[tuple[int, int], list[tuple[int, bool, bytes]]] = {}
        for r, c, node, own, items in zip(*(table.column(k).to_pylist() for k in ("region", "cell", "node", "own", "items"))):
            got.setdefault((r, c), []).append((node, own, items))
        a, b = [], []
        for rows in got.values():
            rows = sorted(set(rows))
            nodes = [r[0] for r in rows]
            for i, j in Region(nodes, [np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[1] for r in rows]), num).forest.links:
                if nodes[i] != nodes[j]:
                    a.append(min(nodes[i], nodes[j]))
                    b.append(max(nodes[i], nodes[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.withColumn("task", F.pmod(F.xxhash64("region", "cell"), F.lit(n_tasks))).groupBy("task").applyInArrow(run, "a long, b long")


def voronoi(cells: DataFrame, sizes: DataFrame, num: int, level: int, task_rows: int) -> DataFrame:
    """Cuts large cells (sizes: region, cell, m) by the pivots of their own rows with the smallest hashes.

    Gives region, parent (the cell that was cut), cell, node, own and near: on the row at its home, the
    pivot that links it. The sets stay behind, as a cut that makes nothing smaller would copy them in vain.
    """
    order = Window.partitionBy("region", "cell").orderBy(F.xxhash64("node", F.lit(level)), "node")
    first = cells.where("own").withColumn("k", F.row_number().over(order)).where(F.col("k") <= PIVOTS)
    sized = sizes.withColumn("n", F.ceil(F.col("m") / 1000))
    pivots = first.join(sized, ["region", "cell"]).where(F.col("k") <= F.ceil(4 * F.col("m") / task_rows))
    pivots = materialize(pivots.select("region", "cell", "n", "k", "node", "items"))
    pivots = pivots.select("region", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("part"), "k", "node", "items")
    rows = cells.join(sized, ["region", "cell"]).select("region", "cell", F.pmod(F.xxhash64("node", F.lit(29)), "n").alias("part"), "node", "own", "items")

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        got, sites = rows.to_pylist(), sorted(pivots.to_pylist(), key=lambda p: p["k"])
        out = []
        if got and sites:
            members = [np.frombuffer(r["items"], np.uint64) for r in sites + got]
            lengths, n = np.array([len(x) for x in members]), len(sites)
            both = overlaps(members, np.arange(n))[n:]
            linked, home, reach = windows(both, lengths[n:], lengths[:n], num)
            for i, r in enumerate(got):
                for k in np.flatnonzero(reach[i]).tolist():
                    at_home = k == home[i]
                    near = sites[k]["node"] if at_home and k < n and linked[i, k] else None
                    out.append({"region": r["region"], "parent": r["cell"], "cell": r["cell"] * (PIVOTS + 2) + k + 1, "node": r["node"], "own": r["own"] and at_home, "near": near})
        return pa.Table.from_pylist(out, schema=pa.schema([("region", pa.int64()), ("parent", pa.int64()), ("cell", pa.int64()), ("node", pa.int64()), ("own", pa.bool_()), ("near", pa.int64())]))

    key = ("region", "cell", "part")
    return rows.groupBy(*key).cogroup(pivots.groupBy(*key)).applyInArrow(run, "region long, parent long, cell long, node long, own boolean, near long")


def block_pairs(cells: DataFrame, cut: DataFrame, half: int) -> DataFrame:
    """Cells that pivots don't make smaller, as pairs of blocks of about `half` rows: each two rows meet in one.

    Rows that the busiest pivot of the cell has linked don't meet each other.
    """
    near = cut.where("near is not null").select("region", F.col("parent").alias("cell"), "node", "near")
    busy = near.groupBy("region", "cell", "near").count().groupBy("region", "cell").agg(F.max(F.struct("count", "near"))["near"].alias("near"))
    done = near.join(busy, ["region", "cell", "near"]).select("region", "cell", "node", F.lit(True).alias("done"))
    rows = cells.join(done, ["region", "cell", "node"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
    n_of = lambda c: F.ceil(F.sum(F.col(c).cast("int")) / half)
    sizes = rows.withColumn("open", ~F.col("done")).groupBy("region", "cell").agg(n_of("done").alias("n_done"), n_of("open").alias("n_open"))
    rows = rows.join(sizes, ["region", "cell"]).where("n_open > 0").withColumn("n", F.col("n_done") + F.col("n_open"))
    h = F.xxhash64("node", F.lit(17))
    mine = F.when(F.col("done"), F.pmod(h, F.greatest("n_done", F.lit(1)))).otherwise(F.col("n_done") + F.pmod(h, "n_open"))
    others = F.sequence(F.when(F.col("done"), F.col("n_done")).otherwise(F.lit(0).cast("long")), F.col("n") - 1)
    rows = rows.select("region", "cell", "node", "own", "items", "n", mine.alias("i"), F.explode(others).alias("j"))
    pair = F.least("i", "j") * F.col("n") + F.greatest("i", "j")
    return rows.select("region", F.xxhash64("cell", pair).alias("cell"), "node", "own", "items")


def region_links(regions: DataFrame, num: int, task_rows: int, levels: int) -> DataFrame:
    """Links that connect what is linked in all regions (region, node, items)."""
    cells = materialize(regions.select("region", F.lit(0).cast("long").alias("cell"), "node", F.lit(True).alias("own"), "items"))
    key, found = ["region", "cell"], []

    def join_all(rows: DataFrame) -> None:
        found.append(joined_cells(rows, num, max(8, rows.count() // 1000)))

    for level in range(levels + 1):
        large = materialize(cells.groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > task_rows))
        total = large.agg(F.max("m").alias("top"), F.sum("m").alias("rows")).first()
        join_all(cells.join(large, key, "left_anti"))
        if total.top is None:
            break
        rest = materialize(cells.join(large.select(*key), key, "left_semi"))
        cut = materialize(voronoi(rest, large, num, level, task_rows))
        found.append(cut.where("near <> node").select(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")))
        now = cut.groupBy(*key).agg(F.count("*").alias("m")).agg(F.max("m").alias("top"), F.sum("m").alias("rows")).first()
        if level == levels or now.top > 0.8 * total.top or now.rows > 4 * total.rows:
            join_all(materialize(block_pairs(rest, cut, task_rows // 2)))
            break
        items = rest.select("region", F.col("cell").alias("parent"), "node", "items")
        cells = materialize(cut.join(items, ["region", "parent", "node"]).select("region", "cell", "node", "own", "items"))
    return materialize(reduce(DataFrame.unionByName, found).distinct())


def named(met: DataFrame, rows: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """`met` with each column's ids replaced by their nodes; a set's keys may have come under several of its ids."""
    ids = reduce(DataFrame.union, [met.select(F.col(c).alias("id")) for c in columns]).distinct()
    names = materialize(rows.where("set is not null").select("id", "set").join(ids, "id", "left_semi").distinct().join(nodes, "set").select("id", "node"))
    for c in columns:
        met = met.join(names.select(F.col("id").alias(c), F.col("node").alias("_node")), c).drop(c).withColumnRenamed("_node", c)
    return met


#: Smallest keys of a set by which it meets others first.
LEADING = 4


def edges_of(rows: DataFrame, nodes: DataFrame, num: int) -> DataFrame:
    """(a, b) of nodes: pairs that can be linked, and owners of a key of many, each with the smallest of them.

    What the smallest keys connect isn't told again: copies and what is connected have the same label.
    """

    def told(chunks: DataFrame) -> DataFrame:
        met = named(materialize(meetings(chunks)), rows, nodes, "a", "b").where("a <> b")
        met = materialize(met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("star").alias("star")))
        return linkable(met.where("not star"), rows, num).unionByName(met.where("star").select("a", "b"))

    near = components(told(dealt(rows, LEADING)))
    of_sets = nodes.join(near, "node", "left").select("set", F.coalesce("root", "node").alias("label"))
    labels = materialize(rows.where("keys is not null").select("id", "set").join(of_sets, "set").where("label <> id").select("id", "label").distinct())
    hint = F.broadcast if labels.count() <= BROADCAST_ROWS else lambda x: x
    rest = told(dealt(rows.select("id", "n_buckets", "keys").where("keys is not null").join(hint(labels), "id", "left")))
    return rest.unionByName(near.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))


def regions_of(docs: DataFrame, edges: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """region, node, items of the nodes joined by edges, directly or over others."""
    regions = materialize(components(edges).select("node", F.col("root").alias("region")))
    # The sets of nodes in regions are made anew from their texts, rather than kept for all documents.
    wanted = regions.select(F.col("node").alias("id"))
    hint = F.broadcast if regions.count() <= BROADCAST_ROWS else lambda x: x

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            items = [shingle_set(t.as_py(), n, hashes).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(items, pa.binary())], names=["node", "items"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(hint(wanted), "id", "left_semi")
    items = texts.mapInArrow(again, "node long, items binary").where(F.octet_length("items") > 0)
    return items.join(hint(regions), "node")


def nodes_of(rows: DataFrame) -> DataFrame:
    """(set, node): the smallest id of each set."""
    return materialize(rows.where("id is not null and set is not null").groupBy("set").agg(F.min("id").alias("node")))


def labelled(rows: DataFrame, nodes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """Per document of `rows`: id, n_shingles, component_id by the links (a, b) of nodes."""
    out = rows.join(nodes, "set", "left").join(components(links), "node", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("root", "node", "id").alias("component_id"))


def link(docs: DataFrame, n: int = 3, num: int = 90, id_col: str = "doc_id", text_col: str = "text", task_rows: int = TASK_ROWS, levels: int = 3) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    keys_of = partial(signatures, shells=Shells(num), frequent=frequent_shingles(docs, n, text_col))
    rows = materialize(sets(docs, n, keys_of, id_col, text_col, max(8, docs.count() // DOCS_PER_BUCKET)))
    nodes = nodes_of(rows)
    return labelled(rows, nodes, region_links(regions_of(docs, edges_of(rows, nodes, num), n, id_col, text_col), num, task_rows, levels), id_col)


def keep_one(docs: DataFrame, n: int = 3, num: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs`, all columns, with one document of each component: that with the smallest id.

    Rows with a null id stay. Of rows that share an id one stays.
    """
    found = settled(lambda: link(docs, n, num, id_col, text_col))
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    twice = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col)
    small = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROWS else x
    out = docs.join(small(gone), id_col, "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return out
    hint = small(twice)
    return out.join(hint, id_col, "left_anti").select(*docs.columns).unionByName(out.join(hint, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns))
