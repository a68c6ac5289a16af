"""Hard negatives by zone maps over Hilbert-ordered blocks.

Entries c become x = floor(256 c); the score of two rows is the inner product of their x. For each
anchor and each of its first positives (rows of its label, best scores first), the best rows of
other labels with `low` to 100 hundredths of the positive's score are its hard negatives.

1. Rows are ordered along a Hilbert curve through the cells that each dimension's mean and
   deviation cut, and packed into zones: a Parquet row each, with the least and the greatest entry
   of every dimension and the labels that occur.
2. Anchors travel in groups, which neighbours on the curve form. Interval arithmetic on a zone's
   entries bounds the scores of all its rows for an anchor from both sides. A zone is read for an
   anchor only if the bounds reach one of its windows and a row of a wanted label is there.
   The window of positives opens at the score of the worst of as many as are wanted in the
   anchor's own zone; those of negatives are what the positives leave.
3. Groups meet the zones that they chose, bundles of neighbouring zones in a task; the best of
   each bundle are the candidates of which the best are taken.

Groups and zone maps meet in blocks of both, which is a stated query set against all rows; groups
that chose the same bundle are dealt to as many tasks as their number asks for. Neither a label
nor a vector that very many rows have comes into one task: zones are cut by position.

Bounds prune where vectors lie in clusters; where all are strangers in many dimensions every zone
may be chosen. The result is exact either way.

Defined results: rows with a null id, label or vector, or with null or non-finite entries, take
no part. Rows equal in id, label and vector count once; other rows that share an id are rows of
their own, but never positives of an anchor with that id. Vectors of different widths never meet.
Anchors without positives, and positives without negatives, give no rows; so does an empty table.
Other columns are ignored. Scores must be below 2^56 in size, else an OverflowError is raised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import materialize
from paperloom.llm.whitening import by_width, whole_entries

#: Rows of a sorted partition and most partitions; entries and most rows of a zone; zones of a bundle as a power of two.
PART_ROWS, MOST_PARTS, ZONE_ENTRIES, ZONE_ROWS, BUNDLE = 8192, 50_000, 32_768, 1024, 4
#: Anchors of a group, groups and zone maps that meet in a task of the choice, and groups of a task that reads a bundle.
GROUP, GROUPS, MAPS, READERS = 128, 128, 2048, 32
BITS = 2
ZONE = "zone long, width int, ids binary, labels binary, anchors binary, xs binary, lo binary, hi binary, kinds array<long>"
ANCHORS = "group long, width int, ids binary, labels binary, xs binary, low binary, high binary, positives binary"


def hilbert(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Places on the Hilbert curve of rows of cell numbers below 2^bits, as strings that sort like the places."""
    x = cells.astype(np.int64).copy()
    m, d = x.shape
    if not d:
        return [b""] * m
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(high, q - 1, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(m, np.int64)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        turn ^= np.where(x[:, d - 1] & q, q - 1, 0)
    x ^= turn[:, None]
    planes = np.concatenate([(x >> k) & 1 for k in range(bits - 1, -1, -1)], axis=1).astype(np.uint8)
    return [row.tobytes() for row in np.packbits(planes, axis=1)]


def small(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them, its width first."""
    most = int(np.abs(x).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def unsmall(data: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(data, f"i{data[0]}", offset=1).reshape(n, width).astype(np.int64)


def numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if most >= 2.0**56:
        raise OverflowError("scores of 2^56 and more")
    return (a.astype(float) @ x.T.astype(float)).astype(np.int64) if most < 2.0**52 else a @ x.T


def best(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values, ties by smaller id."""
    at = np.arange(len(values))
    if len(at) > k:
        at = np.flatnonzero(values >= np.partition(values, -k)[-k])
    return at[np.lexsort((ids[at], -values[at]))][:k]


def grid_of(points: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """By width: number of vectors, and mean and deviation of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, (_, x) in by_width(batch.column(0)):
                if width:
                    yield pa.RecordBatch.from_arrays([pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([len(x)] * width, pa.int64()), pa.array(x.sum(axis=0, dtype=float)), pa.array((x.astype(float) ** 2).sum(axis=0))], names=["width", "at", "n", "s", "q"])

    sums = points.select("x").mapInArrow(run, "width int, at int, n long, s double, q double").groupBy("width", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    out: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for width, rows in sums.orderBy("width", "at").toPandas().groupby("width"):  # a row for each dimension
        n, mean = int(rows["n"].iloc[0]), (rows["s"] / rows["n"]).to_numpy()
        out[int(width)] = (n, mean, np.sqrt(np.maximum((rows["q"] / rows["n"]).to_numpy() - mean * mean, 1e-9)))
    return out


def zones_of(points: DataFrame) -> DataFrame:
    """Zones of all rows (id, label, anchor, x) in the curve's order."""
    grid = grid_of(points)
    n_parts = max(1, min(MOST_PARTS, -(-sum(n for n, _, _ in grid.values()) // PART_ROWS)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, widths = np.empty(batch.num_rows, object), np.empty(batch.num_rows, np.int32)
            for width, (at, x) in by_width(batch.column(3)):
                _, mean, deviation = grid.get(width, (0, np.zeros(width), np.ones(width)))
                keys[at] = hilbert(np.clip(np.floor((x - mean) / deviation) + (1 << BITS - 1), 0, (1 << BITS) - 1))
                widths[at] = width
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(widths), pa.array(keys.tolist(), pa.binary())], names=["id", "label", "anchor", "x", "width", "key"])

    placed = points.mapInArrow(place, "id long, label long, anchor boolean, x array<long>, width int, key binary")
    order = ["width", "key", "id", "label", "x"]
    placed = placed.repartitionByRange(n_parts, *order).sortWithinPartitions(*order, F.desc("anchor")).withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bool, np.ndarray]] = []
        k = 0

        def zone(part: int) -> pa.RecordBatch:
            xs = np.stack([r[3] for r in held])
            labels = np.array([r[1] for r in held], np.int64)
            row = {"zone": part << 24 | k, "width": xs.shape[1], "ids": np.array([r[0] for r in held], np.int64).tobytes(), "labels": labels.tobytes(), "anchors": bytes(r[2] for r in held), "xs": small(xs)}
            return pa.RecordBatch.from_pylist([row | {"lo": xs.min(axis=0).tobytes(), "hi": xs.max(axis=0).tobytes(), "kinds": np.unique(labels).tolist()}], schema=ZONE_SCHEMA)

        part, last = 0, None
        for batch in batches:
            xs: list = [None] * batch.num_rows
            for _, (at, x) in by_width(batch.column(3)):
                for i, row in zip(at.tolist(), x):
                    xs[i] = row
            part = batch.column(6)[0].as_py() if batch.num_rows else part
            for i, label, anchor, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), xs):
                now = (i, label, x.tobytes())
                if now == last:
                    continue
                if held and (len(held) >= min(ZONE_ROWS, max(32, ZONE_ENTRIES // max(1, len(x)))) or len(held[0][3]) != len(x)):
                    yield zone(part)
                    held, k = [], k + 1
                held.append((i, label, anchor, x))
                last = now
        if held:
            yield zone(part)

    return materialize(placed.mapInArrow(pack, ZONE))


ZONE_SCHEMA = pa.schema([("zone", pa.int64()), ("width", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "anchors", "xs", "lo", "hi")), ("kinds", pa.list_(pa.int64()))])
ANCHOR_SCHEMA = pa.schema([("group", pa.int64()), ("width", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "xs", "low", "high", "positives"))])


def groups_of(zones: DataFrame, k: int) -> DataFrame:
    """Anchors in groups. Their one window opens at the score of the k-th best of their label in their own zone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def group() -> pa.RecordBatch:
            name, width = held[0][:2]
            ids, labels, low = (np.array([r[c] for r in held], t) for c, t in ((2, np.int64), (3, np.int64), (5, float)))
            row = {"group": name, "width": width, "ids": ids.tobytes(), "labels": labels.tobytes(), "xs": small(np.stack([r[4] for r in held])), "low": low.tobytes(), "high": np.full(len(held), np.inf).tobytes(), "positives": b""}
            return pa.RecordBatch.from_pylist([row], schema=ANCHOR_SCHEMA)

        for batch in batches:
            for r in batch.to_pylist():
                ids, labels = numbers(r["ids"]), numbers(r["labels"])
                mine = np.flatnonzero(np.frombuffer(r["anchors"], np.uint8))
                if not len(mine):
                    continue
                x = unsmall(r["xs"], r["width"], len(ids))
                own = scores(x[mine], x)
                for at, row in zip(mine.tolist(), own):
                    same = row[(labels == labels[at]) & (ids != ids[at])]
                    low = float(np.partition(same, -k)[-k]) if len(same) >= k else -np.inf
                    if held and (len(held) >= GROUP or held[0][1] != r["width"]):
                        yield group()
                        held = []
                    held.append((r["zone"] << 10 | at, r["width"], ids[at], labels[at], x[at], low))
        if held:
            yield group()

    return materialize(zones.select("zone", "width", "ids", "labels", "anchors", "xs").mapInArrow(run, ANCHORS))


def chosen(groups: DataFrame, zones: DataFrame, same: bool) -> DataFrame:
    """(group, bundle, picks): zones whose bounds reach a window of an anchor of the group, with these anchors' places.

    `same` tells whether rows of the anchor's label are wanted, or of others.
    """
    maps = zones.select("zone", "width", "lo", "hi", "kinds")
    n_rows, n_columns = (F.lit(max(1, -(-df.count() // k))) for df, k in ((groups, GROUPS), (maps, MAPS)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))
    one = groups.select("group", "width", "labels", "xs", "low", "high", F.pmod(F.xxhash64("group"), n_rows.cast("long")).alias("i"), every(n_columns).alias("j"))
    two = maps.select("*", F.pmod(F.xxhash64("zone"), n_columns.cast("long")).alias("j"), every(n_rows).alias("i"))

    def run(groups: pa.Table, maps: pa.Table) -> pa.Table:
        out = []
        zones = maps.to_pylist()
        for width in {r["width"] for r in zones}:
            these = [r for r in zones if r["width"] == width]
            lo, hi = (np.stack([numbers(r[c]) for r in these]).astype(float) for c in ("lo", "hi"))
            kinds = [r["kinds"] for r in these]
            for g in groups.to_pylist():
                if g["width"] != width:
                    continue
                labels = numbers(g["labels"])
                a = unsmall(g["xs"], width, len(labels)).astype(float)
                up, down = np.maximum(a, 0), np.minimum(a, 0)
                most, least = up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T
                most, least = most + 1 + 1e-9 * np.abs(most), least - 1 - 1e-9 * np.abs(least)
                low, high = (np.frombuffer(g[c], float).reshape(len(labels), -1) for c in ("low", "high"))
                hit = np.zeros(most.shape, bool)
                for w in range(low.shape[1]):
                    hit |= (most >= low[:, w : w + 1]) & (least <= high[:, w : w + 1])
                for z in np.flatnonzero(hit.any(axis=0)).tolist():
                    wanted = np.isin(labels, kinds[z]) if same else (labels != kinds[z][0]) | (len(kinds[z]) > 1)
                    at = np.flatnonzero(hit[:, z] & wanted)
                    if len(at):
                        out.append((g["group"], these[z]["zone"], at.astype(np.uint8).tobytes()))
        return pa.table(dict(zip(("group", "zone", "at"), (pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 3, (pa.int64(), pa.int64(), pa.binary()))))))

    picks = one.groupBy("i", "j").cogroup(two.groupBy("i", "j")).applyInArrow(run, "group long, zone long, at binary")
    return materialize(picks.groupBy("group", F.shiftright("zone", BUNDLE).alias("bundle")).agg(F.collect_list(F.struct("zone", "at")).alias("picks")))


FOUND = "anchor_at long, anchor_id long, positive long, positive_id long, positive_score long, id long, score long"


def read_zones(groups: DataFrame, zones: DataFrame, picks: DataFrame, k: int, low: int | None) -> DataFrame:
    """The k best rows of each bundle for each anchor: of its label if low is None, else of others, by window."""
    tasks = picks.groupBy("bundle").agg(F.ceil(F.count("*") / READERS).alias("n"))
    one = picks.join(tasks, "bundle").join(groups, "group").withColumn("task", F.pmod(F.xxhash64("group"), "n")).drop("n")
    two = zones.select("zone", F.shiftright("zone", BUNDLE).alias("bundle"), "ids", "labels", "xs", "width").join(tasks, "bundle").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")

    def run(groups: pa.Table, zones: pa.Table) -> pa.Table:
        out: list[tuple] = []
        rows = sorted(zones.to_pylist(), key=lambda r: r["zone"])
        for width in {r["width"] for r in rows}:
            these = [r for r in rows if r["width"] == width]
            ids, labels = (np.concatenate([numbers(r[c]) for r in these]) for c in ("ids", "labels"))
            x = np.concatenate([unsmall(r["xs"], width, len(r["ids"]) // 8) for r in these])
            ends = np.cumsum([len(r["ids"]) // 8 for r in these]).tolist()
            spans = {r["zone"]: slice(e - len(r["ids"]) // 8, e) for r, e in zip(these, ends)}
            for g in groups.to_pylist():
                if g["width"] != width:
                    continue
                mine, own = numbers(g["ids"]), numbers(g["labels"])
                seen = np.zeros((len(mine), len(ids)), bool)
                for p in g["picks"]:
                    seen[np.frombuffer(p["at"], np.uint8), spans[p["zone"]]] = True
                values = scores(unsmall(g["xs"], width, len(mine)), x)
                for i in np.flatnonzero(seen.any(axis=1)).tolist():
                    name = g["group"] << 7 | i
                    if low is None:
                        at = np.flatnonzero(seen[i] & (labels == own[i]) & (ids != mine[i]))
                        at = at[best(values[i, at], ids[at], k)]
                        out += [(name, int(mine[i]), None, None, None, int(ids[j]), int(values[i, j])) for j in at]
                        continue
                    positives = numbers(g["positives"]).reshape(len(mine), -1, 3)[i]  # there, id, score
                    positives = positives[positives[:, 0] > 0]
                    at = np.flatnonzero(seen[i] & (labels != own[i]) & (values[i] <= positives[:, 2].max()) & (100 * values[i] >= low * positives[:, 2].min()))
                    at = at[np.lexsort((ids[at], -values[i, at]))]
                    falling = -values[i, at]
                    for w, (_, p_id, p_score) in enumerate(positives.tolist()):
                        first = int(np.searchsorted(falling, -p_score))
                        out += [(name, int(mine[i]), w, p_id, p_score, int(ids[j]), int(values[i, j])) for j in at[first : first + k] if 100 * values[i, j] >= low * p_score]
        return pa.table(dict(zip((f.split()[0] for f in FOUND.split(", ")), (pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * 7)))))

    return one.groupBy("bundle", "task").cogroup(two.groupBy("bundle", "task")).applyInArrow(run, FOUND)


def with_windows(groups: DataFrame, positives: DataFrame, k: int, low: int) -> DataFrame:
    """Groups with the windows that their positives (anchor_at, place, id, score) leave; anchors without any have none."""
    lists = positives.groupBy(F.shiftright("anchor_at", 7).alias("group")).agg(F.collect_list(F.struct(F.expr("anchor_at & 127").alias("at"), "place", "id", "score")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                table = np.zeros((len(r["ids"]) // 8, k, 3), np.int64)
                for f in r.pop("found"):
                    table[f["at"], f["place"] - 1] = 1, f["id"], f["score"]
                there = table[:, :, 0] > 0
                r |= {"low": np.where(there, table[:, :, 2] * (low / 100), np.inf).tobytes(), "high": np.where(there, table[:, :, 2].astype(float), -np.inf).tobytes(), "positives": table.tobytes()}
            yield pa.RecordBatch.from_pylist(rows, schema=ANCHOR_SCHEMA)

    return materialize(groups.join(lists, "group").select(*ANCHOR_SCHEMA.names, "found").mapInArrow(run, ANCHORS))


def mine(rows: DataFrame, is_anchor: Column, k_positives: int = 5, k_negatives: int = 5, low: int = 80, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    points = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vec_col).alias("v"))
    points = whole_entries(points.where("id is not null and label is not null"), "v").select("id", "label", "anchor", "x")
    zones = zones_of(points)
    groups = groups_of(zones, k_positives)
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    positives = read_zones(groups, zones, chosen(groups, zones, True), k_positives, None)
    positives = positives.select("anchor_at", first("anchor_at").alias("place"), "id", "score").where(F.col("place") <= k_positives)
    groups = with_windows(groups, materialize(positives), k_positives, low)
    found = read_zones(groups, zones, chosen(groups, zones, False), k_negatives, low)
    found = found.withColumn("rank", first("anchor_at", "positive")).where(F.col("rank") <= k_negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
