"""Mixing sources to target weights: fixed-length blocks, multinomial shards, index permutations.

1. Targets: all sizes together are shared out by weight; a source stops at `max_repeat`
   times its own size and the excess goes to the others by weight (water filling).
2. Blocks: each source's documents form token streams of about `stream_words` words, cut into
   blocks of `block_words` words (the last of a stream is shorter); a source's quota is its
   target in blocks.
3. Shards: a source's draws, as many as its quota, are dealt to the slots of the output shards
   by a keyed permutation of all slots. The counts of a shard are thereby multinomial draws,
   given that the totals of all shards are the quotas; nothing is moved afterwards.
4. Draw j of a source, in pass j div n, takes the block to which a keyed permutation of its n
   blocks, one per source and pass, sends j mod n. So no block is used more than `max_repeat` times.
5. Slots and blocks meet by (source, block index): blocks() gives each slot with the words of
   its block, and mix() counts from the same table what each document gave.

Permutations are Feistel rounds of keyed hashes on the two digits of an index, with cycle
walking. Offsets are two-level prefix sums, so no window holds a whole source.

Defined results: size 0 for a null text or one without words (never taken); null is a
source of its own, last in order; equal ids are separate rows that share a source; an
empty table gives no rows; other columns are ignored. The same input and seed give the
same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import materialize

WEIGHTS = (5, 2, 1)
SPACE = r"[\x20\x09-\x0D]+"
#: Feistel rounds, draws that one row is expanded to, most tasks that expand them, and rows up to which a side is sent to all tasks.
ROUNDS, DRAWS, DRAW_TASKS, BROADCAST_ROWS = 4, 65_536, 4096, 100_000


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`, without keeping the words."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def targets(sized: DataFrame, max_repeat: int = 3) -> DataFrame:
    """One row per source: sid (1.. by code point, null last), source, source_size, target."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source, not per document
    weights = F.array(*map(F.lit, WEIGHTS))
    ranked = by_source.withColumn("sid", F.row_number().over(order))
    ranked = ranked.withColumn("weight", F.element_at(weights, ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    # Sources fill up in the order of cap / weight. The level at which the rest share what is left ends the filling.
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    all_rows, before = Window.partitionBy(), fill.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("left", F.sum("source_size").over(all_rows).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("rest"))  # its own weight is in, so above 0
        .withColumn("final", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(all_rows))
    )
    capped = F.col("final").isNull() | (F.col("final") * F.col("weight") > F.col("cap"))
    return filled.select("sid", "source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def small(df: DataFrame) -> DataFrame:
    """`df`, to be sent to all tasks if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def permuted(rows: DataFrame, index: str, n: str, key: list[Column], out: str) -> DataFrame:
    """Adds `out`: where a keyed permutation of 0 to n-1 sends `index`.

    An index is two digits, below a = ceil(sqrt n) and b = ceil(n / a). Each round adds a keyed
    hash of one digit to the other, which is a bijection of a * b indices. Those that
    leave 0 to n-1 go on until they are back, which takes less than a steps.
    """
    a, b, size = F.col("_a"), F.col("_b"), F.greatest(F.col(n), F.lit(1))  # nothing is drawn from no blocks, but plans of it are made

    def turn(x: Column, y: Column, k: int) -> Column:
        """Digit x after round k, with a hash of y added."""
        m = b if k % 2 else a
        return F.pmod(x + F.pmod(F.xxhash64(*key, F.lit(k), y), m), m)

    def step(v: Column) -> Column:
        x, y = F.floor(v / b), F.pmod(v, b)
        for k in range(ROUNDS):
            x, y = (x, turn(y, x, k)) if k % 2 else (turn(x, y, k), y)
        return (x * b + y).cast("long")

    rows = rows.withColumn("_a", F.ceil(F.sqrt(size))).withColumn("_b", F.floor((size + F.col("_a") - 1) / F.col("_a")))
    rows = rows.withColumns({"_x": F.floor(F.col(index) / b), "_y": F.pmod(F.col(index), b)})
    for k in range(ROUNDS):
        digit, other = ("_y", "_x") if k % 2 else ("_x", "_y")
        rows = rows.withColumn(digit, turn(F.col(digit), F.col(other), k))
    first = (F.col("_x") * b + F.col("_y")).cast("long")
    rows = rows.withColumn("_v", first)
    back = F.aggregate(F.sequence(F.lit(1).cast("long"), a), F.col("_v"), lambda v, _: F.when(v >= size, step(v)).otherwise(v))
    return rows.withColumn(out, F.when(F.col("_v") < size, F.col("_v")).otherwise(back)).drop("_a", "_b", "_x", "_y", "_v")


def drawn(plan: DataFrame, n_slots: int, shard_slots: int, seed: int) -> DataFrame:
    """(sid, source, block, shard, slot) of every draw; `plan` has sid, source, n_blocks and quota."""
    line = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)  # one row per source
    ahead = plan.where("quota > 0").select("sid", "source", "n_blocks", "quota", F.coalesce(F.sum("quota").over(line), F.lit(0)).alias("ahead"))
    last = lambda c: F.floor((F.col(c) - 1) / DRAWS)
    parts = ahead.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last("quota"))))
    # With a number of its own, so that the few small rows aren't put together before they are expanded.
    parts = parts.repartition(max(1, min(DRAW_TASKS, n_slots // DRAWS)), "sid", "part")
    first = F.col("part") * DRAWS
    rows = parts.withColumn("j", F.explode(F.sequence(first, F.least(first + DRAWS, F.col("quota")) - 1)))
    rows = rows.withColumns({"at": F.col("ahead") + F.col("j"), "n_slots": F.lit(n_slots).cast("long"), "pass": F.floor(F.col("j") / F.col("n_blocks")), "index": F.pmod("j", "n_blocks")})
    rows = permuted(rows, "at", "n_slots", [F.lit(seed)], "slot")
    rows = permuted(rows, "index", "n_blocks", [F.lit(seed), F.col("sid"), F.col("pass")], "block")
    return rows.select("sid", "source", "block", F.floor(F.col("slot") / shard_slots).alias("shard"), "slot")


def pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """sid, bucket, block (in its stream), id, size, source_size, target, start and words of each document's part in each of its blocks."""
    end = F.col("start") + F.col("size")
    touched = F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))

    def cut(words: Column, block: Column) -> Column:
        first = F.greatest(F.col("start"), block * block_words)
        n = F.least(end, (block + 1) * block_words) - first
        # As one string: an array of words takes several times its bytes in a shuffle.
        return F.struct(block.alias("block"), n.alias("n"), F.array_join(F.slice(words, (first - F.col("start") + 1).cast("int"), n.cast("int")), " ").alias("words"))

    # The array around the words binds them to a name, so that they are split once a document, not once a block.
    words = F.array(F.array_remove(F.split("text", SPACE), ""))
    parts = F.flatten(F.transform(words, lambda w: F.transform(touched, lambda b: cut(w, b))))
    same = ("sid", "bucket", "base", "id", "size", "source_size", "target", "start")
    return placed.select(*same, F.explode(parts).alias("part")).select(*same, "part.block", "part.n", "part.words")


def packed(
    docs: DataFrame, block_words: int, shard_slots: int, max_repeat: int, seed: int, stream_words: int, id_col: str, text_col: str, source_col: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents without words; blocks (sid, block, words, parts: the documents in it, in order); draws."""
    text = F.col(text_col)
    read = docs.select(F.col(id_col).alias("id"), n_words(text).alias("size"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("tie"), F.xxhash64(text, F.lit(1)).alias("tie2"), text.alias("text"))
    sized = materialize(read.drop("text", "tie2"))
    plan = targets(sized, max_repeat).withColumn("n_streams", F.ceil(F.col("source_size") / stream_words))
    plan = materialize(plan)
    own = small(plan.withColumnRenamed("source", "s"))
    known = lambda rows: rows.join(own, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    bucket = F.pmod(F.xxhash64("id", "tie"), F.col("n_streams"))
    # Words of each stream, and how many blocks the streams of its source ahead of it have.
    streams = known(sized.where("size > 0")).groupBy("sid", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    streams = streams.withColumn("n", F.ceil(F.col("n") / block_words))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per stream
    streams = materialize(streams.select("sid", "bucket", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")))
    of = plan.join(streams.groupBy("sid").agg(F.sum("n").alias("n_blocks")), "sid")
    # A target in blocks, rounded: words per block are the source's mean.
    quota = F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"), F.col("n_blocks") * max_repeat)
    of = materialize(of.select("sid", "source", "n_blocks", quota.alias("quota")))
    n_slots = of.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("q")).first().q
    rows = known(read.where("size > 0")).withColumn("bucket", bucket).join(small(streams.drop("n")), ["sid", "bucket"])
    inside = Window.partitionBy("sid", "bucket").orderBy("id", "size", "tie", "tie2").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # Pieces of a block are in one partition already. A block has at most block_words of them, since each has a word of its own.
    cut = pieces(rows, block_words)
    doc = F.struct("start", "id", "size", "source_size", "target", F.col("n").cast("long").alias("n"))
    content = cut.groupBy("sid", "bucket", "block", "base").agg(F.sort_array(F.collect_list(doc)).alias("parts"), F.sort_array(F.collect_list(F.struct("start", "words"))).alias("text"))
    content = content.select("sid", "bucket", (F.col("base") + F.col("block")).alias("block"), "parts", F.array_join("text.words", " ").alias("words"))
    return known(sized.where("size = 0")), content, drawn(of, n_slots, shard_slots, seed)


def blocks(
    docs: DataFrame, block_words: int = 64, shard_slots: int = 4096, max_repeat: int = 3, seed: int = 20240229, stream_words: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mixture, a row per slot: shard, slot, source, block (its index in the source), the ids of its documents in order, words."""
    _, content, draws = packed(docs, block_words, shard_slots, max_repeat, seed, stream_words, id_col, text_col, source_col)
    # The size of what is expanded isn't known to the planner, so it must not think of sending it to all tasks.
    out = draws.hint("merge").join(content.select("sid", "block", F.col("parts.id").alias("ids"), "words"), ["sid", "block"])
    return out.select("shard", "slot", "source", "block", F.col("ids").alias(f"{id_col}s"), F.split("words", " ").alias("words"))


def mix(
    docs: DataFrame, block_words: int = 64, shard_slots: int = 4096, max_repeat: int = 3, seed: int = 20240229, stream_words: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per row: id, size, source_size, target (its source's), taken (words the mix takes, repeats counted)."""
    empty, content, draws = packed(docs, block_words, shard_slots, max_repeat, seed, stream_words, id_col, text_col, source_col)
    uses = draws.groupBy("sid", "block").agg(F.count("*").alias("uses"))
    parts = content.join(uses.hint("merge"), ["sid", "block"], "left").select("sid", "bucket", F.coalesce("uses", F.lit(0)).alias("uses"), F.explode("parts").alias("part"))
    rows = parts.groupBy("sid", "bucket", "part.start").agg(*[F.first(f"part.{c}").alias(c) for c in ("id", "size", "source_size", "target")], F.sum(F.col("part.n") * F.col("uses")).alias("taken"))
    same = [F.col("id").alias(id_col), "size", "source_size", "target"]
    return rows.select(*same, "taken").unionByName(empty.select(*same, F.lit(0).cast("long").alias("taken")))
