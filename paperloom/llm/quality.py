"""Quality rules by distribution divergence, in Spark expressions only.

Each language has two references, counted over all its documents: a histogram of
character classes, and one of its `n_common` most frequent short words (1 to
`short` letters, lower case) against all others. A document's histograms are compared
with its language's by the Jensen-Shannon distance (base 2, 0 to 1). Below the minimum
lengths a distance isn't judged. Documents without a language use the reference of all.

Defined results: a null text has no words, and fails the base rule of 20 words; a
reference of no characters judges nothing; repeated rows each give a row; other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import materialize

SPACE = r"[\x20\x09-\x0D]+"
CLASSES = ("letters", "digits", "spaces", "symbols", "marks", "others")
#: References (about 1 kB each) up to which they are sent to all tasks, and parts that a language is dealt to beyond, or when its words are ranked.
BROADCAST_ROWS, SALTS = 10_000, 64


def with_classes(docs: DataFrame) -> DataFrame:
    """Adds `chars`: characters by CLASSES. Each step strips one class from what is left, so steps get shorter."""
    steps = (r"\p{L}+", r"\p{N}+", r"[\s]+", r"[#*$%&|<>{}\[\]=^~_\\/+]+", r"[\p{P}]+")
    left = "text"
    for k, pattern in enumerate(steps):
        docs = docs.withColumn(f"_t{k}", F.regexp_replace(left, pattern, ""))
        left = f"_t{k}"
    sizes = [F.length("text"), *[F.length(f"_t{k}") for k in range(len(steps))], F.lit(0)]
    return docs.withColumn("chars", F.array(*[(a - b).cast("double") for a, b in zip(sizes, sizes[1:])])).drop(*[f"_t{k}" for k in range(len(steps))])


def repeat_cover(docs: DataFrame, words: str, name: str, n: int = 8) -> DataFrame:
    """Adds `name`: words inside n-word windows that occur at least twice in the text, the first included.

    Windows of one text are compared by two independent hashes, 96 bits together. Texts
    whose 64-bit hashes are all different, which most are, end at the first step.
    """
    window = lambda i: [F.get(words, i + k) for k in range(n)]
    starts = lambda: F.sequence(F.lit(0), F.size(words) - n)
    same = lambda a, b: F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))
    docs = docs.withColumn("_h", F.when(F.size(words) > n, F.transform(starts(), lambda i: F.xxhash64(*window(i)))))
    docs = docs.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h")).drop("_h")
    keyed = F.array_sort(F.transform(starts(), lambda i: F.struct(F.xxhash64(*window(i)).alias("h"), F.hash(*window(i)).alias("g"), i.alias("i"))))
    docs = docs.withColumn("_k", F.when(F.col("_again"), keyed))
    # In hash order equal windows are neighbours; in text order their starts give the cover.
    hit = F.transform("_k", lambda x, j: F.when(same(F.get("_k", j - 1), x) | same(F.get("_k", j + 1), x), x["i"]))
    docs = docs.withColumn("_i", F.array_sort(F.array_compact(hit))).drop("_k", "_again")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    grow = lambda acc, i: F.struct((acc["n"] + i + n - F.greatest(i, acc["end"])).alias("n"), (i + n).alias("end"))
    cover = F.aggregate("_i", start, grow)["n"]
    return docs.withColumn(name, F.coalesce(cover, F.lit(0)).cast("long")).drop("_i")


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda a, b: term(a, (a + b) / 2) / 2 + term(b, (a + b) / 2) / 2)
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def brief_words(words: str, short: int) -> Column:
    """Words of at most `short` letters, lower case."""
    return F.transform(F.filter(words, lambda w: F.length(w) <= short), F.lower)


def references(docs: DataFrame, n_common: int = 24, short: int = 4) -> DataFrame:
    """lang (null: all), chars (shares by class), common (words), shares (of these, then of all others).

    One pass: a row per document and class or short word is summed before it is shuffled.
    """
    rows = with_classes(docs).select("lang", "chars", F.array_remove(F.split("text", SPACE), "").alias("words"))
    pair = lambda w, v: F.struct(w.alias("w"), v.cast("double").alias("v"))
    facts = [pair(F.lit(f"#{c}"), F.col("chars")[k]) for k, c in enumerate(CLASSES)] + [pair(F.lit("#words"), F.size("words")), pair(F.lit("#docs"), F.lit(1))]
    brief = F.transform(brief_words("words", short), lambda w: pair(w, F.lit(1)))
    sums = rows.select("lang", F.explode(F.concat(F.array(*facts), brief)).alias("x")).groupBy("lang", F.col("x.w").alias("w")).agg(F.sum("x.v").alias("v"))
    sums = sums.where(F.col("w").startswith("#") & (F.length("w") > short) | F.col("w").rlike(r"^\p{L}+$"))
    sums = materialize(sums)  # languages x short words, read several times
    sums = sums.where("lang is not null").unionByName(sums.groupBy("w").agg(F.sum("v").alias("v")).withColumn("lang", F.lit(None).cast("string")))
    fact = F.col("w").startswith("#")
    facts_of = sums.where(fact).groupBy("lang").agg(*[F.coalesce(F.max(F.when(F.col("w") == f"#{c}", F.col("v"))), F.lit(0.0)).alias(c) for c in (*CLASSES, "words", "docs")])
    # First in parts of a language, so that none is ranked in one task.
    top = sums.where(~fact).withColumn("part", F.pmod(F.xxhash64("w"), F.lit(SALTS)))
    for by in (["lang", "part"], ["lang"]):
        top = top.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("v"), "w"))).where(F.col("k") <= n_common)
    top = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "w", "v"))).alias("top"))
    joined = facts_of.join(top, facts_of["lang"].eqNullSafe(top["lang"]), "left").select(facts_of["*"], F.coalesce("top", F.array().cast("array<struct<k:int,w:string,v:double>>")).alias("top"))
    size = reduce(lambda a, b: a + b, [F.col(c) for c in CLASSES])
    common = F.transform("top", lambda x: x["v"] / F.greatest(F.col("words"), F.lit(1.0)))
    shares = F.concat(common, F.array(1 - F.aggregate(common, F.lit(0.0), lambda a, x: a + x)))
    return joined.select("lang", F.array(*[F.col(c) / F.greatest(size, F.lit(1.0)) for c in CLASSES]).alias("ref_chars"), F.transform("top", lambda x: x["w"]).alias("common"), shares.alias("ref_shares"))


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_char_distance: float = 0.3,
    max_word_distance: float = 0.45, min_chars: int = 200, min_words: int = 50, short: int = 4, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Base counts, both distances (null below the minimum length) and the verdict of every row."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    ref = materialize(references(docs, short=short)).withColumnRenamed("lang", "of")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = with_classes(docs).select(
        "id", "lang", F.array_remove(F.split("text", SPACE), "").alias("words"),
        "chars", F.length("text").alias("n_chars"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"),
    )
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    rows = repeat_cover(rows, "words", "n_repeat_words").withColumn("brief", brief_words("words", short)).drop("words")
    if ref.count() <= broadcast_rows:
        rows = rows.join(F.broadcast(ref), F.col("lang").eqNullSafe(F.col("of")), "left")
    else:
        ref = ref.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "n_chars"), F.lit(SALTS)).cast("int")).join(ref, F.col("lang").eqNullSafe(F.col("of")) & (F.col("part") == F.col("salt")), "left")
    # Only the common words are kept, then each is counted by what its removal takes away.
    rows = rows.withColumn("found", F.filter("brief", lambda w: F.array_contains("common", w))).drop("brief")
    n = F.greatest(F.col("n_words"), F.lit(1))
    counts = F.transform("common", lambda w: (F.size("found") - F.size(F.array_remove("found", w))) / n)
    rows = rows.withColumn("shares", F.concat(counts, F.array(1 - F.size("found") / n))).drop("found", "common")
    rows = rows.withColumn("char_distance", F.when(F.col("n_chars") >= min_chars, jsd(F.transform("chars", lambda x: x / F.col("n_chars")), F.col("ref_chars"))))
    rows = rows.withColumn("word_distance", F.when(F.col("n_words") >= min_words, jsd(F.col("shares"), F.col("ref_shares"))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"), F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))
