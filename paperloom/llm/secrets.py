"""Secret scans with multipart credential linking, in Spark expressions only.

Base spans: keyword assignments, access identifiers and long hex runs. Beside them the
scan finds weak parts that prove nothing alone: user or client identifiers, secret-like
tokens, endpoints. Parts of a text are laid over bins of `scope` characters and joined
by (row, bin): a weak part is reported only if complementary parts lie within `scope`
characters. Identifiers need a secret, secrets an identifier, endpoints both. The side
that is joined to is one row per (row, role, bin), so no pairs within a group are made.

Positions are code points, end exclusive. Defined results: null text counts as empty
(no spans, the hash of the empty string); repeated rows each give a row; a null id stays
null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialize

#: The base patterns. A keyword's letters are in either case.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are whole, so those of 24 or more are the runs that count
BASE = ("assign", "access", "hex")
#: The weak parts.
IDENT = r"""((?i)user_?name|user|login|account|client_?id|access_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
KEY = r"""((?i)pass|pwd|passphrase|private_?key|auth_?key|credential)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@-]{6,})"""
RUN, TOKEN = r"[A-Za-z0-9+/_=-]{32,}", r"[A-Za-z0-9+/_-]{32,}={0,2}"  # a whole run that is a token, with a digit and letters of both cases
ENDPOINT = r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\s"'<>]+"""
WEAK = ("weak_ident", "weak_key", "weak_token", "endpoint")
SPAN = "array<struct<start:int,k:int,end:int>>"


def found(text: Column, pattern: str, kind: int, gate: Column, group: int = 0, least: int = 0, test: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the leftmost matches that don't overlap; `least` is the length that `group` needs, `test` what a match must be.

    What lies between matches is what split() leaves, so starts are running sums of lengths.
    """
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    size = (lambda x: F.when(test(x), F.length(x)).otherwise(F.lit(-1))) if test else F.length
    zipped = F.zip_with(F.transform(F.slice(pieces, 1, F.size(hits)), F.length), F.arrays_zip(F.transform(hits, F.length).alias("n"), F.transform(parts, size).alias("m")), lambda p, x: F.struct(p.alias("gap"), x["n"].alias("n"), x["m"].alias("m")))
    empty = F.array().cast(SPAN)
    span = lambda a, x: F.struct((a["at"] + x["gap"]).alias("start"), F.lit(kind).alias("k"), (a["at"] + x["gap"] + x["n"]).alias("end"))
    fold = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.when(x["m"] >= least, F.concat(a["out"], F.array(span(a, x)))).otherwise(a["out"]).alias("out")),
    )["out"]
    return F.when(gate, fold).otherwise(empty)


def names(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, (*BASE, *WEAK)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked(parts: DataFrame, scope: int) -> DataFrame:
    """Of weak parts (rid, start, k, end, role, weak) those with complementary parts in scope."""
    bins = F.sequence((F.col("start") / scope).cast("int"), ((F.col("end") - 1) / scope).cast("int"))
    cells = parts.select("rid", "role", "start", "end", F.explode(bins).alias("bin"))
    cells = cells.groupBy("rid", "role", "bin").agg(
        F.min(F.greatest(F.col("start"), F.col("bin") * scope)).alias("lo"), F.max(F.least(F.col("end"), (F.col("bin") + 1) * scope)).alias("hi")
    )
    near = F.sequence((F.col("start") / scope).cast("int") - 1, ((F.col("end") - 1) / scope).cast("int") + 1)
    weak = parts.where("weak").select("rid", "start", "k", "end", F.col("role").alias("own"), F.explode(near).alias("bin"))
    met = weak.join(cells, ["rid", "bin"]).where((F.col("role") != F.col("own")) & (F.col("lo") - F.col("end") <= scope) & (F.col("start") - F.col("hi") <= scope))
    has = lambda role: F.max(F.col("role") == role)
    got = met.groupBy("rid", "start", "k", "end", "own").agg(has("ident").alias("ident"), has("secret").alias("secret"))
    keep = F.when(F.col("own") == "ident", F.col("secret")).when(F.col("own") == "secret", F.col("ident")).otherwise(F.col("ident") & F.col("secret"))
    return got.where(keep).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "k", "end"))).alias("more"))


def scan(docs: DataFrame, scope: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of base spans, hash of the base spans, all spans."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(
        "id",
        found(text, ASSIGN, 0, text.rlike(ASSIGN), 2, 6).alias("a"), found(text, ACCESS, 1, text.contains("AKIA"), 0, 20).alias("b"), found(text, HEX, 2, text.rlike(HEX)).alias("c"),
        found(text, IDENT, 3, text.rlike(IDENT)).alias("d"), found(text, KEY, 4, text.rlike(KEY)).alias("e"),
        found(text, RUN, 5, text.rlike(RUN), test=lambda x: x.rlike(f"^{TOKEN}$") & x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]")).alias("f"), found(text, ENDPOINT, 6, text.contains("://")).alias("g"),
    )
    rows = rows.select("id", F.size("a").cast("long").alias("n_assign"), F.size("b").cast("long").alias("n_access"), F.size("c").cast("long").alias("n_hex"), F.array_sort(F.concat("a", "b", "c")).alias("base"), F.concat("d", "e", "f", "g").alias("weak"))
    rows = rows.withColumn("weak", F.filter("weak", lambda w: ~F.exists("base", lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"]))))
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()))
    role = F.when(F.col("k").isin(1, 3), "ident").when(F.col("k") == 6, "endpoint").otherwise("secret")
    parts = rows.where(F.size("weak") > 0).select("rid", F.inline(F.concat("base", "weak"))).withColumns({"role": role, "weak": F.col("k") >= len(BASE)})
    out = rows.join(linked(parts, scope), "rid", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    return out.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", F.sha2(names(F.col("base")), 256).alias("base_sha256"), names(spans).alias("spans"))
