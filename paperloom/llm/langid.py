"""Language identification of mixed text: script ranges, word scores, Viterbi.

A word's script narrows its candidate languages to those that write that script. Its
score per candidate is the log probability of its padded character trigrams. Viterbi
with a switching penalty labels the words; neighbouring equal labels form spans. The
document's language is the one with most letters in its spans, its score that share.

The model is fitted on a bounded sample of labelled rows: at most `sample_per_lang` rows of
each language, picked by the hash of their id. All languages and all trigrams of the sample
are learned. Prediction reads every word of every text.

Defined results: `und` with score 0 for a null text, a text without letters, or a model
without languages; ties between languages go to the first in code-point order; a null id
stays null and is not held out; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import materialize, text_batches

#: First and last code point of the main blocks of each script.
SCRIPT_RANGES = [
    (0x0041, 0x024F, "Latin"), (0x1E00, 0x1EFF, "Latin"),
    (0x0370, 0x03FF, "Greek"), (0x1F00, 0x1FFF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"),
    (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"), (0xAC00, 0xD7AF, "Hangul"),
    (0x3040, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"),
]
LETTERS = re.compile(r"[^\W\d_]+")
#: Least share of a language's letters in a script for it to be a candidate there.
SCRIPT_SHARE = 0.02
#: A language outside the script, and the worst score that one word can add.
OUTSIDE, FLOOR = -12.0, -8.0
#: Scores (words x languages) that a worker keeps, and sampled ids up to which they are sent to all tasks.
CACHE_SCORES, BROADCAST_ROWS = 2_000_000, 1_000_000
SPANS = "array<struct<start:int,end:int,lang:string>>"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def script_of(ch: str) -> str:
    c = ord(ch)
    if c < 0x250:
        return "Latin"
    return next((s for a, b, s in SCRIPT_RANGES if a <= c <= b), "other")


@dataclass
class Model:
    langs: list[str]
    trigrams: dict[str, int]
    scores: np.ndarray  # trigram x language; the last row is of unseen trigrams
    scripts: dict[str, np.ndarray]  # script -> which languages write it


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_per_lang: int = 2000,
) -> Model:
    """Trigram counts by language over the bounded sample; only rows that aren't held out are read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")))
    # Sent to all tasks, so that rows are thinned out before they are dealt by language.
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    # About half as many again by hash first, so that ranking never gathers a whole language.
    some = rows.select("id", "lang").join(sizes, "lang").where(F.pmod(F.xxhash64("id"), F.col("n")) < 1.5 * sample_per_lang)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = materialize(some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_per_lang).select("id", "lang").distinct())
    langs = sorted(r.lang for r in chosen.select("lang").distinct().collect())  # labels, not documents
    if not langs:
        return Model([], {}, np.zeros((1, 1), np.float32), {})
    sample = rows.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen, ["id", "lang"])
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("w")).groupBy("lang", "w").count()
    padded = F.concat(F.lit("^"), "w", F.lit("$"))
    tris = words.select("lang", "count", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: padded.substr(i, F.lit(3)))).alias("t"))
    counts = tris.groupBy("lang", "t").agg(F.sum("count").alias("n")).collect()  # of the sample only
    at = {x: k for k, x in enumerate(langs)}
    trigrams = {t: k for k, t in enumerate(sorted({r.t for r in counts}))}
    table = np.zeros((len(trigrams) + 1, max(1, len(langs))))
    letters: dict[str, np.ndarray] = {}
    for r in counts:
        table[trigrams[r.t], at[r.lang]] = r.n
        mid = r.t[1] if r.t[0] == "^" and len(r.t) > 1 else r.t[0]
        letters.setdefault(script_of(mid), np.zeros(max(1, len(langs))))[at[r.lang]] += r.n
    whole = np.maximum(sum(letters.values(), np.zeros(max(1, len(langs)))), 1)
    smooth = 0.5
    scores = np.log((table + smooth) / (table.sum(0) + smooth * len(table)))
    return Model(langs, trigrams, scores.astype(np.float32), {s: v / whole >= SCRIPT_SHARE for s, v in letters.items()})


class Labeller:
    """Word scores with a bounded cache, and the paths through them."""

    def __init__(self, model: Model, penalty: float) -> None:
        self.m, self.penalty = model, penalty
        width = max(1, len(model.langs))
        self.rows = np.zeros((max(1000, CACHE_SCORES // width), width), np.float32)
        self.index: dict[str, int] = {}

    def learn(self, words: list[str]) -> None:
        """Scores of words that aren't known yet, all at once."""
        m, unseen, get = self.m, len(self.m.trigrams), self.m.trigrams.get
        width = len(m.langs)
        if len(self.index) + len(words) > len(self.rows):
            self.index.clear()
            if len(words) > len(self.rows):
                self.rows = np.zeros((len(words), width), np.float32)
        flat: list[int] = []
        for w in words:
            p = f"^{w}$"
            flat += [get(p[i : i + 3], unseen) for i in range(len(w))]
        starts = np.cumsum([0, *map(len, words[:-1])])
        s = np.add.reduceat(m.scores[flat], starts, axis=0)
        none = np.zeros(width, bool)
        latin = m.scripts.get("Latin", none)
        allowed = np.array([latin if w.isascii() else m.scripts.get(script_of(w[0]), none) for w in words]).reshape(len(words), width)
        s[~allowed] = -np.inf
        top = s.max(axis=1, keepdims=True)
        s = np.where(allowed, np.maximum(s - np.where(np.isfinite(top), top, 0), FLOOR), OUTSIDE)
        s[~allowed.any(axis=1)] = 0  # a script that no language writes says nothing
        first = len(self.index)
        self.rows[first : first + len(words)] = s
        self.index.update(zip(words, range(first, first + len(words))))

    def path(self, s: np.ndarray) -> np.ndarray | int:
        """The best labels; a number if one language holds throughout, which is proven without the full search.

        If no other language gains more than half the penalty on any stretch, no path with
        a switch beats the language with the best total.
        """
        total = s.sum(0, dtype=np.float64)
        best = int(total.argmax())
        gain = np.cumsum(s - s[:, best : best + 1], axis=0, dtype=np.float64)
        low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
        rise = gain.copy()
        rise[1:] -= low[:-1]
        if rise.max() <= self.penalty / 2:
            return best
        penalty, at = self.penalty, s[0].tolist()
        states, tops = [at], []
        for row in s[1:].tolist():
            top = max(at)
            tops.append(top)
            floor = top - penalty
            at = [(x if x >= floor else floor) + y for x, y in zip(at, row)]
            states.append(at)
        k = at.index(max(at))
        out = [k]
        for at, top in zip(states[-2::-1], reversed(tops)):
            if at[k] < top - penalty:  # it came from the best one
                k = at.index(top)
            out.append(k)
        return np.array(out[::-1], np.int16)

    def label(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[dict]]]:
        """Language, score and spans of each text; some hundreds of texts at a time."""
        found: list[list[str]] = []
        for text in texts:
            low = text.lower() if text else ""
            # Lower-casing that changes lengths could move words, so those texts are lowered word by word.
            words = LETTERS.findall(low) if len(low) == len(text or "") else [w.lower() for w in LETTERS.findall(text)]
            found.append(words if self.m.langs and any(c.isalpha() for w in words for c in w) else [])
        new = list({w for words in found for w in words if w not in self.index})
        if new:
            if len(self.index) + len(new) > len(self.rows):  # the cache begins anew, with all words of these texts
                new = list({w for words in found for w in words})
            self.learn(new)
        for text, words in zip(texts, found):
            yield self.one(text, words) if words else ("und", 0.0, [])

    def one(self, text: str, words: list[str]) -> tuple[str, float, list[dict]]:
        path = self.path(self.rows[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))])
        if isinstance(path, int):
            first = LETTERS.search(text).start()
            end = next(k for k in range(len(text), first, -1) if text[k - 1].isalpha())
            return self.m.langs[path], 1.0, [{"start": first, "end": end, "lang": self.m.langs[path]}]
        sizes = np.bincount(path, weights=[len(w) for w in words], minlength=len(self.m.langs))
        best = int(sizes.argmax())
        # Places are needed where labels change only: the words between are passed over.
        cut = np.flatnonzero(np.diff(path)).tolist()
        marks, done, spans = LETTERS.finditer(text), 0, []
        for lo, hi in zip([0, *(c + 1 for c in cut)], [*cut, len(path) - 1]):
            m = next(islice(marks, lo - done, None))
            start, end = m.start(), m.end() if lo == hi else next(islice(marks, hi - lo - 1, None)).end()
            done = hi + 1
            spans.append({"start": start, "end": end, "lang": self.m.langs[path[lo]]})
        return self.m.langs[best], float(sizes[best] / sizes.sum()), spans


def in_parts(texts: pa.Array, chars: int = 1_000_000) -> Iterator[list[str | None]]:
    """Texts in lists of about so many characters."""
    part, size = [], 0
    for t in texts:
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def label_spans(docs: DataFrame, model: Model, penalty: float = 12.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and the language spans of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the sample's languages and trigrams make it
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, penalty)
        for batch in batches:
            got = [g for part in in_parts(batch.column(1)) for g in labeller.label(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], kind)],
                names=[id_col, "lang_pred", "score", "spans"],
            )

    return text_batches(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` long, lang_pred string, score double, spans {SPANS}")


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fit on the labelled rows of `docs` that aren't held out, then label every row."""
    out = label_spans(docs, fit(docs, id_col), id_col=id_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score", "spans")


def keep_identified(docs: DataFrame, model: Model, least: float, penalty: float = 12.0, text_col: str = "text") -> DataFrame:
    """Rows of `docs`, all columns, whose text has a language with a score of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, penalty)
        for batch in batches:
            got = (g for part in in_parts(batch.column(column)) for g in labeller.label(part))
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score, _ in got], pa.bool_()))

    return text_batches(docs).mapInArrow(run, docs.schema)
