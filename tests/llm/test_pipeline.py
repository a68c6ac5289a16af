"""The pipeline keeps clean documents, and each stage's decisions take effect."""

import collections
import random

import corpus_pipeline
from paperloom.llm import decontam, langid, mixing, pii
from paperloom.llm.common import materialize
from tests.llm.test_operators import EN, WORDS, frame, linked
from tests.llm.test_oracles import best_local

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(1)
    letters = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    text = letters(80)
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    more = [(9001, text, "en", "src0", 1), (9002, text, "en", "src0", 1), (9003, "12345 !!", "en", "src0", 1), (9004, f"{letters(40)} {leak} {letters(40)}", "en", "src0", 1), (9005, f"{letters(50)} call +1 (743) 555-3824 {letters(50)}", "en", "src0", 1)]
    docs = materialize(docs.unionByName(spark.createDataFrame(more, docs.schema)))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF))
        if name == "mixture":
            assert docs.columns == ["shard", "slot", "source", "block", "doc_ids", "words"]
            words = collections.Counter(w for r in docs.select("words").collect() for w in r.words)
            whole = collections.Counter(w for r in before.select("text").collect() for w in WORDS.findall(r.text or ""))
            assert 0.9 < sum(words.values()) / sum(whole.values()) < 1.1 and set(words) <= set(whole)
            assert {i for r in docs.select("doc_ids").collect() for i in r.doc_ids} <= seen["personal_data"]
            break
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == before.columns
        if name == "personal_data":
            row = docs.where("doc_id = 9005").first()
            assert "3824" not in row.text and row.n_chars == len(row.text)
    assert 9003 not in seen["language"] and {9001, 9002, 9004, 9005} <= seen["language"]
    assert 9001 in seen["near_duplicates"] and 9002 not in seen["near_duplicates"]
    assert 9004 not in seen["benchmark"] and {9001, 9005} <= seen["benchmark"]
    assert seen["personal_data"] == seen["benchmark"]


def test_run_against_brute_force(spark):
    """Each stage of the pipeline on the smallest tables, on what the stage before it left; the last is run()'s own rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r.item_id: decontam.WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    grams = lambda w: {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF))
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language":
            model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
            told = dict(zip(before, langid.Labeller(model, 12.0).label([r.text for r in before.values()])))
            assert set(after) == {i for i, (lang, score, _) in told.items() if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE}
        elif name == "near_duplicates":
            ids = sorted(before)
            groups = linked([before[i].text for i in ids], corpus_pipeline.DUPLICATE_WORDS, corpus_pipeline.DUPLICATE_SIMILARITY)
            assert set(after) == {ids[k] for k, (_, c) in groups.items() if c == k} != set(before)
        elif name == "benchmark":
            words = {i: decontam.WORD.findall(r.text.lower()) for i, r in before.items()}
            holds = lambda w: any(grams(w) & grams(x) and best_local(w, x) >= len(x) for x in items.values() if len(x) >= 4)
            assert set(after) == {i for i, w in words.items() if not holds(w)} != set(before)
        else:
            assert set(after) == set(before) and {i: r.text for i, r in after.items()} == {i: pii.rewrite(r.text, corpus_pipeline.PII_KEY, {})[0] for i, r in before.items()}
        if name != "personal_data":
            assert all(after[i] == before[i] for i in after)
    made = lambda df: sorted((r.shard, r.slot, str(r.source), r.block, tuple(r.doc_ids), tuple(r.words)) for r in df.collect())
    rows = made(corpus_pipeline.run(spark, SF))
    assert rows == made(mixing.blocks(docs))
    texts = {i: WORDS.findall(r.text or "") for i, r in after.items()}
    assert all({*words} <= {w for i in ids for w in texts[i]} for *_, ids, words in rows)


def test_stages_on_odd_rows(spark):
    """Nulls in all columns, empty and repeated rows, clashing extra columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, `size` string, _moved long, component_id string"
    long = " ".join(f"w{k}" for k in range(9000)) + " the cat and the dog"
    data = [(None, None, None, None, None, None, None, None), (1, "", "en", "s", 0, "x", 1, "y"), (2, long, "en", None, len(long), "x", 1, "y"), (3, "the cat and the dog went home", None, "s", 3, None, 2, None), (3, "the cat and the dog went home", None, "s", 3, None, 2, None)]
    more = [(10 + k, " ".join(random.Random(k).choices(EN, k=40)), "en", "s", 1, "x", 0, "y") for k in range(30)]
    for rows in (data + more, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            columns, docs = docs.columns, materialize(stage(spark, docs, SF))
            assert name == "mixture" or docs.columns == columns
            if name == "near_duplicates" and rows:
                assert docs.where("doc_id = 3").count() == 1 and docs.where("doc_id = 2").count() == 1 and docs.where("doc_id is null or doc_id = 1").count() == 0
        assert (docs.count() > 0) == bool(rows)


def test_near_duplicates_against_brute_force(spark):
    """Copies with spread edits that are 0.8 alike on five words, but not 0.9 on three."""
    rng = random.Random(3)
    texts = []
    for size in (240, 300, 400, 600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(size)]
        for k in (0, size // 54, size // 50, size // 46, size // 30):
            at = {int((j + 0.5) * size / k) for j in range(k)}
            texts.append(" ".join(f"new{size}x{k}x{i}" if i in at else w for i, w in enumerate(words)))
    want = {i for i, (_, c) in linked(texts, 5, 80).items() if c == i}
    assert want != {i for i, (_, c) in linked(texts, 3, 90).items() if c == i}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, texts), SF).collect()} == want
