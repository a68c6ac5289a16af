"""Pages are walked once: what the walk counts is what the columns count, and texts don't move unless they are asked for."""

import random
import re

from pyspark.sql import functions as F

from paperloom.functions.text import CHEMISTRY_WORDS, ascii_density, density
from paperloom.sources import pages

SAID = ["Heated", "5 mg", "NaCl", "H2O", "washed", "STIRRED", "zinc", "solution", "10wt%", "7", "g", "CH3COOH", "_a_", "3.5  mL", "x5g", "Catalyst."]
PLAIN = ["lorem", "ipsum", "dolor", "a", "to", "x1", "in-between", "(so)", "\x1d", "\x0b", "\t"]


def test_ascii_density_as_column(spark):
    rng = random.Random(1)
    texts = ["", " ", "..."] + [" ".join(rng.choice(SAID if rng.random() < share else PLAIN) for _ in range(rng.choice([1, 5, 40, 300]))) for share in (0.0, 0.01, 0.05, 0.5) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", density(F.col("t"), ["zinc", "a"]).alias("some"), density(F.col("t")).alias("default")).collect()
    some, default = frozenset([b"zinc", b"a"]), frozenset(w.encode() for w in CHEMISTRY_WORDS)
    assert [(ascii_density(r.t, some), ascii_density(r.t, default)) for r in rows] == [(r.some, r.default) for r in rows]
    assert len({r.default for r in rows}) > 20


def test_chunks_as_columns_tell(spark):
    """Words and densities of ASCII texts and of others; an id has paragraphs only if none of its pages has a section."""
    body, rare = "zinc " + "w " * 60, "zinc " + "w " * 99
    said = [
        (1, "Synthesis of A\n\n" + body), (2, "Synthesis of Ä\n\n" + body + " ä"), (3, rare + "\n\n\n\n" + body + "\n\nshort"), (4, body + "é\n\n" + "w " * 60), (5, body), (5, "Synthesis of B\n\n" + body + "\x1dw"),
        (6, "Experimental section\n\n" + body + "\n\nSynthesis of C\n\n" + body), (7, None), (8, ""),
    ]
    out = pages.page_chunks(spark.createDataFrame(said, "page_id long, text string"), vocabulary=["zinc"]).select("*", pages.word_count("text").alias("n"))
    got = sorted((r.page_id, r.place, r.section, r.n_words, r.n) for r in out.collect())
    assert [g[:3] for g in got] == [(1, 1, "experimental_section"), (2, 1, "experimental_section"), (3, 1, "paragraph_1"), (3, 2, "paragraph_0"), (4, 1, "paragraph_0"), (5, 1, "experimental_section"), (6, 1, "experimental_section")]
    assert all(g[3] == g[4] for g in got)


def test_pages_are_read_once_and_texts_stay(spark):
    rows = spark.range(20).select(F.col("id").alias("page_id"), F.concat(F.lit("Synthesis of A\n\n"), F.repeat(F.lit("w "), 60)).alias("text"))
    out = pages.page_chunks(rows, vocabulary=["zinc"]).select("page_id", "place", "n_words")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "parquet" not in plan
    above = [line for line in plan[: plan.index("MapInArrow")].split("\n") if "Project" in line or "Window" in line]
    assert len(above) > 3 and not any(re.search(r"[\[ ]text#\d+[,\]]", line) for line in above)
    assert out.count() == 20
