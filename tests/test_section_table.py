"""The section table function against the operator, and what it refuses."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from paperloom.operators import chunking, section_table

LONG = " ".join(["word"] * 60)
TEXTS = [
    f"## Experimental Section\n{LONG}\n\n# Results\nnone",
    f"intro\n2.2 Synthesis of ZnO\n{LONG}\n2.3 Preparation of TiO2\n{LONG}\n3. Results\nx",
    "## Experimental\ntoo short", "", f"**Experimental**\na\nb\nc\n1. Header\n{LONG}",
    "\n".join(f"2.{k} Synthesis of sample\n{LONG if k % 2 else 'short'}" for k in range(1, 15)), f"no heading {LONG}",
]


@pytest.fixture(scope="module")
def lines(spark):
    section_table.register(spark)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc long, text string")
    docs.select("doc", F.posexplode(F.split("text", "\n")).alias("k", "line")).repartition(3).createOrReplaceTempView("lines")
    return docs


def test_same_sections_as_the_operator(spark, lines):
    key = lambda df: sorted(tuple(r) for r in df.collect())
    for least in (50, 1):
        want = key(chunking.experimental_sections(lines, "doc", "text", least))
        assert key(spark.sql(f"SELECT * FROM section_lines(TABLE(lines) PARTITION BY doc ORDER BY (k), {least}, NULL)")) == want and len(want) > 5
    mine = spark.sql("SELECT named, count(*) AS n FROM section_lines(TABLE(SELECT concat('d', doc) AS named, k, line FROM lines) PARTITION BY named ORDER BY (k), 1, '^intro') GROUP BY named")
    assert [tuple(r) for r in mine.collect()] == [("d1", 1)] and mine.schema["named"].dataType.simpleString() == "string"


def test_tables_of_another_shape_are_refused(spark, lines):
    for call in ("TABLE(SELECT doc, line FROM lines) PARTITION BY (doc), 1, NULL", "'text', 1, NULL", "TABLE(SELECT doc, k, k AS line FROM lines) PARTITION BY (doc), 1, NULL"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM section_lines({call})").collect()
