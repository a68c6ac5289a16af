"""Pages are spread over tasks and read once; sections by page stay as they were."""

from paperloom.functions.text import density
from paperloom.plans import source_queries
from paperloom.session import ARROW_ROWS
from paperloom.sources import pages

SF = "/root/testdata/sf0.01"


def test_sections_join_no_copy_of_themselves(spark):
    found = spark.createDataFrame([(1, "Synthesis of A\n\n" + "w " * 60), (2, "w " * 60)], "page_id long, text string")
    out = pages.page_sections(found)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert [r.page_id for r in out.collect()] == [1] and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS


def test_pages_of_a_small_file_are_dealt_out(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(source_queries.pages, "page_chunks", lambda found, **more: seen.append(found.rdd.getNumPartitions()) or pages.spark_free)
    monkeypatch.setattr(pages, "spark_free", spark.createDataFrame([], "page_id long, place int, section string, n_words int"), raising=False)
    source_queries.page_chunk_caps(spark, SF)
    assert seen == [2]  # 2000 parts


def test_gated_patterns_count(spark):
    texts = ["Heated 5 g at 60 °C in solution", "heated in solution", "٣ mg added", "60 °C", "", None]
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select(density("t", ["zzz"]).alias("d")).collect()]
    assert got[0] == got[1] == got[2] == got[3] == 1.0 and got[4] == got[5] == 0.0
