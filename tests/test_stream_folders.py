"""Streams over tables that are one file, and over tables that are folders of files."""

import pytest

from paperloom.plans import stream_queries
from paperloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["documents", "events"])
def test_folders_are_read_whole(spark, tmp_path, name):
    whole = spark.read.parquet(f"{SF}/{name}.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for folder in (SF, f"{tmp_path}"):
        got = stream_queries.through(spark, stream_queries.stream_of(spark, folder, name), "append").drop("epoch")
        assert got.count() == whole.count() and got.exceptAll(whole).isEmpty()


def test_gated_chunks_of_a_folder(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda folder: sorted(tuple(r) for r in QUERIES["stream_chunk_events"](spark, folder).collect())
    assert rows(f"{tmp_path}") == rows(SF) != []
