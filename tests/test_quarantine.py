"""Good rows and rejects of one pass."""

from paperloom.sources import quarantine


def test_counts_are_those_of_the_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "fine " * 20, 0.5, "x"), (2, "short", 0.5, None), (3, " " * 60, 2.0, "y"), (4, None, None, "z")], "id long, text string, density double, faults string")
    got = quarantine.sorted_chunks(rows, folder=str(tmp_path / "out"))
    assert got.counts == {"rows": 4, "good": 1, "text_short": 2, "text_blank": 1, "density": 1}
    assert [r.id for r in got.good.collect()] == [1] and got.good.columns == rows.columns
    assert {r.id: r.row_faults for r in got.rejected.collect()} == {2: ["text_short"], 3: ["text_blank", "density"], 4: ["text_short"]} and {r.faults for r in got.rejected.collect()} == {None, "y", "z"}
    again = quarantine.sorted_chunks(rows.limit(0), folder=str(tmp_path / "none"))
    assert again.counts["rows"] == 0 and again.good.count() == again.rejected.count() == 0


def test_event_logs(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"ts": "2024-01-01T00:00:00Z", "event": "run_started", "new_field": 1}\n\nnot json\n{"ts": "2024-01-01T00:00:00Z"}\n{"event": "x"}\n{"ts": "2024-01-02T00:00:00Z", "event": "chunk_skipped", "chunks": "many"}\n[1]\n')
    got = quarantine.sorted_events(spark, str(tmp_path / "log.json"))
    assert [r.event for r in got.good.collect()] == ["run_started"]
    faults = {r.line: r.faults for r in got.rejected.collect()}
    assert faults["not json"] == ["json"] and faults['{"ts": "2024-01-01T00:00:00Z"}'] == ["event"] and faults['{"event": "x"}'] == ["ts"] and faults["[1]"] == ["json"] and len(faults) == 5
    assert got.counts == {"rows": 6, "good": 1, "json": 3, "ts": 1, "event": 1}
