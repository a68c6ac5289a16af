"""Lives of jobs over several batches and restarts, with timers that fire; repeated deliveries."""

import datetime
import random

from paperloom.streaming import jobs, progress

SCHEMA = "job_id long, ts timestamp, event_id long, stage string, chunks_total long, validation_status string, message string"
ZERO = datetime.datetime(2024, 1, 1)


def event(job, second, number, stage, total=None, status=None, message=None):
    return job, ZERO + datetime.timedelta(seconds=second), number, stage, total, status, message


def run(spark, folder, batches):
    """Each batch by a run of its own that goes on from the checkpoint; the last rows of all lives, seconds from ZERO."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events")
        stream = progress.lives(spark.readStream.schema(SCHEMA).parquet(f"{folder}/events"), late="10 seconds")
        jobs.run_once(stream, "update", jobs.batches_to(f"{folder}/rows"), str(folder))
    base = int(ZERO.replace(tzinfo=datetime.UTC).timestamp() * 1000)
    rows = progress.latest(spark.read.schema(stream.schema).parquet(f"{folder}/rows")).collect()
    second = lambda x: None if x is None else (x - base) / 1000
    return {(r.job_id, second(r.started)): r for r in rows}, second


def test_lives_of_jobs(spark, tmp_path):
    rows, second = run(spark, tmp_path, [
        [event(1, 0, 1, "starting"), event(1, 1, 2, "fetching"), event(1, 5, 3, "fetched", 3), event(1, 6, 4, "extracting"), event(1, 9, 5, "stored", status="PASSED"), event(2, 0, 6, "starting"), event(3, 0, 20, "starting")],
        [event(1, 15, 7, "skipped"), event(1, 20, 8, "stored", status="FAILED"), event(1, 30, 9, "error", message="chunk 3"), event(1, 40, 10, "complete")],
        [event(4, 200, 11, "starting"), event(3, 110, 21, "complete")],  # job 2 has been silent for more than 120 s
        [event(3, 100, 22, "stored"), event(4, 290, 12, "extracting"), event(4, 409, 13, "extracting"), event(4, 600, 14, "stored", status="CORRECTED")],
        [event(1, 700, 15, "starting"), event(5, 2000, 16, "starting")],
    ])
    one = rows[1, 0.0]
    assert (one.chunks_total, one.chunks_done, one.recipes_extracted, one.recipes_passed, one.status, one.message, one.closed_by, second(one.closed), one.removed) == (3, 2, 2, 1, "complete", "chunk 3", "error", 30.0, True)
    assert one.stages == {"starting": 1, "fetching": 1, "fetched": 1, "extracting": 1, "stored": 2, "skipped": 1, "error": 1, "complete": 1} and set(one.stages) == set(progress.STAGES)
    two = rows[2, 0.0]
    assert (two.status, two.closed_by, second(two.closed), two.removed) == ("running", "idle", 120.0, True)
    three = rows[3, 0.0]  # a gap of 110 s is none; the event of second 100 came behind the watermark
    assert (three.closed_by, second(three.closed), three.events, three.chunks_done, three.removed) == ("complete", 110.0, 2, 0, True)
    four = rows[4, 200.0]  # a gap of 119 s is none, one of 191 s closes the life; what comes within 300 s still counts
    assert (four.closed_by, second(four.closed), four.chunks_done, four.recipes_passed, four.events) == ("idle", 529.0, 1, 1, 4)
    assert rows[1, 700.0].events == 1 and rows[1, 700.0].closed_by == "idle" and rows[1, 700.0].removed and not rows[5, 2000.0].closed


def test_batches_dont_matter(spark, tmp_path):
    rng = random.Random(2)
    second, events = 0, []
    for k in range(300):
        second += rng.choice([1, 5, 40, 130])
        events.append(event(rng.randrange(4), second, k, rng.choice(progress.STAGES), k, rng.choice(["PASSED", "FAILED"]), str(k)))
    key = lambda rows: {k: {**r.asDict(), "epoch": 0} for k, r in rows.items()}
    whole, _ = run(spark, tmp_path / "whole", [events])
    parts, _ = run(spark, tmp_path / "parts", [events[:50], events[50:51], events[51:220], events[220:]])
    assert key(whole) == key(parts) and len(whole) > 30


def test_repeated_deliveries(spark, tmp_path):
    """An event that comes again passes no more until its id is forgotten."""
    for rows, ttl in (([1, 2, 2], 10**9), ([2, 3], 10**9), ([1, 4], 10**9)):
        spark.createDataFrame([event(1, k, k, "stored") for k in rows], SCHEMA).write.mode("append").parquet(f"{tmp_path}/events")
        stream = progress.delivered_once(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/events"), ttl_ms=ttl)
        jobs.run_once(stream, "append", jobs.batches_to(f"{tmp_path}/rows"), str(tmp_path), one_batch=True)
    assert sorted(r.event_id for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/rows").collect()) == [1, 2, 3, 4]
