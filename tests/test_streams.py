import datetime as dt

from quarryline.sources.tables import scratch
from quarryline.streaming import jobs

SCHEMA = "event_id long, user_id long, event_type string, ts timestamp"


def at(day, hour=1):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}")


def audit(spark, folder, out):
    log = jobs.ChangeLog(spark, out, "key", jobs.AUDIT)
    rows = jobs.merged(jobs.audit_counts(jobs.stream_of(spark, f"file://{folder}", 1)), log).collect()
    return {((r.start - dt.datetime(2024, 1, 1)).days, r.event_type): r.n for r in rows}


def test_repeated_and_late_events(spark, tmp_path):
    folder, out = tmp_path / "events", f"file://{tmp_path}/audit"
    put(spark, folder, [(1, 1, "a", at(0)), (1, 1, "a", at(0)), (2, 1, "b", at(1))])
    assert audit(spark, folder, out) == {(0, "a"): 1, (1, "b"): 1}
    put(spark, folder, [(1, 1, "a", at(0)), (3, 1, "a", at(0)), (4, None, "a", at(200))])  # a repeat, and a late one within the retention
    assert audit(spark, folder, out) == {(0, "a"): 2, (1, "b"): 1, (200, "a"): 1}
    put(spark, folder, [(5, 1, "a", at(0)), (6, 1, "a", at(150))])  # too late, and just in time
    assert audit(spark, folder, out) == {(0, "a"): 2, (1, "b"): 1, (200, "a"): 1, (150, "a"): 1}


def test_state_leaves_with_the_watermark(spark, tmp_path):
    folder = tmp_path / "events"
    for day in (0, 100, 200, 300, 400):
        put(spark, folder, [(day * 100 + i, i, "a", at(day)) for i in range(50)])
    query = jobs.audit_counts(jobs.stream_of(spark, f"file://{folder}", 1)).writeStream.outputMode("update").format("memory").queryName("audit_state").option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) <= 3 * 52 and kept[-1] <= 2 * 52


def test_progress_adds_up_over_batches_and_retries(spark, tmp_path):
    folder, out = tmp_path / "events", f"file://{tmp_path}/done"
    run = lambda: {r.user_id: r.done for r in jobs.progress(jobs.stream_of(spark, f"file://{folder}", 1), out).collect()}
    put(spark, folder, [(1, 1, "a", at(0)), (2, 2, "a", at(0)), (3, None, "a", at(0))])
    assert run() == {1: 1, 2: 1, None: 1}
    put(spark, folder, [(4, 1, "a", at(0)), (5, None, "a", at(0)), (6, 7, "a", at(0))])
    assert run() == {1: 2, 2: 1, None: 2, 7: 1}
    for mark in (tmp_path / "done-progress" / "commits").glob("*1*"):
        mark.unlink()  # as if the job had ended after its batch and before it was noted
    assert run() == {1: 2, 2: 1, None: 2, 7: 1}


def test_retention_by_day(spark, tmp_path):
    folder, out = tmp_path / "events", f"file://{tmp_path}/kept"
    run = lambda: sorted(r.event_id for r in jobs.retained(jobs.stream_of(spark, f"file://{folder}", 1), out, 10).collect())
    put(spark, folder, [(1, 1, "a", at(0)), (2, 1, "a", at(5)), (3, 1, "a", None)])
    assert run() == [1, 2]
    put(spark, folder, [(2, 1, "a", at(5)), (4, 1, "a", at(12)), (5, 1, "a", at(5, 3))])  # day 0 leaves, 2 is a repeat
    assert run() == [2, 4, 5]
    put(spark, folder, [(6, 1, "a", at(1)), (7, 1, "a", at(2))])  # a day that is gone, and the oldest that isn't
    assert run() == [2, 4, 5, 7]
    assert run() == [2, 4, 5, 7]
    assert jobs.run_retention(spark, f"file://{folder}", 10_000).count() == 6
