import pytest
from pyspark.sql import functions as F

from quarryline.sources import changelog
from quarryline.sources.changelog import ChangeLog
from quarryline.sources.tables import bytes_in, complete_versions, remove, scratch
from quarryline.streaming import jobs

SCHEMA = "id long, key string, deleted string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(log, version=None):
    return sorted(map(tuple, log.read(version).collect()), key=repr)


@pytest.fixture
def log(spark):
    return ChangeLog(spark, scratch(spark, "log"), "id", SCHEMA)


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_batches_replace_and_delete_keys(spark, log):
    assert log.read().collect() == [] and log.versions() == []
    log.merge(frame(spark, [(1, "a", "x"), (2, "b", None), (None, "n", "x"), (2, "b", None)]), 0)
    assert state(log) == sorted([(1, "a", "x"), (2, "b", None), (2, "b", None), (None, "n", "x")], key=repr)
    log.merge(frame(spark, [(2, "c", "y"), (None, "m", None), (7, None, None)]), 1, keys(spark, 1, 2, 99))  # a key that is both named and written is written
    want = sorted([(2, "c", "y"), (None, "m", None), (7, None, None)], key=repr)
    assert state(log) == want
    log.merge(frame(spark, []), 2)
    assert state(log) == want and log.versions() == [0, 2, 4]
    log.merge(frame(spark, []), 3, keys(spark, None))
    want = [r for r in want if r[0] is not None]
    assert state(log) == sorted(want, key=repr)
    assert sorted(map(tuple, log.lookup(keys(spark, 2, 5)).collect())) == [(2, "c", "y")]
    before = state(log)
    log.compact()
    assert state(log) == before and [e[0] for e in log.entries()] == ["base"]
    log.merge(frame(spark, [(8, "z", "z")]), 4)
    assert state(log) == sorted([*before, (8, "z", "z")], key=repr)
    # versions still tell what was
    assert state(log, 4) == sorted([(2, "c", "y"), (None, "m", None), (7, None, None)], key=repr)


def test_a_batch_tried_again_replaces_its_first_attempt(spark, log):
    log.merge(frame(spark, [(1, "a", None), (2, "a", None)]), 0)
    log.merge(frame(spark, [(2, "b", None), (3, "b", None)]), 1)
    log.compact()  # and the job ends before its progress is noted
    log.vacuum()
    log.merge(frame(spark, [(2, "c", None)]), 1)
    assert state(log) == [(1, "a", None), (2, "c", None)] and log.versions() == [0, 2]
    # an attempt that ended before its manifest
    log.write(frame(spark, [(1, "lost", None)]).select(F.col("id").alias("key"), F.struct("*").alias("row"), F.lit(False).alias("deleted"), changelog.bucket_of(F.col("id")).alias("bucket")), f"{log.root}/delta={2:09d}")
    assert state(log) == [(1, "a", None), (2, "c", None)]
    log.merge(frame(spark, [(5, "e", None)]), 2)
    assert state(log) == [(1, "a", None), (2, "c", None), (5, "e", None)]
    # a manifest without its mark is not read
    remove(spark, f"{log.root}/manifest/version={4:09d}/_SUCCESS")
    assert log.versions() == [0, 2] and state(log) == [(1, "a", None), (2, "c", None)]


def test_compaction_merges_touched_buckets_and_old_files_go(spark, log, monkeypatch):
    log.merge(frame(spark, [(i, "a", None) for i in range(300)]), 0)
    log.compact()
    for n in range(1, 4):
        log.merge(frame(spark, [(n, f"b{n}", None)]), n)
    touched = {b for kind, _, held in log.entries() if kind == "delta" for b in held}
    log.compact()
    held = {(kind, n): set(b) for kind, n, b in log.entries()}
    assert set(held) == {("base", 0), ("base", 3)} and held["base", 3] == touched and not held["base", 0] & touched
    want = sorted([(i, f"b{i}" if 1 <= i <= 3 else "a", None) for i in range(300)], key=repr)
    assert state(log) == want
    gone = log.vacuum()
    # what batch 3 would need to be tried again is still there
    assert "delta=000000001" not in gone and "manifest/version=000000000" in gone
    log.merge(frame(spark, [(3, "again", None)]), 3)
    assert state(log) == sorted([(i, f"b{i}" if 1 <= i <= 2 else "again" if i == 3 else "a", None) for i in range(300)], key=repr)
    log.merge(frame(spark, []), 4)
    log.compact()
    log.merge(frame(spark, []), 5)
    log.vacuum()
    assert state(log) == sorted([(i, f"b{i}" if 1 <= i <= 2 else "again" if i == 3 else "a", None) for i in range(300)], key=repr)


def test_bytes_follow_the_changed_keys(spark, log):
    log.merge(frame(spark, [(i, f"text {i} " * 20, None) for i in range(20_000)]), 0)
    whole = bytes_in(spark, f"{log.root}/delta={0:09d}")
    log.merge(frame(spark, [(i, "new", None) for i in range(0, 20_000, 1000)]), 1)
    assert bytes_in(spark, f"{log.root}/delta={1:09d}") < whole / 10


def test_rows_of_a_table_are_not_shuffled_to_be_read(spark, log):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    log.merge(frame(spark, [(i, "a", None) for i in range(300)] + [(None, "a", None)]), 0)
    assert "Join" not in plan(log.read())
    log.merge(frame(spark, [(2, "b", None), (2, "c", None), (None, "d", None)]), 1, keys(spark, 1))
    assert plan(log.read()).count("Join") == 1 and "hashpartitioning" not in plan(log.read())
    assert sorted((r.key for r in log.keys(1).collect()), key=repr) == [1, 2, None]
    assert sorted(map(tuple, log.rows_of(1).collect()), key=repr) == sorted([(2, "b", None), (2, "c", None), (None, "d", None)], key=repr)
    want = sorted([(i, "a", None) for i in range(3, 300)] + [(0, "a", None), (2, "b", None), (2, "c", None), (None, "d", None)], key=repr)
    assert state(log) == want
    log.compact()
    log.merge(frame(spark, []), 2, keys(spark, 2))
    log.merge(frame(spark, [(1, "e", None)]), 3)
    assert state(log) == sorted([r for r in want if r[0] != 2] + [(1, "e", None)], key=repr)


def test_a_lookup_reads_only_its_buckets(spark, log):
    log.merge(frame(spark, [(i, "a", None) for i in range(200)]), 0)
    plan = log.lookup(keys(spark, 17))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert [tuple(r) for r in log.lookup(keys(spark, 17)).collect()] == [(17, "a", None)]


def documents(spark, folder, rows, name):
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.mode("append").parquet(f"file://{folder}")


def test_ingestion_of_many_batches_null_ids_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changelog, "MOST_DELTAS", 3)
    folder, out = tmp_path / "docs", f"file://{tmp_path}/out"
    latest = {}
    for n in range(6):
        rows = [(None, "s", f"null {n}"), (1, "s", "same"), (2, "s", f"v{n // 2}"), (10 + n, "t", "new"), (10 + n, "t", "new")]
        documents(spark, folder, rows, n)
        latest |= {i: t for i, _, t in rows}
        got = jobs.run_ingest(spark, f"file://{folder}", out).collect()
        assert {r.doc_id: r.chars for r in got} == {i: len(t) for i, t in latest.items()} and len(got) == len(latest)
    runs = [tuple(r) for r in jobs.ingestion_runs(spark, out).orderBy("run").select("run", "new", "changed", "unchanged").collect()]
    assert runs == [(0, 4, 0, 0), *[(n, 1, 2 - n % 2, 1 + n % 2) for n in range(1, 6)]]
    log = jobs.ChangeLog(spark, out, "doc_id", jobs.INGESTED)
    assert sum(kind == "delta" for kind, _, _ in log.entries()) < 3
    assert complete_versions(spark, f"{out}/manifest")[0] >= 0


def test_ingestion_tries_its_last_batch_again(spark, tmp_path):
    folder, out = tmp_path / "docs", f"file://{tmp_path}/out"
    documents(spark, folder, [(1, "s", "a"), (2, "s", "b")], 0)
    jobs.run_ingest(spark, f"file://{folder}", out)
    documents(spark, folder, [(2, "s", "bb"), (None, "s", "c")], 1)
    jobs.run_ingest(spark, f"file://{folder}", out)
    for mark in (tmp_path / "out-progress" / "commits").glob("*1*"):
        mark.unlink()  # as if the job had ended after its batch and before it was noted
    rows = {r.doc_id: r.chars for r in jobs.run_ingest(spark, f"file://{folder}", out).collect()}
    assert rows == {1: 1, 2: 2, None: 1}
    assert [tuple(r) for r in jobs.ingestion_runs(spark, out).orderBy("run").select("run", "new", "changed", "unchanged").collect()] == [(0, 2, 0, 0), (1, 1, 1, 0)]
