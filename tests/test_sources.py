from quarryline.operators.catalog import parse_requirements
from quarryline.sources import tables
from quarryline.streaming import jobs


def test_requirements_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("ReqID,Source,Target,Category,Description\nR1,ERP,,Sync,one\nR2, ,PIM,,two, cut\n")
    rows = parse_requirements(tables.read_requirements_csv(spark, f"file://{tmp_path}/r.csv")).orderBy("ReqID").collect()
    assert [tuple(r) for r in rows] == [("R1", "ERP", "Unknown", "Sync", "one", False), ("R2", "Unknown", "PIM", "Sync", "two", False)]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é ok".encode())
    (tmp_path / "b.txt").write_bytes("é old".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b" \n")
    good, empty = tables.read_text_files(spark, f"file://{tmp_path}")
    assert sorted(r.text for r in good.collect()) == ["é ok", "é old"]
    assert [r.path.rsplit("/", 1)[1] for r in empty.collect()] == ["c.txt"]


def test_text_files_are_written_by_tasks(spark, tmp_path):
    texts = {f"{i}.md": f"é {i}\n\n" if i % 3 else None if i % 2 else " " for i in range(500)}
    own = spark.createDataFrame(list(texts.items()), "name string, text string")
    assert [tables.write_text_files(own, f"file://{tmp_path}/x", 40) for _ in range(2)] == [500, 500]  # a second attempt replaces the first
    assert tables.write_text_files(own.limit(0), f"file://{tmp_path}/none") == 0
    files = [p for p in (tmp_path / "x").rglob("*") if p.is_file()]
    assert {p.name: p.read_text() for p in files} == {k: v or "" for k, v in texts.items()} and len(files) == 500
    assert len([*(tmp_path / "x").iterdir()]) <= 40  # not a folder each
    good, empty = tables.read_text_files(spark, f"file://{tmp_path}/x")
    assert {r.path.rsplit("/", 1)[1]: r.text for r in good.collect()} == {k: v for k, v in texts.items() if (v or "").strip()}
    assert {k for k, v in texts.items() if v == " "} <= {r.path.rsplit("/", 1)[1] for r in empty.collect()}  # Spark's reader passes over files of no byte


def test_bundle_import_skips_or_overwrites(spark, tmp_path):
    rows = [(1, "file", "a"), (2, "url", "b"), (3, "file", "c")]
    own = spark.createDataFrame(rows, "chunk_id long, source_type string, text string")
    tables.export_bundle(own, f"file://{tmp_path}/x", ["file", "url"])
    existing = spark.createDataFrame([(1, "file", "old")], own.schema)
    schema = "chunk_id long, source_type string, text string"
    got, counts = tables.import_bundle(existing, f"file://{tmp_path}/x", schema, ["file"])
    assert sorted(map(tuple, got.collect())) == [(1, "file", "old"), (3, "file", "c")] and tuple(counts.first()) == (1, 1)
    got, counts = tables.import_bundle(existing, f"file://{tmp_path}/x", schema, ["file"], overwrite=True)
    assert sorted(map(tuple, got.collect())) == [(1, "file", "a"), (3, "file", "c")] and tuple(counts.first()) == (2, 0)


def test_replacing_a_source(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "source string, v int")
    new = spark.createDataFrame([("a", 9)], "source string, v int")
    assert sorted(map(tuple, tables.replaced_per_source(old, new).collect())) == [("a", 9), ("b", 2)]


def test_ingestion_in_batches_equals_one_batch(spark, tmp_path):
    a = spark.createDataFrame([(1, "s", "one"), (2, "s", "two"), (2, "s", "two")], "doc_id long, source string, text string")
    a.coalesce(1).write.parquet(f"file://{tmp_path}/docs")
    first = jobs.run_ingest(spark, f"file://{tmp_path}/docs")
    assert first.count() == 2
    spark.createDataFrame([(2, "s", "changed"), (3, "t", None)], a.schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/docs")
    rows = {r.doc_id: r.chars for r in jobs.run_ingest(spark, f"file://{tmp_path}/docs").collect()}
    assert set(rows) == {1, 2, 3} and rows[1] == 3


def test_log_stream_equals_batch(spark, tmp_path):
    lines = spark.createDataFrame([("[LLM] a",), ("[ERROR] b",), ("plain",)], "message string")
    lines.write.parquet(f"file://{tmp_path}/log")
    batch = sorted(map(tuple, jobs.structured_log(spark.read.parquet(f"file://{tmp_path}/log")).collect()))
    assert sorted(map(tuple, jobs.run_log_stream(spark, f"file://{tmp_path}/log", lambda d: d).collect())) == batch == [("ERROR", "b"), ("INFO", "plain"), ("LLM", "a")]


def test_ingestion_goes_on_after_a_restart(spark, tmp_path):
    """A second run on the same folders only reads what is new, and keeps what the first one made."""
    out, schema = f"file://{tmp_path}/table", "doc_id long, source string, text string"
    spark.createDataFrame([(1, "s", "one"), (2, "s", "two"), (2, "s", "two")], schema).coalesce(1).write.parquet(f"file://{tmp_path}/docs")
    assert jobs.run_ingest(spark, f"file://{tmp_path}/docs", out).count() == 2
    spark.createDataFrame([(2, "s", "changed"), (3, "t", None), (1, "s", "one")], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/docs")
    rows = {r.doc_id: r.chars for r in jobs.run_ingest(spark, f"file://{tmp_path}/docs", out).collect()}
    assert rows == {1: 3, 2: 7, 3: None}
    runs = [tuple(r) for r in jobs.ingestion_runs(spark, out).orderBy("run").select("run", "new", "changed", "unchanged", "diff").collect()]
    assert runs == [(0, 2, 0, 0, True), (1, 1, 1, 1, True)]
    # without new files nothing happens
    assert jobs.run_ingest(spark, f"file://{tmp_path}/docs", out).count() == 3 and jobs.ingestion_runs(spark, out).count() == 2
