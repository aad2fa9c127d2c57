import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, own = [docs.count()], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, own, sf_dir).write.parquet(f"{tmp_path}/{k}")
        own = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert own.columns == docs.columns
            counts.append(own.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3] == counts[4]
    assert own.select("doc_id").distinct().count() == counts[4]
    run = corpus_pipeline.run(spark, sf_dir)
    assert run.columns == own.columns and run.agg({"length": "sum"}).first()[0] == own.agg({"length": "sum"}).first()[0]


def test_stages_on_an_empty_table(spark, sf_dir, tmp_path):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, own, sf_dir).write.parquet(f"{tmp_path}/{k}")
        own = spark.read.parquet(f"{tmp_path}/{k}")
    assert own.count() == 0


@pytest.fixture(scope="module")
def odd_documents(spark, sf_dir):
    """Documents with nulls, empty and very long texts, repeated rows and ids, and columns that helpers might be called."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = docs.where("lang = 'en' AND length(text) BETWEEN 300 AND 900").orderBy("doc_id").first().text
    odd = [(None, clean), (None, clean), (900_001, None), (900_002, ""), (900_003, clean), (900_003, clean), (900_004, " ".join([clean] * 300)), (900_005, "日本語の文字は別の言語である " * 40)]
    extra = spark.createDataFrame(odd, "doc_id long, text string").select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    names = ("row", "score", "found", "node", "digest", "bucket", "label", "place")
    return docs.unionByName(extra).select("*", *[F.lit(f"mine {n}").alias(n) for n in names]), clean


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_treat_odd_rows_as_they_say(spark, sf_dir, odd_documents, k):
    docs, clean = odd_documents
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r.row == "mine row" and r.node == "mine node" for r in rows)
    ids = [r.doc_id for r in rows]
    text = {r.doc_id: r.text for r in rows}
    if name == "language ID":
        assert 900_001 not in ids and 900_002 not in ids and 900_005 not in ids
        assert ids.count(None) == 2 and ids.count(900_003) == 2 and 900_004 in ids
    elif name == "near-dedup":
        assert ids.count(None) == 2 and 900_001 in ids and 900_002 in ids and 900_003 not in ids  # an original is there
        assert len(ids) - 2 == len({i for i in ids if i is not None})
    elif name == "decontamination":
        assert text[900_001] is None and text[900_002] == "" and ids.count(900_003) == 2 and ids.count(None) == 2
    else:
        assert len(ids) == docs.count() and text[900_001] is None and text[900_002] == ""
        assert all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in rows)
        assert sum(r.text is None for r in rows) == docs.where("text IS NULL").count()


def test_last_stage_of_odd_rows(spark, sf_dir, odd_documents):
    docs, _ = odd_documents
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()
    by_id = {}
    for r in pieces:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [p.doc_tokens for p in by_id[900_001]] == [1] == [p.doc_tokens for p in by_id[900_002]]
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert sum(p.start == 0 for p in by_id[None]) == 2


@pytest.mark.parametrize("k", range(5))
def test_stages_of_an_empty_table(spark, sf_dir, odd_documents, k):
    assert corpus_pipeline.STAGES[k][1](spark, odd_documents[0].limit(0), sf_dir).count() == 0
