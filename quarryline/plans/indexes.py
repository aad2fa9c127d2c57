"""Queries over stored indexes, and the same in SQL on the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import cells, postings
from quarryline.operators import retrieval as r
from quarryline.sources.tables import scratch

from .retrieval import BM25, chunks, text_queries, vectors
from .retrieval import SQL as SCANNED


def indexed(spark: SparkSession, sf_dir: str) -> str:
    root = scratch(spark, "postings")
    postings.write_index(chunks(spark, sf_dir).select("chunk_id", "source", "text"), root)
    return root


def of_even_sources() -> Column:
    return F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 0


def stored_bm25_topk(spark, sf_dir) -> DataFrame:
    return postings.Search(spark, indexed(spark, sf_dir), text_queries(spark, sf_dir), 5).top()


def stored_bm25_replaced(spark, sf_dir) -> DataFrame:
    """Chunks of even sources are replaced in the index by longer ones before it is searched."""
    root = indexed(spark, sf_dir)
    new = chunks(spark, sf_dir).where(of_even_sources()).select("chunk_id", "source", F.concat(F.lit("replaced "), "text", F.lit(" replaced")).alias("text"))
    postings.replace_sources(new, root)
    return postings.Search(spark, root, text_queries(spark, sf_dir), 5).top()


def stored_blocks_read(spark, sf_dir) -> DataFrame:
    """Of each query the blocks that share a term with it, those that were read, and the share skipped. How chunks are dealt to blocks is the index's own, so there is no SQL for it."""
    return postings.Search(spark, indexed(spark, sf_dir), text_queries(spark, sf_dir), 5).report()


def celled(spark: SparkSession, sf_dir: str, metric: str) -> tuple[cells.CellIndex, DataFrame, DataFrame]:
    c, q = vectors(spark, sf_dir)
    index = cells.CellIndex(spark, scratch(spark, "cells"), metric)
    index.write(c.select("chunk_id", "embedding"))
    return index, c, q


def stored_dense_top10(spark, sf_dir) -> DataFrame:
    index, _, q = celled(spark, sf_dir, "l2")
    return r.ranked(r.dense_scores(cells.top(index.near(q, 10), 10)))


def stored_cosine_search(spark, sf_dir) -> DataFrame:
    index, _, q = celled(spark, sf_dir, "cosine")
    return cells.top(index.near(q, 10), 10).select("query_id", "chunk_id", F.round(1 - F.col("distance"), 4).alias("score"))


def stored_vectors_tested(spark, sf_dir) -> DataFrame:
    """Of each query the vectors that it was multiplied with, and the share skipped. The cells are the index's own, so there is no SQL for it."""
    index, c, q = celled(spark, sf_dir, "l2")
    return cells.report(index.near(q, 10), c.count())


TOP = "SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM top_bm25 WHERE rank <= 5"
REPLACED = BM25.replace("FROM documents)", "FROM (SELECT * REPLACE (CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 2 = 0 THEN 'replaced ' || text || ' replaced' ELSE text END AS text) FROM documents))", 1)
QUERIES = {f.__name__: f for f in (stored_bm25_topk, stored_bm25_replaced, stored_blocks_read, stored_dense_top10, stored_cosine_search, stored_vectors_tested)}
SQL = {"stored_bm25_topk": f"WITH {BM25} {TOP}", "stored_bm25_replaced": f"WITH {REPLACED} {TOP}", "stored_dense_top10": SCANNED["dense_top10"], "stored_cosine_search": SCANNED["dense_cosine_search"]}
