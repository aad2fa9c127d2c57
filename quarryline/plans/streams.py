"""Streaming and versioned-table queries over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.sources import tables
from quarryline.sources.changelog import ChangeLog
from quarryline.streaming import jobs

from . import texts
from .retrieval import table


def stream_log_levels(spark, sf_dir):
    tags = ["[LLM] ", "[KB-RAG] ", "[ERROR] ", "[GUARD] ", "[STEP 2/5] ", "", "[llm] ", "run completed: ", "cancelled "]

    def message(own: DataFrame) -> DataFrame:
        tag = F.element_at(F.array(*[F.lit(t) for t in tags]), ((F.col("conv_id") * 7 + F.col("turn")) % len(tags) + 1).cast("int"))
        return own.select("conv_id", "turn", F.concat(tag, "text").alias("message"))

    return jobs.run_log_stream(spark, f"{sf_dir}/conversations.parquet", message)


def stream_audit_counts(spark, sf_dir):
    return jobs.run_audit(spark, f"{sf_dir}/events.parquet")


def stream_run_progress(spark, sf_dir):
    return jobs.run_progress(spark, f"{sf_dir}/events.parquet")


def stream_retention(spark, sf_dir):
    """Events of the newest day and the 20 before it."""
    return jobs.run_retention(spark, f"{sf_dir}/events.parquet", 20).select("event_id", "event_type", "day")


def stream_ingest(spark, sf_dir):
    return jobs.run_ingest(spark, f"{sf_dir}/documents.parquet")


def upsert_by_source(spark, sf_dir):
    """Documents in a change log by source; those of even sources come again with new text, the others stay as they are on disk."""
    own = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("chars"))
    log = ChangeLog(spark, tables.scratch(spark, "chunk-log"), "source", "doc_id long, source string, chars int")
    log.merge(own, 0)
    log.merge(own.where(F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 0).withColumn("chars", -F.col("chars")), 1)
    return log.read()


def bundle_round_trip(spark, sf_dir):
    """Two languages exported, imported into the table of the first half of the documents."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("source_type"), F.length("text").alias("chars"))
    path = tables.scratch(spark, "bundle")
    tables.export_bundle(own, path, ["fr", "de"])
    return tables.import_bundle(own.where("chunk_id % 2 = 0"), path, "chunk_id long, source_type string, chars int", ["fr"])[0]


def text_files(spark, sf_dir):
    """Conversations as markdown files (every seventh empty), read back whole: file name, length and hash of those that aren't empty."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    own = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.when(F.col("conv_id") % 7 == 0, " ").otherwise(F.array_join(ordered, "\n")).alias("text"))
    path = tables.scratch(spark, "texts")
    tables.write_text_files(own.select(F.concat(F.col("conv_id").cast("string"), F.lit(".md")).alias("name"), "text"), path)
    found, _ = tables.read_text_files(spark, path)
    return found.select(F.regexp_extract("path", r"/(-?\d+)\.md$", 1).cast("long").alias("conv_id"), F.md5("text").alias("text_md5"))


def report_sink(spark, sf_dir):
    """Quality and abuse shares by source, written by label and read again."""
    own = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy(F.col("source").alias("label")).agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))
    path = tables.scratch(spark, "report")
    tables.write_report(own.unpivot("label", ["quality", "toxic"], "metric", "value"), path)
    return spark.read.schema("metric string, value double, label string").parquet(path)


QUERIES = {f.__name__: f for f in (stream_log_levels, stream_audit_counts, stream_run_progress, stream_retention, stream_ingest, upsert_by_source, bundle_round_trip, text_files, report_sink)}
SQL = {
    "stream_log_levels": texts.SQL["log_levels"],
    "stream_audit_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_run_progress": "SELECT user_id, count(*) AS done FROM events GROUP BY 1",
    "stream_retention": "SELECT event_id, event_type, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) - 20 FROM events)",
    "stream_ingest": "SELECT doc_id, source, sha256(coalesce(text, '')) AS content_hash, CAST(length(text) AS INTEGER) AS chars FROM documents",
    "upsert_by_source": "SELECT doc_id, source, CAST(CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 2 = 0 THEN -length(text) ELSE length(text) END AS INTEGER) AS chars FROM documents",
    "bundle_round_trip": "SELECT doc_id AS chunk_id, lang AS source_type, CAST(length(text) AS INTEGER) AS chars FROM documents WHERE doc_id % 2 = 0 OR lang = 'fr'",
    "text_files": "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5 FROM conversations WHERE conv_id % 7 <> 0 GROUP BY conv_id",
    "report_sink": "WITH a AS (SELECT source AS label, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT label, 'quality' AS metric, quality AS value FROM a UNION ALL SELECT label, 'toxic', toxic FROM a",
}
