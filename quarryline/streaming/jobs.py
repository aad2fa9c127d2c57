"""Structured Streaming jobs: logs, audit events, progress and incremental ingestion. Each runs with availableNow and ends when its input is read.

Watermarks equal the retention of the logs: later rows are dropped, and state older than that leaves. Tables are change logs: a batch writes the rows of the keys that it changed under its number, so that a retried batch
replaces its own. All state is in the checkpoint and in the tables themselves, none in the driver: a stopped job that is started again on the same
folders goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as x
from quarryline.sources.changelog import ChangeLog
from quarryline.sources.tables import scratch, stored, write_version

RETENTION_DAYS = 90
RETENTION = f"{RETENTION_DAYS} days"


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A stream over the files of a Parquet table, a folder or a single file (written as a pattern, which may be either)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def appended(stream: DataFrame, out: str) -> DataFrame:
    """Runs a stateless stream to a Parquet table and reads it."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def structured_log(messages: DataFrame) -> DataFrame:
    """level and text of log messages (message)."""
    return messages.select("*", x.log_level(F.col("message")).alias("level"), x.without_log_prefix(F.col("message")).alias("clean")).drop("message")


AUDIT = "key string, start timestamp_ntz, event_type string, n long"
PROGRESS = "user_id long, done long"


def once_within_retention(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Events (ts and a key) without repeats: a repeat within RETENTION of the newest event goes, and so does what comes later than that. State holds the keys of that time alone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", RETENTION).dropDuplicatesWithinWatermark([key])


def audit_counts(events: DataFrame, length: str = "1 day") -> DataFrame:
    """Different events per window and type, as rows of AUDIT: events (ts, event_id, event_type). Windows leave the state once the watermark has passed them."""
    own = once_within_retention(events).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.concat_ws("|", F.col("w.start").cast("string"), "event_type").alias("key"), F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def merged(stream: DataFrame, log: ChangeLog, step: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Runs a stream in update mode; the rows that a batch changed (after step) replace those of their keys in a change log, whose table is the result."""

    def write(batch: DataFrame, number: int) -> None:
        log.merge(step(batch, number) if step else batch, number)
        tidied(log)

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{log.root}-progress").trigger(availableNow=True).start().awaitTermination()
    return log.read()


def tidied(log: ChangeLog) -> None:
    if log.due():
        log.compact()
        log.vacuum()


def progress(events: DataFrame, out: str) -> DataFrame:
    """Events done per user (a null one too). A batch's counts are added to those that the table had before it, so the stream itself keeps no state, and a batch that is tried again adds to the same numbers."""
    log = ChangeLog(events.sparkSession, out, "user_id", PROGRESS)

    def step(batch: DataFrame, number: int) -> DataFrame:
        new = stored(batch.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("done")), "progress-batch")
        start = log.before(number)
        if start is None:
            return new
        old = log.lookup(new.select("user_id"), start).select(F.col("user_id").alias("old_user"), F.col("done").alias("before"))
        return new.join(old, F.col("user_id").eqNullSafe(F.col("old_user")), "left").select("user_id", (F.col("done") + F.coalesce("before", F.lit(0))).alias("done"))

    return merged(events, log, step)


RETAINED = "day date, event_id long, event_type string, ts timestamp"


def retained(events: DataFrame, out: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Events (ts, event_id, event_type) of the newest day and the `days` before it, each once.

    The table is a change log by day: a batch writes its own days again with what is new, and days that have grown too old are dropped by name, without reading them. The newest day is that of all
    batches so far, so that late events of days that are gone stay out.
    """
    spark = events.sparkSession
    log = ChangeLog(spark, out, "day", RETAINED)

    def write(batch: DataFrame, number: int) -> None:
        new = stored(batch.where("ts IS NOT NULL").select(F.to_date("ts").alias("day"), F.col("event_id").cast("long"), F.col("event_type").cast("string"), F.col("ts").cast("timestamp").alias("ts")), "retained-batch")
        start = log.before(number)
        old = log.lookup(new.select("day"), start) if start is not None else spark.createDataFrame([], RETAINED)
        days_ = new.select("day").unionByName(log.read(start).select("day")) if start is not None else new.select("day")
        newest = days_.agg(F.max("day")).first()[0]
        if newest is None:
            log.merge(new, number)
            return
        least = F.date_sub(F.lit(newest), days)
        rows = old.unionByName(new).where(F.col("day") >= least).dropDuplicates(["day", "event_id"])
        log.merge(rows, number, days_.where(F.col("day") < least).distinct())
        tidied(log)

    events.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    return log.read()


INGESTED = "doc_id long, source string, content_hash string, chars int"


def ingest(documents: DataFrame, out: str) -> DataFrame:
    """Batches of documents replace the chunks of their ids where their content has changed: id, source, content hash, size.

    The table is a change log by doc_id (a null one is an id like others): a batch reads the buckets of its ids, writes its new and changed rows, and every few batches the log is compacted and what nothing
    needs any more is removed. Of a batch's rows with one id the one with the smallest hash counts. Beside the log, out-runs gets a row per batch (new, changed and unchanged ids,
    whether anything changed) and out-snapshots the hashes that a batch brought: both are written by batch number, so that a retried batch replaces its own.
    """
    spark = documents.sparkSession
    log = ChangeLog(spark, out, "doc_id", INGESTED)

    def step(batch: DataFrame, number: int) -> None:
        found = batch.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.length("text").alias("chars"))
        new = found.groupBy("doc_id").agg(F.min_by(F.struct("source", "content_hash", "chars"), F.struct("content_hash", "source")).alias("own")).select("doc_id", "own.*")
        new = stored(new, "ingest-batch")
        # a batch that is tried again starts from the version before it
        start = log.before(number)
        old = log.lookup(new.select("doc_id"), start) if start is not None else spark.createDataFrame([], INGESTED)
        old = old.select(F.col("doc_id").alias("old_id"), F.col("content_hash").alias("old_hash"))
        state = new.join(old, F.col("doc_id").eqNullSafe(F.col("old_id")), "left")
        state = state.withColumn("state", F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("content_hash"), "unchanged").otherwise("changed"))
        write_version(state.select("doc_id", "content_hash", "state"), f"{out}-snapshots", number)
        known = spark.read.parquet(f"{out}-snapshots/version={number:09d}")
        counts = [F.count_if(F.col("state") == s).alias(s) for s in ("new", "changed", "unchanged")]
        run = known.agg(*counts).select(F.lit(number).alias("run"), "*", ((F.col("new") + F.col("changed")) > 0).alias("diff"))
        write_version(run, f"{out}-runs", number)
        same = known.where("state = 'unchanged'").select(F.col("doc_id").alias("same_id"))
        log.merge(new.join(same, F.col("doc_id").eqNullSafe(F.col("same_id")), "left_anti"), number)
        tidied(log)

    documents.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    return log.read()


def ingestion_runs(spark: SparkSession, out: str) -> DataFrame:
    """Run rows of all batches so far."""
    return spark.read.parquet(f"{out}-runs/version=*")


def run_log_stream(spark: SparkSession, path: str, message: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return appended(structured_log(message(stream_of(spark, path))), scratch(spark, "log-stream"))


def run_audit(spark: SparkSession, path: str) -> DataFrame:
    return merged(audit_counts(stream_of(spark, path)), ChangeLog(spark, scratch(spark, "audit"), "key", AUDIT)).drop("key")


def run_progress(spark: SparkSession, path: str) -> DataFrame:
    return progress(stream_of(spark, path), scratch(spark, "progress"))


def run_retention(spark: SparkSession, path: str, days: int = RETENTION_DAYS) -> DataFrame:
    return retained(stream_of(spark, path, 1), scratch(spark, "retained"), days)


def run_ingest(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """out: the table's folder; a run on the same one goes on from there."""
    return ingest(stream_of(spark, path, 1), out or scratch(spark, "ingest"))
