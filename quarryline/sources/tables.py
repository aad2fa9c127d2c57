"""Reading source files and writing versioned tables, exports and reports."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIREMENT_COLUMNS = ("ReqID", "Source", "Target", "Category", "Description", "Mandatory")
BUNDLE_VERSION = 1
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_requirements_csv(spark: SparkSession, path: str) -> DataFrame:
    """Requirement files with header; absent columns are null, surplus fields are ignored."""
    own = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return own.select(*[F.col(c) if c in own.columns else F.lit(None).cast("string").alias(c) for c in REQUIREMENT_COLUMNS])


def read_text_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, text) of whole files, also in folders under path, UTF-8 or else Latin-1; and the paths of empty ones."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    own = own.select("path", text.alias("text"))
    some = F.col("text").rlike(r"\S")
    return own.where(some), own.where(~some).select("path")


def write_text_files(texts: DataFrame, path: str, folders: int = 256) -> int:
    """A UTF-8 file per row (name, text; null is empty) under path, whose file system Arrow must know (file, hdfs, s3, gs, abfs): path/folder/name, the folder by the name's hash. Returns their number.

    Tasks write the files themselves, as Spark's writer would open each by several processes of its own on a local or mounted disk and list and move them all in the driver. A file is moved to its name once it is whole,
    so that an attempt that ends early leaves hidden ones alone, and one that is tried again replaces its own. Names are to be different.
    """
    root = texts.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = root.getFileSystem(texts.sparkSession._jsparkSession.sessionState().newHadoopConf()).makeQualified(root).toString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = pa.fs.FileSystem.from_uri(uri)
        made = set()
        for batch in batches:
            for folder, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = f"{top}/{folder}"
                if folder not in made:
                    files.create_dir(at, recursive=True)
                    made.add(folder)
                with files.open_output_stream(part := f"{at}/.{name}-{uuid.uuid4().hex}") as out:
                    out.write((text or "").encode())
                files.move(part, f"{at}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    own = texts.select(F.pmod(F.xxhash64("name"), F.lit(folders)).alias("folder"), "name", "text")
    return own.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def replaced_per_source(existing: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """The new rows, and existing ones of sources that the new ones don't have."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_version(table: DataFrame, root: str, version: int, partition_by: str | None = None) -> str:
    """A new version of a table under root; writing a version again replaces it, so that retried batches agree."""
    path = f"{root}/version={version:09d}"
    writer = table.write.mode("overwrite")
    with shuffles_removed(table.sparkSession):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def export_bundle(chunks: DataFrame, path: str, source_types: list[str]) -> None:
    """JSON lines of the chosen source types, without embeddings, with the bundle's version."""
    own = chunks.where(F.col("source_type").isin(source_types))
    own.drop(*[c for c in own.columns if c == "embedding"]).withColumn("bundle_version", F.lit(BUNDLE_VERSION)).write.mode("overwrite").json(path)


def import_bundle(existing: DataFrame, path: str, schema: str, source_types: list[str], overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table after the import, and counts of imported and skipped rows. Known ids are skipped, or replaced if overwrite."""
    new = existing.sparkSession.read.schema(f"{schema}, bundle_version int").json(path)
    new = new.where((F.col("bundle_version") == BUNDLE_VERSION) & F.col("source_type").isin(source_types)).drop("bundle_version").dropDuplicates(["chunk_id"])
    known = new.join(existing.select("chunk_id"), "chunk_id", "left_semi")
    fresh = new.join(existing.select("chunk_id"), "chunk_id", "left_anti")
    counts = fresh.agg(F.count(F.lit(1)).alias("imported")).crossJoin(known.agg(F.count(F.lit(1)).alias("known")))
    counts = counts.select((F.col("imported") + (F.col("known") if overwrite else F.lit(0))).alias("imported"), (F.lit(0) if overwrite else F.col("known")).alias("skipped"))
    if overwrite:
        return existing.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new), counts
    return existing.unionByName(fresh), counts


def write_report(metrics: DataFrame, path: str) -> None:
    """A long table (label, metric, value), a folder per label."""
    metrics.select("label", "metric", "value").write.mode("overwrite").partitionBy("label").parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared checkpoint folder; a session on this machine alone gets a temporary one, on a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within are removed after each write (a public Spark setting); else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)


def stored(table: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again: what several branches of a plan read is computed once, and survives lost executors."""
    path = scratch(table.sparkSession, name)
    with shuffles_removed(table.sparkSession):
        table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def complete_versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of a table's complete versions under root."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [f.getPath() for f in files.listStatus(path) if f.getPath().getName().startswith("version=")]
    return [int(p.getName().split("=")[1]) for p in names if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan over as many tasks as run at once, where its files give fewer (few files, or row groups too large to split); otherwise the scan as it is, so large inputs are not shuffled."""
    tasks = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan


def latest_version(spark: SparkSession, root: str) -> int | None:
    """The number of the last complete version of a table under root; None if there is none."""
    return max(complete_versions(spark, root), default=None)


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder; whether it was there."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(file, True)


def bytes_in(spark: SparkSession, path: str) -> int:
    """Bytes of all files in a folder."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(file).getLength()
