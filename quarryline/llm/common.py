"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tokenizer file of the token operators, by its public name.
TOKENIZER = "word_bpe_49k.json"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset, a session on this machine alone (local[...], as in tests) gets a temporary folder; on a cluster it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """A write's own shuffle files are no longer needed afterwards and are removed (a public Spark setting)."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)


def written(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts lineage and survives lost executors. rows_a_file: most rows of a file, for wide rows (readers take thousands of rows of a file at once; 0: any)."""
    spark, path = df.sparkSession, new_table_path(df.sparkSession, name)
    schema = df.schema
    with shuffles_removed(spark):
        df.write.option("maxRecordsPerFile", rows_a_file).parquet(path, compression="zstd")
    table = spark.read.schema(schema).parquet(path)
    table.path_written = path
    return table


def removed(spark: SparkSession, path: str) -> None:
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(file, True)


def forget(*tables: DataFrame) -> None:
    """Removes the files of tables from `written` that nothing reads any more."""
    for table in tables:
        removed(table.sparkSession, table.path_written)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
