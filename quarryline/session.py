"""Session settings that suit the library's jobs; on a cluster the sizes come from its own configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "quarryline", cores: int = 8, partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session on this machine, as in tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
