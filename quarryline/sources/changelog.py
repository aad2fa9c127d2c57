"""Tables kept as base files and deltas, both bucketed by key, merged when they are read.

Layout under a folder, all Parquet with columns key, row (a struct of the table's columns) and deleted, in folders by bucket (a hash of the key):
  base=n       merged rows of some buckets after batch n
  delta=n      the rows of batch n
  keys=n       the different keys that batch n names, each once (column key alone)
  manifest/version=v   which buckets of which bases and deltas make up the table: v = 2n after batch n, 2n + 1 once it has been compacted

The rows of a key in the newest delta that names the key replace all older rows of that key; a key can have many rows (a source and its documents), and one that is deleted has none. A batch writes its own rows
and a manifest, so bytes follow what changed. A manifest is written last and read only when complete: a job that ends before it leaves the table as it was, and a batch that
is tried again under its number replaces what its first attempt wrote. Compaction merges only buckets that have deltas. `vacuum` keeps what the last two batches need, so that the last one can be tried again.

Defined cases: null is a key like others; an empty batch changes nothing and still has its manifest; of equal rows in a batch each stays; the table's own columns may have any names; a table without batches is empty.
"""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import complete_versions, remove, write_version

BUCKETS = 32
#: Deltas after which a log is due for compaction.
MOST_DELTAS = 8
MANIFEST = "kind string, number long, buckets array<int>"


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


@dataclasses.dataclass(frozen=True)
class ChangeLog:
    """A table of the given columns (DDL) under root, by one key column."""

    spark: SparkSession
    root: str
    key: str
    schema: str

    @functools.cached_property
    def fields(self) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.spark.createDataFrame([], self.schema).schema}

    def versions(self) -> list[int]:
        return sorted(complete_versions(self.spark, f"{self.root}/manifest"))

    def entries(self, version: int | None = None) -> list[tuple[str, int, list[int]]]:
        """Of the last manifest, or of that version: never more than one row per base and delta that is still needed."""
        done = self.versions()
        version = version if version is not None else done[-1] if done else None
        if version is None:
            return []
        return [tuple(r) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/version={version:09d}").collect()]

    def files(self, entry: tuple[str, int, list[int]], buckets: list[int] | None) -> DataFrame:
        kind, number, held = entry
        row = ", ".join(f"`{c}`: {t}" for c, t in self.fields.items())
        own = self.spark.read.schema(f"key {self.fields[self.key]}, row struct<{row}>, deleted boolean, bucket int").parquet(f"{self.root}/{kind}={number:09d}")
        return own.where(F.col("bucket").isin(held if buckets is None else sorted({*held} & {*buckets}))).withColumn("number", F.lit(number))

    def keys(self, number: int) -> DataFrame:
        """The different keys that batch `number` wrote or deleted."""
        return self.spark.read.schema(f"key {self.fields[self.key]}").parquet(f"{self.root}/keys={number:09d}")

    def rows_of(self, number: int) -> DataFrame:
        """The rows that batch `number` wrote, none of them joined with anything."""
        return self.files(("delta", number, list(range(BUCKETS))), None).where(~F.col("deleted")).select("row.*")

    def live(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """key, row, bucket of the table. What is not of the newest delta is joined with the keys that later deltas name, from their own small files, so that few of them are broadcast; a lone delta or base is read as it is."""
        entries = self.entries(version)
        entries = sorted(entries, key=lambda e: (e[0] == "delta", e[1]))
        columns = ["key", "row", "bucket"]
        if not entries:
            return self.nothing()
        deltas = [n for kind, n, _ in entries if kind == "delta"]
        # bases come before all deltas, whatever their number
        each = [self.files(e, buckets).where(~F.col("deleted")).withColumn("number", F.lit(e[1] if e[0] == "delta" else -1)) for e in entries]
        if not deltas or len(each) == 1:
            return functools.reduce(DataFrame.unionByName, each).select(*columns)
        old, later = functools.reduce(DataFrame.unionByName, each[:-1]), [n for n in deltas if n > deltas[0] or len(deltas) < len(each)]
        named = functools.reduce(DataFrame.unionByName, [self.keys(n).select(F.col("key").alias("named"), F.lit(n).alias("later")) for n in later])
        return old.join(named, F.col("key").eqNullSafe(F.col("named")) & (F.col("number") < F.col("later")), "left_anti").unionByName(each[-1]).select(*columns)

    def nothing(self) -> DataFrame:
        row = ", ".join(f"`{c}`: {t}" for c, t in self.fields.items())
        return self.spark.createDataFrame([], f"key {self.fields[self.key]}, row struct<{row}>, bucket int")

    def read(self, version: int | None = None) -> DataFrame:
        return self.live(version).select("row.*")

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The table's rows of some keys (a DataFrame with the key column alone): only their buckets are read."""
        wanted = keys.select(F.col(self.key).alias("wanted")).distinct()
        buckets = [r.b for r in wanted.select(bucket_of(F.col("wanted")).alias("b")).distinct().collect()]  # at most BUCKETS
        return self.live(version, buckets).join(wanted, F.col("key").eqNullSafe(F.col("wanted")), "left_semi").select("row.*")

    def before(self, number: int) -> int | None:
        """The last manifest that batch `number` starts from; None for the first one."""
        return max((v for v in self.versions() if v < 2 * number), default=None)

    def write(self, rows: DataFrame, path: str) -> list[int]:
        """Writes key, row, deleted, bucket by bucket, a large one in several files; returns the buckets that have rows."""
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return sorted(r.bucket for r in self.spark.read.schema("deleted boolean, bucket int").parquet(path).select("bucket").distinct().collect())

    def merge(self, rows: DataFrame, number: int, gone: DataFrame | None = None) -> None:
        """Batch `number`: rows replace all of their keys' rows, keys in gone (the key column) lose theirs; numbers rise, and a batch that is tried again keeps its own."""
        for version in self.versions():
            if version >= 2 * number:  # of an attempt that was not finished
                remove(self.spark, f"{self.root}/manifest/version={version:09d}")
        start = self.before(number)
        entries = self.entries(start) if start is not None else []
        row = F.struct(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in self.fields.items()])
        own = rows.select(F.col(f"`{self.key}`").cast(self.fields[self.key]).alias("key"), row.alias("row"), F.lit(False).alias("deleted"))
        if gone is not None:
            named = gone.select(F.col(f"`{self.key}`").cast(self.fields[self.key]).alias("key"), F.lit(None).cast(own.schema["row"].dataType).alias("row"), F.lit(True).alias("deleted")).distinct()
            own = own.unionByName(named.join(own.select(F.col("key").alias("named")).distinct(), F.col("key").eqNullSafe(F.col("named")), "left_anti"))
        path = f"{self.root}/delta={number:09d}"
        buckets = self.write(own.withColumn("bucket", bucket_of(F.col("key"))), path)
        self.spark.read.schema(f"key {self.fields[self.key]}, bucket int").parquet(path).select("key").distinct().write.mode("overwrite").parquet(f"{self.root}/keys={number:09d}")
        self.commit([*entries, *([("delta", number, buckets)] if buckets else [])], 2 * number)

    def commit(self, entries: list[tuple[str, int, list[int]]], version: int) -> None:
        write_version(self.spark.createDataFrame(entries, MANIFEST).coalesce(1), f"{self.root}/manifest", version)

    def due(self) -> bool:
        return sum(kind == "delta" for kind, _, _ in self.entries()) >= MOST_DELTAS

    def compact(self) -> None:
        """The buckets that have deltas become a new base; other buckets' bases stay as they are."""
        last = self.versions()[-1]
        entries, number = self.entries(last), last // 2
        touched = sorted({b for kind, _, held in entries if kind == "delta" for b in held})
        if not touched:
            return
        rows = self.live(last, touched).withColumn("deleted", F.lit(False)).select("key", "row", "deleted", "bucket")
        made = self.write(rows, f"{self.root}/base={number:09d}")
        kept = [(kind, n, rest) for kind, n, held in entries if kind == "base" and (rest := [b for b in held if b not in touched])]
        self.commit([*kept, ("base", number, made)] if made else kept, 2 * number + 1)

    def vacuum(self) -> list[str]:
        """Removes manifests before those of the last two batches, and bases and deltas that none of these names. Returns what went."""
        done = self.versions()
        if not done:
            return []
        numbers = sorted({v // 2 for v in done})
        # the batch before the last one is where the last one starts if it is tried again
        first = max((v for v in done if v // 2 < numbers[-1]), default=done[0])
        named = {(kind, n) for v in done if v >= first for kind, n, _ in self.entries(v)}
        old = [f"manifest/version={v:09d}" for v in done if v < first]
        for kind in ("base", "delta"):
            gone = [n for n in range(numbers[-1] + 1) if (kind, n) not in named]
            old += [f"{folder}={n:09d}" for n in gone for folder in ([kind, "keys"] if kind == "delta" else [kind])]
        return [x for x in old if remove(self.spark, f"{self.root}/{x}")]
