"""Merkle fixity audit of WARC files.

Records lie one after the other in WARC files. A record's leaf is the SHA-256 of its bytes and its offset range; FAN consecutive nodes of a level
have a parent, whose hash is that of their hashes and offset ranges in order and whose range spans theirs. A file's root stands for the whole file.

Files are written by Spark's text writer (a record's end is the line separator), compressed as is usual for WARC, and read by its binary reader; offsets
are those of the plain file. A task parses a file at a time, which has FILE_PAGES pages at most, and gives the nodes of its tree. Two replicas are compared from the roots down: only children of nodes
that differ are looked at on the next level. Records below the differing leaves are then matched by their id, which tells changed records from
missing and additional ones; records that are merely moved by these are not reported. After a missing or additional record the ranges of the rest
of its file differ, so that rest is opened too.

Trees hold hashes, ids and offsets only. All joins are by file and shuffled: nothing is broadcast.

Defined cases: null fields of a page count as empty, line breaks in a url are written as %0D and %0A; pages with a null id go to files by a hash of their
content; records of one id and file are told apart by their order, repeated rows by their number; very long pages are records like others; what cannot be
parsed in a file, up to the next record's start, is a record without id; an empty table gives no rows; a file that only one replica has
is reported record by record; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_table_path, removed, shuffles_removed, written

FAN = 16
#: Page ids of a file.
FILE_PAGES = 1024
#: Of so many pages one is changed, one missing and one added twice in the sample replica.
DAMAGE = 97
#: A record's first line and what ends it (fixed values of the format).
START = "WARC/1.1\r\n"
END = "\r\n\r\n"
NODES = "file_id long, level int, idx long, hash string, start long, stop long, record_id long, copy int"


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A record without its END."""
    body, target = F.coalesce(html, F.lit("")), F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"{START}WARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), target,
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
    )


def write_files(pages: DataFrame, path: str) -> None:
    """WARC files of pages (page_id, url, html), a folder per file_id."""
    file_id = F.coalesce(F.floor(F.col("page_id") / FILE_PAGES), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(4096)))
    own = pages.select(file_id.alias("file_id"), "page_id", warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    own = own.repartition("file_id").sortWithinPartitions("file_id", "page_id", "record").select("file_id", "record")
    with shuffles_removed(pages.sparkSession):
        own.write.option("lineSep", END).partitionBy("file_id").text(path, compression="gzip")


HEADER = re.compile(rb"WARC/1\.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:(-?\d*)>\r\nWARC-Target-URI: [^\r\n]*\r\nContent-Length: (\d+)\r\n\r\n")


def parsed(data: bytes) -> Iterator[tuple[int | None, int, int]]:
    """(record id, start, stop) of a file's records."""
    at, mark, end = 0, START.encode(), END.encode()
    while at < len(data):
        head = HEADER.match(data, at)
        stop = head.end() + int(head[2]) + len(end) if head else 0
        if head and data[stop - len(end) : stop] == end:
            yield int(head[1]) if head[1] else None, at, stop
        else:
            following = data.find(mark, at + 1)
            stop = following if following > 0 else len(data)
            yield None, at, stop
        at = stop


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def file_nodes(data: bytes, fan: int = FAN) -> list[tuple[int, int, str, int, int, int | None, int | None]]:
    """(level, idx, hash, start, stop, record id, copy) of a file's tree, leaves first."""
    seen: Counter = Counter()
    nodes = []
    for i, (record_id, start, stop) in enumerate(parsed(data)):
        seen[record_id] += 1
        nodes.append((0, i, sha(data[start:stop]), start, stop, record_id, seen[record_id]))
    own, level = nodes, 0
    while len(own) > 1:
        level += 1
        groups = [own[i : i + fan] for i in range(0, len(own), fan)]
        own = [(level, i, sha("".join(f"{n[2]} {n[3]} {n[4]}\n" for n in g).encode()), g[0][3], g[-1][4], None, None) for i, g in enumerate(groups)]
        nodes = nodes + own
    return nodes


def trees(spark: SparkSession, path: str) -> DataFrame:
    """NODES of all files at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        for batch in batches:
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(file_id, *n) for n in file_nodes(gzip.decompress(content.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [c.split()[0] for c in NODES.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt.gz").load(path)
    file_id = F.regexp_extract("path", r"/file_id=(-?\d+)/", 1).cast("long")
    return written(files.select(file_id.alias("file_id"), "content").mapInArrow(run, NODES), "tree")


def level_of(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of a level; a root of a lower one stands for the levels above it."""
    tops = nodes.groupBy("file_id").agg(F.max("level").alias("top")).where(F.col("top") < level)
    roots = nodes.join(tops.hint("merge"), "file_id").where("level = top").drop("top")
    return nodes.where(F.col("level") == level).unionByName(roots)


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file_id, idx) of nodes that the replicas don't have alike."""
    x, y = (s.select("file_id", "idx", F.struct("hash", "start", "stop").alias(n)) for s, n in ((a, "x"), (b, "y")))
    return x.hint("merge").join(y, ["file_id", "idx"], "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("file_id", "idx")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Damaged records of two replicas' trees: file_id, record_id, copy, state (changed, missing, added), and offset and length on either side."""
    sides = (primary, replica)
    height = max((s.agg(F.max("level")).first()[0] or 0) for s in sides)
    open_nodes = written(differing(*(level_of(s, height) for s in sides)), "open-nodes")
    for level in range(height - 1, -1, -1):
        above = open_nodes.select("file_id", F.col("idx").alias("up"))
        own = [level_of(s, level).withColumn("up", F.floor(F.col("idx") / FAN)).join(above.hint("merge"), ["file_id", "up"], "left_semi") for s in sides]
        open_nodes = written(differing(*own), "open-nodes")
    x, y = (
        s.where("level = 0").join(open_nodes.hint("merge"), ["file_id", "idx"], "left_semi").select("file_id", "record_id", "copy", F.col("hash").alias(f"{n}_hash"), F.col("start").alias(f"{n}_offset"), (F.col("stop") - F.col("start")).alias(f"{n}_length"))
        for s, n in zip(sides, ("primary", "replica"), strict=True)
    )
    same = (F.col("x.file_id") == F.col("y.file_id")) & F.col("x.record_id").eqNullSafe(F.col("y.record_id")) & (F.col("x.copy") == F.col("y.copy"))
    matched = x.alias("x").hint("merge").join(y.alias("y"), same, "full")
    state = F.when(F.col("replica_hash").isNull(), "missing").when(F.col("primary_hash").isNull(), "added").otherwise("changed")
    return matched.where(~F.col("primary_hash").eqNullSafe(F.col("replica_hash"))).select(*[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in ("file_id", "record_id", "copy")], state.alias("state"), "primary_offset", "primary_length", "replica_offset", "replica_length")


def damaged(pages: DataFrame) -> DataFrame:
    """Pages of a replica with known damage: of every DAMAGE page ids one has a byte changed, one is missing, one is there twice."""
    turn = F.pmod("page_id", F.lit(DAMAGE))
    changed = F.when(turn == 0, F.concat(F.lit("?"), F.substring("html", F.lit(2), F.length("html")))).otherwise(F.col("html"))
    return pages.where(F.coalesce(turn != 1, F.lit(True))).withColumn("html", changed).unionByName(pages.where(turn == 2))


def op8_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC files twice (the second time with damage), read back and audited."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long"), "url", "html")
    sides = []
    for name, own in (("warc-primary", pages), ("warc-replica", damaged(pages))):
        path = new_table_path(spark, name)
        write_files(own, path)
        sides.append(trees(spark, path))
        removed(spark, path)  # the sample's files have been read
    return audit(*sides)


OP8_SQL = f"""
WITH base AS (
  SELECT page_id, page_id // {FILE_PAGES} AS file_id,
         strlen('WARC/1.1__WARC-Type: response__WARC-Record-ID: <urn:page:>__WARC-Target-URI: __Content-Length: ________')
           + strlen(CAST(page_id AS VARCHAR)) + strlen(coalesce(url, '')) + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + strlen(coalesce(html, '')) AS length,
         page_id % {DAMAGE} AS turn, html
  FROM pages
), a AS (
  SELECT *, sum(length) OVER (PARTITION BY file_id ORDER BY page_id) - length AS start FROM base
), copies AS (
  SELECT page_id, file_id, length, turn, html, 1 AS copy FROM base WHERE turn <> 1
  UNION ALL SELECT page_id, file_id, length, turn, html, 2 FROM base WHERE turn = 2
), sized AS (
  -- the changed byte may replace a first letter of more bytes
  SELECT page_id, file_id, copy, turn, html, CASE WHEN turn = 0 AND html IS NOT NULL THEN length + 1 - strlen(html[1]) - strlen(CAST(strlen(html) AS VARCHAR)) + strlen(CAST(strlen(html) + 1 - strlen(html[1]) AS VARCHAR)) ELSE length END AS length
  FROM copies
), b AS (
  SELECT *, sum(length) OVER (PARTITION BY file_id ORDER BY page_id, copy) - length AS start FROM sized
)
SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.page_id, b.page_id) AS record_id, CAST(coalesce(b.copy, 1) AS INTEGER) AS copy,
       CASE WHEN b.page_id IS NULL THEN 'missing' WHEN b.copy = 2 THEN 'added' ELSE 'changed' END AS state,
       CAST(CASE WHEN b.copy IS DISTINCT FROM 2 THEN a.start END AS BIGINT) AS primary_offset, CAST(CASE WHEN b.copy IS DISTINCT FROM 2 THEN a.length END AS BIGINT) AS primary_length,
       CAST(b.start AS BIGINT) AS replica_offset, CAST(b.length AS BIGINT) AS replica_length
FROM a LEFT JOIN b ON a.page_id = b.page_id
WHERE b.page_id IS NULL OR b.copy = 2 OR (b.turn = 0 AND a.html IS NOT NULL AND left(a.html, 1) <> '?')
"""
