"""A stored inverted index for BM25+ with block maxima: exact top lists that read the postings of few blocks, maintained by source.

Layout under a folder:
  manifest/version=v       one row per zone: the generation that holds it, its number of chunks and of words
  generation=g/chunks      chunk_id, source, dl (words), block, by zone
  generation=g/postings    a row per (term, zone, block): entries (chunk_id, tf, dl) and front, by zone and bucket of the term
  generation=g/terms       document counts per term and zone, by zone and bucket

A source belongs to one zone (a hash of it), a chunk to one block of about BLOCK chunks of like length in its zone (a hash of its id), so a chunk's postings all lie in one block and a block's bound is the
sum of its terms' bounds. The front holds a block's pairs (tf, dl) that no other pair of the term beats in both; the largest part of BM25+ is that of one of them, whatever the average length, so bounds stay
exact while the corpus changes.

Replacing sources writes a new generation of their zones alone, from the stored postings of the zones' other sources, and then a new manifest; until that is complete readers see the one before. `removed_generations` lists what
no manifest needs.

Search: 1. Bounds of all blocks that share a term with a query, from the fronts alone (the scan leaves the entries out). 2. The first blocks by bound are scored whole; the k-th score found is a
threshold. 3. Of the other blocks only those whose bound reaches it are scored. What is skipped can't hold a better chunk, so the list is that of scoring all of them.

Defined cases: rows with a null chunk_id are no chunks; a null source is a source of its own, a null text has no words but counts as a chunk; rows that share a chunk_id and a source are chunks of their own whose
scores add up; ties go to the smaller chunk_id, as in `retrieval.ranked`; an empty table gives an index without zones, in which nothing is found.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.sources.tables import latest_version, shuffles_removed, stored, write_version

from .retrieval import B, DELTA, K1, ranked, words

#: A generation has at most ZONES x BUCKETS folders; large ones are split into several files (rebalance), small ones stay one.
ZONES = 16
BUCKETS = 8
BLOCK = 128
#: Words that a task counts at once, in whole blocks.
WORDS_AT_ONCE = 500_000
#: Blocks of a query that are scored before there is a threshold, as a multiple of k.
FIRST = 1
#: Rows of queries' terms that are sent to all tasks; more are joined by a shuffle of the postings.
SENT_ROWS = 200_000
CHUNKS = "chunk_id long, source string, dl int, block long, zone int"
POSTINGS = "term string, block long, entries array<struct<chunk_id:long,tf:int,dl:int>>, front array<struct<tf:int,dl:int>>, zone int, bucket int"
TERMS = "term string, df long, zone int, bucket int"
MANIFEST = "zone int, generation long, n long, words long"


def zone_of(source: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("zone"), source), F.lit(ZONES)).cast("int")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counted(chunks: DataFrame) -> DataFrame:
    """zone, chunk_id, source, dl and the words of every chunk."""
    own = chunks.where("chunk_id IS NOT NULL").select(F.col("chunk_id").cast("long"), F.col("source").cast("string"), F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("w"))
    return own.select(zone_of(F.col("source")).alias("zone"), "chunk_id", "source", F.size("w").alias("dl"), "w")


def with_blocks(chunks: DataFrame) -> DataFrame:
    """Adds each chunk's block: chunks of a zone whose lengths have the same power of two are dealt out by a hash of their ids.

    Counts per zone and length class are at most 32 x ZONES rows, so they may be broadcast.
    """
    own = chunks.withColumn("class", F.floor(F.log2(F.col("dl") + 1)).cast("int"))
    sizes = own.groupBy("zone", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    block = F.col("class").cast("long") * (1 << 40) + F.pmod(F.xxhash64("chunk_id"), F.col("blocks"))
    return own.join(F.broadcast(sizes), ["zone", "class"]).withColumn("block", block).drop("class", "blocks")


def front(entries: Column) -> Column:
    """Pairs (tf, dl) that no other entry beats: by falling tf, those shorter than all before."""
    pairs = F.array_sort(F.array_distinct(F.transform(entries, lambda e: F.struct((-e["tf"]).alias("tf"), e["dl"].alias("dl")))))
    kept = F.aggregate(pairs, F.slice(pairs, 1, 0), lambda acc, p: F.when((F.size(acc) > 0) & (p["dl"] >= F.element_at(acc, -1)["dl"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.transform(kept, lambda p: F.struct((-p["tf"]).alias("tf"), p["dl"].alias("dl")))


def exploded(chunks: DataFrame) -> DataFrame:
    """term, block, entries, front, zone of chunks (zone, block, chunk_id, source, dl, w).

    The chunks of a block come together and leave as postings: words are counted where they are, so that neither they nor their counts are shuffled. A task looks at whole blocks of about WORDS_AT_ONCE words at once. Rows of a block that share
    chunk_id, source and dl are counted as one.
    """
    spark = chunks.sparkSession
    entry, pair = pa.struct([("chunk_id", pa.int64()), ("tf", pa.int32()), ("dl", pa.int32())]), pa.struct([("tf", pa.int32()), ("dl", pa.int32())])
    names = ["term", "block", "entries", "front", "zone"]

    def starts(*keys: np.ndarray) -> np.ndarray:
        """Where one of the keys changes."""
        new = np.ones(len(keys[0]), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        return new

    def made(own: pa.Table) -> pa.RecordBatch:
        zone, block, chunk_id, dl = (own.column(c).to_numpy() for c in ("zone", "block", "chunk_id", "dl"))
        which = np.cumsum(starts(zone, block)) - 1
        first: dict[tuple, int] = {}
        keys = zip(which.tolist(), chunk_id.tolist(), dl.tolist(), own.column("source").to_pylist(), strict=True)
        row = np.fromiter((first.setdefault(key, k) for k, key in enumerate(keys)), np.int64, own.num_rows)
        lists = own.column("w").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        terms = coded.dictionary
        cell, tf = np.unique(np.repeat(row, lists.value_lengths().to_numpy(zero_copy_only=False)) * max(1, len(terms)) + coded.indices.to_numpy(), return_counts=True)
        row, term = np.divmod(cell, max(1, len(terms)))
        order = np.lexsort((dl[row], tf, chunk_id[row], term, which[row]))
        row, term, tf = row[order], term[order], tf[order]
        begin = np.flatnonzero(starts(which[row], term)) if len(row) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(begin)), np.diff([*begin, len(row)]))
        entries = pa.StructArray.from_arrays([pa.array(chunk_id[row]), pa.array(tf.astype(np.int32)), pa.array(dl[row].astype(np.int32))], fields=list(entry))
        # the front: by falling tf, those shorter than all before; a later group's lengths are made smaller than any before
        by = np.lexsort((dl[row], -tf, group))
        far = dl[row][by].astype(np.int64) - group[by] * (1 << 32)
        kept = by[far < np.minimum.accumulate(np.concatenate([[np.iinfo(np.int64).max], far[:-1]]))] if len(by) else by
        front = pa.StructArray.from_arrays([pa.array(tf[kept].astype(np.int32)), pa.array(dl[row][kept].astype(np.int32))], fields=list(pair))
        ends = np.concatenate([[0], np.cumsum(np.bincount(group[kept], minlength=len(begin)))]).astype(np.int32)
        at = row[begin]
        columns = [terms.take(pa.array(term[begin])), pa.array(block[at]), pa.ListArray.from_arrays(pa.array([*begin, len(row)], pa.int32()), entries), pa.ListArray.from_arrays(pa.array(ends), front), pa.array(zone[at].astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names)

    def parts(own: pa.Table) -> Iterator[pa.RecordBatch]:
        """Postings of whole blocks, of about WORDS_AT_ONCE words together."""
        begin = np.flatnonzero(starts(own.column("zone").to_numpy(), own.column("block").to_numpy()))
        before = np.concatenate([[0], np.cumsum(own.column("w").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))])
        cuts = begin[starts(before[begin] // WORDS_AT_ONCE)].tolist()
        for a, b in zip(cuts, [*cuts[1:], own.num_rows], strict=True):
            yield made(own.slice(a, b - a))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = (batch.column("zone")[-1].as_py(), batch.column("block")[-1].as_py())
            same = (batch.column("zone").to_numpy() == last[0]) & (batch.column("block").to_numpy() == last[1])
            cut = batch.num_rows - int(same.sum())  # rows are sorted: those of the last block are at the end
            whole = cut > 0 or (held and (held[-1].column("zone")[-1].as_py(), held[-1].column("block")[-1].as_py()) != last)
            if whole:
                yield from parts(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from parts(pa.Table.from_batches(held))

    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = chunks.select("zone", "block", F.col("chunk_id").cast("long"), "source", F.col("dl").cast("int"), "w").repartition(tasks, "zone", "block").sortWithinPartitions("zone", "block")
    return own.mapInArrow(local, ", ".join(c for c in POSTINGS.split(", ") if not c.startswith("bucket")))


def write_generation(rows: DataFrame, chunks: DataFrame, root: str, generation: int) -> DataFrame:
    """rows: term, block, entries, front, zone; chunks: zone, chunk_id, source, dl, block. Returns the zones' rows of a manifest."""
    spark, path = rows.sparkSession, f"{root}/generation={generation:09d}"
    with shuffles_removed(spark):
        chunks.select(*[c.split()[0] for c in CHUNKS.split(", ")]).hint("rebalance", "zone").write.mode("overwrite").partitionBy("zone").parquet(f"{path}/chunks", compression="zstd")
        rows = rows.select("term", "block", "entries", "front", "zone", bucket_of(F.col("term")).alias("bucket"))
        rows.hint("rebalance", "zone", "bucket").sortWithinPartitions("zone", "bucket", "term", "block").write.mode("overwrite").partitionBy("zone", "bucket").parquet(f"{path}/postings", compression="zstd")
        own = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
        df = own.groupBy("term", "zone", "bucket").agg(F.sum(F.size("entries")).alias("df"))
        df.select("term", "df", "zone", "bucket").hint("rebalance", "zone", "bucket").write.mode("overwrite").partitionBy("zone", "bucket").parquet(f"{path}/terms", compression="zstd")
    return spark.read.schema(CHUNKS).parquet(f"{path}/chunks").groupBy("zone").agg(F.lit(generation).cast("long").alias("generation"), F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words"))


def write_index(chunks: DataFrame, root: str) -> None:
    """A new index of chunks (chunk_id, source, text) under root, or a new version of all of it."""
    own = with_blocks(counted(chunks))
    last = latest_version(chunks.sparkSession, f"{root}/manifest")
    generation = 0 if last is None else last + 1
    write_version(write_generation(exploded(own), own, root, generation), f"{root}/manifest", generation)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    last = latest_version(spark, f"{root}/manifest")
    if last is None:
        raise ValueError(f"there is no index in {root}")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/version={last:09d}")


def current(spark: SparkSession, root: str, name: str, schema: str, zones: list[int] | None = None) -> DataFrame:
    """The live rows of a table of the index: of each generation the zones that it holds (never more than ZONES rows of the manifest)."""
    held: dict[int, list[int]] = {}
    for r in manifest(spark, root).collect():
        if zones is None or r.zone in zones:
            held.setdefault(r.generation, []).append(r.zone)
    found = [spark.read.schema(schema).parquet(f"{root}/generation={g:09d}/{name}").where(F.col("zone").isin(z)) for g, z in sorted(held.items())]
    return functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def replace_sources(chunks: DataFrame, root: str, gone: DataFrame | None = None) -> None:
    """The rows of all sources of chunks (and of gone: source) leave the index, and chunks come in; other zones' files are not read."""
    spark = chunks.sparkSession
    old = chunks.select(F.col("source").cast("string"))
    old = (old.unionByName(gone.select(F.col("source").cast("string"))) if gone is not None else old).distinct()
    zones = [r.zone for r in old.select(zone_of(F.col("source")).alias("zone")).distinct().collect()]
    number = latest_version(spark, f"{root}/manifest") + 1
    kept = current(spark, root, "chunks", CHUNKS, zones).join(old.withColumnRenamed("source", "old"), F.col("source").eqNullSafe(F.col("old")), "left_anti")
    kept = stored(kept, "kept-chunks")
    # a block's chunks that stay are few: its postings meet them in one row, and keep their front if no entry goes
    ids = kept.groupBy("zone", "block").agg(F.collect_set(F.struct("chunk_id", "dl")).alias("ids"))
    left = F.filter("entries", lambda e: F.array_contains("ids", F.struct(e["chunk_id"].alias("chunk_id"), e["dl"].alias("dl"))))
    old_rows = current(spark, root, "postings", POSTINGS, zones).join(ids, ["zone", "block"]).withColumn("left", left).where(F.size("left") > 0)
    old_rows = old_rows.select("term", "block", F.col("left").alias("entries"), F.when(F.size("left") == F.size("entries"), F.col("front")).otherwise(front(F.col("left"))).alias("front"), "zone")
    new = counted(chunks)
    # chunks that stay keep their block; new ones get blocks of their own, as many as they need
    generation_bit = F.lit(number).cast("long") * (1 << 48)
    new = with_blocks(new).withColumn("block", F.col("block") + generation_bit)
    made = write_generation(old_rows.unionByName(exploded(new)), kept.unionByName(new.select(*kept.columns)), root, number)
    rest = manifest(spark, root).where(~F.col("zone").isin(zones))
    write_version(rest.unionByName(made), f"{root}/manifest", number)


def removed_generations(spark: SparkSession, root: str) -> list[int]:
    """Generations that the last manifest doesn't name: their folders may go once no older reader is left."""
    kept = {r.generation for r in manifest(spark, root).select("generation").distinct().collect()}
    return [g for g in range(latest_version(spark, f"{root}/manifest") + 1) if g not in kept]


def part(tf: Column, dl: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


class Search:
    """Top k of each query (query_id, text) by BM25+, over the index under root."""

    def __init__(self, spark: SparkSession, root: str, queries: DataFrame, k: int):
        self.k = k
        totals = manifest(spark, root).agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
        self.n, self.average = totals.n or 0, (totals.words or 0) / totals.n if totals.n and totals.words else 1.0
        wanted = queries.select("query_id", F.explode(words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        terms = wanted.select("term", bucket_of(F.col("term")).alias("bucket")).distinct()
        buckets = [r.bucket for r in terms.select("bucket").distinct().collect()]  # at most BUCKETS
        df = current(spark, root, "terms", TERMS).where(F.col("bucket").isin(buckets)).join(terms, ["term", "bucket"]).groupBy("term").agg(F.sum("df").alias("df"))
        weights = wanted.join(df, "term").select("query_id", "term", (F.col("qtf") * F.log((self.n + 1) / F.col("df"))).alias("w"))
        self.weights = stored(weights, "query-weights")
        self.asked = self.weights.count()
        self.floors = self.weights.groupBy("query_id").agg(F.sum(F.col("w") * DELTA).alias("floor"))
        # only postings of the queries' terms are shuffled
        self.postings = current(spark, root, "postings", POSTINGS).where(F.col("bucket").isin(buckets)).join(self.sent(self.weights.select("term").distinct(), self.asked), "term", "left_semi")
        most = F.array_max(F.transform("front", lambda p: part(p["tf"], p["dl"], self.average)))
        bounds = self.postings.select("term", "zone", "block", most.alias("most")).join(self.sent(self.weights, self.asked), "term").groupBy("query_id", "zone", "block").agg(F.sum(F.col("w") * F.col("most")).alias("score"))
        self.bounds = stored(bounds.join(self.floors, "query_id").select("query_id", "zone", "block", (F.col("score") + F.col("floor")).alias("score")), "block-bounds")
        key = F.struct("zone", "block").alias("chunk_id")
        self.first = stored(ranked(self.bounds.select("query_id", key, "score"), FIRST * k).select("query_id", "chunk_id.zone", "chunk_id.block"), "first-blocks")
        self.found = stored(self.scored(self.first, FIRST * k * self.asked), "first-scores")
        least = ranked(self.found, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least")).where(F.col("found") == k)
        rest = self.bounds.join(self.first, ["query_id", "zone", "block"], "left_anti").join(least, "query_id", "left")
        # scores are rounded to six places before they are ranked
        self.rest = stored(rest.where(F.col("least").isNull() | (F.col("score") >= F.col("least") - 2e-6)).select("query_id", "zone", "block"), "other-blocks")

    @staticmethod
    def sent(table: DataFrame, rows: int) -> DataFrame:
        """A table of a few rows (`rows` at most), for a join without a shuffle of the postings; a larger one as it is."""
        return F.broadcast(table) if rows <= SENT_ROWS else table

    def scored(self, blocks: DataFrame, rows: int | None = None) -> DataFrame:
        """query_id, chunk_id, score of all chunks of blocks (query_id, zone, block), which have `rows` terms of their queries at most."""
        asked = blocks.join(self.weights, "query_id")
        asked = asked if rows is None else self.sent(asked, rows)
        each = self.postings.select("term", "zone", "block", "entries").join(asked, ["term", "zone", "block"]).select("query_id", "w", F.explode("entries").alias("e"))
        sums = each.groupBy("query_id", "e.chunk_id").agg(F.sum(F.col("w") * part(F.col("e.tf"), F.col("e.dl"), self.average)).alias("sum"))
        return sums.join(self.floors, "query_id").select("query_id", "chunk_id", F.round(F.col("sum") + F.col("floor"), 6).alias("score"))

    def top(self) -> DataFrame:
        """query_id, chunk_id, score, rank."""
        return ranked(self.found.unionByName(self.scored(self.rest)), self.k)

    def report(self) -> DataFrame:
        """query_id, blocks that share a term with it, blocks whose entries were read, and the share that was skipped."""
        read = self.first.unionByName(self.rest).groupBy("query_id").agg(F.count(F.lit(1)).alias("read"))
        own = self.bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks")).join(read, "query_id", "left")
        return own.select("query_id", "blocks", F.coalesce("read", F.lit(0)).alias("read"), F.round(1 - F.coalesce("read", F.lit(0)) / F.col("blocks"), 6).alias("skipped"))
