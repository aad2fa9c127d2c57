"""Memberships of entities and edges as long tables, bounded views of them, and a store that follows documents.

A membership is a row (entity_id, chunk_id, doc_id), however many an entity has: nothing collects the chunks of an entity or the evidence of an edge into one value. A view of an entity has counts, the first chunks
(a stated number), its semantic types (of the classifier's fixed list) and the name, type and tags that a merge keeps. All of it comes from partial aggregations and from row numbers whose limit is applied
in every task before the shuffle, so that an entity with a third of all rows is no hot task.
The store makes the views of entities with fewer rows from one shuffle, and those of the others in this way.
"""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.sources.changelog import ChangeLog
from quarryline.sources.tables import stored

from .graph import RELATED_WEIGHT, rel_id, sorted_set

FIRST_CHUNKS = 3
#: Entities that a batch changes by more rows, or that had more chunks before it, are not brought together in one task.
HOT_ROWS = 100_000


def members(found: DataFrame) -> DataFrame:
    """entity_id, chunk_id, doc_id, each once, of candidates."""
    return found.select("entity_id", "chunk_id", "doc_id").distinct()


def first_chunks(own: DataFrame, most: int) -> DataFrame:
    """entity_id, pos (from 0), chunk_id of each entity's smallest chunk ids."""
    chunks = own.select("entity_id", "chunk_id").distinct()
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("chunk_id"))
    return chunks.withColumn("place", place).where(F.col("place") <= most).select("entity_id", (F.col("place") - 1).alias("pos"), "chunk_id")


def counts(own: DataFrame, key: str | list[str] = "entity_id") -> DataFrame:
    """key, chunk_count, doc_count: different chunks and documents, each counted in two steps."""
    keys = [key] if isinstance(key, str) else key
    n = [own.select(*keys, c).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name)) for c, name in (("chunk_id", "chunk_count"), ("doc_id", "doc_count"))]
    return n[0].join(n[1], keys)


VIEW = ("entity_id", "first.name", "first.entity_type", "tags_csv", "semantic_types", "chunk_count", "doc_count", "first_chunks")


def kept(found: DataFrame, order: str) -> list[Column]:
    """first (name and type), tags_csv and semantic_types of an entity, as `entity_views` says."""
    by = [F.col(c) for c in order.split(",")]
    late = [F.col("batch")] if "batch" in found.columns else []
    first = F.min_by(F.struct("name", "entity_type"), F.struct(*by, "name", "entity_type"))
    tags = F.max_by("tags_csv", F.struct(*late, F.length("tags_csv"), -F.col(order.split(",")[-1]), "tags_csv"))
    return [first.alias("first"), tags.alias("tags_csv"), sorted_set("semantic_type").alias("semantic_types")]


def entity_views(found: DataFrame, order: str = "pos", most: int = FIRST_CHUNKS) -> DataFrame:
    """A row per entity of candidates (entity_id, name, entity_type, chunk_id, doc_id, semantic_type, tags_csv and columns to order by).

    order: comma-separated columns; name and type are those of the first candidate, tags the longest of the last batch (where `batch` is a column), of like length those of the first.
    """
    state = found.groupBy("entity_id").agg(*kept(found, order))
    shown = first_chunks(found, most).groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda s: s["chunk_id"]).alias("first_chunks"))
    return state.join(counts(found), "entity_id").join(shown, "entity_id").select(*VIEW)


def entity_views_at_once(found: DataFrame, order: str = "pos", most: int = FIRST_CHUNKS) -> DataFrame:
    """The same of entities none of which has very many rows: these are dealt by entity once, and chunks and documents are counted in their order, as they pass by. Nothing is collected but types."""
    of = Window.partitionBy("entity_id")
    own = found.withColumn("chunk", F.dense_rank().over(of.orderBy("chunk_id"))).withColumn("doc", F.dense_rank().over(of.orderBy("doc_id")))
    shown = F.array(*[F.max(F.when(F.col("chunk") == k, F.col("chunk_id"))) for k in range(1, most + 1)])
    state = own.groupBy("entity_id").agg(*kept(found, order), F.max("chunk").cast("long").alias("chunk_count"), F.max("doc").cast("long").alias("doc_count"), shown.alias("shown"))
    return state.withColumn("first_chunks", F.slice("shown", 1, F.least(F.lit(most), F.col("chunk_count").cast("int")))).select(*VIEW)


def edge_members(found: DataFrame) -> DataFrame:
    """from_id, to_id, rel_type, chunk_id, doc_id, each once; self-loops dropped."""
    return found.where("from_id <> to_id").select("from_id", "to_id", "rel_type", "chunk_id", "doc_id").distinct()


def edge_views(found: DataFrame) -> DataFrame:
    """rel_id, from_id, to_id, rel_type, weight, chunk_count (evidence), doc_count of relation candidates."""
    weight = F.when(F.col("rel_type") == "RELATED_TO", RELATED_WEIGHT).otherwise(1.0)
    return counts(edge_members(found), ["from_id", "to_id", "rel_type"]).select(rel_id("from_id", "to_id", "rel_type").alias("rel_id"), "from_id", "to_id", "rel_type", weight.alias("weight"), "chunk_count", "doc_count")


def entities_of_chunks(own: DataFrame, seeds: DataFrame) -> DataFrame:
    """query_id, entity_id of entities that a query's seed chunks (query_id, chunk_id) support."""
    return own.select("entity_id", "chunk_id").join(seeds, "chunk_id").select("query_id", "entity_id").distinct()


def supporting_chunks(own: DataFrame, chosen: DataFrame, per_entity: int = 2, per_query: int = 20) -> DataFrame:
    """query_id, entity_id, chunk_id: the first chunks of a query's entities (query_id, entity_id), capped per entity and per query as the ranking asks."""
    few = first_chunks(own.join(chosen.select("entity_id").distinct(), "entity_id", "left_semi"), per_entity)
    ranked = chosen.join(few, "entity_id").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("entity_id", "pos")))
    return ranked.where(F.col("place") <= per_query).select("query_id", "entity_id", "chunk_id")


def without_document(own: DataFrame, edges: DataFrame, doc_id: Column) -> tuple[DataFrame, DataFrame]:
    """Memberships of entities and of edges without a document: its rows go, and edges of which an end is left without a chunk."""
    left = own.where(F.col("doc_id") != doc_id)
    ends = [left.select(F.col("entity_id").alias(c)).distinct() for c in ("from_id", "to_id")]
    return left, edges.where(F.col("doc_id") != doc_id).join(ends[0], "from_id", "left_semi").join(ends[1], "to_id", "left_semi")


MEMBERS = "doc_id long, entity_id string, chunk_id long, name string, entity_type string, semantic_type string, tags_csv string, pos long, batch long"
VIEWS = "entity_id string, name string, entity_type string, tags_csv string, semantic_types array<string>, chunk_count long, doc_count long, first_chunks array<long>"


@dataclasses.dataclass(frozen=True)
class EntityStore:
    """Candidates by document and views by entity, as two change logs under a folder.

    A batch replaces the candidates of its documents. Only entities that a changed document names, or named before, get a new view, from their candidates; the others' views and files stay. The candidates keep the
    number of the batch that brought them: the first one gives an entity's name and type, the last one its tags.
    """

    spark: SparkSession
    root: str

    @functools.cached_property
    def candidates(self) -> ChangeLog:
        return ChangeLog(self.spark, f"{self.root}/candidates", "doc_id", MEMBERS)

    @functools.cached_property
    def views(self) -> ChangeLog:
        return ChangeLog(self.spark, f"{self.root}/views", "entity_id", VIEWS)

    def put(self, found: DataFrame, number: int, gone: DataFrame | None = None) -> None:
        """Batch `number`: candidates (as for `entity_views`) of changed documents, and documents (doc_id) that are gone. A batch that is tried again starts from the one before."""
        before, seen = self.candidates.before(number), self.views.before(number)
        self.candidates.merge(found.withColumn("batch", F.lit(number).cast("long")), number, gone)
        rows, changed = self.candidates.rows_of(number), self.candidates.keys(number).withColumnRenamed("key", "doc_id")
        named = rows.select("entity_id")
        if before is not None:
            named = named.unionByName(self.candidates.lookup(changed, before).select("entity_id"))
            rows = self.candidates.read()
        touched = stored(named.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")), "touched-entities")
        ids = touched.select("entity_id")
        hot = touched.where(F.col("n") > HOT_ROWS).select("entity_id")
        if seen is not None:
            hot = hot.unionByName(self.views.read(seen).where(F.col("chunk_count") > HOT_ROWS).select("entity_id").join(ids, "entity_id", "left_semi")).distinct()
        hot = stored(hot, "hot-entities")
        some = not hot.isEmpty()
        few = rows.join(F.broadcast(hot), "entity_id", "left_anti") if some else rows
        views = entity_views_at_once(few if before is None else few.join(ids, "entity_id", "left_semi"), "batch,pos")
        if some:  # never more than the rows of a batch or table divided by HOT_ROWS
            views = views.unionByName(entity_views(rows.join(F.broadcast(hot), "entity_id", "left_semi"), "batch,pos"))
        self.views.merge(stored(views, "new-views"), number, ids)
        for log in (self.candidates, self.views):
            if log.due():
                log.compact()
                log.vacuum()

    def members(self) -> DataFrame:
        return members(self.candidates.read())
