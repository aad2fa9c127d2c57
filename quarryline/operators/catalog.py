"""Requirements, catalog entries, status checks and promotion as keyed aggregations and joins.

Tables: requirements (pos, req_id, source, target, category, description, mandatory), entries (id, source, target, requirements, status, project_id), projects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import stripped

#: Allowed changes of an entry's and of an approval's status.
ENTRY_STEPS = [("PENDING_TAG_REVIEW", "TAG_CONFIRMED"), ("TAG_CONFIRMED", "PROCESSING"), ("PROCESSING", "DONE")]
APPROVAL_STEPS = [("PENDING", "APPROVED"), ("PENDING", "REJECTED")]


def parse_requirements(rows: DataFrame) -> DataFrame:
    """Defaults of absent fields and the flag of a requirements file read with header (ReqID, Source, Target, Category, Description, Mandatory)."""
    text = lambda c, default: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))
    return rows.select("ReqID", text("Source", "Unknown").alias("source"), text("Target", "Unknown").alias("target"), text("Category", "Sync").alias("category"), text("Description", "").alias("description"), F.coalesce(F.lower(F.trim("Mandatory")).isin("true", "yes", "1"), F.lit(False)).alias("mandatory"))


def parse_bullets(files: DataFrame) -> DataFrame:
    """Requirements of Markdown files (file_name, text): front matter source and target, mandatory headings carried down, bullets `id | category | description`."""
    front = lambda k: F.nullif(F.trim(F.regexp_extract("text", rf"(?m)^{k}:\s*(.+)$", 1)), F.lit(""))
    names = F.split(F.regexp_replace("file_name", r"\.[a-z]+$", ""), "-to-")
    own = files.select("file_name", F.coalesce(front("source"), F.get(names, F.lit(0)), F.lit("Unknown")).alias("source"), F.coalesce(front("target"), F.get(names, F.lit(1)), F.lit("Unknown")).alias("target"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    heading = F.when(F.col("line").startswith("#"), F.lower("line"))
    own = own.withColumn("heading", F.last(heading, ignorenulls=True).over(Window.partitionBy("file_name").orderBy("line_no")))
    parts = F.transform(F.split(F.regexp_replace("line", r"^[-*]\s+", ""), r"\|"), lambda p: stripped(p))
    own = own.where(F.col("line").rlike(r"^[-*]\s+") & (F.size(F.split("line", r"\|")) >= 3)).withColumn("p", parts)
    low = F.coalesce("heading", F.lit(""))
    return own.select("file_name", "line_no", F.col("p")[0].alias("req_id"), "source", "target", F.col("p")[1].alias("category"), F.col("p")[2].alias("description"), (low.contains("mandatory") & ~low.rlike("non-mandatory|optional")).alias("mandatory"))


def overridden(requirements: DataFrame, overrides: DataFrame) -> DataFrame:
    """Non-blank source and target of overrides (req_id, new_source, new_target) win."""
    own = requirements.join(overrides, "req_id", "left")
    return own.withColumns({c: F.coalesce(F.nullif(F.trim(f"new_{c}"), F.lit("")), c) for c in ("source", "target")}).drop("new_source", "new_target")


def integration_id(source: Column | str, target: Column | str) -> Column:
    return F.concat(F.lit("INT-"), F.substring(F.sha1(F.concat_ws("|", source, target)), 1, 12))


def integrations(requirements: DataFrame) -> DataFrame:
    """One entry per (source, target), its requirement ids in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "req_id"))), lambda s: s["req_id"])
    return requirements.groupBy("source", "target").agg(ids.alias("requirements")).select(integration_id("source", "target").alias("id"), "source", "target", "requirements", F.lit("PENDING_TAG_REVIEW").alias("status"))


def pairs_preview(requirements: DataFrame) -> DataFrame:
    return requirements.groupBy("source", "target").agg(F.min("pos").alias("first_pos"))


def incomplete_pairs(requirements: DataFrame) -> DataFrame:
    missing = lambda c: F.coalesce(F.trim(F.lower(c)).isin("", "unknown"), F.lit(True))
    return requirements.where(missing("source") | missing("target")).groupBy("source", "target").agg(F.count(F.lit(1)).alias("affected"))


def requirements_of(entries: DataFrame, requirements: DataFrame) -> DataFrame:
    return entries.select("id", F.explode("requirements").alias("req_id")).join(requirements, "req_id")


def category_tags(of_entries: DataFrame, most: int = 5) -> DataFrame:
    """Distinct trimmed categories of an entry, by first position, at most five: id, tags."""
    first = of_entries.select("id", F.trim("category").alias("tag"), "pos").where("tag <> ''").groupBy("id", "tag").agg(F.min("pos").alias("pos"))
    capped = first.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("pos", "tag"))).where(F.col("n") <= most)
    return capped.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "tag"))), lambda s: s["tag"]).alias("tags"))


def merged_tags(own: Column, suggested: Column) -> dict[str, Column]:
    return {"tags": F.array_union(own, suggested), "added": F.array_except(suggested, own)}


def invalid_steps(log: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """Changes of status that are not allowed: log (entity, pos, status)."""
    before = F.lag("status").over(Window.partitionBy("entity").orderBy("pos"))
    own = log.withColumn("before", before).where("before IS NOT NULL")
    allowed = F.lit(False)
    for a, b in steps:
        allowed = allowed | ((F.col("before") == a) & (F.col("status") == b))
    return own.where(~allowed)


def transitions(log: DataFrame) -> DataFrame:
    """from_state, to_state, n of consecutive different states."""
    own = log.withColumn("to_state", F.lead("status").over(Window.partitionBy("entity").orderBy("pos"))).where("to_state <> status")
    return own.groupBy(F.col("status").alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))


def status_counts(entries: DataFrame) -> DataFrame:
    """Entries per status, and of all."""
    return entries.rollup("status").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("status", F.lit("all")).alias("status"), "n")


def promotable(documents: DataFrame, kb: DataFrame, entries: DataFrame) -> DataFrame:
    """Staged documents that the knowledge base lacks, with their entry's tags."""
    return documents.where("kb_status = 'staged'").join(kb.select("doc_id"), "doc_id", "left_anti").join(entries.select("id", F.concat_ws(",", "tags").alias("tags_csv")), documents.integration_id == F.col("id"), "left").drop("id")


def retagged(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (doc_id, chunk_id, tags_csv) of documents and of their chunks with a document's new tags (doc_id, new_tags), where it has some."""
    return rows.join(new, "doc_id", "left").select("doc_id", "chunk_id", F.coalesce("new_tags", "tags_csv").alias("tags_csv"))
