"""Requirements out of prose documents, as windows over their lines.

Standalone bold lines and FR codes count as headings. The deepest level of a file's headings opens requirements; sections of the next higher level
that have none become one themselves; headings above only say whether what follows is mandatory. Files without headings give a requirement per paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import stripped

#: Marks of codes and bold lines.
CODE = r"(?i)^FR[‐-―−\-.]\S"
BOLD = r"^\*\*(.+?)\*\*\s*$"


def is_mandatory(heading: Column) -> Column:
    low = F.lower(heading)
    return low.rlike(r"\bmandatory\b") & ~low.rlike(r"\bnon[-\s]?mandatory\b|\boptional\b")


def heading_lines(files: DataFrame) -> DataFrame:
    """file_name, pos, text, level and heading (null for plain lines); fence marks are gone, fenced lines are plain."""
    order = Window.partitionBy("file_name").orderBy("pos")
    own = files.select("file_name", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("text", stripped(F.col("line")))
    fence = F.col("text").startswith("```")
    own = own.withColumn("fences", F.sum(fence.cast("int")).over(order)).where(~fence)
    plain, bold = F.col("fences") % 2 == 0, F.trim(F.regexp_extract("text", BOLD, 1))
    marks = F.when(plain, F.length(F.regexp_extract("text", r"^(#{1,6})\s+.+$", 1))).otherwise(0)
    level = F.when(plain & (bold != ""), F.when(bold.rlike(CODE), 4).otherwise(3)).when(plain & F.col("text").rlike(CODE), 4).when(marks > 0, marks)
    heading = F.when(plain & (bold != ""), bold).when(plain & F.col("text").rlike(CODE), F.col("text")).when(marks > 0, F.trim(F.regexp_replace("text", r"^#{1,6}\s+", "")))
    return own.select("file_name", "pos", "text", level.alias("level"), heading.alias("heading"))


def joined(lines: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(lines), lambda s: s["text"]), " ")


def parse_prose(files: DataFrame) -> DataFrame:
    """file_name, pos, req_id, category, description, mandatory of files (file_name, text)."""
    lines = heading_lines(files)
    order = Window.partitionBy("file_name").orderBy("pos")
    whole = Window.partitionBy("file_name")
    lines = lines.withColumn("section", F.count("level").over(order))
    text = F.collect_list(F.when(F.col("level").isNull() & (F.col("text") != ""), F.struct("pos", "text")))
    parts = lines.groupBy("file_name", "section").agg(F.min("pos").alias("pos"), F.max("level").alias("level"), F.max("heading").alias("heading"), joined(text).alias("body"))
    deepest = F.max("level").over(whole)
    parts = parts.withColumn("deepest", deepest)
    parts = parts.withColumn("parent", F.max(F.when(F.col("level") < F.col("deepest"), F.col("level"))).over(whole))
    above = F.col("level") < F.col("deepest")
    parts = parts.withColumns({"group": F.sum(F.coalesce(above.cast("int"), F.lit(0))).over(order), "rule": F.last(F.when(above, is_mandatory(F.col("heading"))), ignorenulls=True).over(order)})
    parts = parts.withColumn("children", F.count(F.when(F.col("level") == F.col("deepest"), 1)).over(Window.partitionBy("file_name", "group")))
    wanted = (F.col("level") == F.col("deepest")) | ((F.col("level") == F.col("parent")) & (F.col("children") == 0))
    described = F.coalesce(F.nullif("body", F.lit("")), "heading")
    found = parts.where(wanted & (described != "")).select("file_name", "pos", F.col("heading").alias("category"), described.alias("description"), F.coalesce("rule", F.lit(False)).alias("mandatory"))
    # files without headings: paragraphs between blank lines
    bare = lines.withColumn("top", F.max("level").over(whole)).where("top IS NULL").withColumn("blank", (F.col("text") == "").cast("int"))
    bare = bare.withColumn("paragraph", F.sum("blank").over(order)).where("text <> ''")
    paragraphs = bare.groupBy("file_name", "paragraph").agg(F.min("pos").alias("pos"), joined(F.collect_list(F.struct("pos", "text"))).alias("description"))
    out = found.unionByName(paragraphs.select("file_name", "pos", F.lit("General").alias("category"), "description", F.lit(False).alias("mandatory")))
    return out.withColumn("req_id", F.concat(F.lit("R-"), F.upper(F.substring(F.sha1(F.concat_ws("|", "file_name", "pos", "description")), 1, 6))))
