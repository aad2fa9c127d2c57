"""Further document queries over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as x
from quarryline.operators import ingest, prose
from quarryline.operators import retrieval as r

from . import retrieval, texts
from .retrieval import table

#: Sections (by their title) and what they must hold.
ARTIFACTS = [("part 1", r"(?is)```mermaid.*?(flowchart|graph)\b"), ("part 3", r"(?m)^\|[\s\-|:]+\|")]


def context_sections(spark, sf_dir):
    own = retrieval.fused(spark, sf_dir).withColumns({"section": F.element_at(F.array(F.lit("summary"), F.lit("approved"), F.lit("kb")), (F.col("chunk_id") % 3 + 1).cast("int")), "size": F.length("text").cast("long")})
    return r.assembled(own, 9000, 2500).select("query_id", "section", "chunk_id", "score", "used")


def section_artifacts(spark, sf_dir):
    """Sections that lack their artifact; the first section with the title counts."""
    own = texts.design_documents(spark, sf_dir).select("conv_id", F.posexplode(x.sections(F.col("content"))).alias("idx", "s")).where("s.title IS NOT NULL")
    parts = []
    for title, pattern in ARTIFACTS:
        first = own.where(F.lower("s.title").contains(title)).groupBy("conv_id").agg(F.min_by("s.body", "idx").alias("body"))
        parts.append(first.where(~F.col("body").rlike(pattern)).select("conv_id", F.lit(title).alias("section")))
    return parts[0].unionByName(parts[1])


def section_groups(spark, sf_dir):
    """Conversations as documents, a turn's speaker as header."""
    own = table(spark, sf_dir, "conversations").where("text <> ''").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("header"), F.col("turn").alias("pos"), "text")
    return ingest.section_groups(own).select("doc_id", "header", "chunks", F.md5("text").alias("text_md5"))


def resource_capabilities(spark, sf_dir):
    """Every page as a resource."""
    own = table(spark, sf_dir, "pages").select(F.lit("web").alias("source"), F.concat(F.lit("p"), "page_id").alias("name"), F.col("url").alias("uri"), F.when(F.col("page_id") % 2 == 0, "a page").otherwise("").alias("description"), F.lit("text/html").alias("mime"))
    return ingest.resource_capabilities(own)


def prompt_capabilities(spark, sf_dir):
    """Every supplier as a prompt with one or two arguments."""
    args = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.struct(F.lit("key").alias("name"), F.lit(True).alias("required")), F.struct(F.lit("note").alias("name"), F.lit(False).alias("required")))).otherwise(F.array(F.struct(F.lit("key").alias("name"), F.lit(True).alias("required"))))
    return ingest.prompt_capabilities(table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("source"), F.col("s_name").alias("name"), F.lit("").alias("description"), args.alias("arguments")))


def tool_capabilities(spark, sf_dir):
    schema = F.concat(F.lit('{"properties": {"'), F.lower(F.regexp_replace("p_type", " ", "_")), F.lit('": {}, "size": {}}, "required": ["size"]}'))
    own = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("source"), F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("description"), schema.alias("schema"))
    return ingest.tool_capabilities(own)


def openapi_schemas(spark, sf_dir):
    """Schemas of specifications that are made of a supplier's parts: of version 3 for even suppliers, of version 2 for odd ones."""
    body = F.concat(F.lit('"T'), "p", F.lit('": {"type": "object", "properties": {"key": {}, "n'), "p", F.lit('": {}}}'))
    where = F.when(F.col("l_suppkey") % 2 == 0, F.lit('{"components": {"schemas": {')).otherwise('{"definitions": {')
    end = F.when(F.col("l_suppkey") % 2 == 0, "}}}").otherwise("}}")
    own = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p")).distinct().groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list(body)), ", ").alias("all"))
    return ingest.openapi_schemas(own.select(F.concat(F.lit("spec"), "l_suppkey").alias("source"), F.concat(where, "all", end).alias("spec")))


def url_entries_for_tags(spark, sf_dir):
    """Pages whose path has one of the wanted languages."""
    return table(spark, sf_dir, "pages").where(F.arrays_overlap(F.split("url", "[/?#]"), F.array(F.lit("fr"), F.lit("de")))).select("page_id", "url")


def document_browser(spark, sf_dir):
    """Chunks of a kind (language) with a word in their preview, whatever its case."""
    return table(spark, sf_dir, "documents").where((F.col("lang") == "en") & F.lower(F.substring("text", 1, 300)).contains("tion")).select("doc_id", "source")


def newest_reports(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "value")


def prose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per conversation: its turns under headings, bold lines, codes and fences, or without any."""
    head = F.when(F.col("conv_id") % 5 == 0, "").when(F.col("turn") % 5 == 0, F.when(F.col("conv_id") % 2 == 0, "## Mandatory part\n").otherwise("## Optional part\n")).when(F.col("turn") % 5 == 1, F.concat(F.lit("### Item "), "turn", F.lit("\n"))).when(F.col("turn") % 5 == 2, F.concat(F.lit("**FR-"), "turn", F.lit(".1 – code**\n"))).when(F.col("turn") % 5 == 3, F.lit("```\n# fenced\n```\n")).otherwise("**Bold section**\n")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(head, "text").alias("part")))), lambda s: s["part"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(ordered, "\n\n").alias("text")).select(F.concat(F.lit("c"), "conv_id").alias("file_name"), "text")


def requirement_prose(spark, sf_dir):
    return prose.parse_prose(prose_files(spark, sf_dir))


QUERIES = {f.__name__: f for f in (context_sections, section_artifacts, section_groups, tool_capabilities, resource_capabilities, prompt_capabilities, openapi_schemas, url_entries_for_tags, document_browser, newest_reports, requirement_prose)}
SQL = {
    "context_sections": f"""WITH {retrieval.FUSED}, e AS (SELECT query_id, ['summary', 'approved', 'kb'][chunk_id % 3 + 1] AS section, chunk_id, score, length(text) AS size FROM fused),
        u AS (SELECT *, CAST(sum(size) OVER (PARTITION BY query_id, section ORDER BY score DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM e),
        s AS (SELECT query_id, coalesce(max(used) FILTER (section = 'summary' AND used <= 2500), 0) AS s FROM u GROUP BY ALL),
        a AS (SELECT query_id, any_value(s) AS s, coalesce(max(used) FILTER (section = 'approved' AND s + used <= 9000), 0) AS a FROM u JOIN s USING (query_id) GROUP BY ALL)
        SELECT query_id, section, chunk_id, score, used FROM u JOIN a USING (query_id) WHERE CASE section WHEN 'summary' THEN used <= 2500 WHEN 'approved' THEN s + used <= 9000 ELSE s + a + used <= 9000 END""",
    "section_groups": "WITH g AS (SELECT conv_id AS doc_id, role AS header, count(*) AS chunks, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5 FROM conversations WHERE text <> '' GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY header) AS n FROM g) SELECT doc_id, header, chunks, text_md5 FROM n WHERE n <= 15 AND chunks >= 3",
    "resource_capabilities": "SELECT 'web__resource__p' || page_id AS capability_id, 'Resource: p' || page_id || coalesce(chr(10) || 'URI: ' || nullif(url, ''), '') || chr(10) || 'Type: text/html' || CASE WHEN page_id % 2 = 0 THEN chr(10) || 'Description: a page' ELSE '' END AS text FROM pages",
    "prompt_capabilities": "SELECT 'n' || s_nationkey || '__prompt__' || s_name AS capability_id, 'Prompt: ' || s_name || chr(10) || 'Arguments: key (required)' || CASE WHEN s_suppkey % 2 = 0 THEN ', note (optional)' ELSE '' END AS text FROM supplier",
    "tool_capabilities": "SELECT lower(p_brand) || '__tool__' || p_name || '_' || p_partkey AS capability_id, 'Tool: ' || p_name || '_' || p_partkey || CASE WHEN p_size % 2 = 0 THEN chr(10) || p_type ELSE '' END || chr(10) || 'Parameters: ' || lower(replace(p_type, ' ', '_')) || ' (optional), size (required)' AS text FROM part",
    "openapi_schemas": "SELECT DISTINCT 'spec' || l_suppkey AS source, 'T' || l_partkey AS name, 2 AS properties FROM lineitem",
    "url_entries_for_tags": "SELECT page_id, url FROM pages WHERE list_has_any(regexp_split_to_array(url, '[/?#]'), ['fr', 'de'])",
    "document_browser": "SELECT doc_id, source FROM documents WHERE lang = 'en' AND contains(lower(left(text, 300)), 'tion')",
    "newest_reports": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "section_artifacts": f"""WITH {texts.DESIGN}, p AS (SELECT conv_id, unnest(string_split(chr(10) || content, chr(10) || '## ')) AS part, generate_subscripts(string_split(chr(10) || content, chr(10) || '## '), 1) - 1 AS idx FROM design),
        s AS (SELECT conv_id, idx, lower(split_part(part, chr(10), 1)) AS title, part FROM p WHERE idx > 0), a AS (SELECT conv_id, arg_min(part, idx) AS body FROM s WHERE contains(title, 'part 1') GROUP BY 1), b AS (SELECT conv_id, arg_min(part, idx) AS body FROM s WHERE contains(title, 'part 3') GROUP BY 1)
        SELECT conv_id, 'part 1' AS section FROM a WHERE NOT regexp_matches(body, '(?is)```mermaid.*?(flowchart|graph)\\b') UNION ALL SELECT conv_id, 'part 3' FROM b WHERE NOT regexp_matches(body, '(?m)^\\|[\\s\\-|:]+\\|')""",
}
