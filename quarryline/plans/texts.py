"""Classification, cleaning and scoring of texts over the test tables, and the same in SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions import text as x
from quarryline.operators import chunking, html
from quarryline.sources.tables import spread

from .retrieval import table

#: The test texts are invented words; a bracketed sentence made of row values gives the rules something to find.
WORDS_BY_SOURCE = {0: "The OrderMaster must validate order_id, order_status and customer_no; required by policy.", 1: "Billing platform: Pending -> Confirmed, Confirmed to Shipped. error timeout retry", 2: "api endpoint payload of the CrmHub service; source target mapping of ProductItem", 3: "button form screen menu; token secret role", 4: "status state pending; event trigger", 5: ""}


def sentence_sql() -> str:
    return "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in WORDS_BY_SOURCE.items()) + " END"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with such a sentence in front, and a chunk type."""
    out = None
    for k, v in WORDS_BY_SOURCE.items():
        out = F.when(F.col("doc_id") % 6 == k, v) if out is None else out.when(F.col("doc_id") % 6 == k, v)
    kind = F.when(F.col("doc_id") % 50 == 7, "table").when(F.col("doc_id") % 50 == 8, "figure").when(F.col("doc_id") % 50 == 9, "code").otherwise("text")
    own = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return own.select("doc_id", "source", "lang", F.concat(out, F.lit("\n"), "text").alias("text"), kind.alias("chunk_type"))


MARKED = f"""marked AS (SELECT doc_id, source, lang, {sentence_sql()} || chr(10) || text AS text,
  CASE doc_id % 50 WHEN 7 THEN 'table' WHEN 8 THEN 'figure' WHEN 9 THEN 'code' ELSE 'text' END AS chunk_type FROM documents)"""


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"


def found_sql(group: str, text: str = "text") -> str:
    return f"list_filter({listed(x.MARKERS[group])}, lambda m: contains(lower({text}), m))"


def sql_matches(pattern: str, most: int) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(text, '{pattern}', 1)))[1:{most}]"


SYSTEMS_SQL = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '{}', 1), lambda n: trim(n)), lambda n: length(n) > 2)))[1:10]".format(x.SYSTEM)
TRANSITIONS_SQL = f"list_transform(list_zip(regexp_extract_all(text, '{x.TRANSITION}', 1), regexp_extract_all(text, '{x.TRANSITION}', 2)), lambda p: p[1] || ' -> ' || p[2])[1:10]"
TYPE_SQL = (
    "CASE WHEN chunk_type = 'figure' THEN 'diagram_or_visual' WHEN chunk_type = 'table' THEN 'data_mapping_candidate' "
    + " ".join(f"WHEN len({found_sql(g)}) >= {n} THEN '{t}'" for g, n, t in x.PRIORITY)
    + f" WHEN len({sql_matches(x.FIELD, 15)}) >= 3 THEN 'field_definition' WHEN len({sql_matches(x.ENTITY, 10)}) >= 3 THEN 'entity_definition'"
    + f" WHEN chunk_type = 'text' AND length(text) > 100 AND len({sql_matches(x.FIELD, 15)}) = 0 AND len({sql_matches(x.ENTITY, 10)}) <= 1 THEN 'system_overview' ELSE 'generic_context' END"
)


def classify_names(spark, sf_dir):
    t = F.col("text")
    return marked(spark, sf_dir).select("doc_id", x.entity_names(t).alias("entity_names"), x.field_names(t).alias("field_names"), x.system_names(t).alias("system_names"), x.state_transitions(t).alias("state_transitions"))


def classify_markers(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", *[x.found_markers(F.col("text"), g).alias(f"{g}_markers") for g in ("rule", "integration", "error", "business")])


def classify_flags(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in x.flags(F.col("text"), F.col("chunk_type")).items()])


def classify_semantic_type(spark, sf_dir):
    return x.with_semantic_type(marked(spark, sf_dir)).select("doc_id", "semantic_type", "confidence")


CONFIDENCE_SQL = f"round(least(0.5 + 0.1 * (CAST(len({found_sql('rule')}) >= 2 AS INTEGER) + CAST(len({sql_matches(x.FIELD, 15)}) >= 3 AS INTEGER) + CAST(len({sql_matches(x.ENTITY, 10)}) >= 2 AS INTEGER) + CAST(len({SYSTEMS_SQL}) >= 1 AS INTEGER) + CAST(semantic_type NOT IN ('generic_context', 'system_overview') AS INTEGER)), 0.95), 2)"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the first schema version, and of the second (every fourth)."""
    return marked(spark, sf_dir).withColumn("version", F.when(F.col("doc_id") % 4 == 0, "v2").otherwise("v1"))


def enriched_rows(spark, sf_dir):
    """Rows of the second version as they are; the others with type, confidence, flattened names, flags and modality, as the second version."""
    return x.enriched(versions(spark, sf_dir)).select("doc_id", "version", "semantic_type", "confidence", "entities_csv", "modality", "enriched")


def enrich_forced(spark, sf_dir):
    """The same by force: all rows anew."""
    return x.enriched(versions(spark, sf_dir), force=True).groupBy("source").agg(F.count_if("enriched").alias("processed"), F.count_if(F.col("modality") == "visual").alias("visual"))


def enrich_summary(spark, sf_dir):
    """Documents of a source are enriched unless they are of the second schema version; counts per source and type."""
    own = x.enriched(versions(spark, sf_dir))
    return own.groupBy("source").agg(F.count_if("enriched").alias("processed"), F.count_if(~F.col("enriched")).alias("skipped"), F.count_if(F.col("semantic_type") == "business_rule").alias("business_rules"))


def flatten_metadata(spark, sf_dir):
    t = F.col("text")
    return marked(spark, sf_dir).select("doc_id", F.concat_ws(",", x.entity_names(t)).alias("entities_csv"), F.concat_ws(",", x.found_markers(t, "business")).alias("terms_csv"), F.concat_ws(",", F.array("source", "lang")).alias("tags_csv"))


def split_csv(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", x.csv_parts(F.concat_ws(" ;, ", "p_brand", "p_type", F.lit(""), "p_name")).alias("parts"))


def slugs(spark, sf_dir):
    """ASCII part of the slug, over part names and priorities."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("ENT-"), x.slug(F.concat_ws(" - ", "p_name", "p_brand", "p_type"))).alias("entity_id"))


def slugs_of_accents(spark, sf_dir):
    """Entity ids of the longest words, accents folded."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("length(word) > 18").distinct()
    return words.select("word", x.entity_id(F.col("word")).alias("entity_id"))


def clean_tags(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", x.clean_tags(F.array(F.concat(F.lit("  "), "s_name", F.lit(" ")), F.lit("  "), F.repeat(F.col("s_name"), 4))).alias("tags"))


def html_plain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", x.plain_html(F.col("html")).alias("text"))


def url_checks(spark, sf_dir):
    """Every page's URL, and one made local or private by its id."""
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("http://10.0.0."), F.col("page_id") % 250, F.lit("/x"))).when(F.col("page_id") % 5 == 1, F.lit("ftp://files.example.com/a")).when(F.col("page_id") % 5 == 2, F.concat(F.lit("https://172."), F.col("page_id") % 40, F.lit(".1.1:8080/a?b"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url")).withColumn("blocked", x.private_url(F.col("url")))


def file_routes(spark, sf_dir):
    exts, mimes = ["pdf", "HTML", "md", "txt", "csv", "yaml", "bin"], ["application/pdf", "text/html", None, None]
    ext = F.element_at(F.array(*[F.lit(e) for e in exts]), (F.col("doc_id") % 7 + 1).cast("int"))
    mime = F.element_at(F.array(*[F.lit(m) for m in mimes]), (F.col("doc_id") % 4 + 1).cast("int"))
    own = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("file"), "doc_id", F.lit("."), ext).alias("name"), mime.alias("mime"))
    return own.withColumn("reader", x.file_route(F.col("name"), F.col("mime")))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = ["[LLM] ", "[KB-RAG] ", "[ERROR] ", "[GUARD] ", "[STEP 2/5] ", "", "[llm] ", "run completed: ", "cancelled "]
    tag = F.element_at(F.array(*[F.lit(t) for t in tags]), ((F.col("conv_id") * 7 + F.col("turn")) % len(tags) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(tag, "text").alias("message"))


def log_levels(spark, sf_dir):
    m = F.col("message")
    return log_lines(spark, sf_dir).select("conv_id", "turn", x.log_level(m).alias("level"), x.without_log_prefix(m).alias("clean"))


def design_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated documents: sections of a conversation's turns under headings, with diagrams, tables and placeholders that depend on the ids."""
    head = F.element_at(F.array(F.lit("# Integration Design\n"), F.lit("Sure!\n# Integration Design\n"), F.lit("# ERP integration  design notes\n"), F.lit("# Something else\n")), (F.col("conv_id") % 4 + 1).cast("int"))
    section = F.concat(F.lit("## Part "), "turn", F.lit("\n"), F.when((F.col("turn") + F.col("conv_id")) % 3 == 0, "n/a").otherwise(F.col("text")), F.when(F.col("turn") % 4 == 1, "\n```mermaid\nflowchart LR\nA-->B\nB-->C\n```").otherwise(""), F.when(F.col("turn") % 3 == 2, "\n| Source | Target |\n|---|---|\n| a | b |").otherwise(""), F.when(F.col("conv_id") % 5 == 0, "\n[TODO]").otherwise(""), F.lit("\n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "section"))), lambda s: s["section"])
    return table(spark, sf_dir, "conversations").withColumn("section", section).withColumn("head", head).groupBy("conv_id").agg(F.concat(F.first("head"), F.array_join(ordered, "")).alias("content"))


DESIGN = """design AS (SELECT conv_id, ['# Integration Design' || chr(10), 'Sure!' || chr(10) || '# Integration Design' || chr(10), '# ERP integration  design notes' || chr(10), '# Something else' || chr(10)][conv_id % 4 + 1] ||
  string_agg('## Part ' || turn || chr(10) || CASE WHEN (turn + conv_id) % 3 = 0 THEN 'n/a' ELSE text END
   || CASE WHEN turn % 4 = 1 THEN chr(10) || '```mermaid' || chr(10) || 'flowchart LR' || chr(10) || 'A-->B' || chr(10) || 'B-->C' || chr(10) || '```' ELSE '' END
   || CASE WHEN turn % 3 = 2 THEN chr(10) || '| Source | Target |' || chr(10) || '|---|---|' || chr(10) || '| a | b |' ELSE '' END || CASE WHEN conv_id % 5 = 0 THEN chr(10) || '[TODO]' ELSE '' END || chr(10), '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id)"""


def structural_guard(spark, sf_dir):
    c = F.col("content")
    return design_documents(spark, sf_dir).select("conv_id", x.guard_state(c).alias("state"), F.length(x.guarded(c)).cast("long").alias("kept_chars"))


def quality_scores(spark, sf_dir):
    s = x.quality_signals(F.col("content"))
    own = design_documents(spark, sf_dir).select("conv_id", *[c.alias(k) for k, c in s.items()])
    named = {k: F.col(k) for k in s}
    own = own.withColumns({"issues": x.quality_issues(named), "score": x.quality_score(named)})
    return own.withColumn("passed", (F.size("issues") == 0) & (F.col("score") >= x.LEAST_SCORE)).withColumn("na_ratio", F.round("na_ratio", 4))


SIGNALS_SQL = f"""{DESIGN}, s AS (SELECT conv_id, CAST(len(regexp_extract_all(content, '(?m)^## ')) AS INTEGER) AS section_count, len(regexp_extract_all(content, '(?i)\\bn/a\\b')) AS na,
  CAST(len(regexp_extract_all(content, '\\S+')) AS INTEGER) AS word_count, regexp_matches(content, '(?i)```mermaid') AS has_diagram, CAST(len(regexp_extract_all(content, '(?m)^\\|[\\s\\-|:]+\\|')) AS INTEGER) AS table_count,
  CAST(len(regexp_extract_all(content, '{x.PLACEHOLDER}')) AS INTEGER) AS placeholder_count FROM design),
 r AS (SELECT * EXCLUDE na, CASE WHEN section_count > 0 THEN na / section_count ELSE 1.0 END AS na_ratio FROM s),
 q AS (SELECT *, list_filter([CASE WHEN section_count < 10 THEN 'sections' END, CASE WHEN na_ratio > 0.3 THEN 'not_applicable' END, CASE WHEN word_count < 300 THEN 'short' END, CASE WHEN NOT has_diagram THEN 'no_diagram' END, CASE WHEN table_count < 1 THEN 'no_table' END, CASE WHEN placeholder_count > 0 THEN 'placeholders' END], lambda i: i IS NOT NULL) AS issues,
  round((least(1.0, section_count / 10) + greatest(0.0, 1 - na_ratio / 0.3) + least(1.0, word_count / 300) + CAST(has_diagram AS DOUBLE) + least(1.0, table_count / 1) + CASE WHEN placeholder_count = 0 THEN 1.0 ELSE greatest(0.0, 1 - placeholder_count * 0.25) END) / 6, 2) AS score FROM r)"""


def section_split(spark, sf_dir):
    own = design_documents(spark, sf_dir).select("conv_id", F.posexplode(x.sections(F.col("content"))).alias("idx", "s"))
    return own.select("conv_id", "idx", F.col("s.title").alias("title"), F.length("s.body").cast("long").alias("body_chars"))


def diagram_check(spark, sf_dir):
    """Diagram blocks: type, lines, arrows, stub nodes."""
    own = design_documents(spark, sf_dir).select("conv_id", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?is)```mermaid\s*\n(.*?)```"), F.lit(1))).alias("block", "body"))
    kind = F.lower(F.regexp_extract("body", r"(?i)^\s*(flowchart|graph|sequenceDiagram|classDiagram|stateDiagram|erDiagram|gantt|pie)\b", 1))
    lines = F.size(F.filter(F.split("body", "\n"), lambda n: F.trim(n) != ""))
    return own.select("conv_id", "block", kind.alias("kind"), lines.alias("lines"), F.col("body").rlike(r"-->|---|==>|-\.->|==").alias("has_arrow"), F.col("body").rlike(r"(?i)\b(Source|Target)\s+System|participant\s+(Src|Int|Tgt)\b").alias("is_stub"))


def mapping_table_check(spark, sf_dir):
    """Documents whose first mapping table has real data, fences taken out."""
    plain = F.regexp_replace("content", r"(?s)```.*?```", "")
    tables = F.regexp_extract_all(plain, F.lit(r"(?m)((?:\|[^\n]+\|\n)+\|[\s\-|:]+\|\n(?:\|[^\n]+\|\n?)+)"), F.lit(1))
    mapping = F.filter(tables, lambda t: F.substring_index(t, "\n", 1).rlike(r"(?i)\b(source|src|target|tgt|field|mapping|transformation|transform|rule)\b"))
    return design_documents(spark, sf_dir).select("conv_id", F.size(tables).alias("tables"), (F.size(mapping) > 0).alias("has_mapping"))


def chunk_fixed(spark, sf_dir):
    return chunking.fixed(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def chunk_recursive(spark, sf_dir):
    return chunking.recursive(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def html_clean(spark, sf_dir):
    return html.cleaned(table(spark, sf_dir, "pages").select("page_id", "html"))


def html_links(spark, sf_dir):
    return html.links(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def html_sanitized(spark, sf_dir):
    return html.sanitized(table(spark, sf_dir, "pages").select("page_id", "html"))


QUERIES = {f.__name__: f for f in (classify_names, classify_markers, classify_flags, classify_semantic_type, enriched_rows, enrich_forced, enrich_summary, flatten_metadata, split_csv, slugs, slugs_of_accents, clean_tags, html_plain, url_checks, file_routes, log_levels, structural_guard, quality_scores, section_split, diagram_check, mapping_table_check, chunk_fixed, chunk_recursive, html_clean, html_links, html_sanitized)}
#: What the pages' markup holds: one heading, paragraphs of which some are never closed, marks by name, and parts that are dropped. A paragraph's text goes on to its end or, without one, to that of the page.
PLAIN_SQL = "regexp_replace(regexp_replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"
DATA_SQL = "array_to_string(list_transform(regexp_split_to_array({}, '(?s)<!--.*?-->|<[^>]*>'), lambda d: regexp_replace(" + PLAIN_SQL.format("d") + ", '^\\s+|\\s+$', '', 'g')), '')"
ABSENT_SQL = "</?(?:html|head|meta|title|style|script|body|nav|article|footer|b|div)(?:\\s[^>]*)?>"
LOG_SQL = "log AS (SELECT conv_id, turn, ['[LLM] ', '[KB-RAG] ', '[ERROR] ', '[GUARD] ', '[STEP 2/5] ', '', '[llm] ', 'run completed: ', 'cancelled '][(conv_id * 7 + turn) % 9 + 1] || text AS message FROM conversations)"
LEVEL_SQL = "CASE WHEN contains(message, '[LLM]') THEN 'LLM' WHEN contains(message, '[RAG]') OR contains(message, '[KB-RAG]') THEN 'RAG' WHEN contains(message, '[ERROR]') THEN 'ERROR' WHEN contains(message, '[GUARD]') THEN 'WARN' WHEN contains(message, '⛔') OR contains(message, 'cancelled') THEN 'CANCEL' WHEN contains(message, 'completed') OR contains(message, 'Approved') OR contains(message, '✓') THEN 'SUCCESS' ELSE 'INFO' END"
SQL = {
    "classify_names": f"WITH {MARKED} SELECT doc_id, {sql_matches(x.ENTITY, 10)} AS entity_names, {sql_matches(x.FIELD, 15)} AS field_names, {SYSTEMS_SQL} AS system_names, {TRANSITIONS_SQL} AS state_transitions FROM marked",
    "classify_markers": f"WITH {MARKED} SELECT doc_id, " + ", ".join(f"{found_sql(g)} AS {g}_markers" for g in ("rule", "integration", "error", "business")) + " FROM marked",
    "classify_flags": f"WITH {MARKED} SELECT doc_id, chunk_type = 'table' AS contains_table, chunk_type = 'figure' AS contains_figure, chunk_type = 'code' OR contains(text, '```') OR contains(lower(text), '<code>') AS contains_code, len({found_sql('rule')}) > 0 AS contains_rules, len({found_sql('mapping')}) > 0 AS contains_mapping FROM marked",
    "classify_semantic_type": f"WITH {MARKED}, t AS (SELECT *, {TYPE_SQL} AS semantic_type FROM marked) SELECT doc_id, semantic_type, CAST({CONFIDENCE_SQL} AS DOUBLE) AS confidence FROM t",
    "enrich_summary": f"WITH {MARKED}, t AS (SELECT source, doc_id % 4 = 0 AS v2, {TYPE_SQL} AS kind FROM marked) SELECT source, count(*) FILTER (NOT v2) AS processed, count(*) FILTER (v2) AS skipped, count(*) FILTER (NOT v2 AND kind = 'business_rule') AS business_rules FROM t GROUP BY source",
    "enriched_rows": f"""WITH {MARKED}, t AS (SELECT *, doc_id % 4 <> 0 AS enriched, {TYPE_SQL} AS semantic_type FROM marked)
        SELECT doc_id, 'v2' AS version, CASE WHEN enriched THEN semantic_type END AS semantic_type, CASE WHEN enriched THEN CAST({CONFIDENCE_SQL} AS DOUBLE) END AS confidence, CASE WHEN enriched THEN array_to_string({sql_matches(x.ENTITY, 10)}, ',') END AS entities_csv,
          CASE WHEN enriched THEN CASE chunk_type WHEN 'figure' THEN 'visual' WHEN 'table' THEN 'table' ELSE 'text' END END AS modality, enriched FROM t""",
    "enrich_forced": f"WITH {MARKED} SELECT source, count(*) AS processed, count(*) FILTER (chunk_type = 'figure') AS visual FROM marked GROUP BY source",
    "flatten_metadata": f"WITH {MARKED} SELECT doc_id, array_to_string({sql_matches(x.ENTITY, 10)}, ',') AS entities_csv, array_to_string({found_sql('business')}, ',') AS terms_csv, source || ',' || lang AS tags_csv FROM marked",
    "split_csv": "SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(p_brand || ' ;, ' || p_type || ' ;, ' || '' || ' ;, ' || p_name, '[,;]'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM part",
    "slugs": "SELECT p_partkey, 'ENT-' || lower(regexp_replace(trim(regexp_replace(p_name || ' - ' || p_brand || ' - ' || p_type, '[^A-Za-z0-9_\\s-]', '', 'g')), '[\\s_-]+', '_', 'g')) AS entity_id FROM part",
    "clean_tags": "SELECT s_suppkey, list_filter(list_transform(['  ' || s_name || ' ', '  ', repeat(s_name, 4)], lambda t: left(trim(t), 50)), lambda t: t <> '') AS tags FROM supplier",
    "html_plain": "SELECT page_id, left(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1000) AS text FROM pages",
    "url_checks": "WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http://10.0.0.' || (page_id % 250) || '/x' WHEN 1 THEN 'ftp://files.example.com/a' WHEN 2 THEN 'https://172.' || (page_id % 40) || '.1.1:8080/a?b' ELSE url END AS url FROM pages), h AS (SELECT *, lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host FROM u) SELECT page_id, url, host = '' OR host = 'localhost' OR regexp_matches(host, '^(127\\.|10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') AS blocked FROM h",
    "file_routes": """WITH f AS (SELECT doc_id, 'file' || doc_id || '.' || ['pdf', 'HTML', 'md', 'txt', 'csv', 'yaml', 'bin'][doc_id % 7 + 1] AS name, ['application/pdf', 'text/html', NULL, NULL][doc_id % 4 + 1] AS mime FROM documents)
        SELECT *, CASE WHEN mime = 'application/pdf' THEN 'pdf' WHEN mime = 'text/html' THEN 'html' WHEN lower(name) LIKE '%.pdf' THEN 'pdf' WHEN lower(name) LIKE '%.html' THEN 'html' WHEN name LIKE '%.md' THEN 'markdown' WHEN name LIKE '%.txt' THEN 'text' WHEN name LIKE '%.csv' THEN 'csv' WHEN name LIKE '%.yaml' THEN 'yaml' ELSE 'unsupported' END AS reader FROM f""",
    "log_levels": f"WITH {LOG_SQL} SELECT conv_id, turn, {LEVEL_SQL} AS level, regexp_replace(message, '^\\[[A-Z][A-Z0-9-]*(?:\\s+[0-9]+/[0-9]+)?\\]\\s*', '') AS clean FROM log",
    "structural_guard": f"WITH {DESIGN} SELECT conv_id, ['exact', 'preamble', 'relaxed', 'rejected'][conv_id % 4 + 1] AS state, CASE conv_id % 4 WHEN 0 THEN length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) WHEN 1 THEN length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) - 6 WHEN 2 THEN length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) END AS kept_chars FROM design",
    "quality_scores": f"WITH {SIGNALS_SQL} SELECT conv_id, section_count, word_count, has_diagram, table_count, placeholder_count, issues, CAST(score AS DOUBLE) AS score, len(issues) = 0 AND score >= 0.6 AS passed, CAST(round(na_ratio, 4) AS DOUBLE) AS na_ratio FROM q",
    "section_split": f"WITH {DESIGN}, p AS (SELECT conv_id, unnest(string_split(chr(10) || content, chr(10) || '## ')) AS part, generate_subscripts(string_split(chr(10) || content, chr(10) || '## '), 1) - 1 AS idx FROM design) SELECT conv_id, CAST(idx AS INTEGER) AS idx, CASE WHEN idx > 0 THEN trim(split_part(part, chr(10), 1)) END AS title, CASE WHEN idx = 0 THEN length(part) - 1 WHEN contains(part, chr(10)) THEN length(part) - length(split_part(part, chr(10), 1)) - 1 ELSE 0 END AS body_chars FROM p",
    "diagram_check": f"WITH {DESIGN}, b AS (SELECT conv_id, regexp_extract_all(content, '(?is)```mermaid\\s*\\n(.*?)```', 1) AS bs FROM design), u AS (SELECT conv_id, unnest(bs) AS body, generate_subscripts(bs, 1) - 1 AS block FROM b) SELECT conv_id, CAST(block AS INTEGER) AS block, lower(regexp_extract(body, '(?i)^\\s*(flowchart|graph|sequenceDiagram|classDiagram|stateDiagram|erDiagram|gantt|pie)\\b', 1)) AS kind, CAST(len(list_filter(string_split(body, chr(10)), lambda n: trim(n) <> '')) AS INTEGER) AS lines, regexp_matches(body, '-->|---|==>|-\\.->|==') AS has_arrow, regexp_matches(body, '(?i)\\b(Source|Target)\\s+System|participant\\s+(Src|Int|Tgt)\\b') AS is_stub FROM u",
    "mapping_table_check": f"WITH {DESIGN}, t AS (SELECT conv_id, regexp_extract_all(regexp_replace(content, '(?s)```.*?```', '', 'g'), '((?:\\|[^\\n]+\\|\\n)+\\|[\\s\\-|:]+\\|\\n(?:\\|[^\\n]+\\|\\n?)+)', 1) AS ts FROM design) SELECT conv_id, CAST(len(ts) AS INTEGER) AS tables, len(list_filter(ts, lambda t: regexp_matches(split_part(t, chr(10), 1), '(?i)\\b(source|src|target|tgt|field|mapping|transformation|transform|rule)\\b'))) > 0 AS has_mapping FROM t",
    "html_links": "SELECT page_id, list_sort(list_distinct(list_transform(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda h: regexp_extract(url, '^https?://[^/]+') || h))) AS links FROM pages",
    "html_sanitized": f"""WITH u AS (SELECT page_id, CASE WHEN length(html) > {html.MOST_CHARS} THEN regexp_replace(left(html, {html.MOST_CHARS}), '<[^<>]*$', '') ELSE html END AS html FROM pages),
        s AS (SELECT page_id, replace(replace({PLAIN_SQL.format('html')}, '&', '&amp;'), '\"</p>\"', '\"&lt;/p&gt;\"') AS html FROM u),
        t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<!DOCTYPE[^>]*>|{ABSENT_SQL}', '', 'g'), '<(p|li|ul|h1)\\s[^>]*>', '<\\1>', 'g') AS html FROM s)
        SELECT page_id, html || repeat('</p>', CAST(len(regexp_extract_all(html, '<p>')) - len(regexp_extract_all(html, '</p>')) AS INTEGER)) AS html FROM t""",
    "html_clean": f"""WITH b AS (SELECT page_id, regexp_replace(html, '(?s)<script>.*?</script>|<style>.*?</style>|<nav>.*?</nav>|<footer>.*', '', 'g') AS html FROM pages),
        h AS (SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS head, string_split(html, '<p>') AS parts FROM b),
        p AS (SELECT page_id, head, list_transform(range(2, len(parts) + 1), lambda i: CASE WHEN contains(parts[i], '</p>') THEN split_part(parts[i], '</p>', 1) ELSE array_to_string(parts[i:], '<p>') END) AS parts FROM h)
        SELECT page_id, array_to_string(list_filter(list_prepend('## ' || {DATA_SQL.format('head')}, list_transform(parts, lambda q: {DATA_SQL.format('q')})), lambda t: t <> '' AND t <> '## '), chr(10)) AS text FROM p""",
}
