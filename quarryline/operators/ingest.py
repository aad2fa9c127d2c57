"""Snapshots, differences, capabilities and evidence of ingested sources as aggregations, windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered

#: Weights of a claim by its confidence, and that of a section without claims.
WEIGHTS = {"confirmed": 1.0, "inferred": 0.7, "to_validate": 0.5, "missing_evidence": 0.2}
UNSUPPORTED = 0.5
LOW_CONFIDENCE = 0.7


def daily_snapshots(rows: DataFrame) -> DataFrame:
    """A source's items of a day, sorted, and their hash: rows (source_id, ts, item)."""
    own = rows.groupBy("source_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return own.withColumn("content_hash", F.sha2(F.array_join("items", "|"), 256))


def flagged_snapshots(snapshots: DataFrame) -> DataFrame:
    """is_current for a source's latest snapshot, changed where the hash differs from the one before."""
    w = Window.partitionBy("source_id").orderBy("day")
    own = snapshots.withColumns({"before": F.lag("content_hash").over(w), "previous_items": F.lag("items").over(w), "back": F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("day")))})
    return own.withColumns({"is_current": F.col("back") == 1, "changed": F.col("before").isNull() | (F.col("before") != F.col("content_hash"))})


def last_runs(runs: DataFrame, n: int) -> DataFrame:
    own = runs.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("ts"), F.desc("run_id"))))
    return own.where(F.col("rank") <= n).select("source_id", "run_id", "rank")


def operation_diff(snapshots: DataFrame) -> DataFrame:
    """Items added and removed by the current snapshot; removed ones break, added ones are minor."""
    own = snapshots.where("is_current AND previous_items IS NOT NULL").select("source_id", F.array_sort(F.array_except("items", "previous_items")).alias("added"), F.array_sort(F.array_except("previous_items", "items")).alias("removed"))
    part = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(f"{c}: "), F.array_join(c, ", ")))
    severity = F.when(F.size("removed") > 0, "breaking").when(F.size("added") > 0, "minor").otherwise("none")
    return own.select("source_id", "added", "removed", severity.alias("severity"), F.concat_ws("; ", part("added"), part("removed")).alias("summary"))


def reconciled(capabilities: DataFrame) -> DataFrame:
    """Capabilities (id, source, kind, name, description, confidence) with one normalised name are one: descriptions united, highest confidence, the most detailed one's id."""
    own = capabilities.withColumn("name", F.lower(F.trim("name")))
    return own.groupBy("source", "kind", "name").agg(F.count(F.lit(1)).alias("merged"), F.round(F.max("confidence"), 6).alias("confidence"), F.max_by("id", F.struct(F.length("description"), -F.col("id"))).alias("best_id"), F.array_join(F.array_sort(F.collect_set("description")), " / ").alias("description"))


def normalised_capabilities(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Without blank names; unknown kinds are guide steps, missing confidence is 1."""
    return rows.where(F.trim("name") != "").select(F.concat(F.lit("src_"), "source", F.lit("-"), "id").alias("capability_id"), "name", F.when(F.col("kind").isin(kinds), F.col("kind")).otherwise("guide_step").alias("kind"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))




def typed_chunks(capabilities: DataFrame) -> DataFrame:
    """Chunks of capabilities (source, id, kind, text, rules, moves, confidence): a screen gives a flow, its validations and its transitions, others one text.

    A chunk's index is its running number in its source (`order.numbered`), so that a hot source is numbered by many tasks.
    """
    part = lambda kind, text: F.struct(F.lit(kind).alias("chunk_kind"), text.alias("text"))
    screen = F.concat(F.array(part("flow", F.col("text"))), F.transform("rules", lambda r: part("validation", r)), F.transform("moves", lambda r: part("transition", r)))
    own = capabilities.select("source", "id", (F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence"), F.posexplode(F.when(F.col("kind") == "screen", screen).otherwise(F.array(part("text", F.col("text"))))).alias("pos", "c"))
    return numbered(own, ["source"], ["id", "pos"]).select("row.*", "index").select(F.concat(F.lit("src_"), "source", F.lit("-chunk-"), "index").alias("chunk_id"), "id", "c.chunk_kind", "c.text", "low_confidence")


#: The methods that are operations of a path; other keys of a path (parameters, summary, servers, trace) are none.
HTTP_METHODS = ["get", "post", "put", "patch", "delete", "options", "head"]


def fields_of(json: Column) -> Column:
    """The keys of a JSON object with their values as text; null for what is no object."""
    return F.when(F.ltrim(json).startswith("{"), F.from_json(json, "map<string,string>"))


def given(json: Column | str, path: str) -> Column:
    """The text at a path of JSON; null if it is empty."""
    return F.nullif(F.get_json_object(json, path), F.lit(""))


def spec_operations(specs: DataFrame) -> DataFrame:
    """source, path, method (as written), body of every operation of JSON specs (source, spec): objects under one of HTTP_METHODS, in any case."""
    own = specs.select("source", F.explode(fields_of(F.get_json_object("spec", "$.paths"))).alias("path", "item"))
    own = own.select("source", "path", F.explode(fields_of(F.col("item"))).alias("method", "body"))
    return own.where(F.lower("method").isin(HTTP_METHODS) & F.ltrim("body").startswith("{"))


def openapi_operations(specs: DataFrame) -> DataFrame:
    """An operation per path and method of JSON specs (source, spec): its id, or METHOD_path."""
    operation = F.coalesce(given("body", "$.operationId"), F.concat(F.upper("method"), F.lit("_"), "path"))
    return spec_operations(specs).select("source", "path", "method", operation.alias("operation_id"), F.get_json_object("body", "$.summary").alias("summary"))


def line(label: str, text: Column) -> Column:
    """A line of a text; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"\n{label}"), text), F.lit(""))


def openapi_capabilities(specs: DataFrame) -> DataFrame:
    """capability_id, source, kind, name, text of JSON specs (source, spec): an overview (of specs with a title), their operations, their schemas (of version 3, or else of version 2)."""
    servers = F.transform(F.from_json(F.get_json_object("spec", "$.servers"), "array<string>"), lambda s: F.coalesce(F.get_json_object(s, "$.url"), F.lit("")))
    title = given("spec", "$.info.title")
    text = F.concat(F.lit("API: "), title, line("Version: ", given("spec", "$.info.version")), line("", given("spec", "$.info.description")), line("Servers: ", F.when(F.size(servers) > 0, F.array_join(servers, ", "))))
    overview = specs.where(title.isNotNull()).select(F.concat("source", F.lit("__overview")).alias("capability_id"), "source", F.lit("overview").alias("kind"), title.alias("name"), text.alias("text"))

    method = F.upper("method")
    name = F.coalesce(given("body", "$.operationId"), F.concat(method, F.lit("_"), F.regexp_replace(F.replace("path", F.lit("/"), F.lit("_")), "^_+|_+$", "")))
    summary, more = given("body", "$.summary"), given("body", "$.description")
    listed = F.from_json(F.get_json_object("body", "$.parameters"), "array<string>")
    parameters = F.transform(F.filter(listed, lambda p: p.startswith("{")), lambda p: F.coalesce(F.get_json_object(p, "$.name"), F.lit("?")))
    codes = F.map_keys(fields_of(F.get_json_object("body", "$.responses")))
    text = F.concat(
        method, F.lit(" "), "path", F.coalesce(F.concat(F.lit(" — "), summary), F.lit("")), line("", F.when(~more.eqNullSafe(summary), more)),
        line("Parameters: ", F.when(F.size(listed) > 0, F.array_join(parameters, ", "))), line("Response codes: ", F.when(F.size(codes) > 0, F.array_join(codes, ", "))),
    )
    endpoints = spec_operations(specs).select("source", name.alias("name"), text.alias("text")).select(F.concat("source", F.lit("__endpoint__"), "name").alias("capability_id"), "source", F.lit("endpoint").alias("kind"), "name", "text")

    names = F.map_keys(fields_of(F.get_json_object("body", "$.properties")))
    required = F.coalesce(F.from_json(F.get_json_object("body", "$.required"), "array<string>"), F.array().cast("array<string>"))
    shown = F.transform(names, lambda n: F.concat(n, F.when(F.array_contains(required, n), F.lit(" (required)")).otherwise(" (optional)")))
    text = F.concat(F.lit("Schema: "), "name", line("Fields: ", F.when(F.size(names) > 0, F.array_join(shown, ", "))))
    schemas = spec_schemas(specs).select(F.concat("source", F.lit("__schema__"), "name").alias("capability_id"), "source", F.lit("schema").alias("kind"), "name", text.alias("text"))
    return overview.unionByName(endpoints).unionByName(schemas)


def spec_schemas(specs: DataFrame) -> DataFrame:
    """source, name, body of the schemas of JSON specs of version 3, or if there are none of version 2."""
    new, old = (fields_of(F.get_json_object("spec", p)) for p in ("$.components.schemas", "$.definitions"))
    own = specs.select("source", F.explode(F.when(F.size(new) > 0, new).otherwise(old)).alias("name", "body"))
    return own.where(F.ltrim("body").startswith("{"))


def canonical_hash(json: Column) -> Column:
    """Hash of JSON that doesn't depend on the order of keys or on spacing; null for what isn't JSON."""
    return F.sha2(F.to_json(F.try_parse_json(json)), 256)


def parsed_replies(replies: DataFrame) -> DataFrame:
    """JSON objects out of model replies (event_id, reply): as they are, without fences, or from the first to the last brace; rejected otherwise."""
    schema = "id long, kind string"
    bare = F.regexp_replace(F.regexp_replace("reply", r"^\s*```[a-z]*\s*", ""), r"\s*```\s*$", "")
    braces = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    read = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
    own = replies.select("event_id", F.coalesce(read(F.col("reply")), read(bare), read(F.nullif(braces, F.lit("")))).alias("o"))
    return own.select("event_id", "o.id", "o.kind", F.col("o.id").isNull().alias("rejected"))


def normalised_claims(claims: DataFrame) -> DataFrame:
    return claims.withColumn("confidence", F.when(F.col("confidence").isin(*WEIGHTS), F.col("confidence")).otherwise("missing_evidence"))


def claim_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("pack_id").agg(*[F.count_if(F.col("confidence") == k).alias(k) for k in WEIGHTS])


def evidence_report(claims: DataFrame, least_lists: tuple[str, ...] = ()) -> DataFrame:
    """Per pack: claims, ids used twice, claims of an unknown confidence, share without evidence and whether that is over a half, issues.

    claims: pack_id, claim_id, confidence, and if there `scope` and `expected_scope` (compared whatever their case) and boolean columns least_lists, of which one claim of
    a pack must have each.
    """
    twice = claims.groupBy("pack_id", "claim_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("pack_id").agg(F.count(F.lit(1)).alias("duplicated"))
    scoped = F.lower("scope") != F.lower("expected_scope") if {"scope", "expected_scope"} <= set(claims.columns) else F.lit(False)
    checks = [F.count_if(~F.coalesce(F.col("confidence").isin(*WEIGHTS), F.lit(False))).alias("invalid"), F.count_if(scoped).alias("off_scope"), *[F.max(F.col(c).cast("int")).alias(f"has_{c}") for c in least_lists]]
    own = claims.groupBy("pack_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("confidence") == "missing_evidence").alias("missing"), *checks).join(twice, "pack_id", "left")
    ratio, duplicated = F.col("missing") / F.col("claims"), F.coalesce("duplicated", F.lit(0))
    issues = F.array_compact(F.array(F.when(F.col("off_scope") > 0, "scope"), *[F.when(F.coalesce(f"has_{c}", F.lit(0)) == 0, f"empty_{c}") for c in least_lists], F.when(duplicated > 0, "duplicates"), F.when(F.col("invalid") > 0, "invalid_confidence"), F.when(ratio > 0.5, "missing_evidence")))
    return own.select("pack_id", "claims", duplicated.alias("duplicated"), "invalid", F.round(ratio, 6).alias("missing_ratio"), (ratio > 0.5).alias("weak"), issues.alias("issues"))


#: Letters of the runs by which long words meet the words that contain them; words of more than four letters have one at least.
GRAM = 5


def grams(word: Column, n: int = GRAM) -> Column:
    """The different runs of n letters of a word; none if it is shorter."""
    return F.array_distinct(F.transform(F.when(F.length(word) >= n, F.sequence(F.lit(1), F.length(word) - (n - 1))), lambda i: F.substring(word, i, F.lit(n))))


def words_within(wanted: DataFrame, words: DataFrame) -> DataFrame:
    """pack_id, wanted, word: which words (pack_id, word) of a pack contain a wanted one (pack_id, wanted, of GRAM letters or more).

    A wanted word goes by the run of its letters that fewest of the pack's words have; it meets the words with that run, and only then the texts are compared. So nothing is paired that has no run in common.
    """
    runs = words.where(F.length("word") >= GRAM).select("pack_id", "word", F.explode(grams(F.col("word"))).alias("gram"))
    often = runs.groupBy("pack_id", "gram").agg(F.count(F.lit(1)).alias("often"))
    own = wanted.select("pack_id", "wanted", F.explode(grams(F.col("wanted"))).alias("gram")).join(often, ["pack_id", "gram"], "left")
    # a word one of whose runs is nowhere in the pack is contained in none
    rarest = own.groupBy("pack_id", "wanted").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("gram"))
    return runs.join(rarest, ["pack_id", "gram"]).where(F.col("word").contains(F.col("wanted"))).select("pack_id", "wanted", "word")


def section_confidence(sections: DataFrame, claims: DataFrame) -> DataFrame:
    """Sections (pack_id, section, text) with the mean weight of the pack's claims (claim, confidence, statement, and if there source_chunks) of which a word of more than four letters occurs in
    them, also within a longer word; the claims' number and first id, their source chunks and issues.

    A claim's different long words travel in one row and meet the pack's sections there, until one is found: a text and a claim's words are shuffled once, whatever the number of their words, and only
    matches go on, which the result counts one by one anyway. A pack's pairs of a section and a claim are looked at, in one task; packs are parts of a corpus.
    """
    weight = F.coalesce(*[F.when(F.col("confidence") == k, v) for k, v in WEIGHTS.items()], F.lit(UNSUPPORTED))
    long_words = F.array_distinct(F.transform(F.filter(F.split("statement", r"\s+"), lambda w: F.length(w) > 4), F.lower))
    in_claims = claims.select("pack_id", "claim", long_words.alias("wanted")).where(F.size("wanted") > 0)
    texts = sections.select("pack_id", "section", F.lower("text").alias("text")).where("text IS NOT NULL")
    found = texts.hint("merge").join(in_claims, "pack_id").where(F.exists("wanted", lambda w: F.col("text").contains(w)))
    matched = found.select("pack_id", "section", "claim").distinct()
    chunks = F.col("source_chunks") if "source_chunks" in claims.columns else F.array().cast("array<long>")
    one = claims.groupBy("pack_id", "claim").agg(F.first(F.struct(weight.alias("w"), "confidence", chunks.alias("source_chunks"))).alias("of"))
    hits = matched.join(one, ["pack_id", "claim"]).select("pack_id", "section", "claim", "of.*")
    found = hits.groupBy("pack_id", "section").agg(F.count("w").alias("claims"), F.avg("w").alias("confidence"), F.count_if(F.col("confidence") == "missing_evidence").alias("missing"), F.min("claim").alias("first_claim"))
    sources = hits.select("pack_id", "section", F.explode("source_chunks").alias("chunk")).distinct().groupBy("pack_id", "section").agg(F.array_sort(F.collect_list("chunk")).alias("source_chunks"))
    issues = F.when(F.col("claims").isNull(), F.array(F.lit("unverified"))).otherwise(F.array_compact(F.array(F.when(F.round("confidence", 3) < 0.4, "low_evidence_density"), F.when(F.col("missing") > 0, "missing_evidence"))))
    own = sections.select("pack_id", "section").join(found, ["pack_id", "section"], "left").join(sources, ["pack_id", "section"], "left")
    return own.select("pack_id", "section", F.coalesce("claims", F.lit(0)).alias("claims"), F.round(F.coalesce("confidence", F.lit(UNSUPPORTED)), 6).alias("confidence"), "first_claim", F.coalesce("source_chunks", F.slice(F.array(F.lit(None).cast(own.schema["source_chunks"].dataType.elementType)), 1, 0)).alias("source_chunks"), issues.alias("issues"))


def openapi_schemas(specs: DataFrame) -> DataFrame:
    """Schemas of version 3 or 2 specs (source, spec): source, name, number of properties."""
    return spec_schemas(specs).select("source", "name", F.coalesce(F.size(F.from_json(F.get_json_object("body", "$.properties"), "map<string,string>")), F.lit(0)).alias("properties"))


def tool_capabilities(tools: DataFrame) -> DataFrame:
    """Tools (source, name, description, schema as JSON) as capabilities whose text names the parameters and which are required."""
    names = F.map_keys(F.from_json(F.get_json_object("schema", "$.properties"), "map<string,string>"))
    required = F.coalesce(F.from_json(F.get_json_object("schema", "$.required"), "array<string>"), F.array().cast("array<string>"))
    listed = F.array_join(F.transform(names, lambda n: F.concat(n, F.when(F.array_contains(required, n), F.lit(" (required)")).otherwise(" (optional)"))), ", ")
    text = F.concat(F.lit("Tool: "), "name", F.coalesce(F.concat(F.lit("\n"), F.nullif("description", F.lit(""))), F.lit("")), F.when(F.size(names) > 0, F.concat(F.lit("\nParameters: "), listed)).otherwise(""))
    return tools.select(F.concat("source", F.lit("__tool__"), "name").alias("capability_id"), text.alias("text"))


def resource_capabilities(resources: DataFrame) -> DataFrame:
    """Resources (source, name, uri, description, mime) as capabilities."""
    line = lambda label, c: F.coalesce(F.concat(F.lit(f"\n{label}: "), F.nullif(F.col(c), F.lit(""))), F.lit(""))
    return resources.select(F.concat("source", F.lit("__resource__"), "name").alias("capability_id"), F.concat(F.lit("Resource: "), "name", line("URI", "uri"), line("Type", "mime"), line("Description", "description")).alias("text"))


def prompt_capabilities(prompts: DataFrame) -> DataFrame:
    """Prompts (source, name, description, arguments: array of (name, required)) as capabilities."""
    listed = F.array_join(F.transform("arguments", lambda a: F.concat(a["name"], F.when(a["required"], F.lit(" (required)")).otherwise(" (optional)"))), ", ")
    text = F.concat(F.lit("Prompt: "), "name", F.coalesce(F.concat(F.lit("\n"), F.nullif("description", F.lit(""))), F.lit("")), F.when(F.size("arguments") > 0, F.concat(F.lit("\nArguments: "), listed)).otherwise(""))
    return prompts.select(F.concat("source", F.lit("__prompt__"), "name").alias("capability_id"), text.alias("text"))


def section_groups(chunks: DataFrame, most: int = 15, least: int = 3) -> DataFrame:
    """A document's first `most` sections in header order, of these the ones with `least` chunks or more: chunks (doc_id, header, pos, text).

    A section's text is a value of one row, so it must fit one: sections are parts of a document, not of a source.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n")
    own = chunks.groupBy("doc_id", "header").agg(F.count(F.lit(1)).alias("chunks"), joined.alias("text"))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("header")))
    return own.where((F.col("place") <= most) & (F.col("chunks") >= least)).drop("place")
