"""Retrieval queries over the test tables, and the same in SQL.

Chunks are the documents, text queries the benchmark items; query vectors are the embeddings whose id is divisible by 20. A chunk is relevant to a
query if it contains the item's text; a vector to a query vector if it has its label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.operators import retrieval as r
from quarryline.operators.ingest import grams, words_within
from quarryline.operators.order import at_shares
from quarryline.sources.tables import spread, stored

INTENTS = ("overview", "business_rules", "data_mapping", "errors", "architecture")
#: Word lists that are added to a query for its intent, and the chunk types that earn a bonus.
INTENT_WORDS = {
    "overview": "overview summary scope end-to-end flow diagram component system landscape integration boundary capability purpose context",
    "business_rules": "rule validation constraint mandatory conditional logic governance approval threshold eligibility policy decision table normative",
    "data_mapping": "field mapping transformation source target attribute schema canonical normalization domain model master data hierarchy taxonomy type format",
    "errors": "error exception retry timeout fallback dead-letter circuit-breaker idempotent recovery compensation rollback alert edge-case boundary invalid null missing response code status",
    "architecture": "API REST SOAP webhook event message queue batch trigger schedule middleware adapter connector protocol authentication SLA throughput latency non-functional idempotency",
}
BONUS_TYPES = {
    "overview": ("system_overview", "integration_flow"),
    "business_rules": ("business_rule", "validation_rule"),
    "data_mapping": ("data_mapping_candidate", "field_definition", "entity_definition"),
    "errors": ("error_handling",),
    "architecture": ("integration_flow", "api_contract", "security_requirement"),
}
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "it", "that", "this", "was", "for", "on", "with", "as", "by", "be", "are", "from", "or", "an"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source", "lang")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    return own, own.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


CHUNK_WORDS = """
cw AS (SELECT doc_id AS chunk_id, source, lang, text, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents),
qw AS (SELECT item_id AS query_id, text, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM benchmark)"""
BM25 = CHUNK_WORDS + f""",
stats AS (SELECT count(*) AS n, avg(coalesce(len(w), 0)) AS avgdl FROM cw),
tf AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM cw) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(w) AS term FROM qw) GROUP BY ALL),
wt AS (SELECT query_id, term, qtf * ln((n + 1) / df) AS w, avgdl FROM qt JOIN df USING (term), stats),
floors AS (SELECT query_id, sum(w * {r.DELTA}) AS floor FROM wt GROUP BY query_id),
bm25 AS (SELECT query_id, chunk_id, round(sum(w * tf * {r.K1 + 1} / (tf + {r.K1} * ({1 - r.B} + {r.B} * dl / avgdl))) + any_value(floor), 6) AS score FROM tf JOIN wt USING (term) JOIN floors USING (query_id) GROUP BY ALL),
shared AS (SELECT query_id, chunk_id, round(count(*) / any_value(size), 6) AS score
           FROM (SELECT chunk_id, unnest(list_distinct(w)) AS term FROM cw) JOIN (SELECT query_id, unnest(list_distinct(w)) AS term, len(list_distinct(w)) AS size FROM qw) USING (term) GROUP BY ALL),
top_bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm25),
top_shared AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM shared),
lists AS (SELECT 'a' AS list, query_id, chunk_id, score, rank FROM top_bm25 WHERE rank <= 20 UNION ALL SELECT 'b', query_id, chunk_id, score, rank FROM top_shared WHERE rank <= 20),
keyed AS (SELECT lists.*, left(text, 100) AS key FROM lists JOIN cw USING (chunk_id)),
rrf AS (SELECT query_id, key, arg_min(chunk_id, (list, rank)) AS chunk_id, round(sum(1 / ({r.RRF_K} + rank)), 9) AS score FROM keyed GROUP BY query_id, key),
maxima AS (SELECT list, query_id, max(score) AS top FROM keyed GROUP BY ALL),
ens AS (SELECT query_id, key, arg_min(chunk_id, (list, -score, chunk_id)) AS chunk_id, round(sum(CASE WHEN top > 0 THEN score / top * CASE list WHEN 'a' THEN {r.ENSEMBLE[0]} ELSE {r.ENSEMBLE[1]} END ELSE 0 END), 6) AS score FROM keyed JOIN maxima USING (list, query_id) GROUP BY query_id, key),
truth AS (SELECT DISTINCT item_id AS query_id, doc_id AS item FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"""


def two_lists(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    c, q = spread(chunks(spark, sf_dir)), text_queries(spark, sf_dir)
    a = r.bm25_top(c, q, k).withColumn("list", F.lit("a"))
    b = r.overlap_top(c, q, k).withColumn("list", F.lit("b"))
    return a.unionByName(b).drop("rank").join(c.select("chunk_id", F.substring("text", 1, 100).alias("key")), "chunk_id")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that stand word for word in a document, from an equi-join: an item of three words and more goes by the longest of its inner words, which a document with the item has as a word; texts come only to the pairs that
    share it. The first word of an item of one or two may be a part of a longer one: such items go by the runs of letters of their longest word (`words_within`), and if no word has five letters by all
    runs of their own length. An empty item stands in no document.
    """
    cut = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    longest = F.array_max(F.transform(F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    q = text_queries(spark, sf_dir).where("text IS NOT NULL").select("query_id", F.col("text").alias("item_text"), longest.alias("key"), F.array_max(F.transform(cut, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("word"))
    c = spread(chunks(spark, sf_dir).select("chunk_id", "text"))
    words = c.select("chunk_id", F.explode(F.array_distinct(cut)).alias("key"))
    pairs = words.join(q.where("key IS NOT NULL").select("query_id", "key"), "key").select("query_id", "chunk_id")
    short = stored(q.where("key IS NULL"), "short-items")
    if not short.isEmpty():
        one = F.lit("all").alias("pack_id")
        within = words_within(short.where("length(word) >= 5").select(one, F.col("word").alias("wanted")).distinct(), words.select(one, F.col("key").alias("word")).distinct())
        named = within.join(short.select("query_id", F.col("word").alias("wanted")), "wanted").select("query_id", F.col("word").alias("key")).distinct()
        pairs = pairs.unionByName(words.join(named, "key").select("query_id", "chunk_id")).distinct()
        rest = short.where("coalesce(length(word), 0) < 5 AND item_text <> ''")
        for n in [x.n for x in rest.select(F.length("item_text").alias("n")).distinct().collect()]:  # two short words: a few lengths
            runs = c.select("chunk_id", F.explode(grams(F.col("text"), n)).alias("item_text"))
            pairs = pairs.unionByName(runs.join(rest, "item_text").select("query_id", "chunk_id"))
    return pairs.join(c, "chunk_id").join(q.select("query_id", "item_text"), "query_id").where(F.col("text").contains(F.col("item_text"))).select("query_id", F.col("chunk_id").alias("item")).distinct()


def bm25_term_stats(spark, sf_dir):
    return r.term_stats(chunks(spark, sf_dir))


def bm25_corpus_stats(spark, sf_dir):
    return r.corpus_stats(chunks(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


def retrieval_bm25_scores(spark, sf_dir):
    return r.bm25(spread(chunks(spark, sf_dir)), text_queries(spark, sf_dir))


def retrieval_bm25_topk(spark, sf_dir):
    return r.bm25_top(spread(chunks(spark, sf_dir)), text_queries(spark, sf_dir), 5)


def bm25_topk_of_all(spark, sf_dir):
    """The ten best documents of each item's longest word, which few documents have; the rest are those of the smallest ids at the floor."""
    longest = F.array_max(F.transform(r.words(F.col("text")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return r.bm25_top_of_all(spread(chunks(spark, sf_dir)), text_queries(spark, sf_dir).select("query_id", longest.alias("text")), 10)


def query_variants(spark, sf_dir):
    """The item, a sentence made of its first words, and phrasings from another table: of every third item three, the first of them blank where the id is even, the last beyond the two that count."""
    q = text_queries(spark, sf_dir)
    part = lambda n: F.coalesce(F.get(F.split("text", " "), F.lit(n)), F.lit(""))
    other = F.array(F.when(F.col("query_id") % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" about "), part(3))), F.concat(part(4), F.lit(" in other words\n")), F.lit("one too many"))
    external = q.where("query_id % 3 = 0").select("query_id", F.posexplode(other).alias("pos", "text"))
    return r.query_variants(q.select("query_id", "text", part(0).alias("source"), part(1).alias("target"), part(2).alias("category")), external)


def retrieval_bm25_variants(spark, sf_dir):
    """All variants are scored and a chunk keeps its best: the ten best chunks of a query are among the ten best of the variant that each has its score from."""
    q = query_variants(spark, sf_dir).select((F.col("query_id") * 4 + F.col("variant")).alias("query_id"), "text")
    best = r.bm25_top(spread(chunks(spark, sf_dir)), q, 10).groupBy(F.floor(F.col("query_id") / 4).alias("query_id"), "chunk_id").agg(F.max("score").alias("score"))
    return r.ranked(best, 10)


def fusion_rrf(spark, sf_dir):
    return r.ranked(r.rank_fusion(two_lists(spark, sf_dir)), 10).select("query_id", "chunk_id", "score", "rank")


def fusion_ensemble(spark, sf_dir):
    return r.ranked(r.ensemble(two_lists(spark, sf_dir), {"a": r.ENSEMBLE[0], "b": r.ENSEMBLE[1]}), 10).select("query_id", "chunk_id", "score", "rank")


def ensemble_threshold(spark, sf_dir):
    return r.above_threshold(r.ensemble(two_lists(spark, sf_dir), {"a": r.ENSEMBLE[0], "b": r.ENSEMBLE[1]})).select("query_id", "chunk_id", "score")


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates after fusion, cut to 30, with text, tags and the query's intent; written once (30 rows a query), as queries read them several times."""
    c = chunks(spark, sf_dir).select("chunk_id", "text", "source", "lang", F.concat_ws(",", "source", "lang").alias("tags_csv"))
    intent = F.element_at(F.array(*[F.lit(i) for i in INTENTS]), (F.col("query_id") % len(INTENTS) + 1).cast("int"))
    own = r.ranked(r.ensemble(two_lists(spark, sf_dir), {"a": r.ENSEMBLE[0], "b": r.ENSEMBLE[1]}), 30).select("query_id", "chunk_id", "score")
    return stored(own.join(c, "chunk_id").withColumn("intent", intent), "fused")


INTENT_SQL = "CASE query_id % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(INTENTS)) + " END"
FUSED = BM25 + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ens),
fused AS (SELECT query_id, chunk_id, score, cw.text, cw.source, cw.lang, cw.source || ',' || cw.lang AS tags_csv, {INTENT_SQL} AS intent FROM ranked JOIN cw USING (chunk_id) WHERE rank <= 30)"""


def candidate_cut(spark, sf_dir):
    return fused(spark, sf_dir).select("query_id", "chunk_id", "score", "intent", "tags_csv")


def tag_whole_token(spark, sf_dir):
    tags = F.when(F.col("query_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(" EN "), F.concat(F.lit("src"), F.col("query_id") % 20)))
    return r.tag_filter(fused(spark, sf_dir), tags).select("query_id", "chunk_id", "score")


def tag_with_fallback(spark, sf_dir):
    return r.tag_filter_or_all(fused(spark, sf_dir), F.col("lang") == "fr").select("query_id", "chunk_id", "score")


def tag_primary_top2(spark, sf_dir):
    return r.primary_tag_top(fused(spark, sf_dir), F.lit("es")).select("query_id", "chunk_id", "score", "rank", "label")


def tag_kb_variant(spark, sf_dir):
    return r.primary_tag_top(fused(spark, sf_dir), F.lit("src1"), fetch=15, keep=15).select("query_id", "chunk_id", "score", "rank", "label")


def judge_rescore(spark, sf_dir):
    """Labels judge the fused candidates of even queries."""
    own = fused(spark, sf_dir)
    judged = own.where("query_id % 2 = 0").join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "chunk_id"), "chunk_id").groupBy("query_id", "chunk_id").agg(F.max(F.col("quality") + 0.5).alias("judge_score"))
    return r.rescored(own.select("query_id", "chunk_id", "score"), judged).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def tfidf_rerank(spark, sf_dir):
    boost = F.create_map(*[F.lit(x) for kv in INTENT_WORDS.items() for x in kv])
    intent = F.element_at(F.array(*[F.lit(i) for i in INTENTS]), (F.col("query_id") % len(INTENTS) + 1).cast("int"))
    q = text_queries(spark, sf_dir).select("query_id", F.concat_ws(" ", "text", boost[intent]).alias("text"))
    out = r.tfidf_rerank(fused(spark, sf_dir), q, STOP_WORDS)
    return r.ranked(out, 10).select("query_id", "chunk_id", "score", "rank")


TFIDF = FUSED + """,
boosted AS (SELECT query_id, text || ' ' || CASE """ + INTENT_SQL + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in INTENT_WORDS.items()) + """ END AS text FROM qw),
texts AS (SELECT query_id, chunk_id, text FROM fused UNION ALL SELECT query_id, -1, text FROM boosted),
toks AS (SELECT query_id, chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM texts),
ttf AS (SELECT query_id, chunk_id, term, count(*) AS tf FROM toks WHERE term NOT IN (""" + ", ".join(f"'{w}'" for w in STOP_WORDS) + """) GROUP BY ALL),
tdf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cf DESC, term) AS place FROM (SELECT query_id, term, count(*) AS df, sum(tf) AS cf FROM ttf GROUP BY ALL)),
tn AS (SELECT query_id, count(*) AS n FROM texts GROUP BY ALL),
tw AS (SELECT query_id, chunk_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM ttf JOIN tdf USING (query_id, term) JOIN tn USING (query_id) WHERE place <= 5000),
tq AS (SELECT query_id, term, w AS q FROM tw WHERE chunk_id = -1),
td AS (SELECT query_id, chunk_id, sum(w * coalesce(q, 0)) AS dot, sqrt(sum(w * w)) AS norm FROM tw LEFT JOIN tq USING (query_id, term) GROUP BY ALL),
tc AS (SELECT a.query_id, a.chunk_id, a.dot / (a.norm * b.norm) AS cosine FROM td a JOIN td b ON a.query_id = b.query_id AND b.chunk_id = -1),
reranked AS (SELECT query_id, chunk_id, CASE WHEN n <= 2 THEN score ELSE round(0.5 * score + 0.5 * coalesce(cosine, 0), 6) END AS score FROM fused LEFT JOIN tc USING (query_id, chunk_id) JOIN tn USING (query_id))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM reranked) WHERE rank <= 10"""


def semantic_bonus(spark, sf_dir):
    """Chunk types stand in by language here; the bonus table is derived from the intents."""
    kinds = F.create_map(*[F.lit(x) for kv in (("en", "system_overview"), ("fr", "business_rule"), ("de", "error_handling"), ("es", "api_contract")) for x in kv])
    own = fused(spark, sf_dir).withColumn("semantic_type", kinds[F.col("lang")])
    bonus = spark.createDataFrame([(k, t) for k, v in BONUS_TYPES.items() for t in v], "intent string, semantic_type string")
    return r.ranked(r.semantic_bonus(own, bonus), 10).select("query_id", "chunk_id", "score", "rank")


def dense_top10(spark, sf_dir):
    c, q = vectors(spark, sf_dir)
    return r.ranked(r.dense_scores(r.dense_top(c, q, 10)))


def dense_cosine_search(spark, sf_dir):
    c, q = vectors(spark, sf_dir)
    return r.dense_top(c, q, 10, "cosine").select("query_id", "chunk_id", F.round(1 - F.col("distance"), 4).alias("score"))


def dense_best_per_label(spark, sf_dir):
    c, q = vectors(spark, sf_dir)
    return r.best_per_document(r.dense_scores(r.dense_top(c, q, 30)).join(c.select("chunk_id", F.col("label").alias("doc_id")), "chunk_id"))


def summary_retrieval(spark, sf_dir):
    """Twice the wanted number are fetched, filtered by tag (the label), and three kept."""
    c, q = vectors(spark, sf_dir)
    own = r.dense_scores(r.dense_top(c, q, 6)).join(c.select("chunk_id", F.col("label").cast("string").alias("tags_csv")), "chunk_id").join(q.select("query_id", "query_label"), "query_id")
    return r.ranked(r.tag_filter(own, F.array(F.col("query_label").cast("string"))), 3).select("query_id", "chunk_id", "score", "rank")


def dense_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ranks of the retrieved vectors that have the query's label, and how many others have it."""
    c, q = vectors(spark, sf_dir)
    ranks = r.ranked(r.dense_scores(r.dense_top(c, q, 11)).where("query_id <> chunk_id"), 10).withColumnRenamed("chunk_id", "item")
    return r.relevant_by_label(ranks, c.select(F.col("chunk_id").alias("item"), "label"), q.select("query_id", F.col("query_label").alias("label")))


def metric_recall5_dense(spark, sf_dir):
    return r.recall_of(*dense_hits(spark, sf_dir), 5)


def metric_mrr_dense(spark, sf_dir):
    return r.reciprocal_rank_of(*dense_hits(spark, sf_dir))


def metric_ndcg5_dense(spark, sf_dir):
    return r.ndcg_of(*dense_hits(spark, sf_dir), 5)


def metric_summary_bm25(spark, sf_dir):
    """Mean recall@5, reciprocal rank and NDCG@5 of BM25+ against word-for-word truth."""
    ranks = r.bm25_top(spread(chunks(spark, sf_dir)), text_queries(spark, sf_dir), 10).withColumnRenamed("chunk_id", "item")
    hits, sizes = (stored(d, "judged") for d in r.relevant(ranks, truth(spark, sf_dir)))  # at most ten rows a query, and one
    own = r.recall_of(hits, sizes, 5).join(r.reciprocal_rank_of(hits, sizes), "query_id").join(r.ndcg_of(hits, sizes, 5), "query_id")
    return own.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("recall"), 5).alias("recall5"), F.round(F.avg("rr"), 5).alias("mrr"), F.round(F.avg("ndcg"), 5).alias("ndcg5"))


def top_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.bm25_top(spread(chunks(spark, sf_dir)), text_queries(spark, sf_dir), 5).join(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id")


def metric_keyword_coverage(spark, sf_dir):
    words = F.array_distinct(r.words(F.col("text")))
    return r.keyword_coverage(top_texts(spark, sf_dir), text_queries(spark, sf_dir).select("query_id", F.explode(words).alias("keyword")))


def metric_faithfulness(spark, sf_dir):
    words = F.array_distinct(r.words(F.col("text")))
    return r.faithfulness(top_texts(spark, sf_dir), text_queries(spark, sf_dir).select("query_id", F.explode(words).alias("token")))


def metric_index_percentiles(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), "value")
    return at_shares(own, {"p50": 0.5, "p95": 0.95})


def context_budget(spark, sf_dir):
    """Fused candidates of a query until 6000 characters are used: entries are a header and the text."""
    entry = F.length(F.concat(F.lit("### Source: kb_file · score: "), F.format_string("%.2f", "score"), F.lit("\n"), "text")).cast("long")
    return r.budgeted(fused(spark, sf_dir), 6000, ("query_id",), entry).select("query_id", "chunk_id", "score", "used")


def context_pinned(spark, sf_dir):
    """Word-for-word copies are pinned: each gets an equal share of 1200 characters."""
    pinned = truth(spark, sf_dir).join(chunks(spark, sf_dir).select(F.col("chunk_id").alias("item"), "text"), "item")
    cap = F.floor(F.lit(1200) / F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    own = pinned.withColumn("cap", cap).withColumn("cut", F.concat(F.expr("substring(text, 1, int(cap))"), F.when(F.length("text") > F.col("cap"), "…").otherwise("")))
    size = F.length(F.concat(F.lit("### Source: pinned · doc: "), F.col("chunk_id").cast("string"), F.lit("\n"), "cut")).cast("long")
    own = own.withColumn("score", F.lit(1.0)).withColumnRenamed("item", "chunk_id")
    return r.budgeted(own, 1200, ("query_id",), size).select("query_id", "chunk_id", "cap", "used")


def context_text(spark, sf_dir):
    """The first three texts of a query, joined and cut to 3000 characters."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"])
    return top_texts(spark, sf_dir).where("rank <= 3").groupBy("query_id").agg(F.substring(F.array_join(parts, "\n---\n"), 1, 3000).alias("context"))


def source_attribution(spark, sf_dir):
    """Sources of a query's context: distinct by 150 characters of preview, best first, ten at most."""
    own = fused(spark, sf_dir).withColumn("preview", F.substring("text", 1, 150))
    first = r.ranked(own, 1, ("query_id", "preview")).drop("rank")
    return r.ranked(first, 10).select("query_id", "chunk_id", F.round("score", 3).alias("score"), "preview", "rank")


DENSE = """
v AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
near AS (SELECT q.chunk_id AS query_id, q.label AS query_label, c.chunk_id, c.label,
                round(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance,
                round(1 - list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(q.e, lambda x: x * x))) * sqrt(list_sum(list_transform(c.e, lambda x: x * x)))), 6) AS cos
         FROM v q, v c WHERE q.chunk_id % 20 = 0),
nr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS place, row_number() OVER (PARTITION BY query_id ORDER BY cos, chunk_id) AS cplace, round(1 / (1 + distance), 6) AS score FROM near),
dr AS (SELECT query_id, query_label, chunk_id AS item, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM nr WHERE place <= 11 AND chunk_id <> query_id),
lt AS (SELECT q.chunk_id AS query_id, c.chunk_id AS item FROM v q JOIN v c ON q.label = c.label AND q.chunk_id <> c.chunk_id WHERE q.chunk_id % 20 = 0),
ls AS (SELECT query_id, count(DISTINCT item) AS size FROM lt GROUP BY ALL)"""
TOP5 = BM25 + ",\ntt AS (SELECT query_id, chunk_id, rank, cw.text FROM top_bm25 JOIN cw USING (chunk_id) WHERE rank <= 5)"

SQL = {
    "bm25_term_stats": f"WITH {BM25} SELECT term, df, CAST(cf AS BIGINT) AS cf FROM df",
    "bm25_corpus_stats": f"WITH {BM25} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "retrieval_bm25_scores": f"WITH {BM25} SELECT query_id, chunk_id, score FROM bm25",
    "retrieval_bm25_topk": f"WITH {BM25} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM top_bm25 WHERE rank <= 5",
    "bm25_topk_of_all": f"""WITH {BM25.replace("AS w FROM benchmark)", "AS all_w, [list_max(list_transform(all_w, lambda w: {'n': length(w), 'w': w})).w] AS w FROM benchmark)")},
        every AS (SELECT query_id, chunk_id, coalesce(bm25.score, round(floor, 6)) AS score FROM floors CROSS JOIN cw LEFT JOIN bm25 USING (query_id, chunk_id))
        SELECT * FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM every) WHERE rank <= 10""",
    "fusion_rrf": f"WITH {BM25} SELECT * FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM rrf) WHERE rank <= 10",
    "fusion_ensemble": f"WITH {BM25} SELECT * FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM ens) WHERE rank <= 10",
    "ensemble_threshold": f"WITH {BM25} SELECT query_id, chunk_id, score FROM ens WHERE score >= 1 / 1.8",
    "candidate_cut": f"WITH {FUSED} SELECT query_id, chunk_id, score, intent, tags_csv FROM fused",
    "tag_whole_token": f"WITH {FUSED} SELECT query_id, chunk_id, score FROM fused WHERE query_id % 3 = 0 OR lang = 'en' OR source = 'src' || (query_id % 20)",
    "tag_with_fallback": f"WITH {FUSED} SELECT query_id, chunk_id, score FROM (SELECT *, bool_or(lang = 'fr') OVER (PARTITION BY query_id) AS any_hit FROM fused) WHERE NOT any_hit OR lang = 'fr'",
    "tag_primary_top2": f"""WITH {FUSED}, f10 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS fetched FROM fused),
        m AS (SELECT *, bool_or(contains(tags_csv, 'es')) OVER (PARTITION BY query_id) AS any_hit FROM f10 WHERE fetched <= 10),
        k AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, CASE WHEN any_hit THEN 'tag_filtered' ELSE 'similarity_fallback' END AS label FROM m WHERE NOT any_hit OR contains(tags_csv, 'es'))
        SELECT * FROM k WHERE rank <= 2""",
    "tag_kb_variant": f"""WITH {FUSED}, f10 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS fetched FROM fused),
        m AS (SELECT *, bool_or(contains(tags_csv, 'src1')) OVER (PARTITION BY query_id) AS any_hit FROM f10 WHERE fetched <= 15)
        SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, CASE WHEN any_hit THEN 'tag_filtered' ELSE 'similarity_fallback' END AS label FROM m WHERE NOT any_hit OR contains(tags_csv, 'src1')""",
    "judge_rescore": f"""WITH {FUSED}, j AS (SELECT query_id, chunk_id, max(quality + 0.5) AS judge FROM fused JOIN labels ON chunk_id = doc_id WHERE query_id % 2 = 0 GROUP BY ALL),
        n AS (SELECT fused.query_id, fused.chunk_id, score, judge, count(judge) OVER (PARTITION BY fused.query_id) AS n FROM fused LEFT JOIN j USING (query_id, chunk_id))
        SELECT query_id, chunk_id, CAST(round(coalesce(judge, score), 6) AS DOUBLE) AS score FROM n WHERE n = 0 OR judge IS NOT NULL""",
    "tfidf_rerank": f"WITH {TFIDF}",
    "semantic_bonus": f"""WITH {FUSED}, t AS (SELECT *, CASE lang WHEN 'en' THEN 'system_overview' WHEN 'fr' THEN 'business_rule' WHEN 'de' THEN 'error_handling' ELSE 'api_contract' END AS kind FROM fused),
        b AS (SELECT query_id, chunk_id, round(score + CASE WHEN {" OR ".join(f"(intent = '{k}' AND kind IN ({', '.join(repr(t) for t in v)}))" for k, v in BONUS_TYPES.items())} THEN 0.08 ELSE 0 END, 6) AS score FROM t)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM b) WHERE rank <= 10""",
    "dense_top10": f"WITH {DENSE} SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM nr WHERE place <= 10",
    "dense_cosine_search": f"WITH {DENSE} SELECT query_id, chunk_id, round(1 - cos, 4) AS score FROM nr WHERE cplace <= 10",
    "dense_best_per_label": f"WITH {DENSE}, b AS (SELECT query_id, label AS doc_id, chunk_id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, chunk_id) AS n FROM nr WHERE place <= 30) SELECT query_id, doc_id, chunk_id, score FROM b WHERE n = 1",
    "summary_retrieval": f"WITH {DENSE}, b AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM nr WHERE place <= 6 AND label = query_label) SELECT * FROM b WHERE rank <= 3",
    "metric_recall5_dense": f"WITH {DENSE}, h AS (SELECT query_id, count(*) AS hits FROM dr WHERE rank <= 5 AND label = query_label GROUP BY ALL) SELECT query_id, round(coalesce(hits, 0) / least(size, 5), 6) AS recall FROM ls LEFT JOIN h USING (query_id)",
    "metric_mrr_dense": f"WITH {DENSE}, h AS (SELECT query_id, min(rank) AS f FROM dr WHERE rank <= 10 AND label = query_label GROUP BY ALL) SELECT query_id, round(coalesce(1 / f, 0), 6) AS rr FROM ls LEFT JOIN h USING (query_id)",
    "metric_ndcg5_dense": f"WITH {DENSE}, h AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg FROM dr WHERE rank <= 5 AND label = query_label GROUP BY ALL) SELECT query_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(size, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM ls LEFT JOIN h USING (query_id)",
    "metric_summary_bm25": f"""WITH {BM25}, s AS (SELECT query_id, count(*) AS size FROM truth GROUP BY ALL), h AS (SELECT query_id, rank FROM top_bm25 JOIN truth USING (query_id) WHERE chunk_id = item AND rank <= 10),
        p AS (SELECT s.query_id, round(count(rank) FILTER (rank <= 5) / least(any_value(size), 5), 6) AS recall, round(coalesce(1 / min(rank), 0), 6) AS rr,
              round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 5), 0) / list_sum(list_transform(range(1, least(any_value(size), 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM s LEFT JOIN h USING (query_id) GROUP BY s.query_id)
        SELECT count(*) AS n_queries, round(avg(recall), 5) AS recall5, round(avg(rr), 5) AS mrr, round(avg(ndcg), 5) AS ndcg5 FROM p""",
    "metric_keyword_coverage": f"WITH {TOP5}, k AS (SELECT query_id, unnest(list_distinct(w)) AS keyword FROM qw), h AS (SELECT k.query_id, keyword, max(CAST(coalesce(contains(lower(text), keyword), false) AS INTEGER)) AS hit FROM k LEFT JOIN tt ON k.query_id = tt.query_id GROUP BY ALL) SELECT query_id, round(sum(hit) / count(*), 6) AS coverage FROM h GROUP BY ALL",
    "metric_faithfulness": f"WITH {TOP5}, k AS (SELECT query_id, unnest(list_distinct(w)) AS token FROM qw), a AS (SELECT query_id, lower(string_agg(text, ' ' ORDER BY rank)) AS answer FROM tt WHERE rank <= 3 GROUP BY ALL) SELECT query_id, round(sum(CAST(coalesce(contains(answer, token), false) AS INTEGER)) / count(*), 6) AS faithfulness FROM k LEFT JOIN a USING (query_id) GROUP BY ALL",
    "metric_index_percentiles": "WITH o AS (SELECT event_type AS label, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT label, max(value) FILTER (place = floor(n * 0.5)) AS p50, max(value) FILTER (place = floor(n * 0.95)) AS p95 FROM o GROUP BY label",
    "context_budget": f"WITH {FUSED}, u AS (SELECT query_id, chunk_id, score, CAST(sum(length('### Source: kb_file · score: ' || printf('%.2f', score) || chr(10) || text)) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM fused) SELECT * FROM u WHERE used <= 6000",
    "context_pinned": f"WITH {BM25}, p AS (SELECT query_id, item, text, 1200 // count(*) OVER (PARTITION BY query_id) AS cap FROM truth JOIN documents ON item = doc_id), u AS (SELECT query_id, item AS chunk_id, cap, CAST(sum(length('### Source: pinned · doc: ' || item || chr(10) || left(text, cap) || CASE WHEN length(text) > cap THEN '…' ELSE '' END)) OVER (PARTITION BY query_id ORDER BY item ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM p) SELECT * FROM u WHERE used <= 1200",
    "context_text": f"WITH {TOP5} SELECT query_id, left(string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank), 3000) AS context FROM tt WHERE rank <= 3 GROUP BY query_id",
    "source_attribution": f"WITH {FUSED}, f AS (SELECT *, left(text, 150) AS preview FROM fused), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, preview ORDER BY score DESC, chunk_id) AS n FROM f) SELECT * FROM (SELECT query_id, chunk_id, round(score, 3) AS score, preview, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o.score DESC, chunk_id) AS INTEGER) AS rank FROM o WHERE n = 1) WHERE rank <= 10",
    "query_variants": """SELECT item_id AS query_id, CAST(0 AS INTEGER) AS variant, text FROM benchmark UNION ALL SELECT item_id, 1, coalesce(split_part(text, ' ', 1), '') || ' to ' || coalesce(split_part(text, ' ', 2), '') || ' ' || coalesce(split_part(text, ' ', 3), '') || ' integration pattern' FROM benchmark
        UNION ALL SELECT item_id, 2, trim('about ' || coalesce(split_part(text, ' ', 4), '')) FROM benchmark WHERE item_id % 3 = 0 AND item_id % 2 <> 0
        UNION ALL SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 3 END, trim(coalesce(split_part(text, ' ', 5), '') || ' in other words') FROM benchmark WHERE item_id % 3 = 0""",
}
QUERIES = {f.__name__: f for f in (bm25_term_stats, bm25_corpus_stats, retrieval_bm25_scores, retrieval_bm25_topk, bm25_topk_of_all, query_variants, retrieval_bm25_variants, fusion_rrf, fusion_ensemble, ensemble_threshold, candidate_cut, tag_whole_token, tag_with_fallback, tag_primary_top2, tag_kb_variant, judge_rescore, tfidf_rerank, semantic_bonus, dense_top10, dense_cosine_search, dense_best_per_label, summary_retrieval, metric_recall5_dense, metric_mrr_dense, metric_ndcg5_dense, metric_summary_bm25, metric_keyword_coverage, metric_faithfulness, metric_index_percentiles, context_budget, context_pinned, context_text, source_attribution)}
VARIANT_SQL = BM25.replace("SELECT item_id AS query_id, text, list_filter", "SELECT query_id, text, list_filter").replace("AS w FROM benchmark)", "AS w FROM (SELECT query_id * 4 + variant AS query_id, text FROM (" + SQL["query_variants"] + ")))")
SQL["retrieval_bm25_variants"] = f"WITH {VARIANT_SQL}, best AS (SELECT query_id // 4 AS query_id, chunk_id, max(score) AS score FROM bm25 GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM best) WHERE rank <= 10"
