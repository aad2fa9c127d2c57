"""Entity graph queries, and the same in SQL.

The larger graph comes from lineitem: an order is a chunk, a hundred orders a document, a part an entity name and a supplier a system. Classified texts give
the candidates and typed relations of the text rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions import text as x
from quarryline.operators import graph as g
from quarryline.operators import membership as m
from quarryline.sources.tables import scratch

from . import texts
from .retrieval import table

def kind():
    return F.when(F.col("l_returnflag") == "R", "CALLS").when(F.col("l_returnflag") == "A", "MAPS_TO").otherwise("RELATED_TO")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chunk_id"), F.floor(F.col("l_orderkey") / 100).alias("doc_id"), F.concat(F.lit("P"), "l_partkey").alias("part"), F.concat(F.lit("S"), "l_suppkey").alias("system"),
        F.col("l_returnflag").alias("semantic_type"), F.concat("l_returnflag", F.repeat("l_linestatus", (F.col("l_linenumber") % 3).cast("int"))).alias("tags_csv"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), kind().alias("rel_type"),
    )


LINES = """lines AS (SELECT l_orderkey AS chunk_id, l_orderkey // 100 AS doc_id, 'P' || l_partkey AS part, 'S' || l_suppkey AS system, l_returnflag AS semantic_type, l_returnflag || repeat(l_linestatus, l_linenumber % 3) AS tags_csv,
  l_orderkey * 10 + l_linenumber AS pos, CASE l_returnflag WHEN 'R' THEN 'CALLS' WHEN 'A' THEN 'MAPS_TO' ELSE 'RELATED_TO' END AS rel_type FROM lineitem),
ents AS (SELECT part AS entity_id, arg_min(semantic_type, (pos, semantic_type)) AS entity_type, list_sort(list(DISTINCT doc_id)) AS doc_ids, list_sort(list(DISTINCT chunk_id)) AS chunk_ids, list_sort(list(DISTINCT semantic_type)) AS semantic_types, arg_max(tags_csv, (length(tags_csv), -pos, tags_csv)) AS tags_csv FROM lines GROUP BY part),
rels AS (SELECT 'REL-' || left(sha1(system || '|' || part || '|' || rel_type), 12) AS rel_id, system AS from_id, part AS to_id, rel_type, CAST(CASE rel_type WHEN 'RELATED_TO' THEN 0.4 ELSE 1.0 END AS DOUBLE) AS weight, list_sort(list(DISTINCT chunk_id)) AS evidence, list_sort(list(DISTINCT doc_id)) AS doc_ids FROM lines GROUP BY system, part, rel_type)"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entity candidates."""
    return lines(spark, sf_dir).select(F.col("part").alias("entity_id"), F.col("part").alias("name"), F.col("semantic_type").alias("entity_type"), "doc_id", "chunk_id", "semantic_type", "tags_csv", "pos")


def found_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(F.col("system").alias("from_id"), F.col("part").alias("to_id"), "rel_type", "chunk_id", "doc_id")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.merge_entities(found(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.merge_relations(found_edges(spark, sf_dir))


def graph_entities(spark, sf_dir):
    return entities(spark, sf_dir)


def graph_edges(spark, sf_dir):
    return edges(spark, sf_dir)


def graph_cooccurrence(spark, sf_dir):
    """Parts of an order that go together, with the number of orders."""
    own = lines(spark, sf_dir).groupBy("chunk_id", "doc_id").agg(F.collect_set("part").alias("names"))
    typed = lines(spark, sf_dir).where("false").select("chunk_id", F.col("part").alias("from_name"), F.col("part").alias("to_name"))
    return g.related(own, typed).groupBy("from_name", "to_name").agg(F.count(F.lit(1)).alias("chunks"))


def graph_without_shadowed(spark, sf_dir):
    return g.without_shadowed(m.edge_views(found_edges(spark, sf_dir))).select("rel_id", "from_id", "to_id", "rel_type")


def graph_stats(spark, sf_dir):
    return m.entity_views(found(spark, sf_dir)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.sum("chunk_count").alias("chunks")).orderBy(F.desc("n"), "entity_type").limit(10)


def graph_top_entities(spark, sf_dir):
    return m.counts(found(spark, sf_dir)).select("entity_id", F.col("chunk_count").cast("int").alias("chunk_count")).orderBy(F.desc("chunk_count"), "entity_id").limit(5)


def graph_incremental(spark, sf_dir):
    """Orders of even documents exist, those of odd ones are new."""
    cols = [F.col("part").alias("entity_id"), F.col("part").alias("name"), F.col("semantic_type").alias("entity_type"), "doc_id", "chunk_id", "semantic_type", "tags_csv", "pos"]
    own = [g.merge_entities(lines(spark, sf_dir).where(F.col("doc_id") % 2 == k).select(*cols)).drop("semantic_types", "chunk_count") for k in (0, 1)]
    return g.merge_incremental(*own)


def graph_members(spark, sf_dir):
    return m.members(found(spark, sf_dir))


def graph_entity_views(spark, sf_dir):
    return m.entity_views(found(spark, sf_dir))


def graph_edge_views(spark, sf_dir):
    return m.edge_views(found_edges(spark, sf_dir))


def graph_store(spark, sf_dir):
    """Views of a store that got the even documents, then the odd ones, then lost every document whose id is divisible by 7."""
    own = found(spark, sf_dir)
    store = m.EntityStore(spark, scratch(spark, "entity-store"))
    for k in (0, 1):
        store.put(own.where(F.col("doc_id") % 2 == k), k)
    store.put(own.where("false"), 2, own.where("doc_id % 7 = 0").select("doc_id").distinct())
    return store.views.read()


def graph_bounded_walk(spark, sf_dir):
    """Everything that edges lead to within three hops from a customer's parts, without a bound on seeds or nodes, so that no walk is cut. Queries are the customers whose id is divisible by 20."""
    own = seeds(spark, sf_dir).where("query_id % 20 = 0")
    return g.whole_walk(both_ways(spark, sf_dir), m.entities_of_chunks(m.members(found(spark, sf_dir)), own), 2).withColumn("cut", F.lit(False))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges region -> nation -> customer -> order."""
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    edge = lambda d, a, x_, b, y: d.select(F.concat(F.lit(a), x_).alias("from_id"), F.concat(F.lit(b), y).alias("to_id"))
    return edge(n, "R", "n_regionkey", "N", "n_nationkey").unionByName(edge(c, "N", "c_nationkey", "C", "c_custkey")).unionByName(edge(o, "C", "o_custkey", "O", "o_orderkey"))


HIERARCHY = "tree AS (SELECT 'R' || n_regionkey AS from_id, 'N' || n_nationkey AS to_id FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders)"


def graph_neighbourhood(spark, sf_dir):
    """Everything within three hops of the regions whose names begin with A."""
    seeds = table(spark, sf_dir, "region").where("r_name LIKE 'A%'").select(F.concat(F.lit("R"), "r_regionkey").alias("node"))
    return g.neighbourhood(hierarchy(spark, sf_dir), seeds, 3)


def graph_subgraph(spark, sf_dir):
    """Edges between the nodes within two hops."""
    seeds = table(spark, sf_dir, "region").where("r_name LIKE 'A%'").select(F.concat(F.lit("R"), "r_regionkey").alias("node"))
    return g.subgraph(hierarchy(spark, sf_dir), g.neighbourhood(hierarchy(spark, sf_dir), seeds, 2))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query = customer; seed chunks are its orders of urgent priority."""
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"))


def graph_seed_entities(spark, sf_dir):
    return m.entities_of_chunks(m.members(found(spark, sf_dir)), seeds(spark, sf_dir))


def both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from systems to parts, and back as untyped ones."""
    own = found_edges(spark, sf_dir).select("from_id", "to_id", "rel_type").distinct()
    return own.unionByName(own.where("rel_type <> 'RELATED_TO'").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit("RELATED_TO").alias("rel_type")))


def graph_expansion(spark, sf_dir):
    """A customer's five best (dearest) orders -> their parts -> parts that typed edges lead to within three hops -> their first orders, at the score of expanded chunks."""
    e, o = m.members(found(spark, sf_dir)), table(spark, sf_dir, "orders").where("o_custkey % 20 = 0")
    best = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("n")).where("n <= 5").drop("n")
    reached = g.walked_entities(both_ways(spark, sf_dir), m.entities_of_chunks(e, best), 2, first=20, among=e)  # twenty rows a query come from twenty entities at most
    return m.supporting_chunks(e, reached).withColumn("score", F.lit(0.05))


def graph_entity_detail(spark, sf_dir):
    """Edges into and out of an entity (systems call parts), with the texts (400 characters at most) of its first three chunks."""
    own = g.merge_entities(lines(spark, sf_dir).select(F.explode(F.array("part", "system")).alias("entity_id"), "chunk_id", "doc_id", "semantic_type", "tags_csv", "pos").withColumns({"name": F.col("entity_id"), "entity_type": F.col("semantic_type")}))
    texts_ = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("text"))
    return g.entity_detail(own, edges(spark, sf_dir), texts_)


def graph_delete_document(spark, sf_dir):
    """The graph without document 3."""
    own, left = m.without_document(m.members(found(spark, sf_dir)), m.edge_members(found_edges(spark, sf_dir)), F.lit(3).cast("long"))
    return m.counts(own).select(F.col("entity_id").alias("id"), F.col("chunk_count").alias("n")).unionByName(m.edge_views(left).select(F.col("rel_id").alias("id"), F.col("doc_count").alias("n")))


def graph_delete_entities(spark, sf_dir):
    """The edges without entities of fewer than 20 chunks."""
    e = m.counts(found(spark, sf_dir))
    return g.delete_entities(e, m.edge_views(found_edges(spark, sf_dir)), e.where("chunk_count < 20").select("entity_id"))[1].select("rel_id", "from_id", "to_id")


def entity_search(spark, sf_dir):
    """Tag patterns, type, and a pattern of the name or an alias (the type and the name), third page of ten, with the number of all hits."""
    own = m.entity_views(found(spark, sf_dir)).withColumn("aliases", F.array(F.concat_ws(" ", "entity_type", "name")))
    return g.entity_page(own, "1[0-9]*$", "N", ["^n?oo", " ", "x|of$"], 20, 10).select("entity_id", "tags_csv", "total")


def name_token_search(spark, sf_dir):
    """Parts by the tokens of their names; every twentieth part's name is a query. The five best of each query: by matching tokens, then id."""
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.array("p_name", "p_type").alias("names"))
    wanted = table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    return g.token_search(own, wanted, 5)


def graph_subgraph_nodes(spark, sf_dir):
    """Nodes within two hops with their labels, and how many edges of the subgraph leave them."""
    seeds = table(spark, sf_dir, "region").where("r_name LIKE 'A%'").select(F.concat(F.lit("R"), "r_regionkey").alias("node"))
    tree, near = hierarchy(spark, sf_dir), g.neighbourhood(hierarchy(spark, sf_dir), seeds, 2)
    label = F.when(F.col("node").startswith("R"), "region").when(F.col("node").startswith("N"), "nation").when(F.col("node").startswith("C"), "customer").otherwise("order")
    out = g.subgraph(tree, near).groupBy(F.col("from_id").alias("node")).agg(F.count(F.lit(1)).alias("edges"))
    return near.join(out, "node", "left").select("node", "depth", label.alias("label"), F.coalesce("edges", F.lit(0)).alias("edges"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower-case text, then the names, then the type, each in a projection of its own, so that none is made more than once a row."""
    t, low = F.col("text"), F.col("low")
    own = texts.marked(spark, sf_dir).select("doc_id", F.concat_ws(",", "source", "lang").alias("tags_csv"), "text", "chunk_type", x.lower_ascii(t).alias("low"))
    own = own.select(
        "doc_id", "tags_csv", "chunk_type", "low", F.length(t).alias("length"), x.system_names(t, low).alias("system_names"), x.markers_of(low, "business").alias("business_terms"),
        x.state_transitions(t).alias("state_transitions"), x.entity_names(t).alias("entity_names"), x.field_names(t).alias("field_names"),
    )
    kind = x.kind_of(F.col("chunk_type"), low, F.col("length"), F.size("field_names"), F.size("entity_names"))
    return own.select(F.col("doc_id").alias("chunk_id"), "doc_id", "tags_csv", kind.alias("semantic_type"), "system_names", "business_terms", "state_transitions", "entity_names", "field_names")


CLASSIFIED = f"""{texts.MARKED}, c AS (SELECT doc_id, {texts.TYPE_SQL} AS semantic_type, {texts.SYSTEMS_SQL} AS system_names, {texts.found_sql('business')} AS business_terms, {texts.TRANSITIONS_SQL} AS state_transitions,
  {texts.sql_matches(x.ENTITY, 10)} AS entity_names, {texts.sql_matches(x.FIELD, 15)} AS field_names FROM marked),
cand AS (SELECT doc_id, unnest(system_names) AS name, 'system' AS entity_type FROM c UNION ALL SELECT doc_id, unnest(business_terms), 'business_term' FROM c
  UNION ALL SELECT doc_id, unnest(flatten(list_transform(state_transitions, lambda t: string_split(t, ' -> ')))), 'state' FROM c
  UNION ALL SELECT doc_id, unnest(entity_names), CASE semantic_type WHEN 'business_rule' THEN 'rule' WHEN 'integration_flow' THEN 'process' WHEN 'entity_definition' THEN 'api_entity' ELSE 'generic' END FROM c
  UNION ALL SELECT doc_id, unnest(field_names), 'field' FROM c WHERE len(field_names) >= 3)"""


def text_entity_candidates(spark, sf_dir):
    return g.candidates(classified(spark, sf_dir)).groupBy("name", "entity_type").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("doc_id").alias("docs"))


def text_typed_relations(spark, sf_dir):
    return g.typed_relations(classified(spark, sf_dir)).groupBy("from_name", "to_name", "rel_type").agg(F.count(F.lit(1)).alias("chunks"))


def text_related(spark, sf_dir):
    own = classified(spark, sf_dir)
    return g.related_in_row(own.withColumn("names", F.concat("entity_names", "system_names"))).groupBy("from_name", "to_name").agg(F.count(F.lit(1)).alias("chunks"))


KINDS = ["api_contract", "business_rule", "event_definition", "error_handling", "data_mapping_candidate", "field_definition", "generic_context"]


def order_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks of every kind: parts are their entities, suppliers their systems, line numbers their fields, flags of lines their moves. An order has seven lines at most."""
    some = lambda prefix, column: F.array_sort(F.collect_set(F.concat(F.lit(prefix), column)))
    names = [some("P", "l_partkey").alias("entity_names"), some("S", "l_suppkey").alias("system_names"), some("line_", "l_linenumber").alias("field_names")]
    moves = F.array_sort(F.collect_set(F.concat("l_returnflag", F.lit(" -> "), "l_linestatus"))).alias("state_transitions")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("l_orderkey") % len(KINDS) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*names, moves).select(F.col("l_orderkey").alias("chunk_id"), F.col("l_orderkey").alias("doc_id"), kind.alias("semantic_type"), "entity_names", "system_names", "field_names", "state_transitions")


def order_typed_relations(spark, sf_dir):
    return g.typed_relations(order_chunks(spark, sf_dir)).select("doc_id", "from_name", "to_name", "rel_type")


def order_related(spark, sf_dir):
    """Names of an order that no typed relation of it links, in twos."""
    own = order_chunks(spark, sf_dir)
    return g.related_in_row(own.withColumn("names", F.concat("entity_names", "system_names"))).select("doc_id", "from_name", "to_name")


ORDER_CHUNKS = f"""c AS (SELECT l_orderkey AS doc_id, {KINDS}[l_orderkey % {len(KINDS)} + 1] AS semantic_type, list_sort(list(DISTINCT 'P' || l_partkey)) AS entity_names, list_sort(list(DISTINCT 'S' || l_suppkey)) AS system_names,
  list_sort(list(DISTINCT 'line_' || l_linenumber)) AS field_names, list_sort(list(DISTINCT l_returnflag || ' -> ' || l_linestatus)) AS state_transitions FROM lineitem GROUP BY l_orderkey)"""
#: Names in a row by twos, and each kind of chunk's relations.
RELATIONS = """t AS (SELECT doc_id, split_part(t, ' -> ', 1) AS a, split_part(t, ' -> ', 2) AS b, 'TRANSITIONS_TO' AS r FROM (SELECT doc_id, unnest(state_transitions) AS t FROM c)
  UNION ALL SELECT doc_id, system_names[i], system_names[i + 1], 'CALLS' FROM (SELECT *, unnest(range(1, len(system_names))) AS i FROM c WHERE semantic_type = 'api_contract')
  UNION ALL SELECT doc_id, entity_names[1], entity_names[2], 'GOVERNS' FROM c WHERE semantic_type = 'business_rule'
  UNION ALL SELECT doc_id, entity_names[1], unnest(entity_names[2:21]), 'TRIGGERS' FROM c WHERE semantic_type = 'event_definition'
  UNION ALL SELECT doc_id, n, CASE WHEN n = entity_names[1] THEN entity_names[2] ELSE entity_names[1] END, 'HANDLES_ERROR' FROM (SELECT *, unnest(entity_names) AS n FROM c WHERE semantic_type = 'error_handling' AND len(entity_names) >= 2)
  UNION ALL SELECT doc_id, entity_names[i], entity_names[i + 1], 'MAPS_TO' FROM (SELECT *, unnest(range(1, len(entity_names))) AS i FROM c WHERE semantic_type = 'data_mapping_candidate')
  UNION ALL SELECT doc_id, system_names[1], unnest(field_names[1:3]), 'DEFINED_BY' FROM c WHERE semantic_type = 'field_definition' AND len(entity_names) > 0 AND len(system_names) > 0),
typed AS (SELECT * FROM t WHERE a <> b AND a <> '' AND b <> '')"""
NAMED = "n AS (SELECT DISTINCT doc_id, unnest(list_concat(entity_names, system_names)) AS name FROM c), pairs AS (SELECT x.doc_id, x.name AS a, y.name AS b FROM n x JOIN n y ON x.doc_id = y.doc_id AND x.name < y.name EXCEPT SELECT doc_id, least(a, b), greatest(a, b) FROM typed)"
QUERIES = {f.__name__: f for f in (graph_entities, graph_edges, graph_cooccurrence, graph_without_shadowed, graph_stats, graph_top_entities, graph_incremental, graph_neighbourhood, graph_subgraph, graph_subgraph_nodes, graph_seed_entities, graph_expansion, graph_entity_detail, graph_delete_document, graph_delete_entities, entity_search, name_token_search, text_entity_candidates, text_typed_relations, text_related, order_typed_relations, order_related, graph_members, graph_entity_views, graph_edge_views, graph_store, graph_bounded_walk)}
SEEDS = "seeds AS (SELECT o_custkey AS query_id, o_orderkey AS chunk_id FROM orders WHERE o_orderpriority = '1-URGENT'), se AS (SELECT DISTINCT query_id, part AS entity_id FROM lines JOIN seeds USING (chunk_id))"
SQL = {
    "graph_entities": f"WITH {LINES} SELECT entity_id, entity_id AS name, entity_type, doc_ids, chunk_ids, semantic_types, tags_csv, CAST(len(chunk_ids) AS INTEGER) AS chunk_count FROM ents",
    "graph_edges": f"WITH {LINES} SELECT * FROM rels",
    "graph_cooccurrence": "WITH d AS (SELECT DISTINCT l_orderkey, 'P' || l_partkey AS p FROM lineitem) SELECT a.p AS from_name, b.p AS to_name, count(*) AS chunks FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.p < b.p GROUP BY ALL",
    "graph_without_shadowed": f"WITH {LINES} SELECT rel_id, from_id, to_id, rel_type FROM rels r WHERE rel_type <> 'RELATED_TO' OR NOT EXISTS (SELECT 1 FROM rels t WHERE t.rel_type <> 'RELATED_TO' AND t.from_id = r.from_id AND t.to_id = r.to_id)",
    "graph_stats": f"WITH {LINES} SELECT entity_type, count(*) AS n, CAST(sum(len(chunk_ids)) AS BIGINT) AS chunks FROM ents GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "graph_top_entities": f"WITH {LINES} SELECT entity_id, CAST(len(chunk_ids) AS INTEGER) AS chunk_count FROM ents ORDER BY 2 DESC, 1 LIMIT 5",
    "graph_incremental": f"WITH {LINES}, p AS (SELECT part, doc_id % 2 AS age, arg_min(semantic_type, (pos, semantic_type)) AS t, arg_max(tags_csv, (length(tags_csv), -pos, tags_csv)) AS tags FROM lines GROUP BY ALL) SELECT entity_id, entity_id AS name, (SELECT arg_min(t, age) FROM p WHERE p.part = entity_id) AS entity_type, doc_ids, chunk_ids, (SELECT arg_max(tags, age) FROM p WHERE p.part = entity_id) AS tags_csv, CAST(len(chunk_ids) AS INTEGER) AS chunk_count FROM ents",
    "graph_neighbourhood": f"WITH RECURSIVE {HIERARCHY}, walk AS (SELECT 'R' || r_regionkey AS node, 0 AS depth FROM region WHERE r_name LIKE 'A%' UNION SELECT to_id, depth + 1 FROM walk JOIN tree ON node = from_id WHERE depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node",
    "graph_subgraph": f"WITH RECURSIVE {HIERARCHY}, walk AS (SELECT 'R' || r_regionkey AS node, 0 AS depth FROM region WHERE r_name LIKE 'A%' UNION SELECT to_id, depth + 1 FROM walk JOIN tree ON node = from_id WHERE depth < 2) SELECT from_id, to_id FROM tree WHERE from_id IN (SELECT node FROM walk) AND to_id IN (SELECT node FROM walk)",
    "graph_seed_entities": f"WITH {LINES}, {SEEDS} SELECT * FROM se",
    "graph_expansion": f"""WITH {LINES}, b AS (SELECT o_custkey AS query_id, o_orderkey AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_custkey % 20 = 0) WHERE n <= 5),
        e0 AS (SELECT query_id, entity_id FROM (SELECT query_id, part AS entity_id, row_number() OVER (PARTITION BY query_id ORDER BY part) AS n FROM (SELECT DISTINCT query_id, part FROM lines JOIN b USING (chunk_id))) WHERE n <= 10),
        w AS (SELECT from_id, to_id, rel_type FROM rels UNION ALL SELECT to_id, from_id, 'RELATED_TO' FROM rels WHERE rel_type <> 'RELATED_TO'),
        h1 AS (SELECT DISTINCT query_id, to_id, rel_type FROM e0 JOIN w ON entity_id = from_id), f1 AS (SELECT DISTINCT query_id, to_id AS entity_id FROM h1 EXCEPT SELECT query_id, entity_id FROM e0),
        h2 AS (SELECT DISTINCT query_id, to_id, rel_type FROM f1 JOIN w ON entity_id = from_id), f2 AS (SELECT DISTINCT query_id, to_id AS entity_id FROM h2 EXCEPT SELECT * FROM e0 EXCEPT SELECT * FROM f1),
        h3 AS (SELECT DISTINCT query_id, to_id, rel_type FROM f2 JOIN w ON entity_id = from_id),
        r AS (SELECT DISTINCT query_id, to_id AS entity_id FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) WHERE rel_type <> 'RELATED_TO'),
        s AS (SELECT query_id, entity_id, unnest(chunk_ids[1:2]) AS chunk_id, generate_subscripts(chunk_ids[1:2], 1) AS pos FROM r JOIN ents USING (entity_id)), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY entity_id, pos) AS n FROM s)
        SELECT query_id, entity_id, chunk_id, CAST(0.05 AS DOUBLE) AS score FROM n WHERE n <= 20""",
    "graph_entity_detail": f"""WITH {LINES}, m AS (SELECT part AS id, chunk_id FROM lines UNION SELECT system, chunk_id FROM lines), f AS (SELECT id, chunk_id, row_number() OVER (PARTITION BY id ORDER BY chunk_id) AS pos FROM m),
        p AS (SELECT id, list(o_orderstatus || ' ' || o_orderpriority ORDER BY pos) AS previews FROM f JOIN orders ON chunk_id = o_orderkey WHERE pos <= 3 GROUP BY id),
        i AS (SELECT part AS id, list_sort(list(DISTINCT system || ' ' || rel_type)) AS incoming FROM lines GROUP BY part), o AS (SELECT system AS id, list_sort(list(DISTINCT part || ' ' || rel_type)) AS outgoing FROM lines GROUP BY system)
        SELECT id AS entity_id, incoming, outgoing, previews FROM (SELECT DISTINCT id FROM m) LEFT JOIN i USING (id) LEFT JOIN o USING (id) LEFT JOIN p USING (id)""",
    "graph_subgraph_nodes": f"""WITH RECURSIVE {HIERARCHY}, walk AS (SELECT 'R' || r_regionkey AS node, 0 AS depth FROM region WHERE r_name LIKE 'A%' UNION SELECT to_id, depth + 1 FROM walk JOIN tree ON node = from_id WHERE depth < 2),
        n AS (SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node), e AS (SELECT from_id AS node, count(*) AS edges FROM tree WHERE from_id IN (SELECT node FROM n) AND to_id IN (SELECT node FROM n) GROUP BY 1)
        SELECT node, depth, CASE left(node, 1) WHEN 'R' THEN 'region' WHEN 'N' THEN 'nation' WHEN 'C' THEN 'customer' ELSE 'order' END AS label, coalesce(edges, 0) AS edges FROM n LEFT JOIN e USING (node)""",
    "graph_delete_document": f"WITH {LINES}, e AS (SELECT part AS id, count(DISTINCT chunk_id) AS n FROM lines WHERE doc_id <> 3 GROUP BY 1), r AS (SELECT rel_id AS id, len(list_filter(doc_ids, lambda d: d <> 3)) AS n, from_id, to_id FROM rels) SELECT id, n FROM e UNION ALL SELECT id, n FROM r WHERE n > 0 AND from_id IN (SELECT id FROM e) AND to_id IN (SELECT id FROM e)",
    "graph_delete_entities": f"WITH {LINES} SELECT rel_id, from_id, to_id FROM rels WHERE to_id NOT IN (SELECT entity_id FROM ents WHERE len(chunk_ids) < 20)",
    "entity_search": f"WITH {LINES}, h AS (SELECT entity_id, tags_csv FROM ents WHERE entity_type = 'N' AND regexp_matches(lower(tags_csv), '^n?oo|x|of$') AND regexp_matches(entity_id, '1[0-9]*$')) SELECT entity_id, tags_csv, (SELECT count(*) FROM h) AS total FROM h ORDER BY entity_id LIMIT 10 OFFSET 20",
    "name_token_search": "WITH t AS (SELECT DISTINCT p_partkey AS entity_id, unnest(regexp_split_to_array(lower(p_name || ' ' || p_type), '\\s+')) AS token FROM part), q AS (SELECT DISTINCT p_partkey AS query_id, unnest(regexp_split_to_array(lower(p_name), '\\s+')) AS token FROM part WHERE p_partkey % 20 = 0), m AS (SELECT query_id, entity_id, count(*) AS matches FROM t JOIN q USING (token) WHERE token <> '' GROUP BY ALL) SELECT query_id, entity_id, matches, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, entity_id) AS INTEGER) AS rank FROM m) WHERE rank <= 5",
    "text_entity_candidates": f"WITH {CLASSIFIED} SELECT name, entity_type, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM cand WHERE name <> '' GROUP BY ALL",
    "text_typed_relations": f"WITH {CLASSIFIED}, {RELATIONS} SELECT a AS from_name, b AS to_name, r AS rel_type, count(*) AS chunks FROM typed GROUP BY ALL",
    "text_related": f"WITH {CLASSIFIED}, {RELATIONS}, {NAMED} SELECT a AS from_name, b AS to_name, count(*) AS chunks FROM pairs GROUP BY ALL",
    "order_typed_relations": f"WITH {ORDER_CHUNKS}, {RELATIONS} SELECT doc_id, a AS from_name, b AS to_name, r AS rel_type FROM typed",
    "order_related": f"WITH {ORDER_CHUNKS}, {RELATIONS}, {NAMED} SELECT doc_id, a AS from_name, b AS to_name FROM pairs",
    "graph_members": f"WITH {LINES} SELECT DISTINCT part AS entity_id, chunk_id, doc_id FROM lines",
    "graph_entity_views": f"WITH {LINES} SELECT entity_id, entity_id AS name, entity_type, tags_csv, semantic_types, len(chunk_ids) AS chunk_count, len(doc_ids) AS doc_count, chunk_ids[1:3] AS first_chunks FROM ents",
    "graph_edge_views": f"WITH {LINES} SELECT rel_id, from_id, to_id, rel_type, weight, len(evidence) AS chunk_count, len(doc_ids) AS doc_count FROM rels",
    "graph_store": f"WITH {LINES}, l AS (SELECT * FROM lines WHERE doc_id % 7 <> 0) SELECT part AS entity_id, part AS name, arg_min(semantic_type, (doc_id % 2, pos, semantic_type)) AS entity_type, arg_max(tags_csv, (doc_id % 2, length(tags_csv), -pos, tags_csv)) AS tags_csv, list_sort(list(DISTINCT semantic_type)) AS semantic_types, count(DISTINCT chunk_id) AS chunk_count, count(DISTINCT doc_id) AS doc_count, list_sort(list(DISTINCT chunk_id))[1:3] AS first_chunks FROM l GROUP BY part",
    "graph_bounded_walk": f"""WITH {LINES}, {SEEDS.replace("WHERE o_orderpriority = '1-URGENT'", "WHERE o_orderpriority = '1-URGENT' AND o_custkey % 20 = 0")},
        w AS (SELECT from_id, to_id, rel_type FROM rels UNION ALL SELECT to_id, from_id, 'RELATED_TO' FROM rels WHERE rel_type <> 'RELATED_TO'),
        h1 AS (SELECT DISTINCT query_id, to_id, rel_type FROM se JOIN w ON entity_id = from_id), f1 AS (SELECT DISTINCT query_id, to_id AS entity_id FROM h1 EXCEPT SELECT query_id, entity_id FROM se),
        h2 AS (SELECT DISTINCT query_id, to_id, rel_type FROM f1 JOIN w ON entity_id = from_id), f2 AS (SELECT DISTINCT query_id, to_id AS entity_id FROM h2 EXCEPT SELECT query_id, entity_id FROM se EXCEPT SELECT * FROM f1),
        h3 AS (SELECT DISTINCT query_id, to_id, rel_type FROM f2 JOIN w ON entity_id = from_id)
        SELECT DISTINCT query_id, to_id AS entity_id, false AS cut FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) WHERE rel_type <> 'RELATED_TO'""",
}
