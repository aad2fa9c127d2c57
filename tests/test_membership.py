import random

from pyspark.sql import functions as F

from quarryline.operators import graph as g
from quarryline.operators import membership as m
from quarryline.sources.tables import scratch

SCHEMA = "entity_id string, name string, entity_type string, doc_id long, chunk_id long, semantic_type string, tags_csv string, pos long"


def rows(seed, docs, entities=12):
    rng = random.Random(seed)
    out = []
    for d in docs:
        for k in range(rng.randrange(1, 6)):
            e = "hot" if rng.random() < 0.4 else f"e{rng.randrange(entities)}"
            out.append((e, f"{e}-{rng.randrange(3)}", rng.choice("ab"), d, d * 10 + rng.randrange(3), rng.choice("xyz"), "t" * rng.randrange(1, 4), d * 100 + k))
    return out


def frame(spark, own):
    return spark.createDataFrame(own, SCHEMA)


def views(df):
    return {r.entity_id: (r.name, r.entity_type, r.tags_csv, r.semantic_types, r.chunk_count, r.doc_count, r.first_chunks) for r in df.collect()}


def plain_views(batches):
    """batches: {doc_id: (batch, rows)}"""
    out = {}
    for e in {r[0] for _, own in batches.values() for r in own}:
        mine = [(b, r) for b, own in batches.values() for r in own if r[0] == e]
        first = min(mine, key=lambda x: (x[0], x[1][7], x[1][1], x[1][2]))[1]
        tags = max(mine, key=lambda x: (x[0], len(x[1][6]), -x[1][7], x[1][6]))[1][6]
        chunks = sorted({r[4] for _, r in mine})
        out[e] = (first[1], first[2], tags, sorted({r[5] for _, r in mine}), len(chunks), len({r[3] for _, r in mine}), chunks[:3])
    return out


def by_document(own, batch):
    return {d: (batch, [r for r in own if r[3] == d]) for d in {r[3] for r in own}}


def test_views_equal_a_plain_reading(spark):
    own = rows(1, range(40)) + rows(1, range(40))
    assert views(m.entity_views(frame(spark, own))) == plain_views(by_document(own, 0))
    assert m.members(frame(spark, own)).count() == len({(r[0], r[4], r[3]) for r in own})


def test_store_follows_documents(spark, tmp_path):
    store = m.EntityStore(spark, scratch(spark, "entities"))
    state = {}
    first = rows(2, range(30))
    store.put(frame(spark, first), 0)
    state |= by_document(first, 0)
    assert views(store.views.read()) == plain_views(state)
    second = rows(3, range(25, 40))
    store.put(frame(spark, second), 1, spark.createDataFrame([(1,), (2,), (77,)], "doc_id long"))
    state = {d: x for d, x in state.items() if d not in (1, 2)} | by_document(second, 1)
    assert views(store.views.read()) == plain_views(state)
    # tried again with the same number, and an entity that only a deleted document named
    store.put(frame(spark, second), 1, spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert views(store.views.read()) == plain_views(state)
    lone = [("lone", "Lone", "a", 99, 990, "x", "t", 1)]
    store.put(frame(spark, lone), 2)
    assert "lone" in views(store.views.read())
    store.put(frame(spark, []), 3, spark.createDataFrame([(99,)], "doc_id long"))
    assert views(store.views.read()) == plain_views(state)
    # only touched entities were written
    assert store.views.files(("delta", 2, list(range(32))), None).count() == 1
    assert {(r.entity_id, r.chunk_id, r.doc_id) for r in store.members().collect()} == {(r[0], r[4], r[3]) for _, own in state.values() for r in own}


def test_views_at_once_equal_the_others_with_one_shuffle(spark):
    own = rows(4, range(40)) + rows(4, range(40)) + [("hot", "hot-0", "a", 1, None, "x", "t", 5), ("e1", "e1-0", "b", None, 17, "y", None, 9), ("e1", "e1-0", "b", 99, 17, "y", "tt", 9)]  # a chunk of two documents, and nulls
    found = frame(spark, own)
    got = m.entity_views_at_once(found)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert views(got) == views(m.entity_views(found)) and got.dtypes == m.entity_views(found).dtypes
    assert plan.count("Exchange") == 1 and "collect_set(chunk_id" not in plan and "collect_set(doc_id" not in plan


def test_store_with_hot_entities(spark, monkeypatch):
    monkeypatch.setattr(m, "HOT_ROWS", 8)
    store = m.EntityStore(spark, scratch(spark, "entities"))
    state, batches = {}, [(rows(6, range(30)), []), (rows(7, range(25, 32)), [3, 4]), ([], list(range(20)))]
    for k, (own, gone) in enumerate(batches):
        store.put(frame(spark, own), k, spark.createDataFrame([(d,) for d in gone], "doc_id long") if gone else None)
        state = {d: x for d, x in state.items() if d not in gone} | by_document(own, k)
        assert views(store.views.read()) == plain_views(state)
    assert len(state) > 5


def test_chunks_of_entities_and_deletion(spark):
    own = rows(5, range(30))
    long = m.members(frame(spark, own))
    chosen = spark.createDataFrame([(q, e) for q in range(3) for e in ("hot", f"e{q}", "none")], "query_id long, entity_id string")
    got = sorted(map(tuple, m.supporting_chunks(long, chosen, 2, 3).collect()))
    want = []
    for q in range(3):
        each = [(q, e, c) for e in sorted(("hot", f"e{q}")) for c in sorted({r[4] for r in own if r[0] == e})[:2]]
        want += each[:3]
    assert got == sorted(want)
    found = spark.createDataFrame([("a", "b", "CALLS", 10, 1), ("a", "b", "CALLS", 10, 1), ("a", "b", "CALLS", 20, 2), ("b", "c", "RELATED_TO", 10, 1), ("a", "a", "CALLS", 10, 1)], "from_id string, to_id string, rel_type string, chunk_id long, doc_id long")
    assert sorted((r.from_id, r.to_id, r.weight, r.chunk_count, r.doc_count) for r in m.edge_views(found).collect()) == [("a", "b", 1.0, 2, 2), ("b", "c", 0.4, 1, 1)]
    ents = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("b", 20, 2), ("c", 10, 1)], "entity_id string, chunk_id long, doc_id long")
    left, edges = m.without_document(ents, m.edge_members(found), F.lit(1))
    assert {r.entity_id for r in left.collect()} == {"a", "b"} and [(r.from_id, r.to_id, r.doc_id) for r in edges.collect()] == [("a", "b", 2)]


def test_an_entity_with_most_rows_is_no_hot_task(spark):
    own = spark.range(200_000).select(F.when(F.col("id") >= 0, "hot").alias("entity_id"), F.lit("Hot").alias("name"), F.lit("a").alias("entity_type"), (F.col("id") % 5000).alias("doc_id"), F.col("id").alias("chunk_id"), F.lit("x").alias("semantic_type"), F.lit("t").alias("tags_csv"), F.col("id").alias("pos"))
    view = m.entity_views(own)
    assert views(view) == {"hot": ("Hot", "a", "t", ["x"], 200_000, 5000, [0, 1, 2])}
    plan = view._jdf.queryExecution().executedPlan().toString()
    # row numbers are cut in each task before the shuffle, and no aggregate collects chunks but of the cut ones
    assert "WindowGroupLimit" in plan and "collect_set(chunk_id" not in plan and "collect_set(doc_id" not in plan


# walks


def test_walk_through_a_hub(spark):
    edges = spark.createDataFrame([("s", "hub", "CALLS"), ("hub", "x", "RELATED_TO"), ("x", "y", "CALLS"), *[("hub", f"n{i:04d}", "CALLS") for i in range(300)], *[(f"n{i:04d}", f"m{i:04d}", "CALLS") for i in range(300)]], "from_id string, to_id string, rel_type string")
    chosen = spark.createDataFrame([(1, "s"), (2, "n0000"), (2, "n0007")], "query_id long, entity_id string")
    got = {(r.query_id, r.entity_id) for r in g.walked_entities(edges, chosen, 2).collect()}
    assert got == {(1, "hub"), *[(1, f"n{i:04d}") for i in range(300)], (1, "y"), *[(1, f"m{i:04d}") for i in range(300)], (2, "m0000"), (2, "m0007")}
    few = g.bounded_walk(edges, chosen, 2, frontier_most=50)
    rows_ = few.collect()
    assert {(r.query_id, r.entity_id) for r in rows_ if r.query_id == 2} == {(2, "m0000"), (2, "m0007")} and not any(r.cut for r in rows_ if r.query_id == 2)
    mine = [r for r in rows_ if r.query_id == 1]
    assert {r.entity_id for r in mine} == {"hub", *[f"n{i:04d}" for i in range(50)], *[f"m{i:04d}" for i in range(50)]} and all(r.cut for r in mine)
    whole = g.bounded_walk(edges, chosen, 2, frontier_most=10_000)
    assert {(r.query_id, r.entity_id) for r in whole.collect()} == got and not any(r.cut for r in whole.collect())


def test_walks_with_few_results_and_without_broadcasts(spark):
    rng = random.Random(5)
    edges = spark.createDataFrame([(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}", rng.choice(["CALLS", "RELATED_TO", "RELATED_TO"])) for _ in range(150)], "from_id string, to_id string, rel_type string")
    chosen = spark.createDataFrame([(q, f"n{rng.randrange(60):02d}") for q in range(8) for _ in range(2)], "query_id long, entity_id string").distinct()
    all_, among = {}, spark.createDataFrame([(f"n{i:02d}",) for i in range(0, 60, 2)], "entity_id string")
    for r in g.walked_entities(edges, chosen, 2).collect():
        if int(r.entity_id[1:]) % 2 == 0:
            all_.setdefault(r.query_id, []).append(r.entity_id)
    got = {(r.query_id, r.entity_id) for r in g.walked_entities(edges, chosen, 2, first=3, among=among).collect()}
    assert got == {(q, e) for q, own in all_.items() for e in sorted(own)[:3]} and got
    walked, bounded = g.walked_entities(edges, chosen, 2), g.bounded_walk(edges, chosen, 2, frontier_most=1000)
    assert {tuple(r) for r in walked.collect()} == {(r.query_id, r.entity_id) for r in bounded.collect()}
    assert "Broadcast" not in bounded._jdf.queryExecution().sparkPlan().toString()


def test_a_walk_without_bounds_reaches_everything(spark, sf_dir, monkeypatch):
    from quarryline.plans import graphs

    monkeypatch.setattr(g, "NODES_AT_ONCE", 50)
    monkeypatch.setattr(g, "ENDS_AT_ONCE", 300)
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("lineitem", "orders"))
    ways, parts, want = {}, {}, set()
    for r in lines:
        part, system, typed = f"P{r.l_partkey}", f"S{r.l_suppkey}", r.l_returnflag in "RA"
        ways.setdefault(system, set()).add((part, typed))
        parts.setdefault(r.l_orderkey, set()).add(part)
        if typed:
            ways.setdefault(part, set()).add((system, False))
    chosen = {}
    for r in orders:
        if r.o_custkey % 20 == 0 and r.o_orderpriority == "1-URGENT":
            chosen.setdefault(r.o_custkey, set()).update(parts.get(r.o_orderkey, ()))
    for q, own in chosen.items():
        seen, frontier = set(own), own
        for _ in range(3):
            steps = {w for n in frontier for w in ways.get(n, ())}
            want |= {(q, n, False) for n, typed in steps if typed}
            frontier = {n for n, _ in steps} - seen
            seen |= frontier
    got = list(map(tuple, graphs.graph_bounded_walk(spark, sf_dir).select("query_id", "entity_id", "cut").collect()))
    assert len(got) == len(set(got)) and set(got) == want
    assert max(map(len, chosen.values())) > 10 and len(got) > 40 * 3 * len(chosen) / 2
    edges = spark.createDataFrame([("a", "b", "RELATED_TO"), ("b", "c", "RELATED_TO"), ("c", "a", "CALLS"), ("c", "d", "CALLS"), ("d", "e", "CALLS")], "from_id string, to_id string, rel_type string")
    one = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "d"), ("z", "none")], "query_id string, entity_id string")
    assert sorted(map(tuple, g.whole_walk(edges, one).collect())) == [("x", "a"), ("x", "d"), ("y", "e")]
    assert g.whole_walk(edges.limit(0), one).count() == 0 == g.whole_walk(edges, one.limit(0)).count()


def test_related_in_a_row_equals_the_join(spark):
    rng, kinds = random.Random(3), ["api_contract", "business_rule", "event_definition", "error_handling", "data_mapping_candidate", "field_definition", None]
    some = lambda: None if rng.random() < 0.1 else [rng.choice("abcde") for _ in range(rng.randrange(5))]
    own = spark.createDataFrame([(i, i, kinds[i % 7], some(), some(), ["x_y"], ["a -> b", "c -> c"][: i % 3]) for i in range(70)], "chunk_id long, doc_id long, semantic_type string, entity_names array<string>, system_names array<string>, field_names array<string>, state_transitions array<string>")
    own = own.withColumn("names", F.concat("entity_names", "system_names"))
    got = g.related_in_row(own)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, g.related(own, g.typed_relations(own)).collect())) != []
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_name_in_two_rows_counts_once(spark):
    entities = spark.createDataFrame([(1, ["red bolt", "x"]), (1, ["red bolt"]), (2, ["red nut bolt"]), (3, [""]), (4, ["red bolt x"]), (5, None)], "entity_id long, names array<string>")
    queries = spark.createDataFrame([(7, "Red bolt nut"), (8, "bolt red nut nut"), (9, " "), (10, None)], "query_id long, text string")
    got = sorted(tuple(r) for r in g.token_search(entities, queries, 2).collect())
    assert got == [(q, *r) for q in (7, 8) for r in ((1, 2, 2), (2, 3, 1))]


def test_a_hub_of_a_million_edges_is_split(spark):
    edges = spark.range(1_000_000).select(F.lit("hub").alias("from_id"), F.format_string("n%07d", "id").alias("to_id"), F.lit("CALLS").alias("rel_type"))
    chosen = spark.createDataFrame([(1, "hub")], "query_id long, entity_id string")
    salted = g.salted_edges(edges, 16)
    sizes = [r["count"] for r in salted.groupBy("from_id", "part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.1 * 1_000_000 / 16
    assert g.bounded_walk(edges, chosen, 0, frontier_most=1000).count() == 1000
