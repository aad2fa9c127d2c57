import random
import time

import pytest
from pyspark.sql import functions as F

from quarryline.operators import postings
from quarryline.operators import retrieval as r
from quarryline.sources.tables import latest_version, scratch

WORDS = [f"w{i}" for i in range(60)]


def rows(seed, n, sources=7):
    rng = random.Random(seed)
    weight = [1 / (i + 1) for i in range(60)]
    return [(i, f"s{rng.randrange(sources)}", " ".join(rng.choices(WORDS, weight, k=rng.choice([3, 8, 30, 90])))) for i in range(n)]


def chunks(spark, own):
    return spark.createDataFrame(own, "chunk_id long, source string, text string")


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=4))) for i in range(9)] + [(90, "nowhere at all"), (91, None), (92, "w59 w59 w58")], "query_id long, text string")


def scanned(spark, own, queries, k):
    return sorted(map(tuple, r.bm25_top(chunks(spark, own), queries, k).select("query_id", "chunk_id", "score", "rank").collect()))


def found(spark, root, queries, k):
    search = postings.Search(spark, root, queries, k)
    return sorted(map(tuple, search.top().select("query_id", "chunk_id", "score", "rank").collect())), search


def test_index_gives_the_lists_of_a_scan_and_skips_blocks(spark, queries, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    monkeypatch.setattr(postings, "ZONES", 4)
    own = rows(1, 900)
    root = scratch(spark, "postings")
    postings.write_index(chunks(spark, own), root)
    for k in (1, 5, 40):
        got, search = found(spark, root, queries, k)
        assert got == scanned(spark, own, queries, k)
        report = search.report().collect()
        assert all(x.read <= x.blocks for x in report)
        if k == 1:
            assert sum(x.read for x in report) < 0.7 * sum(x.blocks for x in report)


def test_replaced_sources(spark, queries, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    monkeypatch.setattr(postings, "ZONES", 4)
    own = rows(2, 300)
    root = scratch(spark, "postings")
    postings.write_index(chunks(spark, own), root)
    again = [i for i, s, _ in own if s == "s3"]
    new = [(again[i] if i < 9 else i + 1000, "s3", t) for i, _, t in rows(3, 60)] + [(2000, "new source", "w59 w58 w0"), (2001, None, "w59")]
    postings.replace_sources(chunks(spark, new), root)
    state = [x for x in own if x[1] != "s3"] + new
    assert found(spark, root, queries, 5)[0] == scanned(spark, state, queries, 5)
    # only the touched zones were written again
    touched = {x.z for x in spark.createDataFrame([("s3",), ("new source",), (None,)], "source string").select(postings.zone_of(F.col("source")).alias("z")).collect()}
    held = {x.zone: x.generation for x in postings.manifest(spark, root).collect()}
    assert {z for z, g in held.items() if g == 1} == touched and set(held.values()) <= {0, 1}
    # a source and the null source leave
    postings.replace_sources(chunks(spark, []), root, spark.createDataFrame([("s1",), (None,)], "source string"))
    state = [x for x in state if x[1] not in ("s1", None)]
    assert found(spark, root, queries, 5)[0] == scanned(spark, state, queries, 5)
    assert latest_version(spark, f"{root}/manifest") == 2
    postings.write_index(chunks(spark, own), root)
    assert found(spark, root, queries, 5)[0] == scanned(spark, own, queries, 5) and postings.removed_generations(spark, root) == [0, 1, 2]


def test_an_unfinished_generation_is_not_seen(spark, queries):
    own = rows(4, 80)
    root = scratch(spark, "postings")
    postings.write_index(chunks(spark, own), root)
    before = found(spark, root, queries, 3)[0]
    new = postings.with_blocks(postings.counted(chunks(spark, rows(5, 40))))
    postings.write_generation(postings.exploded(new), new, root, 1)  # ended before its manifest
    assert found(spark, root, queries, 3)[0] == before == scanned(spark, own, queries, 3)
    new = [(i + 500, s, t) for i, s, t in rows(6, 30, 3)]
    postings.replace_sources(chunks(spark, new), root)
    gone = {s for _, s, _ in new}
    assert found(spark, root, queries, 3)[0] == scanned(spark, [x for x in own if x[1] not in gone] + new, queries, 3)


def test_odd_rows(spark, queries):
    root = scratch(spark, "postings")
    postings.write_index(chunks(spark, []), root)
    assert found(spark, root, queries, 3)[0] == []
    own = [(1, None, "w1 w2"), (2, "a", None), (3, "a", ""), (4, "a", "w1 " * 5000), (5, "b", "w1 w2"), (6, "b", "w1 w2")]
    postings.write_index(chunks(spark, [*own, (None, "a", "w1")]).withColumn("zone", F.lit("x")).withColumn("block", F.lit("y")), root)
    assert found(spark, root, queries, 3)[0] == scanned(spark, own, queries, 3)


def test_entries_stay_out_of_the_scan_for_bounds(spark, queries):
    root = scratch(spark, "postings")
    postings.write_index(chunks(spark, rows(1, 50)), root)
    plan = postings.current(spark, root, "postings", postings.POSTINGS).select("term", "zone", "block", F.array_max("front.tf"))._jdf.queryExecution().executedPlan().toString()
    assert "entries" not in plan.split("ReadSchema")[1]


def test_words_are_counted_where_they_are(spark, capsys):
    own = [(k, "s", " ".join(f"w{(k * j) % 7}" for j in range(1, 5 + k % 3))) for k in range(40)] + [(3, "s", "w1 w1"), (3, "s", "w1 w2"), (50, "s", ""), (51, None, None)]
    dealt = postings.with_blocks(postings.counted(chunks(spark, own)))
    want = {}
    for r in dealt.collect():
        for w in r.w:
            cell = want.setdefault((w, r.zone, r.block), {})
            cell[r.chunk_id, r.dl] = cell.get((r.chunk_id, r.dl), 0) + 1
    made = postings.exploded(dealt)
    got = {(r.term, r.zone, r.block): r for r in made.collect()}
    assert {k: [tuple(e) for e in r.entries] for k, r in got.items()} == {k: sorted((c, tf, dl) for (c, dl), tf in v.items()) for k, v in want.items()}
    for r in got.values():
        assert [tuple(p) for p in r.front] == sorted({(e.tf, e.dl) for e in r.entries if not any((o.tf > e.tf and o.dl <= e.dl) or (o.tf >= e.tf and o.dl < e.dl) for o in r.entries)}, key=lambda p: -p[0])
    made.explain()
    assert "Generate" not in capsys.readouterr().out


def shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (held.apply(i).getName() for i in range(held.size())) if name.startswith("shuffle_")}


def test_an_index_leaves_no_shuffle_files(spark):
    before, root = shuffle_files(spark), scratch(spark, "postings")
    postings.write_index(chunks(spark, rows(1, 200)), root)
    for _ in range(40):  # they go soon after
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.5)
    assert not left


def test_only_postings_of_the_queries_terms_are_shuffled(spark, queries):
    root, own = scratch(spark, "postings"), rows(1, 200)
    postings.write_index(chunks(spark, own), root)
    got, search = found(spark, root, queries.where("query_id = 92"), 3)
    assert got == scanned(spark, own, queries.where("query_id = 92"), 3)
    assert {r.term for r in search.postings.select("term").collect()} == {"w58", "w59"}
    plan = search.postings._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
