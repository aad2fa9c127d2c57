import random

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as x
from quarryline.operators import catalog, chunking, graph, html


def of(spark, expression, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.v for r in rows.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_names_and_transitions(spark):
    assert of(spark, x.entity_names, "The ProductMaster and OrderId, Plain") == [["OrderId", "ProductMaster"]]
    assert of(spark, x.field_names, "order_id x_y_z Order_Id") == [["order_id", "x_y_z"]]
    assert of(spark, x.system_names, "the Billing system and Hub platform")[0][0] in ("Billing", "and Hub", "the Billing")
    assert of(spark, x.state_transitions, "Pending -> Confirmed, Confirmed to Shipped") == [["Pending -> Confirmed", "Confirmed -> Shipped"]]


def test_semantic_types(spark):
    rows = spark.createDataFrame([("It must be required by policy", "text"), ("error timeout", "text"), ("x" * 150, "text"), ("short", "text"), ("any", "figure"), ("any", "table"), ("validate the format and check the range", "text")], "t string, k string")
    got = [r.v for r in rows.select(x.semantic_type(F.col("t"), F.col("k")).alias("v")).collect()]
    assert got == ["business_rule", "error_handling", "system_overview", "generic_context", "diagram_or_visual", "data_mapping_candidate", "validation_rule"]


def test_log_levels_and_prefixes(spark):
    assert of(spark, x.log_level, "[LLM] hi", "[ERROR] no", "[llm] hi", "⛔ stop", "job completed", "[GUARD] x") == ["LLM", "ERROR", "INFO", "CANCEL", "SUCCESS", "WARN"]
    assert of(spark, x.without_log_prefix, "[STEP 2/5] go [LLM]", "[llm] x") == ["go [LLM]", "[llm] x"]


def test_guard_and_slugs(spark):
    assert of(spark, x.guard_state, "# Integration Design\nx", "Hi\n# Integration Design", "# My Integration  Design doc", "nothing", "  ", None) == ["exact", "preamble", "relaxed", "rejected", "empty", "empty"]
    assert of(spark, x.guarded, "Hi\n# Integration Design a")[0] == "# Integration Design a"
    assert of(spark, x.entity_id, "Élan Vital - X!") == ["ENT-elan_vital_x"]
    assert of(spark, x.csv_parts, " a, b ;;c") == [["a", "b", "c"]]
    assert of(spark, x.mandatory_heading, "## Mandatory Requirements", "## Non-mandatory", "## Other") == [True, False, False]
    assert of(spark, x.private_url, "http://10.1.2.3/x", "https://example.com", "ftp://a.b", "http://localhost:80", None, "http://172.20.0.1") == [True, False, True, True, True, True]


def test_fixed_chunks(spark, sf_dir):
    # stated pieces: the best break in the second half wins over a later one of another kind
    assert chunking.fixed_pieces("aaaa bbbb. cccc dddd", 16, 4) == [(0, 11, "aaaa bbbb."), (7, 20, "bb. cccc dddd"), (19, 20, "d")]
    assert chunking.fixed_pieces("one two three", 8, 2) == [(0, 8, "one two"), (6, 13, "o three"), (12, 13, "e")]
    assert chunking.fixed_pieces("\n a\n\n\n\nb ", 10, 0) == [(0, 4, "a\n\nb")]
    assert len(chunking.fixed_pieces("x" * 900)) == 2  # the tail is cut again
    assert all(len(p[2]) <= 100 for p in chunking.fixed_pieces("Word " * 100, 100, 20))
    assert chunking.fixed_pieces("") == [] == chunking.fixed_pieces(" \n ")
    # properties over whole documents: in order, covering, of bounded size, overlapping, and ended by a break where the text goes on
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts, found = {r.doc_id: chunking.normalised(r.text) for r in docs.collect()}, {}
    for r in chunking.fixed(docs).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts.items():
        own = found.get(doc_id, [])
        assert [r.chunk_index for r in own] == list(range(len(own))) and (own or not text)
        for r, after in zip(own, own[1:] + [None], strict=True):
            assert r.text == text[r.char_start : r.char_end].strip() and 0 < r.char_end - r.char_start <= chunking.SIZE
            if after and r.char_end < len(text):
                assert after.char_start == r.char_end - chunking.OVERLAP
                half = text[r.char_start + chunking.SIZE // 2 : r.char_start + chunking.SIZE]
                assert text[: r.char_end].endswith(chunking.BREAKS) or not any(b in half for b in chunking.BREAKS)
        assert not text or (own[0].char_start == 0 and max(r.char_end for r in own) == len(text))


def recursive(text, size, overlap=0):
    return [t for *_, t in chunking.recursive_pieces(text, size, overlap)]


def test_recursive_chunks_by_level():
    assert recursive("aaaa bbbb cccc", 10) == ["aaaa bbbb", "cccc"]
    assert recursive("aaaa bbbb cccc", 10, 5) == ["aaaa bbbb", "bbbb cccc"]
    # a word that no separator cuts stays whole and closes what stands before it; one of just the size is long too
    assert recursive("ab " + "x" * 12 + " cd", 10) == ["ab", "x" * 12, "cd"]
    assert recursive("ab " + "y" * 9 + " cd", 10) == ["ab", "y" * 9, "cd"]
    # short parts are merged with those of their own level alone
    assert recursive("a\n\nb\n\nccc " + "d" * 12 + "\n\ne", 10) == ["a\n\nb", "ccc", "d" * 12, "e"]
    assert recursive("## A\nab\n## B\nno blank\n## C", 12) == ["## A\nab", "## B", "no blank", "## C"]
    assert recursive("z" * 30, 10) == ["z" * 30] and recursive("", 10) == [] == recursive(" \n ", 10)
    two = "## A\n" + "a" * 300 + "\n## B\n" + "b" * 300
    assert [t[:4] for t in recursive(two, 400)] == ["## A", "## B"]


def test_recursive_chunks_cover_the_text(spark, sf_dir):
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice(["\n## ", "\n### ", "\n\n", "\n", ". ", " ", "word", "longerword", "x" * 30, "y" * 150]) for _ in range(rng.randrange(1, 200)))
        own = chunking.recursive_pieces(text, 120, 30)
        text = chunking.normalised(text)
        covered = set()
        for a, b, t in own:
            assert text[a:b].strip() == t and (len(t) <= 120 or " " not in t and "\n" not in t)
            covered.update(range(a, b))
        assert all(i in covered or text[i].isspace() for i in range(len(text)))
        assert all(x[0] < y[0] or x[1] <= y[0] for x, y in zip(own, own[1:], strict=False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(40)
    got = {}
    for r in chunking.recursive(docs.unionByName(docs.sparkSession.createDataFrame([(-1, None)], docs.schema))).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.char_start, r.char_end, r.text))
    assert got == {r.doc_id: own for r in docs.collect() if (own := chunking.recursive_pieces(r.text or ""))}


PAGE = '<html><nav><a href="/n">menu</a></nav><script>var x</script><h1>Title</h1><p>One <b>two</b></p><div class="cookie-banner"><p>no</p></div><ul><li>item</li></ul><a href="/a#f">l</a><a href="http://other.org/">o</a><a href="b.pdf">p</a><footer>end</footer></html>'


def test_html_helpers():
    # every level of heading is one, bullets have no mark, pieces of a text are joined without a blank
    assert html.clean_text(PAGE) == "## Title\nOnetwo\nitem"
    assert html.clean_text("<h3>T</h3><ul><li><p>a</p></li><li>b</li></ul><pre>x=1\ny=2</pre>") == "## T\na\na\nb\n```\nx=1\ny=2\n```"
    assert html.clean_text('<div id="my-modal">no</div><p class="crumb">yes</p><div class="ad-box"><p>no</p></div><p>a<br>b &amp; c</p><p>open') == "yes\nab & c\nopen"
    assert html.page_links("http://h.com/x/", PAGE) == ["http://h.com/a", "http://h.com/n"]
    assert "http://other.org/" in html.page_links("http://h.com/x/", PAGE, same_domain=False)
    assert html.sanitized_text('<p onclick="x">a<script>b</script><a href="javascript:1" title="t">c</a>') == '<p>ab<a title="t">c</a></p>'
    long = html.sanitized_text("<p>" + "x" * (html.MOST_CHARS - 8) + '<a href="http://h/">link</a>')
    assert long == "<p>" + "x" * (html.MOST_CHARS - 8) + "</p>"
    assert html.sanitized_text("<ul><li>a<li>b</ul></p>") == "<ul><li>a<li>b</li></li></ul>"
    assert html.page_links("http://h.com/", '<a href="a.json">1</a><a href="b.exe">2</a>') == ["http://h.com/b.exe"]
    assert html.clean_text(None) == "" and html.page_links(None, None) == []


def test_graph_merge_is_idempotent(spark):
    rows = [("e", "E", "rule", 1, 10, "a", "x", 1), ("e", "E2", "field", 2, 11, "b", "xyz", 2), ("f", "F", "rule", 1, 10, "a", "", 3)]
    found = spark.createDataFrame(rows, "entity_id string, name string, entity_type string, doc_id int, chunk_id int, semantic_type string, tags_csv string, pos int")
    own = graph.merge_entities(found)
    e = own.where("entity_id = 'e'").first()
    assert (e.name, e.entity_type, e.doc_ids, e.chunk_ids, e.tags_csv, e.chunk_count) == ("E", "rule", [1, 2], [10, 11], "xyz", 2)
    part = own.drop("semantic_types", "chunk_count")
    assert sorted(map(str, graph.merge_incremental(part, part).select("entity_id", "chunk_count").collect())) == sorted(map(str, own.select("entity_id", "chunk_count").collect()))
    edges = spark.createDataFrame([("a", "b", "CALLS", 1, 1), ("a", "b", "RELATED_TO", 2, 1), ("b", "a", "RELATED_TO", 2, 1), ("a", "a", "CALLS", 1, 1)], "from_id string, to_id string, rel_type string, chunk_id int, doc_id int")
    left = graph.without_shadowed(graph.merge_relations(edges)).collect()
    assert {(r.from_id, r.rel_type) for r in left} == {("a", "CALLS"), ("b", "RELATED_TO")} and all(r.rel_id.startswith("REL-") and len(r.rel_id) == 16 for r in left)


def test_requirement_files(spark):
    text = "source: ERP\n## Mandatory Requirements\n- R1 | Sync | one\n\n## Optional\n* R2 | Batch | two\nno bullet | x | y"
    got = catalog.parse_bullets(spark.createDataFrame([("a-to-shop.md", text)], "file_name string, text string")).orderBy("line_no").collect()
    assert [(r.req_id, r.source, r.target, r.category, r.description, r.mandatory) for r in got] == [("R1", "ERP", "shop", "Sync", "one", True), ("R2", "ERP", "shop", "Batch", "two", False)]


@pytest.mark.parametrize(("before", "after", "bad"), [("PENDING", "APPROVED", 0), ("PENDING", "REJECTED", 0), ("APPROVED", "PENDING", 1)])
def test_approval_steps(spark, before, after, bad):
    log = spark.createDataFrame([("d", 1, before), ("d", 2, after)], "entity string, pos int, status string")
    assert catalog.invalid_steps(log, catalog.APPROVAL_STEPS).count() == bad


def test_pieces_leave_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    class Docs:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(chunking, "BATCH_CHARS", 3000)
    texts = ["word " * 2000, None, "", "short", "x" * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, None, 5], pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    out = list(chunking.fixed(Docs())(iter([batch])))
    assert len(out) > 3 and max(sum(map(len, b.column(4).to_pylist())) for b in out) < 3000 + chunking.SIZE
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows == [(d, k, *p) for d, t in zip([1, 2, 3, None, 5], texts) for k, p in enumerate(chunking.fixed_pieces(t or ""))]
