import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import html
from quarryline.operators import ingest as i


def test_claims_meet_sections_within_words(spark):
    sections = spark.createDataFrame([("p", 1, "All integrations, validated."), ("p", 2, "Nothing of it"), ("q", 1, "integration"), ("p", 3, None)], "pack_id string, section long, text string")
    claims = spark.createDataFrame([("p", 7, "Integration VALIDATED", "confirmed", [5, 6]), ("p", 8, "abcd it", "inferred", [1]), ("p", 9, "grations", "missing_evidence", [6, 9]), ("p", 10, None, "inferred", [3])], "pack_id string, claim long, statement string, confidence string, source_chunks array<long>")
    got = {(r.pack_id, r.section): (r.claims, r.confidence, r.first_claim, r.source_chunks, r.issues) for r in i.section_confidence(sections, claims).collect()}
    assert got == {
        ("p", 1): (2, 0.6, 7, [5, 6, 9], ["missing_evidence"]), ("p", 2): (0, 0.5, None, [], ["unverified"]), ("q", 1): (0, 0.5, None, [], ["unverified"]), ("p", 3): (0, 0.5, None, [], ["unverified"]),
    }
    assert i.section_confidence(sections.limit(0), claims).count() == 0 and i.section_confidence(sections, claims.limit(0)).count() == 4


def test_words_of_sections_and_claims_are_not_rows_of_a_shuffle(spark, capsys):
    sections = spark.range(3).selectExpr("'p' AS pack_id", "id AS section", "concat_ws(' ', transform(sequence(0, 999), i -> concat('word', i))) AS text")
    claims = spark.createDataFrame([("p", 7, "xword WORD99", "confirmed")], "pack_id string, claim long, statement string, confidence string")
    own = i.section_confidence(sections, claims)
    assert {(r.section, r.claims) for r in own.collect()} == {(0, 1), (1, 1), (2, 1)}
    own.explain("formatted")
    assert capsys.readouterr().out.count(") Generate") <= 2  # of source chunks alone: once in the tree and once in the details


def test_names_beside_other_letters_equal_the_sql(spark, tmp_path):
    import duckdb

    from quarryline.plans import texts

    parts = ["OrderMaster", "order_id", "Billing platform", "Pending", "->", "to", "→", "Done", "Kas SERVICE", "saP system", "Abc module"]
    rng, marks = random.Random(1), ["é", "É", "ß", "_", "1", " ", " ", "\v", "\u00a0", "\n", "\t", "-", "٣", "\u0301", ""]
    docs = [(i * 6 + 5, "".join(rng.choice(parts) + rng.choice(marks) for _ in range(12)), "s", "en") for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in texts.classify_names(spark, f"file://{tmp_path}").collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(texts.SQL["classify_names"])
    for row in want.fetchall():
        own = dict(zip(want.columns, row, strict=True))
        assert {c: own[c] for c in own} == got[own["doc_id"]].asDict(), docs[own["doc_id"] // 6][1]
    assert len(got) == 400


def test_letters_that_fold_to_ascii_equal_the_sql(spark, tmp_path):
    import duckdb

    from quarryline.plans import graphs

    parts = ["OrderMaster", "\u017fku", "Billing plat\u0130nvoice", "Wor\u212aflow \u017fy\u017ftem", "\u212aas SERVICE", "del\u0130very", "\u0130nvoice module", "order_id", "\u0131n component"]
    rng = random.Random(2)
    docs = [(i * 6 + 5, "".join(rng.choice(parts) + rng.choice([" ", "\u017f", "\u212a", "\u0130", "a", ""]) for _ in range(8)), "s", "en") for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in graphs.text_entity_candidates(spark, f"file://{tmp_path}").collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(graphs.SQL["text_entity_candidates"]).fetchall()) and any("\u017f" in r[0] for r in got)


def test_words_within_equal_brute_force(spark):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abc") for _ in range(n))
    words = [(p, make(rng.randrange(1, 14))) for p in "pq" for _ in range(150)] + [("p", make(3000))]
    wanted = [(p, make(rng.randrange(5, 8))) for p in "pq" for _ in range(60)]
    got = {tuple(r) for r in i.words_within(spark.createDataFrame(wanted, "pack_id string, wanted string").distinct(), spark.createDataFrame(words, "pack_id string, word string").distinct()).collect()}
    assert got == {(p, w, x) for p, w in wanted for q, x in words if p == q and w in x} and len(got) > 20


SPEC = """{"info": {"title": "T", "version": "", "description": "D"}, "servers": [{"url": "u"}, {}], "paths": {
  "/x/{id}/": {"parameters": [{"name": "id"}], "summary": "s", "GET": {"operationId": "", "summary": "S", "description": "S"}, "trace": {}, "post": {"operationId": "add", "parameters": [], "responses": {}}, "head": "no"},
  "/y": "no", "/z": {"put": {"description": "only", "parameters": [{"name": "a"}, "x", {"in": "q"}], "responses": {"200": {}, "default": {}}}}},
  "components": {"schemas": {}}, "definitions": {"A": {"properties": {"p": {}, "q": {}}, "required": ["q"]}, "B": {}, "C": 5}}"""


def test_operations_are_the_methods_of_paths(spark):
    specs = spark.createDataFrame([("s", SPEC), ("n", None), ("bad", "{"), ("e", "{}")], "source string, spec string")
    assert sorted(r.operation_id for r in i.openapi_operations(specs).collect()) == ["GET_/x/{id}/", "PUT_/z", "add"]
    got = {r.capability_id: (r.kind, r.text) for r in i.openapi_capabilities(specs).collect()}
    assert got == {
        "s__overview": ("overview", "API: T\nD\nServers: u, "),
        "s__endpoint__GET_x_{id}": ("endpoint", "GET /x/{id}/ — S"),
        "s__endpoint__add": ("endpoint", "POST /x/{id}/"),
        "s__endpoint__PUT_z": ("endpoint", "PUT /z\nonly\nParameters: a, ?\nResponse codes: 200, default"),
        "s__schema__A": ("schema", "Schema: A\nFields: p (optional), q (required)"),
        "s__schema__B": ("schema", "Schema: B"),
    }


@pytest.mark.parametrize("link", ["javascript:x", "java\tscript:alert(1)", "java&#9;script:alert(1)", " \x01javascript:x", "JaVa\nScRiPt:x", "data:text/html,x", "vbscript:x", "ftp://a/b", "file:///etc", " javascript:x"])
def test_links_of_other_schemes_go(link):
    out = html.sanitized_text(f'<a href="{link}">t</a>')
    assert out == "<a>t</a>"


@pytest.mark.parametrize("link", ["https://a/b?c=d:e", "http://a", "mailto:a@b", "/x:y", "x/y:z", "?q=a:b", "#a:b", "", "//host/x"])
def test_allowed_and_relative_links_stay(link):
    assert 'href="' in html.sanitized_text(f'<a href="{link}">t</a>')


def test_links_of_a_page(spark):
    page = '<a href=" /b ">x</a><a href="http://a.com:8080/x">y</a><a href="http://a.com:80/z">z</a><a href="\n/b#f">again</a>'
    assert html.page_links("http://a.com:80/", page) == ["http://a.com:80/b", "http://a.com:80/z"]
    assert html.page_links("http://a.com:80/", page, same_domain=False) == ["http://a.com:80/b", "http://a.com:80/z", "http://a.com:8080/x"]


def test_texts_are_lowered_and_searched_once(spark, sf_dir):
    from quarryline.plans import graphs

    plan = graphs.text_entity_candidates(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    assert plan.count("regexp_extract_all(") == 4  # systems, transitions, entities, fields
