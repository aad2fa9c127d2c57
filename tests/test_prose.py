from quarryline.operators import ingest, prose

DEEP = """Intro that belongs to nothing
# Document
## Mandatory requirements
### Section with children
some text
**FR-4.1 – Asset event**
first line
second line
```
# not a heading
```
FR-4.2 – Plain code
### Section without children
its own text
## Optional part
**Bold section**
FR-5.1 no text
"""


def parsed(spark, text):
    rows = prose.parse_prose(spark.createDataFrame([("f", text)], "file_name string, text string")).orderBy("pos").collect()
    return [(r.category, r.description, r.mandatory) for r in rows]


def test_deepest_level_opens_requirements(spark):
    assert parsed(spark, DEEP) == [
        ("FR-4.1 – Asset event", "first line second line # not a heading", False),
        ("FR-4.2 – Plain code", "FR-4.2 – Plain code", False),
        ("Section without children", "its own text", False),
        ("FR-5.1 no text", "FR-5.1 no text", False),
    ]


def test_nearest_section_says_whether_it_is_mandatory(spark):
    assert parsed(spark, "## Mandatory requirements\n### A\nx\n## Non-mandatory\n### B\n## Mandatory, alone\ny") == [("A", "x", True), ("B", "B", False), ("Mandatory, alone", "y", True)]
    assert parsed(spark, "## Only\ntext") == [("Only", "text", False)]


def test_paragraphs_without_headings(spark):
    assert parsed(spark, "one\ntwo\n\n\nthree\n") == [("General", "one two", False), ("General", "three", False)]
    assert parsed(spark, "") == [] and parsed(spark, "\n \n") == []


def test_specs_and_replies(spark):
    specs = spark.createDataFrame([("a", '{"swagger": "2.0", "paths": {"/p": {"get": {"operationId": "x"}, "post": {}}}, "definitions": {"D": {}}}'), ("b", "not json")], "source string, spec string")
    assert sorted((r.source, r.operation_id) for r in ingest.openapi_operations(specs).collect()) == [("a", "POST_/p"), ("a", "x")]
    assert [(r.source, r.name, r.properties) for r in ingest.openapi_schemas(specs).collect()] == [("a", "D", 0)]
    same = spark.createDataFrame([('{"b": 1, "a": {"d": 2, "c": 3}}',), ('{ "a": {"c":3,"d":2}, "b":1 }',), ("nope",)], "j string")
    assert [r.n for r in same.groupBy(ingest.canonical_hash(same.j).alias("h")).count().withColumnRenamed("count", "n").orderBy("n").collect()] == [1, 2]
