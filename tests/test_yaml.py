"""Specifications in YAML: stated values, the same values as a YAML library has, and what is rejected."""

import json
import random

import pytest

from quarryline.operators import ingest
from quarryline.operators import yaml_specs
from quarryline.operators.yaml_specs import json_of, specs_as_json

SPEC = """\
# a comment
openapi: 3.0.0
info:
    title: T  # the title
    description: |
      one
        two

      three
paths:
    /a/{id}:
        parameters: [{name: x}]
        get:
            operationId: "find\\u0041"
            description: >-
                folded
                text

                par
            responses:
                200: {description: 'it''s', "content": {}}
                default:
                    description: plain text
                        that goes on
        post: {tags: [a b, http://c:80/d#e,
               -1]}
"""
VALUE = {
    "openapi": "3.0.0",
    "info": {"title": "T", "description": "one\n  two\n\nthree\n"},
    "paths": {
        "/a/{id}": {
            "parameters": [{"name": "x"}],
            "get": {"operationId": "findA", "description": "folded text\npar", "responses": {"200": {"description": "it's", "content": {}}, "default": {"description": "plain text that goes on"}}},
            "post": {"tags": ["a b", "http://c:80/d#e", -1]},
        }
    },
}
REJECTED = ["a: &x 1", "a: *x", "a: !t 1", "<<: {a: 1}", "{<<: {a: 1}}", "? a\n: b", "%YAML 1.1\n---\na: 1", "a: 1\n---\nb: 2", "a: b: c", "a: [1", "a: 'x", 'a: "x\\qy"', "a:\n\t- 1", "a: 1\n b: 2", "a:\n  b: 1\n c: 2", "a: {b: 1}\n  c: 2", "a: - b", "a: @x", "- 1", "x", "", " ", "a: " + "[" * 5000, "a:\n" + "".join(" " * k + "b:\n" for k in range(1, 300))]


def test_a_specification():
    assert json.loads(json_of(SPEC)) == VALUE
    assert json_of(SPEC.replace("\n", "\r\n")) == json_of("\ufeff---\n" + SPEC + "...\n") == json_of(SPEC)


@pytest.mark.parametrize("text", REJECTED)
def test_rejected(text):
    assert json_of(text) is None


def test_words_of_one_meaning():
    assert json.loads(json_of("[]: 1") or "null") is None
    got = json.loads(json_of("a: yes\nb: Off\nc: nO\nd: ~\ne:\nf: 0x1F\ng: 017\nh: 08\ni: 1_000\nj: 1.5e+3\nk: 1e3\nl: .5\nm: '1'\nn: .inf\no: 2020-01-01\non: 1\n1.5: 2"))
    assert got == {"a": True, "b": False, "c": "nO", "d": None, "e": None, "f": 31, "g": 15, "h": "08", "i": 1000, "j": 1500.0, "k": "1e3", "l": 0.5, "m": "1", "n": ".inf", "o": "2020-01-01", "true": 1, "1.5": 2}


SCALARS = ["x", "a b", "yes", "1", "1.0", "", "~", "é ü", "a: b", "a #c", "- x", "line\nline2\n", "l\n\n  m\nn", " lead", "trail ", "'q'", '"d"', "#c", "[x", "x,y", "*a", "&a", "!t", "|", "a\tb", "\x07", "long " * 40, "http://a/b", "null", "?", "-", "a:", "\n", "\n\n", "x\n "]
STYLES = [{}, {"default_flow_style": True}, {"default_flow_style": None}, {"default_style": '"'}, {"default_style": "|"}, {"indent": 4, "allow_unicode": True}, {"width": 15, "default_flow_style": True}, {"default_style": ">", "width": 30}]


def some(r: random.Random, depth: int):
    kind = r.random()
    if depth == 0 or kind < 0.5:
        return r.choice([r.choice(SCALARS), r.randint(-(10**9), 10**9), r.random(), None, True, False])
    if kind < 0.75:
        return [some(r, depth - 1) for _ in range(r.randint(0, 4))]
    return {r.choice(["a", "b c", "/x/{id}", "200", "yes", "é", "x: y", "#h", "$ref", "- a", ""]) + str(k): some(r, depth - 1) for k in range(r.randint(0, 4))}


def test_what_a_library_writes():
    yaml = pytest.importorskip("yaml")
    dumper = type("Plain", (yaml.SafeDumper,), {"ignore_aliases": lambda self, data: True})
    for seed in range(600):
        r = random.Random(seed)
        value = {"r": some(r, 4)}
        text = yaml.dump(value, Dumper=dumper, **r.choice(STYLES))
        if "!!" not in text:  # tags are rejected
            assert json.loads(json_of(text)) == value, text


def test_specs_of_both_kinds(spark):
    rows = [("y", SPEC, 1), ("j", json.dumps(VALUE), 2), ("y", SPEC, 1), ("n", None, 3), ("e", "", 4), ("b", "a: [", 5), ("long", "paths:\n" + "".join(f"  /p{k}:\n    get: {{}}\n" for k in range(20000)), 6)]
    own = specs_as_json(spark.createDataFrame(rows, "source string, spec string, column int")).cache()
    assert own.columns == ["source", "spec", "column"] and own.count() == 7
    hashes = {r.source: r.h for r in own.select("source", ingest.canonical_hash(own.spec).alias("h")).collect()}
    assert hashes["y"] == hashes["j"] is not None and hashes["n"] is hashes["e"] is hashes["b"] is None
    found = [(r.source, r.operation_id) for r in ingest.openapi_operations(own.where("source <> 'long'")).collect()]
    assert sorted(found) == sorted([(s, o) for s in "yyj" for o in ("findA", "POST_/a/{id}")])
    assert ingest.openapi_operations(own.where("source = 'long'")).count() == 20000
    assert specs_as_json(own.where("false")).count() == 0


@pytest.mark.parametrize("name", ["yaml_capabilities", "openapi_capabilities"])
def test_specs_are_made_and_parsed_once(spark, sf_dir, name):
    from quarryline.plans import catalogs

    plan = catalogs.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "collect_list" not in plan


LINES = ["a: 1", "c: >-", "d: |", "x: {a: b}", "- a", "-", "- n: 1", "- - z", "b:", "# c", "", "  ", "---", "...", "q: 'it''s'", "q: 'open", "t: a: b", "u: *x", "yes: no", "w: http://a", "w: a # c", "text", "s: >2", "m: [1,", "  ]", "? a", "- |", "<<: 1", "- *x", "a: ]", "b: # c", "- # c"]


def read(reader, text):
    try:
        return json.dumps(reader(text))
    except (ValueError, KeyError, OverflowError):
        return None


def test_reading_by_lines_equals_the_parser():
    same = 0
    for seed in range(20000):
        r, depth, lines = random.Random(seed), 0, []
        for _ in range(r.randint(1, 7)):
            depth = max(0, depth + r.choice([0, 0, 2, 1, -2, -2, 4]))
            lines.append(" " * depth + r.choice(LINES))
        text = "\n".join(lines) + r.choice(["", "\n", "\n\n"])
        try:
            found = read(yaml_specs.quick, text)
        except yaml_specs.Unusual:
            continue
        assert found == read(lambda t: yaml_specs.Yaml(t).document(), text), text
        same += found is not None
    assert same > 500


def test_made_specifications_are_read_by_lines_and_made_once(spark, sf_dir, monkeypatch):
    from quarryline.plans import catalogs

    texts = [r.spec for r in catalogs.made_yaml(spark, sf_dir).limit(20).collect()]
    want = [json_of(t) for t in texts]
    for text in texts:
        yaml_specs.known_pair.cache_clear()
        whole = []
        monkeypatch.setattr(yaml_specs.Yaml, "__init__", lambda self, t, made=yaml_specs.Yaml.__init__: (whole.append(t), made(self, t))[1])
        assert json.dumps(yaml_specs.document(text), ensure_ascii=False) in want and text not in whole
        monkeypatch.undo()
    plan = catalogs.yaml_spec_hashes(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
