import ast
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["retrieval_bm25_topk", "fusion_rrf", "dense_top10", "metric_summary_bm25", "classify_semantic_type", "quality_scores", "graph_edges", "requirement_groups", "operation_diff", "section_evidence", "stream_audit_counts", "stream_ingest", "bundle_round_trip"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, want = e.queries()[name](spark, sf_dir), con.sql(e.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_training_data_subpackage():
    for path in (ROOT / "quarryline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "quarryline").parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), path


def test_entry_imports_without_the_subpackage(tmp_path):
    for name in ("quarryline", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "quarryline").mkdir()
    for p in (ROOT / "quarryline").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "quarryline" / p.name).symlink_to(p)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; print(len(e.queries()), [k for k in e.queries() if k.startswith('op1_')])"
    env = {**os.environ, "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", code.replace("import __spark_entry__ as e", "import importlib.util as u; s = u.spec_from_file_location('__spark_entry__', '__spark_entry__.py'); e = u.module_from_spec(s); s.loader.exec_module(e)")], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0 and out.stdout.strip().endswith("[]"), out.stderr
