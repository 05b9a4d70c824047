import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.registry.QUERIES, entry.registry.ORACLE


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_as_duckdb_has_them(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in columns) for r in rel.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_stands_without_the_llm_folder(monkeypatch):
    """With the subpackage hidden, queries() has the others alone."""

    class Hidden:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("loomgraph.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name)

    for m in [m for m in sys.modules if m.startswith("loomgraph.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(sys, "meta_path", [Hidden(), *sys.meta_path])
    importlib.invalidate_caches()
    assert entry.queries() == QUERIES and entry.oracle_sql() == SQL


def test_import_needs_no_session():
    import subprocess
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 60"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)
