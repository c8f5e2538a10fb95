import importlib.util

import duckdb
import pytest

import __spark_entry__
from sigweave.plans import bindings

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_training_data_operators(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("sigweave.llm", "corpus_pipeline") else find(name, *a))
    assert set(__spark_entry__.queries()) == set(bindings.queries()) and not any(n.startswith("op") for n in __spark_entry__.oracle_sql())


def test_without_what_the_training_data_operators_need(monkeypatch):
    import builtins
    import sys

    real = builtins.__import__

    def without(name, *a, **b):
        if name == "zstandard":
            raise ImportError("no zstandard")
        return real(name, *a, **b)

    for name in [m for m in sys.modules if m.startswith("sigweave.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    if importlib.util.find_spec("sigweave.llm"):
        with pytest.warns(UserWarning, match="no zstandard"):
            assert set(__spark_entry__.queries()) == set(bindings.queries())


def canonical(rows):
    return sorted(tuple("null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(bindings.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = bindings.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({bindings.oracle_sql()[name]})").fetchall()
    assert canonical(df.select(columns).collect()) == canonical(want)
