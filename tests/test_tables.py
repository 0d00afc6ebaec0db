"""Tables, the shared folder, and the entry without its optional operators."""

import importlib
from types import SimpleNamespace

import pytest

import __spark_entry__ as entry
from tracklake.plans import catalog
from tracklake.sources.tables import read_table, shared_dir


def session(master, folder=None):
    conf = {"spark.checkpoint.dir": folder} if folder else {}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))


def test_shared_folder():
    """The named folder; without one only a local session gets a folder of its own, and keeps it."""
    assert shared_dir(session("spark://host:7077", "hdfs://x/shared/")) == "hdfs://x/shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    one = session("local[4]")
    assert shared_dir(one) == shared_dir(one)


def test_few_files_are_dealt_out(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "many.parquet"))
    plan = lambda df: df._jdf.queryExecution().toString()
    one, many = (read_table(spark, str(tmp_path), n) for n in ("one", "many"))
    assert "Repartition" in plan(one) and "Repartition" not in plan(many) and one.count() == many.count() == 100


def test_entry_without_optional_operators(monkeypatch):
    """Any import that fails, of the operators or of what they need, leaves the other queries."""
    load = importlib.import_module

    def without(name, *args):
        if name in ("tracklake.llm.queries", "corpus_pipeline"):
            raise ImportError("no ahocorasick")
        return load(name, *args)

    monkeypatch.setattr(importlib, "import_module", without)
    assert entry.queries().keys() == catalog.QUERIES.keys() and entry.oracle_sql().keys() == catalog.ORACLE_SQL.keys()
