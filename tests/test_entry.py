from __future__ import annotations

import importlib.util

import __spark_entry__
from vocalis.plans import catalog


def test_queries_without_the_corpus_part(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("vocalis.llm", "corpus_pipeline") else real(name, *a))
    assert __spark_entry__.queries() == catalog.QUERIES and __spark_entry__.oracle_sql() == catalog.ORACLES


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
