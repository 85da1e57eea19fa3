"""The entry points need no jar, no JVM and none of the optional parts."""

import glob

import __spark_entry__ as E
from batchwise import queries as Q
from batchwise.functions.stopwords import stopword_set


def test_oracle_sql_builds_without_a_jar(monkeypatch):
    monkeypatch.setattr(glob, "glob", lambda *a, **b: [])
    assert set(Q.oracle_sql()) <= set(Q.QUERIES)
    assert {"the", "is", "!", "7"} <= set(stopword_set())


def test_works_without_the_optional_parts(monkeypatch):
    monkeypatch.setattr(E, "LLM", None)
    monkeypatch.setattr(E, "PIPELINE", None)
    assert set(E.queries()) == set(Q.QUERIES)
    assert set(E.oracle_sql()) == set(Q.oracle_sql())


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
