"""Every registered query against its SQL, on the smallest data set."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from chromaframe.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
NO_SQL = {"corpus_palette", "dedupe_points", "embed_with", "identity_match_strict", "learn_identity", "page_palettes",
          "profile_upsert", "score_clusters", "tone_memory", "undo_redo"}
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def clean(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(clean(r[c]) for c in cols) for r in df.collect()]
    if name not in entry.oracle_sql():
        # Only these have no SQL; the corpus operators are compared in their own tests.
        assert name in NO_SQL or name.startswith("op") or name == "pipeline"
        assert rows
        return
    rel = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    types = dict(zip(names, (str(d[1]) for d in rel.description)))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    at = [names.index(c) for c in cols]
    assert ordered(rows) == ordered([tuple(clean(r[i]) for i in at) for r in rel.fetchall()])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
