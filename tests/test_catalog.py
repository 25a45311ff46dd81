"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TWINS = entry.oracle_sql()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.fixture(scope="module")
def duck(root):
    con = duckdb.connect()
    import os

    for f in os.listdir(root):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{root}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, root, duck, name):
    df = entry.queries()[name](spark, root)
    got = df.collect()
    result = duck.execute(TWINS[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    rows = lambda data, at: sorted((tuple(cell(r[i]) for i in at) for r in data), key=repr)
    order = sorted(columns)
    assert rows(got, [df.columns.index(c) for c in order]) == rows(result.fetchall(), [columns.index(c) for c in order])


@pytest.mark.parametrize("name", ["unified_search", "hash_embeddings", "document_chunks", "related_news", "title_similarity_of_versions", "evidence_texts", "law_mentions", "effective_days_in_texts", "article_html_texts"])
def test_runs(spark, root, name):
    assert entry.queries()[name](spark, root).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
