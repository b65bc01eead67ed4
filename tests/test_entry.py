import os

import duckdb
import pytest

import __spark_entry__ as entry
from glyphspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(frame):
    for c in frame.columns:
        kind = frame[c].dtype
        if kind.kind == "f" and not (frame[c].dropna() % 1 == 0).all():
            frame[c] = frame[c].round(6)
        elif kind.kind in "iuf":
            frame[c] = frame[c].astype("Int64")
        elif "datetime" in str(kind):
            frame[c] = frame[c].astype("datetime64[us]").astype(str)
    names = sorted(frame.columns)
    return frame[names].astype(str).sort_values(names).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = shown(registry.QUERIES[name](spark, SF).toPandas()), shown(duck.sql(registry.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)
    assert len(got), "nothing is compared with nothing"


def test_explanation_equals_sql_at_ties(spark, tmp_path):
    texts = ["aaaabbccddefghij", "aaaaaaaabbccddef", "aaaaaaaabbbbccde", "a", "a" * 8, "ab" * 40_000, "é", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = shown(registry.QUERIES["explain_selection"](spark, str(tmp_path)).toPandas()), shown(connection.sql(registry.ORACLES["explain_selection"]).df())
    assert len(got) == len(texts) and got.equals(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got) and len(got.columns)


def test_entry(spark, duck):
    assert entry.entry(spark).count() == 20
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
