"""The numbered queries and the pipeline run over the smallest tables and give a row per document, vector or piece."""

import os

import duckdb
import pytest

from framewright.llm import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_rows(spark, name):
    got = catalog.QUERIES[name](spark, SF_DIR)
    vectors = ("neighbours", "embedding", "clusters", "vector")
    source = "embeddings" if any(w in name for w in vectors) else "pages" if "warc" in name else "documents"
    n, rows = spark.read.parquet(f"{SF_DIR}/{source}.parquet").count(), got.count()
    if "packing" in name:
        assert rows >= n
    elif "neighbours" in name:
        assert rows == 20 * -(-n // 20)
    else:
        assert rows == n


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF_DIR), duck.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    kinds = dict(got.dtypes)
    assert {c: {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}[str(t)] for c, t in zip(want.columns, want.types)} == kinds
    rows = [sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).values.tolist())) for f in (got.toPandas(), want.df())]
    assert rows[0] == rows[1]


def test_the_tables_hold_no_encoded_keys(spark):
    assert catalog.op4_secret_scan(spark, SF_DIR).agg({"n_confirmed": "sum"}).first()[0] == 0
