"""Every query with SQL gives the same rows as the SQL, at the smallest scale."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from millrace import catalog, catalog_flows, catalog_prompts, catalog_state  # noqa: F401

from .conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_like_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = con.sql(catalog.ORACLE[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(5).count() > 0


def test_entry_without_the_training_operators():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_full_reports_of_all_documents(spark, tmp_path):
    """Long texts too, against every item."""
    items = [(3 * i, f"item{i} " * 50) for i in range(50)]
    docs = [(i, f"item{i % 50} " * (50 if i % 2 else 600)) for i in range(1, 101)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {int(r.identifier): r for r in catalog.QUERIES["qa_full_reports"](spark, str(tmp_path)).collect()}
    assert got.keys() == {i for i, _ in docs} and all(float(r.rougeLsum) > 0.99 for i, r in got.items() if i % 2)
