"""Every knowledge-base query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ravelin.plans.queries import QUERIES, SQL


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, db):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    r = db.execute(SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([plain(x[cols.index(c)]) for c in sorted(cols)]) for x in r.fetchall())
    assert sorted(repr([plain(x[c]) for c in sorted(cols)]) for x in rows) == want


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "score", "rang"]
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


def test_nothing_outside_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for f in glob.glob(f"{root}/ravelin/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in f:
            with open(f, encoding="utf-8") as h:
                assert "ravelin.llm" not in h.read(), f


def test_pages_are_converted_in_small_batches(spark, tmp_path, monkeypatch):
    """A worker never has more than 200 pages at once."""
    from ravelin.plans import queries

    @F.pandas_udf("string")
    def sizes(pages: pd.Series) -> pd.Series:
        return pd.Series([str(len(pages))] * len(pages))

    spark.range(1000).selectExpr("id AS page_id", "'<p>x</p>' AS html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(queries.text, "html_to_markdown_column", sizes)
    assert {r.markdown for r in queries.html_to_markdown(spark, str(tmp_path)).collect()} == {"200"}
