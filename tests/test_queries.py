"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from sievewright import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return db


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool) or isinstance(x, str):
        return x
    return float(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    mine = rows(got.columns, got.collect())
    if name in catalog.ORACLES:
        want = db.execute(catalog.ORACLES[name])
        assert mine == rows([c[0] for c in want.description], want.fetchall())
    else:
        assert mine[1]


def test_documents_that_lack_something_are_counted_as_in_sql(spark, tmp_path):
    docs = "(1, 'A b', 'en', 's1'), (2, 'a  B', 'de', 's2'), (3, 'c', 'en', 's1'), (4, NULL, 'en', 's1'), (5, '', 'en', 's2'), (6, ' ', 'de', 's2'), (7, '', 'en', 's3'), (8, 'd', NULL, 's1'), (9, 'D', ' ', 's2'), (10, 'd', '', 's2'), (NULL, 'f', 'en', 's1'), (12, NULL, NULL, NULL)"
    db = duckdb.connect()
    for name, columns, values in (("documents", "doc_id, text, lang, source", docs), ("labels", "doc_id, quality", "(1, 1), (3, 0), (7, 0), (10, 0), (10, 1)")):
        db.execute(f"COPY (SELECT * FROM (VALUES {values}) t({columns})) TO '{tmp_path}/{name}.parquet'")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got, want = catalog.QUERIES["fanin_stats"](spark, str(tmp_path)), db.execute(catalog.ORACLES["fanin_stats"])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
