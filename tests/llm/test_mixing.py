import re

import duckdb
import pytest
from pyspark.sql import functions as F
from tables import corpus, documents

from sievewright.llm import mixing


def test_schedules_invert(spark):
    knots = ((0.0, 1.0), (0.25, 3.0), (1.0, 0.5))
    df = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
    for row in df.select("u", mixing.demand_by(mixing.time_of(F.col("u"), knots), knots).alias("v")).collect():
        assert row.v == pytest.approx(row.u, abs=1e-9)


def oracle(rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, s) for i, t, _, s in rows])
    return sorted(db.sql(f"SELECT doc_id, size, source_size, target, taken, position FROM ({mixing.SQL})").fetchall(), key=str)


@pytest.mark.parametrize("twice", [False, True])
def test_plan_equals_sql(spark, twice):
    rows = corpus() * (2 if twice else 1)
    got = mixing.plan(documents(spark, rows)).select("doc_id", "size", "source_size", "target", "taken", "position").collect()
    assert sorted(map(tuple, got), key=str) == oracle(rows)


def test_targets(spark):
    rows = [(i, "w " * n, "en", s) for i, (s, n) in enumerate([("a", 100), ("b", 10), ("c", 1000), ("c", 500), (None, 50)])]
    got = {(r.source, r.doc_id): r for r in mixing.plan(documents(spark, rows)).collect()}
    targets = {s: r.target for (s, _), r in got.items()}
    assert targets["b"] == 30 and targets[None] == 150 and targets["a"] == 300  # each at three times its size
    assert targets["c"] == 1660 - 480
    assert sum(r.taken for r in got.values()) == 1660
    assert all(r.taken <= 3 * r.size for r in got.values())


def test_mixed_takes_the_plan(spark):
    rows = corpus()
    docs = documents(spark, rows)
    want = {r.doc_id: r.taken for r in mixing.plan(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got, texts = {}, {i: t for i, t, *_ in rows}
    for r in out.collect():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        got[r.doc_id] = got.get(r.doc_id, 0) + words
        assert (texts[r.doc_id] or "").startswith(r.text or "")
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    again = mixing.mixed(documents(spark, rows)).collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in out.collect()]


def test_repeated_rows_and_no_rows(spark):
    rows = corpus(n=9) * 2
    docs = documents(spark, rows)
    assert sum(r.taken for r in mixing.plan(docs).collect()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in mixing.mixed(docs).collect())
    none = documents(spark, [])
    assert mixing.plan(none).count() == 0 and mixing.mixed(none).count() == 0
