import threading

import pytest
from pyspark.sql import functions as F

from sievewright.operators import overlay
from sievewright.store import Store

SCHEMA = "k long, v string, n long"


def store(spark, tmp_path, buckets=4):
    return Store(spark, f"file://{tmp_path}/t", ["k"], SCHEMA, buckets)


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_can_be_read(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.versions() == [] and s.read().count() == 0
    assert s.upsert(rows(spark, (1, "a", 0), (2, "b", 0), (None, "n", 0))) == 1
    assert s.upsert(rows(spark, (2, "c", 1), (3, "d", 1), (None, "m", 1)), {"n": F.coalesce("old.n", F.lit(-5)) + F.col("new.n")}) == 2
    assert s.delete(rows(spark, (1, "", 0), (3, "", 0)), F.col("v") == "a") == 3
    assert content(s.read(1)) == content(rows(spark, (1, "a", 0), (2, "b", 0), (None, "n", 0)))
    assert content(s.read(2)) == content(rows(spark, (1, "a", 0), (2, "c", 1), (3, "d", -4), (None, "m", 1)))
    assert content(s.read()) == content(rows(spark, (2, "c", 1), (3, "d", -4), (None, "m", 1)))
    assert {(r.k, r.change) for r in s.changes(1).collect()} == {(1, "removed"), (2, "changed"), (3, "added"), (None, "changed")}
    with pytest.raises(ValueError, match="no version 9"):
        s.read(9)
    assert s.vacuum() > 0 and s.versions() == [3] and s.read().count() == 3


def test_repeated_keys_and_batches(spark, tmp_path):
    s = store(spark, tmp_path)
    two = rows(spark, (1, "a", 1), (1, "b", 2), (1, "c", 0))
    assert s.upsert(two, newest=F.col("n"), batch=("stream", 0)) == 1
    assert s.upsert(rows(spark, (1, "x", 9)), batch=("stream", 0)) == 1
    assert s.upsert(rows(spark, (2, "y", 9)), batch=("stream", 1)) == 2
    assert content(s.read()) == [(1, "b", 2), (2, "y", 9)]


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both count up the same key and add keys of their own, at the same time."""
    failed = []

    def write(w):
        try:
            s = store(spark, tmp_path)
            for i in range(4):
                s.upsert(rows(spark, (0, "both", 1), (100 * w + i, "own", 1)), {"n": F.coalesce("old.n", F.lit(0)) + F.col("new.n")})
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    s = store(spark, tmp_path)
    assert not failed and s.versions() == list(range(1, 9))
    assert content(s.read()) == sorted([(0, "both", 8), *((100 * w + i, "own", 1) for w in (1, 2) for i in range(4))], key=repr)


def test_a_crash_before_the_manifest_is_invisible(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    s.upsert(rows(spark, (1, "a", 0)))
    broken = store(spark, tmp_path)

    def fail(manifest):
        raise OSError("lost")

    monkeypatch.setattr(broken, "_publish", fail)
    with pytest.raises(OSError):
        broken.upsert(rows(spark, (1, "z", 0), (2, "z", 0)))
    assert content(s.read()) == [(1, "a", 0)] and s.upsert(rows(spark, (2, "b", 0))) == 2
    assert content(s.read()) == [(1, "a", 0), (2, "b", 0)] and s.vacuum(2) == 1


def test_overlay(spark, tmp_path):
    kept, gone = overlay.overlay(spark, f"file://{tmp_path}/o", 4)
    now = F.lit(100)
    some = spark.createDataFrame([("a", "current", "active"), ("b", "current", "active"), ("c", "stale", "rejected")], "id string, validity string, tier string")
    overlay.put(kept, some)
    overlay.promote(kept, some, now)
    overlay.promote(kept, some.where("id = 'a'"), F.lit(200))
    state = {r.id: (r.tier, r.recall_count, r.last_recalled_at) for r in kept.read().collect()}
    assert state == {"a": ("active", 0, None), "b": ("active", 0, None), "c": ("rejected", None, None)}
    overlay.promote(kept, spark.createDataFrame([("d", "current")], "id string, validity string"), F.lit(200))
    assert kept.read().where("id = 'd'").select("tier", "recall_count", "last_recalled_at").first() == ("active", 1, 200)
    overlay.reject(kept, some.where("id = 'b'"), "worn", F.lit(300), keep=1)
    assert {r.id: (r.tier, r.recall_count) for r in kept.read().collect()} == {"a": ("active", 0), "b": ("rejected", 0), "d": ("active", 1)}
    overlay.retire(kept, gone, spark.createDataFrame([("a",), ("b",), ("x",)], "id string"), "moved", now)
    assert {r.id for r in kept.read().collect()} == {"b", "d"} and [tuple(r) for r in gone.read().collect()] == [("a", "moved", 100)]
    with pytest.raises(Exception, match="requires id"):
        overlay.put(kept, spark.createDataFrame([("", "active")], "id string, tier string"))
    with pytest.raises(Exception, match="only active or rejected"):
        overlay.put(kept, spark.createDataFrame([("q", "recallable")], "id string, tier string"))


def test_runs_resume(spark, tmp_path):
    kept = overlay.runs(spark, f"file://{tmp_path}/r")
    overlay.save(kept, spark.createDataFrame([("r1", "failed", {"a": "success", "b": "failed", "c": None})], "run_id string, status string, results map<string,string>"), F.lit(5))
    asked = spark.createDataFrame([("r1",)], "run_id string")
    assert [tuple(r) for r in overlay.resume(kept, asked, F.lit(9)).collect()] == [("r1", 1, ["b", "c"])]
    again = overlay.resume(kept, asked, F.lit(11)).first()
    assert again.resume_count == 2 and kept.read().select("created_at", "updated_at", "status").first() == (5, 11, "running")
    assert kept.read(1).first().status == "failed"
    with pytest.raises(Exception, match="no checkpoint"):
        overlay.resume(kept, spark.createDataFrame([("r2",)], "run_id string"), F.lit(1))
    with pytest.raises(Exception, match="invalid run id"):
        overlay.save(kept, spark.createDataFrame([("a/b",)], "run_id string"), F.lit(1))
