import gzip
import hashlib
import io

import duckdb
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith
from pyspark.sql.types import StructType

from sievewright.llm import warc
from sievewright.llm.common import new_path

BIG, BIGGER = "é" * 500, "x" * 5000
PAGES = [(1, "http://a/1", BIG), (7, "http://a/7", BIG), (3, "http://b/3\r\nX: y", BIG), (4, None, "x" * 999), (5, "http://b/5", "x" * 999), (6, "http://a/6", None), (8, "http://a/8", ""), (9, "http://é/9", BIGGER), (2, "u", BIGGER + "y")]


@pytest.fixture(scope="module")
def archive(spark):
    warc.register(spark)
    path = new_path(spark, "warc")
    warc.archive(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3), path)
    return path


def test_round_trip(spark, archive):
    got = {int(r.record_id.split(":")[-1]): r for r in spark.read.format("warc").load(archive).collect()}
    assert len(got) == len(PAGES)
    for i, url, html in PAGES:
        payload, r = (html or "").encode(), got[i]
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha1(payload).hexdigest()
        assert r.target_uri == (url and url.replace("\r", "%0D").replace("\n", "%0A"))
        if i in (1, 3):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", "urn:page:7", None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, payload)


def test_predicates_and_columns(spark, archive):
    df = spark.read.format("warc").schema("record_id string, record_type string, target_uri string").load(archive)
    assert {r.record_id for r in df.where("record_type = 'revisit'").collect()} == {"urn:page:1", "urn:page:3"}
    assert {r.record_id for r in df.where("target_uri LIKE 'http://a/%' AND record_type IN ('response')").collect()} == {f"urn:page:{i}" for i in (7, 6, 8)}
    assert df.where("target_uri IS NULL").count() == 1
    reader = warc.WarcReader(archive, StructType.fromDDL("record_id string"))
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("record_id",), ("a",)), StringStartsWith(("target_uri",), "h"), GreaterThan(("payload_bytes",), 3)]))
    assert len(reader.filters) == 3 and left == [GreaterThan(("payload_bytes",), 3)]
    with pytest.raises(ValueError, match="no such columns"):
        warc.WarcReader(archive, StructType.fromDDL("other string"))


def _records():
    rows = [{"record_id": f"urn:page:{i}", "record_type": "response", "target_uri": u, "date": None, "payload_digest": hashlib.sha1((h or "").encode()).hexdigest(), "payload_bytes": len((h or "").encode()), "refers_to": None, "payload": (h or "").encode()} for i, u, h in PAGES]
    return [warc.record(r) for r in rows]


class Counted(io.BytesIO):
    seen = 0

    def read(self, n=-1):
        out = super().read(n)
        self.seen += len(out)
        return out


@pytest.mark.parametrize("form", ["plain", "gzip", "lengths"])
def test_forms_and_passing_over(form):
    data = b"".join({"plain": lambda r: r, "gzip": gzip.compress, "lengths": warc.member}[form](r) for r in _records())
    every = list(warc.records(io.BytesIO(data), lambda h: True))
    assert [b.partition(b"\r\n\r\n")[2] for _, b in every] == [(h or "").encode() for *_, h in PAGES]
    none = list(warc.records(io.BytesIO(data), lambda h: False))
    assert [h for h, _ in none] == [h for h, _ in every] and all(b is None for _, b in none)
    some = list(warc.records(io.BytesIO(data), lambda h: h["warc-record-id"] == "<urn:page:9>"))
    assert [b is not None for _, b in some] == [i == 9 for i, *_ in PAGES]


def test_members_are_gzip_and_blocks_stay_unread():
    import random

    payload = random.Random(1).randbytes(3 << 20)
    row = {"record_id": "r", "record_type": "response", "target_uri": "u", "date": None, "payload_digest": "00" * 20, "payload_bytes": len(payload), "refers_to": None, "payload": payload}
    data = warc.member(warc.record(row)) * 3
    assert gzip.decompress(data) == warc.record(row) * 3
    file = Counted(data)
    assert len(list(warc.records(file, lambda h: False))) == 3 and file.seen < 0.1 * len(data)
    assert [b.endswith(payload) for _, b in warc.records(io.BytesIO(data), lambda h: True)] == [True] * 3
    with pytest.raises(ValueError, match="checksum|ends within"):
        list(warc.records(io.BytesIO(data[:-9] + b"\0" * 9), lambda h: True))


def test_leftovers_of_lost_tasks_are_not_read(spark, archive):
    system, base = warc._open(archive)
    with system.open_output_stream(f"{base}/part-00000-000-lost.warc.gz", compression=None) as f:
        f.write(b"".join(map(warc.member, _records())))
    assert spark.read.format("warc").load(archive).count() == len(PAGES)


def test_query_equals_sql(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in warc.query(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(db.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.SQL})").fetchall())


def test_no_rows_and_repeats(spark):
    warc.register(spark)
    path, schema = new_path(spark, "warc"), "page_id long, url string, html string"
    warc.archive(spark.createDataFrame([], schema), path)
    assert spark.read.format("warc").load(path).count() == 0
    warc.archive(spark.createDataFrame([(1, "u", BIG)] * 2 + [(None, "u", BIG)], schema), path)
    got = sorted((r.record_id, r.record_type, r.refers_to) for r in spark.read.format("warc").load(path).collect())
    assert got == [("urn:page:", "revisit", "urn:page:1"), ("urn:page:1", "response", None), ("urn:page:1", "response", None)]
