import numpy as np
import pytest

from sievewright import tables
from sievewright.functions import nearest


def there(spark, path):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_tables_go_when_they_are_done_with(spark):
    a, b = (tables.written(spark.range(3), n) for n in "ab")
    tables.forget(a)
    assert not there(spark, a.written_at) and b.count() == 3
    with tables.collected() as paths:
        c = tables.written(spark.range(2), "c")
    tables.forget(c)  # whoever collected it deletes it
    assert paths == [c.written_at] and c.count() == 2
    tables.drop_path(spark, c.written_at)
    with pytest.raises(ValueError, match="no"):
        with tables.passing(spark):
            d = tables.written(spark.range(2), "d")
            raise ValueError("no")
    assert not there(spark, d.written_at) and there(spark, b.written_at)
    tables.release(spark)
    assert b.count() == 3


def test_nearest_as_a_table_function(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(4)], i % 2) for i in range(60)]
    rows += [(100, None, 0), (101, [0.0] * 4, 0), (102, [1.0, None, 0.0, 0.0], 0), (103, [1.0, 2.0], 0), (104, rows[0][1], 0), (105, rows[1][1], None)]
    nearest.register(spark)
    nearest.dealt(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "vec_id % 10 = 0", parts=3).createOrReplaceTempView("dealt_vectors")
    got = spark.sql("SELECT left, max_by(right, score) AS best, count(*) AS n FROM nearest(TABLE(SELECT * FROM dealt_vectors) PARTITION BY (label, part) ORDER BY (asks DESC), 2) GROUP BY left").collect()
    unit = {i: np.float32(x) / np.linalg.norm(np.float32(x)) for i, x, label in rows if x and len(x) == 4 and None not in x and any(x) and label is not None}
    label = {i: label for i, _, label in rows}
    assert {r.left for r in got} == {i for i in unit if i % 10 == 0} and all(r.n == 6 for r in got)
    for r in got:
        if r.left:  # 0 has its copy, 104
            assert r.best == max((j for j in unit if j != r.left and label[j] == label[r.left]), key=lambda j: float(unit[j] @ unit[r.left]))
        else:
            assert r.best == 104
