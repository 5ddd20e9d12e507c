import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import vafile

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score int"


def brute(rows, every=10, positives=5, negatives=5):
    """Rows (vec_id, vector, label) by plain sorting."""
    whole = []
    for uid, (i, x, label) in enumerate(rows):
        if label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            whole.append((uid, i, [math.floor(256 * float(np.float32(c))) for c in x], label))
    first = lambda found, n: sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))[:n]
    out = []
    for uid, i, a, label in whole:
        if i is None or i % every:
            continue
        scored = [(sum(p * q for p, q in zip(a, b)), j, u, other) for u, j, b, other in whole if u != uid and len(b) == len(a)]
        for p, j, *_ in first([r for r in scored if r[3] == label], positives):
            window = [r for r in scored if r[3] != label and 80 * p <= 100 * r[0] <= 100 * p]
            out += [(i, j, k, r[1], p, r[0]) for k, r in enumerate(first(window, negatives), 1)]
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, x, label, "x", 1) for i, x, label in rows], SCHEMA)


def mined(df, every=10, **how):
    return sorted(map(tuple, vafile.mine(df, F.col("vec_id") % every == 0, **how).collect()), key=repr)


def vectors(seed, n, d, labels=3, spread=0.35):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((1, d)) + spread * rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(c) for c in np.float32(v)], int(rng.integers(labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize("cells", [2, 16, 64])
def test_equals_brute_force(spark, cells, monkeypatch):
    monkeypatch.setattr(vafile, "FEWEST", 50)
    monkeypatch.setattr(vafile, "BLOCK", 64)
    rows = vectors(1, 300, 16)
    assert mined(table(spark, rows), cells=cells) == (want := brute(rows)) and len(want) > 300


def test_ties_copies_nulls_and_lengths(spark):
    rows = vectors(2, 80, 8)
    hot = rows[7][1]
    rows += [(1000 + i, hot, i % 2) for i in range(60)]  # copies, of which some are anchors, in two labels
    rows += [(20, hot, 0), (20, hot, 0), (20, rows[3][1], 1), (None, hot, 0), (None, hot, 1)]  # repeated and null ids
    rows += [(2000, None, 1), (2010, [], 1), (2011, [], 2), (2020, [float("nan")] * 8, 1), (2030, [None] + hot[1:], 1), (2040, hot, None), (2050, [float("inf")] + hot[1:], 0)]
    rows += [(3000, [0.0] * 8, 0), (3001, [0.0] * 8, 0), (3002, [0.0] * 8, 1), (3010, [-1.0, 0.5], 1), (3011, [-1.0, 0.4], 1), (3012, [-0.9, 0.4], 2), (3020, [1.0, -0.5], 1)]
    assert mined(table(spark, rows)) == brute(rows)


def test_large_components_take_no_part(spark):
    rows = vectors(3, 40, 4)
    assert mined(table(spark, [*rows, (500, [3e38, 1.0, 1.0, 1.0], 1)])) == brute(rows)


def test_empty_and_without_anchors(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []
    assert mined(table(spark, [(10, [1.0], 1)])) == []


def test_few_rows_are_scored():
    rng = np.random.default_rng(5)
    x = rng.integers(-100, 100, (4000, 32))
    ends = np.percentile(x, np.arange(1, 64) / 64 * 100, axis=0).astype(np.int64).T
    low, high = np.concatenate([x.min(0)[:, None], ends + 1], 1), np.concatenate([ends, x.max(0)[:, None]], 1)
    places = vafile.approximate(x, ends).T.astype(np.int64) + np.arange(32)[:, None] * low.shape[1]
    a = vafile.Anchor(-1, x[0].astype(np.int64), low, high, [(-vafile.ANY, vafile.ANY)], 5)
    a.offer(places, x, np.arange(4000), np.arange(4000))
    score = x @ x[0]
    assert a.best[0][0].tolist() == sorted(score.tolist(), reverse=True)[:5] and a.scored < 200
    upper, lower = a.most[places].sum(0), a.least[places].sum(0)
    assert (lower <= score).all() and (score <= upper).all()
