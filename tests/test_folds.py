import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.operators import budget, folds

COSTS = st.lists(st.integers(0, 12), min_size=1, max_size=40)


def batches(costs, limit):
    out, batch, used = [], 0, None
    for c in costs:
        if used is None or used + c > limit:
            batch, used = batch + 1, 0
        used += c
        out.append(batch)
    return out


def fits(costs, limit, most=None):
    used, out = 0, []
    for c in costs:
        out.append(used + c <= limit and (most is None or sum(out) < most))
        used += c if out[-1] else 0
    return out


@settings(max_examples=300, deadline=None)
@given(COSTS, st.integers(0, 30), st.integers(0, 40))
def test_map_of_a_run(costs, limit, used):
    reach, many, left, total = folds.next_fit_map(np.array(costs), limit)
    i = int(np.searchsorted(reach, limit - used, side="right"))
    got = (0, used + total) if i == len(reach) else (many[i], left[i])
    begun, u = 0, used
    for c in costs:
        if u + c > limit:
            begun, u = begun + 1, 0
        u += c
    assert got == (begun, u)


@settings(max_examples=300, deadline=None)
@given(COSTS, st.integers(0, 60), st.integers(0, 10))
def test_what_fits(costs, limit, most):
    assert folds._fit(np.array(costs), limit, most).tolist() == fits(costs, limit, most)


@pytest.mark.parametrize("count", [1, 7])
def test_groups_over_several_blocks(spark, count):
    rng = random.Random(4)
    rows = [(1, i, rng.choice([0, 1, 3, 5, 40, None])) for i in range(900)] + [(g, i, rng.randint(0, 9)) for g in range(2, 30) for i in range(rng.randint(1, 6))] + [(None, i, 4) for i in range(50)] + [(2**60 + 1, i, 4) for i in range(5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, o long, c long")
    by = defaultdict(list)
    for g, o, c in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])):
        by[g].append((o, c or 0))
    for limit in (7, 30, 500):
        got = {(r.g, r.o): r.batch for r in folds.next_fit(df, "g", "o", "c", limit, count).collect()}
        assert got == {(g, o): b for g, own in by.items() for (o, _), b in zip(own, batches([c for _, c in own], limit))}
    for limit, most in ((7, None), (300, None), (10**6, None), (300, 33), (50, 0)):
        got = {(r.g, r.o): r.selected for r in folds.fitting(df, "g", "o", "c", limit, most, count).collect()}
        assert got == {(g, o): s for g, own in by.items() for (o, _), s in zip(own, fits([c for _, c in own], limit, most))}


def test_one_group_is_dealt_evenly(spark):
    rows = spark.range(20_000).selectExpr("1 AS g", "id AS o", "id % 7 AS c")
    cut = folds.blocks(rows, "g", "o", "c", 8)
    sizes = sorted(r["count"] for r in cut.groupBy("block").count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_empty(spark):
    none = spark.createDataFrame([], "g long, o long, c long")
    assert folds.next_fit(none, "g", "o", "c", 5).count() == 0 and folds.fitting(none, "g", "o", "c", 5).count() == 0


def test_skip_gives_what_was_taken(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 4), ("b", 1, 99)], "g string, o long, c long")
    assert sorted(map(tuple, budget.skip(df, "g", "o", "c", 10).collect())) == [("a", [1, 3], 9), ("b", [], 0)]
