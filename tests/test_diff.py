from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.operators import diff

LINES = st.lists(st.integers(0, 8), max_size=14)


@settings(max_examples=500, deadline=None)
@given(LINES, LINES)
def test_changes_make_the_new_lines(old, new):
    out, at = [], 0
    for i, n, j, m in diff.changes(old, new):
        out += old[at:i] + new[j : j + m]
        assert n or m
        at = i + n
    assert out + old[at:] == new
    assert (diff.changes(old, new) == []) == (old == new)


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(7)))
def test_longest_rising_run(order):
    pairs = list(enumerate(order))
    best = 0
    for mask in range(1 << len(order)):
        own = [order[i] for i in range(len(order)) if mask >> i & 1]
        best = max(best, len(own) if own == sorted(own) else 0)
    got = diff.rising(pairs)
    assert len(got) == best and got == sorted(got) and [j for _, j in got] == sorted(j for _, j in got)


def test_anchors_keep_what_moved_little():
    assert diff.changes([1, 2, 3, 4, 5], [1, 9, 3, 4, 5]) == [(1, 1, 1, 1)]
    assert diff.changes([1, 2, 3], [1, 2, 2, 3]) in ([(2, 0, 2, 1)], [(1, 0, 1, 1)])
    assert diff.changes([7, 1, 7, 2, 7], [7, 1, 7, 7, 2, 7]) == [(3, 0, 3, 1)]


def test_hunks_round_trip(spark):
    texts = [("a\nb\nc\n", "a\nx\nc\n"), ("", "a"), ("a", ""), (None, "x\ny"), ("x\ny", None), ("same", "same"), (None, None), ("\n".join(map(str, range(500))), "\n".join(str(i) for i in range(500) if i % 7)), ("é\n\n\n", "\n\né"), ("b\na", "a\nb\na")]
    pairs = spark.createDataFrame([(i, o, n, "x") for i, (o, n) in enumerate(texts)] + [(None, "p\nq", "q", "x")], "k long, old string, new string, hunks string")
    rows = diff.hunks(pairs, "k")
    got = {r.k: r.new for r in diff.applied(pairs.select("k", "old"), rows, "k").collect()}
    assert got == {**{i: n or "" for i, (_, n) in enumerate(texts)}, None: "q"}
    one = [tuple(r) for r in rows.where("k = 0").collect()]
    assert one == [(0, 1, 2, 2, ["b"], ["x"])] and rows.where("k IN (5, 6)").count() == 0 and rows.where("k = 7").count() > 20
