import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.operators import trigrams


def holds(plan, have):
    if plan is None:
        return True
    if isinstance(plan, str):
        return plan in have
    return (all if plan[0] == "and" else any)(holds(p, have) for p in plan[1])


def test_plans():
    assert trigrams.needed("hello") == ("and", ("hel", "ell", "llo"))
    assert trigrams.needed("abc|def") == ("or", ("abc", "def"))
    assert trigrams.needed("a(bcd)?e") is None and trigrams.needed("(bcd)+") == "bcd" and trigrams.needed(".*") is None
    assert trigrams.needed("ab[cd]e") == ("or", (("and", ("abc", "bce")), ("and", ("abd", "bde"))))
    assert trigrams.needed("abc.def") == ("and", ("abc", "def")) and trigrams.needed("tasks") is None


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "abc", "(abc)?", "(ab|bcd)", "[ab]", "b+", "c*", ".", "^", "$", "B", "s", "é", "(?:bca){2}", r"\w", "(?=abc)", "a{2,3}"]), max_size=6).map("".join), st.text("abcdAB sé\n", max_size=14))
def test_nothing_that_matches_is_lost(pattern, text):
    try:
        found = re.compile(pattern, re.IGNORECASE).search(text)
    except re.error:
        return
    have = {trigrams._folded(text)[i : i + 3] for i in range(len(text) - 2)}
    have = {t for t in have if t.isascii() and "\n" not in t}
    if found:
        assert holds(trigrams.needed(pattern), have)


@pytest.fixture(scope="module")
def files(spark):
    rows = [(f"f{i:03}", "\n".join(f"line {i} {w} Alpha" for w in ("red", "blue", "needle" if i % 50 == 7 else "hay"))) for i in range(300)] + [("null", None), ("empty", ""), ("odd", "Kelvin K STRASSE ſtraße\nNEEDLES")]
    return spark.createDataFrame(rows, "path string, content string")


@pytest.mark.parametrize("pattern", ["needle", "Needle|ſtra", "n..dle", "line 7 .*hay", "zzzz", "^$", "strasse", "kelvin k", "(red|blue) alpha"])
def test_search_equals_a_scan(spark, files, pattern):
    postings = trigrams.index(files)
    every = trigrams.matches(trigrams.lines_of(files), f"(?iu){pattern}")
    assert sorted(map(tuple, trigrams.search(files, postings, pattern).collect())) == sorted(map(tuple, every.collect()))


def test_only_candidates_are_read(spark, files, tmp_path):
    at = f"file://{tmp_path}/files"
    files.orderBy("path").coalesce(1).write.option("parquet.page.row.count.limit", "20").parquet(at)
    stored = spark.read.parquet(at)
    postings = trigrams.index(stored)
    assert trigrams.candidates(postings, "needle").count() == 7
    found = trigrams.search(stored, postings, "line 57 needle")
    assert found.count() == 1
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    scans = [n for n in iter_nodes(plan) if "Scan" in n.nodeName()]
    assert len(rows) == 1 and scans and sum(n.metrics().apply("numOutputRows").value() for n in scans) <= 100


def iter_nodes(plan):
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    yield plan
    for i in range(plan.children().size()):
        yield from iter_nodes(plan.children().apply(i))
