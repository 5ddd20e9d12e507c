import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tables import corpus, documents

from sievewright.llm import fim


def expected(key, text):
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.sampled_from([r"(?s:.)", r"\w+", r"[^\n]*\n?", "ab|a"]), st.integers(0, 99), st.integers(0, 99))
def test_ranks_equal_a_list_of_units(text, pattern, a, b):
    unit = re.compile(pattern)
    every = [m.end() for m in unit.finditer(text)]
    assert fim.units(unit, text) == len(every)
    low, high = sorted((a % (len(every) + 1), b % (len(every) + 1)))
    assert fim.ends(unit, text, low, high) == tuple(every[r - 1] if r else 0 for r in (low, high))


def test_no_unit_is_kept():
    import tracemalloc

    text, unit = "é" * 2_000_000, re.compile(fim.UNIT)
    tracemalloc.start()
    n = fim.units(unit, text)
    fim.ends(unit, text, n // 3, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2_000_000 and peak < 100_000


def test_outputs_equal_slices(spark):
    rows = corpus() + [(5000 + i, t, None, None) for i, t in enumerate(["<P>", "a<S>b", "x<M", "<", "<P<S", "P>", "\U0001f600é" * 9, "a\x00b", "<M" * 7])] + [(2003, "one", "en", "s2")]
    made = fim.transform(documents(spark, rows))
    got = sorted(map(tuple, made.collect()), key=repr)
    assert got == sorted(((i, *expected(i, t)) for i, t, *_ in rows), key=repr)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t, *_ in rows), key=repr)


def test_words_as_units(spark):
    docs = spark.createDataFrame([(i, " a bb\tccc  dd\n" * i) for i in range(40)], "doc_id long, text string")
    for r in fim.transform(docs, r"\S+").collect():
        assert r.n == 4 * r.doc_id
        if r.form != "plain":
            assert (" a bb\tccc  dd\n" * r.doc_id)[: r.prefix_chars].rstrip()[-1:] in ("", "a", "b", "c", "d")


def test_empty_table_text_ids_and_clashing_columns(spark):
    assert fim.transform(documents(spark, [])).count() == 0
    docs = spark.createDataFrame([("k", "some text", 1, "plain"), ("k", "some text", 2, "x"), (None, None, 3, None)], "doc_id string, text string, n int, form string")
    got = sorted(map(tuple, fim.transform(docs).collect()), key=repr)
    assert got == sorted([("k", *expected("k", "some text"))] * 2 + [(None, *expected(None, None))], key=repr)
