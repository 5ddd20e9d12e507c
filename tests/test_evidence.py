import pytest
from pyspark.sql import functions as F

from sievewright.operators import evidence


def test_verdicts_of_evidence(spark):
    names = "left_id string, right_id string, left_revision string, right_revision string, left_side string, right_side string, left_content_sha256 string, right_content_sha256 string, want string"
    rows = [("a", "b", None, None, None, None, None, None, "proven-different"), ("a", "a", "1", "2", None, None, None, None, "revision-conflict"), ("a", "a", "1", "1", "x", "y", "h", "h", "conflict"),
            ("a", "a", None, "1", None, "y", "h", "h", "proven-same"), ("a", "a", None, None, None, None, "h", "i", "content-conflict"), ("a", "a", None, None, "x", "x", "h", None, "compatible"), (None, "a", None, None, "x", None, None, None, "unknown")]
    got = spark.createDataFrame(rows, names).select("want", evidence.verdict().alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_projections(spark):
    row = spark.range(1).select(evidence.relevance(F.lit(24.0)).alias("r"), evidence.entry_name(F.lit("async def  Pay(x: int):")).alias("a"), evidence.entry_name(F.lit("class Cart:")).alias("b"), evidence.entry_name(F.lit(None).cast("string")).alias("c")).first()
    assert (row.r, row.a, row.b, row.c) == (0.63212, "pay", "cart", "")
    manifests = spark.createDataFrame([('{"react": 1}',), ("Django==4",), (None,)], "content string")
    assert evidence.frameworks(manifests).first().frameworks == ["React", "Django"]
    files = spark.createDataFrame([("a", ["def pay(x)", "class Cart"]), ("b", ["def pay(x)"])], "path string, names array<string>")
    symbols = spark.createDataFrame([("a", "Pay")], "path string, name string")
    assert {r.path: r.names for r in evidence.without_dominated(files, symbols).collect()} == {"a": ["class Cart"], "b": ["def pay(x)"]}
    assert [r.path for r in evidence.cited(files, symbols).collect()] == ["a"]


def test_slices_and_json(spark):
    items = spark.createDataFrame([("file", 1, "f" * 8), ("external", 1, "e" * 16), ("symbol", 1, "s" * 400), ("symbol", 2, "t" * 4)], "layer string, place long, text string")
    assert sorted(r.text[0] for r in evidence.sliced(items, 6).collect()) == ["e", "t"]
    texts = ['{"a":[1,1,[2,2],[2]],"b":"x"}', "[true,1,1.0]", "no json", None]
    assert [r.j for r in spark.createDataFrame([(t,) for t in texts], "t string").select(evidence.distinct_json("t").alias("j")).collect()] == ['{"a":[1,[2]],"b":"x"}', "[true,1,1.0]", "no json", None]


def test_counters(spark):
    df = spark.createDataFrame([("a b c",), (None,)], "t string")
    evidence.register_counter("words", lambda t: len(t.split()) - (not t))
    assert [r.n for r in df.select(evidence.counted(F.col("t"), "words").alias("n")).collect()] == [3, 0]
    assert [r.n for r in df.select(evidence.counted(F.col("t")).alias("n")).collect()] == [2, 0]
    with pytest.raises(ValueError, match="no such"):
        evidence.counted(F.col("t"), "none")
    answers = spark.createDataFrame([("w", "task", "x" * 9)], "worker string, task string, payload string")
    assert evidence.envelope(answers, 3).first().evidence == "xxx…"


def test_exact_counts_from_sql(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    texts = ["The cat sat.", "", None, "naïve " * 400_000, "<|endoftext|> x"]
    evidence.register_tokenizer("word-bpe", path)
    evidence.register_sql(spark, "exact_tokens", "word-bpe")
    spark.createDataFrame(list(enumerate(texts)), "k int, t string").createOrReplaceTempView("counted_texts")
    got = {r.k: r.n for r in spark.sql("SELECT k, exact_tokens(t) AS n FROM counted_texts").collect()}
    t = tokenizers.Tokenizer.from_file(path)
    assert got == {k: len(t.encode(x or "", add_special_tokens=False).ids) for k, x in enumerate(texts)}
