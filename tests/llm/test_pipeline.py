"""Each stage of the pipeline on what the one before kept, against brute force."""

import re
from collections import Counter

import pytest
from tables import corpus, documents
from test_duplicates import near, removed

import corpus_pipeline
from sievewright.llm import langid, linedup, mixing, packing
from sievewright.llm.common import new_path

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage, each written and read again."""
    docs, out = documents(spark, [(i, t, lang, s) for i, t, lang, s in corpus(seed=5, n=90)] + [(9000 + k, "+ + + 1 2 3", "en", "s1") for k in range(3)]), {}
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, name)
        stage(spark, docs, "").write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()], docs.columns, after.columns)
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, (_, _, before, after) in stages.items():
        assert name == "packing" or after == before


def test_language(spark, stages):
    before, after, *_ = stages["language_id"]
    model = langid.learn(spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in before], "doc_id long, text string, lang string"))
    want = {}
    for r in before:
        lang, score, _ = model.infer(r["text"] or "")
        if lang != "und" and score >= corpus_pipeline.LEAST_SHARE:
            want[r["doc_id"]] = (r["text"], lang)
    assert {r["doc_id"]: (r["text"], r["lang"]) for r in after} == want
    assert not {2000, 2001, 2002, 9000} & set(want) and len(want) > 90


def test_lines(stages):
    before, after, *_ = stages["line_dedup"]
    rows = [(r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in before if len(r["text"]) < 20_000]
    want = {i: t for i, t in removed(rows, linedup.MIN_WORDS).items() if t == dict(rows)[i] or re.search(WORD, t)}
    assert {-1 if r["doc_id"] is None else r["doc_id"]: r["text"] for r in after if r["doc_id"] != 2007} == want
    assert 2007 in {r["doc_id"] for r in after} and len(want) < len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicates(stages):
    before, after, *_ = stages["near_dedup"]
    found = near([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None and r["doc_id"] != 2007], 5, 80)
    want = {i for i, (_, c) in found.items() if i == c} | {None, 2007}
    assert {r["doc_id"] for r in after} == want
    assert [r["text"] for r in sorted(after, key=str)] == [r["text"] for r in sorted(before, key=str) if r["doc_id"] in want]


def test_mixing(spark, stages):
    before, after, *_ = stages["mixing"]
    plan = mixing.plan(spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in before], "doc_id long, text string, source string")).collect()
    words = Counter()
    for r in after:
        words[r["doc_id"]] += len(re.findall(WORD, r["text"]))
    assert {r.doc_id: r.taken for r in plan if r.taken} == {k: v for k, v in words.items() if v}
    whole = {r["doc_id"]: r["text"] for r in before}
    assert all(whole[r["doc_id"]].startswith(r["text"]) for r in after)


def test_packing(stages):
    before, after, *_ = stages["packing"]
    sizes = Counter()
    for r in after:
        sizes[r["sequence_id"]] += r["length"]
    assert max(sizes.values()) <= packing.CAPACITY
    words = packing.Words(packing.vocabulary())
    want = Counter()
    for r in before:
        want[r["doc_id"]] += len(words.ids([r["text"]])[0]) + 1
    got = Counter()
    for r in after:
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_run_and_no_rows(spark, tmp_path):
    docs = documents(spark, corpus(n=12)).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    docs.where("false").write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
    twice = docs.union(docs)
    for _, stage in corpus_pipeline.STAGES:
        twice = stage(spark, twice, "")
    assert twice.count() > 0
