"""Steps whose work or memory once grew faster than their input, or held what a task needn't."""

import unicodedata

import numpy as np
from pyspark.sql import functions as F

from sievewright.functions import nearest, text
from sievewright.operators import findings, graph, overlay


def test_supporters_of_a_stream_are_keys_of_the_state_and_groups_one_row(spark, tmp_path):
    from sievewright.streaming import fanin

    (tmp_path / "in").mkdir()
    spark.range(60).selectExpr("cast(id % 3 as string) AS claim", "cast(id % 20 as string) AS source", "'e' AS evidence", "cast(id % 7 as string) AS worker", "id AS ordinal").write.mode("append").parquet(f"{tmp_path}/in")
    stream = findings.normalize(spark.readStream.schema("claim string, source string, evidence string, worker string, ordinal long").parquet(f"{tmp_path}/in"))
    query = fanin.start(stream, f"file://{tmp_path}/out")
    query.awaitTermination()
    state = query.recentProgress[0]["stateOperators"]
    assert [s["operatorName"] for s in state] == ["dedupe"]  # no worker of Python for each key
    assert state[0]["numRowsTotal"] == 3 * (7 + 20 + 20)
    kept = fanin.totals(spark, f"file://{tmp_path}/out/totals").read()
    assert sorted((r.group_key, r.occurrences, r.workers, r.sources, r.refs) for r in kept.collect()) == [(f"claim:{c}", 20, 7, 20, 20) for c in range(3)]


def test_resuming_reads_the_store_once_without_a_join(spark, tmp_path, monkeypatch):
    kept = overlay.runs(spark, f"file://{tmp_path}/runs")
    overlay.save(kept, spark.sql("SELECT 'r' || id AS run_id, map('a', if(id = 1, 'success', 'failed')) AS results FROM range(4)"), F.lit(1))
    seen, change = [], type(kept)._change

    def spied(self, rows, merged, batch):
        def looked(old, new):
            out = merged(old, new)
            seen.append(out._jdf.queryExecution().optimizedPlan().toString())
            return out

        return change(self, rows, looked, batch)

    monkeypatch.setattr(type(kept), "_change", spied)
    todo = overlay.resume(kept, spark.sql("SELECT 'r' || id % 2 AS run_id FROM range(4)"), F.lit(7))
    assert sorted(map(tuple, todo.collect())) == [("r0", 1, ["a"]), ("r1", 1, [])]
    assert sorted((r.run_id, r.status, r.updated_at, r.created_at) for r in kept.read().collect()) == [("r0", "running", 7, 1), ("r1", "running", 7, 1), ("r2", None, 1, 1), ("r3", None, 1, 1)]
    assert len(seen) == 1 and "Join" not in seen[0] and "Window" not in seen[0]


def test_nearest_of_blocks_by_brute_force(spark):
    rng = np.random.default_rng(5)
    at = rng.integers(-3, 4, (150, 4)).astype(float)
    at[7], at[20] = at[10], 0
    rows = [(i, None if i == 30 else v.tolist(), None if i == 40 else i % 2) for i, v in enumerate(at)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = nearest.best_of_blocks(df, "vec_id % 10 = 0", 3, rows=20, block=3)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    best = {}
    for r in got.collect():
        best.setdefault(r.left, []).append((r.score is None, -(r.score or 0), r.right))
    for a, v, label in rows:
        if a % 10 or label is None:
            continue
        want = []
        for b, w, other in rows:
            if b != a and other == label:
                norm = 0 if v is None or w is None else np.linalg.norm(v) * np.linalg.norm(w)
                score = round(float(np.dot(v, w)) / norm, 6) if norm else None
                want.append((score is None, -(score or 0), b))
        assert [x[2] for x in sorted(best[a])[:3]] == [x[2] for x in sorted(want)[:3]], a


def test_repeated_findings_are_one_row_before_they_are_expanded(spark):
    raw = spark.range(600).selectExpr("id AS ordinal", "'w' || id % 2 AS worker", "'c' || id % 3 AS claim", "'e' AS evidence", "'s' || id % 5 AS source", "0.5 AS confidence")
    found = findings.normalize(raw)
    few = findings.combined(found)
    assert few.count() == 30
    whole = lambda df: sorted(map(repr, df.collect()))
    assert whole(findings.groups(few, times=F.col("times"))) == whole(findings.groups(found))


def test_disagreements_are_counted_without_multiplied_rows(spark):
    raw = spark.createDataFrame([("a", "p", "x", 1.0), ("a", "p", "x", 1.0), ("a", "p", "y", 2.0), ("a", "p", "", None), ("b", "p", "x", 1.0), ("b", "p", None, 1.0), ("c", "p", None, None), ("c", "p", None, None)], "subject string, predicate string, polarity string, value double")
    out = findings.contradictions(findings.normalize(raw.withColumns({c: F.lit(c) for c in ("claim", "evidence", "source")})))
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()  # before any grouping
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.identity, r.findings, r.polarities, r["values"], r.sides, r.reasons) for r in out.collect()] == [("tuple:a|p||", 4, 2, 2, 2, ["polarity disagreement", "value disagreement"])]


def test_common_letters_need_no_python(spark):
    letters = [chr(c) for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF), (0x410, 0x44F), (0x401, 0x401), (0x451, 0x451), (0x4E00, 0x9FFF)) for c in range(a, b + 1)]
    texts = [*letters, *[a + b for a in letters[:130] for b in (*letters[:130], " ")], "é́ Á", " é", "ﬁÉ", "Σ É"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.identity_text(F.col("t")).alias("i"), (~F.col("t").rlike(text.PLAIN)).alias("crosses")).collect()
    assert [r.i for r in got] == [" ".join(unicodedata.normalize("NFKC", t.strip()).lower().split()) for t in texts]
    assert [r.t for r in got if r.crosses] == texts[-4:]


def test_narrow_tables_are_written_by_few_tasks(spark, monkeypatch):
    from sievewright.llm import minhash

    files, written = {}, graph.written

    def counted(df, name):
        out = written(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(graph, "written", counted)
    monkeypatch.setattr(minhash, "written", counted)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        docs = spark.range(300).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 40), i -> concat('w', if(id % 2 = 1 and i = id % 40, id, i + 100 * (id div 4))))) AS text")
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert set(got) == set(range(300)) and all(got[i] == i // 4 * 4 for i in range(0, 300, 2))
    narrow = {k: n for k, n in files.items() if k not in ("signatures", "signed", "nodes")}
    assert {"components", "stars", "parts"} <= set(narrow) and max(narrow.values()) <= max(2 * spark.sparkContext.defaultParallelism, 40 // minhash.WIDE), narrow


def test_components_merge_by_links_between_them(spark):
    from sievewright.llm import minhash

    parts = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (9, 3), (6, 6), (7, 6)], "node long, component long")
    links = spark.createDataFrame([(2, 9), (4, 10), (10, 12), (6, 7), (2, 1)], "a long, b long")
    across = minhash._across(links, parts)
    assert sorted((r.a, r.b, r.x, r.y) for r in across.collect()) == [(2, 9, 1, 3), (4, 10, 3, 10), (10, 12, 10, 12)]
    got = minhash._merged(parts, across)
    assert sorted((r.node, r.component) for r in got.collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (6, 6), (7, 6), (9, 1), (10, 1), (12, 1)]
