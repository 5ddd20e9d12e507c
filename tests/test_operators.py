import random

import pytest
from pyspark.sql import functions as F

from sievewright.operators import budget, contracts, graph, harness, recall, state, telemetry


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    parent = {i: i for p in links for i in p if p[0] != p[1]}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    assert {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()} == {i: root(i) for i in parent}


def test_specs(spark):
    cases = [("src/a/x.js", "./y", "src/a/y"), ("src/a/x.js", "../y.js", "src/y.js"), ("x.js", "../../y", "y"), ("src/x.js", "/lib/y", "lib/y"), ("p/q/x.py", ".m.n", "p/q/m/n"), ("p/q/x.py", "..m", "p/m"), ("x.py", "os", None), ("a/x.js", "./", "a")]
    got = spark.createDataFrame(cases, "s string, i string, w string").select("w", graph.normalized_spec(F.col("s"), F.col("i")).alias("g")).collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_imports_resolve_in_order(spark):
    files = spark.createDataFrame([(p,) for p in ("src/y.ts", "src/y.js", "src/z/index.js", "src/p/__init__.py", "src/x.js", "src/d.css")], "path string")
    imports = spark.createDataFrame([("src/x.js", s) for s in ("./y", "./z", "./p", "./d.css", "./none", "react")], "src string, spec string")
    got = {r.spec: (r.dst, r.kind) for r in graph.resolve_imports(imports, files).collect()}
    assert got == {"./y": ("src/y.js", "edge"), "./z": ("src/z/index.js", "edge"), "./p": ("src/p/__init__.py", "edge"), "./d.css": ("src/d.css", "edge"), "./none": (None, "unresolved"), "react": (None, "external")}


def test_graph_walks(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("x", "y")], "src string, dst string")
    assert {r.node: r.distance for r in graph.distances(edges, spark.createDataFrame([("a",)], "node string")).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert sorted(r.node for r in graph.neighbourhood(edges, spark.createDataFrame([("d",)], "node string"), 1).collect()) == ["a", "d"]
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(spark.createDataFrame([("a",), ("b",)], "node string"), spark.createDataFrame([("a", "b"), ("b", "a")], "node string, on string"))


def test_budgets(spark):
    rows = spark.createDataFrame([("g", i, c) for i, c in enumerate((5, 30, 4, 40, 1))], "g string, i long, c long")
    assert [r.i for r in budget.prefix(rows, ["g"], ["i"], "c", F.lit(36)).where("selected").orderBy("i").collect()] == [0, 1]
    assert budget.skip(rows, "g", "i", "c", 40).first().taken == [0, 1, 2, 4]
    assert budget.skip(rows, "g", "i", "c", 40, most=2).first().taken == [0, 1]
    assert [r.batch for r in budget.next_fit(rows, "g", "i", "c", 40).orderBy("i").collect()] == [1, 1, 1, 2, 3]
    assert [r.i for r in budget.trim_tail(rows, ["g"], ["i"], "c", 1).collect()] == [0]


def test_largest_remainder(spark):
    rows = spark.createDataFrame([("g", i, w) for i, w in enumerate((1.0, 1.0, 1.0))], "g string, i long, w double")
    assert [r.allocated for r in budget.largest_remainder(rows, ["g"], "i", "w", F.lit(11)).orderBy("i").collect()] == [4, 4, 3]


def test_recall(spark):
    cols = "path string, symbol string, signature string, kind string, start_line int, end_line int, neighbour boolean"
    rows = [("src/pay.py", "charge", "charge(x)", "symbol", 5, 9, False), ("src/pay.py", None, None, "file", None, None, False), ("src/other.py", "misc", "", "symbol", 1, 2, True), ("src/charge_it.py", None, None, "file", None, None, True)]
    scored = recall.scored(spark.createDataFrame(rows, cols), "charge")
    assert [r.score for r in scored.collect()] == [100 + 55 + 15 + 5, 0, 0, 9 + 7]
    kept = recall.pruned(recall.with_hits(scored, spark.createDataFrame([("src/pay.py", 7)], "path string, line int"))).collect()
    assert [(r.path, r.kind, r.score, r.lines) for r in kept] == [("src/pay.py", "symbol", 175 + 65, [7])]


def test_grep_and_observations(spark):
    files = spark.createDataFrame([("a", "x\nTODO\ny\nTODO\nTODO\nTODO"), ("b", "nothing"), ("c", None)], "path string, content string")
    assert [(r.path, r.line) for r in recall.grep(recall.lines_of(files), "TODO").collect()] == [("a", 2), ("a", 4), ("a", 5)]
    needs = [("r1", "challenge-if-match", "TODO"), ("r2", "support-if-match", "absent"), ("r3", "challenge-if-no-match", "absent"), ("r4", "context", "nothing")]
    seen = recall.observe(needs, files.withColumnRenamed("content", "text"))
    assert {r.requirement_id: r.status for r in seen.collect()} == {"r1": "challenge-signal", "r2": "checked-no-match", "r3": "challenge-signal", "r4": "evidence-found"}
    assert recall.verification_status(seen).first().status == "challenged"


def test_state(spark):
    ledger = spark.createDataFrame([("a", "1"), ("b", "1")], "key string, fingerprint string")
    items = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "key string, fingerprint string")
    assert {r.key: r.status for r in state.compare(items, ledger).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    assert {r.key: r.fingerprint for r in state.upsert(ledger, items).collect()} == {"a": "1", "b": "2", "c": "1"}
    assert state.compare(items, ledger.where("false")).where("status = 'new'").count() == 3
    diff = spark.createDataFrame([("a\nb", "a\nc")], "o string, n string").select(state.unified_diff("o", "n").alias("d")).first().d
    assert "-b" in diff and "+c" in diff


def test_harness(spark):
    rows = [("fix typo",), ("Refactor the authentication architecture across the repo, maybe from scratch",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(harness.complexity(F.col("t")).alias("c"), harness.risk(F.col("t")).alias("r"), harness.route(F.col("t")).alias("p")).collect()
    assert [r.c.level for r in got] == ["trivial", "autonomous", "trivial"] and [r.r.level for r in got] == ["low", "high", "low"]
    assert [r.p for r in got] == ["understand"] * 3
    tiers = spark.range(1).select(harness.model_tiers(F.lit("complex"), harness.risk(F.lit("rm -rf and payment"))).alias("m")).first().m
    assert tuple(tiers) == ("strong", "standard", "strong")
    tries = spark.range(1).select(harness.retry(F.lit("reject"), F.lit(1), F.lit("cheap"), F.lit("low"), F.lit("focused")).alias("a"), harness.retry(F.lit("uncertain"), F.lit(1), F.lit("cheap"), F.lit("low"), F.lit("focused")).alias("b"), harness.retry(F.lit("reject"), F.lit(2), F.lit("cheap"), F.lit("high"), F.lit("focused")).alias("c")).first()
    assert [tuple(x) for x in tries] == [("retry", "cheap"), ("retry", "standard"), ("human-review", None)]
    assert spark.range(1).select(harness.fan_out(F.lit(0.5), F.lit(5), F.lit(1)).alias("n"), harness.fan_out(F.lit(0.9), F.lit(5), F.lit(1)).alias("m")).first() == (2, 0)


def test_simulation_matches_published_totals(spark):
    """Totals that the baseline publishes for its seven scenarios."""
    p = harness.projections(spark.createDataFrame(list(harness.SCENARIOS), harness.SCENARIO_COLUMNS))
    totals = {r.mode: r.t for r in p.groupBy("mode").agg(F.sum("total_tokens").alias("t")).collect()}
    assert totals == {"direct": 110_262, "light": 115_847, "full": 129_201}
    assert harness.chosen(p).agg(F.sum("selected_tokens")).first()[0] == 123_936


def test_telemetry_and_contracts(spark):
    calls = spark.createDataFrame([("a", True, 1.0), ("a", False, 3.0), ("a", True, None), ("b", True, 1.0)], "provider string, success boolean, latency_ms double")
    got = {r.provider: (r.success_rate, r.healthy, r.penalty, r.avg_latency_ms) for r in telemetry.health(calls).collect()}
    assert got == {"a": (0.6667, True, 6.666, 2.0), "b": (1.0, None, 0.0, 1.0)}
    answer = spark.range(1).select(telemetry.evaluate_answer(F.lit("Uses OAuth"), ["oauth", "token"], ["password"]).alias("e")).first().e
    assert tuple(answer) == (["token"], [], False)
    rows = spark.createDataFrame([("c", "e", "s", 0.5), (" ", None, "s", 2.0)], "claim string, evidence string, source string, confidence double")
    assert [r.errors for r in contracts.errors(rows, "finding").collect()] == [[], ["claim must be non-empty", "evidence must be non-empty", "confidence must be within 0..1"]]
    assert contracts.registry(spark).count() == len(contracts.CONTRACTS)
    with pytest.raises(ValueError, match="no such contract"):
        contracts.errors(rows, "none")


def test_a_long_chain_has_no_cap(spark):
    n = 70
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    got = {r.node: r.distance for r in graph.distances(chain, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {i: i for i in range(n + 1)}
    assert graph.distances(chain, spark.createDataFrame([(0,)], "node long"), 2).count() == 3


def test_deep_levels_and_foreign_needs(spark):
    n = 68
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    needs = spark.createDataFrame([(i + 1, i) for i in range(n - 1)] + [(n + 5, 0)], "node long, on long")
    assert {r.node: r.wave for r in graph.levels(nodes, needs).collect()} == {i: i for i in range(n)}
    assert graph.levels(nodes.where("false"), needs).count() == 0


def test_skip_streams_groups(spark):
    rows = [("a", 1, 50), ("a", 2, 20), ("a", 3, 10), ("b", 1, 70), (None, 1, 5), ("a", 4, None), (None, 2, 56)]
    got = {r.g: (list(r.taken), r.used) for r in budget.skip(spark.createDataFrame(rows, "g string, o int, c int"), "g", "o", "c", 60).collect()}
    assert got == {"a": ([1, 3, 4], 60), "b": ([], 0), None: ([1], 5)}
    one = budget.skip(spark.createDataFrame(rows, "g string, o int, c int").where("g = 'a'"), "g", "o", "c", 60, most=1).first()
    assert list(one.taken) == [1]
