from pyspark.sql import functions as F

from sievewright.operators import graph, harness, telemetry, views
from sievewright.sources import events


def test_index_views(spark):
    files = spark.createDataFrame([("src/a.js", False), ("src/b.js", False), ("packages/x/package.json", True), ("tools/y/package.json", True), ("package.json", True)], "path string, manifest boolean")
    edges = spark.createDataFrame([("src/a.js", "src/b.js"), ("src/c.js", "src/a.js")], "src string, dst string")
    assert [(r.folder, r.files) for r in views.directory_counts(files).collect()][0] == ("src", 2)
    assert [r.path for r in views.module_map(files, "./src/").collect()] == ["src/a.js", "src/b.js"]
    assert sorted(map(tuple, views.dependencies(edges, "src/a.js").collect())) == [("src/b.js", "imports"), ("src/c.js", "imported-by")]
    hit = views.impact(edges, spark.createDataFrame([("src/b.js",)], "path string"), 2)
    assert {r.path: r.changed for r in hit.collect()} == {"src/b.js": True, "src/a.js": False, "src/c.js": False}
    assert [r.folder for r in views.workspaces(files).collect()] == ["packages/x"]
    assert [r.folder for r in views.workspaces(files, ["tools/*"]).collect()] == ["tools/y"]


def test_capabilities(spark):
    rows = [("native", ["s", "g"], "native", True, False), ("fast", ["s"], "plugin", True, False), ("odd", ["s"], "plugin", False, True), ("pick", ["g"], "plugin", True, True)]
    p = spark.createDataFrame(rows, "id string, capabilities array<string>, source_type string, trusted boolean, preferred boolean")
    assert [views.resolve(p, c).first().id for c in ("s", "g")] == ["fast", "pick"]
    assert views.resolve(p, "none").count() == 0
    assert {r.capability: r.providers for r in views.overlaps(p).collect()} == {"s": 3, "g": 2}


def test_problem_paths_take_turns(spark):
    rows = [("p1", 1, "a", 9.0), ("p1", 1, "b", 8.0), ("p2", 2, "a", 7.0), ("p2", 2, "c", 1.0)]
    got = views.problem_paths(spark.createDataFrame(rows, "problem_id string, ordinal int, path string, rank_score double")).orderBy("place").collect()
    assert [(r.path, r.mandatory) for r in got] == [("a", True), ("b", False), ("c", False)]
    problems = spark.createDataFrame([("p1", ["login"]), ("p2", ["pay"]), ("p3", ["none"])], "problem_id string, terms array<string>")
    evidence = spark.createDataFrame([("e1", "Login form", True), ("e2", "pay flow", False)], "context_id string, text string, selected boolean")
    assert {r.problem_id: r.status for r in views.problem_status(problems, evidence).collect()} == {"p1": "covered", "p2": "queued", "p3": "unresolved"}


def test_schedules_and_lanes(spark):
    nodes, needs = harness.schedule(spark, "complex", security=True)
    waves = {r.node: r.wave for r in graph.levels(nodes, needs).collect()}
    assert waves == {"plan": 0, "research": 1, "implement": 2, "test": 3, "security": 3, "grade": 4}
    lanes = harness.lane_budgets(nodes)
    assert lanes.agg(F.sum("context_tokens"), F.sum("output_tokens")).first() == (12_000, 4_000)
    thin = {r.node: r.context_tokens for r in harness.thin_lane_budgets(lanes, "full").collect()}
    assert sum(thin.values()) == 12_000 and thin["grade"] == 1200


def test_usage_and_events(spark, tmp_path):
    row = spark.range(1).select(telemetry.reported_usage(F.lit(7), F.lit(-1), F.lit("abc"), F.lit("abcde")).alias("u"), telemetry.planes(F.lit("abcd"), F.lit("abcdefgh")).alias("p"), telemetry.ratios(F.lit(10), F.lit(4), F.lit(6), F.lit(9)).alias("r")).first()
    assert tuple(row.u) == (7, 2, 9, "provider-reported", "estimated") and tuple(row.p) == (1, 1, 2) and tuple(row.r) == (0.4, 1.0)
    path = str(tmp_path / "log")
    events.append_trace(spark.createDataFrame([("r1", "start", "{}"), ("r2", "end", "x")], "run_id string, kind string, data string"), path, F.lit(5))
    (tmp_path / "log" / "bad.json").write_text("{broken\n\n[1]\n")
    assert sorted((r.run_id, r.kind, r.ts) for r in events.read_trace(spark, path).collect()) == [("r1", "start", 5.0), ("r2", "end", 5.0)]
    a = events.artifacts(spark.createDataFrame([('{"a":1}',)], "payload string"), "plan", "me", F.lit(1)).first()
    assert a.bytes == 7 and a.estimated_tokens == 2 and a.id.startswith("plan-")
