from pyspark.sql import functions as F

from sievewright.functions.text import locator_id
from sievewright.operators import graph
from sievewright.plans import pipelines
from sievewright.sources import repository

RAW = "ordinal long, worker string, claim string, evidence string, source string, confidence double, canonical_key string, value string"


def raw(spark):
    rows = [(0, "a", "The cache is async", "e", "x.py", 0.9, "cache", "async"), (1, "b", "The cache is sync", "e", "y.py", 0.8, "cache", "sync"), (2, "a", "Retries are bounded", "e1", "z.py", 0.7, None, None), (3, "b", "retries  are bounded", "e2", "z.py", 0.6, None, None),
            (4, "c", "Retries are bounded", "e3", "w.py", 0.5, "r", None), (5, "c", "", "e", "s", 0.5, None, None), (6, "d", "long " * 2000, "e", "s", 0.4, None, None)]
    return spark.createDataFrame(rows, RAW)


def test_reduction_and_packet(spark):
    r = pipelines.reduce_findings(raw(spark), provider="lexical")
    stats = r.stats.first()
    assert (stats.extracted, stats.malformed, stats.valid, stats.output, stats.duplicates, stats.max_agreement) == (7, 1, 6, 5, 1, 2)
    assert [c.identity for c in r.contradictions.collect()] == ["canonical:cache"]
    assert r.merged.count() == 4 and r.merged.agg(F.max("merged_findings")).first()[0] == 2
    packet = pipelines.synthesis_packet(r, limit=200)
    got = [(p.packet_rank, p.claim, p.ref) for p in packet.orderBy("packet_rank").collect()]
    assert [g[1:] for g in got] == [("Retries are bounded", "S1"), ("long " * 1999 + "long", "S2")][: len(got)]
    seen, side = pipelines.thin(packet)
    assert "source" not in seen.columns and side.count() == len(got) and seen.orderBy("packet_rank").first().agreement_count == 3
    assert pipelines.reduce_findings(raw(spark)).merged.count() == 5


def repo(spark, tmp_path):
    texts = {"src/index.js": "import { pay } from './pay.js'\npay(1)\n", "src/pay.js": "export function pay(a) {\n  return charge(a)\n}\nexport function charge(b) {\n  return b\n}\n", "src/other.js": "export const nothing = () => {\n}\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = repository.read_files(spark, str(tmp_path))
    return files, repository.build_index(files)


def test_repository_to_context(spark, tmp_path):
    files, index = repo(spark, tmp_path)
    links = graph.resolve_imports(index.select(F.col("path").alias("src"), F.explode("imports").alias("spec")), files)
    edges = links.where("kind = 'edge'").select("src", "dst")
    assert [tuple(r) for r in edges.collect()] == [("src/index.js", "src/pay.js")]
    degree = graph.degrees(files.select(F.col("path").alias("node")), edges)
    distance = graph.distances(edges, index.where("entry_point").select(F.col("path").alias("node")))
    named = index.withColumns({"symbols": F.array_join("symbols", " "), "imports": F.array_join("imports", " ")})
    ranked = graph.rank_files(named, degree, distance, "charge payment")
    assert [r.path for r in graph.ranked(ranked).collect()] == ["src/index.js", "src/pay.js", "src/other.js"]
    assert ranked.where("path = 'src/pay.js'").first().matched_terms == ["charge"]
    symbols = index.select("path", F.explode("symbol_details").alias("s")).select("path", "s.name", "s.estimated_tokens")
    chosen, picked, seen = pipelines.context_pack(ranked, symbols, "charge payment")
    assert chosen.count() == 3 and picked.orderBy("place").first().name == "charge" and seen.first().coverage.matched == ["charge"]
    places = repository.locators(index)
    none = spark.createDataFrame([], "id string")
    found = pipelines.recall_context(places, files, "charge", none, none, edges).orderBy("place").collect()
    assert found[0].symbol == "charge" and found[0].content.startswith("export function charge") and all(f.path == "src/pay.js" for f in found)
    active = places.where("symbol = 'charge'").select(locator_id(F.col("path"), F.col("symbol"), F.col("start_line"), F.col("end_line")).alias("id"))
    assert "charge" not in {f.symbol for f in pipelines.recall_context(places, files, "charge", active, none, edges).collect()}
    got = pipelines.read_symbol(index, files, "src/pay.js", "pay").first()
    assert got.content == "export function pay(a) {\n  return charge(a)\n}"


def test_claims(spark, tmp_path):
    texts = spark.createDataFrame([("a.tsx", "import { getSheet } from './m'\n<p>中文字</p>\n"), ("b.ts", "getSheet('x')\n@media screen")], "path string, text string")
    claim = "The mobile panel uses getSheet"
    seen, status = pipelines.claim_recall(claim, texts.where("path = 'a.tsx'"))
    assert {r.requirement_id: r.status for r in seen.collect()} == {"responsive-variants": "checked-no-match", "responsive-base": "checked-no-match", "runtime-usage-1": "challenge-signal"}
    assert status.first().status == "challenged"
    seen, status = pipelines.claim_recall(claim, texts)
    assert (status.first().counter, status.first().challenge) == (1, 0)
    assert pipelines.claim_recall("All copy is fully localized", texts)[1].first().status == "challenged"
    assert pipelines.claim_requirements("plain words here") == [("claim-context", "context", "(?i)plain|words|here")]
    assert pipelines.trim_observations(seen, 1).count() >= 1


def test_handoff_ledger_and_cases(spark):
    rows = spark.createDataFrame([("r", "done all", ["a", "a", "b" * 5], None, ["q"])], "role string, result string, facts array<string>, warnings array<string>, unknowns array<string>")
    out = pipelines.handoff(rows, most_chars=3).first()
    assert (out.role, out.summary, out.evidence, out.risks, out.open_questions) == ("r", "don…", ["a", "bbb…"], [], ["q"])
    ledger = spark.createDataFrame([("a", "1", "x"), ("b", "1", "line\n" * 60)], "key string, fingerprint string, content string")
    now = spark.createDataFrame([("a", "1", "x"), ("b", "2", "line\n" * 59 + "new\n"), ("c", "1", "z")], "key string, fingerprint string, content string")
    assert {r.key: r.delivery for r in pipelines.symbol_with_ledger(now, ledger).collect()} == {"a": "omit", "b": "delta", "c": "full"}
    cases = spark.createDataFrame([("one", ["a"], ["z"]), ("two", ["a", "b"], [])], "case string, required array<string>, forbidden array<string>")
    claims = spark.createDataFrame([("one", "a"), ("two", "a")], "case string, claim string")
    assert {r.case: (r.passed, r.missing) for r in pipelines.case_results(cases, claims).collect()} == {"one": (True, []), "two": (False, ["b"])}
    paths = spark.createDataFrame([("client/a",), ("server/b",), ("api/c",), ("x",)], "path string")
    assert pipelines.contract_pairs(paths).count() == 2
