import json

import pytest
from pyspark.sql import functions as F

from sievewright.operators import findings
from sievewright.sources import repository, worker_input

OUTPUTS = [
    {"worker": "a", "findings": [{"claim": "c1", "evidence": "e", "source": "s", "confidence": 0.9, "value": 1}, "just text"]},
    {"handoff": {"facts": [{"fact": "f", "detail": "d", "file": "x.py", "value": True, "canonicalKey": "k"}]}, "role": " "},
    {"claim": "alone", "evidence": "e", "source": "s"}, {"nothing": 1},
]


@pytest.mark.parametrize("form", ["ndjson", "array", "wrapped"])
def test_worker_outputs(spark, tmp_path, form):
    path = tmp_path / ("in.ndjson" if form == "ndjson" else "in.json")
    path.write_text("# note\n\n" + "\n".join(map(json.dumps, OUTPUTS)) if form == "ndjson" else json.dumps(OUTPUTS if form == "array" else {"worker_outputs": OUTPUTS}))
    raw = worker_input.raw_findings(worker_input.read(spark, str(path)))
    got = [(r.worker if r.worker != "worker-1" else "w", r.claim, r.source, r.malformed_reason is None) for r in findings.normalize(raw).orderBy("ordinal").collect()]
    names = [g[0] for g in got]
    assert names[:2] == ["a", "a"] and all(n.startswith("w") for n in names[2:])
    assert [g[1:] for g in got] == [("c1", "s", True), ("just text", "worker:a", True), ("f", "x.py", True), ("alone", "s", True), ("", "", False)]


def test_bad_line_is_an_error(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"claim": 1}\n{oops\n')
    with pytest.raises(Exception, match="not JSON"):
        worker_input.read(spark, str(tmp_path / "bad.jsonl")).collect()
    assert worker_input.input_format("-") == "ndjson" and worker_input.input_format("x.JSONL") == "ndjson" and worker_input.input_format("x.json") == "json"


PYTHON = "import os\nfrom . import util\nfrom ..a import b\n\nLIMIT = 1\n\nclass Cart(Base):\n    def total(self, tax):\n        return 1\n"
JS = "import x from './svc/order.js'\nconst y = require('lib')\nexport class Api {\n  go() {}\n}\nexport const run = async (a,\n  b) => {\n  return 1\n}\nrouter.get('/pay', run)\n"


def test_parsers():
    p = repository.summarize("a/b.py", PYTHON)
    assert p["imports"] == ["os", ".", "..a"] and p["classes"] == ["Cart"] and p["functions"] == ["total(self, tax)"] and p["types"] == ["LIMIT"] and p["parser"] == "python-ast"
    j = repository.summarize("a.js", JS)
    assert j["imports"] == ["./svc/order.js", "lib"] and j["classes"] == ["Api"] and j["functions"] == ["run(a, b)"] and j["routes"] == ["GET /pay"] and j["exports"] == ["Api", "run"]
    assert repository.summarize("a.c", '#include "x.h"\n#include <y.h>\nint main(int argc) {\n if (a) {\n}')["functions"] == ["main(int argc)"]
    assert repository.summarize("a.sql", "CREATE OR REPLACE VIEW v.x AS\ncreate function f() returns int")["types"] == ["v.x"]
    assert repository.summarize("a.ps1", "function Get-It {\n}\nImport-Module Mod")["functions"] == ["Get-It()"]
    assert repository.summarize("a.sh", "source ./lib.sh\nrun() {\n}\nfunction go {\n}")["symbols"] == ["run", "go"]
    assert repository.summarize("bad.py", "def (")["parser"] == "heuristic" and repository.summarize("x", "")["lines"] == 0
    spans = [(s["name"], s["kind"], s["start_line"], s["end_line"]) for s in repository.symbols("a.py", PYTHON)]
    assert spans == [("Cart", "class", 7, 9), ("total", "function", 8, 9)]
    assert [(s["name"], s["start_line"], s["end_line"]) for s in repository.symbols("a.js", JS)][0] == ("Api", 3, 5)


def test_repository(spark, tmp_path):
    files = {"src/index.js": JS, "src/svc/order.js": "export function pay(a) { return a }\n", "pkg/m.py": PYTHON, "package.json": "{}", "node_modules/x.js": "x", ".env": "A=1", "src/gen/y.js": "x", "pic.png": "x",
             "bin.py": "a\0b", "made.py": "# Code generated, do not edit\n", "docs/plan.md": "# One\ntext\n## Two\n", "readme.md": "hi", "big.py": "x" * 2000, "src/latin.py": None}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x = '\xe9'\n" if text is None else text.encode())
    all_ = repository.read_files(spark, str(tmp_path), max_bytes=1500)
    skipped = {r.path: r.skipped for r in all_.collect()}
    assert {k: v for k, v in skipped.items() if v} == {"node_modules/x.js": "ignored", ".env": "ignored", "src/gen/y.js": "generated", "pic.png": "irrelevant", "bin.py": "binary", "made.py": "generated-content", "big.py": "large"}
    index = {r.path: r for r in repository.build_index(all_).collect()}
    assert set(index) == {k for k, v in skipped.items() if not v}
    assert index["src/index.js"].entry_point and index["src/index.js"].static_importance == 25 + 5 + 2 + 2 + 2 and index["package.json"].manifest
    assert [(r.path, r.headings) for r in repository.knowledge(all_).collect()] == [("docs/plan.md", ["One", "Two"]), ("readme.md", [])]
    places = repository.locators(repository.build_index(all_))
    assert places.where("kind = 'symbol' AND path = 'src/svc/order.js'").select("symbol").collect()[0][0] == "pay"


def test_stream_equals_batch(spark, tmp_path):
    from sievewright.streaming import fanin

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.ndjson").write_text("\n".join(json.dumps({"worker": f"w{i % 4}", "claim": f"c{i % 5}", "evidence": f"e{i % 2}", "source": f"s{i % 3}", "confidence": (i % 10) / 10}) for i in range(k * 10, k * 10 + 10)))
    batch = findings.normalize(worker_input.raw_findings(worker_input.read_ndjson(spark, str(tmp_path / "in"))))
    stream = findings.normalize(worker_input.raw_findings(worker_input.stream_ndjson(spark, str(tmp_path / "in"))))
    cols = ["group_key", "occurrence_count", "workers", "independent_source_count", "independent_evidence_count"]
    got = sorted(map(tuple, fanin.run(stream, "test").select(*cols).collect()))
    assert got == sorted(map(tuple, findings.groups(batch).select(*cols).collect())) and len(got) == 5
    assert batch.select(F.sum("confidence")).first()[0] > 0


def test_stream_equals_batch_after_each_file_and_a_restart(spark, tmp_path):
    from sievewright.streaming import fanin

    folder, state = tmp_path / "in", f"file://{tmp_path}/state"
    folder.mkdir()
    cols = ["group_key", "assertion_key", "occurrence_count", "workers", "independent_source_count", "independent_evidence_count"]
    for k in range(4):
        lines = [{"findings": [{"claim": f"c{i % 3}", "evidence": f"e{i % 4}", "source": f"s{i % 5}", "confidence": (i % 7) / 10, "value": i % 2}]} | ({} if i % 4 == 0 else {"worker": f"w{i % 6}"}) for i in range(k * 20, k * 20 + 20)]
        (tmp_path / "new").write_text("# note\n\n" + "\n".join(map(json.dumps, lines)))
        (tmp_path / "new").rename(folder / f"{9 - k}.ndjson")
        batch = findings.normalize(worker_input.raw_findings(worker_input.read_ndjson(spark, str(folder))))
        want = findings.groups(batch)
        for again in range(2 if k == 1 else 1):  # started again with nothing new
            stream = findings.normalize(worker_input.raw_findings(worker_input.stream_ndjson(spark, str(folder))))
            got = fanin.run(stream, "test", path=state)
            assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
            best = lambda df, c: {(r.group_key, r.assertion_key): tuple(r[c]) for r in df.withColumn("o", F.col(c)).collect()}
            assert best(got, "best") == {k: tuple(v) for k, v in (((r.group_key, r.assertion_key), r.best.ordinal) for r in want.collect())}
    names = {r.worker for r in batch.collect()}
    assert {"9.ndjson:worker-1", "6.ndjson:worker-17", "w1"} <= names and len(names) == 6 + 20
    one = worker_input.raw_findings(worker_input.read_ndjson(spark, str(folder / "9.ndjson")))
    assert {r.worker for r in one.collect()} == {*(f"w{i}" for i in range(6)), *(f"worker-{i}" for i in (1, 5, 9, 13, 17))}


def test_bad_lines_of_a_stream_are_errors(spark, tmp_path):
    from sievewright.streaming import fanin

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text('{"claim": "x"}\n\n{oops\n')
    stream = findings.normalize(worker_input.raw_findings(worker_input.stream_ndjson(spark, str(tmp_path / "in"))))
    with pytest.raises(Exception, match="invalid NDJSON at line 3 of a.ndjson"):
        fanin.run(stream, "test", path=f"file://{tmp_path}/state")


def test_declarations_of_other_languages():
    assert repository.summarize("a.rs", "pub fn new(a: u8) {\n}\nuse std::io;\nstruct A;")["functions"] == ["new(a: u8)"]
    assert repository.summarize("a.swift", "import X\nfunc go(a: Int) {\n}") == {"imports": [], "classes": [], "types": [], "functions": ["go(a: Int)"], "exports": [], "routes": [], "symbols": ["go"], "lines": 3, "parser": "heuristic"}
    j = repository.summarize("A.java", "import a.b;\nclass A {\n  if (x) {}\n  return new B(x);\n  y = new (3)\n}\n@Get('/x') @post('/y')\n[HttpDelete]")
    assert j["imports"] == ["a.b"] and j["functions"] == ["B(x)", "Get('/x')"] and j["routes"] == ["GET /x", "DELETE"]
    assert repository.summarize("a.go", 'import f "fmt"\nfunc (s *T) Run(a int) error {')["imports"] == ["fmt"]
    assert repository.summarize("a.ps1", ". .\\lib\\x.ps1\nImport-Module 'Mod'")["imports"] == ["./lib/x.ps1", "Mod"]
    assert repository.summarize("a.sh", ". $HOME/x\nsource 'y.sh'")["imports"] == ["y.sh"]
    joined = repository.summarize("a.js", "function wide(\n  a,\n  b\n) {}\n# note\n// function no() {}\n")
    assert joined["functions"] == ["wide( a, b )"]


def test_version_control(spark, tmp_path):
    import subprocess

    from sievewright.sources import version_control as vc

    assert vc.listing(spark, str(tmp_path)) is None and vc.repository_identity(spark, str(tmp_path)).first().git_available is False
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "sub").mkdir()
    for name, text in (("a.txt", "one\n"), ("sub/b.txt", "é"), (".gitignore", "skip.txt\n"), ("skip.txt", "x")):
        (tmp_path / name).write_text(text)
    git("add", ".")
    git("commit", "-q", "-m", "first")
    (tmp_path / "a.txt").write_text("two\n")
    (tmp_path / "sub" / "new.txt").write_text("n")
    assert {r.path: r.bytes for r in vc.listing(spark, str(tmp_path)).collect()} == {"a.txt": 4, "sub/b.txt": 2, ".gitignore": 9, "sub/new.txt": 1}
    assert [r.path for r in vc.changed(spark, str(tmp_path)).orderBy("path").collect()] == ["a.txt", "sub/new.txt"]
    assert {r.path for r in vc.listing(spark, str(tmp_path / "sub")).collect()} == {"b.txt", "new.txt"}
    who = vc.repository_identity(spark, str(tmp_path / "sub")).first()
    assert (who.git_available, who.subpath, who.branch, who.dirty) == (True, "sub", "main", True) and len(who.commit) == 40
    files = spark.createDataFrame([("a.txt", "two\n"), ("sub/b.txt", "é"), ("sub/new.txt", "n")], "path string, content string")
    got = {r.path: r for r in vc.file_provenance(files, *vc.blobs(spark, str(tmp_path)), who.commit).collect()}
    assert [(got[p].source, got[p].tracked, got[p].dirty) for p in ("a.txt", "sub/b.txt", "sub/new.txt")] == [("working-tree", True, True), ("HEAD", True, False), ("working-tree", False, True)]
    blob = subprocess.run(["git", "-C", str(tmp_path), "hash-object", "a.txt"], capture_output=True, text=True).stdout.strip()
    assert got["a.txt"].blob == blob
    symbols = spark.createDataFrame([("a.txt", "x", 1, 1, "f")], "path string, name string, start_line int, end_line int, fingerprint string")
    assert vc.symbol_provenance(symbols, spark.createDataFrame([tuple(got["a.txt"])], "path string, content string, working_blob string, head_blob string, index_blob string, tracked boolean, dirty boolean, commit string, blob string, source string")).first().blob == blob
