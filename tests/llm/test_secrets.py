import hashlib
import re

import duckdb
from tables import documents

from sievewright.llm import secrets
from sievewright.llm.common import new_path

HEX = "0123456789abcdef" * 2
ROWS = [
    (1, f'say token = "{HEX}" and PASSWD:abc', "en", "a"), (2, "secret=token:abcdefgh", "en", "a"), (3, "é\U0001f600 api-key=1 apikey = 'abc/+._=-9' AKIA" + "Z" * 16, "en", "a"),
    (4, "AKIAAKIA" + "1" * 15 + " AKIA" + "B" * 20, "en", "a"), (5, HEX[:24] + "g" + HEX[:23], "en", "a"), (6, "", "en", "a"), (7, None, "en", "a"),
    (8, "-----BEGIN RSA PRIVATE KEY----- eyJabc.eyJdef.sig_-1 " + f"token: {HEX}, " * 400, "en", "a"), (9, f'say token = "{HEX}" and PASSWD:abc', "en", "a"),
    (9, f'say token = "{HEX}" and PASSWD:abc', "en", "a"), (None, "Password : \"hunter22\"", None, None), (10, "toKen = abcdefgh paſſword=abcdefgh", "en", "a"),
]


def brute(text):
    out = []
    rules = [("assign", r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    for kind, pattern, group, least in rules:
        # letters in either case: ASCII alone
        out.append([(m.start(), m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least])
    base = sorted((s, k, e) for k, spans in enumerate(out) for s, e in spans)
    digest = hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
    return (*map(len, out), digest)


def test_equals_brute_force_and_sql(spark):
    docs = documents(spark, ROWS).selectExpr("*", "1 AS blob", "2 AS n_hex", "'x' AS spans")
    got = secrets.findings(docs, secrets.Ledger(spark, new_path(spark, "ledger"))).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got), key=key) == sorted(((i, *brute(t or "")) for i, t, *_ in ROWS), key=key)
    assert "pem:0:31" in next(r.spans for r in got if r.doc_id == 8) and "jwt:32:52" in next(r.spans for r in got if r.doc_id == 8)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, *_ in ROWS])
    want = db.sql(f"SELECT doc_id, n_assign, n_access, n_hex, base_sha256, spans FROM ({secrets.SQL})").fetchall()
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got), key=key) == sorted(want, key=key)


def test_only_unseen_pairs_are_scanned(spark):
    ledger = secrets.Ledger(spark, new_path(spark, "ledger"))
    first = documents(spark, ROWS[:4]).select("doc_id", "text")
    secrets.findings(first, ledger, rules=secrets.RULES[:1]).collect()
    assert ledger.scanned().count() == 4
    secrets.findings(documents(spark, ROWS[:6]).select("doc_id", "text"), ledger, rules=secrets.RULES[:1]).collect()
    assert ledger.scanned().count() == 6  # two new blobs
    got = secrets.findings(documents(spark, ROWS).select("doc_id", "text"), ledger).collect()
    rows = ledger.scanned().collect()
    pairs = [(bytes(r.blob), x) for r in rows for x in r.rules]
    assert len(pairs) == len(set(pairs)) == len({(t or "") for _, t, *_ in ROWS}) * len(secrets.RULES)
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted((str(i), *brute(t or "")) for i, t, *_ in ROWS)


def test_no_rows(spark):
    assert secrets.findings(documents(spark, []).select("doc_id", "text"), secrets.Ledger(spark, new_path(spark, "ledger"))).count() == 0
