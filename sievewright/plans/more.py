"""Further operators as queries, on the test tables or on the literal ones of plans.fixtures, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budget, candidates, contracts, evidence, findings, graph, harness, packets, planning, recall, state, telemetry, views
from ..sources import events, repository, version_control, worker_input
from ..tables import new_path, written
from . import pipelines, queries
from .fixtures import MAX_BYTES, REPOSITORY, folder, literal, table, values
from .oracles import DOC_GROUPS, LOCATORS, PARTS, PATH, QUERY_TERMS, any_of, quoted, tokens
from .queries import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Register a query under its function's name, with SQL for its rows."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def joined(column: str, by: str = "|"):
    return F.array_join(column, by).alias(column.rsplit(".", 1)[-1])


# --- functions of texts

FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, CASE WHEN length({FLAT}) > 40 THEN left({FLAT}, 40) || '…' ELSE {FLAT} END AS short FROM conversations")
def compact_texts(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.compact(F.col("text"), 40).alias("short"))


WORDS = "list_filter(string_split(text, ' '), lambda x: trim(x, chr(10) || chr(9) || ' ') <> '')"


@query(f"SELECT conv_id, turn, array_to_string(list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 12), ' ') AS words FROM (SELECT conv_id, turn, list_transform({WORDS}, lambda x: trim(x, chr(10) || chr(9) || ' ')) AS w FROM conversations)")
def distinct_words(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.distinct_texts(F.split("text", " "), 12), " ").alias("words"))


@query("SELECT p_partkey, round(1.0::DOUBLE - exp(-greatest(0, p_size - 20)::DOUBLE / 24.0::DOUBLE), 5) AS relevance FROM part")
def relevance_of_scores(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", evidence.relevance(F.col("p_size") - 20).alias("relevance"))


@query("""SELECT p_partkey, round(greatest(0.0::DOUBLE, p_size / 50.0::DOUBLE) * greatest(0.05::DOUBLE, (p_partkey % 7) / 7.0::DOUBLE) * greatest(0.05::DOUBLE, (p_partkey % 5) / 5.0::DOUBLE)
 * (0.5::DOUBLE + CASE WHEN p_partkey % 4 = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1 + p_partkey % 4) END) / greatest(1.0::DOUBLE, log2(greatest(2, p_partkey % 300)::DOUBLE)), 6) AS voi FROM part""")
def information_value(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    distance = F.when(F.pmod(k, F.lit(4)) != 0, F.pmod(k, F.lit(4)))
    return p.select("p_partkey", T.value_of_information(F.col("p_size") / 50.0, F.pmod(k, F.lit(7)) / 7.0, F.pmod(k, F.lit(5)) / 5.0, distance, F.pmod(k, F.lit(300))).alias("voi"))


_TERMS = ["steel", "part", "brass", "login", "polished", "part"]


@query(f"""SELECT p_partkey, array_to_string(list_filter(['steel', 'part', 'brass', 'login', 'polished'], lambda t: contains(lower(p_name || ' ' || p_type), t)), ' ') AS matched,
 round(len(list_filter(['steel', 'part', 'brass', 'login', 'polished'], lambda t: contains(lower(p_name || ' ' || p_type), t))) / 5.0::DOUBLE, 3) AS score FROM part""")
def term_coverage(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("c", T.coverage(F.array(*map(F.lit, _TERMS)), F.lower(F.concat_ws(" ", "p_name", "p_type"))))
    return p.select("p_partkey", F.array_join("c.matched", " ").alias("matched"), F.col("c.score").alias("score"))


@query("SELECT p_partkey, lower(trim(string_split(p_name, ' ')[-1], ':')) AS name FROM part")
def entry_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", evidence.entry_name(F.concat("p_name", F.lit(": (a, b)"))).alias("name"))


@query(f"SELECT p_partkey, 'ctx:' || left(sha256(path || '#' || replace(p_name, ' ', '_') || ':' || start_line || '-' || end_line), 20) AS id FROM ({LOCATORS}) JOIN part USING (p_partkey)")
def locator_ids(spark, sf_dir):
    return queries.part_locators(spark, sf_dir).select("p_partkey", T.locator_id(F.col("path"), F.col("symbol"), F.col("start_line"), F.col("end_line")).alias("id"))


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(coalesce(text, ''))) || chr(0)) || encode(coalesce(text, ''))) AS blob FROM documents")
def blob_ids(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", version_control.blob_id(F.coalesce("text", F.lit(""))).alias("blob"))


@query("SELECT conv_id, turn, contains(lower(text), 'quality') AND NOT contains(lower(text), 'zzz') AS passed, CASE WHEN contains(lower(text), 'quality') THEN '' ELSE 'Quality' END AS missing FROM conversations")
def answer_invariants(spark, sf_dir):
    out = read(spark, sf_dir, "conversations").withColumn("e", telemetry.evaluate_answer(F.col("text"), ["Quality"], ["ZZZ"]))
    return out.select("conv_id", "turn", F.col("e.passed").alias("passed"), F.array_join("e.missing", ",").alias("missing"))


# --- findings, packets, handoffs


def _pairs_by_name(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("id", "revision", "side", "content_sha256")]
    rows = p.select("p_partkey", F.col("p_brand").alias("id"), F.when(F.pmod("p_partkey", F.lit(3)) != 0, F.col("p_type")).alias("revision"), F.when(F.pmod("p_partkey", F.lit(4)) != 0, F.pmod("p_size", F.lit(3)).cast("string")).alias("side"), F.when(F.pmod("p_partkey", F.lit(5)) != 0, F.col("p_name")).alias("content_sha256"))
    return rows.select("p_partkey", *side("left")).join(rows.select((F.col("p_partkey") - 1).alias("p_partkey"), *side("right")), "p_partkey")


@query("""WITH r AS (SELECT p_partkey, p_brand AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS rv, CASE WHEN p_partkey % 4 <> 0 THEN p_size % 3 END AS sd, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS ct FROM part)
SELECT CASE WHEN a.id <> b.id THEN 'proven-different' WHEN a.rv <> b.rv THEN 'revision-conflict' WHEN a.sd <> b.sd THEN 'conflict' WHEN a.ct = b.ct THEN 'proven-same' WHEN a.ct <> b.ct THEN 'content-conflict' WHEN a.sd IS NOT NULL AND b.sd IS NOT NULL THEN 'compatible' ELSE 'unknown' END AS verdict,
 count(*) AS n FROM r a JOIN r b ON b.p_partkey = a.p_partkey + 1 GROUP BY 1""")
def evidence_verdicts(spark, sf_dir):
    return _pairs_by_name(spark, sf_dir).groupBy(evidence.verdict().alias("verdict")).agg(F.count("*").alias("n"))


_ARRAY = lambda c: f"list_filter(list_transform(x, lambda y: y.{c}), lambda y: y IS NOT NULL)"
_FIRST = lambda a: f"list_slice(list_filter({a}, lambda y, i: list_position({a}, y) = i), 1, 3)"
_SHORT = lambda a: f"array_to_string(list_transform({_FIRST(a)}, lambda y: CASE WHEN length(y) > 30 THEN left(y, 30) || '…' ELSE y END), '|')"


@query(f"""WITH c AS (SELECT conv_id, list(struct_pack(t := turn, r := role, s := text) ORDER BY turn) AS x FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(x[1].s) > 30 THEN left(x[1].s, 30) || '…' ELSE x[1].s END AS summary, {_SHORT(_ARRAY('s'))} AS evidence, {_SHORT(_ARRAY('r'))} AS open_questions, '' AS risks FROM c""")
def handoffs(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    rows = turns.select("conv_id", F.col("x")[0]["text"].alias("conclusion"), F.transform("x", lambda y: y["text"]).alias("facts"), F.transform("x", lambda y: y["role"]).alias("unresolved"))
    out = pipelines.handoff(rows, most_items=3, most_chars=30)
    return out.select("conv_id", "summary", joined("evidence"), joined("open_questions"), joined("risks"))


@query("SELECT conv_id, role, 'answer ' || conv_id AS claim, CASE WHEN length(text) > 50 THEN left(text, 50) || '…' ELSE text END AS evidence, 'worker:' || role AS source, 0.5::DOUBLE AS confidence FROM conversations")
def worker_envelopes(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("worker"), F.concat(F.lit("answer "), F.col("conv_id").cast("string")).alias("task"), F.col("text").alias("payload"))
    out = evidence.envelope(c.select("worker", "task", "payload"), 50)
    return out.select(F.substring_index("claim", " ", -1).cast("long").alias("conv_id"), F.col("worker").alias("role"), "claim", "evidence", "source", "confidence")


@query(f"""WITH g AS ({DOC_GROUPS}), c AS (SELECT DISTINCT 'claim:' || lower(trim(regexp_replace(text, '[\\s\\x1c-\\x1f]+', ' ', 'g'))) AS group_key FROM documents WHERE doc_id % 3 = 0)
SELECT count(*) AS n FROM g WHERE group_key NOT IN (SELECT group_key FROM c)""")
def uncontradicted(spark, sf_dir):
    g = findings.groups(queries.document_findings(spark, sf_dir)).withColumn("identity", F.col("group_key"))
    gone = findings.normalize(read(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("text").alias("claim"))).select(F.col("group_key").alias("identity")).distinct()
    return packets.without_contradicted(g, gone).agg(F.count("*").alias("n"))


@query(f"""WITH g AS ({DOC_GROUPS}) SELECT round(least(1.0::DOUBLE, sum(occurrence_count - 1)::DOUBLE / greatest(1, (SELECT count(*) FROM documents))), 6) AS duplicate_ratio, round(least(1.0::DOUBLE, count(*) FILTER (workers > 1)::DOUBLE / greatest(1, count(*))), 6) AS conflict_ratio FROM g""")
def reduction_ratios(spark, sf_dir):
    g = findings.groups(queries.document_findings(spark, sf_dir)).agg(F.sum("duplicates").alias("d"), F.sum("occurrence_count").alias("v"), F.count("*").alias("o"), F.count_if(F.col("workers") > 1).alias("c"))
    r = telemetry.ratios(F.col("v"), F.col("d"), F.col("o"), F.col("c"))
    return g.select(F.round(r["duplicate_ratio"], 6).alias("duplicate_ratio"), F.round(r["conflict_ratio"], 6).alias("conflict_ratio"))


@query(f"""WITH f AS ({PARTS}), t AS (SELECT claim, min(idx) AS a, max(idx) AS b FROM f GROUP BY claim) SELECT a AS "left", b AS "right", 1.0::DOUBLE AS score,
 CASE WHEN x.identity <> y.identity THEN 'conflicting-identity' WHEN x.side <> y.side AND x.identity = y.identity THEN 'same-identity-different-assertion' WHEN x.side <> y.side THEN 'conflicting-structured-assertion' ELSE 'safe-duplicate' END AS verdict
 FROM t JOIN f x ON x.idx = a JOIN f y ON y.idx = b WHERE a < b""")
def analyzed_candidates(spark, sf_dir):
    """A registered detector by name, and what verification makes of its pairs."""

    def ends(rows, threshold, most):
        return rows.groupBy("claim_text").agg(F.min("idx").alias("left"), F.max("idx").alias("right")).where("left < right").select("left", "right", F.lit(1.0).alias("score"))

    candidates.register_provider("equal-text-ends", ends)
    f = queries.part_findings(spark, sf_dir)
    return candidates.verify(candidates.detect(f, "equal-text-ends"), f).select("left", "right", "score", "verdict")


@query("SELECT doc_id AS packet_rank, source AS ref, CASE WHEN n_chars > 1 THEN n_chars END AS agreement_count, 0.5::DOUBLE AS confidence, sha256(text) AS claim, CASE WHEN doc_id % 3 > 1 THEN doc_id % 3 END AS independent_evidence_count FROM documents")
def thin_packet(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("packet_rank"), F.sha2("text", 256).alias("claim"), F.col("source").alias("ref"), "source", F.lit(0.5).alias("confidence"), F.col("n_chars").alias("agreement_count"), F.pmod("doc_id", F.lit(3)).alias("independent_evidence_count"))
    return pipelines.thin(d)[0]


_CASES = [("one", ["a", "b"], ["z"]), ("two", ["a"], ["b"]), ("three", ["c"], [])]
_CLAIMS = [("one", "a"), ("one", "b"), ("one", "q"), ("two", "a"), ("two", "b")]


@query(f"""WITH c AS ({values(_CASES, '"case" VARCHAR, required VARCHAR[], forbidden VARCHAR[]')}), k AS ({values(_CLAIMS, '"case" VARCHAR, claim VARCHAR')}), f AS (SELECT "case", list(claim) AS f FROM k GROUP BY 1),
j AS (SELECT c.*, coalesce(f, []) AS f FROM c LEFT JOIN f USING ("case")) SELECT "case", array_to_string(list_filter(required, lambda x: NOT list_contains(f, x)), ',') AS missing, array_to_string(list_filter(forbidden, lambda x: list_contains(f, x)), ',') AS forbidden_found,
 len(list_filter(required, lambda x: NOT list_contains(f, x))) = 0 AND len(list_filter(forbidden, lambda x: list_contains(f, x))) = 0 AS passed FROM j""")
def benchmark_cases(spark, sf_dir):
    cases, claims = table(spark, _CASES, "case string, required array<string>, forbidden array<string>"), table(spark, _CLAIMS, "case string, claim string")
    out = pipelines.case_results(cases, claims)
    return out.select("case", joined("missing", ","), joined("forbidden_found", ","), "passed")


_JSON = ['{"a":[1,1,2,{"b":[3,3]},{"b":[3]}]}', "[[1],[1]]", "not json", '"x"', None]


@query(values([(0, '{"a":[1,2,{"b":[3]}]}'), (1, "[[1]]"), (2, "not json"), (3, '"x"'), (4, None)], "n INT, json VARCHAR"))
def distinct_json(spark, sf_dir):
    rows = table(spark, list(enumerate(_JSON)), "n int, text string")
    return rows.select("n", evidence.distinct_json("text").alias("json"))


# --- contracts of payloads


def _payloads() -> list[tuple[str, int, str]]:
    """For each contract: what keeps it, nothing, values of other kinds, and no object."""
    good = {"text": "x", "container-text": "x", "array": [], "object": {}, "boolean": True, "present": 1, "count": 3, "positive": 1, "share": 0.5, "number": 0.5, "findings": []}

    def put(into: dict, path: str, x) -> None:
        *up, last = path.split(".")
        for k in up:
            into = into.setdefault(k, {})
        into[last] = x

    out = []
    for name, rules in contracts.PAYLOADS.items():
        whole: dict = {}
        for r in rules:
            put(whole, r.path, list(range(r.allowed[0])) if r.kind == "items" else r.allowed[0] if r.kind in ("one", "container-one") else contracts.schema_id(name) if r.kind == "schema" else good[r.kind])
        other: dict = {}
        for r in rules:
            put(other, r.path, -1 if r.kind in ("text", "array", "count", "positive") else "no")
        fields = [whole, {}, other, [whole], {k: None for k in whole}]
        out += [(name, i, contracts.json.dumps(x)) for i, x in enumerate(fields)]
    out += [("finding", 5, '{"claim": "c", "evidence": " ", "source": "s", "confidence": 7}'), ("worker-output", 5, '{"findings": [{"claim": "c"}, 3, {"claim": "a", "evidence": "b", "source": "c"}]}'), ("handoff", 5, "{oops"), ("runtime-config", 5, '{"adapter": "container", "container": {"repo_mode": "x"}}')]
    return out


def _rule_sql(p: str, r: contracts.Rule, name: str) -> str:
    kind, text = f"json_type({p}, '$.{r.path}')", f"json_extract_string({p}, '$.{r.path}')"
    whole, blank = f"coalesce({kind} IN ('UBIGINT', 'BIGINT'), false)", f"NOT coalesce({kind} = 'VARCHAR' AND regexp_matches({text}, '\\S'), false)"
    number = f"CASE {kind} WHEN 'BOOLEAN' THEN ({text} = 'true')::INT::DOUBLE WHEN 'VARCHAR' THEN try_cast({text} AS DOUBLE) WHEN 'UBIGINT' THEN try_cast({text} AS DOUBLE) WHEN 'BIGINT' THEN try_cast({text} AS DOUBLE) WHEN 'DOUBLE' THEN try_cast({text} AS DOUBLE) END"
    absent = f"coalesce({kind} = 'NULL', true)"
    inside = " OR ".join(f"({kind} {'=' if isinstance(x, str) else '<>'} 'VARCHAR' AND {text} = {quoted(x if isinstance(x, str) else contracts.json.dumps(x))})" for x in r.allowed) if r.kind in ("one", "container-one") else ""
    container = f"coalesce(json_extract_string({p}, '$.adapter') = 'container', false)"
    out = {
        "text": blank, "container-text": f"{container} AND {blank}", "array": f"coalesce({kind} <> 'ARRAY', true)", "object": f"coalesce({kind} <> 'OBJECT', true)", "boolean": f"coalesce({kind} <> 'BOOLEAN', true)", "present": f"{kind} IS NULL",
        "count": f"NOT (({whole} OR coalesce({kind} = 'BOOLEAN', false)) AND coalesce({number} >= 0, false))", "positive": f"NOT (({whole} OR coalesce({kind} = 'BOOLEAN', false)) AND coalesce({number} >= 1, false))",
        "one": f"NOT coalesce({inside}, false)", "container-one": f"{container} AND NOT coalesce({inside}, false)", "schema": f"NOT coalesce({kind} = 'VARCHAR' AND {text} = {quoted(contracts.schema_id(name))}, false)",
        "share": f"coalesce(NOT {number} BETWEEN 0 AND 1, false)", "number": f"{number} IS NULL AND {kind} IS NOT NULL", "items": f"NOT coalesce({kind} = 'ARRAY' AND json_array_length({p}, '$.{r.path}') >= {r.allowed[0] if r.allowed else 0}, false)",
    }[r.kind]
    if r.kind == "number":
        return out
    return f"({out}) AND " + ("true" if not r.missing else f"{kind} IS NOT NULL" if r.kind == "object" else f"NOT {absent}")


def _messages_sql(p: str, name: str) -> str:
    rules = [r for r in contracts.PAYLOADS[name] if r.kind != "findings"]
    each = ", ".join(f"CASE WHEN {_rule_sql(p, r, name)} THEN {quoted(r.message)} END" for r in rules)
    return f"list_filter([{each}], lambda m: m IS NOT NULL)"


def _contracts_sql() -> str:
    rows = values(_payloads(), "contract VARCHAR, n INT, payload VARCHAR")
    cases = " ".join(f"WHEN {quoted(name)} THEN {_messages_sql('j', name)}" for name in contracts.PAYLOADS)
    items = "list_transform(json_extract(j, '$.findings[*]'), lambda x, i: list_transform(CASE WHEN json_type(x) = 'OBJECT' THEN " + _messages_sql("x", "finding") + " ELSE ['payload must be an object'] END, lambda m: 'findings[' || (i - 1) || ']: ' || m))"
    nested = f"CASE WHEN contract = 'worker-output' AND json_type(j, '$.findings') = 'ARRAY' THEN flatten({items}) ELSE [] END"
    return f"""WITH p AS (SELECT *, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM ({rows})),
e AS (SELECT contract, n, CASE WHEN coalesce(json_type(j) = 'OBJECT', false) THEN list_concat(CASE contract {cases} END, {nested}) ELSE ['payload must be an object'] END AS m FROM p)
SELECT contract, n, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), '; ') AS errors FROM e"""


@query(_contracts_sql())
def payload_contracts(spark, sf_dir):
    rows, out = _payloads(), None
    for name in contracts.PAYLOADS:
        part = contracts.payload_errors(table(spark, [r for r in rows if r[0] == name], "contract string, n int, payload string"), name)
        part = part.select("contract", "n", F.array_join("errors", "; ").alias("errors"))
        out = part if out is None else out.union(part)
    return out


@query(values([(k, f"sievewright-{k}/v1", len(v)) for k, v in sorted(contracts.PAYLOADS.items())], "contract VARCHAR, schema VARCHAR, invariants INT"))
def schema_list(spark, sf_dir):
    return contracts.schemas(spark)


# --- planning


_POLICY = [(s, f, r) for s in (0.5, 0.82, 0.95) for f in (0, 2) for r in ("low", "medium", "high", "critical", "odd")]


@query(f"""SELECT score, failures, risk, CASE WHEN score >= coalesce(CASE risk {' '.join(f"WHEN {quoted(k)} THEN {v}" for k, v in harness.GRADES.items())} END, 0.82)::DOUBLE AND failures = 0 THEN 'pass' WHEN failures > 0 THEN 'reject' ELSE 'uncertain' END AS grade
 FROM ({values(_POLICY, 'score DOUBLE, failures INT, risk VARCHAR')})""")
def grades(spark, sf_dir):
    rows = table(spark, _POLICY, "score double, failures int, risk string")
    return rows.withColumn("grade", harness.grade(F.col("score"), F.col("failures"), F.col("risk")))


_RETRIES = [(d, a, t, r, c) for d in ("pass", "reject", "uncertain", "what") for a in (0, 1, 2, 3) for t in ("cheap", "standard", "strong") for r in ("low", "high") for c in ("focused", "complex")]


@query(f"""WITH r AS ({values(_RETRIES, 'decision VARCHAR, attempt INT, tier VARCHAR, risk VARCHAR, level VARCHAR')}), p AS (SELECT *, CASE WHEN risk = 'high' THEN 2 WHEN level = 'complex' THEN 3 ELSE 2 END AS most, CASE WHEN risk = 'high' THEN 0 ELSE 1 END AS same, greatest(1, attempt) AS k FROM r),
a AS (SELECT *, CASE WHEN decision = 'pass' THEN 'done' WHEN decision NOT IN ('reject', 'uncertain') THEN 'invalid-grade' WHEN k >= most THEN 'human-review' ELSE 'retry' END AS action FROM p)
SELECT decision, attempt, tier, risk, level, action, CASE WHEN action = 'retry' THEN CASE WHEN decision = 'uncertain' OR risk = 'high' OR k > same THEN CASE tier WHEN 'cheap' THEN 'standard' ELSE 'strong' END ELSE tier END END AS next_tier FROM a""")
def retry_decisions(spark, sf_dir):
    rows = table(spark, _RETRIES, "decision string, attempt int, tier string, risk string, level string")
    out = rows.withColumn("x", harness.retry(*[F.col(c) for c in ("decision", "attempt", "tier", "risk", "level")]))
    return out.select(*rows.columns, F.col("x.action").alias("action"), F.col("x.next_tier").alias("next_tier"))


@query("""SELECT p_partkey, CASE WHEN c >= 0.85 OR u <= 0 OR l <= 0 THEN 0 ELSE least(2, l, greatest(1, u)) END AS launch FROM (SELECT p_partkey, least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(CASE WHEN p_partkey % 6 <> 0 THEN p_size / 55.0::DOUBLE END, 0.0::DOUBLE))) AS c,
 p_partkey % 5 - 1 AS u, greatest(0, 4 - p_partkey % 6) AS l FROM part)""")
def fan_out(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", harness.fan_out(F.when(F.pmod(k, F.lit(6)) != 0, F.col("p_size") / 55.0), F.pmod(k, F.lit(5)) - 1, F.pmod(k, F.lit(6))).alias("launch"))


def _tiers_sql() -> str:
    from .oracles import ORACLES as known

    return f"""WITH c AS ({known['complexity_risk']}), t AS (SELECT conv_id, turn, lower(trim(text)) AS x FROM conversations), f AS (SELECT c.*, complexity_level AS l, risk_level IN ('high', 'critical') AS high,
 least(1.0::DOUBLE, 0.22::DOUBLE * ({' + '.join(f"contains(x, {quoted(w)})::INT" for w in dict.fromkeys(harness.AMBIGUITY))})) >= 0.44 OR routing_confidence < 0.7 AS unsure, {any_of('x', harness.NOVELTY)} AS novel FROM c JOIN t USING (conv_id, turn)),
m AS (SELECT *, CASE l WHEN 'complex' THEN 'standard' WHEN 'autonomous' THEN 'strong' END AS p, CASE WHEN l = 'trivial' THEN 'cheap' ELSE 'standard' END AS w, CASE l WHEN 'trivial' THEN 'cheap' WHEN 'autonomous' THEN 'strong' ELSE 'standard' END AS g FROM f)
SELECT coalesce(CASE WHEN p IS NOT NULL AND (high OR unsure OR novel) THEN 'strong' ELSE p END, '') AS planner, CASE WHEN w = 'cheap' AND (high OR unsure AND p IS NULL) THEN 'standard' ELSE w END AS worker,
 CASE WHEN high OR novel THEN 'strong' WHEN unsure AND g = 'cheap' THEN 'standard' ELSE g END AS grader, count(*) AS n FROM m GROUP BY 1, 2, 3"""


@query(_tiers_sql())
def model_tiers(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("l", harness.complexity(F.col("text"))["level"]).withColumn("t", harness.model_tiers(F.col("l"), harness.risk(F.col("text"))))
    return c.groupBy(F.coalesce("t.planner", F.lit("")).alias("planner"), F.col("t.worker").alias("worker"), F.col("t.grader").alias("grader")).agg(F.count("*").alias("n"))


@query(values([(c, k) for k, names in (("core", planning.CORE), ("fallback", planning.FALLBACK), ("advisory", planning.ADVISORY), ("external", planning.EXTERNAL)) for c in names], "capability VARCHAR, met VARCHAR").replace("SELECT c0", "SELECT CASE WHEN contains(c0, '.') THEN string_split(c0, '.')[1] ELSE 'other' END AS layer, c0"))
def capability_manifest(spark, sf_dir):
    return planning.capability_manifest(spark).withColumn("layer", planning.layer(F.col("capability")))


@query(values(planning.PRESETS, "name VARCHAR, mode VARCHAR, intent VARCHAR, default_task VARCHAR, default_budget INT"))
def presets(spark, sf_dir):
    return planning.presets(spark)


_TASKS = [("t1", "fix typo"), ("t2", "why does login fail with an error"), ("t3", "refactor the architecture across the repo and migrate the oauth database integration end to end"), ("t4", "review security of the payment rollback in production"), ("t5", None), ("t6", "refactor the queue, add feature")]
_PLANNED = [
    ("t1", "understand", "trivial", "low", "work,grade"), ("t2", "debug", "trivial", "low", "work,grade"), ("t3", "understand", "autonomous", "high", "plan,research-a,research-b,implement,test,security,grade,finalize"),
    ("t4", "review", "focused", "critical", "work,grade"), ("t5", "understand", "trivial", "low", "work,grade"), ("t6", "understand", "complex", "low", "plan,research,implement,test,grade"),
]


def _plans(spark):
    return planning.plans(table(spark, _TASKS, "task_id string, task string"))


@query(values(_PLANNED, "task_id VARCHAR, task_type VARCHAR, level VARCHAR, risk VARCHAR, nodes VARCHAR"))
def task_plans(spark, sf_dir):
    return _plans(spark).select("task_id", "task_type", F.col("complexity.level").alias("level"), F.col("risk.level").alias("risk"), F.array_join(F.transform("nodes", lambda n: n["node"]), ",").alias("nodes"))


def _lane_rows() -> list[tuple]:
    return [(t, i, n) for t, *_, names in _PLANNED for i, n in enumerate(names.split(","))]


_ROLES = {"work": "worker", "grade": "grader", "plan": "planner", "research": "researcher", "research-a": "researcher", "research-b": "researcher", "implement": "implementer", "test": "tester", "security": "security-reviewer", "finalize": "integrator"}


@query(f"""WITH n AS ({values([(t, i, n, harness.ROLE_WEIGHTS[_ROLES[n]]) for t, i, n in _lane_rows()], 'task_id VARCHAR, place INT, node VARCHAR, w DOUBLE')}), r AS (SELECT *, 12000 * w / sum(w) OVER (PARTITION BY task_id) AS a, 4000 * w / sum(w) OVER (PARTITION BY task_id) AS b FROM n)
SELECT task_id, node, (floor(a) + CASE WHEN row_number() OVER (PARTITION BY task_id ORDER BY round(a - floor(a), 9) DESC, place) <= 12000 - sum(floor(a)) OVER (PARTITION BY task_id) THEN 1 ELSE 0 END)::BIGINT AS context_tokens,
 (floor(b) + CASE WHEN row_number() OVER (PARTITION BY task_id ORDER BY round(b - floor(b), 9) DESC, place) <= 4000 - sum(floor(b)) OVER (PARTITION BY task_id) THEN 1 ELSE 0 END)::BIGINT AS output_tokens FROM r""")
def plan_lanes(spark, sf_dir):
    return planning.lanes(_plans(spark), "task_id").select("task_id", "node", F.col("context_tokens").cast("long").alias("context_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"))


@query(values([(t, m, ("work" if m == "direct" else "work,grade" if m == "light" else "research-a,research-b,grade,finalize" if t in ("t1", "t5", "t6") else names), None if m == "direct" else "grade", 2 if m == "full" else 1) for t, *_, names in _PLANNED for m in ("direct", "light", "full") if t != "t2" and t != "t4"], "task_id VARCHAR, mode VARCHAR, nodes VARCHAR, quality_gate VARCHAR, parallel_width INT"))
def adapted_plans(spark, sf_dir):
    rows = _plans(spark).where("task_id NOT IN ('t2', 't4')").withColumn("mode", F.explode(F.array(*map(F.lit, ("direct", "light", "full")))))
    out = planning.adapted(rows, F.col("mode"), F.lit(True))
    return out.select("task_id", "mode", F.array_join(F.transform("nodes", lambda n: n["node"]), ",").alias("nodes"), "quality_gate", "parallel_width")


_PROVIDERS = [("fast", ["repository.graph", "context.dedup"], "plugin", True, False, 2.0), ("slow", ["repository.graph"], "plugin", True, False, 5.0), ("mine", ["context.dedup", "executor.autonomous"], "mcp", True, True, 9.0), ("odd", ["repository.index"], "plugin", False, True, 0.0), ("shell", ["repository.symbols"], "cli", True, True, 0.0)]
_CHOSEN = {"repository.graph": "fast", "context.dedup": "mine", "executor.autonomous": "mine"}


def _resolved_rows() -> list[tuple]:
    met = {*planning.CORE, *planning.FALLBACK, *planning.ADVISORY}
    out = []
    for t, kind, level, *_ in _PLANNED:
        several = level in ("complex", "autonomous")
        need = [*planning.REQUIRED[kind], *planning.ALWAYS_REQUIRED]
        may = [*planning.OPTIONAL, *(planning.FOR_SEVERAL if several else ()), *(["knowledge.search"] if several else []), *(["executor.autonomous"] if level == "autonomous" else [])]
        out += [(t, c, c in need, _CHOSEN.get(c) or ("native" if c in met else None)) for c in dict.fromkeys([*need, *may])]
    return out


@query(values(_resolved_rows(), "task_id VARCHAR, capability VARCHAR, required BOOLEAN, provider VARCHAR"))
def plan_providers(spark, sf_dir):
    providers = table(spark, _PROVIDERS, "id string, capabilities array<string>, source_type string, trusted boolean, preferred boolean, penalty double")
    return planning.resolved(_plans(spark), providers, "task_id").where("capability NOT LIKE 'model.%'").select("task_id", "capability", "required", "provider")


@query(f"""WITH n AS ({values([(t, n) for t, _, n in _lane_rows()], 'task_id VARCHAR, node VARCHAR')}), k AS ({values(_TASKS, 'task_id VARCHAR, task VARCHAR')}) SELECT task_id, node, coalesce(task, '') AS task, true AS valid FROM n JOIN k USING (task_id)""")
def invocations(spark, sf_dir):
    planned = _plans(spark)
    lanes = planning.lanes(planned, "task_id").join(planned.select("task_id", "task"), "task_id")
    out = planning.invocations(lanes, "run-1")
    out = contracts.payload_errors(out, "runtime-invocation", "invocation")
    return out.select("task_id", "node", F.get_json_object("invocation", "$.task").alias("task"), ((F.size("errors") == 0) & (F.col("estimated_input_tokens") > 0)).alias("valid"))


_LANES = [("a", 100, 50, 1), ("b", 10, 5, 2), ("c", 0, 9, 1)]
_USES = [("a", "context_tokens", 40), ("a", "context_tokens", 30), ("a", "output_tokens", -5), ("b", "model_calls", 2), ("b", "context_tokens", 11), ("b", "other", 99)]


@query(f"""WITH l AS (SELECT * FROM (UNPIVOT ({values(_LANES, 'lane VARCHAR, context_tokens BIGINT, output_tokens BIGINT, model_calls BIGINT')}) ON context_tokens, output_tokens, model_calls INTO NAME resource VALUE most)), u AS (SELECT lane, resource, sum(greatest(0, amount))::BIGINT AS used FROM ({values(_USES, 'lane VARCHAR, resource VARCHAR, amount BIGINT')}) GROUP BY 1, 2),
j AS (SELECT l.*, coalesce(used, 0) AS used FROM l LEFT JOIN u USING (lane, resource)) SELECT lane, max(used) FILTER (resource = 'context_tokens') AS context_used, max(greatest(0, most - used)) FILTER (resource = 'context_tokens') AS context_left, coalesce(string_agg(resource, ',' ORDER BY resource) FILTER (used >= most), '') AS exceeded, count(*) FILTER (used >= most) = 0 AS allow_more_work FROM j GROUP BY lane""")
def lane_usage(spark, sf_dir):
    out = planning.lane_status(table(spark, _LANES, "lane string, context_tokens long, output_tokens long, model_calls long"), table(spark, _USES, "lane string, resource string, amount long"))
    return out.select("lane", F.col("context_tokens_used").alias("context_used"), F.col("context_tokens_left").alias("context_left"), joined("exceeded", ","), "allow_more_work")


_SETTINGS, _CHANGES = [("p1", None), ("p2", None), ("p1", "search")], [(1, "p3", None, True), (2, "p2", None, False), (3, "p2", "search", True), (4, "p3", "graph", True), (5, None, "graph", True)]


@query(values([("p1", None), ("p3", None), ("p2", "search")], "provider VARCHAR, capability VARCHAR"))
def provider_settings(spark, sf_dir):
    changes = table(spark, _CHANGES, "ordinal int, provider string, capability string, on boolean")
    return planning.trusted(table(spark, _SETTINGS, "provider string, capability string"), changes)


_OFFERS = [("native", ["s", "g"], "native", True, False), ("fast", ["s"], "plugin", True, False), ("odd", ["s"], "plugin", False, True), ("pick", ["g"], "plugin", True, True), ("tool", ["t"], "cli", True, True)]


@query(values([("s", "fast"), ("g", "pick"), ("t", "tool")], "capability VARCHAR, id VARCHAR"))
def capability_choice(spark, sf_dir):
    p, out = table(spark, _OFFERS, "id string, capabilities array<string>, source_type string, trusted boolean, preferred boolean"), None
    for c in ("s", "g", "t", "none"):
        part = views.resolve(p, c, external=True).select(F.lit(c).alias("capability"), "id")
        out = part if out is None else out.union(part)
    return out


@query(f"""WITH p AS ({values([(i, c) for i, c, *_ in _OFFERS], 'id VARCHAR, capabilities VARCHAR[]')}), u AS (SELECT id, unnest(capabilities) AS capability FROM p) SELECT capability, count(DISTINCT id) AS providers, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM u GROUP BY 1 HAVING count(DISTINCT id) > 1""")
def provider_overlaps(spark, sf_dir):
    p = table(spark, _OFFERS, "id string, capabilities array<string>, source_type string, trusted boolean, preferred boolean")
    return views.overlaps(p).select("capability", "providers", joined("ids", ","))


@query("SELECT p_partkey, NOT p_partkey % 5 = 0 AS indexed, CASE WHEN p_partkey % 5 = 0 THEN 'deny' WHEN p_size - 10 <= 0 THEN 'prefer-structure' WHEN p_partkey % 900 > 400 THEN 'prefer-symbol' ELSE 'allow' END AS admission FROM part")
def read_admission(spark, sf_dir):
    k = F.col("p_partkey")
    indexed = F.pmod(k, F.lit(5)) != 0
    return read(spark, sf_dir, "part").select("p_partkey", indexed.alias("indexed"), packets.admission(indexed, F.col("p_size") - 10, F.pmod(k, F.lit(900))).alias("admission"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 4 = 0 THEN 'no-context-selected' END, CASE WHEN p_size / 50.0 < 0.34 THEN 'low-coverage' END, CASE WHEN p_partkey % 3 > 0 THEN 'incomplete-problems' END], lambda x: x IS NOT NULL), ',') AS reasons FROM part")
def context_sufficiency(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(packets.sufficiency(F.pmod(k, F.lit(4)), F.col("p_size") / 50.0, F.pmod(k, F.lit(3))), ",").alias("reasons"))


_PROBLEMS = [("p1", "login", 1, "covered", ["e1", "e2", "e3", "e4", "e5"], ["a"]), ("p2", "pay", 2, "unresolved", [], None), ("p3", "ship", 3, None, None, ["a", "b", "c", "d", "e", "f"])]


@query(f"""SELECT id, text, ordinal, status, array_to_string(list_slice(CASE WHEN len(r) > 0 THEN r END, 1, 4), ',') AS evidence_refs, CASE WHEN len(r) > 0 THEN len(r) END AS evidence_ref_count, array_to_string(list_slice(CASE WHEN len(c) > 0 THEN c END, 1, 4), ',') AS candidate_paths, CASE WHEN len(c) > 0 THEN len(c) END AS candidate_path_count
 FROM ({values(_PROBLEMS, 'id VARCHAR, text VARCHAR, ordinal INT, status VARCHAR, r VARCHAR[], c VARCHAR[]')})""")
def problem_projection(spark, sf_dir):
    rows = table(spark, _PROBLEMS, "id string, text string, ordinal int, status string, evidence_refs array<string>, candidate_paths array<string>")
    return packets.project_problems(rows).select("id", "text", "ordinal", "status", joined("evidence_refs", ","), "evidence_ref_count", joined("candidate_paths", ","), "candidate_path_count")


# --- telemetry, state, logs


@query("""SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS total_tokens, round((l_partkey + l_suppkey) / greatest(1, l_quantity + l_linenumber)::DOUBLE, 4) AS amplification, (l_quantity + l_linenumber - l_partkey - l_suppkey)::DOUBLE AS net_savings FROM lineitem""")
def token_economics(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").withColumn("e", telemetry.economics(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")))
    return l.select("l_orderkey", "l_linenumber", "e.total_tokens", "e.amplification", "e.net_savings")


_LIMITS = [("R", 100), ("N", 10**12), ("none", 5)]


@query(f"""WITH l AS ({values(_LIMITS, 'resource VARCHAR, most BIGINT')}), u AS (SELECT l_returnflag AS resource, sum(l_linenumber)::BIGINT AS used FROM lineitem GROUP BY 1) SELECT resource, most, coalesce(used, 0) AS used, coalesce(used, 0) >= most AS exceeded FROM l LEFT JOIN u USING (resource)""")
def budget_usage(spark, sf_dir):
    uses = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("resource"), F.col("l_linenumber").cast("long").alias("amount"))
    return telemetry.budget_status(uses, table(spark, _LIMITS, "resource string, most long"))


_ANSWER = "The STEEL part and brass are used, part_1 is not"


@query(f"SELECT p_partkey, len(list_filter(list_concat(string_split(p_name, ' '), ['', p_type]), lambda i: i <> '' AND contains({quoted(_ANSWER.lower())}, lower(i)))) > 0 AS used FROM part")
def block_usage(spark, sf_dir):
    blocks = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.split("p_name", " "), F.array(F.lit(""), F.col("p_type"))).alias("identifiers"))
    return telemetry.usage(blocks, F.lit(_ANSWER)).select("p_partkey", "used")


@query(f"""WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id - 30 END AS i, CASE WHEN event_id % 4 = 0 THEN event_id END AS o, event_type AS a, event_type || event_type AS b FROM events),
t AS (SELECT event_id, CASE WHEN i >= 0 THEN i ELSE {tokens('a')} END AS input_tokens, CASE WHEN o >= 0 THEN o ELSE {tokens('b')} END AS output_tokens, CASE WHEN i >= 0 THEN 'provider-reported' ELSE 'estimated' END AS source FROM r) SELECT event_id, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens, source FROM t""")
def reported_usage(spark, sf_dir):
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    u = telemetry.reported_usage(F.when(F.pmod(k, F.lit(3)) == 0, k - 30), F.when(F.pmod(k, F.lit(4)) == 0, k), F.col("event_type"), F.concat("event_type", "event_type"))
    return e.select("event_id", u.alias("u")).select("event_id", "u.input_tokens", "u.output_tokens", "u.total_tokens", F.col("u.input_tokens_source").alias("source"))


@query(f"""WITH t AS (SELECT doc_id, {tokens('left(text, 100)')} AS d, {tokens('text')} AS w FROM documents) SELECT doc_id, least(d, w) AS data_plane, greatest(0, w - d) AS control_plane, w AS total FROM t""")
def token_planes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", telemetry.planes(F.left("text", F.lit(100)), F.col("text")).alias("p")).select("doc_id", "p.data_plane", "p.control_plane", "p.total")


def _overlay(spark, sf_dir):
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(k.alias("id"), F.col("source").alias("path"), F.col("lang").alias("symbol"), F.when(F.pmod(k, F.lit(3)) == 0, "active").when(F.pmod(k, F.lit(3)) == 1, "rejected").otherwise("recallable").alias("tier"), F.when(F.pmod(k, F.lit(2)) == 0, "current").otherwise("stale").alias("validity"))


@query("SELECT doc_id AS id, source AS path, lang AS symbol FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0")
def overlay_items(spark, sf_dir):
    return state.overlay_items(_overlay(spark, sf_dir), "active", current_only=True).select("id", "path", "symbol")


@query("""SELECT count(*) FILTER (doc_id % 3 = 0) AS active, count(*) FILTER (doc_id % 3 = 1) AS rejected, greatest(0, count(*) FILTER (doc_id % 5 <> 0) - count(*) FILTER (doc_id % 3 = 0) - count(*) FILTER (doc_id % 3 = 1 AND doc_id % 5 <> 0)) AS recallable, count(*) FILTER (doc_id % 7 = 0) AS invalidations FROM documents""")
def overlay_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return state.overlay_counts(_overlay(spark, sf_dir), d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id")), d.where("doc_id % 7 = 0"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 2")
def newest_rejections(spark, sf_dir):
    return state.newest(read(spark, sf_dir, "events"), ["user_id"], [F.desc("event_id")], 2).select("user_id", "event_id")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 5")
def latest_runs(spark, sf_dir):
    return events.latest(read(spark, sf_dir, "events"), "event_id", 5).select("event_id", "event_type")


_STATE = [("index.json", 10), ("cache/a", 4), ("cache/b/c", 6), ("config.json", 3), ("artifacts/x", 8), ("odd/y", 1)]


@query(f"""SELECT split_part(path, '/', 1) AS entry, CASE WHEN split_part(path, '/', 1) IN ('index.json', 'cache') THEN 'regenerable' WHEN split_part(path, '/', 1) IN ('config.json', 'artifacts') THEN 'preserved' ELSE 'unrecognized' END AS class, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM ({values(_STATE, 'path VARCHAR, bytes BIGINT')}) GROUP BY 1, 2""")
def state_inventory(spark, sf_dir):
    return state.inventory(table(spark, _STATE, "path string, bytes long"))


@query("SELECT user_id AS run_id, coalesce(string_agg('n' || event_id, ',' ORDER BY 'n' || event_id) FILTER (event_type = 'click'), '') AS completed_nodes, count(*) AS nodes FROM events GROUP BY 1")
def run_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("node"), F.when(F.col("event_type") == "click", "success").otherwise(F.col("event_type")).alias("status"))
    return state.run_summary(e).select("run_id", joined("completed_nodes", ","), F.size("node_statuses").cast("long").alias("nodes"))


@query("SELECT 'plan-' || left(sha256('{\"doc\":' || doc_id || '}'), 16) AS id, octet_length(encode('{\"doc\":' || doc_id || '}'))::BIGINT AS bytes, ((octet_length(encode('{\"doc\":' || doc_id || '}')) + 3) // 4)::BIGINT AS estimated_tokens FROM documents")
def artifact_records(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit('{"doc":'), F.col("doc_id").cast("string"), F.lit("}")).alias("payload"))
    return events.artifacts(d, "plan", "me", F.lit(1)).select("id", "bytes", "estimated_tokens")


@query("SELECT 'u' || user_id AS run_id, event_type AS kind, count(*) AS n, 7.0::DOUBLE AS ts FROM events GROUP BY 1, 2")
def trace_log(spark, sf_dir):
    """Events appended to a log twice, by halves, and read back."""
    path = new_path(spark, "trace")
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_type").alias("kind"), F.to_json(F.struct("value")).alias("data"), "event_id")
    for k in (0, 1):
        events.append_trace(e.where(f"event_id % 2 = {k}"), path, F.lit(7))
    return events.read_trace(spark, path).groupBy("run_id", "kind").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))


# --- repositories


def _files(spark):
    return written(repository.read_files(spark, folder(spark, REPOSITORY, "repository"), max_bytes=MAX_BYTES), "files")


_SKIPPED = {"notes.txt": "irrelevant", "node_modules/x/index.js": "ignored", ".env": "ignored", "src/gen/made.js": "generated", "src/auto.js": "generated-content", "big.py": "large"}
_KEPT = [p for p in REPOSITORY if p not in _SKIPPED]


@query(values([(p, _SKIPPED.get(p), len(t.encode())) for p, t in REPOSITORY.items()], "path VARCHAR, skipped VARCHAR, bytes BIGINT"))
def repository_files(spark, sf_dir):
    return _files(spark).select("path", "skipped", "bytes")


#: path: imports, classes, types, functions, routes, exports, parser.
_SUMMARIES = {
    "packages/shop/src/cart.ts": ("./item", "", "Cart", "total(cart: Cart, tax: number)", "", "Cart|total", "heuristic"), "packages/shop/src/item.ts": ("", "", "Item", "price(item: Item)", "", "Item|price", "heuristic"),
    "src/index.js": ("express|./pay/charge.js", "", "", "", "GET /pay", "", "heuristic"), "src/pay/charge.js": ("", "", "", "pay(request)|charge(amount)", "", "pay|charge", "heuristic"),
    "tools/report.py": ("os|.util", "Report", "LIMIT", "rows(self, first)", "", "", "python-ast"), "tools/util.py": ("", "", "", "table(first)", "", "", "python-ast"),
    "db/schema.sql": ("", "", "orders|open_orders", "due()", "", "", "heuristic"), "native/sum.c": ("./sum.h|stdio.h", "", "", "sum(int a, int b)", "", "", "heuristic"), "lib/core.rs": ("std::io", "Core", "", "new(size: usize)", "", "", "heuristic"),
    "app/Main.java": ("java.util.List", "Main", "", "main(String[] args)|run(args)", "", "", "heuristic"), "scripts/run.sh": ("./env.sh", "", "", "start()", "", "", "heuristic"),
}


@query(values([(p, *s) for p, s in _SUMMARIES.items()], "path VARCHAR, imports VARCHAR, classes VARCHAR, types VARCHAR, functions VARCHAR, routes VARCHAR, exports VARCHAR, parser VARCHAR"))
def source_summaries(spark, sf_dir):
    out = repository.parsed(_files(spark).where("skipped IS NULL")).where(F.col("path").isin(list(_SUMMARIES)))
    return out.select("path", *[joined(c) for c in ("imports", "classes", "types", "functions", "routes", "exports")], "parser")


def _importance(path: str) -> int:
    entry = path in ("src/index.js", "app/Main.java")
    manifest = path.endswith("package.json")
    words = any(w in path.lower() for w in repository.WORDY), any(w in path.lower() for w in repository.GUARDED)
    of = lambda i: len(list(filter(None, _SUMMARIES.get(path, ("",) * 7)[i].split("|"))))
    return 25 * entry + 12 * manifest + 5 * words[0] + 3 * words[1] + min(of(0), 8) + min(2 * of(1), 8) + min(2 * of(4), 8)


@query(values([(p, p.endswith("package.json"), p in ("src/index.js", "app/Main.java"), _importance(p), -(-len(REPOSITORY[p].encode()) // 4)) for p in _KEPT], "path VARCHAR, manifest BOOLEAN, entry_point BOOLEAN, static_importance INT, estimated_tokens BIGINT"))
def repository_index(spark, sf_dir):
    return repository.build_index(_files(spark)).select("path", "manifest", "entry_point", "static_importance", "estimated_tokens")


_SPANS = [
    ("packages/shop/src/cart.ts", "Cart", "type", 2, 4), ("packages/shop/src/cart.ts", "total", "function", 5, 8), ("packages/shop/src/item.ts", "Item", "type", 1, 1), ("packages/shop/src/item.ts", "price", "function", 2, 2),
    ("src/pay/charge.js", "pay", "function", 1, 3), ("src/pay/charge.js", "charge", "function", 4, 6), ("tools/report.py", "Report", "class", 6, 8), ("tools/report.py", "rows", "function", 7, 8), ("tools/util.py", "table", "function", 1, 2),
    ("db/schema.sql", "orders", "type", 1, 3), ("db/schema.sql", "open_orders", "type", 4, 4), ("db/schema.sql", "due", "type", 5, 5), ("native/sum.c", "sum", "function", 4, 8), ("lib/core.rs", "new", "function", 4, 6),
    ("app/Main.java", "Main", "class", 2, 6), ("scripts/run.sh", "start", "function", 2, 4),
]
_SPANS = [(p, n, k, a, b) for p, n, k, a, b in _SPANS]


def _chunk(path: str, start: int, end: int) -> str:
    return "\n".join(REPOSITORY[path].splitlines()[start - 1 : end])


@query(f"SELECT path, name, kind, start_line, end_line, sha256(chunk) AS fingerprint FROM ({values([(*s, _chunk(s[0], s[3], s[4])) for s in _SPANS if s[0] not in ('lib/core.rs',)], 'path VARCHAR, name VARCHAR, kind VARCHAR, start_line INT, end_line INT, chunk VARCHAR')})")
def symbol_index(spark, sf_dir):
    out = repository.parsed(_files(spark).where("skipped IS NULL")).where("path <> 'lib/core.rs'").select("path", F.explode("symbol_details").alias("s"))
    return out.select("path", "s.name", "s.kind", "s.start_line", "s.end_line", "s.fingerprint")


@query(f"SELECT path, name, start_line, end_line, content FROM ({values([('src/pay/charge.js', 'charge', 4, 6, _chunk('src/pay/charge.js', 4, 6)), ('packages/shop/src/cart.ts', 'total', 5, 8, _chunk('packages/shop/src/cart.ts', 5, 8))], 'path VARCHAR, name VARCHAR, start_line INT, end_line INT, content VARCHAR')})")
def read_symbol(spark, sf_dir):
    files = _files(spark)
    index = repository.parsed(files.where("skipped IS NULL"))
    one = pipelines.read_symbol(index, files, "src/pay/charge.js", "charge.charge").union(pipelines.read_symbol(index, files, "packages/shop/src/cart.ts", "TOT"))
    return one.select("path", "name", "start_line", "end_line", "content")


@query(values([("docs/plan.md", "Plan|Steps|Last"), ("readme.md", "")], "path VARCHAR, headings VARCHAR"))
def knowledge_index(spark, sf_dir):
    return repository.knowledge(_files(spark)).select("path", joined("headings"))


@query(f"SELECT count(*) > 0 AS indexed, count(*) AS documents FROM ({values([('docs/plan.md',), ('readme.md',)], 'path VARCHAR')})")
def knowledge_status(spark, sf_dir):
    return repository.knowledge(_files(spark)).agg((F.count("*") > 0).alias("indexed"), F.count("*").alias("documents"))


@query(f"SELECT array_to_string(list_filter([{', '.join('CASE WHEN bool_or(' + any_of('lower(html)', n) + ') THEN ' + quoted(k) + ' END' for k, n in evidence.FRAMEWORKS.items())}], lambda x: x IS NOT NULL), '|') AS frameworks FROM (SELECT html FROM pages UNION ALL SELECT {quoted(REPOSITORY['package.json'])})")
def framework_hints(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.col("html").alias("content"))
    return evidence.frameworks(pages.union(table(spark, [(REPOSITORY["package.json"],)], "content string"))).select(joined("frameworks"))


@query(values([("packages", "javascript-workspace")], "folder VARCHAR, kind VARCHAR").replace("'packages'", "'packages/shop'"))
def workspaces(spark, sf_dir):
    return views.detect_workspaces(_files(spark).where("skipped IS NULL"))


_FOLDERS = f"SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS folder, path FROM (SELECT DISTINCT {PATH} AS path FROM pages)"


def _page_paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]*/?", ""), r"/*([?#].*)?$", "")
    return read(spark, sf_dir, "pages").select(path.alias("path")).distinct()


@query(f"SELECT folder, count(*) AS files FROM ({_FOLDERS}) GROUP BY 1 ORDER BY files DESC, folder LIMIT 60")
def directory_counts(spark, sf_dir):
    return views.directory_counts(_page_paths(spark, sf_dir))


@query(values([(p,) for p in _KEPT if p.startswith("src/")], "path VARCHAR"))
def module_map(spark, sf_dir):
    return views.module_map(_files(spark).where("skipped IS NULL"), "./src/").select("path")


def _edges(spark):
    files = _files(spark).where("skipped IS NULL")
    index = written(repository.build_index(files), "index")
    links = graph.resolve_imports(index.select(F.col("path").alias("src"), F.explode("imports").alias("spec")), files)
    return files, index, links


_LINKS = [("packages/shop/src/cart.ts", "./item", "packages/shop/src/item.ts", "edge"), ("src/index.js", "express", None, "external"), ("src/index.js", "./pay/charge.js", "src/pay/charge.js", "edge"), ("tools/report.py", "os", None, "external"),
          ("tools/report.py", ".util", "tools/util.py", "edge"), ("native/sum.c", "./sum.h", None, "unresolved"), ("native/sum.c", "stdio.h", None, "external"), ("lib/core.rs", "std::io", None, "external"), ("app/Main.java", "java.util.List", None, "external"),
          ("scripts/run.sh", "./env.sh", None, "unresolved")]


@query(values(_LINKS, "src VARCHAR, spec VARCHAR, dst VARCHAR, kind VARCHAR"))
def repository_graph(spark, sf_dir):
    return _edges(spark)[2].select("src", "spec", "dst", "kind")


@query(f"""WITH e AS (SELECT src, dst FROM ({values(_LINKS, 'src VARCHAR, spec VARCHAR, dst VARCHAR, kind VARCHAR')}) WHERE kind = 'edge') SELECT 'src/pay/charge.js' AS file, src AS path, 'imported-by' AS relation FROM e WHERE dst = 'src/pay/charge.js' UNION ALL SELECT 'tools/report.py', dst, 'imports' FROM e WHERE src = 'tools/report.py'""")
def dependency_view(spark, sf_dir):
    edges, out = _edges(spark)[2].where("kind = 'edge'"), None
    for p in ("src/pay/charge.js", "tools/report.py"):
        part = views.dependencies(edges, p).select(F.lit(p).alias("file"), "path", "relation")
        out = part if out is None else out.union(part)
    return out


@query(values([("src/pay/charge.js", True), ("src/index.js", False), ("tools/util.py", True), ("tools/report.py", False)], "path VARCHAR, changed BOOLEAN"))
def impact_view(spark, sf_dir):
    return views.impact(_edges(spark)[2].where("kind = 'edge'"), table(spark, [("src/pay/charge.js",), ("tools/util.py",)], "path string"))


_CHANGED = [["a", "b"], ["b", "c"], ["d"]]


@query(f"SELECT DISTINCT path FROM ({values([(p,) for x in _CHANGED for p in x], 'path VARCHAR')})")
def changed_view(spark, sf_dir):
    return views.changed(*[table(spark, [(p,) for p in x], "path string") for x in _CHANGED])


_SIDES = ["client/cart.ts", "server/api/cart.ts", "src/pages/pay.tsx", "app/routes/pay.ts", "docs/readme.md", "views/a.ts", "views/b.ts", "backend/jobs.ts", "backend/old.ts"]


@query(f"""WITH p AS ({values([(x,) for x in _SIDES], 'path VARCHAR')}), c AS (SELECT path AS client_path FROM p WHERE regexp_matches(lower(path), 'client|page|component|view|hook|frontend') ORDER BY path LIMIT 3), s AS (SELECT path AS server_path FROM p WHERE regexp_matches(lower(path), 'server|route|api|controller|handler|backend') ORDER BY path LIMIT 3)
SELECT * FROM c, s""")
def contract_pairs(spark, sf_dir):
    return pipelines.contract_pairs(table(spark, [(x,) for x in _SIDES], "path string"))


def _ranked(spark, task):
    _, index, links = _edges(spark)
    edges = links.where("kind = 'edge'").select("src", "dst")
    named = index.withColumns({"symbols": F.array_join("symbols", " "), "imports": F.array_join("imports", " ")})
    degree = graph.degrees(index.select(F.col("path").alias("node")), edges)
    distance = graph.distances(edges, index.where("entry_point").select(F.col("path").alias("node")))
    return index, graph.rank_files(named, degree, distance, task)


def _rank_sql() -> str:
    edges = [(s, d) for s, _, d, k in _LINKS if k == "edge"]
    near = {"src/index.js": 0, "app/Main.java": 0, "src/pay/charge.js": 1}
    rows = [(p, _importance(p), p in ("src/index.js", "app/Main.java"), sum(d == p for _, d in edges), sum(s == p for s, _ in edges), near.get(p)) for p in _KEPT]
    return f"""SELECT path, round(s::DOUBLE + log2(1.0::DOUBLE + i) * 7 + log2(1.0::DOUBLE + o) * 3 + CASE WHEN e THEN 15.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN d IS NOT NULL THEN greatest(0.0::DOUBLE, 8.0::DOUBLE - d * 1.5::DOUBLE) ELSE 0.0::DOUBLE END, 3) AS rank_score
 FROM ({values(rows, 'path VARCHAR, s INT, e BOOLEAN, i INT, o INT, d INT')}) ORDER BY rank_score DESC, path LIMIT 6"""


@query(_rank_sql())
def project_map(spark, sf_dir):
    return graph.ranked(_ranked(spark, None)[1], 6).select("path", "rank_score")


@query(values([("src/pay/charge.js", "charge"), ("src/index.js", "charge")], "path VARCHAR, matched VARCHAR"))
def query_view(spark, sf_dir):
    return graph.ranked(_ranked(spark, "charge")[1].where("size(matched_terms) > 0"), 20).select("path", F.array_join("matched_terms", "|").alias("matched"))


@query(values([("file", "src/pay/charge.js", None), ("file", "src/index.js", None), ("symbol", "src/pay/charge.js", "charge")], "layer VARCHAR, path VARCHAR, name VARCHAR"))
def context_pack(spark, sf_dir):
    index, ranked = _ranked(spark, "charge")
    symbols = index.select("path", F.explode("symbol_details").alias("s")).select("path", "s.name", "s.estimated_tokens")
    chosen, picked, _ = pipelines.context_pack(ranked.where("lexical > 0"), symbols, "charge", most_symbols=1)
    return chosen.select(F.lit("file").alias("layer"), "path", F.lit(None).cast("string").alias("name")).union(picked.select(F.lit("symbol"), "path", "name"))


@query(f"""SELECT path, symbol, content FROM ({values([('src/pay/charge.js', 'charge', _chunk('src/pay/charge.js', 4, 6)), ('src/pay/charge.js', 'pay', _chunk('src/pay/charge.js', 1, 3))], 'path VARCHAR, symbol VARCHAR, content VARCHAR')})""")
def recalled_context(spark, sf_dir):
    files, index, links = _edges(spark)
    places = repository.locators(index).where("path <> 'db/schema.sql'")
    none = table(spark, [], "id string")
    out = pipelines.recall_context(places, files, "charge", none, none, links.where("kind = 'edge'").select("src", "dst"))
    return out.where("symbol IS NOT NULL").select("path", "symbol", "content")


@query(f"""WITH s AS ({values([(f'f{i % 3}', f's{i}', i * 10, i * 10 + 8) for i in range(1, 13)], 'path VARCHAR, symbol VARCHAR, start_line INT, end_line INT')}), h AS ({values([('f0', n) for n in range(1, 400, 7)] + [('f1', 45)], 'path VARCHAR, line INT')})
SELECT symbol, (CASE WHEN count(h.line) > 0 THEN 20 ELSE 0 END + CASE WHEN count(h.line) FILTER (h.line BETWEEN start_line AND end_line) > 0 THEN 45 ELSE 0 END)::DOUBLE AS bonus FROM s LEFT JOIN h USING (path) GROUP BY symbol""")
def grep_span_bonus(spark, sf_dir):
    """What hits in a file, and in the lines of a symbol, add: all hits count, also those beyond a report's."""
    from ..operators import recall

    rows = table(spark, [(f"f{i % 3}", f"s{i}", i * 10, i * 10 + 8) for i in range(1, 13)], "path string, symbol string, start_line int, end_line int").withColumns({"score": F.lit(0.0), "kind": F.lit("symbol")})
    lines = table(spark, [("f0", n, "a needle" if n % 7 == 1 else "hay") for n in range(1, 400)] + [("f1", 45, "needle")], "path string, line int, content string")
    return recall.with_hits(rows, recall.matches(lines, "needle")).select("symbol", F.col("score").alias("bonus"))


_SEEN = {"total": ("unchanged", "omit"), "price": ("changed", "full"), "Item": ("new", "full")}


@query(values([(k, *v) for k, v in _SEEN.items()], "key VARCHAR, status VARCHAR, delivery VARCHAR"))
def symbol_delivery(spark, sf_dir):
    index = repository.parsed(_files(spark).where("skipped IS NULL")).select("path", F.explode("symbol_details").alias("s")).where(F.col("s.name").isin(*_SEEN))
    now = index.select(F.col("s.name").alias("key"), F.col("s.fingerprint").alias("fingerprint"), F.col("s.signature").alias("content"))
    ledger = now.where("key <> 'Item'").withColumn("fingerprint", F.when(F.col("key") == "price", "other").otherwise(F.col("fingerprint"))).withColumn("content", F.when(F.col("key") == "price", "x").otherwise(F.col("content")))
    return pipelines.symbol_with_ledger(now, ledger).select("key", "status", "delivery")


_TAKEN = [("f", ["a(x)", "class B", "go: (y)"], ["a", "go"]), ("g", ["m", "n"], [])]


@query(values([("f", "class B"), ("g", "m|n")], "path VARCHAR, names VARCHAR"))
def undominated_structure(spark, sf_dir):
    files = table(spark, [(p, n) for p, n, _ in _TAKEN], "path string, names array<string>")
    return evidence.without_dominated(files, table(spark, [(p, n) for p, _, t in _TAKEN for n in t], "path string, name string")).select("path", joined("names"))


@query("SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 7)")
def cited_items(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return evidence.cited(p.select("p_partkey", F.col("p_brand").alias("path")), p.where("p_size = 7").select(F.col("p_brand").alias("path"))).select("p_partkey")


_ITEMS = [("file", 1, "a" * 40), ("symbol", 1, "b" * 80), ("symbol", 2, "c" * 8), ("external", 1, "d" * 60), ("file", 2, "e" * 4), ("external", 2, "f" * 400)]


@query(values([("external", 1), ("symbol", 1), ("symbol", 2), ("file", 2)], "layer VARCHAR, place INT"))
def pack_slice(spark, sf_dir):
    return evidence.sliced(table(spark, _ITEMS, "layer string, place int, text string"), 40).select("layer", "place")


_NEEDS, _GIVEN = [("p1", ["login"]), ("p2", ["pay", "money"]), ("p3", ["nothing"])], [("e1", "Login form", True), ("e2", "pay flow", False), ("e3", "login and pay", False)]


@query(f"""WITH p AS ({values(_NEEDS, 'problem_id VARCHAR, terms VARCHAR[]')}), e AS ({values(_GIVEN, 'context_id VARCHAR, text VARCHAR, selected BOOLEAN')}) SELECT problem_id, count(context_id) AS evidence, CASE WHEN count(*) FILTER (selected) > 0 THEN 'covered' WHEN count(context_id) > 0 THEN 'queued' ELSE 'unresolved' END AS status
 FROM p LEFT JOIN e ON len(list_filter(terms, lambda t: contains(lower(text), t))) > 0 GROUP BY 1""")
def problem_status(spark, sf_dir):
    return views.problem_status(table(spark, _NEEDS, "problem_id string, terms array<string>"), table(spark, _GIVEN, "context_id string, text string, selected boolean")).select("problem_id", "evidence", "status")


_REQUIRED = [
    ("The mobile panel uses getSheet", "responsive-variants:counter-context,responsive-base:context,runtime-usage-1:challenge-if-no-match"), ("plain words here", "claim-context:context"), ("Text is localized", "translation-consumer:support-if-match,hardcoded-visible-copy:challenge-if-match"),
    ("`run_all` depends on the theme storage", "persistence-contract:context,dependency-reference:context"),
]


@query(values(_REQUIRED, "claim VARCHAR, requirements VARCHAR"))
def claim_requirements(spark, sf_dir):
    return table(spark, [(c, ",".join(f"{r}:{m}" for r, m, _ in pipelines.claim_requirements(c))) for c, _ in _REQUIRED], "claim string, requirements string")


@query(r"""WITH m AS (SELECT count(*) FILTER (regexp_matches(text, '(?i)license|public')) AS n FROM documents) SELECT 'claim-context' AS requirement_id, n AS match_count, CASE WHEN n > 0 THEN 'evidence-found' ELSE 'checked-no-match' END AS status FROM m""")
def claim_recall(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return pipelines.claim_recall("license public", texts)[0].select("requirement_id", "match_count", "status")


_WORKERS = ['{"worker": "a", "findings": [{"claim": "c1", "evidence": "e", "source": "s", "confidence": 0.9}, "just text"]}', '{"handoff": {"facts": [{"fact": "f", "detail": "d", "file": "x.py"}]}, "role": "r"}', '{"nothing": 1}']


@query(values([("a", "c1", "s", None), ("a", "just text", "worker:a", None), ("r", "f", "x.py", None), ("worker-3", "", "", "missing required field(s): claim, evidence, source")], "worker VARCHAR, claim VARCHAR, source VARCHAR, malformed_reason VARCHAR"))
def worker_inputs(spark, sf_dir):
    """A file of worker outputs, one a line, with a comment and a blank line among them."""
    root = folder(spark, {"in.ndjson": "# workers\n\n" + "\n".join(_WORKERS) + "\n"}, "workers")
    raw = worker_input.raw_findings(worker_input.read(spark, f"{root}/in.ndjson"))
    return findings.normalize(raw).select("worker", "claim", "source", "malformed_reason")


@query(f"WITH p AS ({values([(p, 0 if i % 3 == 0 else 1, t) for i, (p, t) in enumerate(sorted(REPOSITORY.items()))], 'path VARCHAR, same INT, text VARCHAR')}) SELECT path, CASE WHEN same = 1 THEN 'HEAD' ELSE 'working-tree' END AS source, sha1(encode('blob ' || octet_length(encode(text)) || chr(0)) || encode(text)) AS blob, same = 0 AS dirty FROM p")
def file_provenance(spark, sf_dir):
    files = table(spark, sorted(REPOSITORY.items()), "path string, content string")
    blob = version_control.blob_id(F.col("content"))
    old = table(spark, [(p, i % 3 == 0) for i, p in enumerate(sorted(REPOSITORY))], "path string, edited boolean")
    head = files.join(old, "path").select("path", F.when(F.col("edited"), F.sha1("path")).otherwise(blob).alias("blob"))
    return version_control.file_provenance(files, head, head, "c0ffee").select("path", "source", "blob", "dirty")


@query(values([("understand", 2, 2, "", 2, 1)], "task_type VARCHAR, lanes BIGINT, files BIGINT, reasons VARCHAR, active_files BIGINT, stale BIGINT"))
def context_request(spark, sf_dir):
    files = _files(spark).where("skipped IS NULL AND path LIKE 'src/%.js'")
    old = table(spark, [("x", "src/index.js", "0" * 40), ("y", "gone.js", "1")], "id string, path string, revision string")
    run = pipelines.execute_context("charge pay", files, active=old)
    one = run.plan.select("task_type").crossJoin(run.lanes.agg(F.count("*").alias("lanes"))).crossJoin(run.status.select("files", F.array_join("reasons", ",").alias("reasons")))  # one row each
    return one.crossJoin(run.locators.where("kind = 'file' AND tier = 'active'").agg(F.count("*").alias("active_files"))).crossJoin(run.stale.where("validity = 'stale'").agg(F.count("*").alias("stale")))


# --- SQL for queries of plans.queries that need what is above

_ITEM = r"^(?:[-*+•]|\d+[.)、]|[（(]\d+[)）]|[一二三四五六七八九十]+[、.])\s*(.+)$"
ORACLES["problem_list"] = rf"""WITH t AS (SELECT conv_id || ':' || turn AS task_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS lines, list_filter(list_transform(string_split_regex(text, '[;；\n]+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM conversations),
i AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, {quoted(_ITEM)})) AS items FROM t),
c AS (SELECT task_id, list_transform(CASE WHEN len(items) > 0 THEN list_transform(items, lambda x: regexp_extract(x, {quoted(_ITEM)}, 1)) ELSE parts END, lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^[ ;；]+|[ ;；]+$', '', 'g')) AS ps FROM i),
u AS (SELECT task_id, unnest(ps) AS text, generate_subscripts(ps, 1) AS place FROM c), f AS (SELECT task_id, min(place) AS place, arg_min(text, place) AS text FROM u WHERE text <> '' GROUP BY task_id, lower(text)),
n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY place) AS ordinal FROM f)
SELECT task_id, ordinal, 'problem-' || lpad(ordinal::VARCHAR, 3, '0') AS problem_id, text AS problem, len({QUERY_TERMS}) AS n_terms FROM n"""
ORACLES["synthesis_packet"] = f"""WITH RECURSIVE g AS (SELECT best_doc_id AS doc_id, best_confidence AS c, greatest(1, workers) AS a, refs AS e, sources AS s FROM ({DOC_GROUPS})),
o AS (SELECT row_number() OVER (ORDER BY c DESC, a DESC, e DESC, s DESC, trim(text, E' \\n\\t\\r')) AS r, trim(text, E' \\n\\t\\r') AS t, octet_length(encode(trim(text, E' \\n\\t\\r'))) + 1 AS size FROM g JOIN documents USING (doc_id)),
w(r, used, took) AS (SELECT 0::BIGINT, 0::BIGINT, false UNION ALL SELECT o.r, used + CASE WHEN used + size <= 24000 THEN size ELSE 0 END, used + size <= 24000 FROM w JOIN o ON o.r = w.r + 1)
SELECT o.r AS packet_rank, t AS text FROM w JOIN o USING (r) WHERE took"""

_TARGET = "array_to_string(list_filter(string_split(spec, '/'), lambda x: x NOT IN ('', '.')), '/')"


@query(f"""WITH f AS (SELECT DISTINCT {PATH} AS path FROM pages), i AS (SELECT DISTINCT {PATH} AS src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS spec FROM pages)
SELECT src, spec, f.path AS dst, CASE WHEN f.path IS NOT NULL THEN 'edge' WHEN spec[1] IN ('.', '/') THEN 'unresolved' ELSE 'external' END AS kind FROM i LEFT JOIN f ON spec[1] = '/' AND f.path = {_TARGET}""")
def page_links(spark, sf_dir):
    """The links of pages as imports of one page by another."""
    pages = read(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]*/?", ""), r"/*([?#].*)?$", "")
    links = pages.select(path.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))).alias("spec"))
    return graph.resolve_imports(links, _page_paths(spark, sf_dir))
