"""SQL for the rows of the queries, as DuckDB runs it on the same tables."""

from __future__ import annotations

import re as _re

from ..functions.text import COMMAND_RISKS, QUERY_STOP_WORDS, TRUST_SIGNALS
from ..operators import harness, packets
from . import queries as Q


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def norm(x: str) -> str:
    return rf"lower(trim(regexp_replace(coalesce({x}, ''), '[\s\x1c-\x1f]+', ' ', 'g')))"


def tokens(x: str) -> str:
    return f"((octet_length(encode(coalesce({x}, ''))) + 3) // 4)"


def any_of(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(t)})" for t in terms) + ")"


DOC_FINDINGS = f"""SELECT d.doc_id, d.source AS worker, d.lang AS evidence, d.text, 'claim:' || {norm('d.text')} AS group_key,
 CASE l.quality WHEN 1 THEN 0.9 WHEN 0 THEN 0.4 ELSE 0.5 END::DOUBLE AS confidence FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)"""
DOC_GROUPS = f"""SELECT group_key, count(*) AS occurrence_count, count(DISTINCT worker) AS workers, count(DISTINCT doc_id) AS sources, count(DISTINCT row(doc_id, evidence)) AS refs,
 arg_min(doc_id, row(-confidence, worker, doc_id::VARCHAR, doc_id)) AS best_doc_id, arg_min(confidence, row(-confidence, worker, doc_id::VARCHAR, doc_id)) AS best_confidence FROM ({DOC_FINDINGS}) GROUP BY group_key"""
LINES = """SELECT 'tuple:' || l_orderkey || '|returnflag||' AS identity, 'string:' || lower(l_returnflag) AS v, lower(l_linestatus) AS p FROM lineitem"""
TURNS = f"SELECT conv_id, turn, {tokens('text')}::BIGINT AS cost FROM conversations"
PARTS = f"""SELECT p_partkey AS idx, {norm('p_name')} AS claim, CASE WHEN p_partkey % 3 <> 0 THEN 'canonical:' || p_brand || '/' || p_type END AS identity, '|number:' || p_size || '|' AS side FROM part"""
_first = lambda *by: f"min(idx) OVER (PARTITION BY {', '.join(by)})"
_classes = [f"SELECT idx, {_first('claim')} AS c FROM f", f"SELECT idx, {_first('identity')} FROM f WHERE identity IS NOT NULL", f"SELECT idx, {_first('claim', 'side')} FROM f", f"SELECT idx, {_first('identity', 'side')} FROM f WHERE identity IS NOT NULL",
            f"SELECT idx, {_first('claim', 'side', 'identity')} FROM f", "SELECT idx, min(CASE WHEN identity IS NULL THEN idx END) OVER (PARTITION BY claim, side) FROM f"]
PAIRS = f"""f AS ({PARTS}), pairs AS (SELECT DISTINCT least(idx, c) AS l, greatest(idx, c) AS r FROM ({' UNION ALL '.join(_classes)}) WHERE idx <> c),
v AS (SELECT l, r, a.identity AS ai, b.identity AS bi, a.side AS sa, b.side AS sb, CASE WHEN a.identity <> b.identity THEN 'conflicting-identity' WHEN a.side <> b.side AND a.identity = b.identity THEN 'same-identity-different-assertion'
 WHEN a.side <> b.side THEN 'conflicting-structured-assertion' WHEN a.claim <> '' AND a.claim = b.claim THEN 'safe-duplicate' WHEN a.identity IS NULL OR b.identity IS NULL OR a.identity <> b.identity THEN 'insufficient-identity' ELSE 'safe-duplicate' END AS verdict
 FROM pairs JOIN f a ON a.idx = l JOIN f b ON b.idx = r)"""
EDGES = "SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem"
DEGREES = f"""SELECT n.node, coalesce(o, 0)::BIGINT AS out_degree, coalesce(i, 0)::BIGINT AS in_degree FROM (SELECT DISTINCT 'p' || p_partkey AS node FROM part) n
 LEFT JOIN (SELECT src AS node, count(*) AS o FROM ({EDGES}) GROUP BY 1) USING (node) LEFT JOIN (SELECT dst AS node, count(*) AS i FROM ({EDGES}) GROUP BY 1) USING (node)"""
LOCATORS = """SELECT p_partkey, 'part/' || lower(replace(p_brand, '#', '')) AS path, lower(replace(p_name, ' ', '_')) AS symbol, lower(p_type) AS signature, CASE WHEN p_partkey % 9 = 0 THEN 'file' ELSE 'symbol' END AS kind,
 p_size AS start_line, p_size + 10 AS end_line, p_partkey % 4 = 0 AS neighbour FROM part"""
_q = " ".join(Q.RECALL_QUERY.lower().split())
_terms = [t.lower() for t in _re.findall(r"[A-Za-z0-9_\-.]+", Q.RECALL_QUERY)]
_terms = [t for t in _terms if len(t) > 1 and t not in QUERY_STOP_WORDS][:40]
_term_points = " + ".join(f"(CASE WHEN contains(symbol, {quoted(t)}) THEN 15 ELSE 0 END + CASE WHEN contains(path, {quoted(t)}) THEN 9 ELSE 0 END + CASE WHEN contains(signature, {quoted(t)}) THEN 5 ELSE 0 END)" for t in _terms)
SCORED = f"""SELECT *, (base + CASE WHEN base > 0 AND neighbour THEN 7 ELSE 0 END)::DOUBLE AS score FROM (SELECT *, CASE WHEN exact_path THEN 80 ELSE 0 END + CASE WHEN exact_symbol THEN 100 ELSE 0 END + CASE WHEN symbol_mentioned THEN 55 ELSE 0 END
 + CASE WHEN contains({quoted(_q)}, path) THEN 45 ELSE 0 END + {_term_points} AS base FROM (SELECT *, path = {quoted(_q)} AS exact_path, symbol = {quoted(_q)} AS exact_symbol,
 regexp_matches({quoted(_q)}, '(^|[^A-Za-z0-9_])' || regexp_escape(symbol) || '($|[^A-Za-z0-9_])') AS symbol_mentioned FROM ({LOCATORS})))"""
_kterms = [t.lower() for t in _re.findall(r"[A-Za-z0-9_.$:/-]{2,}", Q.KNOWLEDGE_QUERY)]
ITEMS = """SELECT user_id AS session, event_type AS item, max(epoch(date_trunc('second', ts)))::BIGINT AS last_accessed, count(*) AS access_count, sum(floor(abs(value)))::BIGINT AS estimated_tokens FROM events GROUP BY 1, 2"""


def _trust() -> str:
    case = ", ".join(f"CASE WHEN regexp_matches(content, {quoted('(?is)' + p)}) THEN {quoted(n)} END" for n, _, p in TRUST_SIGNALS)
    high = " OR ".join(f"regexp_matches(content, {quoted('(?is)' + p)})" for _, s, p in TRUST_SIGNALS if s == "high")
    medium = " OR ".join(f"regexp_matches(content, {quoted('(?is)' + p)})" for _, s, p in TRUST_SIGNALS if s == "medium")
    return f"list_filter([{case}], lambda x: x IS NOT NULL) AS signals, CASE WHEN {high} THEN 'high' WHEN {medium} THEN 'medium' ELSE 'none' END AS severity"


SPOKEN = "SELECT conv_id, turn, '[' || role || '] ' || text AS content FROM conversations"
_stop = ", ".join(map(quoted, QUERY_STOP_WORDS))
QUERY_TERMS = rf"list_slice(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_\-.]+|[一-鿿]{{1,8}}'), lambda x: lower(x)), lambda x: length(x) > 1 AND x NOT IN ({_stop})), 1, 40)"


def _points(text: str, rules) -> str:
    return " + ".join(f"CASE WHEN {any_of(text, terms)} THEN {points} ELSE 0 END" for _, points, terms in rules)


def _hits(text: str, terms) -> str:
    return "(" + " + ".join(f"contains({text}, {quoted(t)})::INT" for t in dict.fromkeys(terms)) + ")"


def _complexity_risk() -> str:
    return f"""WITH t AS (SELECT conv_id, turn, lower(trim(text)) AS x FROM conversations),
s AS (SELECT *, CASE WHEN length(x) > 500 THEN 2 WHEN length(x) > 180 THEN 1 ELSE 0 END + {_points('x', harness.COMPLEXITY)} AS c, {_points('x', harness.RISK)} + ({_hits('x', harness.NOVELTY)} > 0)::INT AS r,
 least(1.0::DOUBLE, 0.22::DOUBLE * {_hits('x', harness.AMBIGUITY)}) AS a, least(1.0::DOUBLE, 0.35::DOUBLE * {_hits('x', harness.NOVELTY)}) AS n FROM t)
SELECT conv_id, turn, c::BIGINT AS complexity, CASE WHEN c <= 1 THEN 'trivial' WHEN c <= 3 THEN 'focused' WHEN c <= 6 THEN 'complex' ELSE 'autonomous' END AS complexity_level, r::BIGINT AS risk,
 CASE WHEN r <= 1 THEN 'low' WHEN r <= 4 THEN 'medium' WHEN r <= 7 THEN 'high' ELSE 'critical' END AS risk_level, round(greatest(0.35::DOUBLE, least(0.98::DOUBLE, 0.9::DOUBLE - a * 0.45::DOUBLE - n * 0.15::DOUBLE)), 3) AS routing_confidence FROM s"""


def _route() -> str:
    scores = [f"({' + '.join(f'CASE WHEN contains(x, {quoted(t)}) THEN {2 if len(t) > 3 else 1} ELSE 0 END' for t in terms)})" for terms in harness.ROUTES.values()]
    names = list(harness.ROUTES)
    cols = ", ".join(f"{s} AS s{i}" for i, s in enumerate(scores))
    order = sorted(range(len(names)), key=lambda i: names[i], reverse=True)
    top = "greatest(" + ", ".join(f"s{i}" for i in range(len(names))) + ")"
    case = " ".join(f"WHEN s{i} = {top} THEN {quoted(names[i])}" for i in order)
    return f"SELECT CASE WHEN {top} = 0 THEN 'understand' {case} END AS route, count(*) AS n FROM (SELECT {cols} FROM (SELECT lower(text) AS x FROM conversations)) GROUP BY 1"


SCENARIOS = "(VALUES " + ", ".join("(" + ", ".join([quoted(s[0]), *(repr(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else quoted(x) if isinstance(x, str) else str(x) for x in s[1:])]) + ")" for s in harness.SCENARIOS) + ") s(name, source_tokens, output_tokens, dup, conflict, complexity, risk, workers, parallel)"
MODES = f"""WITH s AS (SELECT name, source_tokens::BIGINT AS st, output_tokens::BIGINT AS b, dup::DOUBLE AS dup, conflict::DOUBLE AS conflict, complexity, risk, workers::BIGINT AS w, parallel FROM {SCENARIOS}),
c AS (SELECT *, greatest(256, round_even(st * (1.0::DOUBLE - least(0.72::DOUBLE, dup * 0.85::DOUBLE)), 0)::BIGINT) AS ctx, greatest(200, round_even(b * 0.24::DOUBLE * w, 0)::BIGINT) AS wo FROM s),
p AS (SELECT *, greatest(220, round_even(wo * 0.62::DOUBLE, 0)::BIGINT) + round_even(ctx * least(0.10::DOUBLE, conflict * 0.30::DOUBLE), 0)::BIGINT AS packet, round_even(ctx * 0.90::DOUBLE, 0)::BIGINT AS ev FROM c),
m AS (SELECT name, 'direct' AS mode, NOT (complexity IN ('complex', 'autonomous') OR risk <> 'low' OR conflict >= 0.03 OR parallel) AS eligible, ctx + 220 AS tokens_in, b AS tokens_out, 1::BIGINT AS calls, 1.0::DOUBLE AS latency FROM p
 UNION ALL SELECT name, 'light', NOT (complexity = 'autonomous' OR risk IN ('high', 'critical') OR conflict >= 0.08 OR parallel), ctx + 220 + greatest(160, round_even(b * 0.38::DOUBLE, 0)::BIGINT) + 180, b + greatest(80, round_even(b * 0.12::DOUBLE, 0)::BIGINT), 2, 1.55 FROM p
 UNION ALL SELECT name, 'full', true, ev + 200 * w + (ctx - ev) + packet + 180 + packet + 180, wo + greatest(100, round_even(b * 0.14::DOUBLE, 0)::BIGINT) + b, w + 2, 2.0 + 0.22 * w FROM p)"""
DAG = "(VALUES " + ", ".join(f"({quoted(n)}, {quoted(o)})" for n, o in Q.DAG if o) + ") e(node, needs)"
NODES = "(VALUES " + ", ".join(f"({quoted(n)})" for n in sorted({n for n, _ in Q.DAG})) + ") n(node)"
PATH = r"regexp_replace(regexp_replace(url, '^https?://[^/]*/?', ''), '/*([?#].*)?$', '')"

ORACLES = {
    "fanin_groups": f"SELECT sha256(group_key) AS group_sha256, occurrence_count, greatest(1, workers) AS agreement_count, sources AS independent_source_count, refs AS independent_evidence_count, occurrence_count - 1 AS duplicates, occurrence_count - workers AS intra_worker_repeats, best_doc_id, best_confidence FROM ({DOC_GROUPS})",
    "fanin_stats": f"""WITH f AS ({DOC_FINDINGS}), k AS (SELECT * FROM f WHERE confidence >= 0.45), g AS (SELECT group_key, count(*) AS n, count(DISTINCT worker) AS w FROM k GROUP BY 1)
SELECT (SELECT count(*) FROM f) AS extracted, 0::BIGINT AS malformed, (SELECT count(*) FROM f WHERE confidence < 0.45) AS filtered, 0::BIGINT AS quarantined, (SELECT count(*) FROM k) AS valid, count(*) AS output, sum(n - 1)::BIGINT AS duplicates,
 sum(n - w)::BIGINT AS intra_worker_repeats, sum(w - 1)::BIGINT AS cross_worker_support, max(n) AS max_occurrence, max(greatest(1, w)) AS max_agreement FROM g""",
    "finding_normalize": f"SELECT conv_id, turn, 'conv:' || conv_id AS source, CASE WHEN turn / 4 BETWEEN 0 AND 1 THEN turn / 4 ELSE 0.5 END::DOUBLE AS confidence, sha256('claim:' || {norm('text')}) AS group_sha256, length({norm('text')}) AS claim_length FROM conversations",
    "malformed_reasons": """SELECT CASE WHEN m <> '' THEN 'missing required field(s): ' || m END AS malformed_reason, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'claim' END, CASE WHEN o_orderkey % 5 = 0 THEN 'evidence' END,
 CASE WHEN o_orderkey % 7 = 0 THEN 'source' END], lambda x: x IS NOT NULL), ', ') AS m FROM orders) GROUP BY 1""",
    "contradictions": f"""SELECT identity, count(*) AS findings, count(DISTINCT p) AS polarities, count(DISTINCT v) AS "values", count(DISTINCT row(p, v)) AS sides,
 array_to_string(list_filter([CASE WHEN count(DISTINCT p) > 1 THEN 'polarity disagreement' END, CASE WHEN count(DISTINCT v) > 1 THEN 'value disagreement' END], lambda x: x IS NOT NULL), '; ') AS reasons
 FROM ({LINES}) GROUP BY identity HAVING count(*) > 1 AND (count(DISTINCT p) > 1 OR count(DISTINCT v) > 1)""",
    "assertion_sides": f"SELECT p || '|' || v || '|' AS side, count(*) AS n, count(DISTINCT identity) AS identities FROM ({LINES}) GROUP BY 1",
    "trust_scan": f"SELECT conv_id, turn, severity, array_to_string(list_sort(signals), ',') AS signals FROM (SELECT *, {_trust()} FROM ({SPOKEN}))",
    "trust_summary": f"""WITH t AS (SELECT {_trust()} FROM (SELECT content FROM ({SPOKEN}) UNION ALL SELECT html FROM pages)) SELECT severity, count(*) AS n, NULL::VARCHAR AS signal FROM t GROUP BY 1
 UNION ALL SELECT CASE s {' '.join(f'WHEN {quoted(n)} THEN {quoted(v)}' for n, v, _ in TRUST_SIGNALS)} END, count(*), s FROM (SELECT unnest(signals) AS s FROM t) GROUP BY s""",
    "command_risks": f"SELECT risk, CASE risk {' '.join(f'WHEN {quoted(r)} THEN {quoted(p)}' for r, p, _ in COMMAND_RISKS)} ELSE 'normal' END AS permission, count(*) AS n FROM (SELECT CASE {' '.join(f'WHEN regexp_matches(lower(text), {quoted("|".join(f"(?:{x})" for x in ps))}) THEN {quoted(r)}' for r, _, ps in COMMAND_RISKS)} ELSE 'read-only-or-unknown' END AS risk FROM conversations) GROUP BY 1",
    "token_estimate_by_lang": f"SELECT lang, sum({tokens('text')})::BIGINT AS tokens, count(*) AS n FROM documents GROUP BY lang",
    "query_terms": f"SELECT conv_id, turn, len({QUERY_TERMS}) AS n_terms, array_to_string({QUERY_TERMS}, ' ') AS terms FROM conversations",
    "dedup_blocks": r"""WITH b AS (SELECT doc_id AS o, source AS p, 'content|' || text AS k, NULL AS loc, n_chars::DOUBLE AS s, 'content' AS kind FROM documents UNION ALL SELECT page_id + 10000000, 'pages',
 'identity|' || regexp_replace(url, '[?#].*$', ''), regexp_replace(url, '[?#].*$', ''), NULL, 'identity' FROM pages)
SELECT min(o) AS first_seen, count(*) AS occurrence_count, count(DISTINCT p) AS provider_count, count(DISTINCT loc) AS location_count, max(s) AS provider_score, kind FROM b GROUP BY k, kind""",
    "candidate_pairs_jaccard": f"""WITH f AS ({PARTS}), t AS (SELECT idx, unnest(list_distinct(list_filter(regexp_extract_all(claim, '[a-z0-9_.:/-]{{2,}}'), lambda x: x NOT IN ('the', 'and', 'for', 'with', 'from', 'this', 'that', 'into', 'is', 'are', 'was', 'were')))) AS term FROM f),
n AS (SELECT idx, count(*) AS n FROM t GROUP BY idx),
c AS (SELECT a.idx AS l, b.idx AS r FROM t a JOIN t b ON a.term = b.term AND a.idx < b.idx UNION SELECT a.idx, b.idx FROM f a JOIN f b ON a.identity = b.identity AND a.idx < b.idx),
s AS (SELECT l, r, count(b.term) AS x FROM c JOIN t a ON a.idx = l LEFT JOIN t b ON b.idx = r AND b.term = a.term GROUP BY l, r),
j AS (SELECT l, r, round(x::DOUBLE / (p.n + q.n - x), 6) AS score, fa.identity = fb.identity AS same FROM s JOIN n p ON p.idx = l JOIN n q ON q.idx = r JOIN f fa ON fa.idx = l JOIN f fb ON fb.idx = r)
SELECT l AS "left", r AS "right", score FROM j WHERE score >= 0.5 OR same ORDER BY score DESC, l, r LIMIT 2000""",
    "verify_pairs": f"WITH {PAIRS} SELECT verdict, verdict = 'safe-duplicate' AS merge_authorized, count(*) AS n FROM v GROUP BY 1",
    "guarded_components": f"""WITH RECURSIVE {PAIRS}, e AS (SELECT l AS a, r AS b FROM v WHERE verdict = 'safe-duplicate' UNION SELECT r, l FROM v WHERE verdict = 'safe-duplicate'),
w(node, c) AS (SELECT a, a FROM e UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.node), raw AS (SELECT node, min(c) AS c FROM w GROUP BY node),
m AS (SELECT raw.c, count(DISTINCT identity) AS ni, count(DISTINCT side) AS ns FROM raw JOIN f ON f.idx = raw.node GROUP BY 1),
k AS (SELECT l AS a, r AS b FROM v JOIN raw ON raw.node = l JOIN m USING (c) WHERE verdict = 'safe-duplicate' AND (ni <= 1 OR ai IS NOT DISTINCT FROM bi) AND (ns <= 1 OR sa IS NOT DISTINCT FROM sb)),
e2 AS (SELECT a, b FROM k UNION SELECT b, a FROM k), w2(node, c) AS (SELECT a, a FROM e2 UNION SELECT e2.b, w2.c FROM w2 JOIN e2 ON e2.a = w2.node)
SELECT idx, coalesce(min(c), idx) AS component FROM f LEFT JOIN w2 ON w2.node = idx GROUP BY idx""",
    "embedding_candidates": """SELECT l AS "left", r AS "right", score FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS n FROM (SELECT a.vec_id AS l, b.vec_id AS r, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
 FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)) WHERE n <= 3""",
    "synthesis_order": f"""WITH g AS (SELECT best_doc_id AS doc_id, best_confidence AS c, greatest(1, workers) AS a, refs AS e, sources AS s FROM ({DOC_GROUPS}))
SELECT doc_id, row_number() OVER (ORDER BY c DESC, a DESC, e DESC, s DESC, trim(text, E' \\n\\t\\r')) AS packet_rank FROM g JOIN documents USING (doc_id)""",
    "source_refs": "SELECT source, first_cited, 'S' || row_number() OVER (ORDER BY first_cited, source) AS ref FROM (SELECT source, min(doc_id) AS first_cited FROM documents GROUP BY source)",
    "audit_findings": f"SELECT 0::BIGINT AS n_problems, count(*) AS n FROM ({DOC_GROUPS})",
    "graph_degree": DEGREES,
    "graph_khop": f"WITH e AS ({EDGES}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), one AS (SELECT unnest(['p1', 's2']) AS node UNION SELECT dst FROM b WHERE src IN ('p1', 's2')) SELECT node FROM one UNION SELECT dst FROM b JOIN one ON src = node",
    "graph_bfs": """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 97 AS dst FROM lineitem), w(node, d) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, d + 1 FROM w JOIN e ON e.src = node WHERE d < 4)
SELECT node, min(d)::INT AS distance FROM w GROUP BY node""",
    "import_resolution": f"""WITH f AS (SELECT DISTINCT {PATH} AS path FROM pages), i AS (SELECT path AS src, './' || string_split(path, '/')[-1] AS spec, path AS target FROM f UNION SELECT path, '../' || path, array_to_string(list_concat(string_split(path, '/')[:-3], string_split(path, '/')), '/') FROM f
 UNION SELECT path, 'left-pad', NULL FROM f UNION SELECT path, './no/../such', array_to_string(list_concat(string_split(path, '/')[:-2], ['such']), '/') FROM f)
SELECT src, spec, f.path AS dst, CASE WHEN f.path IS NOT NULL THEN 'edge' WHEN spec[1] IN ('.', '/') THEN 'unresolved' ELSE 'external' END AS kind FROM i LEFT JOIN f ON f.path = i.target""",
    "recall_scores": f"SELECT p_partkey, score, exact_path, exact_symbol, symbol_mentioned FROM ({SCORED})",
    "recall_prune": f"""WITH h AS (SELECT 'part/' || lower(replace(p_brand, '#', '')) AS path, list(DISTINCT p_size) AS lines FROM part WHERE p_size % 11 = 0 GROUP BY 1),
s AS (SELECT s.*, lines IS NOT NULL AS text_hit, kind = 'symbol' AND coalesce(len(list_filter(lines, lambda x: x BETWEEN start_line AND end_line)), 0) > 0 AS span_hit FROM ({SCORED}) s LEFT JOIN h USING (path)),
t AS (SELECT * EXCLUDE (score), score + CASE WHEN text_hit THEN 20 ELSE 0 END + CASE WHEN span_hit THEN 45 ELSE 0 END AS score FROM s), r AS (SELECT *, max(score) OVER () AS top, bool_or(text_hit) OVER () AS hit FROM t WHERE score > 0),
k AS (SELECT * FROM r WHERE score >= CASE WHEN top >= 80 THEN greatest(30, top * 0.25) WHEN hit THEN 20 ELSE 0 END)
SELECT p_partkey, score::DOUBLE AS score, text_hit, span_hit FROM k WHERE NOT (kind = 'file' AND NOT exact_path AND path IN (SELECT path FROM k WHERE kind = 'symbol' AND (exact_symbol OR symbol_mentioned OR span_hit)))""",
    "grep_hits": f"""WITH l AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS path, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT path, line, content FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS n FROM l WHERE regexp_matches(content, {quoted(Q.GREP)})) WHERE n <= 3 ORDER BY path, line LIMIT 80""",
    "grep_counts": f"""WITH l AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS path, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT path, count(*) AS hits, min(line) AS first_line FROM l WHERE regexp_matches(content, {quoted(Q.GREP)}) GROUP BY path""",
    "knowledge_topk": f"""WITH d AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS path, text, lower(lpad(doc_id::VARCHAR, 12, '0') || chr(10) || text) AS hay, lower(text) AS low FROM documents),
s AS (SELECT *, {' + '.join(f"(length(hay) - length(replace(hay, {quoted(t)}, ''))) // {len(t)}" for t in _kterms)} AS score, coalesce(least({', '.join(f"nullif(instr(low, {quoted(t)}), 0)" for t in _kterms)}), 1) AS f FROM d)
SELECT path, score, f AS first_at, sha256(substring(text, greatest(1, f - 220), least(220, f - 1) + 900)) AS snippet_sha256 FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 8""",
    "claim_observations": "WITH m AS (" + " UNION ALL ".join(f"SELECT {quoted(r)} AS requirement_id, {quoted(m)} AS mode, count(*) FILTER (regexp_matches(html, {quoted(p)})) AS match_count FROM pages" for r, m, p in Q.REQUIREMENTS) + """) SELECT *, CASE WHEN mode = 'challenge-if-match' AND match_count > 0 OR mode = 'challenge-if-no-match' AND match_count = 0 THEN 'challenge-signal'
 WHEN mode = 'support-if-match' AND match_count > 0 THEN 'support-signal' WHEN mode = 'counter-context' AND match_count > 0 THEN 'counter-context-found' WHEN match_count > 0 THEN 'evidence-found' ELSE 'checked-no-match' END AS status FROM m""",
    "budget_prefix": f"SELECT conv_id, turn, used::BIGINT AS used, used <= 60 AS selected FROM (SELECT conv_id, turn, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM ({TURNS}))",
    "budget_skip": f"""WITH t AS (SELECT conv_id, list(struct_pack(o := turn, c := cost) ORDER BY turn) AS x FROM ({TURNS}) GROUP BY conv_id)
SELECT conv_id, s.u::BIGINT AS used, array_to_string(s.t, ',') AS taken FROM (SELECT conv_id, list_reduce(list_transform(x, lambda y: struct_pack(u := y.c, t := [y.o], c := y.c)), lambda a, y: CASE WHEN a.u + y.u <= 60 THEN struct_pack(u := a.u + y.u, t := list_concat(a.t, y.t), c := 0::BIGINT) ELSE a END, struct_pack(u := 0::BIGINT, t := []::BIGINT[], c := 0::BIGINT)) AS s FROM t)""",
    "batch_next_fit": f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM ({TURNS})), w AS (SELECT conv_id, turn, cost, n, 1::BIGINT AS batch, cost AS used FROM t WHERE n = 1
 UNION ALL SELECT t.conv_id, t.turn, t.cost, t.n, CASE WHEN w.used + t.cost > 60 THEN batch + 1 ELSE batch END, CASE WHEN w.used + t.cost > 60 THEN t.cost ELSE w.used + t.cost END FROM w JOIN t ON t.conv_id = w.conv_id AND t.n = w.n + 1)
SELECT conv_id, turn, cost, batch FROM w""",
    "budget_trim": f"SELECT conv_id, turn, used::BIGINT AS used FROM (SELECT conv_id, turn, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM ({TURNS})) WHERE used <= 60 OR n = 1",
    "largest_remainder": """WITH w AS (SELECT s_suppkey, s_nationkey, greatest(0.01, floor(abs(s_acctbal))) AS w FROM supplier), r AS (SELECT *, 1000 * w / sum(w) OVER (PARTITION BY s_nationkey) AS raw FROM w), b AS (SELECT *, floor(raw) AS base FROM r)
SELECT s_suppkey, s_nationkey, (base + CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY round(raw - base, 9) DESC, s_suppkey) <= 1000 - sum(base) OVER (PARTITION BY s_nationkey) THEN 1 ELSE 0 END)::BIGINT AS allocated FROM b""",
    "round_robin_merge": """WITH q AS (SELECT p_partkey, p_size, unnest([CASE WHEN p_partkey % 2 = 0 THEN 0 END, CASE WHEN p_partkey % 3 = 0 THEN 1 END, CASE WHEN p_partkey % 5 = 0 THEN 2 END, CASE WHEN p_partkey % 7 = 0 THEN 3 END]) AS queue FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY p_size DESC, p_partkey) AS position FROM q WHERE queue IS NOT NULL) SELECT p_partkey, min(position) AS position, arg_min(queue, row(position, queue))::BIGINT AS queue FROM n GROUP BY p_partkey""",
    "ledger_compare": "SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM documents",
    "ledger_upsert": "SELECT doc_id AS key, sha256(CASE WHEN doc_id % 2 = 0 AND doc_id % 5 = 0 THEN text || '!' ELSE text END) AS fingerprint FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0",
    "stale_invalidation": "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'missing' WHEN doc_id % 3 = 0 AND md5(text) <> md5(source) THEN 'stale' ELSE 'current' END AS validity FROM documents",
    "reconcile": "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'active' ELSE 'rejected' END AS tier, CASE WHEN doc_id % 2 = 1 AND doc_id % 3 <> 0 AND doc_id % 5 = 0 THEN 'resurrected' WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'retired' ELSE 'kept' END AS outcome FROM documents",
    "lifecycle_tiers": f"SELECT CASE WHEN {Q.NOW} - last_accessed <= 259200 THEN 'hot' WHEN {Q.NOW} - last_accessed <= 432000 THEN 'warm' ELSE 'cold' END AS tier, count(*) AS n, sum(estimated_tokens)::BIGINT AS tokens FROM ({ITEMS}) GROUP BY 1",
    "lifecycle_evict": f"SELECT session, item, sum(estimated_tokens) OVER (PARTITION BY session) - coalesce(sum(estimated_tokens) OVER (PARTITION BY session ORDER BY last_accessed, access_count, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 1000 AS demoted FROM ({ITEMS})",
    "telemetry_summary": """SELECT user_id % 10 AS run_id, count(DISTINCT user_id) AS workers, count(*) AS attempts, count(*) FILTER (event_type = 'click') AS succeeded, sum(floor(abs(value)))::BIGINT AS input_tokens, sum(event_id % 50)::BIGINT AS output_tokens,
 round(sum(event_id % 1000)::DOUBLE, 2) AS latency_ms, count(CASE WHEN event_id % 2 = 0 THEN value END) AS cost_samples, CASE WHEN count(CASE WHEN event_id % 2 = 0 THEN value END) = 0 THEN 'unreported' WHEN count(CASE WHEN event_id % 2 = 0 THEN value END) = count(*) THEN 'complete' ELSE 'partial' END AS cost_completeness FROM events GROUP BY 1""",
    "provider_health": """WITH h AS (SELECT user_id AS provider, count(*) AS attempts, count(*) FILTER (event_id % 3 <> 0) AS successes, round(avg(event_id % 1000), 2) AS avg_latency_ms FROM events GROUP BY 1), r AS (SELECT *, round(successes::DOUBLE / attempts, 4) AS success_rate FROM h)
SELECT *, CASE WHEN attempts >= 3 THEN success_rate >= 0.5 END AS healthy, CASE WHEN attempts >= 3 THEN round((1 - success_rate) * 20, 4) ELSE 0.0 END AS penalty FROM r""",
    "trace_replay": "SELECT event_type AS kind, count(*) AS events FROM events GROUP BY 1",
    "recall_benchmark": """SELECT doc_id % 7 AS "case", count(*) AS gold, count(*) FILTER (toxic = 1) AS found_before, count(*) FILTER (toxic = 1 OR doc_id % 2 = 0) AS found_after, round(count(*) FILTER (toxic = 1)::DOUBLE / count(*), 4) AS recall_before,
 round(count(*) FILTER (toxic = 1 OR doc_id % 2 = 0)::DOUBLE / count(*), 4) AS recall_after FROM labels WHERE quality = 1 GROUP BY 1""",
    "topological_waves": f"WITH RECURSIVE w(node, wave) AS (SELECT node, 0 FROM {NODES} WHERE node NOT IN (SELECT node FROM {DAG}) UNION SELECT e.node, wave + 1 FROM w JOIN {DAG} ON needs = w.node) SELECT node, max(wave)::BIGINT AS wave FROM w GROUP BY node",
    "complexity_risk": _complexity_risk(),
    "route": _route(),
    "reduction_modes": f"{MODES} SELECT name, mode, eligible, tokens_in, tokens_out, tokens_in + tokens_out AS total_tokens, calls FROM m",
    "simulate": f"""{MODES}, b AS (SELECT name, arg_min(mode, row(tokens_in + tokens_out, calls, latency, mode)) FILTER (eligible) AS mode, min(tokens_in + tokens_out) FILTER (eligible) AS t, max(tokens_in + tokens_out) FILTER (eligible AND mode = 'direct') AS d FROM m GROUP BY name),
k AS (SELECT *, d IS NOT NULL AND mode <> 'direct' AND (d - t < 256 OR (d - t) / d::DOUBLE < 0.03) AS stay FROM b) SELECT name, CASE WHEN stay THEN 'direct' ELSE mode END AS selected_mode, CASE WHEN stay THEN d ELSE t END AS selected_tokens FROM k""",
    "workflow_dimensions": f"""WITH c AS (SELECT lower(text) AS x FROM conversations), d AS (SELECT x, list_filter([{', '.join(f"CASE WHEN {any_of('x', t)} THEN {quoted(n)} END" for n, t in packets.DIMENSIONS)}], lambda y: y IS NOT NULL) AS s FROM c)
SELECT dimension, count(*) AS n FROM (SELECT unnest(CASE WHEN contains(x, 'workflow') THEN [{', '.join(quoted(n) for n, _ in packets.DIMENSIONS)}] WHEN len(s) > 0 THEN s ELSE ['cross-layer-contract'] END) AS dimension FROM d) GROUP BY 1""",
    "set_ops_sync": "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 3 = 0 THEN 'added' ELSE 'removed' END AS change FROM documents WHERE (doc_id % 3 = 0) <> (doc_id % 5 = 0)",
    "contract_errors": """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 4 = 0 OR trim(text) = '' THEN 'claim must be non-empty' END, CASE WHEN doc_id % 6 = 0 OR trim(coalesce(lang, '')) = '' THEN 'evidence must be non-empty' END, CASE WHEN trim(coalesce(source, '')) = '' THEN 'source must be non-empty' END,
 CASE WHEN doc_id / 500 > 1 THEN 'confidence must be within 0..1' END], lambda x: x IS NOT NULL), '; ') AS errors FROM documents""",
    "stream_fanin": f"SELECT sha256('claim:' || {norm('text')}) AS group_sha256, count(*) AS occurrence_count, count(DISTINCT role) AS workers, count(DISTINCT conv_id) AS independent_source_count, arg_min(conv_id * 1000 + turn, row(role, conv_id::VARCHAR, conv_id * 1000 + turn)) AS best FROM conversations WHERE {norm('text')} IS NOT NULL GROUP BY {norm('text')}",
}
ORACLES["claim_status"] = f"""WITH o AS ({ORACLES['claim_observations']}), c AS (SELECT count(*) FILTER (status = 'challenge-signal') AS challenge, count(*) FILTER (status = 'support-signal') AS support, count(*) FILTER (status = 'counter-context-found') AS counter, 0::BIGINT AS incomplete FROM o)
SELECT *, CASE WHEN challenge > 0 THEN 'challenged' WHEN support > 0 THEN 'provisionally-supported' ELSE 'inconclusive' END AS status FROM c"""
_words = ["login", "steel", "part"]
_concept = ["auth", "authentication", "session", "token", "jwt", "cookie", "credential", "refresh", "signin", "sign-in"]
_lex = lambda ts: " + ".join(f"(CASE WHEN contains(path, {quoted(t)}) THEN 8 ELSE 0 END + CASE WHEN contains(sy, {quoted(t)}) THEN 5 ELSE 0 END + CASE WHEN contains(im, {quoted(t)}) THEN 2 ELSE 0 END)" for t in ts)
ORACLES["rank_files"] = f"""WITH f AS (SELECT 'p' || p_partkey AS path, lower(p_name) AS sy, lower(p_type) AS im, p_size::DOUBLE AS st, p_partkey = 1 AS en, CASE WHEN p_partkey BETWEEN 1 AND 3 THEN p_partkey - 1 END AS dist FROM part), g AS ({DEGREES})
SELECT path, round(st * 0.45::DOUBLE + (log2(1.0::DOUBLE + in_degree) * 7 + log2(1.0::DOUBLE + out_degree) * 3) * 0.85::DOUBLE + CASE WHEN en THEN 15.0 ELSE 0.0 END::DOUBLE * 0.35::DOUBLE + CASE WHEN dist IS NOT NULL THEN greatest(0.0, 8.0 - dist * 1.5) ELSE 0.0 END::DOUBLE * 0.75::DOUBLE
 + (({_lex(_words)})::DOUBLE + ({_lex(_concept)})::DOUBLE * 0.35::DOUBLE) * 1.8::DOUBLE, 3) AS rank_score, array_to_string(list_filter([{', '.join(f"CASE WHEN {any_of('path', [t])} OR {any_of('sy', [t])} OR {any_of('im', [t])} THEN {quoted(t)} END" for t in _words)}], lambda x: x IS NOT NULL), ' ') AS matched_terms FROM f JOIN g ON g.node = f.path"""
