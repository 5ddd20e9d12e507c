"""Streams, versioned stores, folds, merges, search and differences as queries on the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates, diff, evidence, folds, overlay, packets, trigrams
from ..operators.findings import normalize
from ..sources import worker_input
from ..store import Store
from ..streaming import fanin
from ..tables import new_path, written
from . import pipelines
from .more import QUERIES, query
from .oracles import norm
from .queries import read

_TURNS = "SELECT lower(left(text, 2)) AS claim, 'w' || turn % 5 AS worker, role AS evidence, 's' || conv_id % 7 AS source, conv_id, turn FROM conversations"


@query(f"""SELECT sha256('claim:' || {norm('claim')}) AS group_sha256, count(*) AS occurrence_count, count(DISTINCT worker) AS workers, count(DISTINCT source) AS independent_source_count,
count(DISTINCT row(source, evidence)) AS independent_evidence_count FROM ({_TURNS}) WHERE {norm('claim')} <> '' GROUP BY {norm('claim')}""")
def stream_ndjson_fanin(spark, sf_dir):
    """Turns as NDJSON of worker outputs, written in two parts and read as a stream that is stopped and started again."""
    turns = read(spark, sf_dir, "conversations")
    out = turns.select("turn", F.to_json(F.struct(F.concat(F.lit("w"), F.col("turn") % 5).alias("worker"), F.array(F.struct(F.lower(F.left("text", F.lit(2))).alias("claim"), F.col("role").alias("evidence"), F.concat(F.lit("s"), F.col("conv_id") % 7).alias("source"))).alias("findings"))).alias("value"))
    folder, state = new_path(spark, "worker-outputs"), new_path(spark, "fan-in")
    for part in (0, 1):
        out.where(F.col("turn") % 2 == part).select("value").write.mode("append").text(folder)
        stream = normalize(worker_input.raw_findings(worker_input.stream_ndjson(spark, folder))).where("malformed_reason IS NULL")
        groups = fanin.run(stream, "turns", path=state)
    return groups.select(F.sha2("group_key", 256).alias("group_sha256"), "occurrence_count", "workers", "independent_source_count", "independent_evidence_count")


@query("""SELECT 1 AS version, p_partkey, p_name, p_retailprice AS price, 1::BIGINT AS changes FROM part UNION ALL
SELECT 2, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 ELSE p_retailprice END, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END FROM part UNION ALL
SELECT 3, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 ELSE p_retailprice END, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END FROM part WHERE p_size % 2 = 0""")
def store_versions(spark, sf_dir):
    """Parts put into a store, a third of them anew, those of odd size removed: all three versions, read after the last."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_retailprice").cast("double").alias("price"), F.lit(1).cast("long").alias("changes"), "p_size")
    store = Store(spark, new_path(spark, "parts"), ["p_partkey"], part.drop("p_size").schema, 8)
    store.upsert(part)
    store.upsert(part.where("p_partkey % 3 = 0").withColumns({"p_name": F.upper("p_name"), "price": F.col("price") * 2}), {"changes": F.col("old.changes") + 1})
    store.delete(part.where("p_size % 2 <> 0"))
    versions = [store.read(v).withColumn("version", F.lit(v)) for v in (1, 2, 3)]
    return versions[0].unionByName(versions[1]).unionByName(versions[2])


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'removed' END AS change, CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 OR doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'rejected' ELSE 'active' END AS tier
FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0 OR doc_id % 2 = 0""")
def overlay_changes(spark, sf_dir):
    """Evidence of documents taken up, turned down and retired: what changed since the first version."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("path"), "doc_id")
    kept, gone = overlay.overlay(spark, new_path(spark, "overlay"), 8)
    overlay.put(kept, docs.where("doc_id % 5 <> 0").withColumn("tier", F.lit("active")))
    overlay.put(kept, docs.where("doc_id % 5 = 0 AND doc_id % 2 = 0").withColumn("tier", F.lit("rejected")))
    overlay.promote(kept, docs.where("doc_id % 5 = 0 AND doc_id % 2 <> 0").withColumn("validity", F.lit("current")), F.lit(7))
    overlay.put(kept, docs.where("doc_id % 5 <> 0 AND doc_id % 3 = 0").withColumns({"tier": F.lit("rejected"), "rejection_reason": F.lit("third")}))
    overlay.retire(kept, gone, docs.where("doc_id % 2 = 0"), "even", F.lit(9))
    return kept.changes(1).select("id", "change", "tier")


@query("""WITH n AS (SELECT l_orderkey AS o, l_linenumber AS n, max(CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END) AS s FROM lineitem GROUP BY ALL)
SELECT 'run-' || o_orderkey AS run_id, 2::BIGINT AS resume_count, (SELECT count(*) FROM n WHERE o = o_orderkey AND s = 1) AS unfinished, 20::BIGINT AS updated_at, 10::BIGINT AS created_at FROM orders""")
def runs_resumed(spark, sf_dir):
    """A checkpoint for each order, its lines as nodes; all are taken up again twice."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("run-"), "l_orderkey").alias("run_id"), F.col("l_linenumber").cast("string").alias("node"))
    nodes = lines.agg(F.when(F.bool_and(F.col("l_linestatus") == "F"), "success").otherwise("failed").alias("status"))
    nodes = nodes.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("node", "status"))).alias("results"))
    orders = read(spark, sf_dir, "orders").select(F.concat(F.lit("run-"), "o_orderkey").alias("run_id"))
    kept = overlay.runs(spark, new_path(spark, "runs"))
    overlay.save(kept, orders.join(nodes, "run_id", "left").withColumn("results", F.coalesce("results", F.create_map().cast("map<string,string>"))), F.lit(10))
    overlay.resume(kept, orders, F.lit(15))
    todo = overlay.resume(kept, orders, F.lit(20))
    return todo.select("run_id", "resume_count", F.size("unfinished").cast("long").alias("unfinished")).join(kept.read().select("run_id", "updated_at", "created_at"), "run_id")


_LINES = "SELECT l_orderkey * 10 + l_linenumber AS o, l_quantity::BIGINT AS c FROM lineitem"


def _lines(spark, sf_dir):
    """All lines as one group."""
    return read(spark, sf_dir, "lineitem").select(F.lit(1).alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.col("l_quantity").cast("long").alias("c"))


@query(f"""WITH s AS (SELECT list_reduce(list_prepend(struct_pack(o := 0::BIGINT, c := 0::BIGINT, b := 0::BIGINT, u := 1000000::BIGINT, d := 0::HUGEINT), list(struct_pack(o := o, c := c, b := 0::BIGINT, u := 0::BIGINT, d := 0::HUGEINT) ORDER BY o, c)),
lambda a, x: CASE WHEN a.u + x.c > 1000 THEN struct_pack(o := x.o, c := x.c, b := a.b + 1, u := x.c, d := a.d + (a.b + 1) * (x.o % 9973)) ELSE struct_pack(o := x.o, c := x.c, b := a.b, u := a.u + x.c, d := a.d + a.b * (x.o % 9973)) END) AS s FROM ({_LINES}))
SELECT s.b AS batches, s.d::BIGINT AS digest FROM s""")
def lineitem_batches(spark, sf_dir):
    """Lines of all orders as one group in batches of 1,000 pieces: how many, and a sum over each line's batch."""
    out = folds.next_fit(_lines(spark, sf_dir), "g", "o", "c", 1000)
    return out.agg(F.max("batch").alias("batches"), F.sum(F.col("batch") * (F.col("o") % 9973)).alias("digest"))


@query(f"""WITH t AS (SELECT list(struct_pack(o := o, c := c) ORDER BY o, c) AS x FROM ({_LINES})), s AS (SELECT list_reduce(list_prepend(struct_pack(o := 0::BIGINT, c := 0::BIGINT, u := 0::BIGINT, n := 0::BIGINT, d := 0::HUGEINT), list_transform(x, lambda y: struct_pack(o := y.o, c := y.c, u := 0::BIGINT, n := 0::BIGINT, d := 0::HUGEINT))),
lambda a, y: CASE WHEN a.u + y.c <= 70001 THEN struct_pack(o := y.o, c := y.c, u := a.u + y.c, n := a.n + 1, d := a.d + y.o) ELSE a END) AS s FROM t)
SELECT s.n AS taken, s.u AS used, s.d::BIGINT AS digest FROM s""")
def lineitem_fitting(spark, sf_dir):
    """Of all lines in order, those that still fit into 70,001 pieces."""
    out = folds.fitting(_lines(spark, sf_dir), "g", "o", "c", 70_001).where("selected")
    return out.agg(F.count("*").alias("taken"), F.sum("c").alias("used"), F.sum("o").alias("digest"))


def _type_findings(spark, sf_dir):
    """Parts as findings on their type and name: some name a key, of types that begin with S one of many."""
    part = read(spark, sf_dir, "part")
    key = F.when(F.col("p_partkey") % 3 == 0, None).when(F.col("p_type").startswith("S"), F.col("p_brand")).otherwise(F.concat(F.lit("k"), "p_type", "p_name"))
    return part.select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("w"), F.col("p_size") % 10).alias("worker"), F.concat_ws(" ", "p_type", "p_name").alias("claim"), F.col("p_brand").alias("evidence"), F.concat(F.lit("m"), F.col("p_size") % 7).alias("source"), ((F.col("p_size") % 10) / 10).alias("confidence"), key.alias("canonical_key"))


def _reduced(spark, sf_dir):
    def equal_claims(found, threshold, most):
        own = found.select("idx", "claim_text")
        return own.select(F.col("idx").alias("left"), "claim_text").join(own.select(F.col("idx").alias("right"), "claim_text"), "claim_text").where("left < right").select("left", "right", F.lit(1.0).alias("score"))

    candidates.register_provider("equal-claims", equal_claims)
    return pipelines.reduce_findings(_type_findings(spark, sf_dir), provider="equal-claims")


_TYPES = f"""f AS (SELECT p_partkey, {norm("p_type || ' ' || p_name")} AS claim, 'w' || p_size % 10 AS worker, 'm' || p_size % 7 AS source, p_brand AS evidence, (p_size % 10) / 10 AS confidence,
CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_type LIKE 'S%' THEN p_brand ELSE 'k' || p_type || p_name END AS k FROM part), n AS (SELECT claim, count(DISTINCT k) AS ni, count(*) FILTER (k IS NULL) AS bare FROM f GROUP BY claim)"""


@query(f"""WITH {_TYPES}, g AS (SELECT *, CASE WHEN ni <= 1 THEN 'all' ELSE coalesce('key ' || k, 'none') END AS component FROM f JOIN n USING (claim))
SELECT claim, max(k) AS canonical_key, count(DISTINCT coalesce(k, '')) AS merged_findings, count(*) AS occurrence_count, count(DISTINCT worker) AS agreement_count,
count(DISTINCT source) AS independent_source_count, count(DISTINCT row(source, evidence)) AS independent_evidence_count, max(confidence) AS confidence FROM g GROUP BY claim, component""")
def merged_findings(spark, sf_dir):
    """Findings after verified merges: supporters counted over whole components, keys promoted."""
    out = _reduced(spark, sf_dir).merged
    key = F.nullif(F.col("best.canonical_key"), F.lit(""))
    return out.select(F.lower("best.claim").alias("claim"), key.alias("canonical_key"), "merged_findings", "occurrence_count", "agreement_count", "independent_source_count", "independent_evidence_count", F.col("best.confidence").alias("confidence"))


@query(f"WITH {_TYPES} SELECT 'ambiguous-identity-bridge' AS reason, sum(ni)::BIGINT AS pairs FROM n WHERE ni > 1 AND bare > 0 HAVING count(*) > 0")
def blocked_merges(spark, sf_dir):
    return _reduced(spark, sf_dir).blocked


@query(f"""WITH {_TYPES}, g AS (SELECT claim, ni, bare, ni + CASE WHEN bare > 0 THEN 1 ELSE 0 END AS groups FROM n)
SELECT (sum(CASE WHEN bare > 0 THEN ni ELSE 0 END))::BIGINT AS authorized_pairs, (sum(CASE WHEN ni = 1 AND bare > 0 THEN 1 ELSE 0 END))::BIGINT AS verified_merges, (sum(CASE WHEN ni = 1 AND bare > 0 THEN 1 ELSE 0 END))::BIGINT AS components_merged,
(sum(groups) - sum(CASE WHEN ni = 1 AND bare > 0 THEN 1 ELSE 0 END))::BIGINT AS output_findings FROM g""")
def merge_counts(spark, sf_dir):
    return _reduced(spark, sf_dir).stats.select("authorized_pairs", "verified_merges", "components_merged", "output_findings")


# --- search and differences

_PATTERN = r"licen[sc]e|public +domain|copyright.*20\d\d"


@query(rf"""SELECT path, line, sha256(content) AS line_sha256 FROM (SELECT doc_id::VARCHAR AS path, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
WHERE regexp_matches(content, '(?i){_PATTERN}')""")
def trigram_search(spark, sf_dir):
    """Lines of documents that match a pattern, found through an index of their trigrams."""
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    found = trigrams.search(files, written(trigrams.index(files), "postings"), _PATTERN)
    return found.select("path", F.col("line").cast("long").alias("line"), F.sha2("content", 256).alias("line_sha256"))


@query("""SELECT count(*) FILTER (contains(t, 'lic') AND contains(t, 'ice') AND contains(t, 'cen') OR contains(t, 'cop') AND contains(t, 'opy') AND contains(t, 'pyr') AND contains(t, 'yri') AND contains(t, 'rig') AND contains(t, 'igh') AND contains(t, 'ght')) AS candidates,
count(*) AS documents FROM (SELECT lower(text) AS t FROM documents)""")
def trigram_candidates(spark, sf_dir):
    """How many documents a search reads, of how many."""
    files = read(spark, sf_dir, "documents").select("doc_id", "text")
    some = trigrams.candidates(written(trigrams.index(files, "doc_id", "text"), "postings"), "licen[sc]e|copyright")
    return some.agg(F.count("*").alias("candidates")).crossJoin(files.agg(F.count("*").alias("documents")))  # one row each


_NEXT = "SELECT doc_id, text AS old, lead(text) OVER (ORDER BY doc_id) AS new FROM documents"


@query(f"SELECT doc_id, sha256(coalesce(new, '')) AS new_sha256 FROM ({_NEXT})")
def hunks_applied(spark, sf_dir):
    """Each document's hunks against the next, applied to it: the next one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("old"))
    # the next document by a join on places, not in one task
    placed = packets.numbered(docs, [F.asc("doc_id")], "place")
    pairs = placed.join(placed.select((F.col("place") - 1).alias("place"), F.col("old").alias("new")), "place", "left")
    found = diff.hunks(pairs, "doc_id")
    return diff.applied(docs, found, "doc_id").select("doc_id", F.sha2("new", 256).alias("new_sha256"))


def exact_token_counts(spark, sf_dir, tokenizer: str = "word_bpe_49k.json"):
    """Exact tokens of documents by a function of SQL. The tokenizer is beyond DuckDB; a test holds it to the library."""
    import public_tokenizers

    evidence.register_tokenizer("word-bpe", public_tokenizers.path(tokenizer))
    evidence.register_sql(spark, "exact_tokens", "word-bpe")
    read(spark, sf_dir, "documents").createOrReplaceTempView("documents_to_count")
    return spark.sql("SELECT doc_id, exact_tokens(text) AS tokens FROM documents_to_count")


QUERIES["exact_token_counts"] = exact_token_counts
