"""Rules of planning, grading and providers over the given tables, whose rows stand for tasks, grades and offers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nearest
from ..operators import evidence, graph, harness, planning, state, views
from .more import joined, query
from .queries import read


@query("""SELECT 'region ' || r_regionkey AS node, 0 AS wave FROM region UNION ALL SELECT 'nation ' || n_nationkey, 1 FROM nation UNION ALL SELECT 'customer ' || c_custkey, 2 FROM customer
UNION ALL SELECT 'order ' || o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 3 ELSE 0 END FROM orders""")
def table_waves(spark, sf_dir):
    """Waves in which regions, nations, customers and orders can be loaded, each after what it refers to."""
    named = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c))
    rows = {t: read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders")}
    nodes = rows["region"].select(named("region", "r_regionkey").alias("node"))
    needs = None
    for t, kind, own, on, ref in (("nation", "nation", "n_nationkey", "region", "n_regionkey"), ("customer", "customer", "c_custkey", "nation", "c_nationkey"), ("orders", "order", "o_orderkey", "customer", "o_custkey")):
        nodes = nodes.union(rows[t].select(named(kind, own)))
        part = rows[t].select(named(kind, own).alias("node"), named(on, ref).alias("on"))
        needs = part if needs is None else needs.union(part)
    return graph.levels(nodes, needs.join(nodes.select(F.col("node").alias("on")), "on", "left_semi"))


_RISK = "CASE l_returnflag WHEN 'A' THEN 'low' WHEN 'N' THEN 'high' WHEN 'R' THEN 'critical' ELSE 'medium' END"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity / 50 >= CASE {_RISK} WHEN 'low' THEN 0.75::DOUBLE WHEN 'high' THEN 0.9::DOUBLE WHEN 'critical' THEN 0.95::DOUBLE ELSE 0.82::DOUBLE END AND l_linenumber % 3 = 0 THEN 'pass'
WHEN l_linenumber % 3 > 0 THEN 'reject' ELSE 'uncertain' END AS grade FROM lineitem""")
def line_grades(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", harness.grade(F.col("l_quantity") / 50, F.col("l_linenumber") % 3, F.expr(_RISK)).alias("grade"))


_ASKED = """CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'P' THEN 'uncertain' WHEN 'O' THEN 'reject' ELSE 'what' END AS decision, (o_orderkey % 4)::INT AS attempt, CASE o_custkey % 3 WHEN 0 THEN 'cheap' WHEN 1 THEN 'standard' ELSE 'strong' END AS tier,
CASE WHEN o_orderpriority LIKE '1%' THEN 'high' ELSE 'low' END AS risk, CASE WHEN o_totalprice > 200000 THEN 'complex' ELSE 'focused' END AS level"""


@query(f"""WITH r AS (SELECT o_orderkey, {_ASKED} FROM orders), p AS (SELECT *, CASE WHEN risk = 'high' THEN 2 WHEN level = 'complex' THEN 3 ELSE 2 END AS most, CASE WHEN risk = 'high' THEN 0 ELSE 1 END AS same, greatest(1, attempt) AS k FROM r),
a AS (SELECT *, CASE WHEN decision = 'pass' THEN 'done' WHEN decision = 'what' THEN 'invalid-grade' WHEN k >= most THEN 'human-review' ELSE 'retry' END AS action FROM p)
SELECT o_orderkey, action, CASE WHEN action = 'retry' THEN CASE WHEN decision = 'uncertain' OR risk = 'high' OR k > same THEN CASE tier WHEN 'cheap' THEN 'standard' ELSE 'strong' END ELSE tier END END AS next_tier FROM a""")
def order_retries(spark, sf_dir):
    """What follows on an order's grade: done, another try and in which tier, or a person's review."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders_asked")
    asked = spark.sql(f"SELECT o_orderkey, {_ASKED} FROM orders_asked")
    x = harness.retry(*[F.col(c) for c in ("decision", "attempt", "tier", "risk", "level")])
    return asked.select("o_orderkey", x["action"].alias("action"), x["next_tier"].alias("next_tier"))


@query("""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations)
SELECT conv_id, turn, to_json({'n': turn, 'words': list_filter(w, lambda x, i: list_position(w, x) = i), 'pairs': [[turn, -1]]}) AS json FROM t""")
def distinct_json_turns(spark, sf_dir):
    """Turns as JSON with lists of words and of lists, without what lists repeat."""
    turns = read(spark, sf_dir, "conversations")
    pair = F.array("turn", F.lit(-1).cast("long"))
    made = F.to_json(F.struct(F.col("turn").alias("n"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words"), F.array(pair, pair).alias("pairs")))
    return turns.select("conv_id", "turn", evidence.distinct_json(made).alias("json"))


@query("SELECT l_partkey::VARCHAR AS capability, count(DISTINCT l_suppkey) AS providers, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS ids FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def supplier_overlaps(spark, sf_dir):
    """Parts that several suppliers deliver, as capabilities of several providers."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("id"), F.col("l_partkey").cast("string").alias("part"))
    return views.overlaps(lines.groupBy("id").agg(F.collect_set("part").alias("capabilities"))).select("capability", "providers", joined("ids", ","))


@query("""WITH p AS (SELECT s_suppkey::VARCHAR AS id, s_acctbal > 0 AS trusted, s_nationkey % 4 = 0 AS preferred, CASE s_suppkey % 5 WHEN 0 THEN 'native' WHEN 1 THEN 'cli' ELSE 'plugin' END AS kind, s_suppkey FROM supplier),
r AS (SELECT DISTINCT l_partkey::VARCHAR AS capability, id, CASE WHEN trusted AND preferred AND kind <> 'native' THEN 0 WHEN trusted AND kind = 'plugin' THEN 1 WHEN kind = 'native' THEN 3 END AS rank FROM p JOIN lineitem ON l_suppkey = s_suppkey WHERE l_partkey IN (1, 7, 50, 99))
SELECT capability, arg_min(id, row(rank, id)) AS id FROM r WHERE rank IS NOT NULL GROUP BY capability""")
def supplier_choice(spark, sf_dir):
    """The supplier that is chosen for each of four parts."""
    kind = F.when(F.col("s_suppkey") % 5 == 0, "native").when(F.col("s_suppkey") % 5 == 1, "cli").otherwise("plugin")
    parts = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("capabilities"))
    own = read(spark, sf_dir, "supplier").join(parts, F.col("l_suppkey") == F.col("s_suppkey"))
    offers = own.select(F.col("s_suppkey").cast("string").alias("id"), "capabilities", kind.alias("source_type"), (F.col("s_acctbal") > 0).alias("trusted"), (F.col("s_nationkey") % 4 == 0).alias("preferred"))
    out = None
    for c in ("1", "7", "50", "99"):
        part = views.resolve(offers, c).select(F.lit(c).alias("capability"), "id")
        out = part if out is None else out.union(part)
    return out


_PLACE = "CASE event_type WHEN 'click' THEN 'cache/' WHEN 'view' THEN 'runs/' WHEN 'error' THEN 'artifacts/' ELSE 'other/' END || user_id"


@query(f"""SELECT split_part(path, '/', 1) AS entry, CASE WHEN split_part(path, '/', 1) IN ('cache', 'runs') THEN 'regenerable' WHEN split_part(path, '/', 1) = 'artifacts' THEN 'preserved' ELSE 'unrecognized' END AS class, count(*) AS files, sum(bytes)::BIGINT AS bytes
FROM (SELECT {_PLACE} AS path, event_id % 97 AS bytes FROM events) GROUP BY 1, 2""")
def event_inventory(spark, sf_dir):
    """Events as files of a state folder, by entry and by whether they can be made again."""
    return state.inventory(read(spark, sf_dir, "events").select(F.expr(_PLACE).alias("path"), (F.col("event_id") % 97).alias("bytes")))


@query("""WITH l AS (SELECT c_custkey::VARCHAR AS lane, unnest(['context_tokens', 'output_tokens', 'model_calls']) AS resource, unnest([(c_custkey % 7) * 100000, 900000, 12]::BIGINT[]) AS most FROM customer),
u AS (SELECT o_custkey::VARCHAR AS lane, resource, sum(amount)::BIGINT AS used FROM (SELECT o_custkey, 'context_tokens' AS resource, floor(o_totalprice)::BIGINT AS amount FROM orders UNION ALL SELECT o_custkey, 'model_calls', 1 FROM orders) GROUP BY 1, 2),
j AS (SELECT l.*, coalesce(used, 0) AS used FROM l LEFT JOIN u USING (lane, resource))
SELECT lane, max(used) FILTER (resource = 'context_tokens') AS context_used, max(greatest(0, most - used)) FILTER (resource = 'context_tokens') AS context_left, coalesce(string_agg(resource, ',' ORDER BY resource) FILTER (used >= most), '') AS exceeded, count(*) FILTER (used >= most) = 0 AS allow_more_work FROM j GROUP BY lane""")
def customer_lanes(spark, sf_dir):
    """Customers as lanes with budgets, their orders as what is used of them."""
    key = F.col("c_custkey")
    lanes = read(spark, sf_dir, "customer").select(key.cast("string").alias("lane"), (key % 7 * 100_000).cast("long").alias("context_tokens"), F.lit(900_000).cast("long").alias("output_tokens"), F.lit(12).cast("long").alias("model_calls"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("lane"), F.floor("o_totalprice").alias("price"))
    uses = orders.select("lane", F.lit("context_tokens").alias("resource"), F.col("price").alias("amount")).union(orders.select("lane", F.lit("model_calls"), F.lit(1).cast("long")))
    out = planning.lane_status(lanes, uses)
    return out.select("lane", F.col("context_tokens_used").alias("context_used"), F.col("context_tokens_left").alias("context_left"), joined("exceeded", ","), "allow_more_work")


@query("""SELECT l AS "left", r AS "right", score FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS n FROM (SELECT a.vec_id AS l, b.vec_id AS r, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)) WHERE n <= 3""")
def nearest_candidates(spark, sf_dir):
    """The three nearest vectors of its label to each that asks, by a table function from SQL."""
    nearest.register(spark)
    nearest.dealt(read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0").createOrReplaceTempView("vectors_dealt")
    return spark.sql("""WITH found AS (SELECT * FROM nearest(TABLE(SELECT * FROM vectors_dealt) PARTITION BY (label, part) ORDER BY (asks DESC), 3))
SELECT left, right, score FROM (SELECT *, row_number() OVER (PARTITION BY left ORDER BY score DESC, right) AS n FROM found) WHERE n <= 3""")
