"""Row-level rules of planning: complexity, risk, route, model tiers, reduction modes, retries, grades, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .budget import largest_remainder

# Terms, points and levels of the rules.
COMPLEXITY = (
    ("multi-file", 1, ("multiple files", "across the repo", "across repository", "many files", "多個檔案", "整個專案")),
    ("architecture", 2, ("architecture", "architectural", "架構", "系統設計")),
    ("cross-cutting-change", 2, ("refactor", "migration", "migrate", "upgrade", "rewrite", "重構", "遷移", "升級")),
    ("integration", 2, ("oauth", "authentication", "authorization", "database", "queue", "payment", "integration", "整合", "驗證", "資料庫")),
    ("delivery-scope", 2, ("implement feature", "add feature", "end to end", "end-to-end", "ship", "production-ready", "完整實作", "新增功能")),
    ("autonomous-scope", 3, ("entire project", "whole project", "complete engineering task", "autonomously", "from issue to pr", "整個專案", "全自動")),
)
RISK = (
    ("security", 3, ("security", "vulnerability", "auth", "authentication", "authorization", "oauth", "credential", "secret", "資安", "驗證", "授權", "憑證")),
    ("money", 3, ("payment", "billing", "invoice", "refund", "charge", "money", "付款", "金流", "帳務", "退款")),
    ("data", 3, ("database migration", "schema migration", "drop table", "delete data", "production database", "資料庫遷移", "刪除資料", "正式資料庫")),
    ("production", 3, ("production", "deploy", "deployment", "release", "rollback", "正式環境", "部署", "上線")),
    ("public-contract", 2, ("public api", "breaking change", "backward compatibility", "api contract", "公開 api", "破壞性變更", "向後相容")),
    ("broad-blast-radius", 2, ("entire project", "whole project", "across the repo", "architecture", "migration", "rewrite", "整個專案", "全專案", "架構", "遷移", "重寫")),
    ("destructive", 4, ("rm -rf", "reset --hard", "force push", "truncate", "drop database", "刪庫", "強制推送")),
)
AMBIGUITY = ("maybe", "perhaps", "somehow", "random", "sometimes", "intermittent", "unknown", "not sure", "unclear", "偶爾", "隨機", "有時候", "不確定", "不清楚", "可能", "莫名")
NOVELTY = ("from scratch", "novel", "new architecture", "redesign", "greenfield", "new pattern", "invent", "從零", "全新架構", "重新設計", "新模式", "自行設計")
ROUTES = {
    "understand": ("architecture", "understand", "overview", "structure", "project", "repo", "repository", "架構", "專案", "理解", "結構", "整體"),
    "debug": ("bug", "debug", "error", "fail", "failure", "exception", "wrong", "issue", "why", "broken", "問題", "錯誤", "失敗", "異常", "為什麼", "除錯"),
    "change-impact": ("impact", "affected", "change", "changed", "modify", "modified", "regression", "影響", "修改", "變更", "改動"),
    "review": ("review", "audit", "security", "performance", "quality", "pr", "code review", "審查", "檢查", "資安", "效能"),
}
ROLES = {"trivial": ("worker",), "focused": ("worker",), "complex": ("planner", "implementer", "reviewer"), "autonomous": ("planner", "researcher", "implementer", "reviewer")}
TIERS = ("cheap", "standard", "strong")
GRADES = {"low": 0.75, "medium": 0.82, "high": 0.9, "critical": 0.95}
MODES = ("direct", "light", "full")
SCENARIOS = (
    # name, source tokens, output tokens, duplicate ratio, conflict ratio, complexity, risk, workers, parallel evidence
    ("small-single-file", 3000, 700, 0.05, 0.00, "focused", "low", 1, False),
    ("medium-cross-file-repetitive", 14000, 1200, 0.38, 0.01, "focused", "medium", 1, False),
    ("large-high-dup-investigation", 55000, 1800, 0.55, 0.02, "complex", "medium", 3, True),
    ("conflicting-evidence", 32000, 1800, 0.22, 0.14, "complex", "high", 3, True),
    ("large-low-dup-provenance", 26000, 1500, 0.06, 0.01, "complex", "medium", 3, False),
    ("security-sensitive-small", 4800, 900, 0.10, 0.00, "focused", "high", 2, False),
    ("orchestration-overhead-regression", 4500, 750, 0.30, 0.00, "focused", "low", 1, False),
)
SCENARIO_COLUMNS = "name string, source_tokens long, output_tokens long, duplicate_ratio double, conflict_ratio double, complexity string, risk string, workers long, parallel boolean"


def has_any(text: Column, terms) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(text, F.lit(t))
    return hit


def hits(text: Column, terms) -> Column:
    """Number of distinct terms that a text has."""
    out = F.lit(0)
    for t in dict.fromkeys(terms):
        out = out + F.contains(text, F.lit(t)).cast("int")
    return out


def levels(score: Column, steps: tuple[int, ...], names: tuple[str, ...]) -> Column:
    out = None
    for s, n in zip(steps, names):
        out = F.when(score <= s, n) if out is None else out.when(score <= s, n)
    return out.otherwise(names[len(steps)])


def complexity(task: Column, task_type: Column | None = None) -> Column:
    """Struct of score and level of a task's text."""
    text = F.lower(F.trim(F.coalesce(task, F.lit(""))))
    score = F.when(F.length(text) > 500, 2).when(F.length(text) > 180, 1).otherwise(0)
    for _, points, terms in COMPLEXITY:
        score = score + F.when(has_any(text, terms), points).otherwise(0)
    if task_type is not None:
        score = F.when(task_type.isin("review", "change-impact"), F.greatest(score, F.lit(2))).otherwise(score)
    return F.struct(score.alias("score"), levels(score, (1, 3, 6), ("trivial", "focused", "complex", "autonomous")).alias("level"))


def risk(task: Column, task_type: Column | None = None) -> Column:
    """Struct of score, level, ambiguity, novelty, routing_confidence and requires_escalation of a task's text."""
    text = F.lower(F.trim(F.coalesce(task, F.lit(""))))
    score = F.lit(0)
    for _, points, terms in RISK:
        score = score + F.when(has_any(text, terms), points).otherwise(0)
    if task_type is not None:
        score = F.when((task_type == "review") & has_any(text, ("security", "資安", "vulnerability")), F.greatest(score, F.lit(5))).when(task_type == "change-impact", F.greatest(score, F.lit(1))).otherwise(score)
    new = hits(text, NOVELTY)
    score = score + F.when(new > 0, 1).otherwise(0)
    ambiguity, novelty = F.least(F.lit(1.0), 0.22 * hits(text, AMBIGUITY)), F.least(F.lit(1.0), 0.35 * new)
    confidence = F.round(F.greatest(F.lit(0.35), F.least(F.lit(0.98), 0.9 - ambiguity * 0.45 - novelty * 0.15)), 3)
    level = levels(score, (1, 4, 7), ("low", "medium", "high", "critical"))
    escalate = level.isin("high", "critical") | (ambiguity >= 0.44) | (confidence < 0.7)
    return F.struct(score.alias("score"), level.alias("level"), F.round(ambiguity, 3).alias("ambiguity"), F.round(novelty, 3).alias("novelty"), confidence.alias("routing_confidence"), escalate.alias("requires_escalation"))


def route(task: Column) -> Column:
    """Task type by terms, longer ones twice; equal scores go to the last name, no hit to understanding."""
    text, scores = F.lower(F.coalesce(task, F.lit(""))), []
    for name, terms in ROUTES.items():
        score = F.lit(0)
        for t in terms:
            score = score + F.when(F.contains(text, F.lit(t)), 2 if len(t) > 3 else 1).otherwise(0)
        scores.append(F.struct(score.alias("score"), F.lit(name).alias("name")))
    best = F.greatest(*scores)
    return F.when(best["score"] > 0, best["name"]).otherwise("understand")


def _tier(name: Column, least: str) -> Column:
    order = F.array(*map(F.lit, TIERS))
    return F.element_at(order, F.greatest(F.array_position(order, name), F.lit(TIERS.index(least) + 1)).cast("int"))


def model_tiers(level: Column, risks: Column) -> Column:
    """Struct of the tiers of planner, worker and grader, raised by risk, ambiguity and novelty (null: no planner)."""
    planner = F.when(level == "complex", "standard").when(level == "autonomous", "strong")
    worker = F.when(level == "trivial", "cheap").otherwise("standard")
    grader = F.when(level == "trivial", "cheap").when(level == "autonomous", "strong").otherwise("standard")
    high = risks["level"].isin("high", "critical")
    unsure = (risks["ambiguity"] >= 0.44) | (risks["routing_confidence"] < 0.7)
    novel = risks["novelty"] > 0
    worker = F.when(high | unsure & planner.isNull(), _tier(worker, "standard")).otherwise(worker)
    grader = F.when(high | novel, "strong").when(unsure, _tier(grader, "standard")).otherwise(grader)
    planner = F.when(planner.isNotNull() & (high | unsure | novel), "strong").otherwise(planner)
    return F.struct(planner.alias("planner"), worker.alias("worker"), grader.alias("grader"))


def attempts(risk_level: Column, level: Column) -> Column:
    """Struct of how often a worker may try, and how often in the same tier."""
    high = risk_level.isin("high", "critical")
    most = F.when(high, 2).when(level.isin("complex", "autonomous"), 3).otherwise(2)
    return F.struct(most.alias("max_attempts"), F.when(high, 0).otherwise(1).alias("same_tier_retries"))


def retry(decision: Column, attempt: Column, tier: Column, risk_level: Column, level: Column) -> Column:
    """Struct of the action after a grade, and the next tier if it is another try."""
    policy, n = attempts(risk_level, level), F.greatest(F.lit(1), attempt)
    up = (decision == "uncertain") | risk_level.isin("high", "critical") | (n > policy["same_tier_retries"])
    order = F.array(*map(F.lit, TIERS))
    stronger = F.element_at(order, F.least(F.lit(len(TIERS)), F.coalesce(F.nullif(F.array_position(order, tier), F.lit(0)), F.lit(2)) + 1).cast("int"))
    action = F.when(decision == "pass", "done").when(~decision.isin("reject", "uncertain"), "invalid-grade").when(n >= policy["max_attempts"], "human-review").otherwise("retry")
    return F.struct(action.alias("action"), F.when(action == "retry", F.when(up, stronger).otherwise(tier)).alias("next_tier"))


def grade(score: Column, failures: Column, risk_level: Column) -> Column:
    """pass if the score reaches the risk's threshold without failures, reject with failures, else uncertain."""
    least = F.element_at(F.create_map(*[x for k, v in GRADES.items() for x in (F.lit(k), F.lit(v))]), risk_level)
    return F.when((score >= F.coalesce(least, F.lit(0.82))) & (failures == 0), "pass").when(failures > 0, "reject").otherwise("uncertain")


def fan_out(coverage: Column, unresolved: Column, used: Column, most: int = 4, at_once: int = 2) -> Column:
    """How many more workers to launch: none once covered, else for what is unresolved, within what is left."""
    left = F.greatest(F.lit(0), F.lit(most) - used)
    covered = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(coverage, F.lit(0.0))))
    return F.when((covered >= 0.85) | (unresolved <= 0) | (left <= 0), 0).otherwise(F.least(F.lit(at_once), left, F.greatest(F.lit(1), unresolved)))


# Weights of roles when a budget is shared, and the nodes of each level's plan.
ROLE_WEIGHTS = {"sorter": 0.35, "planner": 1.2, "researcher": 0.75, "worker": 1.7, "implementer": 1.7, "tester": 0.85, "verifier": 0.8, "grader": 0.9, "reviewer": 0.9, "security-reviewer": 1.0, "integrator": 0.8}
PLANS = {
    "focused": (("work", "worker", ()), ("grade", "grader", ("work",))),
    "complex": (("plan", "planner", ()), ("research", "researcher", ("plan",)), ("implement", "implementer", ("plan", "research")), ("test", "tester", ("implement",)), ("grade", "grader", ("test",))),
    "autonomous": (
        ("plan", "planner", ()), ("research-a", "researcher", ("plan",)), ("research-b", "researcher", ("plan",)), ("implement", "implementer", ("plan", "research-a", "research-b")),
        ("test", "tester", ("implement",)), ("grade", "grader", ("test",)), ("finalize", "integrator", ("grade",)),
    ),
}
PLANS["trivial"] = PLANS["focused"]


def schedule(spark: SparkSession, level: str, security: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes(node, role) and needs(node, on) of a level's plan; a security review joins it where one is called for."""
    nodes, needs = [(n, r) for n, r, _ in PLANS[level]], [(n, o) for n, _, on in PLANS[level] for o in on]
    if security and level in ("complex", "autonomous"):
        nodes.append(("security", "security-reviewer"))
        needs += [("security", "implement"), ("grade", "security")]
    return spark.createDataFrame(nodes, "node string, role string"), spark.createDataFrame(needs, "node string, on string")


def lane_budgets(nodes: DataFrame, context: int = 12_000, output: int = 4_000) -> DataFrame:
    """Shares of the budgets for each node of a plan, by its role's weight; the shares add up to the budgets."""
    weights = F.create_map(*[x for k, v in ROLE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    rows = nodes.withColumns({"plan": F.lit(0), "weight": F.coalesce(F.try_element_at(weights, F.col("role")), F.lit(1.0))})
    rows = largest_remainder(rows, ["plan"], "node", "weight", F.lit(context)).withColumnRenamed("allocated", "context_tokens")
    return largest_remainder(rows, ["plan"], "node", "weight", F.lit(output)).withColumnRenamed("allocated", "output_tokens").drop("plan", "weight")


def thin_lane_budgets(lanes: DataFrame, mode: str) -> DataFrame:
    """Context budgets when graders only verify and integrators only join: what they leave goes to the others."""
    total = lanes.agg(F.sum("context_tokens")).first()[0] or 0
    graders = lanes.where("role = 'grader'").count()
    share = 0 if mode == "direct" or not graders else round(total * (0.12 if mode == "light" else 0.10))
    weights = F.create_map(*[x for k, v in ROLE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    part = F.when(F.col("role") == "grader", "grader").when(F.col("role") == "integrator", "integrator").otherwise("evidence")
    rows = lanes.drop("context_tokens").withColumn("part", part).withColumn("weight", F.when(F.col("part") == "grader", 1.0).otherwise(F.coalesce(F.try_element_at(weights, F.col("role")), F.lit(1.0))))
    pot = F.when(F.col("part") == "grader", share).when(F.col("part") == "integrator", 0).otherwise(total - share)
    return largest_remainder(rows, ["part"], "node", "weight", pot).withColumnRenamed("allocated", "context_tokens").drop("part", "weight")


def projections(scenarios: DataFrame) -> DataFrame:
    """Scenarios in each reduction mode: whether it is eligible, and what it would cost. Halves are rounded to even."""
    half = lambda c: F.bround(c, 0).cast("long")
    dup, conflict = (F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))) for c in ("duplicate_ratio", "conflict_ratio"))
    context = F.greatest(F.lit(256), half(F.greatest(F.lit(1), F.col("source_tokens")) * (1.0 - F.least(F.lit(0.72), dup * 0.85))))
    out = scenarios.withColumns({"context": context, "conflict": conflict}).withColumn("mode", F.explode(F.array(*map(F.lit, MODES))))
    base, workers = F.col("output_tokens"), F.greatest(F.lit(1), F.col("workers"))
    ctx = F.col("context")
    worker_outputs = F.greatest(F.lit(200), half(base * 0.24 * workers))
    packet = F.greatest(F.lit(220), half(worker_outputs * 0.62)) + half(ctx * F.least(F.lit(0.10), F.col("conflict") * 0.30))
    evidence = half(ctx * 0.90)
    tokens_in = F.when(F.col("mode") == "direct", ctx + 220).when(F.col("mode") == "light", ctx + 220 + F.greatest(F.lit(160), half(base * 0.38)) + 180).otherwise(evidence + 200 * workers + (ctx - evidence) + packet + 180 + packet + 180)
    tokens_out = F.when(F.col("mode") == "direct", base).when(F.col("mode") == "light", base + F.greatest(F.lit(80), half(base * 0.12))).otherwise(worker_outputs + F.greatest(F.lit(100), half(base * 0.14)) + base)
    calls = F.when(F.col("mode") == "direct", 1).when(F.col("mode") == "light", 2).otherwise(workers + 2).cast("long")
    latency = F.when(F.col("mode") == "direct", 1.0).when(F.col("mode") == "light", 1.55).otherwise(F.round(2.0 + 0.22 * workers, 2))
    blocked_direct = F.col("complexity").isin("complex", "autonomous") | (F.col("risk") != "low") | (F.col("conflict") >= 0.03) | F.col("parallel")
    blocked_light = (F.col("complexity") == "autonomous") | F.col("risk").isin("high", "critical") | (F.col("conflict") >= 0.08) | F.col("parallel")
    eligible = F.when(F.col("mode") == "direct", ~blocked_direct).when(F.col("mode") == "light", ~blocked_light).otherwise(True)
    return out.withColumns({"eligible": eligible, "tokens_in": tokens_in, "tokens_out": tokens_out, "total_tokens": tokens_in + tokens_out, "calls": calls, "latency": latency})


def chosen(projected: DataFrame) -> DataFrame:
    """The cheapest eligible mode of each scenario; direct, where eligible, unless 3 % and 256 tokens are saved."""
    rank = F.struct("total_tokens", "calls", "latency", "mode")
    out = projected.groupBy("name").agg(
        F.min(F.when(F.col("eligible"), rank)).alias("best"), F.max(F.when((F.col("mode") == "direct") & F.col("eligible"), F.col("total_tokens"))).alias("direct_tokens")
    )
    saved = F.col("direct_tokens") - F.col("best.total_tokens")
    stay = F.col("direct_tokens").isNotNull() & (F.col("best.mode") != "direct") & ((saved < 256) | (saved / F.greatest(F.lit(1), F.col("direct_tokens")) < 0.03))
    return out.select("name", F.when(stay, "direct").otherwise(F.col("best.mode")).alias("selected_mode"), F.when(stay, F.col("direct_tokens")).otherwise(F.col("best.total_tokens")).alias("selected_tokens"))
