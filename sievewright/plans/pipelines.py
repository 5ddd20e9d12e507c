"""The public dataflows: fan-in, synthesis, context packs, recall, claim recall, handoffs, evaluations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import QUERY_STOP_WORDS, coverage, estimated_tokens, fingerprint, identity_text, locator_id, query_terms, trust
from ..operators import budget, candidates, findings, graph, packets, recall
from ..tables import written

# Names under which a handoff may carry a field, the fields whose items are a set, and what claims of
# certain kinds are tested by: (requirement, mode, terms of the claim, pattern to look for).
HANDOFF_ALIASES = {
    "summary": ("summary", "result", "conclusion"), "decisions": ("decisions", "decision"), "evidence": ("evidence", "findings", "facts"), "targets": ("targets", "symbols", "files", "relevant_files"),
    "constraints": ("constraints", "requirements", "guardrails"), "open_questions": ("open_questions", "questions", "unknowns", "unresolved"), "changed_files": ("changed_files", "changes", "modified_files"),
    "tests": ("tests", "test_results", "verification"), "risks": ("risks", "warnings", "concerns"),
}
CLAIM_RULES = (
    ("responsive-variants", "counter-context", ("desktop", "mobile", "responsive", "breakpoint", "bottom sheet", "dialog", "sheet", "桌面", "手機", "行動", "響應", "斷點", "底部", "彈窗"),
     r"(?:^|[^A-Za-z0-9_])(?:sm|md|lg|xl|2xl):|@media|matchMedia|useMediaQuery|innerWidth"),
    ("responsive-base", "context", ("desktop", "mobile", "responsive", "breakpoint", "bottom sheet", "dialog", "sheet", "桌面", "手機", "行動", "響應", "斷點", "底部", "彈窗"),
     r"bottom-0|inset-0|m-auto|hidden|flex|grid|max-w-|max-h-"),
    ("motion-contract", "context", ("motion", "animation", "animate", "spring", "transition", "reduced motion", "reduced-motion", "動效", "動畫", "彈簧"),
     r"prefers-reduced-motion|useReducedMotion|get(?:Modal|Sheet|Overlay)Motion|getOverlayTransition|SPRING_[A-Z_]+|transition\s*[:=]"),
    ("translation-consumer", "support-if-match", ("i18n", "localiz", "translation", "translated", "language", "locale", "翻譯", "多語", "語系", "本地化"), r"\bt\s*\(|i18n\.|useTranslation\s*\("),
    ("hardcoded-visible-copy", "challenge-if-match", ("i18n", "localiz", "translation", "translated", "language", "locale", "翻譯", "多語", "語系", "本地化"),
     r"(?:['\"`][^'\"`\n]*[一-鿿]{2,}[^'\"`\n]*['\"`]|>[^<\n]*[一-鿿]{2,}[^<\n]*<)"),
    ("accessibility-contract", "context", ("accessibility", "a11y", "keyboard", "focus", "escape", "aria", "tab", "無障礙", "鍵盤", "焦點"), r"role=|aria-|tabIndex|onKeyDown|Escape|ArrowLeft|ArrowRight|Home|End|\.focus\s*\("),
    ("persistence-contract", "context", ("persist", "persistence", "saved", "save", "reload", "storage", "dark mode", "theme", "保存", "持久", "重載", "深色"),
     r"\bpersist\s*\(|localStorage|sessionStorage|partialize|rehydrat|storage|setItem\s*\(|getItem\s*\("),
)
USAGE_TERMS = (" uses ", " using ", " calls ", " invokes ", " applies ", " imports ", "使用", "呼叫", "套用", "引用")
DEPENDENCY_TERMS = ("caller", "callee", "depends", "dependency", "imports", "imported", "calls", "呼叫者", "依賴", "匯入")


@dataclass
class Reduction:
    """What a fan-in gives: each a DataFrame, computed when asked for. Without a provider of candidates `merged` is the
    groups, each alone."""

    decided: DataFrame
    groups: DataFrame
    contradictions: DataFrame
    pairs: DataFrame
    members: DataFrame
    merged: DataFrame
    blocked: DataFrame
    stats: DataFrame


def reduce_findings(raw: DataFrame, min_confidence: float = 0.0, trust_policy: str = "annotate", policy: str = "exact-claim", provider: str | None = None, threshold: float = 0.72, most: int = 500) -> Reduction:
    """Fan-in of raw findings (worker, ordinal and the columns of a finding): decisions on each, groups of exact
    duplicates, contradictions from before any merge, candidate pairs with verdicts, and what those merge.

    Candidates are looked for only where a provider is named; they merge nothing that isn't verified.
    """
    decided = findings.decide(findings.normalize(raw), min_confidence, trust_policy)
    kept = decided.where("decision.decision = 'keep'")
    same = findings.combined(kept)
    grouped = findings.groups(same, policy, F.col("times"))
    numbered = grouped.select("*", F.xxhash64("group_key", "assertion_key").alias("idx"), identity_text(F.col("best.claim")).alias("claim_text"), F.col("best.identity").alias("identity"), F.col("best.side").alias("side"), F.col("best.confidence").alias("confidence"), F.col("best.source").alias("source"))
    none = kept.sparkSession.createDataFrame([], "left long, right long, score double")
    pairs = candidates.verify(candidates.detect(numbered, provider, threshold, most) if provider else none, numbered)
    authorized = pairs.where("merge_authorized").select("left", "right")
    members = candidates.guarded_components(authorized, numbered) if provider else numbered.withColumn("component", F.col("idx"))
    merged = candidates.merge(members, same, policy)
    stats = findings.reduction_stats(decided, grouped).crossJoin(merge_stats(authorized, merged))  # one row each
    return Reduction(decided, grouped, findings.contradictions(kept), pairs, members, merged, candidates.blocked(authorized, members), stats)


def merge_stats(authorized: DataFrame, merged: DataFrame) -> DataFrame:
    """One row of counts over authorised pairs and what they merged; agreement is that of the findings that came out."""
    out = merged.agg(
        F.coalesce(F.sum(F.col("merged_findings") - 1), F.lit(0)).alias("verified_merges"), F.count_if(F.col("merged_findings") > 1).alias("components_merged"), F.count("*").alias("output_findings"),
        F.count_if(F.col("agreement_count") > 1).alias("agreement_groups"), F.coalesce(F.max("agreement_count"), F.lit(0)).alias("max_merged_agreement"), F.count_if("ambiguous").alias("ambiguous_groups"),
    )
    return authorized.agg(F.count("*").alias("authorized_pairs")).crossJoin(out)  # one row each


def synthesis_packet(reduction: Reduction, limit: int = 6000) -> DataFrame:
    """The findings of a packet: merged ones that no contradiction carries, in order, as far as they fit; each with its
    source's short name. Contradictions go with it whole."""
    free = packets.without_contradicted(reduction.merged.withColumn("identity", F.coalesce("identity", F.lit(""))), reduction.contradictions)
    rows = packets.ordered(free.select(F.col("best.claim").alias("claim"), F.col("best.source").alias("source"), F.col("best.confidence").alias("confidence"), "agreement_count", "independent_evidence_count", "independent_source_count"))
    fit = packets.pack(rows.select("packet_rank", F.concat_ws(" ", "claim", "source").alias("text")), limit).select("packet_rank")
    rows = rows.join(fit, "packet_rank")
    return rows.join(packets.source_refs(rows, "packet_rank", "source").select("source", "ref"), "source")


def thin(packet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A packet as what a model sees (claims and short names, support only where there is more than one) and the rest."""
    more = lambda c: F.when(F.col(c) > 1, F.col(c)).alias(c)
    return packet.select("packet_rank", "claim", "ref", "confidence", more("agreement_count"), more("independent_evidence_count")), packet.select("ref", "source").distinct()


def context_pack(files: DataFrame, symbols: DataFrame, task: str, limit: int = 6000, most_files: int = 12, most_symbols: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranked files (path, rank_score, estimated_tokens, symbols) and symbols(path, name, estimated_tokens) for a task:
    files by prefix within two fifths of the budget, then symbols that fit in the rest, and the coverage of terms.

    Only a pack's candidates are folded in order: most_files and four times most_symbols rows.
    """
    limit = max(800, limit)
    terms = query_terms(F.lit(task))
    top = graph.ranked(files, most_files).withColumn("pack", F.lit(0)).withColumn("place", F.row_number().over(Window.partitionBy("pack").orderBy(F.desc("rank_score"), "path")))
    chosen = budget.prefix(top, ["pack"], ["place"], "estimated_tokens", F.lit(int(limit * 0.4))).where("selected")
    name = F.lower("name")
    score = F.col("rank_score") * 0.2 + F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.when(F.contains(name, t), 9.0).otherwise(0.0))
    rows = symbols.join(chosen.select("path", "rank_score", F.col("used").alias("file_tokens")), "path").withColumn("symbol_score", F.round(score, 6)).where("symbol_score > 0")
    rows = rows.orderBy(F.desc("symbol_score"), "path", "name").limit(4 * most_symbols).withColumn("pack", F.lit(0))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("pack").orderBy(F.desc("symbol_score"), "path", "name")))
    taken = budget.skip(rows, "pack", "place", "estimated_tokens", int(limit * 0.6), most_symbols).select(F.explode("taken").alias("place"))
    picked = rows.join(taken, "place")
    text = F.lower(F.concat_ws(" ", "path", "symbols"))
    seen = chosen.agg(F.coalesce(F.array_join(F.collect_list(text), " "), F.lit("")).alias("text"))
    return chosen, picked, seen.select(coverage(terms, F.col("text")).alias("coverage"))


def recall_context(places: DataFrame, files: DataFrame, query: str, active: DataFrame, rejected: DataFrame, edges: DataFrame | None = None, limit: int = 1800, top: int = 6, pattern: str | None = None) -> DataFrame:
    """Places (see sources.repository.locators) that a query recalls: neither active nor rejected, scored, helped by text
    hits, pruned, and then the best that fit. files(path, content) gives the text; ids are those of locator_id."""
    places = places.withColumn("id", locator_id(F.col("path"), F.col("symbol"), F.col("start_line"), F.col("end_line")))
    known = places.join(active.select("id").union(rejected.select("id")).distinct(), "id", "left_anti")
    if edges is not None:
        seeds = active.join(places.select("id", "path"), "id").select(F.col("path").alias("node")).distinct()
        near = graph.neighbourhood(edges, seeds, 1).select(F.col("node").alias("path"), F.lit(True).alias("neighbour"))
        known = known.join(near, "path", "left").fillna(False, ["neighbour"])
    hits = recall.matches(recall.lines_of(files), pattern or "(?i)" + "|".join(map(re.escape, query.split()[:8])))
    rows = recall.pruned(recall.with_hits(recall.scored(known, query), hits)).orderBy(F.desc("score"), "path", "symbol").limit(4 * top)
    text = files.select("path", F.split("content", "\n").alias("__lines"))
    body = F.when(F.col("kind") == "symbol", F.array_join(F.slice("__lines", F.greatest(F.lit(1), F.col("start_line")), F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)), "\n"))
    rows = rows.join(text, "path", "left").withColumn("content", body).drop("__lines").withColumns({"cost": estimated_tokens(F.concat_ws(" ", "path", "symbol", "signature", "content")), "trust": trust(F.col("content")), "pack": F.lit(0)})
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("pack").orderBy(F.desc("score"), "path", "symbol")))
    taken = budget.skip(rows, "pack", "place", "cost", max(64, limit), top).select(F.explode("taken").alias("place"))
    return rows.join(taken, "place").drop("pack")


def claim_requirements(claim: str) -> list[tuple[str, str, str]]:
    """What to look for to test a claim: (id, mode, pattern), ten at most. Rules by kind of claim come first; what is
    said to be used must be called; without any rule, the claim's own words give context."""
    if not claim.strip():
        raise ValueError("a claim needs text")
    low, out = f" {claim.lower()} ", []
    names = list(dict.fromkeys(n.strip("`") for n in re.findall(r"`[^`]+`|\b[A-Za-z]+(?:_[A-Za-z0-9]+)+\b|\b[a-z]+[A-Z][A-Za-z0-9]*\b|\b[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*\b", claim)))[:3]
    has = lambda terms: any(t in low for t in terms)
    for name, mode, terms, pattern in CLAIM_RULES[:3]:
        if has(terms):
            out.append((name, mode, pattern))
    if has(USAGE_TERMS):
        out += [(f"runtime-usage-{i}", "challenge-if-no-match", rf"\b{re.escape(n)}\s*\(") for i, n in enumerate(names[-2:], 1)]
    for name, mode, terms, pattern in CLAIM_RULES[3:]:
        if has(terms):
            out.append((name, mode, pattern))
    if has(DEPENDENCY_TERMS) and names:
        out.append(("dependency-reference", "context", rf"\b{re.escape(names[0])}\b"))
    if not out:
        words = [w for w in re.findall(r"[A-Za-z0-9_.-]{3,}|[一-鿿]{1,8}", claim.lower()) if w not in QUERY_STOP_WORDS][:8]
        out = [("claim-context", "context", "(?i)" + "|".join(map(re.escape, words)))] if words else []
    seen: set[str] = set()
    return [x for x in out if not (x[2] in seen or seen.add(x[2]))][:10]


def claim_recall(claim: str, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations of a claim's requirements over texts(path, text), and the status that follows. No semantic truth is
    claimed: a status says what was matched."""
    seen = recall.observe(claim_requirements(claim), texts)
    return seen, recall.verification_status(seen)


def trim_observations(observations: DataFrame, limit: int) -> DataFrame:
    """Observations in order of weight, as many as fit, one at least."""
    order = F.array_position(F.array(*map(F.lit, recall.OBSERVATIONS)), F.col("status"))
    rows = observations.withColumns({"cost": estimated_tokens(F.concat_ws(" ", "requirement_id", "mode", "status")), "weight": order, "pack": F.lit(0)})
    return budget.trim_tail(rows, ["pack"], ["weight", "requirement_id"], "cost", max(64, limit)).drop("pack", "weight")


def handoff(rows: DataFrame, most_items: int = 12, most_chars: int = 1600) -> DataFrame:
    """Handoff payloads, fields under any of their names, as one column each: bounded, and items of sets once.

    `summary` is text, the others are arrays of texts; columns of other names are kept.
    """
    have = set(rows.columns)
    none = F.array().cast("array<string>")
    short = lambda x: F.when(F.length(x) > most_chars, F.concat(F.left(x, F.lit(most_chars)), F.lit("…"))).otherwise(x)
    out = {}
    for field, names in HANDOFF_ALIASES.items():
        given = [F.col(n) for n in names if n in have]
        if field == "summary":
            out[field] = short(F.coalesce(*given)) if given else F.lit(None).cast("string")
        else:
            out[field] = F.transform(F.slice(F.array_distinct(F.coalesce(*given, none) if given else none), 1, most_items), short)
    return rows.select(*[c for c in rows.columns if not any(c in n for n in HANDOFF_ALIASES.values())], *[v.alias(k) for k, v in out.items()])


def read_symbol(index: DataFrame, files: DataFrame, path: str, symbol: str) -> DataFrame:
    """A symbol's lines: the first of its exact name (or file.name), else the first whose name contains it."""
    rows = index.where(F.col("path") == path).select("path", F.posexplode("symbol_details").alias("n", "s")).select("path", "n", "s.*")
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    exact = (F.col("name") == symbol) | (F.concat(F.lit(stem + "."), F.col("name")) == symbol)
    rows = rows.withColumn("exact", exact).where(exact | F.contains(F.lower("name"), F.lit(symbol.lower()))).orderBy(F.desc("exact"), "n").limit(1)
    lines = F.slice(F.split("content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    return rows.join(files.select("path", "content"), "path").select("path", "name", "kind", "signature", "start_line", "end_line", "fingerprint", F.array_join(lines, "\n").alias("content"))


def symbol_with_ledger(symbols: DataFrame, ledger: DataFrame) -> DataFrame:
    """Read symbols(key, fingerprint, content) against a ledger(key, fingerprint, content): omitted if unchanged, a
    difference if that is shorter than the whole, else the whole."""
    from ..operators.state import compare, unified_diff

    rows = compare(symbols, ledger).join(ledger.select("key", F.col("content").alias("old")), "key", "left")
    rows = rows.withColumn("diff", F.when(F.col("status") == "changed", unified_diff("old", "content")))
    delta = F.col("diff").isNotNull() & (estimated_tokens(F.col("diff")) < estimated_tokens(F.col("content")))
    return rows.withColumns({"delivery": F.when(F.col("status") == "unchanged", "omit").when(delta, "delta").otherwise("full"), "content": F.when(F.col("status") == "unchanged", None).when(delta, F.col("diff")).otherwise(F.col("content"))}).drop("old", "diff")


def contract_pairs(paths: DataFrame, each: int = 3) -> DataFrame:
    """Client and server paths that a contract may join: three of each at most, every two."""
    side = lambda pattern, name: paths.where(F.lower("path").rlike(pattern)).orderBy("path").limit(each).select(F.col("path").alias(name))
    return side(r"client|page|component|view|hook|frontend", "client_path").crossJoin(side(r"server|route|api|controller|handler|backend", "server_path"))


def case_results(cases: DataFrame, claims: DataFrame) -> DataFrame:
    """cases(case, required, forbidden: arrays of claims) against claims(case, claim): what is missing, what is wrong."""
    found = claims.groupBy("case").agg(F.collect_set("claim").alias("found"))
    rows = cases.join(found, "case", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    missing, wrong = F.array_except("required", "found"), F.array_intersect("forbidden", "found")
    return rows.select("case", missing.alias("missing"), wrong.alias("forbidden_found"), ((F.size(missing) == 0) & (F.size(wrong) == 0)).alias("passed"))


def append(rows: DataFrame, path: str, now: Column) -> None:
    """Append events or artifacts to a table, with when and a fingerprint of their text columns."""
    texts = [F.col(c) for c, t in rows.dtypes if t == "string"]
    rows.withColumns({"ts": now, "fingerprint": fingerprint(*texts) if texts else F.lit(None).cast("string")}).write.mode("append").parquet(path)


@dataclass
class ContextRun:
    """What a context request gives: each a DataFrame, computed when asked for."""

    plan: DataFrame
    lanes: DataFrame
    files: DataFrame
    symbols: DataFrame
    blocks: DataFrame
    coverage: DataFrame
    stale: DataFrame
    locators: DataFrame
    status: DataFrame


def execute_context(task: str, files: DataFrame, external: DataFrame | None = None, active: DataFrame | None = None, budget_tokens: int = 6000, forced: str | None = None, run_id: str = "run") -> ContextRun:
    """A whole context request over files(path, bytes, content): the plan of the task with its lanes; an index of the
    files, ranked by the import graph and the task's terms; the pack that fits; external blocks, each once; what of the
    active(id, path, revision) evidence of before is stale; every place as a locator, active where the pack holds it,
    else recallable; and whether the pack is enough. Revisions are the blobs' ids. Nothing is run or delegated here.
    """
    from ..operators import blocks, planning, state
    from ..sources import repository, version_control

    spark, budget_tokens = files.sparkSession, max(800, budget_tokens)
    planned = planning.plans(spark.createDataFrame([(run_id, task)], "run_id string, task string"), forced=forced)
    index = written(repository.build_index(files), "index")
    links = graph.resolve_imports(index.select(F.col("path").alias("src"), F.explode("imports").alias("spec")), index.select("path"))
    edges = written(links.where("kind = 'edge'").select("src", "dst"), "edges")
    named = index.withColumns({"symbols": F.array_join("symbols", " "), "imports": F.array_join("imports", " ")})
    distance = graph.distances(edges, index.where("entry_point").select(F.col("path").alias("node")))
    ranked = written(graph.rank_files(named, graph.degrees(index.select(F.col("path").alias("node")), edges), distance, task), "ranked")
    details = index.select("path", F.explode("symbol_details").alias("s")).select("path", "s.name", "s.start_line", "s.end_line", "s.estimated_tokens")
    chosen, picked, seen = context_pack(ranked, details, task, budget_tokens)
    chosen, picked = written(chosen, "files"), written(picked, "symbols")
    revisions = files.select("path", version_control.blob_id(F.col("content")).alias("revision"))
    old = active if active is not None else spark.createDataFrame([], "id string, path string, revision string")
    held = chosen.select(locator_id(F.col("path"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int")).alias("id")).union(picked.select(locator_id(F.col("path"), F.col("name"), F.col("start_line"), F.col("end_line"))))
    places = repository.locators(index).withColumn("id", locator_id(F.col("path"), F.col("symbol"), F.col("start_line"), F.col("end_line")))
    tiered = places.join(held.distinct().withColumn("__held", F.lit(True)), "id", "left").withColumn("tier", F.when(F.col("__held"), "active").otherwise("recallable")).drop("__held").join(revisions, "path", "left")
    outside = blocks.deduplicate(external) if external is not None else blocks.deduplicate(spark.createDataFrame([], "ordinal long, provider string, path string, symbol string, fingerprint string, provider_score double"))
    counts = chosen.agg(F.count("*").alias("files"), F.coalesce(F.max("used"), F.lit(0)).alias("file_tokens")).crossJoin(picked.agg(F.count("*").alias("symbols"))).crossJoin(seen)  # one row each
    reasons = packets.sufficiency(F.col("files") + F.col("symbols"), F.coalesce("coverage.score", F.lit(0.0)), F.lit(0))
    return ContextRun(planned, planning.lanes(planned, "run_id", context=budget_tokens), chosen, picked, outside, seen, state.stale(old, revisions), tiered, counts.withColumn("reasons", reasons))
