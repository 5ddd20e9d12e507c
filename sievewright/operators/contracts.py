"""Contracts of records: invariants of each kind, checked as columns."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def _outside(name: str, low: float, high: float) -> Column:
    return F.col(name).isNotNull() & ~F.coalesce(F.col(name).try_cast("double").between(low, high), F.lit(False))


#: Contract name to (message, condition that breaks it); conditions are made when a contract is used.
CONTRACTS = {
    "finding": lambda: [("claim must be non-empty", _blank("claim")), ("evidence must be non-empty", _blank("evidence")), ("source must be non-empty", _blank("source")), ("confidence must be within 0..1", _outside("confidence", 0, 1))],
    "context-evidence": lambda: [("id must be a locator", ~F.coalesce(F.col("id").rlike("^ctx:[0-9a-f]{20}$"), F.lit(False))), ("path must be non-empty", _blank("path")), ("tier is unknown", ~F.coalesce(F.col("tier").isin("hot", "warm", "active", "rejected"), F.lit(False)))],
    "trace-event": lambda: [("run_id must be non-empty", _blank("run_id")), ("kind must be non-empty", _blank("kind")), ("ts must be a number", F.col("ts").try_cast("double").isNull())],
    "token-estimate": lambda: [("tokens must not be negative", F.coalesce(F.col("tokens") < 0, F.lit(True)))],
    "schedule-node": lambda: [("id must be non-empty", _blank("id")), ("role must be non-empty", _blank("role"))],
    "runtime-event": lambda: [("node_id must be non-empty", _blank("node_id")), ("status must be non-empty", _blank("status")), ("tokens must not be negative", F.coalesce(F.col("input_tokens") < 0, F.lit(False)))],
}


def errors(rows: DataFrame, contract: str) -> DataFrame:
    """Rows with the messages of the invariants that they break."""
    if contract not in CONTRACTS:
        raise ValueError(f"no such contract: {contract}; there are {sorted(CONTRACTS)}")
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(c, m) for m, c in CONTRACTS[contract]()])))


def registry(spark: SparkSession) -> DataFrame:
    """The contracts by name, with the number of their invariants."""
    return spark.createDataFrame([(k, len(v())) for k, v in sorted(CONTRACTS.items())], "contract string, invariants int")


class Rule(NamedTuple):
    """An invariant of a JSON payload: what must hold of the value at `path`, else `message`. Values that `allowed` names
    may stand there; with `missing` the field may be left out or null."""

    path: str
    kind: str
    message: str
    allowed: tuple = ()
    missing: bool = False


def _each(kind: str, message: str, names: str) -> list[Rule]:
    return [Rule(n, kind, message.format(n)) for n in names.split()]


def _texts(names: str) -> list[Rule]:
    return _each("text", "{} must be a non-empty string", names)


def _arrays(names: str) -> list[Rule]:
    return _each("array", "{} must be an array", names)


def _objects(names: str) -> list[Rule]:
    return _each("object", "{} must be an object", names)


def _booleans(names: str) -> list[Rule]:
    return _each("boolean", "{} must be boolean", names)


def _counts(names: str) -> list[Rule]:
    return _each("count", "{} must be a non-negative integer", names)


def _present(names: str) -> list[Rule]:
    return _each("present", "missing required field: {}", names)


def _one(path: str, message: str, *allowed, missing: bool = False) -> list[Rule]:
    return [Rule(path, "one", message, allowed, missing)]


def _classified(as_: str) -> list[Rule]:
    return _one("classification", "classification mismatch", as_)


_ID = [Rule("schema", "schema", "schema id mismatch", missing=True)]
_EVIDENCE_ONLY = _one("policy.content_authority", "content_authority must be evidence-only", "evidence-only")
# The invariants of each kind of payload, in the order in which they are reported.
PAYLOADS: dict[str, list[Rule]] = {
    "finding": [*_texts("claim evidence source"), Rule("confidence", "share", "confidence must be between 0 and 1"), Rule("confidence", "number", "confidence must be numeric", missing=True)],
    "worker-output": [*_ID, *_arrays("findings"), Rule("findings", "findings", "findings[{}]: {}")],
    "handoff": [*_present("from to handoff"), Rule("handoff", "object", "handoff must be an object", missing=True)],
    "fan-in": [*_arrays("findings contradictions"), *_objects("stats")],
    "contradiction": [*_texts("key"), Rule("reasons", "items", "reasons must contain at least one item", (1,)), Rule("claims", "items", "claims must contain at least two items", (2,))],
    "synthesis-packet": [*_arrays("findings contradictions"), *_objects("budget")],
    "trace-event": _present("ts run_id kind data"),
    "benchmark-case": [*_texts("task"), *_arrays("worker_outputs")],
    "token-estimate": [*_counts("tokens"), *_texts("tokenizer"), *_booleans("exact")],
    "provenance": [*_texts("classification"), *_booleans("git_available")],
    "candidate-analysis": [*_classified("candidate-detection-with-deterministic-verification"), *_texts("provider"), *_booleans("semantic_similarity_used"), *_arrays("pairs")],
    "runtime-invocation": [*_texts("run_id node_id role model_tier"), *_ID, *_objects("dependency_handoffs budget"), *_one("policy.instruction_authority_from_context", "context must not gain instruction authority", False)],
    "runtime-result": [*_texts("run_id adapter"), *_booleans("success cancelled"), *_objects("nodes fan_in synthesis_packet telemetry status_counts")],
    "runtime-telemetry": [*_texts("run_id"), *_counts("workers input_tokens output_tokens total_tokens"), *_one("cost_completeness", "invalid cost_completeness", "complete", "partial", "unreported")],
    "final-answer-evaluation": [*_classified("deterministic-final-answer-invariant-check"), *_booleans("passed"), *_arrays("missing_required_claims forbidden_hits missing_required_fields")],
    "runtime-config": [*_texts("adapter"), *_one("reduction_mode", "invalid reduction_mode", "compat", "auto", "direct", "light", "full", missing=True), Rule("container.image", "container-text", "container.image must be a non-empty string for container adapter"),
                       Rule("container.repo_mode", "container-one", "container.repo_mode must be ro, rw, or none", ("ro", "rw", "none"), True)],
    "runtime-state": [*_texts("run_id status adapter config_sha256 plan_sha256"), *_ID, *_objects("results handoffs counters repository_identity")],
    "sandbox-policy": [*_classified("container-sandbox-policy"), *_one("repo_mode", "invalid repo_mode", "ro", "rw", "none"), *_texts("network"), *_one("pull", "invalid pull policy", "never", "missing", "always", missing=True), *_booleans("read_only_root drop_all_capabilities no_new_privileges")],
    "filter-summary": [*_ID, *_one("classification", "invalid filter summary classification", "deterministic-filter-and-dedup-summary", "deterministic-handoff-filter-summary", "context-cross-layer-filter-summary")],
    "dedup-support": [*_ID, Rule("occurrence_count", "positive", "occurrence_count must be >= 1"), *_arrays("providers records"), *_one("provenance_preserved", "provenance_preserved must be true", True)],
    "filter-audit": [*_ID, *_classified("deterministic-filter-invariant-audit"), *_booleans("passed"), *_arrays("violations warnings"), *_objects("metrics")],
    "model-packet": [*_ID, *_arrays("findings contradictions"), *_objects("sources"), *_EVIDENCE_ONLY],
    "model-context": [*_ID, *_arrays("files symbols external_context"), *_EVIDENCE_ONLY],
    "token-economics": [*_ID, *_objects("baseline observed_or_estimated_pipeline"), *_booleans("token_efficient")],
    "adaptive-reduction": [*_ID, *_one("selected_mode", "invalid selected_mode", "direct", "light", "full"), *_objects("eligibility")],
    "reduction-simulation": [*_ID, *_one("recommended_policy", "recommended_policy must be adaptive", "adaptive"), *_arrays("scenarios"), *_objects("aggregate")],
    "context-evidence": [*_ID, *_classified("repository-context-evidence"), *_texts("id path"), *_one("tier", "invalid tier", "active", "recallable", "rejected"), *_one("validity", "invalid validity", "current", "stale", "missing"), *_objects("revision")],
    "context-store": [*_ID, *_one("version", "version must be 2", 2), *_texts("session"), *_objects("items index_summary"), *_arrays("invalidations")],
    "recall-result": [*_ID, *_classified("deterministic-repository-context-recall"), *_texts("query"), *_objects("model_payload sidecar"), *_one("metrics.model_calls_added", "recall must not add model calls", 0)],
    "recall-benchmark": [*_ID, *_classified("deterministic-critical-evidence-recall-benchmark"), *_arrays("cases"), *_one("aggregate.model_calls_added_by_recall", "recall benchmark must report zero model calls", 0)],
    "claim-verification-recall": [*_ID, *_classified("deterministic-claim-aware-verification-recall"), *_texts("claim"), *_one("verification.semantic_truth_claimed", "claim recall must not claim semantic truth", False),
                                  *_one("verification.status", "invalid verification status", "challenged", "provisionally-supported", "inconclusive"), *_objects("model_payload"), *_one("metrics.model_calls_added", "claim recall must not add model calls", 0), *_one("metrics.recall_model_calls_added", "claim recall must not add model calls", 0)],
}
#: Versions of schema ids that aren't 1.
_VERSIONS: dict[str, int] = {}


def schema_id(contract: str, prefix: str = "sievewright") -> str:
    return f"{prefix}-{contract}/v{_VERSIONS.get(contract, 1)}"


def schemas(spark: SparkSession) -> DataFrame:
    """The contracts of payloads by name, with their schema ids and numbers of invariants."""
    return spark.createDataFrame([(k, schema_id(k), len(v)) for k, v in sorted(PAYLOADS.items())], "contract string, schema string, invariants int")


def _value(payload: Column, path: str) -> Column:
    return F.try_variant_get(payload, f"$.{path}", "variant")


def _kind(value: Column) -> Column:
    """object, array, text, boolean, integer, number, null, or missing."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), "missing").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "text").when(name == "BOOLEAN", "boolean")
        .when(name.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), "integer").when(name == "VOID", "null").otherwise("number")
    )


def _breaks(payload: Column, rule: Rule, contract: str) -> Column:
    value = _value(payload, rule.path)
    kind, text = _kind(value), F.try_variant_get(payload, f"$.{rule.path}", "string")

    def blank() -> Column:
        return ~F.coalesce((kind == "text") & text.rlike(r"\S"), F.lit(False))

    def number() -> Column:
        return F.when(kind.isin("text", "boolean", "integer", "number"), F.when(kind == "boolean", F.when(text == "true", 1.0).otherwise(0.0)).otherwise(F.trim(text).try_cast("double")))

    def below(least: int) -> Column:
        return ~(kind.isin("integer", "boolean") & F.coalesce(number() >= least, F.lit(False)))

    def outside() -> Column:
        words = any(isinstance(x, str) for x in rule.allowed)
        spelled = [x if isinstance(x, str) else json.dumps(x) for x in rule.allowed]
        return ~F.coalesce(text.isin(*spelled) & ((kind == "text") if words else (kind != "text")), F.lit(False))

    def contained() -> Column:
        return F.try_variant_get(payload, "$.adapter", "string") == "container"

    out = {
        "text": blank, "container-text": lambda: contained() & blank(), "array": lambda: kind != "array", "object": lambda: kind != "object", "boolean": lambda: kind != "boolean", "present": lambda: kind == "missing",
        "count": lambda: below(0), "positive": lambda: below(1), "one": outside, "container-one": lambda: contained() & outside(),
        "schema": lambda: ~F.coalesce((kind == "text") & (text == schema_id(contract)), F.lit(False)), "share": lambda: number().isNotNull() & ~number().between(0, 1), "number": lambda: number().isNull(),
        "items": lambda: ~F.coalesce((kind == "array") & (F.size(F.try_variant_get(payload, f"$.{rule.path}", "array<variant>")) >= rule.allowed[0]), F.lit(False)),
    }[rule.kind]()
    # what may be left out may mostly be null as well
    if rule.kind == "number" or rule.missing and rule.kind == "object":
        return out & (kind != "missing")
    return out & ~kind.isin("missing", "null") if rule.missing else out


def _messages(payload: Column, contract: str) -> Column:
    plain = [r for r in PAYLOADS[contract] if r.kind != "findings"]
    out = F.array_distinct(F.array_compact(F.array(*[F.when(_breaks(payload, r, contract), r.message) for r in plain])))
    if len(plain) < len(PAYLOADS[contract]):
        items = F.coalesce(F.try_variant_get(payload, "$.findings", "array<variant>"), F.array().cast("array<variant>"))
        nested = F.transform(items, lambda x, i: F.transform(_checked(x, "finding"), lambda m: F.concat(F.lit("findings["), i.cast("string"), F.lit("]: "), m)))
        out = F.concat(out, F.flatten(nested))
    return out


def _checked(payload: Column, contract: str) -> Column:
    return F.when(_kind(payload) == "object", _messages(payload, contract)).otherwise(F.array(F.lit("payload must be an object")))


def payload_errors(rows: DataFrame, contract: str, payload: str = "payload") -> DataFrame:
    """Rows with the messages of the invariants that their JSON breaks; text that isn't JSON, or null, is no object."""
    if contract not in PAYLOADS:
        raise ValueError(f"no such contract: {contract}; there are {sorted(PAYLOADS)}")
    return rows.withColumn("__payload", F.try_parse_json(payload)).withColumn("errors", _checked(F.col("__payload"), contract)).drop("__payload")
