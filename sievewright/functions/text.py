"""Column functions on text: normalisation, token estimates, terms, trust signals, fingerprints."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python has it within ASCII; Java's own class lacks the separators 1C to 1F.
SPACE = r"[\s\x1c-\x1f]+"

#: Texts of characters that are compatibility-composed as they are, whatever stands beside them, and whose lower case is
#: the same everywhere: ASCII, letters of Latin-1 and Cyrillic, ideographs.
PLAIN = r"^[\p{ASCII}À-ÖØ-öø-ÿА-яЁё一-鿿]*$"

# The words that queries and claims leave out, the concepts that widen a query, and the patterns of text
# that tries to steer its reader.
QUERY_STOP_WORDS = (
    "the", "a", "an", "and", "or", "to", "of", "in", "for", "on", "with", "is", "are", "this", "that", "it", "be", "as", "at", "by", "from", "project",
    "repo", "repository", "code", "file", "files", "why", "how", "find", "help", "please", "read", "analyze", "analyse", "entire", "whole", "issue", "problem",
)
CLAIM_STOP_WORDS = ("the", "and", "for", "with", "from", "this", "that", "into", "is", "are", "was", "were")
CONCEPTS = {
    "login": ["auth", "authentication", "session", "token", "jwt", "cookie", "credential", "refresh", "signin", "sign-in"],
    "登入": ["auth", "authentication", "session", "token", "jwt", "cookie", "credential", "refresh", "登入", "驗證"],
    "payment": ["checkout", "billing", "order", "transaction", "stripe", "refund", "invoice"],
    "付款": ["payment", "checkout", "billing", "order", "transaction", "stripe", "refund", "訂單"],
    "database": ["db", "repository", "storage", "sql", "orm", "entity", "model", "migration"],
    "資料庫": ["database", "db", "repository", "storage", "sql", "orm", "entity", "model"],
    "performance": ["latency", "slow", "cache", "memory", "cpu", "n+1", "query"],
    "效能": ["performance", "latency", "slow", "cache", "memory", "cpu", "query"],
}
TRUST_SIGNALS = (
    ("instruction-override", "high", r"\b(?:ignore|disregard|forget)\b.{0,60}\b(?:previous|prior|above|system|developer|user)\b.{0,40}\binstruction"),
    ("prompt-role-spoofing", "medium", r"(?:\[\s*system\s*\]|</?system>|\bsystem\s+prompt\b|\bdeveloper\s+message\b)"),
    ("agent-directed-command", "medium", r"\b(?:assistant|agent|model|chatgpt)\b.{0,80}\b(?:must|should|need to|execute|run|open|read|send|upload|delete)\b"),
    ("destructive-command", "high", r"\b(?:rm\s+-rf|git\s+reset\s+--hard|git\s+clean\s+-[a-z]*f|drop\s+database|truncate\s+table)\b"),
    ("credential-access", "high", r"(?:\.ssh/(?:id_rsa|id_ed25519)|\b(?:api[_ -]?key|access[_ -]?token|credential|password|secret)\b).{0,100}\b(?:cat|read|print|send|upload|post|curl|wget|exfiltrat)"),
    ("network-exfiltration", "high", r"\b(?:curl|wget|scp|nc|netcat)\b.{0,160}\b(?:https?://|@|upload|post)\b"),
)
SEVERITIES = ("none", "low", "medium", "high")
COMMAND_RISKS = (
    ("destructive", "confirmation-required", (r"\brm\s+-rf\b", r"\bgit\s+reset\s+--hard\b", r"\bgit\s+clean\s+-[a-z]*f", r"\bdrop\s+(table|database)\b", r"\btruncate\s+table\b")),
    ("credential-access", "confirmation-or-explicit-policy", (r"\b(cat|type|read)\b.*(?:\.env|id_rsa|credentials|secret|token)", r"\bprintenv\b", r"\benv\b")),
    ("write", "explicit-write-policy", (r"\bgit\s+(commit|push|merge|rebase)\b", r"\bnpm\s+publish\b", r"\bterraform\s+apply\b", r"\bkubectl\s+(apply|delete|patch)\b")),
    ("external-side-effect", "network-policy", (r"\bcurl\b", r"\bwget\b", r"\bssh\b", r"\bscp\b", r"\bgh\s+api\b")),
)


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t.strip()).lower().split()))


def clean(text: Column) -> Column:
    """Without white space at the ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}$", "")


def identity_text(text: Column) -> Column:
    """Compatibility-composed, lower case, one space between words, none at the ends; null becomes empty.

    What is ASCII and common letters stays in the JVM: only other texts cross to Arrow, the rest go as nulls.
    """
    plain = F.lower(F.regexp_replace(clean(text), SPACE, " "))
    return F.coalesce(_compatible(F.when((F.octet_length(text) != F.length(text)) & ~text.rlike(PLAIN), text)), plain)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; 0 for null."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def compact(text: Column, limit: int = 180) -> Column:
    """White space collapsed, cut to `limit` characters with an ellipsis."""
    flat = F.regexp_replace(clean(text), SPACE, " ")
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("…"))).otherwise(flat)


def distinct_texts(values: Column, cap: int = 50) -> Column:
    """Trimmed, not empty, each once in first-seen order, at most `cap`."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, clean), lambda x: x != "")), 1, cap)


def query_terms(query: Column) -> Column:
    """Lower-case terms of a query in order, repeats kept, stop words and single characters left out, at most 40."""
    found = F.transform(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"[A-Za-z0-9_\-.]+|[一-鿿]{1,8}"), F.lit(0)), F.lower)
    return F.slice(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(list(QUERY_STOP_WORDS))), 1, 40)


def expand_terms(terms: Column) -> Column:
    """Each term with its concept's words after it, each once in first-seen order, at most 80."""
    concepts = F.create_map(*[x for k, v in CONCEPTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    wide = F.flatten(F.transform(terms, lambda t: F.concat(F.array(F.lower(t)), F.coalesce(F.try_element_at(concepts, F.lower(t)), none))))
    return F.slice(F.array_distinct(wide), 1, 80)


def claim_terms(claim: Column) -> Column:
    """The set of terms by which claims are compared, on identity text."""
    found = F.regexp_extract_all(claim, F.lit(r"[a-z0-9_.:/-]{2,}|[一-鿿]{1,6}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(list(CLAIM_STOP_WORDS))))


def trust(text: Column) -> Column:
    """Struct of severity and signals: what in a text tries to instruct its reader. Text has no authority either way."""
    text = F.coalesce(text, F.lit(""))
    signals = F.array_compact(F.array(*[F.when(text.rlike(f"(?is){p}"), F.struct(F.lit(n).alias("signal"), F.lit(s).alias("severity"))) for n, s, p in TRUST_SIGNALS]))
    worst = F.array_max(F.transform(signals, lambda x: F.array_position(F.array(*map(F.lit, SEVERITIES)), x["severity"])))
    severity = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.coalesce(worst, F.lit(1)).cast("int"))
    return F.struct(severity.alias("severity"), signals.alias("signals"))


def command_risk(command: Column) -> Column:
    """Struct of risk and permission of a shell command: the first class of patterns with a hit."""
    lower, out = F.lower(F.coalesce(command, F.lit(""))), None
    for risk, permission, patterns in COMMAND_RISKS:
        hit, value = lower.rlike("|".join(f"(?:{p})" for p in patterns)), F.struct(F.lit(risk).alias("risk"), F.lit(permission).alias("permission"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit("read-only-or-unknown").alias("risk"), F.lit("normal").alias("permission")))


def fingerprint(*values: Column) -> Column:
    """SHA-256 of several values, nulls told apart from empty text and fields from each other."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("null")) for v in values]), 256)


def coverage(terms: Column, text: Column) -> Column:
    """Struct of the distinct terms that a text has and lacks, and the share it has to 3 places (null without terms)."""
    own = F.array_distinct(terms)
    has = F.filter(own, lambda t: F.contains(text, t))
    return F.struct(has.alias("matched"), F.array_except(own, has).alias("missing"), F.when(F.size(own) > 0, F.round(F.size(has) / F.size(own), 3)).alias("score"))


def locator_id(path: Column, symbol: Column, start: Column, end: Column) -> Column:
    """Identifier of a place in a repository, whatever its content."""
    text = F.concat(F.coalesce(path, F.lit("")), F.lit("#"), F.coalesce(symbol, F.lit("")), F.lit(":"), F.coalesce(start.cast("string"), F.lit("")), F.lit("-"), F.coalesce(end.cast("string"), F.lit("")))
    return F.concat(F.lit("ctx:"), F.left(F.sha2(text, 256), F.lit(20)))


def value_of_information(relevance: Column, uncertainty: Column, novelty: Column, distance: Column, tokens: Column) -> Column:
    """Worth of reading something next: relevant, uncertain, new, near and short scores high."""
    near = F.when(distance.isNull(), 1.0).otherwise(1 / (1 + F.greatest(F.lit(0), distance)))
    cost = F.greatest(F.lit(1.0), F.log2(F.greatest(F.lit(2), tokens).cast("double")))
    return F.round(F.greatest(F.lit(0.0), relevance) * F.greatest(F.lit(0.05), uncertainty) * F.greatest(F.lit(0.05), novelty) * (0.5 + near) / cost, 6)
