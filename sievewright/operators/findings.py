"""Fan-in of findings: normalise, validate, group exact duplicates with their support, contradictions, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, fingerprint, identity_text, trust

#: Columns of a raw finding; those a table lacks are null. `value` may be of any scalar type.
RAW = ("claim", "summary", "fact", "evidence", "detail", "support", "source", "path", "file", "url", "confidence", "canonical_key", "subject", "predicate", "period", "unit", "polarity", "value", "provenance")
WORKER_NAMES = ("worker_id", "worker", "producer", "agent", "from", "role")


def worker_name(df: DataFrame, index: Column) -> Column:
    """The first worker name that isn't blank, else worker-<index + 1>."""
    names = [F.nullif(clean(F.col(f"`{c}`").cast("string")), F.lit("")) for c in WORKER_NAMES if c in df.columns]
    return F.coalesce(*names, F.concat(F.lit("worker-"), (index + 1).cast("string")))


def confidence(value: Column) -> Column:
    """A number from 0 to 1; anything else is 0.5."""
    number = value.try_cast("double")
    return F.when((number >= 0) & (number <= 1) & ~F.isnan(number), number).otherwise(0.5)


def assertion_value(value: Column, kind: str) -> Column:
    """A scalar as (tag, text) that compares across spellings: 1 and 1.0 alike, true and 1 not; null if none."""
    if kind == "boolean":
        return F.when(value.isNotNull(), F.concat(F.lit("bool:"), value.cast("string")))
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        number = value.cast("double")
        whole = F.when((number == F.floor(number)) & (F.abs(number) < 9e15), number.cast("long").cast("string")).otherwise(number.cast("string"))
        return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), F.concat(F.lit("number:"), whole))
    if kind == "string":
        return F.when(clean(value) != "", F.concat(F.lit("string:"), identity_text(value)))
    return F.lit(None).cast("string")


def normalize(raw: DataFrame) -> DataFrame:
    """Raw findings with the columns of a finding, or the reason why a row is none (malformed_reason).

    claim, evidence and source take the first of their aliases that isn't empty (blank ones hide later ones), trimmed.
    Adds the group key (canonical key as it is, else the claim's identity text), the identity (canonical key, else
    subject, predicate, period and unit; null without both of the first two), the assertion side, and trust.
    """
    df = raw.withColumns({c: F.lit(None).cast("string") for c in RAW if c not in raw.columns})
    first = lambda *names: clean(F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in names]))
    kind = df.schema["value"].dataType.simpleString()
    df = df.withColumns({"claim": first("claim", "summary", "fact"), "evidence": first("evidence", "detail", "support"), "source": first("source", "path", "file", "url"), "confidence": confidence(F.col("confidence")), "canonical_key": clean(F.col("canonical_key"))})
    missing = F.array_compact(F.array(*[F.when(F.col(c) == "", c) for c in ("claim", "evidence", "source")]))
    df = df.withColumn("malformed_reason", F.when(F.size(missing) > 0, F.concat(F.lit("missing required field(s): "), F.array_join(missing, ", "))))
    df = df.withColumns({"claim_text": identity_text(F.col("claim")), **{f"{c}_text": identity_text(F.col(c)) for c in ("subject", "predicate", "period", "unit", "polarity")}, "value_text": assertion_value(F.col("value"), kind)})
    canonical = F.when(F.col("canonical_key") != "", F.concat(F.lit("canonical:"), F.col("canonical_key")))
    tuple_ = F.when((F.col("subject_text") != "") & (F.col("predicate_text") != ""), F.concat(F.lit("tuple:"), F.concat_ws("|", "subject_text", "predicate_text", "period_text", "unit_text")))
    side = F.when((F.col("polarity_text") != "") | F.col("value_text").isNotNull(), F.concat_ws("|", F.col("polarity_text"), F.coalesce("value_text", F.lit("")), F.col("unit_text")))
    return df.withColumns({
        "group_key": F.coalesce(canonical, F.concat(F.lit("claim:"), F.col("claim_text"))), "identity": F.coalesce(canonical, tuple_), "side": side,
        "trust": trust(F.concat_ws("\n", "claim", "evidence")),
    })


def assertion_key(policy: str = "exact-claim") -> Column:
    """What a finding asserts within its group: its side, else its claim if a canonical key groups it, else nothing."""
    exact = F.when(F.col("canonical_key") != "", F.concat(F.lit("claim:"), F.col("claim_text"))) if policy == "exact-claim" else F.lit(None).cast("string")
    return F.coalesce(F.concat(F.lit("side:"), F.col("side")), exact, F.lit(""))


def decide(findings: DataFrame, min_confidence: float = 0.0, trust_policy: str = "annotate") -> DataFrame:
    """Normalised findings with the decision on each: malformed, drop (and why), quarantine or keep, in that order."""
    high = F.col("trust.severity") == "high"
    out = F.when(F.col("malformed_reason").isNotNull(), F.struct(F.lit("malformed").alias("decision"), F.col("malformed_reason").alias("reason")))
    out = out.when(F.col("confidence") < min_confidence, F.struct(F.lit("drop").alias("decision"), F.lit("low-confidence").alias("reason")))
    if trust_policy in ("quarantine-high", "drop-high"):
        out = out.when(high, F.struct(F.lit("quarantine" if trust_policy == "quarantine-high" else "drop").alias("decision"), F.lit("trust-high-risk").alias("reason")))
    return findings.withColumn("decision", out.otherwise(F.struct(F.lit("keep").alias("decision"), F.lit(None).cast("string").alias("reason"))))


def code(*parts: str | Column) -> Column:
    """128 bits that stand for a value, or a tuple of them, in keys and distinct counts; null if any part is."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.struct(F.xxhash64(*cols).alias("x"), F.xxhash64(F.lit(1), *cols).alias("y")))


#: Tasks over which findings of one identity and side are dealt before they are counted.
SPREAD = 8
#: What a group takes from its best finding.
BEST = ("ordinal", "claim", "evidence", "source", "worker", "confidence", "canonical_key", "identity", "side", "polarity_text", "value_text", "unit_text", "subject", "predicate", "period", "unit", "polarity", "value")


def combined(findings: DataFrame) -> DataFrame:
    """Findings that differ in their ordinal alone as one row, with the smallest and how many they are (times).

    Counted by a hash of their columns, they needn't be sorted; what `groups` then expands and sorts doesn't grow with
    repeats.
    """
    same = [c for c in BEST if c != "ordinal"]
    return findings.groupBy(*same, "claim_text", "group_key", "provenance").agg(F.count("*").alias("times"), F.min("ordinal").alias("ordinal"))


def groups(findings: DataFrame, policy: str = "exact-claim", times: Column | None = None) -> DataFrame:
    """Findings with equal group key and assertion as one row: who and what supports it, and its best finding.

    The best has the highest confidence, then the first worker and source. Keys and what is counted as distinct are
    hashes of 128 bits, so rows that are expanded for the counts hold no text; the best finding alone carries it, and the
    key is worked out from that. Counts are combined before they are shuffled. `times` is how many findings a row stands
    for, as in `combined`.
    """
    ref = fingerprint(F.col("source"), F.sha2(F.col("evidence"), 256), F.col("provenance"))
    rank = F.struct(-F.col("confidence"), F.col("worker"), F.col("source"), F.col("ordinal"))
    coded = {
        "__key": F.struct(code("group_key").alias("g"), code(assertion_key(policy)).alias("a")), "__worker": code("worker"), "__source": code("source"), "__both": code("worker", "source"),
        "__ref": code(ref), "__claim": code("claim_text"), "__rank": rank,
    }
    out = findings.withColumns(coded).groupBy("__key").agg(
        (F.count("*") if times is None else F.sum(times)).alias("occurrence_count"), F.count_distinct("__worker").alias("workers"), F.count_distinct("__source").alias("independent_source_count"),
        F.count_distinct("__both").alias("worker_sources"), F.count_distinct("__ref").alias("independent_evidence_count"), F.count_distinct("__claim").alias("claim_variants"),
        F.min_by(F.struct(*BEST), "__rank").alias("best"), F.min("ordinal").alias("first_seen"),
    )
    agreement = F.greatest(F.lit(1), F.col("workers")).cast("long")
    claim = identity_text(F.col("best.claim"))
    canonical = F.when(F.col("best.canonical_key") != "", F.concat(F.lit("canonical:"), F.col("best.canonical_key")))
    exact = F.when(F.col("best.canonical_key") != "", F.concat(F.lit("claim:"), claim)) if policy == "exact-claim" else F.lit(None).cast("string")
    return out.drop("__key").withColumns({
        "group_key": F.coalesce(canonical, F.concat(F.lit("claim:"), claim)), "assertion_key": F.coalesce(F.concat(F.lit("side:"), F.col("best.side")), exact, F.lit("")),
        "agreement_count": agreement, "duplicates": F.col("occurrence_count") - 1, "intra_worker_repeats": F.col("occurrence_count") - F.col("workers"),
        "same_source_repeats": F.col("occurrence_count") - F.col("worker_sources"), "cross_worker_support": F.col("workers") - 1,
    })


def support(findings: DataFrame, policy: str = "exact-claim") -> DataFrame:
    """One row for each distinct supporter of a group: its worker, source and evidence."""
    return findings.withColumn("assertion_key", assertion_key(policy)).select("group_key", "assertion_key", "worker", "source", F.sha2("evidence", 256).alias("evidence_sha256")).distinct()


def contradictions(findings: DataFrame) -> DataFrame:
    """Identities whose findings disagree in polarity or value: the reasons, the numbers of sides and of findings.

    All findings stay where they are; nothing is averaged or dropped. A finding is a row for its side and one each for its
    polarity and its value, if any: hashes of 128 bits, which are counted within an identity before it is one row, so
    neither is a large identity one task's nor are rows multiplied for the distinct counts later on. Findings are dealt
    into spark.sql.shuffle.partitions tasks first, those of one side over SPREAD of them: files and shuffles of such rows
    are small, and tasks of so many bytes would hold millions of groups.
    """
    spark = findings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    polarity = F.nullif(F.col("polarity_text"), F.lit(""))
    hashed = lambda kind, c, has: F.struct(F.lit(kind).alias("kind"), F.when(has, F.xxhash64(c)).alias("x"), F.when(has, F.xxhash64(F.lit(1), c)).alias("y"))
    held = lambda kind, c: F.when(c.isNotNull(), hashed(kind, c, c.isNotNull()))
    side = F.col("side")
    each = F.explode(F.array_compact(F.array(hashed(0, side, side.isNotNull()), held(1, polarity), held(2, F.col("value_text"))))).alias("by")
    rows = findings.where("identity IS NOT NULL").select("identity", "polarity_text", "value_text", "side", (F.monotonically_increasing_id() % SPREAD).alias("spread"))
    rows = rows.repartition(parts, "identity", "side", "spread").select("identity", each).groupBy("identity", "by.kind", "by.x", "by.y").agg(F.count("*").alias("n"))
    n = lambda kind: F.count_if((F.col("kind") == kind) & F.col("x").isNotNull())
    out = rows.groupBy("identity").agg(F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("findings"), n(1).alias("polarities"), n(2).alias("values"), n(0).alias("sides"))
    reasons = F.array_compact(F.array(F.when(F.col("polarities") > 1, "polarity disagreement"), F.when(F.col("values") > 1, "value disagreement")))
    return out.withColumn("reasons", reasons).where("findings > 1 AND size(reasons) > 0")


def reduction_stats(decided: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of counts over the decisions and the groups."""
    a = decided.agg(
        F.count("*").alias("extracted"), F.count_if(F.col("decision.decision") == "malformed").alias("malformed"), F.count_if(F.col("decision.decision") == "drop").alias("filtered"),
        F.count_if(F.col("decision.decision") == "quarantine").alias("quarantined"), F.count_if(F.col("decision.decision") == "keep").alias("valid"),
    )
    b = grouped.agg(
        F.count("*").alias("output"), F.sum("duplicates").alias("duplicates"), F.sum("intra_worker_repeats").alias("intra_worker_repeats"), F.sum("cross_worker_support").alias("cross_worker_support"),
        F.max("occurrence_count").alias("max_occurrence"), F.max("agreement_count").alias("max_agreement"),
    )
    return a.crossJoin(b)  # one row each


def audit(grouped: DataFrame) -> DataFrame:
    """Invariants that a group breaks, as an array of messages; empty arrays are good."""
    checks = {
        "agreement differs from the distinct workers": F.col("agreement_count") != F.greatest(F.lit(1), F.col("workers")),
        "occurrence below agreement": F.col("occurrence_count") < F.col("agreement_count"),
        "occurrence below sources": F.col("occurrence_count") < F.col("independent_source_count"),
        "occurrence below evidence": F.col("occurrence_count") < F.col("independent_evidence_count"),
        "duplicates differ from the repeats": F.col("duplicates") != F.col("occurrence_count") - 1,
        "no claim": F.coalesce(F.col("best.claim"), F.lit("")) == "",
        "confidence out of range": ~F.col("best.confidence").between(0, 1),
    }
    return grouped.withColumn("problems", F.array_compact(F.array(*[F.when(c, m) for m, c in checks.items()])))


def trust_summary(findings: DataFrame) -> DataFrame:
    """Number of findings by severity and signal; signal null is the severity's own count."""
    by_severity = findings.groupBy(F.col("trust.severity").alias("severity")).agg(F.count("*").alias("n")).withColumn("signal", F.lit(None).cast("string"))
    by_signal = findings.select(F.explode("trust.signals").alias("s")).groupBy(F.col("s.severity").alias("severity"), F.col("s.signal").alias("signal")).agg(F.count("*").alias("n"))
    return by_severity.unionByName(by_signal)
