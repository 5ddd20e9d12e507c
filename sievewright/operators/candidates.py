"""Candidate pairs of findings: lexical or registered detection, deterministic verification, guarded merging."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import claim_terms, fingerprint
from ..tables import written
from .findings import assertion_key, code
from .graph import components

#: Parts of a class over which its first is handed back.
SALTS = 32
#: Least scores for which pairs are looked for in turn, until there are enough.
STEPS = (0.9, 0.8, 0.65, 0.5, 0.3, 0.1)
#: Comparisons, for each pair to be returned, up to which all scores are looked at in one step.
FEW = 1000
#: Registered detectors: name to (callable of findings, threshold, most pairs -> left, right, score; description).
PROVIDERS: dict[str, tuple[Callable[[DataFrame, float, int], DataFrame], str]] = {}


def register_provider(name: str, detect: Callable[[DataFrame, float, int], DataFrame], description: str = "registered detector") -> None:
    """Make a detector available by name. What it proposes is still verified: similarity merges nothing."""
    if not name.strip() or name.strip().lower() == "lexical":
        raise ValueError("a detector needs a name other than 'lexical'")
    PROVIDERS[name.strip().lower()] = detect, description


@F.pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0 for a, b in zip(left, right)])


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def _near(tokens: DataFrame, forms: DataFrame, least: float, sequence: bool, shared: bool) -> DataFrame:
    """Pairs (x, y) of forms with other terms whose score is `least` or more one way (score) or the other (back).

    Found by prefix filtering on rarest tokens.

    Sets of Jaccard similarity t have t of the larger in common. Matched characters are common ones, so texts of ratio t
    have t / (2 - t) of the longer in common, each character counted as often as it stands there.
    """
    near = max(0.0, least - 1e-6)  # scores are rounded
    share = F.when(F.col("kind") == "term", near).otherwise(near / (2 - near))
    held = tokens.where(F.col("nth") <= F.col("size") - F.ceil(share * F.col("size") - 1e-9) + 1).select("kind", "within", "token", "x", "size", share.alias("share"))
    other = held.select("kind", "within", "token", F.col("x").alias("y"), F.col("size").alias("size_"))
    fit = F.least("size", "size_") >= F.col("share") * F.greatest("size", "size_") - 1e-9
    met = held.join(other, ["kind", "within", "token"]).where((F.col("x") < F.col("y")) & fit).select("x", "y").distinct()
    for c in "xy":
        met = met.join(forms.select(F.col("x").alias(c), F.col("form").alias(f"form_{c}"), F.col("terms").alias(f"terms_{c}")), c)
    met = met.where("terms_x <> terms_y OR size(terms_x) = 0")
    if shared:
        met = met.where(F.arrays_overlap("terms_x", "terms_y"))
    score = back = jaccard(F.col("terms_x"), F.col("terms_y"))
    if sequence:  # matching blocks depend on which text comes first
        score, back = F.greatest(score, _ratio("form_x", "form_y")), F.greatest(score, _ratio("form_y", "form_x"))
    met = met.select("x", "y", F.round(score, 6).alias("score"), F.round(back, 6).alias("back"))
    return met.where(F.greatest("score", "back") >= least)


def _first(members: DataFrame, met: DataFrame, counts: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The `most` first pairs (left, right, score) by score and place of members(block, idx), and whether there are as many.

    In met(a, b, score, start) members of a stand on the left of later ones of b; start is null where b, a has the same
    score, else the first member of a. counts(score, n) says how many pairs have a score at least, or fewer. At one
    score, each member before a left one gives an earlier pair, so `most` on the left are enough; and so are the `most`
    on the right that come first in b, or first after start.
    """
    total, last = 0, -1.0
    for r in counts.where("n > 0").orderBy(F.desc("score")).limit(most).collect():
        total += r.n
        if total >= most:
            last = r.score
            break
    met = met.where(F.col("score") >= last)
    place = F.row_number().over(Window.partitionBy("block").orderBy("idx"))
    used = met.select(F.col("a").alias("block")).union(met.select("b")).distinct()
    few = written(members.join(used, "block", "left_semi").withColumn("place", place).where(F.col("place") <= most + 1).select("block", "idx"), "members")
    after = F.row_number().over(Window.partitionBy("a", "b").orderBy("right"))
    even = met.where("start IS NULL").join(few.select(F.col("block").alias("b"), F.col("idx").alias("right")), "b").select("a", "score", "right")
    uneven = met.where("start IS NOT NULL").join(members.select(F.col("block").alias("b"), F.col("idx").alias("right")), "b").where("right > start")
    uneven = uneven.withColumn("place", after).where(F.col("place") <= most).select("a", "score", "right")
    right = written(even.union(uneven), "right")
    left = few.select(F.col("block").alias("a"), F.col("idx").alias("left"))
    better, at = right.where(F.col("score") > last), right.where(F.col("score") == last)
    starts = at.groupBy("a").agg(F.max("right").alias("end")).join(left, "a").where("left < end").select("left").distinct().orderBy("left").limit(most)
    pairs = left.join(better, "a").union(left.join(starts, "left", "left_semi").select("a", "left").join(at, "a")).where("left < right")
    return pairs.select("left", "right", "score").orderBy(F.desc("score"), "left", "right").limit(most), total >= most


def best_pairs(rows: DataFrame, least: float, most: int, sequence: bool = True, shared: bool = True) -> DataFrame:
    """The `most` best pairs of rows(idx, within, claim_text) with one `within` and a score of `least` or more, exactly.

    With `shared`, of those that share a term. Rows of equal terms have score 1 and form one block, however many they
    are; other texts are compared once each, whatever their number of rows, and from high scores down only as far as
    needed. No term is left out for being common.
    """
    rows = rows.select("idx", "within", F.col("claim_text").alias("text"), F.array_sort(claim_terms(F.col("claim_text"))).alias("terms"))
    rows = rows.withColumn("set", F.array_join("terms", " ")).withColumn("form", F.col("text") if sequence else F.col("set"))
    forms = written(rows.groupBy("within", "form").agg(F.min("idx").alias("x"), F.count("*").alias("n"), F.first("terms").alias("terms"), F.first("set").alias("set")), "forms")
    sets = forms.where("set <> ''").groupBy("within", "set").agg(F.min("x").alias("s"), F.sum("n").alias("n"))
    placed = rows.select("idx", "within", "form").join(forms.select("within", "form", "set", "x"), ["within", "form"]).join(sets.select("within", "set", "s"), ["within", "set"], "left")
    placed = written(placed.select("idx", "within", "x", "s"), "placed")
    text = placed.select(F.concat(F.lit("x"), "x").alias("block"), "idx")
    members = text.union(placed.where("s IS NOT NULL").select(F.concat(F.lit("s"), "s"), "idx"))
    n_pairs, none = F.expr("n * (n - 1) div 2").alias("n"), F.lit(None).cast("long").alias("start")
    own = lambda kind, c, score: [F.concat(F.lit(kind), c).alias("a"), F.concat(F.lit(kind), c).alias("b"), F.lit(score).alias("score"), none, n_pairs]
    equal = sets.select(*own("s", "s", 1.0))
    if sequence and not shared:
        equal = equal.union(forms.where("set = '' AND form <> ''").select(*own("x", "x", 1.0)))
    equal = equal.where("n > 0")
    met, counts = equal.drop("n"), equal.select("score", "n")
    out, enough = _first(members, met, counts, most)
    if enough:
        return out
    words = forms.select(F.lit("term").alias("kind"), "within", "x", F.size("terms").alias("size"), F.explode("terms").alias("token"))
    if sequence:
        letters = forms.select("within", "x", F.length("form").alias("size"), F.explode(F.regexp_extract_all("form", F.lit("(?s)."), F.lit(0))).alias("letter"))
        letters = letters.groupBy("within", "x", "size", "letter").count().withColumn("time", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
        words = words.union(letters.select(F.lit("letter"), "within", "x", "size", F.concat("letter", F.col("time").cast("string"))))
    often = words.groupBy("kind", "within", "token").agg(F.count("*").alias("times"))
    nth = F.row_number().over(Window.partitionBy("kind", "x").orderBy("times", "token"))
    tokens = written(words.join(often, ["kind", "within", "token"]).withColumn("nth", nth).drop("times"), "tokens")
    sizes = forms.select("x", "n")
    # where even the lowest score leaves few to compare, that is the only step
    share = max(0.0, least - 1e-6)
    kept = F.col("nth") <= F.col("size") - F.ceil(F.when(F.col("kind") == "term", share).otherwise(share / (2 - share)) * F.col("size") - 1e-9) + 1
    meetings = tokens.where(kept).groupBy("kind", "within", "token").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    for t in [*[t for t in STEPS if t > least and meetings > FEW * most], least]:
        near = _near(tokens, forms, t, sequence, shared).join(sizes, "x").join(sizes.select(F.col("x").alias("y"), F.col("n").alias("m")), "y")
        near = written(near, "near")
        x, y, odd = F.concat(F.lit("x"), "x"), F.concat(F.lit("x"), "y"), F.col("score") != F.col("back")
        there = near.select(x.alias("a"), y.alias("b"), "score", F.when(odd, F.col("x")).alias("start"))
        back = near.select(y.alias("a"), x.alias("b"), F.col("back").alias("score"), F.when(odd, F.col("y")).alias("start"))
        both = there.union(back).where(F.col("score") >= t)
        known = near.select(F.least("score", "back").alias("score"), (F.col("n") * F.col("m")).alias("n")).where(F.col("score") >= t)
        out, enough = _first(members, met.union(both), counts.union(known), most)
        if enough:
            return out
    if shared or least > 0:
        return out
    # what has neither a term nor a character in common comes last, by place
    out = written(out, "found")
    whole = placed.select(F.concat(F.lit("w"), "within").alias("block"), "idx")
    every = whole.groupBy(F.col("block").alias("a")).agg(F.count("*").alias("n")).select("a", F.col("a").alias("b"), F.lit(0.0).alias("score"), none, n_pairs).where("n > 0")
    rest, _ = _first(whole, every.drop("n"), every.select("score", "n"), most + out.count())
    return out.union(rest.join(out, ["left", "right"], "left_anti").select("left", "right", "score")).orderBy(F.desc("score"), "left", "right").limit(most)


def lexical_pairs(findings: DataFrame, threshold: float = 0.72, most: int = 500, sequence: bool = True) -> DataFrame:
    """The `most` best candidate pairs by the larger of Jaccard and sequence similarity; equal identities always count.

    Candidates share a term or an identity, however common; `most` limits what is returned alone.
    """
    every = best_pairs(findings.withColumn("within", F.lit("")), threshold, most, sequence)
    same = best_pairs(findings.where("identity IS NOT NULL").withColumn("within", F.col("identity")), 0.0, most, sequence, shared=False)
    return every.union(same).distinct().select("left", "right", "score").orderBy(F.desc("score"), "left", "right").limit(most)


def detect(findings: DataFrame, provider: str = "lexical", threshold: float = 0.72, most: int = 500) -> DataFrame:
    """Candidate pairs by a detector's name."""
    if not 0 <= threshold <= 1 or most <= 0:
        raise ValueError("the threshold must lie between 0 and 1 and the number of pairs be positive")
    name = (provider or "lexical").strip().lower()
    if name == "lexical":
        return lexical_pairs(findings, threshold, most)
    if name not in PROVIDERS:
        raise ValueError(f"no such candidate detector: {provider}")
    return PROVIDERS[name][0](findings, threshold, most)


def verdict(left: str = "left", right: str = "right") -> Column:
    """Whether two findings are one, from claim_text, identity and side with those prefixes; wording alone never merges."""
    claim, identity, side = ([F.col(f"{p}_{c}") for p in (left, right)] for c in ("claim_text", "identity", "side"))
    same_identity = F.coalesce(identity[0] == identity[1], F.lit(False))
    sides = side[0].isNotNull() & side[1].isNotNull()
    return (
        F.when(identity[0].isNotNull() & identity[1].isNotNull() & ~same_identity, "conflicting-identity")
        .when(sides & (side[0] != side[1]) & same_identity, "same-identity-different-assertion")
        .when(sides & (side[0] != side[1]), "conflicting-structured-assertion")
        .when((claim[0] != "") & (claim[0] == claim[1]), "safe-duplicate")
        .when(~same_identity, "insufficient-identity")
        .when(sides, "safe-duplicate")
        .otherwise("same-identity-unverified-assertion")
    )


def verify(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Candidate pairs with their verdict, and whether that authorises a merge."""
    for s in ("left", "right"):
        pairs = pairs.join(findings.select(F.col("idx").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("claim_text", "identity", "side")]), s)
    return pairs.withColumn("verdict", verdict()).withColumn("merge_authorized", F.col("verdict") == "safe-duplicate")


def class_pairs(findings: DataFrame) -> DataFrame:
    """Pairs (left, right) of findings(idx, claim_text, identity, side) that stand for all with an equal claim or identity.

    Each finding is paired with the first of every class that it is in: of equal claim, of equal identity, each of those
    with an equal side, and of equal claim, side and identity; and findings of equal claim and side with the first of them
    that has no identity, which may merge with any. What verify authorises of these joins the same findings as what it
    authorises of all pairs, and a class of n gives n - 1. Texts are keys as hashes of 128 bits, and what is found for a
    class is handed back over SALTS parts of it.
    """
    one = lambda c: F.struct(F.xxhash64(c), F.xxhash64(F.lit(1), c))
    claim, identity, side = (F.when(F.col(c).isNotNull(), one(c)) for c in ("claim_text", "identity", "side"))
    none = F.lit(None).cast("struct<col1: bigint, col2: bigint>")
    rows = findings.select("idx", claim.alias("c"), identity.alias("i"), side.alias("s"))
    key = lambda kind, c, i, s, on: F.when(on, F.struct(F.lit(kind).alias("kind"), c.alias("c"), i.alias("i"), s.alias("s")))
    c, i, s = F.col("c"), F.col("i"), F.col("s")
    classes = F.array(
        key("claim", c, none, none, c.isNotNull()), key("identity", none, i, none, i.isNotNull()), key("claim-side", c, none, s, c.isNotNull()), key("identity-side", none, i, s, i.isNotNull()),
        key("all", c, i, s, c.isNotNull()), key("unidentified", c, none, s, c.isNotNull()),
    )
    placed = rows.select("idx", (c.isNotNull() & i.isNull()).alias("free"), F.explode(F.array_compact(classes)).alias("key"), F.pmod(F.xxhash64("idx"), F.lit(SALTS)).alias("salt"))
    placed = written(placed, "classes")
    centre = F.min(F.when((F.col("key.kind") != "unidentified") | F.col("free"), F.col("idx")))
    parts = written(placed.groupBy("key", "salt").agg(centre.alias("centre"), F.count("*").alias("n")), "parts")
    first = parts.groupBy("key").agg(F.min("centre").alias("centre"), F.sum("n").alias("n")).where("n > 1 AND centre IS NOT NULL").select("key", "centre")
    pairs = placed.join(parts.select("key", "salt").join(first, "key"), ["key", "salt"]).where("idx <> centre")
    return pairs.select(F.least("idx", "centre").alias("left"), F.greatest("idx", "centre").alias("right")).distinct()


def guarded_components(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings(idx, identity, side) with the component that authorised pairs(left, right) put them in.

    Where a component would hold several identities or sides, only pairs that agree in them count: what lacks an
    identity can't bridge two.
    """
    edges = written(pairs.select(F.col("left").alias("a"), F.col("right").alias("b")), "pairs")
    raw = written(components(edges, "raw"), "raw")
    known = findings.select("idx", "identity", "side")
    least = lambda c: [F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high")]
    mixed = raw.join(known, F.col("node") == F.col("idx")).groupBy("component").agg(*least("identity"), *least("side"))
    mixed = mixed.select("component", (F.col("identity_low").eqNullSafe(F.col("identity_high"))).alias("one_identity"), (F.col("side_low").eqNullSafe(F.col("side_high"))).alias("one_side")).where("NOT one_identity OR NOT one_side")
    # the others are whole already
    inside = written(raw.join(mixed, "component").select("node", "one_identity", "one_side"), "mixed")
    some = edges.join(inside.withColumnRenamed("node", "a"), "a")
    for s in ("a", "b"):
        some = some.join(known.select(F.col("idx").alias(s), F.col("identity").alias(f"{s}_identity"), F.col("side").alias(f"{s}_side")), s)
    agree = (F.col("one_identity") | F.col("a_identity").eqNullSafe(F.col("b_identity"))) & (F.col("one_side") | F.col("a_side").eqNullSafe(F.col("b_side")))
    again = components(some.where(agree).select("a", "b"), "guarded")
    final = raw.join(inside, "node", "left_anti").select("node", "component").union(again)
    return findings.join(final, F.col("idx") == F.col("node"), "left").withColumn("component", F.coalesce("component", "idx")).drop("node")


#: Fields that a merged finding takes from members that have them, where its best finding lacks them.
IDENTITY_FIELDS, SIDE_FIELDS = ("subject", "predicate", "period", "unit"), ("polarity", "value", "unit")


def _filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def merge(members: DataFrame, findings: DataFrame, policy: str = "exact-claim") -> DataFrame:
    """One row for each component of `members` (findings.groups with idx, identity, side and component), with the columns
    of a group: its best finding, its occurrences, and who and what supports the component as a whole.

    Workers, sources and evidence that support several members count once: they are counted anew over the findings that
    the groups came from. `best` is the member of the highest confidence, then first by claim and source. It keeps its own
    fields; a canonical key, else subject, predicate, period and unit, comes from the first member with an identity, and
    polarity, value and unit from the first with an asserted side, where it has none; `promoted` lists those. Groups alone
    in their component are as they were. First means in the order of findings: confidence, agreement, claim.
    """
    place = F.struct(-F.col("best.confidence"), -F.col("agreement_count"), F.col("best.claim"), F.col("idx"))
    lead = F.struct(-F.col("best.confidence"), F.col("best.claim"), F.col("best.source"), F.col("idx"))
    fields = F.struct("best.canonical_key", *[F.col(f"best.{c}").alias(c) for c in (*IDENTITY_FIELDS, "polarity", "value")])
    sums = members.groupBy("component").agg(
        F.min_by(F.struct("idx", "group_key", "assertion_key", "best"), lead).alias("lead"), F.count("*").alias("merged_findings"), F.sum("occurrence_count").alias("occurrence_count"),
        *[F.sum(c).alias(c) for c in ("workers", "independent_source_count", "independent_evidence_count")],
        F.min_by(fields, F.when(F.col("identity").isNotNull(), place)).alias("__identity"), F.min_by(fields, F.when(F.col("side").isNotNull(), place)).alias("__side"),
        F.min_by("identity", F.when(F.col("identity").isNotNull(), place)).alias("identity"), F.min_by("side", F.when(F.col("side").isNotNull(), place)).alias("side"),
        F.bool_or(F.col("group_key").startswith("canonical:") & (F.col("assertion_key") == "") & (F.col("claim_variants") > 1)).alias("ambiguous"), F.min("first_seen").alias("first_seen"),
    )
    several = sums.where("merged_findings > 1").select("component")
    of = members.join(several, "component").select("idx", "component")
    # distinct supporters of merged components alone, pairs of hashes, each member's counted once before they meet
    ref = fingerprint(F.col("source"), F.sha2("evidence", 256), F.col("provenance"))
    supporters = findings.select(F.xxhash64("group_key", assertion_key(policy)).alias("idx"), *[code(c).alias(n) for n, c in (("w", F.nullif(F.trim("worker"), F.lit(""))), ("s", F.nullif(F.trim("source"), F.lit(""))), ("r", ref))])
    supporters = supporters.join(of, "idx").groupBy("component", "w", "s", "r").agg(F.lit(1))
    anew = supporters.groupBy("component").agg(F.count_distinct("w").alias("__w"), F.count_distinct("s").alias("__s"), F.count_distinct("r").alias("__r"))
    out = sums.join(anew, "component", "left")
    best = {c: F.col(f"lead.best.{c}") for c in members.schema["best"].dataType.fieldNames()}
    keyed = _filled(F.col("__identity.canonical_key"))
    takes = {"canonical_key": keyed & ~_filled(best["canonical_key"])}
    takes |= {c: F.col("__identity").isNotNull() & ~keyed & ~_filled(best[c]) & _filled(F.col(f"__identity.{c}")) for c in IDENTITY_FIELDS}
    value = {c: F.when(t, F.col(f"__identity.{c}")).otherwise(best[c]) for c, t in takes.items()}
    for c in SIDE_FIELDS:
        has = value.get(c, best[c])
        lacks = ~_filled(has) & _filled(F.col(f"__side.{c}"))
        value[c] = F.when(lacks, F.col(f"__side.{c}")).otherwise(has)
        takes[c] = takes.get(c, F.lit(False)) | lacks
    promoted = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)) & (F.col("merged_findings") > 1), c) for c, t in takes.items()]))
    merged_best = F.struct(*[F.when(F.col("merged_findings") > 1, value.get(c, best[c])).otherwise(best[c]).alias(c) for c in best if c not in ("identity", "side")], F.col("identity").alias("identity"), F.col("side").alias("side"))
    workers = F.coalesce("__w", "workers")
    return out.select(
        "component", F.col("lead.idx").alias("idx"), F.col("lead.group_key").alias("group_key"), F.col("lead.assertion_key").alias("assertion_key"), "merged_findings", "occurrence_count", workers.alias("workers"),
        F.greatest(F.lit(1), workers).cast("long").alias("agreement_count"), F.coalesce("__s", "independent_source_count").alias("independent_source_count"), F.coalesce("__r", "independent_evidence_count").alias("independent_evidence_count"),
        promoted.alias("promoted"), "ambiguous", "identity", "side", merged_best.alias("best"), "first_seen",
    )


def supporters(members: DataFrame, findings: DataFrame, policy: str = "exact-claim") -> DataFrame:
    """Who and what supports each component, a row each: kind (worker, source, group, provenance) and value."""
    own = findings.select(F.xxhash64("group_key", assertion_key(policy)).alias("idx"), "worker", "source", "group_key", "provenance").join(members.select("idx", "component"), "idx")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in (("worker", "worker"), ("source", "source"), ("group", "group_key"), ("provenance", "provenance"))])
    return own.select("component", F.explode(kinds).alias("by")).where("by.value <> ''").select("component", "by.kind", "by.value").distinct()


def blocked(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Authorised pairs (left, right) whose findings stayed apart, by reason and number: components that would hold two
    identities or sides, and findings without one that would bridge such."""
    kinds = members.groupBy("component").agg(F.min("identity").alias("identity"), F.min("side").alias("side"))
    own = members.select("idx", "component").join(kinds, "component")
    for s in ("left", "right"):
        pairs = pairs.join(own.select(F.col("idx").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("component", "identity", "side")]), s)
    apart = pairs.where("left_component <> right_component")
    differ = lambda c: F.col(f"left_{c}") != F.col(f"right_{c}")
    one = F.col("left_identity").isNull() != F.col("right_identity").isNull()
    reason = F.when(differ("identity"), "component-conflicting-identity").when(differ("side"), "component-conflicting-assertion").when(one, "ambiguous-identity-bridge").otherwise("ambiguous-assertion-bridge")
    return apart.groupBy(reason.alias("reason")).agg(F.count("*").alias("pairs"))
