"""Packets for synthesis: contradictions first, findings that fit, sources by short names; problem lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens, query_terms
from ..tables import written

# Dimensions of a workflow and the terms that show them.
DIMENSIONS = (
    ("entry-and-state", ("entry", "route", "path", "app", "state", "session", "login", "home", "trip")),
    ("action-and-persistence", ("create", "save", "update", "delete", "persist", "sync", "storage", "repository", "database")),
    ("auth-and-authorization", ("auth", "login", "guest", "token", "role", "permission", "public", "private", "share", "join")),
    ("error-and-retry", ("error", "catch", "retry", "fallback", "loading", "empty", "status", "timeout")),
    ("cross-layer-contract", ("fetch", "api", "route", "request", "response", "endpoint", "json", "server", "client")),
    ("device-and-delivery", ("mobile", "desktop", "responsive", "viewport", "safe-area", "print", "export", "offline", "device")),
    ("realtime-and-return", ("socket", "room", "realtime", "redirect", "return", "share", "join", "trip")),
)


def finding_order() -> list[Column]:
    """Order of findings in a packet: sure, agreed on, well evidenced ones first."""
    return [F.desc("confidence"), F.desc("agreement_count"), F.desc("independent_evidence_count"), F.desc("independent_source_count"), F.asc("claim")]


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place (column `name`, from 1) in an order, by ranges rather than in one task.

    A range sort gives each partition a run of places; the runs' lengths, one number a partition, are added up.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = written(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    here = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return runs.join(starts, "__part").withColumn(name, F.col("__start") + here).drop("__part", "__start")


def ordered(findings: DataFrame) -> DataFrame:
    """Findings with their place in a packet (packet_rank, from 1)."""
    return numbered(findings, finding_order(), "packet_rank")


def source_refs(rows: DataFrame, order: str, source: str) -> DataFrame:
    """Each distinct source with its name S1, S2 and so on, in the order in which it is first cited."""
    first = rows.groupBy(source).agg(F.min(order).alias("first_cited"))
    return numbered(first, [F.asc("first_cited"), F.asc(source)], "__n").withColumn("ref", F.concat(F.lit("S"), F.col("__n").cast("string"))).drop("__n")


def without_contradicted(findings: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Findings whose identity no contradiction carries: those go with it."""
    return findings.join(contradictions.select("identity"), "identity", "left_anti")


def pack(findings: DataFrame, limit: int, base_bytes: int = 0, chunk: int = 4096) -> DataFrame:
    """The findings of one packet that fit in `limit` tokens, passing over those that don't, in the packet's order.

    findings(packet_rank, text). Whether one fits depends on those before it, but of these no more than the limit's bytes
    can be taken. So sizes alone are read, `chunk` at a time in order, and of those that still fit in what is left: each
    chunk's first is taken, and there are no more chunks than findings taken.
    """
    spark = findings.sparkSession
    sizes = written(findings.select("packet_rank", (F.octet_length("text") + 1).alias("size")), "sizes")
    room, last, taken = 4 * limit - base_bytes, None, []
    while room > 0:
        rows = sizes.where(F.col("size") <= room) if last is None else sizes.where((F.col("size") <= room) & (F.col("packet_rank") > last))
        some = rows.orderBy("packet_rank").limit(chunk).collect()
        for r in some:
            if r.size <= room:
                room -= r.size
                taken.append(r.packet_rank)
        if len(some) < chunk:
            break
        last = some[-1].packet_rank
    return findings.select("packet_rank", "text").join(spark.createDataFrame([(x,) for x in taken], "packet_rank long"), "packet_rank", "left_semi")


def dimensions(task: Column) -> Column:
    """Workflow dimensions whose terms a task has; all for a workflow as such, the contract one if none."""
    text = F.lower(F.coalesce(task, F.lit("")))
    some = F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)), name) for name, terms in DIMENSIONS]))
    return F.when(F.contains(text, F.lit("workflow")), F.array(*[F.lit(n) for n, _ in DIMENSIONS])).when(F.size(some) > 0, some).otherwise(F.array(F.lit("cross-layer-contract")))


def problems(tasks: DataFrame, key: str = "task_id", text: str = "task") -> DataFrame:
    """Problems that tasks list: their list items, else their parts between semicolons and line ends; each once.

    What stands before the first item joins the query of each. Repeats are told by lower case.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), F.trim), lambda x: x != "")
    item = r"^(?:[-*+•]|\d+[.)、]|[（(]\d+[)）]|[一二三四五六七八九十]+[、.])\s*(.+)$"
    items = F.filter(lines, lambda x: x.rlike(item))
    listed = F.transform(items, lambda x: F.regexp_extract(x, item, 1))
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[;；\n]+"), F.trim), lambda x: x != "")
    tidy = lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[ ;；]+|[ ;；]+$", "")
    chosen = F.transform(F.when(F.size(listed) > 0, listed).otherwise(parts), tidy)
    head = F.when(F.size(listed) > 0, F.array_join(F.slice(lines, F.lit(1), F.greatest(F.lit(0), F.array_position(F.transform(lines, lambda x: x.rlike(item)), F.lit(True)).cast("int") - 1)), " ")).otherwise("")
    rows = tasks.select(key, head.alias("preamble"), F.posexplode(chosen).alias("place", "problem")).where("problem <> ''")
    first = rows.groupBy(key, F.lower("problem").alias("__same")).agg(F.min(F.struct("place", "problem", "preamble")).alias("p")).select(key, "p.*")
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    query = F.trim(F.concat_ws(" ", F.regexp_replace("preamble", "[：:]+$", ""), "problem"))
    return first.withColumn("ordinal", ordinal).select(key, "ordinal", F.concat(F.lit("problem-"), F.lpad(F.col("ordinal").cast("string"), 3, "0")).alias("problem_id"), "problem", query.alias("query"), query_terms(F.col("problem")).alias("terms"))


def sufficiency(selected: Column, covered: Column, open_problems: Column) -> Column:
    """Reasons why a pack of context isn't enough; none is good."""
    return F.array_compact(F.array(F.when(selected == 0, "no-context-selected"), F.when(covered < 0.34, "low-coverage"), F.when(open_problems > 0, "incomplete-problems")))


def admission(indexed: Column, relevance: Column, lines: Column) -> Column:
    """How a file may be read: not at all, by its structure, by symbol, or whole."""
    return F.when(~indexed, "deny").when(relevance <= 0, "prefer-structure").when(lines > 400, "prefer-symbol").otherwise("allow")


def tokens(text: Column) -> Column:
    return estimated_tokens(text)


def project_problems(problems: DataFrame, most: int = 4) -> DataFrame:
    """Problems or dimensions (id, text, ordinal, status, purpose, evidence_refs, candidate_paths: arrays) in short: the
    first `most` references and paths, with how many there are; null where there are none. All rows stay."""
    have = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    cut = lambda c: F.when(have(c), F.slice(F.col(c), 1, most))
    size = lambda c: F.when(have(c), F.size(c).cast("long"))
    plain = [c for c in ("id", "text", "ordinal", "status", "purpose") if c in problems.columns]
    return problems.select(*plain, cut("evidence_refs").alias("evidence_refs"), size("evidence_refs").alias("evidence_ref_count"), cut("candidate_paths").alias("candidate_paths"), size("candidate_paths").alias("candidate_path_count"))
