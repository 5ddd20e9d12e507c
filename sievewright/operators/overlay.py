"""Evidence that a session has taken up or turned down, and checkpoints of runs, kept in versioned stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Store
from .state import newest

EVIDENCE = "id string, path string, symbol string, tier string, validity string, fingerprint string, rejection_reason string, rejected_at long, last_recalled_at long, recall_count long"
INVALIDATIONS = "id string, reason string, ts long"
RUNS = "run_id string, status string, task string, adapter string, created_at long, updated_at long, resume_count long, results map<string,string>, config_sha256 string"
#: Tombstones and invalidations that are kept, the newest.
TOMBSTONES = 500


def overlay(spark: SparkSession, path: str, buckets: int = 32) -> tuple[Store, Store]:
    """The stores of a session: evidence by id, invalidations by id and time."""
    return Store(spark, f"{path}/evidence", ["id"], EVIDENCE, buckets), Store(spark, f"{path}/invalidations", ["id", "ts", "reason"], INVALIDATIONS, buckets)


def _whole(rows: DataFrame) -> DataFrame:
    """Rows with all columns of evidence; those that a table lacks are null. Rows without an id are an error."""
    known = {f.split(" ")[0]: f.split(" ")[1] for f in EVIDENCE.split(", ")}
    rows = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in known.items()])
    missing = F.raise_error("context evidence requires id").cast("string")
    return rows.withColumn("id", F.when(F.coalesce("id", F.lit("")) == "", missing).otherwise(F.col("id")))


def put(evidence: Store, rows: DataFrame) -> int:
    """Upsert active or rejected evidence; how often and when it was recalled stays. Another tier is an error."""
    other = F.raise_error("only active or rejected evidence is kept").cast("string")
    rows = _whole(rows).withColumn("tier", F.when(F.coalesce("tier", F.lit("")).isin("active", "rejected"), F.col("tier")).otherwise(other))
    old = F.col("old.id").isNotNull()
    carry = {"last_recalled_at": F.when(old, F.col("old.last_recalled_at")).otherwise(F.col("new.last_recalled_at")), "recall_count": F.when(old, F.coalesce("old.recall_count", F.lit(0))).otherwise(F.col("new.recall_count"))}
    return evidence.upsert(rows, carry)


def promote(evidence: Store, rows: DataFrame, now: Column) -> int:
    """Make evidence whose validity is current active; other rows change nothing. A new row counts as recalled once, now;
    one that is there keeps its count and time, as in any upsert."""
    rows = _whole(rows).where("validity = 'current'").withColumns({"tier": F.lit("active"), "last_recalled_at": now.cast("long"), "recall_count": F.lit(1).cast("long")})
    return put(evidence, rows)


def reject(evidence: Store, rows: DataFrame, reason: str, now: Column, validity: str = "current", keep: int = TOMBSTONES) -> int:
    """Put evidence as rejected, then drop all rejected rows but the newest `keep`."""
    put(evidence, _whole(rows).withColumns({"tier": F.lit("rejected"), "validity": F.lit(validity), "rejection_reason": F.lit(reason), "rejected_at": now.cast("long")}))
    rejected = evidence.read().where("tier = 'rejected'")
    kept = newest(rejected.withColumn("__all", F.lit(1)), ["__all"], [F.desc(F.coalesce("rejected_at", F.lit(0))), "id"], keep)
    return evidence.delete(rejected.join(kept, "id", "left_anti"), F.col("tier") == "rejected")


def retire(evidence: Store, invalidations: Store, ids: DataFrame, reason: str, now: Column) -> int:
    """Remove active evidence (id) and record why; ids that aren't active change nothing."""
    known = ids.select("id").distinct().join(evidence.read().where("tier = 'active'").select("id"), "id")
    invalidations.upsert(known.select("id", F.lit(reason).alias("reason"), now.cast("long").alias("ts")))
    return evidence.delete(ids, F.col("tier") == "active")


def runs(spark: SparkSession, path: str, buckets: int = 8) -> Store:
    """Checkpoints of runs, one a run; older ones are in older versions."""
    return Store(spark, path, ["run_id"], RUNS, buckets)


def save(checkpoints: Store, rows: DataFrame, now: Column) -> int:
    """Put checkpoints of runs. A run that is there keeps when it was created; a run id of other than letters, digits, -, _
    and . is an error."""
    bad = F.raise_error("invalid run id").cast("string")
    known = {f.name: f.dataType for f in checkpoints.schema}
    rows = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in known.items()])
    rows = rows.withColumns({"run_id": F.when(F.trim("run_id").rlike(r"^[A-Za-z0-9_.-]+$"), F.trim("run_id")).otherwise(bad), "updated_at": now.cast("long"), "created_at": F.coalesce("created_at", now.cast("long"))})
    return checkpoints.upsert(rows, {"created_at": F.coalesce("old.created_at", "new.created_at")}, newest=F.col("resume_count"))


def resume(checkpoints: Store, run_ids: DataFrame, now: Column) -> DataFrame:
    """Runs taken up again: saved with one resumption more, and given back with the nodes that are still to do. A run
    that isn't there is an error."""
    names = checkpoints.schema.fieldNames()
    rows = run_ids.select("run_id", *[F.lit(None).alias(n) for n in names if n not in ("run_id", "updated_at")], now.cast("long").alias("updated_at"))
    lost = F.raise_error(F.concat(F.lit("no checkpoint of run "), F.col("new.run_id"))).cast("long")
    count = F.when(F.col("old.created_at").isNull(), lost).otherwise(F.coalesce("old.resume_count", F.lit(0)) + 1)
    # what is there stays, but for these
    carry = {n: F.col(f"old.{n}") for n in names if n not in ("run_id", "updated_at")} | {"resume_count": count, "status": F.lit("running")}
    checkpoints.upsert(rows, carry)
    to_do = F.array_sort(F.map_keys(F.map_filter("results", lambda _, status: F.coalesce(status, F.lit("")) != "success")))
    return run_ids.select("run_id").distinct().join(checkpoints.read(), "run_id").select("run_id", "resume_count", to_do.alias("unfinished"))
