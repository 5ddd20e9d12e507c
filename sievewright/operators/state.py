"""Session state as tables: ledger comparison, invalidation, reconciliation, lifecycle tiers."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified diff of two texts by lines."""
    return pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="")) for a, b in zip(old, new)])


def compare(items: DataFrame, ledger: DataFrame, key: str = "key") -> DataFrame:
    """items(key, fingerprint) against what the ledger last saw of them: new, unchanged or changed."""
    seen = ledger.select(key, F.col("fingerprint").alias("seen_fingerprint"))
    status = F.when(F.col("seen_fingerprint").isNull(), "new").when(F.col("seen_fingerprint") == F.col("fingerprint"), "unchanged").otherwise("changed")
    return items.join(seen, key, "left").withColumn("status", status)


def upsert(ledger: DataFrame, items: DataFrame, key: str = "key") -> DataFrame:
    """The ledger with items in place of what it had of them."""
    return ledger.join(items.select(key), key, "left_anti").unionByName(items.select(*ledger.columns))


def stale(active: DataFrame, current: DataFrame) -> DataFrame:
    """active(id, path, revision) by what became of it: missing if its path is gone, stale if its revision changed."""
    now = current.select("path", F.col("revision").alias("current_revision"), F.lit(True).alias("exists"))
    differs = (F.coalesce(F.col("revision"), F.lit("")) != "") & F.col("current_revision").isNotNull() & (F.col("revision") != F.col("current_revision"))
    verdict = F.when(F.col("exists").isNull(), "missing").when(differs, "stale").otherwise("current")
    return active.join(now, "path", "left").withColumn("validity", verdict).drop("exists")


def reconcile(overlay: DataFrame, locators: DataFrame) -> DataFrame:
    """overlay(id, tier, reason) against the locators(id) of the index: what returns, what retires, what stays.

    Rejections for want of a path end when the locator is back; active items whose locator is gone are retired.
    """
    known = locators.select("id").distinct().withColumn("__known", F.lit(True))
    back = (F.col("tier") == "rejected") & F.col("__known").isNotNull() & F.col("reason").isin("repository-path-missing", "not-present-in-current-index")
    gone = (F.col("tier") == "active") & F.col("__known").isNull()
    return overlay.join(known, "id", "left").withColumn("outcome", F.when(back, "resurrected").when(gone, "retired").otherwise("kept")).drop("__known")


def tiers(items: DataFrame, now: Column, hot: int = 900, warm: int = 7200) -> DataFrame:
    """items(last_accessed, in seconds) as hot, warm or cold by age."""
    age = now - F.col("last_accessed")
    return items.withColumn("tier", F.when(age <= hot, "hot").when(age <= warm, "warm").otherwise("cold"))


def newest(rows: DataFrame, by: list[str], order: list, keep: int) -> DataFrame:
    """The newest `keep` rows of each group: how tombstones and invalidations are bounded."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= keep).drop("__n")


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that were added or removed between two listings."""
    a, b = before.select("path").distinct(), after.select("path").distinct()
    return b.join(a, "path", "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, "path", "left_anti").withColumn("change", F.lit("removed")))


# What a state folder holds that can be made again, and what can't.
REGENERABLE = ("index.json", "cache", "sessions", "runs", "budgets", "lifecycle", "provider-health.json", "knowledge.json", "telemetry", "runtime-runs", "context-stores")
PRESERVED = ("config.json", "providers.json", "providers.d", "artifacts")


def overlay_items(overlay: DataFrame, tier: str | None = None, current_only: bool = False) -> DataFrame:
    """Items(path, symbol, id, tier, validity) of an overlay, of a tier and current ones where asked for, in the order of
    path, symbol and id."""
    rows = overlay if tier is None else overlay.where(F.col("tier") == tier)
    rows = rows.where("validity = 'current'") if current_only else rows
    return rows.orderBy(*[F.coalesce(c, F.lit("")) for c in ("path", "symbol", "id")])


def overlay_counts(overlay: DataFrame, locators: DataFrame, invalidations: DataFrame) -> DataFrame:
    """One row: active and rejected items, what could be recalled of the locators(id) besides, and invalidations."""
    known = locators.select("id").distinct().withColumn("__known", F.lit(1))
    rows = overlay.select("id", "tier").join(known, "id", "left")
    counts = rows.agg(F.count_if(F.col("tier") == "active").alias("active"), F.count_if(F.col("tier") == "rejected").alias("rejected"), F.count_if((F.col("tier") == "rejected") & F.col("__known").isNotNull()).alias("there"))
    total, gone = locators.agg(F.count("*").alias("total")), invalidations.agg(F.count("*").alias("invalidations"))
    out = counts.crossJoin(total).crossJoin(gone)  # one row each
    return out.select("active", "rejected", F.greatest(F.lit(0), F.col("total") - F.col("active") - F.col("there")).alias("recallable"), "invalidations")


def inventory(files: DataFrame) -> DataFrame:
    """files(path, bytes) of a state folder by their entry in it: number, bytes, and whether they can be made again."""
    entry = F.substring_index("path", "/", 1)
    kind = F.when(entry.isin(*REGENERABLE), "regenerable").when(entry.isin(*PRESERVED), "preserved").otherwise("unrecognized")
    return files.groupBy(entry.alias("entry"), kind.alias("class")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def inventory_bytes(files: DataFrame) -> DataFrame:
    """Bytes of a state folder that can be made again, that can't, and of what isn't known."""
    return inventory(files).groupBy("class").agg(F.sum("bytes").alias("bytes"))


def run_summary(results: DataFrame) -> DataFrame:
    """results(run_id, node, status) by run: which nodes are done, and the status of each."""
    done = F.array_sort(F.collect_list(F.when(F.col("status") == "success", F.col("node"))))
    return results.groupBy("run_id").agg(done.alias("completed_nodes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "status")))).alias("node_statuses"))
