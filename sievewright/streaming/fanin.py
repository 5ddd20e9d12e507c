"""Fan-in of a stream of findings: supporters in keyed state, totals of groups in a versioned store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructType

from ..functions.text import fingerprint
from ..operators.findings import assertion_key, code, normalize
from ..store import Store
from ..tables import drop_path, new_path

#: What a group has seen: findings, distinct workers, sources and evidence references, and its best finding.
TOTALS = "occurrences long, workers long, sources long, refs long, less double, worker string, source string, place string, ordinal string"
KEY = "group_key string, assertion_key string"
COUNTED = {"workers": "w", "sources": "s", "refs": "r"}
RocksDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _place(ordinal: Column, kind: DataType) -> Column:
    """Text that sorts as the ordinal does: a whole number from 0, a text, or a structure of those."""
    if isinstance(kind, StructType):
        return F.concat_ws("\x01", *[_place(F.coalesce(ordinal[f.name], F.lit("")) if isinstance(f.dataType, StringType) else ordinal[f.name], f.dataType) for f in kind])
    return ordinal if isinstance(kind, StringType) else F.lpad(ordinal.cast("string"), 20, "0")


def supported(findings: DataFrame, policy: str = "exact-claim") -> DataFrame:
    """Normalised findings with what a fan-in needs of them: the keys of their group, their rank, who and what supports it."""
    kind = findings.schema["ordinal"].dataType
    rows = findings.withColumns({"assertion_key": assertion_key(policy), "ref": fingerprint(F.col("source"), F.sha2("evidence", 256), F.col("provenance"))})
    rows = rows.where("group_key IS NOT NULL").withColumns({"place": _place(F.col("ordinal"), kind), "ordinal": F.to_json(F.struct("ordinal")), "less": -F.col("confidence"), "g": code("group_key", "assertion_key")})
    return rows.select("g", "group_key", "assertion_key", "less", "worker", "source", "place", "ordinal", "ref")


def supporters(rows: DataFrame) -> DataFrame:
    """Who and what supports a group, once in a stream: hashes of 128 bits of the group and of its worker, source or
    evidence reference. Each is a key of the state of its own, so neither does a group's state grow nor is it one task's."""
    by = F.array(*[F.struct(F.lit(k).alias("kind"), code(c).alias("who")) for k, c in (("w", "worker"), ("s", "source"), ("r", "ref"))])
    return rows.select("g", F.explode(by).alias("by")).select("g", "by.kind", "by.who").where("who IS NOT NULL").dropDuplicates()


def _rank(prefix: str = "") -> Column:
    c = lambda n: F.col(f"{prefix}{n}")
    return F.struct(c("less"), F.coalesce(c("worker"), F.lit("")).alias("worker"), F.coalesce(c("source"), F.lit("")).alias("source"), c("place"))


def totals(spark: SparkSession, path: str) -> Store:
    """The store of a stream's totals, a row for each group."""
    return Store(spark, path, ["group_key", "assertion_key"], f"{KEY}, {TOTALS}")


def groups(kept: DataFrame, ordinal: DataType = LongType()) -> DataFrame:
    """Groups from their totals: occurrences, distinct supporters, the ordinal of the best finding."""
    best = F.from_json("ordinal", StructType().add("ordinal", ordinal))["ordinal"]
    return kept.select(
        "group_key", "assertion_key", F.col("occurrences").alias("occurrence_count"), "workers", F.col("sources").alias("independent_source_count"), F.col("refs").alias("independent_evidence_count"), best.alias("best"),
    )


def start(stream: DataFrame, path: str, policy: str = "exact-claim", **trigger):
    """Start the fan-in of a stream of normalised findings into the store under `path`, whose checkpoint lies beside it.

    A micro-batch is its findings and, out of the state, those supporters of theirs that the stream hadn't had before. It
    reads no more than its own rows and the state of those, and adds to the totals of the groups that they touch, as one
    version of the store. Started again under the same path it goes on where it stopped; a batch that is run again
    after a failure changes nothing twice.
    """
    spark = stream.sparkSession
    store = totals(spark, f"{path}/totals")
    rows = supported(stream, policy)
    both = rows.drop("ref").unionByName(supporters(rows), allowMissingColumns=True)
    best = ("group_key", "assertion_key", "less", "worker", "source", "place", "ordinal")
    sums = {c: F.col(f"new.{c}") + F.coalesce(F.col(f"old.{c}"), F.lit(0)) for c in ("occurrences", *COUNTED)}
    keep = F.coalesce(_rank("old.") <= _rank("new."), F.lit(False)) & F.col("old.less").isNotNull()
    carry = sums | {c: F.when(keep, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")) for c in best[2:]}

    def put(df: DataFrame, batch: int) -> None:
        at = new_path(spark, "batch")
        new = df.groupBy("g").agg(
            F.count_if(F.col("kind").isNull()).alias("occurrences"), *[F.count_if(F.col("kind") == k).alias(c) for c, k in COUNTED.items()],
            F.min_by(F.struct(*best), F.when(F.col("kind").isNull(), _rank())).alias("best"),
        )
        new = new.select("best.*", "occurrences", *COUNTED)
        try:
            new.write.parquet(at)  # the state is updated once, what is put may be read again
            added = spark.read.schema(new.schema).parquet(at)
            if not added.isEmpty():
                store.upsert(added, carry, batch=("fan-in", batch))
        finally:
            drop_path(spark, at)

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, RocksDB)
    try:
        return both.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).foreachBatch(put).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def run(stream: DataFrame, name: str, policy: str = "exact-claim", path: str | None = None) -> DataFrame:
    """Run the fan-in of a stream over all that is there, and read the groups from the shared folder."""
    spark = stream.sparkSession
    path = path or new_path(spark, name)
    start(stream, path, policy).awaitTermination()
    return groups(totals(spark, f"{path}/totals").read(), stream.schema["ordinal"].dataType)


def over_table(spark: SparkSession, path: str) -> DataFrame:
    """The fan-in over a table of conversations that is read as a stream of files."""
    schema = spark.read.parquet(path).schema
    # a stream's source is a folder or a pattern of files
    stream = spark.readStream.schema(schema).parquet(f"{path}*")
    raw = stream.select(F.col("role").alias("worker"), F.col("text").alias("claim"), F.col("role").alias("evidence"), F.col("conv_id").cast("string").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.lit(0.5).alias("confidence"))
    out = run(normalize(raw), "conversations")
    return out.select(F.sha2("group_key", 256).alias("group_sha256"), "occurrence_count", "workers", "independent_source_count", "best")
