"""Append-only event logs and artifacts as tables of JSON lines or Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens

TRACE = "ts double, run_id string, kind string, data string"


def read_trace(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Events of a log of JSON lines; lines that aren't JSON are left out. `data` stays JSON text."""
    rows = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'")
    out = rows.select(*[F.expr(f"try_variant_get(v, '$.{c}', '{t}')").alias(c) for c, t in (("ts", "double"), ("run_id", "string"), ("kind", "string"))], F.expr("to_json(try_variant_get(v, '$.data', 'variant'))").alias("data"))
    return out if run_id is None else out.where(F.col("run_id") == run_id)


def append_trace(events: DataFrame, path: str, now: Column) -> None:
    """Append events(run_id, kind, data) to a log of JSON lines, with their time in seconds."""
    events.select(now.cast("double").alias("ts"), "run_id", "kind", "data").write.mode("append").json(path)


def trace_stream(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream."""
    return spark.readStream.schema(TRACE).json(path)


def artifacts(payloads: DataFrame, kind: str, producer: str, now: Column) -> DataFrame:
    """payloads(payload: JSON text) as artifacts: content-addressed, with sizes and about their tokens."""
    digest = F.sha2("payload", 256)
    return payloads.select(F.concat(F.lit(f"{kind}-"), F.left(digest, F.lit(16))).alias("id"), F.lit(kind).alias("kind"), F.lit(producer).alias("producer"), now.alias("created_at"), digest.alias("sha256"), F.octet_length("payload").cast("long").alias("bytes"), estimated_tokens(F.col("payload")).alias("estimated_tokens"), "payload")


def latest(rows: DataFrame, when: str, limit: int) -> DataFrame:
    """The newest rows (a report)."""
    return rows.orderBy(F.desc(when)).limit(limit)
