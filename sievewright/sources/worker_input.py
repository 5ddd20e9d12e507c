"""Worker outputs from JSON and NDJSON, batch and stream, as raw findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import worker_source

#: Fields of a finding that are read from JSON as text; `value` keeps its JSON type's name beside it.
FIELDS = ("claim", "summary", "fact", "evidence", "detail", "support", "source", "path", "file", "url", "confidence", "subject", "predicate", "period", "unit", "polarity")
WORKER = ("worker_id", "worker", "producer", "agent", "from", "role")


def input_format(path: str, given: str = "auto") -> str:
    """json or ndjson: as given, else by the path's suffix; standard input (-) is NDJSON."""
    if given != "auto":
        return given
    return "ndjson" if path == "-" or path.lower().endswith((".ndjson", ".jsonl")) else "json"


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines as (input, ordinal, raw variant); a bad one is an error that names its number."""
    at = F.concat(F.lit("invalid NDJSON at line "), F.col("line").cast("string"), F.coalesce(F.concat(F.lit(" of "), "input"), F.lit("")), F.lit(", not JSON: "), F.left("value", F.lit(200)))
    return lines.select("input", "ordinal", F.coalesce(F.try_parse_json("value"), F.raise_error(at).cast("variant")).alias("raw"))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One worker output a line of a file, or of the files of a folder; blank and # lines are passed over. Outputs are
    numbered within their file."""
    worker_source.register(spark)
    return _parsed(spark.read.format("worker_ndjson").load(path))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Worker outputs of a whole JSON text: an array's items, those under worker_outputs, or the object itself."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = F.expr("try_variant_get(v, '$.worker_outputs', 'array<variant>')")
    top = F.expr("try_variant_get(v, '$', 'array<variant>')")
    chosen = F.when(top.isNotNull(), top).when(items.isNotNull(), items).otherwise(F.array("v"))
    return whole.select(F.posexplode(chosen).alias("ordinal", "raw")).select(F.col("ordinal").cast("long"), "raw")


def read(spark: SparkSession, path: str, given: str = "auto") -> DataFrame:
    return read_ndjson(spark, path) if input_format(path, given) == "ndjson" else read_json(spark, path)


def stream_ndjson(spark: SparkSession, folder: str) -> DataFrame:
    """Worker outputs as a stream of the files that come into a folder: the same rows, numbers and errors as a batch."""
    worker_source.register(spark)
    return _parsed(spark.readStream.format("worker_ndjson").load(folder))


def _text(of: str, field: str) -> Column:
    return F.expr(f"try_variant_get({of}, '$.{field}', 'string')")


def raw_findings(outputs: DataFrame) -> DataFrame:
    """The findings of worker outputs (ordinal, raw), one a row, with their worker and place.

    They stand under findings, evidence or facts of the handoff, else of the output; an output that is a finding itself
    is one; text is a claim that is its own evidence. An output without any gives a row with no claim. Workers without a
    name are worker-<number of the output>, behind the file's name where several files are read.
    """
    lists = [F.expr(f"try_variant_get(raw, '$.{p}{k}', 'array<variant>')") for p in ("handoff.", "") for k in ("findings", "evidence", "facts")]
    alone = F.when(F.coalesce(*[_text("raw", k) for k in ("claim", "evidence", "source")]).isNotNull() | F.expr("try_variant_get(raw, '$', 'string')").isNotNull(), F.array("raw"))
    outputs = outputs if "input" in outputs.columns else outputs.withColumn("input", F.lit(None).cast("string"))
    number = F.concat(F.coalesce(F.concat("input", F.lit(":")), F.lit("")), F.lit("worker-"), (F.col("ordinal") + 1).cast("string"))
    name = F.coalesce(*[F.nullif(F.trim(_text("raw", k)), F.lit("")) for k in WORKER], F.nullif(F.trim(_text("raw", "provenance.worker")), F.lit("")), F.nullif(F.trim(_text("raw", "provenance.producer")), F.lit("")), number)
    rows = outputs.select("input", "ordinal", name.alias("worker"), F.posexplode_outer(F.coalesce(*lists, alone)).alias("item", "f"))
    plain = F.expr("CASE WHEN schema_of_variant(f) = 'STRING' THEN try_variant_get(f, '$', 'string') END")
    out = rows.select("input", F.col("ordinal").alias("worker_index"), "worker", F.col("item").alias("item_index"), plain.alias("__text"), *[_text("f", k).alias(k) for k in FIELDS], F.coalesce(_text("f", "canonicalKey"), _text("f", "canonical_key")).alias("canonical_key"), F.expr("to_json(try_variant_get(f, '$.provenance', 'variant'))").alias("provenance"), _text("f", "value").alias("value"), F.expr("schema_of_variant(try_variant_get(f, '$.value', 'variant'))").alias("value_kind"))
    filled = {k: F.coalesce(k, "__text") for k in ("claim", "evidence")}
    out = out.withColumns(filled).withColumn("source", F.coalesce("source", F.when(F.col("__text").isNotNull(), F.concat(F.lit("worker:"), F.col("worker")))))
    return out.withColumn("ordinal", F.struct("input", "worker_index", F.coalesce("item_index", F.lit(0)).alias("item_index"))).drop("__text", "input")
