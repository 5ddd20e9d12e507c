"""External blocks of content: canonical form, exact deduplication with merged support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens, fingerprint, trust


def canonical(raw: DataFrame, provider: str) -> DataFrame:
    """Provider rows (path|file, symbol|name, content|text|summary, score) as blocks."""
    have = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in raw.columns], F.lit(None).cast("string"))
    path = F.nullif(F.replace(have("path", "file"), F.lit("\\"), F.lit("/")), F.lit(""))
    content = F.nullif(have("content", "text", "summary"), F.lit(""))
    out = raw.select(F.lit(provider).alias("provider"), path.alias("path"), F.nullif(have("symbol", "name"), F.lit("")).alias("symbol"), content.alias("content"), (F.col("score").try_cast("double") if "score" in raw.columns else F.lit(None).cast("double")).alias("provider_score"))
    return out.withColumns({"fingerprint": F.when(F.col("content").isNotNull(), F.sha2("content", 256)), "estimated_tokens": estimated_tokens(F.col("content")), "trust": trust(F.col("content"))})


def unwrapped(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The items of providers' JSON (payloads): a list's, or those under results, symbols or files, else the object
    itself; one row each with path, file, symbol, name, content, text, summary, score and its place (ordinal within the
    payload). Other columns are kept. What isn't an object or a list raises an error; items that aren't objects go."""
    value = F.try_parse_json(payload)
    kind = F.schema_of_variant("__value")
    items = lambda path: F.try_variant_get("__value", path, "array<variant>")
    wrong = F.raise_error(F.lit("a provider's payload must be a JSON object or list")).cast("array<variant>")
    listed = F.when(kind.startswith("ARRAY"), items("$")).when(kind.startswith("OBJECT"), F.coalesce(items("$.results"), items("$.symbols"), items("$.files"), F.array("__value"))).otherwise(wrong)
    rows = payloads.withColumn("__value", value).select(*[c for c in payloads.columns if c != payload], F.posexplode(listed).alias("ordinal", "__item")).where(F.schema_of_variant("__item").startswith("OBJECT"))
    fields = [F.try_variant_get("__item", f"$.{c}", "double" if c == "score" else "string").alias(c) for c in ("path", "file", "symbol", "name", "content", "text", "summary", "score")]
    return rows.select(*[c for c in rows.columns if c != "__item"], *fields)


def keyed(blocks: DataFrame) -> DataFrame:
    """Blocks(provider, path, symbol, fingerprint, provider_score) with the key of those that are one, and their location."""
    place = F.concat_ws("#", F.coalesce("path", F.lit("")), F.coalesce("symbol", F.lit("")))
    has, placed = F.coalesce(F.col("fingerprint"), F.lit("")) != "", place != "#"
    key = (
        F.when(has & placed, F.concat_ws("|", F.lit("content+identity"), "fingerprint", place))
        .when(has, F.concat_ws("|", F.lit("content"), "fingerprint"))
        .when(placed, F.concat_ws("|", F.lit("identity"), place))
        .otherwise(F.concat_ws("|", F.lit("object"), fingerprint(F.col("provider"), F.col("provider_score"))))
    )
    location = F.when(placed, F.regexp_replace(place, "#$", ""))
    return blocks.withColumns({"block_key": key, "location": location})


def deduplicate(blocks: DataFrame) -> DataFrame:
    """Blocks(ordinal, provider, path, symbol, fingerprint, provider_score) merged where content and place are equal, or
    content where no place is given, or place where no content is. Each keeps the first of its blocks with all its
    columns, its best score, its providers, and how many support it; see support for who does from where."""
    rows = keyed(blocks)
    first = F.min_by(F.struct(*[c for c in blocks.columns if c != "provider_score"]), "ordinal")
    out = rows.groupBy("block_key").agg(
        first.alias("block"), F.min("ordinal").alias("first_seen"), F.count("*").alias("occurrence_count"), F.count_distinct("provider").alias("provider_count"), F.count_distinct("location").alias("location_count"),
        F.array_sort(F.collect_set("provider")).alias("providers"), F.max("provider_score").alias("provider_score"),
    )
    return out


def support(blocks: DataFrame) -> DataFrame:
    """One row for each distinct supporter of a merged block: its provider and location. Rows, since a block may stand in
    any number of places."""
    return keyed(blocks).select("block_key", "provider", "location").distinct()
