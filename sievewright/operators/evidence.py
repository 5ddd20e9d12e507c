"""Evidence at places of a repository: comparison, relevance, dominance, slices; JSON without repeats; token counters."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from ..functions.text import estimated_tokens
from .budget import skip

# What in manifests hints at a framework.
FRAMEWORKS = {
    "React": ('"react"', "react-dom"), "Next.js": ('"next"',), "Vue": ('"vue"',), "Svelte": ('"svelte"',), "Express": ('"express"',), "NestJS": ("@nestjs/",), "Tauri": ("@tauri-apps", "tauri ="), "Django": ("django",),
    "FastAPI": ("fastapi",), "Flask": ("flask",), ".NET": ("microsoft.net.sdk", "<targetframework>"), "ASP.NET Core": ("microsoft.net.sdk.web", "aspnetcore"), "Spring": ("spring-boot", "org.springframework"),
    "Rails": ("rails",), "Laravel": ("laravel/framework",),
}
#: Layers of a context pack in the order in which a slice takes them.
LAYERS = ("external", "symbol", "file")

_counters: dict[str, Callable[[list[str]], list[int]]] = {}
_tokenizers: dict = {}
#: Characters that a tokenizer is given at once.
BATCH_CHARS = 1 << 20


def relevance(score: Column) -> Column:
    """A rank score as a share that nears 1."""
    return F.round(1.0 - F.exp(-F.greatest(F.lit(0.0), score) / 24.0), 5)


def entry_name(signature: Column) -> Column:
    """The name that a line of structure declares: the last word before its parenthesis, in lower case."""
    head = F.trim(F.substring_index(F.coalesce(signature, F.lit("")), "(", 1))
    return F.lower(F.regexp_replace(F.element_at(F.split(head, r"\s+"), -1), "^:+|:+$", ""))


def frameworks(manifests: DataFrame) -> DataFrame:
    """Frameworks that manifests(content) hint at, in a fixed order: one conditional maximum each, in one scan."""
    text = F.lower(F.coalesce("content", F.lit("")))
    hits = []
    for name, needles in FRAMEWORKS.items():
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(text, F.lit(n))
        hits.append(F.when(F.bool_or(hit), name))
    return manifests.agg(F.array_compact(F.array(*hits)).alias("frameworks"))


def verdict(left: str = "left", right: str = "right") -> Column:
    """How two pieces of evidence compare, by id, revision, side and content_sha256 under those prefixes; only equal
    content at one place and revision is the same."""
    of = lambda c: (F.col(f"{left}_{c}"), F.col(f"{right}_{c}"))
    differ = lambda c: F.coalesce(of(c)[0] != of(c)[1], F.lit(False))
    both = lambda c: of(c)[0].isNotNull() & of(c)[1].isNotNull()
    return (
        F.when(differ("id"), "proven-different").when(differ("revision"), "revision-conflict").when(differ("side"), "conflict").when(both("content_sha256") & ~differ("content_sha256"), "proven-same")
        .when(differ("content_sha256"), "content-conflict").when(both("side"), "compatible").otherwise("unknown")
    )


def without_dominated(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """files(path, names) without the names that are selected as symbols(path, name) of the same file."""
    taken = symbols.groupBy("path").agg(F.collect_set(F.lower("name")).alias("__taken"))
    keep = F.filter("names", lambda n: ~F.array_contains(F.coalesce("__taken", F.array().cast("array<string>")), entry_name(n)))
    return files.join(taken, "path", "left").withColumn("names", keep).drop("__taken")


def cited(items: DataFrame, citations: DataFrame) -> DataFrame:
    """Items(path) that citations(path) name."""
    return items.join(citations.select("path").distinct(), "path", "left_semi")


def sliced(items: DataFrame, limit: int) -> DataFrame:
    """Items(layer, place, text) of a pack that fit in `limit` tokens: by layer, then place, passing over what doesn't."""
    rank = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    rows = items.withColumns({"pack": F.lit(0), "order": rank * 1_000_000 + F.col("place"), "cost": estimated_tokens(F.col("text"))})
    taken = skip(rows, "pack", "order", "cost", limit).select(F.explode("taken").alias("order"))
    return rows.join(taken, "order").drop("pack", "order")


@F.pandas_udf(StringType())
def distinct_json(texts: pd.Series) -> pd.Series:
    """JSON with every list's repeats left out, from the innermost on; text that isn't JSON stays as it is."""

    def once(x):
        if isinstance(x, list):
            out = {}
            for y in map(once, x):
                out.setdefault(json.dumps(y, sort_keys=True), y)
            return list(out.values())
        return {k: once(v) for k, v in x.items()} if isinstance(x, dict) else x

    def one(text):
        try:
            return None if text is None else json.dumps(once(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return text

    return texts.map(one)


def register_counter(name: str, count: Callable[[str], int]) -> None:
    """Make a token counter available by name; what it counts is held to 0 at least."""
    register_batch_counter(name, lambda texts: [max(0, int(count(t))) for t in texts])


def register_batch_counter(name: str, count: Callable[[list[str]], list[int]]) -> None:
    """Make a counter of many texts at once available by name."""
    if not name.strip() or name == "native":
        raise ValueError("a counter needs a name other than 'native'")
    _counters[name] = count


def _token_counts(path: str, special_tokens: bool, texts: list[str]) -> list[int]:
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].no_truncation()
        _tokenizers[path].no_padding()
    out, held, size = [], [], 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= BATCH_CHARS or i + 1 == len(texts):
            out += [len(e.ids) for e in _tokenizers[path].encode_batch(held, add_special_tokens=special_tokens)]
            held, size = [], 0
    return out


def register_tokenizer(name: str, path: str, special_tokens: bool = False) -> None:
    """Make the exact counter of a tokenizer's file available by name. Each worker reads the file once, from a path that
    all of them have; texts are encoded BATCH_CHARS characters at a time, a longer one by itself."""
    register_batch_counter(name, partial(_token_counts, path, special_tokens))


def _counting(counter: str):
    """The function of a registered counter over Arrow arrays of texts."""
    if counter not in _counters:
        raise ValueError(f"no such token counter: {counter}")
    count = _counters[counter]

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(count(texts.fill_null("").to_pylist()), pa.int64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, LongType())


def counted(text: Column, counter: str = "native") -> Column:
    """Tokens of a text by a counter's name, 0 for null; the native one needs no Python, others take Arrow batches."""
    return estimated_tokens(text) if counter == "native" else _counting(counter)(text)


def register_sql(spark: SparkSession, function: str, counter: str) -> None:
    """Make a registered counter a function of SQL: SELECT <function>(text) FROM ..."""
    spark.udf.register(function, _counting(counter))


def envelope(payloads: DataFrame, most_chars: int = 4000) -> DataFrame:
    """Plain worker answers(worker, task, payload) as findings: the task's claim, with the answer as its evidence."""
    text = F.col("payload")
    short = F.when(F.length(text) > most_chars, F.concat(F.left(text, F.lit(most_chars)), F.lit("…"))).otherwise(text)
    return payloads.select("worker", F.col("task").alias("claim"), short.alias("evidence"), F.concat(F.lit("worker:"), F.col("worker")).alias("source"), F.lit(0.5).alias("confidence"))
