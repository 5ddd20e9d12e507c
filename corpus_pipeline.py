"""A corpus pipeline of five stages over the table documents: each works on all that the one before has kept.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, so a document's text,
number of characters and so on are those it has at that point. Null and empty texts, repeated rows, empty tables and
further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import langid, linedup, minhash, mixing, packing
from sievewright.llm.common import new_path
from sievewright.tables import collected, drop_path, release

#: Share of the main language from which a document is taken for one of it.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are mostly in one of the languages of the labelled rows; lang becomes the predicted one.

    Texts without a letter and nulls have no language, and mixtures where none has half of the n-grams no main one:
    those are rejected. The model is learned from the documents' own labels, as a bounded sample of whole texts.
    """
    model = langid.learn(docs)
    named = langid.identify(docs, model, keep_text=True)
    kept = named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated runs of lines; a document of which no word is left goes with them."""
    out = linedup.dedup(docs)
    return out.where((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) keep the document of the smallest id.

    What is compared, kept or dropped are rows: another text under a repeated id stays unless it is a copy itself. Null
    ids come last, equal rows count once, texts without words all stay; an empty table stays empty.
    """
    return minhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's words by its target: documents repeated, cut or left out, in order of training position."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with the sequences and offsets that they are packed at."""
    return packing.pack(docs)


#: Tables that stages needed on the way to their results.
_left: list[str] = []


def _swept(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that begins by deleting what those before it left, but for what docs still read if they weren't written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _sweep(spark, docs)
        with collected() as paths:
            out = stage(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return run


def _sweep(spark: SparkSession, docs: DataFrame) -> None:
    read = {part for file in docs.inputFiles() for part in file.split("/")}
    for path in [p for p in _left if p.rsplit("/", 1)[-1] not in read]:
        _left.remove(path)
        drop_path(spark, path)
    release(spark)


STAGES = [
    (name, _swept(stage))
    for name, stage in (
        ("language_id", identify_language), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences),
    )
]

#: The language model, the tokenizer and the partition of pieces are beyond SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of a folder, each written in the shared folder and read again. What tables a
    stage needs on the way are deleted once it is written, the last one's as well."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    _sweep(spark, docs)
    return docs
