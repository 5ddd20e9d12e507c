"""What the operators share: tables in the cluster's shared folder, words, splits, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..tables import new_path, shared_folder, written

__all__ = ["WORD", "components", "held_out", "new_path", "shared_folder", "small_batches", "tidy", "unrepeated", "word_count", "written"]

#: A word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, unless the session says otherwise: rows are whole documents here, and buffers of the
    usual 10,000 of them stay with the executors' native heap."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def tidy() -> None:
    """Give what a Python worker no longer holds back to the system: workers outlive their tasks, beside each other."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold


def unrepeated(docs: DataFrame) -> bool:
    """Whether no doc_id is repeated: a count of ids, far cheaper than dropping repeated texts."""
    rows, ids = docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*")).first()
    return rows == ids
