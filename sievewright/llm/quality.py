"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, small_batches, tidy, written

#: Labelled rows that a fit takes at most (about: rows are drawn by a hash of their id).
MAX_TRAINING_ROWS = 50_000
#: Share of the pooled covariance in a class's own, and of the mean variance on the diagonal.
POOLED, RIDGE = 0.3, 0.02
#: Counts of a text: its words, code points and bytes, then what is taken as a share of the words (the last two: of the
#: bytes).
STATISTICS = ("words", "chars", "bytes", "distinct", "repeats", "marks", "pipes", "bangs", "stops", "lines", "upper", "digits")
_DELETE = {name: bytes(x) for name, x in {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "marks": b"%$#*&@^~<>{}[]=+\\", "digits": b"0123456789"}.items()}
#: Words, or as many times BYTES bytes, of the usual shares that are added to every text: a few words show little.
PRIOR, BYTES = 20, 6
#: Added to a share before its logarithm.
FLOOR = 0.02


def statistics(text: str) -> list[int]:
    """Counts of one whole text, in the order of STATISTICS."""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    has = {k: len(raw) - len(raw.translate(None, x)) for k, x in _DELETE.items()}
    return [
        len(words), len(text), len(raw), len(set(words)), sum(map(eq, words, words[1:])), has["marks"], raw.count(b"|"), raw.count(b"!"),
        raw.count(b"."), raw.count(b"\n"), has["upper"], has["digits"],
    ]


def shares(counts: np.ndarray) -> np.ndarray:
    """The counts as shares, with the sums over all rows as the usual ones."""
    n = np.column_stack([np.repeat(counts[:, :1], 7, 1), np.repeat(counts[:, 2:3], 2, 1)])
    return counts[:, 3:].sum(0) / np.maximum(1, n.sum(0))


def transformed(counts: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Logarithms of the length, the mean length of a word and the shares, drawn to the usual ones in short texts."""
    n = np.column_stack([np.repeat(counts[:, :1], 7, 1), np.repeat(counts[:, 2:3], 2, 1)])
    prior = np.array([PRIOR] * 7 + [PRIOR * BYTES] * 2)
    drawn = (counts[:, 3:] + prior * usual) / (n + prior)
    length = (counts[:, 1] + PRIOR * BYTES) / (counts[:, 0] + PRIOR)
    return np.column_stack([np.log(counts[:, 1] + PRIOR * BYTES), np.log(length), np.log(FLOOR + drawn)])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and statistics (array<long>) of every text; null counts as empty. Rows stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [statistics(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "statistics"])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, statistics array<long>")


class Discriminant:
    """Two Gaussians with shrunken covariances; what scoring needs of them is factored once, when fitted."""

    def __init__(self, counts: np.ndarray, y: np.ndarray, pooled: float = POOLED, ridge: float = RIDGE):
        self.usual = shares(counts)
        x = transformed(counts, self.usual)
        self.share = float(np.mean(y)) if len(y) else 0.5
        self.classes = None
        if len(np.unique(y)) < 2 or min(np.bincount(y)) < 2:
            return
        self.middle, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = (x - self.middle) / self.scale
        own = [np.cov(z[y == c], rowvar=False, bias=True) for c in (0, 1)]
        within = sum(np.mean(y == c) * own[c] for c in (0, 1))
        self.classes = []
        for c in (0, 1):
            s = (1 - pooled) * own[c] + pooled * within
            s = (1 - ridge) * s + ridge * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.classes.append((z[y == c].mean(0), np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), math.log(np.mean(y == c))))
        # log-density differences are overconfident: a logistic curve through their signed roots makes them probabilities
        d, self.curve = self.difference(x), np.array([1.0, 0.0])
        f = np.column_stack([np.sign(d) * np.sqrt(np.abs(d)), np.ones(len(d))])
        target = np.where(y == 1, (np.sum(y == 1) + 1) / (np.sum(y == 1) + 2), 1 / (np.sum(y == 0) + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(f @ self.curve, -30, 30)))
            step = np.linalg.solve((f * (p * (1 - p) + 1e-9)[:, None]).T @ f + 1e-6 * np.eye(2), f.T @ (target - p) - 1e-6 * self.curve)
            self.curve = self.curve + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        z = (x - self.middle) / self.scale
        logs = [prior - 0.5 * (volume + np.square((z - mean) @ inverse.T).sum(1)) for mean, inverse, volume, prior in self.classes]
        return logs[1] - logs[0]

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Probability of class 1, from rows of counts; its share among the labels where one class had too few rows to fit."""
        if self.classes is None:
            return np.full(len(counts), self.share)
        d = self.difference(transformed(counts, self.usual))
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * np.sign(d) * np.sqrt(np.abs(d)) + b, -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, folds: int = 5, fold: int = 0, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Score every document by a discriminant learned from the labelled ones outside the held-out fold.

    Statistics are computed once, over whole texts, and written in the shared folder. About `most` labelled rows at
    most, drawn by a hash of the id, go to the driver for the fit, which costs it 100 bytes a row; the scan is the only
    pass over the texts, and no text is shuffled.

    Null and empty texts are scored like others. Labels other than 0 and 1 don't count; of several labels of one id the
    largest does, and of several texts that of the least statistics. Repeated documents are scored as rows each. No rows: no rows. Other columns of either table are ignored.
    Returns doc_id, held_out, score, predicted.
    """
    small_batches(docs.sparkSession)
    stats = written(document_statistics(docs), "statistics")
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    known = known.where(~held_out(F.col("doc_id"), folds, fold))
    total = known.count()
    if total > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * most / total)))
    # one row an id, so that repeated ids don't exceed the bound
    rows = stats.join(known, "doc_id").groupBy("doc_id").agg(F.min("statistics").alias("statistics"), F.first("label").alias("label")).select("statistics", "label").toPandas()
    x = np.array(rows["statistics"].tolist(), np.float64).reshape(len(rows), len(STATISTICS))
    order = np.lexsort(np.column_stack([rows["label"].to_numpy(), x]).T) if len(rows) else []
    model = Discriminant(x[order], rows["label"].to_numpy().astype(np.int64)[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("statistics").flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.score(x))], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stats.select("doc_id", F.coalesce(held_out(F.col("doc_id"), folds, fold), F.lit(False)).alias("held_out"), "statistics").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
