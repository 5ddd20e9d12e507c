"""Language identification as a mixture: expectation-maximisation over n-gram likelihoods of a document."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, small_batches, tidy

#: Labelled rows of a language that a fit takes at most (about: rows are drawn by a hash of their id).
MAX_TRAINING_ROWS = 5_000
#: Languages that a model may have: it goes to every worker, with half a MB for each.
MAX_LANGUAGES = 256
#: Bytes of an n-gram, hash buckets, count added to each bucket, the price of one more language in n-grams' logarithms.
NGRAM, BUCKETS, SMOOTHING, PRICE = 4, 1 << 16, 0.05, 4.0
ROUNDS, CLOSE = 25, 1e-3
UNKNOWN = "und"
_TO_SPACE = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether any character is of a letter category; numerals such as fractions and superscripts aren't."""
    return next(filter(str.isalpha, text), None) is not None


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a lower-case text's n-grams of bytes, with their counts; whatever of ASCII is no letter counts as a
    space, of which two stand before and after it, so that a letter alone has n-grams too. Other characters stand for
    themselves, marks included."""
    raw = np.frombuffer(b"  " + text.lower().encode("utf-8", "replace").translate(_TO_SPACE) + b"  ", np.uint8)
    if len(raw) < NGRAM:
        return np.zeros(0, np.int64), np.zeros(0)
    h = np.zeros(len(raw) - NGRAM + 1, np.uint32)
    for k in range(NGRAM):
        h = h * np.uint32(0x01000193) ^ raw[k : len(raw) - NGRAM + 1 + k]
    h = h * np.uint32(0x9E3779B1)
    buckets = (h >> np.uint32(16)).astype(np.uint16)
    if len(buckets) > 20_000:
        counts = np.bincount(buckets, minlength=BUCKETS)
        found = np.flatnonzero(counts)
        return found, counts[found].astype(np.float64)
    found, counts = np.unique(buckets, return_counts=True)
    return found.astype(np.int64), counts.astype(np.float64)


class Mixture:
    """Languages with their n-gram probabilities, a row for each bucket."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.table = (smooth / smooth.sum(0)).astype(np.float64) if languages else counts

    def _fit(self, p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions by expectation-maximisation, and the log likelihood they reach."""
        shares = np.full(p.shape[1], 1 / p.shape[1])
        total = counts.sum()
        for _ in range(ROUNDS if p.shape[1] > 1 else 0):
            joint = p @ shares
            new = shares * ((counts / joint) @ p) / total
            if np.abs(new - shares).max() < CLOSE:
                shares = new
                break
            shares = new
        return shares, float(counts @ np.log(p @ shares))

    def infer(self, text: str) -> tuple[str, float, list[tuple[str, float]]]:
        """The main language, its share, and the set of languages with their shares.

        The set starts from the language with the largest share in the mixture of all; others follow in the order of
        their shares while one raises the log likelihood by more than PRICE times the logarithm of the n-grams.
        """
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, []
        buckets, counts = ngrams(text)
        if not len(buckets):
            return UNKNOWN, 0.0, []
        p = self.table[buckets]
        every, _ = self._fit(p, counts)
        order = np.argsort(-every, kind="stable")
        chosen = [int(order[0])]
        shares, best = self._fit(p[:, chosen], counts)
        for k in order[1:].tolist():
            if every[k] < 0.01:
                break
            more, likelihood = self._fit(p[:, [*chosen, k]], counts)
            if likelihood - best <= PRICE * math.log(1 + counts.sum()):
                break
            chosen, shares, best = [*chosen, k], more, likelihood
        top = int(np.argmax(shares))
        found = sorted(((self.languages[k], float(s)) for k, s in zip(chosen, shares)), key=lambda x: (-x[1], x[0]))
        # a lone language is as sure as its share among all
        score = float(every[chosen[0]]) if len(chosen) == 1 else float(shares[top])
        return self.languages[chosen[top]], min(1.0, max(0.0, score)), found


def learn(docs: DataFrame, most: int = MAX_TRAINING_ROWS, most_languages: int = MAX_LANGUAGES) -> Mixture:
    """A mixture's n-gram table from the whole texts of labelled rows (text, lang), about `most` a language at most.

    Partitions count into the fixed buckets and only those sums are shuffled; the driver gets as many numbers as
    languages times buckets, whatever the corpus. More than `most_languages` languages raise an error.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"labels name more than {most_languages} languages")
    languages = sorted(sizes)
    if not languages:
        return Mixture([], np.zeros((BUCKETS, 0)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    rare = [k for k in languages if sizes[k] <= most]
    keep = F.col("lang").isin(rare)
    for k in languages:
        if k not in rare:
            keep = keep | ((F.col("lang") == k) & (draw < int(1_000_000 * most / sizes[k])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                buckets, counts = ngrams(text)
                own = sums.get(lang)
                if own is None:
                    own = sums[lang] = np.zeros(BUCKETS)
                own[buckets] += counts
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counted = known.where(keep).select("text", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((BUCKETS, len(languages)))
    table[counted["bucket"].to_numpy(np.int64), [languages.index(x) for x in counted["lang"]]] = counted["n"]
    return Mixture(languages, table)


def identify(docs: DataFrame, model: Mixture, keep_text: bool = False) -> DataFrame:
    """docs without the text (unless keep_text), with lang_pred, score and languages (each of the set with its share, largest first).

    Null texts and texts without a letter: `und`, 0, none; so is every text where nothing could be learned. Ties go to
    the first language by name. Repeated rows stay apart; no rows give no rows. The only column read is text; others
    are kept, but those that clash with the three.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    added = ["lang_pred", "score", "languages"]
    keep = [c for c in docs.columns if c not in added and (keep_text or c != "text")]
    kinds = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.infer(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in keep), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()),
                pa.array([[{"lang": k, "share": s} for k, s in x[2]] for x in out], kinds),
            ], names=[*keep, *added])
        tidy()

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{fields}{', ' if fields else ''}lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def query(spark: SparkSession, sf_dir: str, folds: int = 3, fold: int = 1) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = F.coalesce(held_out(F.col("doc_id"), folds, fold), F.lit(False))
    model = learn(docs.where(~out))
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), model)
