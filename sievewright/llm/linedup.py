"""Line dedup: a suffix array over line ids by distributed prefix doubling finds repeated runs; later copies go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, tidy, unrepeated, written

#: Words from which a repeated run of lines goes.
MIN_WORDS = 50
#: What is no document's key: stands for a null doc_id.
NO_ID = -(1 << 63)
#: Parts into which the successors of one rank are dealt while they are ranked, and the copies of one run while its
#: first is looked for.
PARTS, SALTS = 1024, 32


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the fewest lines from it on, and up to it, that have `least` words; 0 where there aren't so many."""
    n = len(words)
    upto = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(upto, upto[:-1] + least, side="left")
    start = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    return np.where(end <= n, end - np.arange(n), 0), np.where(start >= 0, np.arange(1, n + 1) - start, 0)


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """Every line: its document (doc, version: hash of its text), place, 128-bit hash, and the windows that begin
    (ahead) and end (back) at it. No line's text leaves the worker."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "version"))
            texts = batch.column("text").to_pylist()
            for a in range(0, len(texts), 500):
                hashed, counts, ahead, back = [], [], [], []
                for text in texts[a : a + 500]:
                    lines = (text or "").encode("utf-8", "replace").split(b"\n")
                    hashed += [xxhash.xxh3_128_digest(x) for x in lines]
                    counts.append(len(lines))
                    f, b = windows(np.fromiter((len(x.split()) for x in lines), np.int64, len(lines)), least)
                    ahead.append(f), back.append(b)
                h = np.frombuffer(b"".join(hashed), "<i8").reshape(-1, 2)
                place = np.concatenate([np.arange(n, dtype=np.int64) for n in counts])
                columns = [np.repeat(x[a : a + 500], counts) for x in (ids, versions)] + [place, h[:, 0].copy(), h[:, 1].copy(), np.concatenate(ahead), np.concatenate(back)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "version", "place", "h1", "h2", "ahead", "back"])
        tidy()

    return docs.mapInArrow(run, "doc long, version long, place long, h1 long, h2 long, ahead long, back long")


def _ranked(pairs: DataFrame, top: int) -> DataFrame:
    """Rows of pairs (rank, next) that aren't alone with theirs, with a finer rank: the old one, plus the rows of the
    same rank that come before by `next`. Ranks are at most `top`.

    Counts are pre-aggregated, so what is ranked are distinct pairs, and in two levels: a rank's successors in PARTS
    ranges of theirs, then within a range. So the successors of a very common line don't meet in one task.
    """
    counts = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).withColumn("part", F.expr(f"next * {PARTS} div {top + 1}"))
    counts = written(counts, "counts")
    parts = counts.groupBy("rank", "part").agg(F.sum("n").alias("total"))
    upto = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select("rank", "part", (F.sum("total").over(upto) - F.col("total")).alias("prior"))
    here = F.sum("n").over(Window.partitionBy("rank", "part").orderBy("next").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    finer = counts.withColumn("here", here).where("n > 1").join(parts, ["rank", "part"]).select("rank", "next", (F.col("rank") + F.col("prior") + F.col("here")).alias("refined"))
    return pairs.join(finer, ["rank", "next"]).select("doc", "version", "place", F.col("refined").alias("rank"))


def _later(named: DataFrame) -> DataFrame:
    """Of windows (doc, version, start, size) with the name of their interval (head, tail, size) those that aren't the
    interval's first, as lines start to stop that aren't in the first copy.

    The first of an interval is found over SALTS parts of it, and handed back to those: a run with any number of copies
    is no key of a join.
    """
    at = F.struct("doc", "version", "start")
    keys = ["head", "tail", "size"]
    named = named.withColumn("salt", F.pmod(F.xxhash64("doc", "version", "start"), F.lit(SALTS)).cast("int"))
    parts = written(named.groupBy(*keys, "salt").agg(F.min(at).alias("first"), F.count("*").alias("n")), "intervals")
    first = parts.groupBy(*keys).agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    again = named.join(parts.select(*keys, "salt").join(first, keys), [*keys, "salt"]).where(at != F.col("first"))
    # copies may overlap in one document: what is in the first stays
    own = (F.col("doc") == F.col("first.doc")) & (F.col("version") == F.col("first.version"))
    begin = F.when(own, F.greatest("start", F.col("first.start") + F.col("size"))).otherwise(F.col("start"))
    return again.select("doc", "version", begin.alias("start"), (F.col("start") + F.col("size")).alias("stop"))


def repeated_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Runs of lines (doc, version, start, stop: exclusive) that occurred before, in order of (doc, version, place).

    Ranks of single lines are their places in the order of hashes; a step of prefix doubling joins each suffix's rank
    with that of the suffix 2**k lines on, and ranks the pairs within the first: the suffix array, as far as 2**(k+1)
    lines. Suffixes whose prefix occurs once leave, so what is carried shrinks to true repeats.

    Suffixes whose longest common prefix has m lines or more are an interval of the array. Two suffixes are in one if
    the two stretches of 2**k lines that cover m lines have equal ranks in both, so those ranks name the interval, and
    its members needn't be gathered in order to compare neighbours. Intervals are asked for at each line's least window
    of `least` words that begins there, and that ends there: those inside a maximal repeated run of `least` words or
    more cover it wholly, so their union is that of all maximal runs. Where copies overlap each other in a document,
    the first stays whole.
    """
    lines = written(_lines(docs, least), "lines")
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").withColumn("bucket", F.shiftrightunsigned("h1", 52))
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("total"))
    prior = F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")
    here = F.sum("n").over(Window.partitionBy("bucket").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    first = counts.join(buckets.select("bucket", prior.alias("prior")), "bucket").select("h1", "h2", (F.col("prior") + here).alias("rank"))
    known = written(lines.join(first, ["h1", "h2"]).select("doc", "version", "place", "rank", "ahead", "back"), "ranks")
    # the least windows, once for each place and size
    front = known.where("ahead > 0").select("doc", "version", F.col("place").alias("start"), F.col("ahead").alias("size"))
    rear = known.where("back > 0").select("doc", "version", (F.col("place") - F.col("back") + 1).alias("start"), F.col("back").alias("size"))
    asked = written(front.union(rear).distinct(), "windows")
    longest = asked.agg(F.max("size")).first()[0] or 0
    top = known.agg(F.max("rank")).first()[0] or 0
    ranks, found, width = known.select("doc", "version", "place", "rank"), None, 1
    while width <= longest:
        part = asked.where((F.col("size") >= width) & (F.col("size") < 2 * width))
        head = ranks.select("doc", "version", F.col("place").alias("start"), F.col("rank").alias("head"))
        tail = ranks.select("doc", "version", F.col("place").alias("last"), F.col("rank").alias("tail"))
        named = part.join(head, ["doc", "version", "start"]).withColumn("last", F.col("start") + F.col("size") - width).join(tail, ["doc", "version", "last"]).drop("last")
        again = written(_later(written(named, "named")), "again")
        found = again if found is None else found.union(again)
        if 2 * width <= longest:
            after = ranks.select("doc", "version", (F.col("place") - width).alias("place"), F.col("rank").alias("next"))
            ranks = written(_ranked(written(ranks.join(after, ["doc", "version", "place"]), "pairs"), top), "ranks")
            if not ranks.head(1):
                break
        width *= 2
    return docs.sparkSession.createDataFrame([], "doc long, version long, start long, stop long") if found is None else found


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__version": F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))})


def dedup(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs without the later copies of maximal repeated runs of lines of `least` words or more, with n_lines and
    n_deleted; n_chars, where there is one, follows the text.

    Copies are ordered by doc_id (nulls first), then place; the first stays, whole also where it overlaps a later one:
    30 equal lines of 5 words leave 10. Lines are compared byte by byte (by 128-bit
    hashes), blank ones as well; words are runs of anything but ASCII white space. Null text: 0 lines, and null again.
    Empty text: one empty line, kept. Rows that repeat doc_id and text are one document: both keep or lose the same.
    No rows: no rows. Other columns are kept, but ones named n_lines or n_deleted. Text is shuffled once, to meet its
    document's windows, unless those are few enough for Spark to broadcast.
    """
    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    lines = keyed.select(F.col("__doc").alias("doc"), F.col("__version").alias("version"), "text").where("text IS NOT NULL")
    # rows that repeat a document would be copies of themselves
    runs = repeated_runs(lines if unrepeated(docs) else lines.dropDuplicates(["doc", "version"]), least)
    spans = runs.groupBy(F.col("doc").alias("__doc"), F.col("version").alias("__version")).agg(F.collect_set(F.struct("start", "stop")).alias("__spans"))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    joined = keyed.select(*keep, "__doc", "__version").join(spans, ["__doc", "__version"], "left").select(*keep, "__spans")
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist()):
                if text is None or not spans:
                    texts.append(text), total.append(0 if text is None else text.count("\n") + 1), gone.append(0)
                    continue
                lines = text.split("\n")
                edge = np.zeros(len(lines) + 1, np.int64)
                for s in spans:
                    edge[s["start"]] += 1
                    edge[s["stop"]] -= 1
                out = np.cumsum(edge)[:-1] > 0
                texts.append("\n".join(x for x, o in zip(lines, out.tolist()) if not o)), total.append(len(lines)), gone.append(int(out.sum()))
            columns = [batch.column(c) for c in keep]
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in keep:
                was, i = batch.column("n_chars").to_pylist(), keep.index("n_chars")
                columns[i] = pa.array([len(t) if g else n for t, g, n in zip(texts, gone, was)], columns[i].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*keep, "n_lines", "n_deleted"])
        tidy()

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return joined.mapInArrow(run, f"{fields}, n_lines long, n_deleted long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
