"""Hard negatives by a vector-approximation file: cells of each dimension, score bounds from tables, few exact scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, tidy, written

#: Positives of an anchor, negatives of each, least score of a negative in percent of the positive's, steps of 1.
POSITIVES, NEGATIVES, PERCENT, SCALE = 5, 5, 80, 256
#: Cells of a dimension; components of a block of anchors; rows whose bounds are held at once; fewest and most rows of a
#: strip, which one task reads against one block.
CELLS, BLOCK, CHUNK, FEWEST, MOST = 64, 1 << 15, 4096, 4096, 1 << 20
NO_ID, ANY = np.iinfo(np.int64).max, 1 << 62
#: Cells of vectors without components, which all score 0.
NONE = tuple(np.zeros((0, n), np.int64) for n in (CELLS - 1, CELLS, CELLS))
ROWS = "dim int, uid long, vec_id long, label string, anchor boolean, vector array<int>"
FOUND = "anchor long, high long, uid long, vec_id long, score long"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part, with their components as whole numbers."""
    for batch in batches:
        vectors = batch.column("embedding")
        size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        can = vectors.is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
        for d in np.unique(size[can]).tolist():
            at = np.flatnonzero(can & (size == d))
            x = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), d)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(SCALE * x)
                ok = np.isfinite(x).all(1) & (np.square(x).sum(1) * np.sqrt(max(d, 1)) < 2.0**62)
            at, x = at[ok], x[ok]
            if len(at):
                take = batch.take(pa.array(at))
                vector = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * d), pa.array(x.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, np.int32)), take.column("uid"), take.column("vec_id"), take.column("label"), take.column("anchor"), vector], names=[x.split()[0] for x in ROWS.split(", ")])


def _edges(rows: DataFrame, cells: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of vectors: upper ends of the cells but the last (dimension, cell), ascending, and the smallest and
    largest component in each cell. Cells hold about equally many of all rows' components. A few numbers a dimension."""
    parts = rows.select("dim", F.posexplode("vector").alias("at", "x")).groupBy("dim", "at")
    cuts = parts.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", F.array(*(F.lit(i / cells) for i in range(1, cells))), 4 * cells).alias("cuts"))
    by: dict[int, dict[int, tuple]] = {}
    for r in cuts.collect():
        by.setdefault(r.dim, {})[r["at"]] = (r.low, r.high, sorted(r.cuts))
    out = {}
    for d, own in by.items():
        ends = np.array([own[i][2] for i in range(d)], np.int64)
        low = np.concatenate([np.array([[own[i][0]] for i in range(d)]), ends + 1], 1)
        high = np.concatenate([ends, np.array([[own[i][1]] for i in range(d)])], 1)
        # no row is in a cell between equal ends
        out[d] = ends, low, np.maximum(low, high)
    return out


def approximate(vectors: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The cell of each component, as bytes: the approximation file's rows."""
    return np.stack([np.searchsorted(e, x, side="left") for e, x in zip(ends, vectors.T)], 1).astype(np.uint8) if vectors.shape[1] else np.zeros(vectors.shape, np.uint8)


class Anchor:
    """The best rows so far in each window of scores of one anchor, and its tables of bounds."""

    def __init__(self, uid: int, vector: np.ndarray, low: np.ndarray, high: np.ndarray, windows: list[tuple[int, int]], keep: int):
        self.uid, self.vector, self.keep = uid, vector, keep
        a, b = vector[:, None] * low, vector[:, None] * high
        self.least, self.most = np.minimum(a, b).ravel(), np.maximum(a, b).ravel()
        self.low, self.high = (np.array(x, np.int64) for x in zip(*windows))
        self.reach = self.low.copy()  # what a score needs to enter each window
        self.best = [np.empty((4, 0), np.int64) for _ in windows]
        self.scored = 0

    def offer(self, places: np.ndarray, vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        """Rows: their cells' places in a table (dimension, row), whole components, vec_id (NO_ID: null), uid."""
        upper = self.most[places].sum(0)
        near = np.flatnonzero((upper >= self.reach.min()) & (uids != self.uid))
        if not len(near):
            return
        upper, lower = upper[near], self.least[places[:, near]].sum(0)
        maybe = (upper >= self.reach[:, None]) & (lower <= self.high[:, None])
        sure = maybe & (lower >= self.low[:, None]) & (upper <= self.high[:, None])
        for w in np.flatnonzero(sure.sum(1) >= self.keep):
            maybe[w] &= upper >= np.partition(lower[sure[w]], -self.keep)[-self.keep]
        some = np.flatnonzero(maybe.any(0))
        score = vectors[near[some]].astype(np.int64) @ self.vector
        self.scored += len(some)
        for w, best in enumerate(self.best):
            there = maybe[w][some] & (score >= self.low[w]) & (score <= self.high[w])
            if there.any():
                at = near[some[there]]
                every = np.concatenate([best, np.stack([score[there], ids[at], uids[at], np.zeros(len(at), np.int64)])], 1)
                self.best[w] = every[:, np.lexsort((every[2], every[1], -every[0]))[: self.keep]]
                if self.best[w].shape[1] == self.keep:
                    self.reach[w] = max(self.low[w], self.best[w][0, -1])


def _scanner(edges: dict, same: bool, keep: int, percent: int):
    """Over rows sorted by (dim, block, strip, kind): anchors of a block first, then the rows that they are held against."""

    def finished(held: dict[str, list[Anchor]]) -> Iterator[pa.RecordBatch]:
        out = [(a.uid, None if same else int(a.high[w]), int(uid), None if i == NO_ID else int(i), int(score)) for own in held.values() for a in own for w, best in enumerate(a.best) for score, i, uid, _ in best.T]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=[x.split()[0] for x in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Anchor]] = {}
        now = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dim", "block", "strip")], 1)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                if b == a:
                    continue
                if now != tuple(keys[a]):
                    yield from finished(held)
                    now, held = tuple(keys[a]), {}
                part = batch.slice(int(a), int(b - a))
                d, (_, low, high) = now[0], edges.get(now[0], NONE)
                vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)
                uids, labels = part.column("uid").to_numpy(), part.column("label").dictionary_encode()
                kinds = part.column("kind").to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(kinds == 0).tolist():
                    windows = [(-ANY, ANY)] if same else [(-(-percent * p // 100), p) for p in part.column("scores")[i].as_py()]
                    held.setdefault(labels[i].as_py(), []).append(Anchor(int(uids[i]), vectors[i].astype(np.int64), low, high, windows, keep))
                rows = np.flatnonzero(kinds == 1)
                if not len(rows) or not held:
                    continue
                ids = part.column("vec_id").fill_null(NO_ID).to_numpy()
                codes = np.frombuffer(b"".join(part.column("codes").take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), d)
                places = codes.T.astype(np.int64) + np.arange(d)[:, None] * low.shape[1]
                code = labels.indices.to_numpy()[rows]
                for label, own in held.items():
                    name = labels.dictionary.index(label).as_py()
                    its = np.flatnonzero((code == name) == same)
                    for at in range(0, len(its), CHUNK):
                        some = its[at : at + CHUNK]
                        r = rows[some]
                        for anchor in own:
                            anchor.offer(places[:, some], vectors[r], ids[r], uids[r])
        yield from finished(held)
        tidy()

    return run


def _first(found: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """The n best rows of each key with their rank, from the best of each strip."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= n)


def mine(vectors: DataFrame, anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT, cells: int = CELLS) -> DataFrame:
    """Hard negatives of the rows of `vectors` (vec_id, embedding, label) that `anchor` marks: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score.

    Components count as floor(256 * x); a score is the integer inner product; order is by score, largest first, then by
    vec_id. An anchor's positives are its first `positives` other rows of its label; for each, its negatives are the first
    `negatives` rows of other labels that score from `percent` percent of the positive's score up to it. `label` (default:
    the column) gives the label.

    Each dimension is parted into `cells` cells of about equally many components of all rows, and a row is approximated by
    a byte a dimension. Blocks of anchors meet strips of rows, each row of a strip once a block, as streams: sums of table
    entries bound a score from both sides, and only rows that may still enter one of an anchor's windows are scored.
    A strip gives its best few a window, from which the best of all follow. Of rows of one label with equal vectors, only
    the first few by vec_id can be among the best, so that a large group of copies is a few rows before anything moves.

    Rows with a null label, a null vector or a null or non-finite component take no part, nor do those whose sum of squared
    whole components, times the root of their number, is 2**62 or more, as scores and bounds needn't fit a long. Vectors meet only those of their length. Rows that
    repeat a vec_id are rows of their own, each an anchor if marked; a null vec_id comes last among equal scores. Negative
    positive scores leave no negatives. No rows give no rows. Other columns are ignored. vec_id must be a whole number.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    label = F.col("label") if label is None else label
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), "embedding")
    rows = written(rows.mapInArrow(_whole, ROWS), "vectors")
    edges = _edges(rows, cells)
    order = Window.partitionBy("dim", "label", "vector").orderBy(F.asc_nulls_last("vec_id"), "uid")
    firsts = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(positives, negatives) + 1).drop("nth", "anchor")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, lists = batch.column("dim").to_numpy(), batch.column("vector")
            codes = np.empty(batch.num_rows, object)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                codes[at] = [c.tobytes() for c in approximate(x, edges.get(d, NONE)[0])]
            yield batch.append_column("codes", pa.array(codes, pa.binary()))

    names = ["dim", "uid", "vec_id", "label", "vector"]
    file = written(firsts.select(*names).mapInArrow(encode, "dim int, uid long, vec_id long, label string, vector array<int>, codes binary"), "approximations")
    anchors = rows.where("anchor").select(*names)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = {r.dim: r.n for r in file.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    # blocks and strips by length of vectors
    parts = []
    for r in anchors.groupBy("dim").agg(F.count("*").alias("n")).collect():
        blocks = -(-r.n * max(r.dim, 1) // BLOCK)
        strips = max(-(-sizes[r.dim] // MOST), min(-(-sizes[r.dim] // FEWEST), -(-2 * partitions // blocks)))
        parts.append((r.dim, blocks, strips))
    parts = spark.createDataFrame(parts, "dim int, blocks int, strips int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("uid"), n).cast("int")
    against = file.join(parts, "dim").select(*names, "codes", F.lit(None).cast("array<long>").alias("scores"), F.lit(1).alias("kind"), own(F.col("strips")).alias("strip"), every(F.col("blocks")).alias("block"))

    def scan(asking: DataFrame, same: bool, keep: int, name: str) -> DataFrame:
        asked = asking.join(parts, "dim").select(*names, F.lit(None).cast("binary").alias("codes"), "scores", F.lit(0).alias("kind"), own(F.col("blocks")).alias("block"), every(F.col("strips")).alias("strip"))
        key = ["dim", "block", "strip"]
        met = asked.unionByName(against).repartition(partitions, *key).sortWithinPartitions(*key, "kind")
        return written(met.mapInArrow(_scanner(edges, same, keep, percent), FOUND), name)

    near = _first(scan(anchors.withColumn("scores", F.lit(None).cast("array<long>")), True, positives, "near"), ["anchor"], positives, "nth")
    near = written(near.join(anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = near.where("positive_score >= 0").groupBy(F.col("anchor").alias("uid")).agg(F.collect_set("positive_score").alias("scores"))
    far = _first(scan(anchors.join(scores, "uid"), False, negatives, "far"), ["anchor", "high"], negatives, "rank")
    far = far.select("anchor", F.col("high").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, F.col("vec_id") % 100 == 0, label)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""
