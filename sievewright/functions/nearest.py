"""A detector of candidates as a table function of SQL: vectors that lie nearest to those that ask."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Rows of a part of a label, and asking ones of a block, that meet in one task as matrices.
ROWS, ASKS = 16_384, 2_048
#: Asking rows whose scores are held at a time.
CHUNK = 256
#: Parts that the vectors of one label are dealt into; those that ask are in each.
PARTS = 8


class Nearest:
    """nearest(TABLE(asks, id, embedding) PARTITION BY label, part ORDER BY asks DESC, most): of each partition, the `most`
    rows nearest to each asking one by cosine, as (left, right, score). Asking rows come first in their partition; a
    partition is read as a stream, and holds those alone. Rows without a direction are near to none, nor are vectors of
    another length."""

    def __init__(self) -> None:
        #: By length of vectors: ids, directions, and a heap of the best of each.
        self.asking: dict[int, tuple[list[int], list[np.ndarray], list[list[tuple[float, int]]]]] = {}
        self.matrix: dict[int, np.ndarray] = {}
        #: The least score that still enters a heap.
        self.least: dict[int, np.ndarray] = {}

    def eval(self, row: Row, most: int) -> None:
        if row["embedding"] is None or any(x is None for x in row["embedding"]):
            return
        vector = np.asarray(row["embedding"], np.float64)
        n, norm = len(vector), float(np.linalg.norm(vector))
        if not np.isfinite(norm) or norm == 0:
            return
        if row["asks"]:
            for held, value in zip(self.asking.setdefault(n, ([], [], [])), (row["id"], vector / norm, [])):
                held.append(value)
            return
        if n not in self.asking:
            return
        ids, units, heaps = self.asking[n]
        if n not in self.matrix:
            self.matrix[n] = np.stack(units)
            self.least[n] = np.full(len(ids), -np.inf)
        scores, least = np.round(self.matrix[n] @ (vector / norm), 6), self.least[n]
        # -id: of equal scores the smaller id is the better
        for k in np.nonzero(scores >= least)[0].tolist():
            best, score = heaps[k], float(scores[k])
            if ids[k] == row["id"]:
                continue
            if len(best) < most:
                heapq.heappush(best, (score, -row["id"]))
            elif (score, -row["id"]) > best[0]:
                heapq.heapreplace(best, (score, -row["id"]))
            if len(best) == most:
                least[k] = best[0][0]

    def terminate(self) -> Iterator[tuple[int, int, float]]:
        for ids, _, heaps in self.asking.values():
            for left, best in zip(ids, heaps):
                for score, right in sorted(best, reverse=True):
                    yield left, -right, score


def register(spark: SparkSession, name: str = "nearest") -> None:
    """Make the table function known to SQL by a name."""
    spark.udtf.register(name, F.udtf(Nearest, returnType="left long, right long, score double"))


def dealt(vectors: DataFrame, asks: str, parts: int = PARTS) -> DataFrame:
    """vectors(vec_id, embedding, label) as rows that the function takes: each in one part of its label, and those that
    ask (an expression over the columns) in all of them as well. Rows without a label are left out."""
    rows = vectors.where("label IS NOT NULL").select(F.col("vec_id").alias("id"), "embedding", "label", F.expr(asks).alias("__asks"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    own = rows.select(F.lit(False).alias("asks"), "id", "embedding", "label", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    return own.union(rows.where("__asks").select(F.lit(True).alias("asks"), "id", "embedding", "label", every.alias("part")))


def _units(column: pa.ChunkedArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions of the vectors of a length, one a row, and which have one; a vector that holds a null has none."""
    out, good = np.zeros((len(column), length)), np.zeros(len(column), bool)
    begin = 0
    for chunk in column.chunks:
        sizes = chunk.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        fit = np.nonzero(sizes == length)[0]
        values = chunk.take(pa.array(fit)).flatten().cast(pa.float64())
        empty = values.is_null().to_numpy(zero_copy_only=False).reshape(len(fit), length).any(axis=1)
        out[begin + fit] = values.fill_null(0).to_numpy(zero_copy_only=False).reshape(len(fit), length)
        good[begin + fit[~empty]] = True
        begin += len(chunk)
    with np.errstate(all="ignore"):
        norm = np.sqrt((out * out).sum(axis=1))
        good &= norm != 0
        return out / np.where(norm == 0, 1, norm)[:, None], good


def _meet(rows: pa.Table, asks: pa.Table, most: int) -> pa.Table:
    """The `most` best of rows(id, embedding) for each of asks(ask, vector), by score (null last), then id."""
    ids, left, found = rows["id"].to_numpy(), asks["ask"].to_numpy(), []
    lengths = asks["vector"].combine_chunks().value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        of = np.nonzero(lengths == length)[0]
        units, good = _units(rows["embedding"], max(length, 0))
        own, has = _units(asks["vector"].take(pa.array(of)), max(length, 0))
        for begin in range(0, len(of), CHUNK):
            part = slice(begin, begin + CHUNK)
            with np.errstate(all="ignore"):
                score = np.round(own[part] @ units.T, 6)
            # places of scores: no number comes first, none at all last, the row itself never
            key = np.where(np.isnan(score), np.inf, score)
            key[~(has[part][:, None] & good[None, :])] = -3
            key[left[of[part]][:, None] == ids[None, :]] = -np.inf
            take = min(most, len(ids))
            ask, row = np.nonzero((key >= np.partition(key, len(ids) - take, axis=1)[:, len(ids) - take, None]) & (key > -np.inf))
            order = np.lexsort((ids[row], -key[ask, row], ask))
            ask, row = ask[order], row[order]
            first = np.arange(len(ask)) - np.searchsorted(ask, ask) < most
            ask, row = ask[first], row[first]
            found.append(pa.table({"left": left[of[part]][ask], "right": ids[row], "score": pa.array(score[ask, row], mask=key[ask, row] == -3)}))
    return pa.concat_tables(found) if found else pa.table({"left": pa.array([], pa.int64()), "right": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def best_of_blocks(vectors: DataFrame, asks: str, most: int, rows: int = ROWS, block: int = ASKS) -> DataFrame:
    """For each row of vectors(vec_id, embedding, label) that asks (an expression), the `most` nearest of its label in
    each part of that: left, right and the cosine to 6 places, null where one has no direction.

    A label of n rows is dealt into n / `rows` parts, those that ask into blocks, and every part meets every block in a
    task as two matrices, so no task grows with a label.
    """
    every = vectors.where("label IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").alias("id"), "embedding", "label", F.coalesce(F.expr(asks), F.lit(False)).alias("asks"))
    sizes = every.groupBy("label").agg(F.expr(f"int(1 + count(*) div {rows})").alias("parts"), F.expr(f"int(1 + count_if(asks) div {block})").alias("blocks"))
    every = every.join(sizes, "label")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    own = every.select("id", "embedding", "label", dealt("parts").alias("part"), spread("blocks").alias("block"))
    asking = every.where("asks").select(F.col("id").alias("ask"), F.col("embedding").alias("vector"), F.col("label").alias("of"), spread("parts").alias("with"), dealt("blocks").alias("among"))
    return own.groupBy("label", "part", "block").cogroup(asking.groupBy("of", "with", "among")).applyInArrow(lambda a, b: _meet(a, b, most), "left long, right long, score double")
