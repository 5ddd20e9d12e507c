"""Near-duplicate embeddings by lattice hashing: random projections decoded to E8 points, neighbouring cells probed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, small_batches, tidy, written

#: Cosine of a link, tables, cells beside its own that a vector stands in, stretch of the unit sphere before decoding.
#: A pair at the threshold shares a cell of one table with probability 0.98, so all three miss it once in 200,000.
THRESHOLD, TABLES, PROBES, STRETCH = 0.98, 3, 4, 8.0
#: A cell of n rows is dealt into the root of n / SPREAD blocks, or more if they would exceed BLOCK rows; every two meet.
SPREAD, BLOCK = 256, 1 << 15
#: Rows and columns of a product of vectors that is held at once.
TILE = (512, 4096)
SEED = 20_240_229


def _roots() -> np.ndarray:
    """The 240 shortest points of E8: two coordinates of +-1, or all of +-1/2 with an even number below 0."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.round(x)
    rest, row = x - near, np.arange(len(x))
    worst = np.abs(rest).argmax(1)
    step = np.where(rest[row, worst] >= 0, 1.0, -1.0)
    near[row, worst] += np.where(near.sum(1).astype(np.int64) % 2 != 0, step, 0.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: of the even integer points and those shifted by one half, the nearer."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((np.square(x - a).sum(1) <= np.square(x - b).sum(1))[:, None], a, b)


def projections(dimension: int, tables: int) -> np.ndarray:
    """Random directions, eight orthonormal ones a table where the dimension allows; tables share none while it does."""
    rng = np.random.default_rng(SEED + dimension)
    out = []
    while sum(x.shape[1] for x in out) < 8 * tables:
        q = np.linalg.qr(rng.standard_normal((dimension, dimension)))[0] if dimension >= 8 else rng.standard_normal((dimension, 8)) / np.sqrt(8)
        out.append(q[:, : q.shape[1] // 8 * 8])
    return np.concatenate(out, 1)[:, : 8 * tables]


def cells(unit: np.ndarray, seed: np.ndarray, tables: int = TABLES, probes: int = PROBES, stretch: float = STRETCH) -> np.ndarray:
    """Keys of the cells that each unit vector stands in, ascending: in each table its own and those whose points are
    next. `seed` (uint64, one a row) sets apart vectors that mustn't meet."""
    y = unit @ projections(unit.shape[1], tables) * (stretch * np.sqrt(unit.shape[1] / 64))
    out = []
    for t in range(tables):
        x = y[:, 8 * t : 8 * t + 8]
        home = decode(x)
        near = np.argsort(-((x - home) @ ROOTS.T), axis=1, kind="stable")[:, :probes]
        for point in (home, *(home + ROOTS[near[:, k]] for k in range(probes))):
            h = seed ^ np.uint64(t + 1)
            for c in (2 * point).astype(np.int64).astype(np.uint64).T:
                h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append(h.view(np.int64))
    return np.sort(np.column_stack(out), axis=1)


def _valid(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows (their numbers, vectors in double precision) that can link, by the length of their vectors."""
    vectors, labels = batch.column("embedding"), batch.column("label")
    size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    can = labels.is_valid().to_numpy(zero_copy_only=False) & (size > 0)
    out = []
    for d in np.unique(size[can]):
        rows = np.flatnonzero(can & (size == d))
        x = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), d)
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.linalg.norm(x, axis=1)
        ok = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
        if ok.any():
            out.append((rows[ok], x[ok]))
    return out


def _seeds(label, n: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.sha1(f"{label!r}/{n}".encode()).digest()[:8], "little"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, key, and a digest of label and vector; null where the vector can't link."""
    for batch in batches:
        out: list[bytes | None] = [None] * batch.num_rows
        labels = batch.column("label").to_pylist()
        for rows, x in _valid(batch):
            for i, v in zip(rows.tolist(), x + 0.0):  # -0.0 counts as 0.0
                out[i] = hashlib.sha1(f"{labels[i]!r}/".encode() + v.tobytes()).digest()[:16]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("key"), pa.array(out, pa.binary())], names=["vec_id", "key", "digest"])


def _pairs(group: np.ndarray, block: np.ndarray, unit: np.ndarray, own: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (row numbers) within runs of equal rows of group (cell, low, high), a bounded number at once; each
    in the one group that counts it."""
    starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1)]))
    sizes = np.diff(np.append(starts, len(group)))
    slack = threshold - 1e-9

    def linked(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        met = (group[i, 1] == group[i, 2]) | (block[i] != block[j])
        i, j = i[met], j[met]
        first = np.zeros(len(i), bool)
        for at in range(0, len(i), 50_000):
            a, b = own[i[at : at + 50_000]], own[j[at : at + 50_000]]
            common = np.where((a[:, :, None] == b[:, None, :]).any(2), a, np.iinfo(np.int64).max).min(1)
            first[at : at + 50_000] = common == group[i[at : at + 50_000], 0]
        i, j = i[first], j[first]
        exact = np.zeros(len(i), bool)
        for at in range(0, len(i), 50_000):
            exact[at : at + 50_000] = np.einsum("ij,ij->i", unit[i[at : at + 50_000]], unit[j[at : at + 50_000]]) >= threshold
        return i[exact], j[exact]

    small = np.repeat(sizes <= 48, sizes)
    nth = np.arange(len(group)) - np.repeat(starts, sizes)
    room = np.repeat(sizes, sizes) - nth
    for d in range(1, int(sizes[sizes <= 48].max(initial=0))):
        i = np.flatnonzero(small & (room > d))
        hit = i[np.einsum("ij,ij->i", unit[i], unit[i + d]) >= slack]
        yield linked(hit, hit + d)
    for s, n in zip(starts[sizes > 48].tolist(), sizes[sizes > 48].tolist()):
        for at in range(0, n, TILE[0]):
            rows = unit[s + at : s + min(n, at + TILE[0])]
            for to in range(at, n, TILE[1]):
                a, b = np.nonzero(rows @ unit[s + to : s + min(n, to + TILE[1])].T >= slack)
                keep = a + at < b + to
                yield linked(a[keep] + at + s, b[keep] + to + s)


def _joined(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Put the ends of links into one tree of `parent`, whose roots are smallest."""
    while True:
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, stretch: float = STRETCH) -> DataFrame:
    """Vectors with their number of links, and the component that those make; all of `vectors` are compared.

    Equal vectors of a label are one, with their number as its weight. Each distinct vector stands in its own cell and
    `probes` next ones in each table; pairs that share a cell are verified by cosine in double precision, and counted
    in the first of the cells that they share. A cell alone to a vector is dropped before vectors move. Larger cells are
    dealt into blocks, every two of which meet in a group of their own, so that no task holds a large cell: a cell of n
    vectors sends each to about the root of n / SPREAD groups, and beyond SPREAD * (BLOCK / SPREAD)**2 vectors to n /
    BLOCK. Groups give back their members' numbers of links and a tree of them, never the pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those without a label: no links, a
    component of their own. Vectors of other lengths don't link. Rows that repeat a vec_id with other vectors are each
    searched for themselves, and one doesn't carry the other's links on; n_links counts rows. component_id is the
    smallest vec_id of the component's rows, null if none has one; a null vec_id is kept only there. No rows give no
    rows. Other columns are ignored. Returns vec_id, n_links, component_id, kept.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("embedding", "label").alias("key"), "embedding", "label")
    digests = written(vectors.mapInArrow(_digests, "vec_id long, key long, digest binary"), "digests")
    first = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "key"))
    classes = digests.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("least"), first.alias("row"), F.count("*").alias("weight"))
    classes = written(classes.select("digest", "least", F.col("row.vec_id").alias("of"), F.col("row.key").alias("its"), "weight"), "classes")
    per = tables * (1 + probes)

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for rows, x in _valid(batch):
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                seed = np.array([_seeds(labels[i], x.shape[1]) for i in rows.tolist()], np.uint64)
                keys = cells(unit, seed, tables, probes, stretch)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                own = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), per).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(rows)), batch.column("weight").take(pa.array(rows)), flat, own], names=["node", "weight", "unit", "cells"])

    same = F.col("vec_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("its"))
    distinct = vectors.join(classes.select("of", "its", F.col("digest").alias("node"), "weight"), same).dropDuplicates(["node"])
    standing = written(distinct.select("node", "weight", "embedding", "label").mapInArrow(stand, "node binary, weight long, unit array<double>, cells array<long>"), "cells")
    sizes = standing.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    many = F.ceil(F.greatest(F.sqrt(F.col("n") / SPREAD), F.col("n") / BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = standing.select("node", F.explode("cells").alias("cell")).join(sizes.select("cell", many.alias("parts")), "cell")
    placed = placed.select("node", "cell", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    placed = placed.select("node", "cell", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    met = placed.join(standing, "node").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "low", "high").sortWithinPartitions("cell", "low", "high", "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            n, weight = table.num_rows, table.column("weight").to_numpy()
            group = np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in ("cell", "low", "high")])
            block, units = table.column("block").to_numpy(), table.column("unit").chunk(0)
            own = table.column("cells").chunk(0).flatten().to_numpy().reshape(n, per)
            lengths, flat = units.value_lengths().to_numpy(), units.flatten().to_numpy()
            ends = np.cumsum(lengths)
            links, parent = np.zeros(n), np.arange(n)
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                unit = flat.reshape(n, d) if len(at) == n else flat[(ends - d)[at][:, None] + np.arange(d)]
                for i, j in _pairs(group[at], block[at], unit, own[at], threshold):
                    if len(i):
                        i, j = at[i], at[j]
                        links += np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
                        _joined(parent, i, j)
            some = np.flatnonzero(links)
            if len(some):
                node = table.column("node").chunk(0)
                yield pa.RecordBatch.from_arrays([node.take(pa.array(some)), pa.array(links[some].astype(np.int64)), node.take(pa.array(parent[some]))], names=["node", "links", "root"])

        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            keys = np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in ("cell", "low", "high")])
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if held:
                tail = held[-1].slice(held[-1].num_rows - 1)
                if [tail.column(c)[0].as_py() for c in ("cell", "low", "high")] != keys[0].tolist():
                    change = np.append(0, change)
            if len(change):
                yield from done(pa.concat_tables([*held, table.slice(0, int(change[-1]))]))
                held = [table.slice(int(change[-1]))]
            else:
                held.append(table)
        if held:
            yield from done(pa.concat_tables(held))
        tidy()

    linked = written(met.select("cell", "low", "high", "block", "node", "weight", "unit", "cells").mapInArrow(link, "node binary, links long, root binary"), "links")
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rows = classes.withColumnRenamed("digest", "node").join(counts, "node", "left").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = rows.groupBy("part").agg(F.min("least").alias("component_id"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long")
    found = rows.join(least, "part").select(F.col("node").alias("digest"), n_links.alias("n_links"), "component_id", F.lit(True).alias("__has"))
    out = digests.join(found, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("__has"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
