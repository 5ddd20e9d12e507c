"""Document fingerprints: rare byte windows in chained Bloom filters, compared by normalised bit overlap."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: Bytes of a window, windows of a neighbourhood, neighbourhoods that must agree on a window to make it a feature.
WINDOW, AROUND, VOTES = 8, 8, 2
#: Bits of a filter, bits that a feature sets, features of a filter.
BITS, HASHES, FULL = 2048, 5, 256
#: Bytes of text that are worked on at once.
BLOCK = 1 << 18
#: Documents that are drawn for each range to find where ranges begin, and the seed of the draw.
SAMPLED, SEED = 64, 17
_F = np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(1, np.arange(WINDOW + 1))) * 256).astype(np.int64)
_G = np.diff(_F, append=0)


def _disorder(data: np.ndarray) -> np.ndarray:
    """For each window the sum over its byte values of count * log2(count): the less, the higher its entropy.

    A step to the right changes two counts alone; those are the numbers of equal bytes within a window's reach.
    """
    n = len(data)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for at in range(0, n, 1 << 15):
        end = min(n, at + (1 << 15))
        for d in range(1, WINDOW):
            stop = min(end, n - d)
            if stop <= at:
                break
            same = (data[at:stop] == data[at + d : stop + d]).view(np.uint8)
            ahead[at:stop] += same
            behind[at + d : stop + d] += same
    first = _F[np.bincount(data[:WINDOW], minlength=256)].sum()
    return first + np.concatenate([[0], np.cumsum(_G[behind[WINDOW:]] - _G[ahead[: n - WINDOW]])])


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Where the feature windows of each text begin, ascending.

    Windows rank by entropy: the higher it is, the less probable the window. In each neighbourhood the rarest window,
    the first of equals, gets a vote; those with VOTES or more are features. A text where no window gets so many has its
    rarest window alone, and one shorter than a window is a feature itself. The same holds for texts of any length.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < WINDOW:
        return [np.arange(min(n, 1)) for n in sizes.tolist()]
    rank = _disorder(data)
    low = (rank << 32) + np.arange(len(rank))
    least, width = low, 1
    while width < AROUND and len(least) > width:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    reach = WINDOW + AROUND - 1
    votes = np.zeros(len(data) + 1, np.int64)
    long = sizes >= reach
    if width == AROUND and long.any():
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, starts[long], 1)
        np.add.at(edge, starts[long] + sizes[long] - reach + 1, -1)
        inside = np.cumsum(edge)[: len(least)] > 0
        votes = np.bincount(least[inside] & 0xFFFFFFFF, minlength=len(data) + 1)
    picked = np.flatnonzero(votes >= VOTES)
    cut = np.searchsorted(picked, np.concatenate([starts, [len(data)]]))
    out = []
    for i, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
        own = np.arange(min(n, 1)) if n < WINDOW else picked[cut[i] : cut[i + 1]] - s
        if not len(own) and n:
            own = np.array([int(np.argmin(rank[s : s + n - WINDOW + 1]))], np.int64)
        out.append(own)
    return out


def hashes(data: bytes, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows at those places; of the whole of a text that is shorter than a window."""
    if 0 < len(data) < WINDOW:
        return np.frombuffer(hashlib.sha1(data).digest()[:8], np.uint64)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), WINDOW)[at]).view("<u8") if len(at) else np.zeros((0, WINDOW // 8), np.uint64)
    out = np.full(len(words), len(words[0]) if len(words) else 0, np.uint64)
    for k in range(words.shape[1]):
        out = (out ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def filters(hashed: np.ndarray) -> np.ndarray:
    """Features, in order and each once, in a chain of filters with FULL of them each: rows of BITS bits."""
    _, first = np.unique(hashed, return_index=True)
    hashed = hashed[np.sort(first)]
    bits = np.zeros((-(-len(hashed) // FULL), BITS), np.uint8)
    step = np.uint64(BITS.bit_length() - 1)
    for k in range(HASHES):
        bits[np.arange(len(hashed)) // FULL, (hashed >> (step * np.uint64(k))) & np.uint64(BITS - 1)] = 1
    return bits


def written_as(bits: np.ndarray) -> str:
    """Number of filters, a colon, their bits in base64."""
    return f"{len(bits)}:{base64.b64encode(np.packbits(bits, axis=1).tobytes()).decode()}"


def read_from(fingerprint: str) -> np.ndarray:
    n, _, bits = fingerprint.partition(":")
    return np.unpackbits(np.frombuffer(base64.b64decode(bits), np.uint8)).reshape(int(n), BITS)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised bit overlap of two chains, 0 to 1: 1 for equal ones, two empty ones included.

    Each filter of the shorter chain counts by its best partner: the overlap beyond chance, over the most that there
    could be beyond chance, 0 if within three deviations of chance. Its bits so matched, over the bits of the fuller
    chain, are its share.
    """
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if (len(a), int(a.sum()), a.tobytes()) > (len(b), int(b.sum()), b.tobytes()):
        a, b = b, a
    size_a, size_b = a.sum(1, dtype=np.float64), b.sum(1, dtype=np.float64)
    other, matched = b.astype(np.float32).T, 0.0
    for at in range(0, len(a), 256):
        part = a[at : at + 256].astype(np.float32)
        both, own = (part @ other).astype(np.float64), size_a[at : at + 256, None]
        chance = own * size_b / BITS
        most = np.minimum(own, size_b)
        noise = 3 * np.sqrt(chance * (1 - own / BITS) * (1 - size_b / BITS))
        gain = np.where(both > chance + noise, (both - chance) / np.maximum(most - chance, 1e-9), 0.0)
        matched += (np.clip(gain, 0, 1) * most).max(axis=1).sum()
    return float(min(1.0, matched / max(size_a.sum(), size_b.sum())))


def _edit(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


#: From so many bytes on, an edited text takes over the features that lie before the edit, and its tail is read alone.
_LONG = 2048


def _digests(pairs: list[tuple[str, str | None]]) -> list[tuple[bytes, np.ndarray, np.ndarray | None, str | None]]:
    """For each (text, edited text or None): the text's filters, those of the edited text, that text."""
    buffers, plans = [], []
    for text, edited in pairs:
        own = text.encode("utf-8", "replace")
        buffers.append(own)
        if edited is None:
            plans.append((own, None, 0))
            continue
        new = edited.encode("utf-8", "replace")
        same = len(text[: len(text) - len(text) // 4].encode("utf-8", "replace"))
        reach = WINDOW + AROUND - 1
        tail = max(0, same - reach - AROUND + 1) if same >= _LONG else 0
        buffers.append(new[tail:])
        plans.append((own, new, (same - reach, tail) if tail else 0))
    found = iter(features(buffers))
    out = []
    for own, new, tail in plans:
        at = next(found)
        mine = filters(hashes(own, at))
        theirs = None
        if new is not None:
            late = next(found)
            if tail:
                keep, start = tail
                if min(len(at), len(late)) <= 1:  # perhaps only for want of votes
                    late = features([new])[0]
                else:
                    late = np.concatenate([at[at <= keep], (late + start)[late + start > keep]])
            theirs = filters(hashes(new, late))
        out.append((mine, theirs))
    return out


def fingerprint(text: str) -> str:
    """The fingerprint of one text."""
    return written_as(_digests([(text, None)])[0][0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of every text; null counts as empty, whose fingerprint is "0:". Rows stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _followed(docs: DataFrame) -> DataFrame:
    """Documents in ranges of their order (column range), each range a partition sorted in that order and followed by
    copies (column extra) of the first document of the next, the last by that of the first: so each document's successor
    is the next row.

    The order is by doc_id, nulls last, and by a hash of the text among equal ids, whatever the ids' type. Ranges begin
    at places of a sample of SAMPLED documents a range, so they hold about equal numbers of rows however ids are spread;
    the driver sees that sample alone. The text is shuffled once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least, rows = docs.agg(F.min("doc_id"), F.count("*")).first()
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64("text").alias("hash"))
    docs = docs.select("doc_id", "text", key.alias("key"))
    if not rows:
        return docs.select("doc_id", "text", "key", F.lit(0).alias("range"), F.lit(False).alias("extra"))
    first = docs.where(F.col("doc_id").eqNullSafe(F.lit(least).cast(kind))).agg(F.min("key").alias("key"))
    drawn = docs.select("key").sample(min(1.0, SAMPLED * parts / rows), SEED)
    every = [r.key for r in drawn.union(first).distinct().orderBy("key").collect()]
    starts = [every[i] for i in sorted({0, *(len(every) * k // parts for k in range(1, parts))})]
    bounds = F.array(*[F.struct(F.lit(x.none).alias("none"), F.lit(x.doc_id).cast(kind).alias("doc_id"), F.lit(x.hash).alias("hash")) for x in starts])
    # a binary search: the last start that isn't above
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(starts).bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(starts)) & (F.get(bounds, at + step - 1) <= F.col("key")), at + step).otherwise(at)) - 1
    own = docs.withColumn("range", place)
    copies = own.where(F.col("key") == F.get(bounds, F.col("range"))).withColumn("range", F.pmod(F.col("range") - 1, F.lit(len(starts))))
    out = own.withColumn("extra", F.lit(False)).union(copies.withColumn("extra", F.lit(True)))
    return out.repartitionById(len(starts), "range").sortWithinPartitions("range", "extra", "key")


_OUT = "doc_id {}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edits(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and its likeness to that and to the next document.

    The edited text has the last quarter of the code points replaced by the first as many of the next document in
    ascending doc_id (of any type; nulls last, ties by a hash of the text), the first after the last; a lone document
    follows itself. Null text: empty. Repeated rows follow each other, in one task if id and text are equal. No rows: no
    rows. Other columns are ignored. A worker holds one block of texts at a time, whatever the length of a partition.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one range, the last of which waits for its successor
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def rows() -> Iterator[tuple]:
            for batch in batches:
                types[0] = batch.schema.field("doc_id").type
                yield from zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("range").to_pylist(), batch.column("extra").to_pylist())

        def done(block: list[tuple]) -> pa.RecordBatch:
            """Rows for all of the block but its last."""
            block = [(i, t or "") for i, t, *_ in block]
            pairs = [(t, _edit(t, after)) for (_, t), (_, after) in zip(block, block[1:])] + [(block[-1][1], None)]
            digests = _digests(pairs)
            out = []
            for k, (i, t) in enumerate(block[:-1]):
                mine, edited = digests[k]
                out.append((i, len(t), hashlib.sha256(pairs[k][1].encode("utf-8", "replace")).hexdigest(), written_as(mine), written_as(edited), likeness(mine, edited), likeness(mine, digests[k + 1][0])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        size, ended = 0, False
        for row in rows():
            if held and row[2] != held[-1][2]:
                if len(held) > 1:
                    yield done(held)
                held, size, ended = [], 0, False
            if ended:  # ties of the next range's first document
                continue
            held.append(row)
            size += len(row[1] or "")
            ended = row[3]
            if ended or size >= BLOCK and len(held) > 1:
                yield done(held)
                held, size = [row], len(row[1] or "")
        if len(held) > 1:
            yield done(held)
        tidy()

    names = [c.split()[0] for c in _OUT.format(kind).split(", ")]
    return _followed(docs.select("doc_id", "text")).drop("key").mapInArrow(run, _OUT.format(kind))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
