"""Packing documents into training sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, tidy, written

#: Tokens in a sequence, largest piece that shares one, the id that ends a document, pieces that are packed together,
#: words kept by a worker.
CAPACITY, SHARE, END, GROUP, KEPT_WORDS = 4096, 1024, 2, 2048, 200_000
TEXT_BYTES = 4 << 20
#: Bytes of text that are parted at once, words whose ids are gathered at once.
PARTED_BYTES, GATHERED = 1 << 19, 1 << 15


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Token ids of texts, by way of the ids of their parts between spaces, tabs and line ends.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its parts in a row; each
    part is encoded once while it is kept. A worker keeps at most KEPT_WORDS of them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.known)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(words)] = lengths
        self.known.update(zip(words, range(n, n + len(words))))
        self.used += len(flat)

    def _learn(self, new: list[str]) -> None:
        """Letters alone are one word to the tokenizer, whose last id says so: such parts are encoded many at a time."""
        letters = [w for w in new if _LETTERS.fullmatch(w)]
        single = [w for w in new if not _LETTERS.fullmatch(w)]
        for at in range(0, len(letters), 2000):
            part = letters[at : at + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(part):
                self._add(part, ids, np.diff(ends, prepend=-1))
            else:
                single += part
        for at in range(0, len(single), 1000):
            part = single[at : at + 1000]
            ids = [e.ids for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._add(part, np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())), lengths)

    def ids(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        parts, counts = [], []
        for a, b in _batches(pc.binary_length(texts).to_pylist(), PARTED_BYTES):
            split = pc.split_pattern(_parted(texts.slice(a, b - a)), " ")
            parts.append(split.flatten().cast(pa.string()))
            counts.append(np.diff(split.offsets.to_numpy()))
        ends = np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))
        words = pa.chunked_array(parts, pa.string()).dictionary_encode().combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        del parts
        every, at = words.dictionary.to_pylist(), words.indices.to_numpy()
        del words
        known = self.known
        codes = np.fromiter(map(known.get, every, repeat(-1)), np.int32, len(every))
        rare, unknown = (), np.flatnonzero(codes < 0)
        if len(unknown):
            # as many stay as there is room for, frequent ones first; the others go again after this batch
            often = np.bincount(at, minlength=len(every))[unknown]
            new = [every[i] for i in unknown[np.argsort(-often, kind="stable")].tolist()]
            room = max(0, KEPT_WORDS - len(known))
            rare = new[room:]
            self._learn(new[:room])
        kept, used = len(known), self.used
        if len(unknown):
            self._learn(rare)
            codes[unknown] = [known[every[i]] for i in unknown.tolist()]
        del every[:]
        codes = codes[at]
        upto = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(self.length[codes], out=upto[1:])
        flat = np.empty(upto[-1], np.uint32)
        for a in range(0, len(codes), GATHERED):  # by parts: indices take several times the room of ids
            own = codes[a : a + GATHERED]
            x, y = upto[a], upto[a + len(own)]
            flat[x:y] = self.flat[np.repeat(self.start[own] - upto[a : a + len(own)], self.length[own]) + np.arange(x, y)]
        cut = upto[np.concatenate([[0], ends])]
        for w in rare:
            del known[w]
        assert len(known) == kept
        self.used = used
        return [flat[a:b] for a, b in zip(cut, cut[1:])]


_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Bytes as they stand in a text with other white space as spaces and ASCII in lower case.
_PLAIN = np.array([32 if c in (9, 10, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_WORDY = np.array([48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])
_MARK = np.array([chr(c) in ".,!?;:%$#*&" for c in range(256)])


def _parted(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """Texts in other bytes with the same ids, but fewer different parts between spaces.

    White space is spaces, capitals of ASCII and Latin-1 are small (the tokenizer makes all others small as well), and
    where a letter or digit meets a mark that isn't part of a contraction, the tokenizer parts them anyway. Special
    tokens count by their case: with anything like one, texts stay as they are.
    """
    n, at = len(texts), texts.offset
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[at : at + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if b"<|" in data.tobytes():
        data = np.where(_PLAIN[data] == 32, np.uint8(32), data)
    else:
        data = _PLAIN[data]
        late = data[1:]
        late[(data[:-1] == 0xC3) & (late >= 0x80) & (late <= 0x9E) & (late != 0x97)] += 0x20
        cut = np.flatnonzero(_WORDY[data[:-1]] & _MARK[late]) + 1
        data, offsets = np.insert(data, cut, 32), offsets + np.searchsorted(cut, offsets, side="left")
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data))


_words: dict[str, Words] = {}


def _batches(sizes: list[int], most: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches, joined until they have about TEXT_BYTES: the more words at once, the fewer look-ups."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= TEXT_BYTES:
            whole, held, size = pa.Table.from_batches(held).combine_chunks(), [], 0
            yield whole
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, share: int = SHARE, end: int = END) -> DataFrame:
    """Documents (doc_id, text) as pieces: of `capacity` ids while that many are left, then of `share` ids, then the
    rest: doc_id, start, length, ids_crc32, doc_tokens. The ids themselves never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words.get(path) or _words.setdefault(path, Words(path))
        for batch in _joined(batches):
            doc_ids, texts = batch.column("doc_id").combine_chunks(), batch.column("text").combine_chunks().fill_null("").cast(pa.large_string())
            for a, b in _batches(pc.binary_length(texts).to_pylist()):
                row, start, length, crc, total = [], [], [], [], []
                for i, ids in enumerate(words.ids(texts.slice(a, b - a)), a):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    whole = len(ids) // capacity * capacity
                    for at in (*range(0, whole, capacity), *range(whole, len(ids), share)):
                        piece = ids[at : at + (capacity if at < whole else share)]
                        row.append(i), start.append(at), length.append(len(piece)), crc.append(zlib.crc32(piece)), total.append(len(ids))
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def _difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item by the largest differencing method over `windows` sets.

    A partial partition is its sets' sums less the smallest, largest first, with the trees of items behind them. The
    two with the largest spread are merged, largest against smallest, until one is left.
    """
    n = len(sizes)
    left, right = [-1] * n, [-1] * n  # trees: items are leaves
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {i: (np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)}
    name = n
    while len(heap) > 1:
        (sa, na), (sb, nb) = (held.pop(heapq.heappop(heap)[1]) for _ in range(2))
        both = max(0, len(sa) + len(sb) - windows)
        lone = len(sa) - both
        top, nodes = [sa[:lone], sb[: len(sb) - both]], [na[:lone], nb[: len(nb) - both]]
        if both:
            top.append(sa[lone:] + sb[len(sb) - both :][::-1])
            first = len(left)
            left.extend(na[lone:].tolist())
            right.extend(nb[len(nb) - both :][::-1].tolist())
            nodes.append(np.arange(first, first + both))
        s, t = np.concatenate(top), np.concatenate(nodes)
        order = np.argsort(-s, kind="stable")
        s, t = s[order], t[order]
        if len(s) == windows:
            s = s - s[-1]
        held[name] = (s, t)
        heapq.heappush(heap, (-int(s[0]), name))
        name += 1
    out = np.zeros(n, np.int64)
    for w, root in enumerate(held[heap[0][1]][1].tolist()):
        stack = [root]
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = w
            else:
                stack += (left[x], right[x])
    return out


def partition(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Near-equal windows of at most `capacity`: as few as the sum allows, and more whenever one is exceeded."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = _difference(sizes, windows)
        if np.bincount(at, sizes).max(initial=0) <= capacity:
            return at
        windows += 1


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort([table.column("uid").to_numpy()])
        table = table.take(pa.array(order))
        sizes = table.column("length").to_numpy().astype(np.int64)
        at = partition(sizes, capacity)
        by = np.argsort(at, kind="stable")
        upto = np.cumsum(sizes[by]) - sizes[by]
        first = np.concatenate([[True], at[by][1:] != at[by][:-1]])
        offset = np.empty(len(at), np.int64)
        offset[by] = upto - np.maximum.accumulate(np.where(first, upto, 0))
        sequence = 2 * ((table.column("grp").to_numpy().astype(np.int64) << 20) + at)
        return table.drop_columns(["uid", "grp"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, share: int = SHARE, end: int = END, group: int = GROUP) -> DataFrame:
    """Pieces of all documents (doc_id, text) with the sequence and the offset there that each gets.

    A document is its ids and `end`. It fills sequences of its own while it can; what is left, in pieces of at most
    `share`, is dealt by a hash of its place in the table into groups of about `group` pieces, each parted into
    near-equal windows. More rows mean more groups, so the work grows in proportion. Smaller pieces level the windows
    better: at a quarter of the capacity, padding is about 0.3 % of a group, against 2 % for uncut last pieces.

    Null and empty texts: a piece with `end` alone. Repeated rows: packed each. No rows: no rows. Other columns of
    docs are ignored. Piece rows are written once in the shared folder: a rerun of any task sees the same pieces.
    """
    small_batches(docs.sparkSession)
    pieces = written(cut_pieces(docs, path or vocabulary(), capacity, share, end).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("uid") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, round(rest.count() / group))
    rest = rest.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = rest.groupBy("grp").applyInArrow(_pack(capacity), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(packed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
