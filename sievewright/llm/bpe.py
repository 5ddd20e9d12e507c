"""Byte-pair encoding by a memory-mapped lexicon of frequent words, exact merging of other words, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import new_path, passing
from .common import small_batches, tidy, written
from .packing import _batches, _joined, _parted, vocabulary
from .transducer import Transducer, compiled

#: Words in the lexicon, their longest, symbols from which a word is merged by a heap, ids decoded at once.
LEXICON, LONGEST, HEAP_FROM, IDS = 65_536, 64, 256, 1 << 18
NEVER = np.iinfo(np.int64).max
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Merges:
    """Symbols and merges of a tokenizer's file, and how a text falls into words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        model, letters = read["model"], _byte_letters()
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.final = np.array([ids[c + end] for c in letters], np.int64)
        self.byte = {c: b for b, c in enumerate(letters)}
        self.size = max(ids.values()) + 1
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        made = {c: r for r, (_, _, c) in enumerate(pairs)}
        if len(made) < len(pairs) or any(max(made.get(a, -1), made.get(b, -1)) >= r for r, (a, b, _) in enumerate(pairs)):
            raise ValueError("a symbol is merged before it is made, so merges of one pair can't be done side by side")
        keys = np.array([a * self.size + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.merged = np.append(keys[order], NEVER), np.append(order, NEVER), np.append(np.array([c for *_, c in pairs])[order], 0)
        special = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.special, self.marks = special, re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols (NEVER: not merged) and what it is merged to."""
        key = left * self.size + right
        at = np.searchsorted(self.keys[:-1], key)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NEVER), self.merged[at]

    def words(self, part: str) -> list[bytes | int]:
        """The words of a part of a text, as bytes, and the ids of special tokens among them."""
        if _LETTERS.fullmatch(part):
            return [part.encode()]
        out: list[bytes | int] = []
        at = 0
        for m in [*self.marks.finditer(part), None]:
            piece = part[at : m.start() if m else len(part)]
            out += [bytes(self.byte[c] for c in w) for w, _ in self.split(self.normalize(piece))] if piece else []
            if m:
                out.append(self.special[m.group()])
                at = m.end()
        return out

    def _long(self, word: bytes) -> list[int]:
        """The symbols of a long word: its pairs in a heap, by rank, then from the left."""
        s = self.inner[np.frombuffer(word, np.uint8)]
        s[-1] = self.final[word[-1]]
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        rank, to = self.pairs(s[:-1], s[1:])
        left = np.flatnonzero(rank != NEVER)
        heap = list(zip(rank[left].tolist(), left.tolist(), s[left].tolist(), s[left + 1].tolist(), to[left].tolist()))
        heapq.heapify(heap)
        s = s.tolist()
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= len(s) or s[j] != b:
                continue
            s[i], s[j], after[i] = c, -1, after[j]
            if after[j] < len(s):
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < len(s):
                    r, t = self.pairs(np.array([s[left]]), np.array([s[after[left]]]))
                    if r[0] != NEVER:
                        heapq.heappush(heap, (int(r[0]), left, s[left], s[after[left]], int(t[0])))
        return [x for x in s if x >= 0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. Words are merged side by side: a round merges in each word
        all pairs of its least rank, from the left where they overlap."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts, kept = np.zeros(len(words), np.int64), []
        for i in np.flatnonzero(lengths >= HEAP_FROM).tolist():
            ids = self._long(words[i])
            counts[i] = len(ids)
            kept.append((np.full(len(ids), i), np.array(ids, np.int64)))
        short = np.flatnonzero((lengths < HEAP_FROM) & (lengths > 0))
        data = np.frombuffer(b"".join(words[i] for i in short.tolist()), np.uint8)
        word, symbol = np.repeat(short, lengths[short]), self.inner[data]
        ends = np.cumsum(lengths[short]) - 1
        symbol[ends] = self.final[data[ends]]
        rank, to = np.full(len(symbol), NEVER), np.zeros(len(symbol), np.int64)
        fresh = np.flatnonzero(word[1:] == word[:-1])
        rank[fresh], to[fresh] = self.pairs(symbol[fresh], symbol[fresh + 1])
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            over = least == NEVER
            if over.any():
                kept.append((word[over], symbol[over]))
                word, symbol, rank, to, least = word[~over], symbol[~over], rank[~over], to[~over], least[~over]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == least)
            # of overlapping pairs in a row, the first, the third and so on
            start = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            nth = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
            at = at[nth % 2 == 0]
            symbol[at] = to[at]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            place = np.cumsum(stays) - 1
            word, symbol, rank, to = word[stays], symbol[stays], rank[stays], to[stays]
            at = place[at]
            changed = np.union1d(at, at[at > 0] - 1)
            rank[changed] = NEVER
            changed = changed[changed < len(word) - 1]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed], to[changed] = self.pairs(symbol[changed], symbol[changed + 1])
        if not kept:
            return np.empty(0, np.int64), counts
        word, symbol = (np.concatenate(x) for x in zip(*kept))
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(words))

    def ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, and how many each has."""
        every = [self.words(p) for p in parts]
        flat = [w for own in every for w in own]
        symbols, counts = self.merge([w if isinstance(w, bytes) else b"" for w in flat])
        special = [i for i, w in enumerate(flat) if not isinstance(w, bytes)]
        if special:
            symbols = np.insert(symbols, np.cumsum(counts)[special], [flat[i] for i in special])
            counts[special] = 1
        upto = np.concatenate([[0], np.cumsum(counts)])
        cut = np.concatenate([[0], np.cumsum([len(own) for own in every], dtype=np.int64)])
        return symbols, np.diff(upto[cut])


_merges: dict[str, Merges] = {}
_lexicons: dict[str, Transducer] = {}


def _merging(path: str) -> Merges:
    return _merges.get(path) or _merges.setdefault(path, Merges(path))


def _parts(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where each text's parts between spaces end, and the parts. Capitals count only beside special tokens."""
    parts = pc.split_pattern(_parted(texts), " ")
    return parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py(), parts.flatten().dictionary_encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each part between spaces (word: of at most LONGEST bytes) occurs in all texts: word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches):
            _, words = _parts(batch.column("text").combine_chunks().drop_null().cast(pa.large_string()))
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            size = pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False)
            some = pa.array(np.flatnonzero((size > 0) & (size <= LONGEST)))
            yield pa.RecordBatch.from_arrays([words.dictionary.take(some).cast(pa.string()), pa.array(n).take(some)], names=["word", "n"])
        tidy()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, path: str, size: int = LEXICON) -> str:
    """Compile the most frequent words of all texts, `size` at most (none of those that tie for the last places), with
    their ids into a transducer; the name under which every worker finds its file. It lies in the shared folder, from
    which Spark hands it to executors, new ones as well. The driver sees how many words occur how often, then the words."""
    spark = docs.sparkSession
    with passing(spark):
        every = written(word_counts(docs), "words")
        taken, least = 0, None
        for r in every.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(size + 1).collect():
            taken += r.words
            if taken > size:
                break
            least = r.n
        words = [] if least is None else sorted(r.word for r in every.where(F.col("n") >= least).select("word").collect())
    symbols, counts = _merging(path).ids(words)
    cut = np.split(symbols, np.cumsum(counts)[:-1]) if words else []
    memory = compiled({w.encode(): own.tolist() for w, own in zip(words, cut)})
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{new_path(spark, 'lexicon')}/lexicon-{uuid.uuid4().hex}")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(memory.astype("<i4").tobytes()))
    out.close()
    spark.sparkContext.addFile(at.toString())
    return at.getName()


def _mapped(name: str) -> Transducer:
    if name not in _lexicons:
        _lexicons.clear()
        _lexicons[name] = Transducer(np.memmap(SparkFiles.get(name), "<i4", "r"))
    return _lexicons[name]


def _encoded(texts: pa.Array, merges: Merges, words: Transducer) -> pa.ListArray:
    """Ids of each text: words found in the lexicon, others merged."""
    ends, parts = _parts(texts)
    every = parts.dictionary
    offsets = np.frombuffer(every.buffers()[1], np.int64)[every.offset : every.offset + len(every) + 1] if len(every) else np.zeros(1, np.int64)
    rank = words.ranks(np.frombuffer(every.buffers()[2] or b"", np.uint8) if len(every) else np.empty(0, np.uint8), offsets)
    new = np.flatnonzero(rank < 0)
    symbols, counts = merges.ids(every.take(pa.array(new)).to_pylist())
    start, length = words.starts[:-1][rank].astype(np.int64) if words.words else np.zeros(len(rank), np.int64), np.diff(words.starts)[rank].astype(np.int64) if words.words else np.zeros(len(rank), np.int64)
    start[new], length[new] = len(words.flat) + np.cumsum(counts) - counts, counts
    flat = np.concatenate([words.flat, symbols.astype(np.int32)])
    code = parts.indices.to_numpy()
    size = length[code]
    upto = np.concatenate([[0], np.cumsum(size)])
    ids = flat[np.repeat(start[code] - upto[:-1], size) + np.arange(upto[-1])]
    return pa.ListArray.from_arrays(pa.array(upto[np.concatenate([[0], ends])].astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str | None = None, size: int = LEXICON) -> DataFrame:
    """Documents (doc_id, text) as doc_id, ids: those of the tokenizers library without special tokens added.

    Texts are cut where the tokenizer cuts them anyway. A first pass counts the parts of all texts; the `size` most
    frequent ones (a parameter: what the lexicon holds never changes a result) are compiled with their ids into a minimal
    acyclic transducer, which workers map into memory. All different parts of a batch walk through it side by side; what
    it doesn't hold is normalised, split and merged exactly by the tokenizer's ranks, words of any length.

    Null and empty texts have no ids. Rows with one doc_id are each encoded. No rows give no rows. Other columns are
    ignored. A tokenizer whose merges use symbols before they are made raises an error.
    """
    small_batches(docs.sparkSession)
    path = path or vocabulary()
    name = lexicon(docs, path, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, words = _merging(path), _mapped(name)
        for batch in _joined(batches):
            doc_ids, texts = batch.column("doc_id").combine_chunks(), batch.column("text").combine_chunks().fill_null("").cast(pa.large_string())
            for a, b in _batches(pc.binary_length(texts).to_pylist()):
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), _encoded(texts.slice(a, b - a), merges, words)], names=["doc_id", "ids"])
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


class Pieces:
    """The bytes of each id's piece behind a space; of ids that aren't in the vocabulary, none."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        every = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(every.values()) + 2)
        for piece, i in every.items():
            pieces[i] = b" " + piece.encode()
        self.length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.start, self.data = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(pieces), np.uint8)

    def texts(self, lists: pa.ListArray) -> pa.Array:
        flat = lists.flatten().fill_null(-1).to_numpy().astype(np.int64)
        flat = np.where((flat < 0) | (flat >= len(self.length)), len(self.length) - 1, flat)
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        out, upto = [], np.concatenate([[0], np.cumsum(self.length[flat])])
        for at in range(0, len(flat), IDS):
            ids = flat[at : at + IDS]
            own = self.length[ids]
            places = np.repeat(self.start[ids] - (upto[at : at + len(ids)] - upto[at]), own) + np.arange(own.sum())
            out.append(self.data[places])
        data = np.concatenate(out) if out else np.empty(0, np.uint8)
        cut = upto[np.concatenate([[0], np.cumsum(sizes)])]
        some = np.diff(cut) > 0
        data = np.delete(data, cut[:-1][some])  # each text's first space
        ends = np.concatenate([[0], np.cumsum(np.diff(cut) - some)])
        return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())


_pieces: dict[str, Pieces] = {}


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of each list of ids, as the tokenizers library decodes it, special tokens included: pieces joined by
    spaces, as the tokenizer has no decoder; ids out of the vocabulary are left out. Null and empty lists: empty."""
    path = path or vocabulary()

    def run(lists: pa.Array) -> pa.Array:
        return (_pieces.get(path) or _pieces.setdefault(path, Pieces(path))).texts(lists)

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(ids)


def ids_sha256(ids: Column) -> Column:
    """Digest of each list of ids as little-endian 32-bit numbers; of an empty one if it is null."""

    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()
        return pa.array([hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip([0, *ends], ends)], pa.string())

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    made = made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256(F.col("ids")).alias("ids_sha256"), decode(F.col("ids")).alias("decoded"))
    return made.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
