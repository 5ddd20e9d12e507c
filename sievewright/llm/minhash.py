"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import fewer, forget, release
from .common import components, small_batches, tidy, written

#: Words of a shingle and least similarity in percent of a link, where nothing else is asked for.
WORDS, PERCENT = 5, 80
#: Bands and bins of each. Two sets of similarity 0.85 share no band once in two million pairs, of 0.8 once in 20,000.
BANDS, ROWS = 25, 5
BINS = BANDS * ROWS
#: Share of pairs at the threshold that may share no band, at most: what 25 bands of 5 rows miss at 0.8.
MISSED = 5e-5
TEXT_BYTES = 4 << 20
#: Members of a star that one copy of what its centre contributes serves.
SHARE = 256
#: Times fewer tasks than shuffles have partitions that write rows with whole sets.
WIDE = 4
#: Bits in a filter of documents for each that it has to let through, and at most: 32 MB.
FILTER_BITS, MOST_BITS = 64, 1 << 28
#: Bits in a bitmap of Spark's.
BITMAP = 8 * 4096


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rows_for(percent: int) -> int:
    """The most bins of a band, up to ROWS, with which all but MISSED of the pairs at `percent` share a band."""
    for rows in range(ROWS, 0, -1):
        if (1 - (percent / 100) ** rows) ** (BINS // rows) <= MISSED:
            return rows
    raise ValueError(f"{BINS} bins find no pairs of {percent} percent reliably")


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of shingles as 64-bit hashes: all in a row, ascending for each text, and where each text's end.

    A-Z count as lower case; words are runs of anything but space, tab, LF, VT, FF and CR. A text of fewer words than a
    shingle's is one shingle; one without words, or null, has none.
    """
    import xxhash

    lower = pc.ascii_lower(texts.fill_null("").cast(pa.large_string()))
    parts = pc.ascii_split_whitespace(lower)
    coded = parts.flatten().dictionary_encode()
    every = coded.dictionary.to_pylist()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in every), np.uint64, len(every))
    codes = coded.indices.to_numpy()
    row = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    if "" in every:  # before leading or after trailing white space
        real = codes != every.index("")
        codes, row = codes[real], row[real]
    counts = np.bincount(row, minlength=len(texts))
    h = known[codes]
    first = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts) if len(h) else np.zeros(0, np.int64)
    left = np.repeat(counts, counts) - first  # words from here to the end
    out = np.zeros(len(h), np.uint64)
    for k in range(words):
        follows = left > k
        step = np.zeros(len(h), np.uint64)
        step[: len(h) - k] = h[k:]
        out = np.where(follows, _mix(out * np.uint64(0x9E3779B97F4A7C15) + step + np.uint64(k + 1)), out)
    keep = (left >= words) | (first == 0)
    row, out = row[keep], out[keep]
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (out[1:] != out[:-1])
    row, out = row[fresh], out[fresh]
    return out, np.cumsum(np.bincount(row, minlength=len(texts)))


#: For each bin, the order in which an empty one asks the others.
_ASKED = np.array([np.random.default_rng(7_919 + b).permutation(BINS) for b in range(BINS)])


def band_keys(sets: np.ndarray, ends: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The bucket of each set in each band of `rows` bins.

    One permutation deals a set's hashes into bins, each of which keeps its least. An empty bin takes the value of the
    first full one in its own random order of bins: so any two sets agree in it with their similarity as probability.
    """
    n = len(ends)
    sizes = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(n), sizes)
    h = _mix(sets + np.uint64(0x5851F42D4C957F2D))
    at = ((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    place = row * BINS + at.astype(np.int64)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(n * BINS, none)
    order = np.argsort(h, kind="stable")[::-1]
    least[place[order]] = h[order]  # the last written is the least
    least = least.reshape(n, BINS)
    full = least != none
    empty_row, empty_bin = np.nonzero(~full & (sizes > 0)[:, None])
    for k in range(BINS):
        if not len(empty_row):
            break
        ask = _ASKED[empty_bin, k]
        good = full[empty_row, ask]
        least[empty_row[good], empty_bin[good]] = least[empty_row[good], ask[good]]
        empty_row, empty_bin = empty_row[~good], empty_bin[~good]
    bands = BINS // rows
    keys = np.zeros((n, bands), np.uint64)
    for r in range(rows):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, r::rows][:, :bands])
    return _mix(keys + np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        done = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + TEXT_BYTES, side="right")))
        yield begin, end
        begin = end


def signatures(docs: DataFrame, words: int, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, key, text): doc_id, key, n_shingles, a digest of the shingle set and its buckets; the last two null
    where the set is empty."""
    import xxhash

    bands = BINS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _blocks(batch.column("text")):
                sets, ends = shingle_sets(batch.column("text").take(pa.array(np.arange(a, b))), words)
                sizes = np.diff(ends, prepend=0)
                digest = [xxhash.xxh3_128_digest(sets[e - n : e].tobytes()) if n else None for e, n in zip(ends.tolist(), sizes.tolist())]
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(ends) + 1) * bands, bands), pa.int32()), pa.array(band_keys(sets, ends, rows).ravel()))
                own = [batch.column(c).slice(a, b - a) for c in ("doc_id", "key")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes.astype(np.int64)), pa.array(digest, pa.binary()), keys], names=["doc_id", "key", "n_shingles", "digest", "bands"])
        tidy()

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, n_shingles long, digest binary, bands array<long>")


def _perhaps(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents among wanted(doc_id, key) with about one in FILTER_BITS of the others, while texts stay where they are.

    What the wanted ones hash to is broadcast as bitmaps, of 512 of them each. Beyond MOST_BITS bitmaps fill up, which lets
    more of the others through and loses none.
    """
    bits = min(MOST_BITS, FILTER_BITS * max(1, wanted.count()))
    place = F.pmod(F.xxhash64("doc_id", "key"), F.lit(bits))
    part, bit = F.floor(F.col("place") / BITMAP), F.col("place") % BITMAP
    maps = wanted.select(place.alias("place")).select(part.alias("part"), bit.alias("bit")).repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    byte = F.substring("bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))
    hit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), bit % 8) == 1
    return docs.withColumn("place", place).withColumn("of", part).join(F.broadcast(maps), (F.col("of") == F.col("part")) & hit, "left_semi").select(*docs.columns)


def _whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """digest and whole set of shingles of the documents among wanted(doc_id, key); some more may come along."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _blocks(batch.column("text")):
                sets, ends = shingle_sets(batch.column("text").take(pa.array(np.arange(a, b))), words)
                begins = np.append(0, ends)
                digest = [xxhash.xxh3_128_digest(sets[x:y].tobytes()) for x, y in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(sets.view(np.int64)))], names=["digest", "shingles"])
        tidy()

    return _perhaps(docs, wanted).select("text").mapInArrow(run, "digest binary, shingles array<long>")


def _copies(stars: DataFrame) -> DataFrame:
    """What each star's centre contributes, once for each share of its members: stars(a, shares, ...) to rows (a, s)."""
    return stars.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")


def _linked(size: Column, other: Column, apart: Column, percent: int) -> Column:
    """Whether sets of those sizes that differ in `apart` elements have the similarity of a link."""
    return (100 - percent) * (size + other) >= (100 + percent) * apart


def _places(pairs: DataFrame) -> DataFrame:
    """The stars (a, s, shares) that each node of pairs(a, b, s, shares) is a member of, one a band at most, and the shares
    of the star that it is the centre of; null without one."""
    star = F.struct("a", "s", "shares")
    member = pairs.select(F.col("b").alias("node"), star.alias("star"), F.lit(None).cast("int").alias("own"))
    centre = pairs.select(F.col("a").alias("node"), F.when(F.lit(False), star).alias("star"), F.col("shares").alias("own"))
    return member.union(centre).groupBy("node").agg(F.collect_list("star").alias("stars"), F.max("own").alias("own"))


def _measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b, s, shares) with the sizes of both sets, in how many shingles they differ, and whether they link. Sets
    that come with their _places are shuffled once, to the stars that they are in."""
    if "stars" not in sets.columns:
        sets = sets.join(_places(pairs), "node")
    of_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"), F.explode("stars").alias("star")).select("b", "of_b", "star.*")
    centres = sets.where("own IS NOT NULL").select(F.col("node").alias("a"), F.col("shingles").alias("of_a"), F.col("own").alias("shares"))
    both = of_b.join(_copies(centres), ["a", "s"])
    apart = (F.size("of_a") + F.size("of_b") - 2 * F.size(F.array_intersect("of_a", "of_b"))).cast("long")
    out = both.select("a", "b", "s", "shares", F.size("of_a").cast("long").alias("n_a"), F.size("of_b").cast("long").alias("n_b"), apart.alias("apart"))
    return out.withColumn("linked", _linked(F.col("n_a"), F.col("n_b"), F.col("apart"), percent))


def _labelled(rows: DataFrame, parts: DataFrame, node: str, label: str) -> DataFrame:
    """rows with the component of a column's nodes: their own where parts(node, component) has none."""
    named = parts.select(F.col("node").alias(node), F.col("component").alias("__component"))
    return rows.join(named, node, "left").withColumn(label, F.coalesce("__component", node)).drop("__component")


def _across(links: DataFrame, parts: DataFrame) -> DataFrame:
    """links(a, b) between different components, with those: x and y."""
    return _labelled(_labelled(links.select("a", "b"), parts, "a", "x"), parts, "b", "y").where("x <> y")


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts(node, component) once links(x, y) between components are counted in: only those meet again, not all nodes. A
    node that had no row is a component by itself."""
    merged = written(fewer(components(links.select(F.col("x").alias("a"), F.col("y").alias("b")), "merge")), "merged")
    known = _labelled(parts, merged, "component", "component").select("node", "component")
    return written(fewer(known.union(merged.join(parts, "node", "left_anti").select("node", "component"))), "parts")


def _others(rows: DataFrame) -> DataFrame:
    """Rows (a, s, shares, part, apart, ...) of stars that hold several components, with the least (near) and the most
    (far) that a member of another component differs in from what the star is seen from."""
    at = lambda f, sign: f(F.struct((sign * F.col("apart")).alias("x"), "part"))
    first = rows.groupBy("a").agg(F.max("shares").alias("shares"), at(F.min, 1).alias("low"), at(F.min, -1).alias("high"), F.min("part").alias("one"), F.max("part").alias("two")).where("one <> two").drop("one", "two")
    rows = rows.join(_copies(first), ["a", "s"])
    # the same among the members of any component but the one of the first
    apart_if = lambda end: F.when(F.col("part") != F.col(f"{end}.part"), F.col("apart"))
    second = rows.groupBy("a").agg(F.max("shares").alias("shares"), F.min(apart_if("low")).alias("low2"), F.max(apart_if("high")).alias("high2"))
    rows = rows.join(_copies(second), ["a", "s"])
    near = F.when(F.col("part") != F.col("low.part"), F.col("low.x")).otherwise(F.col("low2"))
    far = F.when(F.col("part") != F.col("high.part"), -F.col("high.x")).otherwise(F.col("high2"))
    return rows.withColumns({"near": near, "far": far}).drop("low", "high", "low2", "high2")


def _members(measured: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Members (a, b, s, shares, n_b, most) of stars that may link with a member of another component, by what they and
    others differ in from their centre; `most` is how many elements a set can differ in and still link."""
    most = F.floor((100 - percent) * (F.col("n_b") + F.floor(F.col("n_b") * 100 / percent)) / (100 + percent))
    rows = measured.select("a", "b", "s", "shares", "n_b", "apart", most.alias("most"))
    labelled = written(fewer(_labelled(rows, parts, "b", "part")), "labelled")
    rows = _others(labelled)
    out = written(fewer(rows.where("near <= apart + most AND far >= apart - most").select("a", "b", "s", "shares", "n_b", "most")), "members")
    forget(labelled)
    return out


def _odd(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of stars with what their sets and the star's usual set differ in (odd, and its size: apart). The usual
    set is the centre's with what most members have otherwise put right, so that the centre's own oddities aren't in
    every difference."""
    centres = rows.groupBy("a").agg(F.max("shares").alias("shares")).join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = rows.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b").join(_copies(centres), ["a", "s"])
    unlike = F.concat(F.array_except("of_a", "of_b"), F.array_except("of_b", "of_a"))
    rows = unlike_rows = written(fewer(both.select("a", "b", "s", "shares", "n_b", "most", unlike.alias("unlike")), WIDE), "unlike")
    often = rows.select("a", F.explode("unlike").alias("e")).groupBy("a", "e").agg(F.count("*").alias("times"))
    sizes = rows.groupBy("a").agg(F.count("*").alias("n"), F.max("shares").alias("shares"))
    usual = often.join(sizes, "a").where("2 * times > n").groupBy("a").agg(F.collect_list("e").alias("usual"), F.max("shares").alias("shares"))
    none = F.array().cast("array<bigint>")
    odd = F.concat(F.array_except("unlike", F.coalesce("usual", none)), F.array_except(F.coalesce("usual", none), "unlike"))
    rows = rows.join(_copies(usual), ["a", "s"], "left").select("a", "b", "s", "shares", "n_b", "most", odd.alias("odd"))
    out = written(fewer(rows.withColumn("apart", F.size("odd").cast("long")), WIDE), "odd")
    forget(unlike_rows)
    return out


def _certain(odd: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that follow without a look at common differences.

    Sets u and v link if beta * D(u, v) <= alpha * (|u| + |v|), and D(u, v) is |U| + |V| at most, where U and V are what
    they and the usual set differ in. So they do if g(u) + g(v) <= 0, with g(u) = beta * |U| - alpha * |u|. If u has any
    such v, then the member of least g is one, and it links with all such: its star stands for them all.
    """
    rows = odd.select("a", "b", "s", "shares", ((100 + percent) * F.col("apart") - (100 - percent) * F.col("n_b")).alias("g"))
    best = rows.groupBy("a").agg(F.min(F.struct("g", "b")).alias("best"), F.max("shares").alias("shares"))
    return rows.join(_copies(best), ["a", "s"]).where("g + best.g <= 0 AND b <> best.b").select(F.col("best.b").alias("a"), "b")


def _relabelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with `part` after links(x, y) between parts are counted in."""
    return _labelled(rows, components(links.select(F.col("x").alias("a"), F.col("y").alias("b")), "merge"), "part", "part")


def _within(odd: DataFrame, percent: int, rounds: int = 1) -> DataFrame | None:
    """Links (a, b) between members of one star that `part` puts in different components: all that there are, or others
    that join the same components; None without any. odd(a, b, n_b, most, odd, apart, part) as of _odd, with the component known so far.

    If U is what u and the usual set differ in, D(u, v) = |U| + |V| - 2 * |U & V|. So a link needs |U & V| >= (|U| + |V|
    - most(u, v)) / 2, where most is the D that still links. Differences that no member of another component has don't
    help, and members that have too few others to offer drop out: nearly all, in a family of copies edited at random.
    The rest meet by prefix filtering, rarest differences first, with what can still be common from there on.

    Members that meet in a difference aren't paired each with each. In each of the rounds one member of those that
    meet, another one every time, is the centre of a star: links found put members in one component, and a family that
    is one component needs no more pairs. Rounds end once they don't halve what is left, which are pairs across
    components that differ for good or nearly so; those are compared last, members of a difference's largest component
    among themselves never. The result doesn't depend on the number of rounds.
    """
    alpha, beta = 100 - percent, 100 + percent
    found = None
    rows = _others(odd)
    need = F.greatest(F.lit(1), F.ceil((F.col("apart") + F.col("near") - F.col("most")) / 2)).cast("int")
    held = rows.where((F.size("odd") >= need) & (F.col("near") <= F.col("apart") + F.col("most"))).select("a", "b", "part", "n_b", "apart", need.alias("need"), F.explode("odd").alias("e"))
    kept, of_one = None, Window.partitionBy("a", "b")  # what one member differs in
    for k in range(3):  # each time some drop out, and leave what they shared to fewer
        held = written(fewer(held), f"held{k}")
        if kept is not None:
            forget(kept)
        kept = held
        if not held.head(1):
            return None
        shared = held.groupBy("a", "e").agg(F.count("*").alias("times"), F.min("part").alias("one"), F.max("part").alias("two")).where("one <> two").drop("one", "two")
        held = held.drop("times").join(shared, ["a", "e"])
        held = held.withColumn("has", F.count("*").over(of_one)).where("has >= need")
    nth = F.row_number().over(of_one.orderBy("times", "e"))
    prefix = held.withColumn("nth", nth).where("nth <= has - need + 1").select("a", "b", "e", "part", "apart", "n_b", (F.col("has") - F.col("nth")).alias("left"))
    prefix = written(fewer(prefix), "prefixes")
    forget(kept)
    release(odd.sparkSession)
    sets = odd.select("a", "b", "odd")
    mine = ("b", "part", "apart", "n_b", "left")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        """Links among members that meet in a difference, of different parts, between left and right."""
        other = right.select("a", "e", *[F.col(c).alias(f"{c}_") for c in mine])
        enough = 2 * (1 + F.least("left", "left_")) >= F.col("apart") + F.col("apart_") - F.floor(alpha * (F.col("n_b") + F.col("n_b_")) / beta)
        pairs = left.select("a", "e", *mine).join(other, ["a", "e"]).where((F.col("part") != F.col("part_")) & enough)
        first, second = F.struct("b", "part", "apart", "n_b"), F.struct(F.col("b_").alias("b"), F.col("part_").alias("part"), F.col("apart_").alias("apart"), F.col("n_b_").alias("n_b"))
        pairs = pairs.select("a", F.least(first, second).alias("u"), F.greatest(first, second).alias("v")).distinct()
        pairs = written(fewer(pairs.select("a", F.col("u.b").alias("b"), F.col("v.b").alias("b_"), F.col("u.part").alias("x"), F.col("v.part").alias("y"), (F.col("u.apart") + F.col("v.apart")).alias("sum"), (F.col("u.n_b") + F.col("v.n_b")).alias("sizes"))), "met")
        both = pairs.join(sets, ["a", "b"]).join(sets.select("a", F.col("b").alias("b_"), F.col("odd").alias("odd_")), ["a", "b_"])
        apart = F.col("sum") - 2 * F.size(F.array_intersect("odd", "odd_"))
        out = written(fewer(both.where(alpha * F.col("sizes") >= beta * apart).select(F.col("b").alias("a"), F.col("b_").alias("b"), "x", "y"), WIDE), "within")
        forget(pairs)
        release(out.sparkSession)
        return out

    before = None
    for k in range(rounds + 1):
        sizes = prefix.groupBy("a", "e", "part").agg(F.count("*").alias("n"))
        sizes = sizes.groupBy("a", "e").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("main")).where("n > main.n")
        sizes = written(fewer(sizes), "meetings")
        rest, rows_left = sizes.agg(F.sum(F.expr("n * (n - main.n)")), F.sum("n")).first()
        if not rest:
            break
        prefix = written(fewer(prefix.join(sizes.select("a", "e", F.col("main.part").alias("main")), ["a", "e"])), "prefixes")
        last = rest <= 4 * rows_left or k == rounds or before is not None and 2 * rest > before
        before = rest
        if last:
            links = met(prefix.where("part <> main"), prefix)
        else:
            centres = prefix.groupBy("a", "e").agg(F.min_by(F.struct(*mine), F.xxhash64("b", F.lit(k))).alias("c")).select("a", "e", "c.*")
            links = met(centres, prefix)
        found = links if found is None else found.union(links)
        if last:
            break
        if links.head(1):
            prefix = _relabelled(prefix.drop("main"), links)
        else:
            prefix = prefix.drop("main")
    return None if found is None else found.select("a", "b")


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, n_shingles, digest) of docs(doc_id, key, text), and digest and component of each distinct set.

    A class is numbered by its smallest doc_id, so that the first text of a family is the centre of its stars: copies
    are nearer to what they were made from than to each other. Where several classes would have one number, and where
    no row has an id, the others' numbers are hashes beyond all ids.
    """
    whole = written(signatures(docs, words, rows_for(percent)), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    one = whole.where("n_shingles > 0").groupBy("digest").agg(first.alias("row"), F.first("bands").alias("bands"))
    banded = written(fewer(one.select("digest", "row.doc_id", "row.key", "bands"), WIDE), "classes")
    signed = written(whole.drop("bands"), "signed")
    forget(whole)
    release(docs.sparkSession)
    several = written(fewer(banded.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("lowest"), F.count("*").alias("n")).where("n > 1").select("doc_id", "lowest")), "several")
    beyond = F.xxhash64("digest").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    node = F.when(F.col("doc_id").isNotNull() & F.coalesce(F.col("lowest") == F.col("digest"), F.lit(True)), F.col("doc_id")).otherwise(beyond)
    classes = banded.join(several, "doc_id", "left").select(node.alias("node"), "digest", "doc_id", "key", "bands")
    placed = classes.select(F.col("node").alias("b"), F.explode("bands").alias("bucket"))
    centres = placed.groupBy("bucket").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1")
    pairs = placed.join(centres, "bucket").where("a < b").groupBy("a", "b").agg(F.max("n").alias("n"))
    shares = F.expr(f"int(1 + n div {SHARE})")
    pairs = written(fewer(pairs.select("a", "b", F.pmod(F.xxhash64("b"), shares).cast("int").alias("s"), shares.alias("shares"))), "stars")
    classes = written(classes.drop("bands"), "nodes")
    forget(banded, several)
    release(docs.sparkSession)
    wanted = written(fewer(classes.join(_places(pairs), "node")), "wanted")
    found = _whole_sets(docs, wanted.select("doc_id", "key"), words).groupBy("digest").agg(F.first("shingles").alias("shingles"))
    sets = written(fewer(found.join(wanted.drop("doc_id", "key"), "digest").drop("digest"), WIDE), "sets")
    release(docs.sparkSession)
    measured = written(fewer(_measured(pairs, sets, percent), WIDE), "measured")
    forget(wanted, pairs)
    release(docs.sparkSession)
    parts = written(fewer(components(measured.where("linked").select("a", "b"))), "parts")
    members = _members(measured, parts, percent)
    if members.head(1):
        odd = _odd(members, sets)
        forget(members, sets)
        release(docs.sparkSession)
        sure = written(fewer(_across(_certain(odd, percent), parts)), "certain")
        if sure.head(1):
            parts = _merged(parts, sure)
        more = _within(_labelled(odd, parts, "b", "part"), percent)
        if more is not None and more.head(1):
            parts = _merged(parts, _across(more, parts))
    return signed.drop("bands"), written(fewer(_labelled(classes.select("node", "digest"), parts, "node", "part").select("digest", "part")), "components")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Documents (doc_id, text) with the component that links of at least `percent` similarity put them in.

    Texts with equal sets are one class, and classes are what links join. In every bucket the class of the smallest
    doc_id is the centre of a star: its pairs with the rest are the candidates, so a bucket of n gives n - 1. Whole
    sets say in how much each differs from its centre, and whether they link. Members of a star that aren't both linked
    with its centre may still link with each other; those that can are found by what they differ in (see _within), so
    no pair that shares a bucket is passed over. What a large star's centre contributes is copied for every SHARE of its
    members, so that none of its joins meets in one task.

    Bands follow from `percent`; one so low that they can't find its pairs raises an error.

    Null texts and texts without words: an empty set, linked with nothing. Rows that repeat a doc_id with other texts
    are each searched and compared for themselves, and one doesn't carry the other's links on. component_id is the
    smallest doc_id of the component's rows, null if none has one; a null doc_id is kept only there. No rows give no
    rows. Other columns are ignored. Returns doc_id, n_shingles, component_id, kept.
    """
    small_batches(docs.sparkSession)
    signed, parts = _classes(_keyed(docs), words, percent)
    rows = parts.join(signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "digest")
    least = rows.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    found = parts.join(least, "part").select("digest", "component_id", F.lit(True).alias("__has"))
    out = signed.join(found, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("__has"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of docs for each component, with all columns: that of the smallest doc_id (nulls last), of the smallest
    hash of its text where that repeats, and one of several equal rows. Rows without a shingle all stay, but for
    rows that repeat their doc_id and text. No rows give no rows."""
    small_batches(docs.sparkSession)
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": F.xxhash64("text")})
    signed, parts = _classes(_keyed(docs), words, percent)
    rows = signed.groupBy("doc_id", "key", "digest").agg(F.count("*").alias("n"))
    rows = written(fewer(rows.join(parts, "digest", "left")), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = rows.where("part IS NOT NULL").groupBy("part").agg(F.min(place).alias("best"))
    gone = rows.join(best, "part").where(place != F.col("best"))
    same = F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k"))
    listed = lambda x: x.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"))
    left = keyed.join(listed(gone), same, "left_anti")
    again = written(fewer(listed(rows.where("n > 1"))), "again")
    once = left.join(again, same, "left_anti")
    return once.union(left.join(again, same, "left_semi").dropDuplicates(["__id", "__key"])).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
