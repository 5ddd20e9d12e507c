"""Differences of texts by lines: patience anchors, hunks as rows, and texts put together again from them."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUNK = "struct<old_start:int,old_count:int,new_start:int,new_count:int>"


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ascending in their firsts, that ascends in the seconds as well."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        before[k] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(j), piles.append(k)
        else:
            tops[p], piles[p] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def changes(old: list[int], new: list[int]) -> list[tuple[int, int, int, int]]:
    """(start, count) in old and in new of what differs, from 0, in order; lines stand as hashes.

    Equal lines at both ends of a stretch match. Of the rest, those that occur once in either are anchors, as many as stand
    in one order in both; between anchors it goes on the same way. A stretch without anchors has changed as a whole.
    """
    out, todo = [], [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and old[a] == new[c]:
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
        if a == b and c == d:
            continue
        anchors: list[tuple[int, int]] = []
        if a < b and c < d:
            once = {h for h, n in Counter(old[a:b]).items() if n == 1} & {h for h, n in Counter(new[c:d]).items() if n == 1}
            place = {new[j]: j for j in range(c, d) if new[j] in once}
            anchors = rising([(i, place[old[i]]) for i in range(a, b) if old[i] in place])
        if not anchors:
            out.append((a, b - a, c, d - c))
            continue
        ends = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(out)


def lines(text: Column) -> Column:
    """The lines of a text, which joined by line feeds give it back; null counts as empty."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def with_hunks(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """pairs(id and two texts) with `hunks`: what of old gives way to what of new, starts from 1. No shuffle; lines go to
    Python as hashes of 64 bits, whose collisions within two texts one in 10**19 pairs of lines has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("old_start", "old_count", "new_start", "new_count"), (i + 1, n, j + 1, m))) for i, n, j, m in changes(a, b)] for a, b in zip(batch.column("__a").to_pylist(), batch.column("__b").to_pylist())]
            kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("old_start", "old_count", "new_start", "new_count")]))
            yield batch.select([n for n in batch.schema.names if n not in ("__a", "__b")]).append_column("hunks", pa.array(found, kind))

    kept = [n for n in pairs.columns if n not in ("hunks", "__a", "__b")]
    hashed = pairs.select(*kept, *[F.transform(lines(F.col(c)), lambda x: F.xxhash64(x)).alias(n) for c, n in ((old, "__a"), (new, "__b"))])
    schema = ", ".join(f"`{n}` {t}" for n, t in hashed.dtypes if n in kept)
    return hashed.mapInArrow(run, f"{schema}, hunks array<{HUNK}>")


def hunks(pairs: DataFrame, key: str, old: str = "old", new: str = "new") -> DataFrame:
    """One row for each hunk: key, hunk (from 1), where it starts in both texts, the lines that go and those that come."""
    rows = with_hunks(pairs.select(key, old, new), old, new).select(key, lines(F.col(old)).alias("__o"), lines(F.col(new)).alias("__n"), F.posexplode("hunks").alias("hunk", "h"))
    cut = lambda of, side: F.slice(of, F.col(f"h.{side}_start"), F.col(f"h.{side}_count"))
    return rows.select(key, (F.col("hunk") + 1).alias("hunk"), "h.old_start", "h.new_start", cut("__o", "old").alias("removed"), cut("__n", "new").alias("added"))


def applied(texts: DataFrame, found: DataFrame, key: str, old: str = "old") -> DataFrame:
    """texts(key, old) with `new`: what hunks of them (a row each, no others' text) make of them. Without hunks: itself.

    A hunk brings what it adds and the old lines between it and the next one; the first also those before it.
    """
    own = found.select(F.col(key).alias("__k"), F.struct("old_start", F.size("removed").alias("gone"), "added").alias("h"))
    every = own.groupBy("__k").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    rows = texts.join(every, F.col(key).eqNullSafe(F.col("__k")), "left").withColumn("__o", lines(F.col(old)))
    behind = lambda i: F.col("hs")[i]["old_start"] + F.col("hs")[i]["gone"]
    until = lambda i: F.when(i + 1 < F.size("hs"), F.get("hs", i + 1)["old_start"]).otherwise(F.size("__o") + 1)
    parts = F.transform(F.sequence(F.lit(0), F.size("hs") - 1), lambda i: F.concat(F.col("hs")[i]["added"], F.slice("__o", behind(i), until(i) - behind(i))))
    first = F.slice("__o", F.lit(1), F.col("hs")[0]["old_start"] - 1)
    made = F.array_join(F.concat(first, F.flatten(parts)), "\n")
    return rows.withColumn("new", F.when(F.col("hs").isNull(), F.coalesce(F.col(old), F.lit(""))).otherwise(made)).drop("__k", "hs", "__o")
