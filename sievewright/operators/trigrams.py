"""Search of texts by regular expressions over an inverted index of trigrams: few texts are read, those are verified."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .recall import lines_of, matches

#: Candidates up to which their ids are pushed into the scan of the texts; more are joined.
PUSHED = 2000
#: Places at which a class of characters is tried one by one.
SPELLED = 4

# What a pattern needs: None (anything may match), a trigram, or ("and" | "or", parts).


def _folded(text: str) -> str:
    """Lower case of ASCII alone, as the index has it; other letters stay, and patterns need none of them."""
    return "".join(c.lower() if c.isascii() else c for c in text)


def _all(parts: list) -> object:
    parts = list(dict.fromkeys(x for p in parts if p is not None for x in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p])))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> object:
    if any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of(text: str) -> object:
    return _all([text[i : i + 3] for i in range(len(text) - 2)])


def _needs(items) -> object:
    """What all of a sequence's runs of plain characters need, and what its groups and repeats need in themselves."""
    runs, parts = [""], []

    def cut() -> None:
        parts.append(_any([_of(r) for r in runs]))
        runs[:] = [""]

    for op, value in items:
        spelled = None
        if op is sre.LITERAL:
            spelled = [chr(value)]
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value) and len(value) <= SPELLED:
            spelled = [chr(v) for _, v in value]
        if spelled and len(runs) * len(spelled) <= 16 and all(c.isascii() and c != "\n" and c not in "kKsS" for c in spelled):
            runs[:] = [r + c.lower() for r in runs for c in dict.fromkeys(x.lower() for x in spelled)]
            continue
        cut()
        if op is sre.BRANCH:
            parts.append(_any([_needs(b) for b in value[1]]))
        elif op is sre.SUBPATTERN:
            parts.append(_needs(value[-1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
            parts.append(_needs(value[2]))
        elif op is sre.ATOMIC_GROUP:
            parts.append(_needs(value))
    cut()
    return _all(parts)


def needed(pattern: str) -> object:
    """The trigrams without which a pattern can't match, as and/or of them; None if it may match without any.

    A character that other letters fold to (k and s, for which there are signs outside ASCII) ends a run, so that a search
    without regard to case loses nothing.
    """
    return _needs(parser.parse(pattern))


def _names(plan: object) -> list[str]:
    if plan is None:
        return []
    return [plan] if isinstance(plan, str) else list(dict.fromkeys(t for p in plan[1] for t in _names(p)))


def _holds(plan: object, has: dict[str, Column]) -> Column:
    if isinstance(plan, str):
        return has[plan]
    parts = [_holds(p, has) for p in plan[1]]
    return reduce(lambda a, b: a & b if plan[0] == "and" else a | b, parts)


def _code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


def index(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """Postings (trigram, path): each trigram of ASCII characters in a text, in lower case, once a text.

    Trigrams are sorted within partitions by range, so that a look-up reads the row groups that may hold what it asks for.
    A trigram of every text is as many rows as there are texts, in several partitions. Null texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.int32)
        for batch in batches:
            at, codes = [], []
            for i, value in enumerate(batch.column("text")):
                data = fold[np.frombuffer((value.as_py() or "").encode(), np.uint8)]
                if len(data) > 2:
                    plain = (data < 128) & (data != 10)
                    own = (data[:-2] << 16 | data[1:-1] << 8 | data[2:])[plain[:-2] & plain[1:-1] & plain[2:]]
                    own = np.unique(own)
                    at.append(np.full(len(own), i)), codes.append(own)
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes), pa.int32()), batch.column("path").take(pa.array(np.concatenate(at)))], names=["trigram", "path"])

    postings = files.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(run, f"trigram int, path {dict(files.dtypes)[path]}")
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartitionByRange(parts, "trigram", "path").sortWithinPartitions("trigram", "path")


def candidates(postings: DataFrame, pattern: str) -> DataFrame | None:
    """Paths of the texts that a pattern may match by their trigrams; None where the pattern needs none, so all may."""
    plan = needed(pattern)
    if plan is None:
        return None
    names = _names(plan)
    found = postings.where(F.col("trigram").isin([_code(t) for t in names]))
    has = found.groupBy("path").agg(*[F.bool_or(F.col("trigram") == _code(t)).alias(f"t{i}") for i, t in enumerate(names)])
    return has.where(_holds(plan, {t: F.col(f"t{i}") for i, t in enumerate(names)})).select("path")


def search(files: DataFrame, postings: DataFrame, pattern: str, ignore_case: bool = True) -> DataFrame:
    """All lines (path, line, content) of files(path, content) that match a pattern, in candidates alone.

    Few candidates are pushed into the scan as a list of ids, which passes over row groups and pages where files are sorted
    by path; more are joined. A pattern that isn't a regular expression of Python's is an error.
    """
    re.compile(pattern)
    own = files.select("path", "content")
    some = candidates(postings, pattern)
    if some is not None:
        some = written(some, "candidates")
        few = [r.path for r in some.limit(PUSHED + 1).collect()]
        own = own.where(F.col("path").isin(few)) if 0 < len(few) <= PUSHED else own.where(F.lit(False)) if not few else own.join(some, "path", "left_semi")
    return matches(lines_of(own), f"(?iu){pattern}" if ignore_case else pattern)
