"""Fill-in-middle: texts cut at two random units by a matcher that streams over each twice and keeps no units."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: A unit (any code point), the marks before prefix, suffix and middle, the draw of 100 from which a text
#: stays plain, and the one below which its suffix comes first.
UNIT, PREFIX, SUFFIX, MIDDLE, PLAIN_FROM, SPM_BELOW = r"(?s:.)", "<P>", "<S>", "<M>", 90, 20
MARKS = "<[PSM]>"
OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def units(unit: re.Pattern, text: str) -> int:
    """First pass: how many units match, from left to right. Each match is dropped before the next is made."""
    n = count()
    deque(zip(unit.finditer(text), n), maxlen=0)
    return next(n)


def ends(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where units `low` and `high` (low <= high, from 1; 0 is before all) end. One iterator of matches is
    advanced to the one, then on to the other, and no further."""
    found = unit.finditer(text)
    first = next(islice(found, low - 1, None)).end() if low else 0
    return first, next(islice(found, high - low - 1, None)).end() if high > low else first


def draws(key: Column) -> list[Column]:
    """Four numbers for each row: the first groups of eight digits in the sha256 of `1:` and its key; null is no key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _cutter(pattern: str):
    unit, marks = re.compile(pattern), re.compile(MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, form, prefix, middle, output = [], [], [], [], []
            for scalar, *h in zip(batch.column("text"), *(batch.column(f"h{i}").to_pylist() for i in (1, 2, 3, 4))):
                text = scalar.as_py() or ""
                all_units = units(unit, text)
                n.append(all_units)
                if not text or h[2] % 100 >= PLAIN_FROM or marks.search(text):
                    form.append("plain"), prefix.append(None), middle.append(None), output.append(text)
                    continue
                low, high = sorted((h[0] % (all_units + 1), h[1] % (all_units + 1)))
                a, b = ends(unit, text, low, high)
                spm = h[3] % 100 < SPM_BELOW
                first = (SUFFIX, text[b:], PREFIX, text[:a]) if spm else (PREFIX, text[:a], SUFFIX, text[b:])
                form.append("spm" if spm else "psm"), prefix.append(a), middle.append(b - a)
                output.append("".join((*first, MIDDLE, text[a:b])))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            made = [pa.array(x, kind) for x, kind in zip((n, form, prefix, middle, output), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", *(x.split()[0] for x in OUT.split(", "))])
        tidy()

    return run


def transform(docs: DataFrame, unit: str = UNIT) -> DataFrame:
    """Documents (doc_id, text) as doc_id, n, form, prefix_chars, middle_chars, output; each row by itself, in one pass
    without a shuffle.

    A text is n units, matches of `unit` from left to right (code points; a pattern for words or lines will do; what
    stands between matches belongs to the part after it). The prefix ends after the smaller of two ranks drawn by doc_id,
    the middle after the larger, the suffix is the rest. Beside the text, a worker holds one match at a time however
    long the text is. Plain texts are left as they are: empty ones, those that hold a mark, and the drawn share.

    Null texts count as empty. A null doc_id draws as an empty key. Repeated rows get equal results, each its own. No rows
    give no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *draws(F.col("doc_id"))).mapInArrow(_cutter(unit), f"doc_id {kind}, {OUT}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output came from. Marks begin and end with characters of their own, and a text that holds one is
    plain, so those found are those put in."""
    part = F.split(output, MARKS, -1)
    at = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    return F.when(form == "plain", output).otherwise(F.concat(*(F.when(form == "psm", part[a]).otherwise(part[b]) for a, b in zip(at["psm"], at["spm"]))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (n + 1) AS b,
             CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 AS e FROM d),
f AS (SELECT *, least(a, b) AS low, greatest(a, b) AS high,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, low) AS prefix, substring(t, low + 1, high - low) AS middle, substring(t, high + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
