"""Mixing sources to target weights by a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unrepeated, word_count, written

#: A source's weight over training time, from 0 to 1: knots (time, relative weight), linear between them. Sources in
#: code-point order take these in turn: falling, level, rising.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Hex digits of the order key by which a source is dealt into buckets (16**3 of them a source).
BUCKET_DIGITS = 3


def _segments(knots) -> list[tuple[float, float, float, float, float]]:
    """(start, width, weight at start, slope, integral before), with the whole integral scaled to 1."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((t0, t1 - t0, w0 / area, (w1 - w0) / (t1 - t0) / area, before))
        before += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def time_of(share: Column, knots) -> Column:
    """Inverse of the schedule's integral: the time by which the given share of the source's tokens is demanded."""
    out = None
    for t0, _, w, k, before in reversed(_segments(knots)):
        rest = share - F.lit(before)
        t = F.lit(t0) + (rest / F.lit(w) if k == 0 else (F.sqrt(F.lit(w * w) + F.lit(2 * k) * rest) - F.lit(w)) / F.lit(k))
        out = t if out is None else F.when(share < F.lit(upper), t).otherwise(out)
        upper = before
    return out


def demand_by(time: Column, knots) -> Column:
    """The schedule's integral up to a time."""
    out = None
    for t0, _, w, k, before in reversed(_segments(knots)):
        x = time - F.lit(t0)
        y = F.lit(before) + F.lit(w) * x + F.lit(k / 2) * x * x
        out = y if out is None else F.when(time < F.lit(upper), y).otherwise(out)
        upper = t0
    return out


def plan(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, schedules=SCHEDULES) -> DataFrame:
    """How much of each document the mix takes, and where in training its first copy stands.

    Sources in code-point order, null last, weigh `weights` in turn and share the sum of all sizes in words; a target
    above max_epochs times its source's size stops there and the rest is shared again by weight. Within a source,
    documents follow the md5 of their id: each is taken quota div source_size times in full, and those before the
    remaining quota once more, the one at its edge in part. So a source's words equal its rounded target.

    A copy's share of the source's demand goes through the inverse of the source's integrated schedule to a time, and
    the demand of all sources up to that time is its position in words.

    Running sums are two-level: per (source, bucket of the key) first, then within a bucket, so that a source with a
    third of all rows is spread over 16**BUCKET_DIGITS windows. Only the table of distinct sources meets in one task.

    Null text: size 0. Null source: a source of its own. Repeated rows: each counts. No rows: no rows. Sources with no
    words have target 0. What isn't taken has no position. Other columns of docs are ignored. Returns doc_id, source, size, source_size, target, quota,
    pattern, before, taken, position.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
    sized = written(sized.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)), "mix")
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sources = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("rank", F.row_number().over(every) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.select("source", "source_size", weight.alias("weight"), (F.col("rank") % len(schedules)).alias("pattern"), "rank", (max_epochs * F.col("source_size")).alias("most"))
    # Filled like vessels: in order of most / weight, the first source that the level of the rest doesn't reach ends it.
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    total = F.sum("source_size").over(Window.partitionBy())
    filled = F.sum("most").over(by_level) - F.col("most")
    level = (total - filled) / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), F.col("rank"), F.col("level")))
    sources = sources.withColumn("found", F.min(fits).over(Window.partitionBy())["level"])
    sources = sources.withColumn("target", F.least(F.col("most").cast("double"), F.col("found") * F.col("weight")))
    sources = sources.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    per_pattern = F.array(*[F.coalesce(F.sum(F.when(F.col("pattern") == i, F.col("quota"))).over(Window.partitionBy()), F.lit(0)).cast("double") for i in range(len(schedules))])
    sources = sources.withColumn("quotas", per_pattern).select("source", "source_size", "target", "quota", "pattern", "quotas")

    prior = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("source", "bucket", F.coalesce(F.sum("words").over(prior), F.lit(0)).alias("prior"))
    same = lambda a, b, *cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    buckets = buckets.alias("b").join(sources.alias("s"), same("b", "s", "source")).select("b.*", "source_size", "target", "quota", "pattern", "quotas")
    out = sized.alias("d").join(buckets.alias("b"), same("d", "b", "source", "bucket")).select("d.*", "prior", "source_size", "target", "quota", "pattern", "quotas")
    here = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("before", F.col("prior") + F.sum("size").over(here) - F.col("size"))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("quota") - times * F.col("source_size") - F.col("before")
    out = out.withColumn("taken", times * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(rest, F.col("size"))))
    at = F.when((F.col("taken") > 0) | (F.col("size") == 0), position(F.col("before"), schedules))
    return out.withColumn("position", at).select("doc_id", "source", "size", "source_size", "target", "quota", "quotas", "pattern", "before", "taken", "position")


def position(before: Column, schedules=SCHEDULES) -> Column:
    """Words of the whole mix that stand before a copy which follows `before` words of its source's quota."""
    share = F.when(F.col("quota") > 0, F.least(F.lit(1.0), before / F.col("quota"))).otherwise(0.0)
    time = None
    for i, knots in enumerate(schedules):
        time = time_of(share, knots) if time is None else F.when(F.col("pattern") == i, time_of(share, knots)).otherwise(time)
    words = None
    for i, knots in enumerate(schedules):
        part = F.col("quotas")[i] * demand_by(time, knots)
        words = part if words is None else words + part
    return F.floor(words + 1e-6).cast("long")


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, schedules=SCHEDULES) -> DataFrame:
    """The mix itself, range-sorted by position: a row of docs for each copy taken, the last copy cut to the words taken.

    Columns are those of docs, whatever they are; n_chars, where there is one, follows a cut text. A document of size 0
    is taken once (it costs no words). A cut copy keeps the white space between its words. Repeated doc_ids are taken
    row by row.

    Positions run from 0 to the sum of words taken, so the ranges of the sort follow from that alone: rows go straight
    to the partition of their range, without a sample of the data. Texts move twice: to meet the plan, and to be sorted.
    """
    spark, cols, once = docs.sparkSession, docs.columns, unrepeated(docs)
    todo = plan(docs, weights, max_epochs, schedules)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int")
    # rows of one doc_id are numbered, so that each meets one row of the plan
    todo = todo.withColumn("__n", F.lit(1) if once else F.row_number().over(Window.partitionBy("doc_id", "source").orderBy("size", "before")))
    todo = todo.withColumn("__copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    todo = todo.select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), "__n", "__copy", F.col("size").alias("__size"), F.least(F.col("size"), F.col("taken") - F.col("__copy") * F.col("size")).alias("__words"),
        position(F.col("before") + F.col("__copy") * F.col("source_size"), schedules).alias("__at"),
    )
    todo = written(todo, "copies")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = (todo.agg(F.max("__at")).first()[0] or 0) + 1
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    if not once:
        nth = F.row_number().over(Window.partitionBy("doc_id", "source").orderBy(word_count(F.col("text")), F.xxhash64("text")))
        docs = docs.withColumn("__nth", nth)
        same = same & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__nth") == F.col("__n"))
    rows = docs.join(todo, same)
    less = F.col("__words") < F.col("__size")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    rows = rows.withColumn("text", F.when(less, F.array_join(F.slice(pieces, 1, F.greatest(F.col("__words"), F.lit(1)).cast("int")), "")).otherwise(F.col("text")))
    if "n_chars" in cols:
        rows = rows.withColumn("n_chars", F.when(less, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    rows = rows.repartitionById(ranges, F.floor(F.col("__at") * ranges / most).cast("int"))
    return rows.sortWithinPartitions("__at", "doc_id", "__copy").select(*cols)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = written(plan(docs).select("doc_id", "size", "source_size", "target", "taken", "position"), "mix-plan")
    return out.orderBy("position", "doc_id")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, (rank % 3 + 1)::DOUBLE AS weight, 3 * source_size AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - (sum(most) OVER o - most))::DOUBLE / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, most::DOUBLE / weight AS ratio
      FROM w WINDOW o AS (ORDER BY most::DOUBLE / weight, rank)),
f AS (SELECT arg_min(level, row(ratio, rank)) AS level FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, rank, least(most::DOUBLE, f.level * weight) AS target FROM l, f),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM t),
g AS (SELECT sum(quota) FILTER (rank % 3 = 0)::DOUBLE AS q0, coalesce(sum(quota) FILTER (rank % 3 = 1), 0)::DOUBLE AS q1, coalesce(sum(quota) FILTER (rank % 3 = 2), 0)::DOUBLE AS q2 FROM q),
c AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.quota, q.rank,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS bef
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS times, CASE WHEN quota > 0 THEN least(1.0::DOUBLE, bef::DOUBLE / quota) ELSE 0.0::DOUBLE END AS share FROM c),
p AS (SELECT *, CASE rank % 3 WHEN 0 THEN (sqrt(2.25::DOUBLE + -2.0::DOUBLE * share) - 1.5::DOUBLE) / -1.0::DOUBLE WHEN 1 THEN share
                ELSE (sqrt(0.25::DOUBLE + 2.0::DOUBLE * share) - 0.5::DOUBLE) / 1.0::DOUBLE END AS time FROM k)
SELECT doc_id, size, source_size, target,
       (times * size + greatest(0, least(quota - times * source_size - bef, size)))::BIGINT AS taken,
       CASE WHEN size = 0 OR times * size + greatest(0, least(quota - times * source_size - bef, size)) > 0 THEN floor(q0 * (1.5::DOUBLE * time + -0.5::DOUBLE * time * time) + q1 * time + q2 * (0.5::DOUBLE * time + 0.5::DOUBLE * time * time) + 1e-6::DOUBLE)::BIGINT END AS position
FROM p, g
"""
