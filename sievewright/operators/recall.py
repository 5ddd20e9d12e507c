"""Recall of evidence: locator scores, pruning, grep over lines, span bonuses, knowledge search, claim observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms

# What each kind of match is worth.
EXACT_PATH, EXACT_SYMBOL, SYMBOL_MENTIONED, PATH_MENTIONED, NEIGHBOUR, FILE_HIT, SPAN_HIT = 80, 100, 55, 45, 7, 20, 45
IN_SYMBOL, IN_PATH, IN_SIGNATURE = 15, 9, 5
#: Order in which observations are kept when a budget is short.
OBSERVATIONS = ("challenge-signal", "support-signal", "counter-context-found", "evidence-found", "checked-no-match", "incomplete")


def scored(locators: DataFrame, query: str) -> DataFrame:
    """locators(path, symbol, signature, neighbour) with their score for a query, and the reasons in short."""
    q = " ".join(query.strip().lower().split())
    path, symbol, signature = (F.lower(F.coalesce(c, F.lit(""))) for c in ("path", "symbol", "signature"))
    # a symbol is mentioned where no word character touches it
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.replace(symbol, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9_])"))
    mentioned = (symbol != "") & F.contains(F.lit(q), symbol) & F.regexp_like(F.lit(q), quoted)
    terms = query_terms(F.lit(query))
    points = lambda hit, n: F.when(hit, float(n)).otherwise(0.0)
    by_terms = F.aggregate(terms, F.lit(0.0), lambda a, t: a + points(F.contains(symbol, t), IN_SYMBOL) + points(F.contains(path, t), IN_PATH) + points(F.contains(signature, t), IN_SIGNATURE))
    known = F.lit(bool(q))
    flags = {"exact_path": known & (path == q), "exact_symbol": known & (symbol != "") & (symbol == q), "symbol_mentioned": mentioned, "path_mentioned": (path != "") & F.contains(F.lit(q), path)}
    out = locators.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    base = points(F.col("exact_path"), EXACT_PATH) + points(F.col("exact_symbol"), EXACT_SYMBOL) + points(F.col("symbol_mentioned"), SYMBOL_MENTIONED) + points(F.col("path_mentioned"), PATH_MENTIONED) + by_terms
    near = F.col("neighbour") if "neighbour" in locators.columns else F.lit(False)
    return out.withColumn("score", base).withColumn("score", F.col("score") + points((F.col("score") > 0) & near, NEIGHBOUR))


def with_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Scored locators with what text hits(path, line) add: some for the file, more if a line lies in the span. Of a file's
    hits, the first three are kept with it (`lines`); spans meet hits in a join by path and line, whatever their number."""
    hits = hits.select("path", "line").distinct()
    nth = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    lines = hits.withColumn("__n", nth).where("__n <= 3").groupBy("path").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    place = ["path", "start_line", "end_line"]
    spans = rows.where(F.col("kind") == "symbol").select(*place).distinct().alias("s")
    spans = spans.join(hits.alias("h"), (F.col("s.path") == F.col("h.path")) & F.col("h.line").between(F.col("s.start_line"), F.col("s.end_line")), "left_semi")
    out = rows.join(lines, "path", "left").join(spans.withColumn("__span", F.lit(True)), place, "left")
    out = out.withColumns({"text_hit": F.col("lines").isNotNull(), "span_hit": F.coalesce("__span", F.lit(False)) & (F.col("kind") == "symbol")}).drop("__span")
    bonus = F.when(F.col("text_hit"), float(FILE_HIT)).otherwise(0.0) + F.when(F.col("span_hit"), float(SPAN_HIT)).otherwise(0.0)
    return out.withColumn("score", F.col("score") + bonus)


def pruned(rows: DataFrame) -> DataFrame:
    """Scored locators without those of little signal next to the best, and files of which a symbol was hit exactly.

    The best score and whether there was any text hit are one row, joined by a cross join of one row with the rest.
    """
    rows = rows.where("score > 0")
    top = rows.agg(F.max("score").alias("__top"), F.bool_or("text_hit").alias("__hit"))
    floor = F.when(F.col("__top") >= 80, F.greatest(F.lit(30.0), F.col("__top") * 0.25)).when(F.col("__hit"), float(FILE_HIT)).otherwise(0.0)
    kept = rows.crossJoin(F.broadcast(top)).where(F.col("score") >= floor).drop("__top", "__hit")
    precise = kept.where((F.col("kind") == "symbol") & (F.col("exact_symbol") | F.col("symbol_mentioned") | F.col("span_hit"))).select("path").distinct().withColumn("__precise", F.lit(True))
    return kept.join(precise, "path", "left").where(~((F.col("kind") == "file") & F.coalesce("__precise", F.lit(False)) & ~F.col("exact_path"))).drop("__precise")


def lines_of(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """Each line of each file with its number, from 1."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n", "content")).select("path", (F.col("n") + 1).alias("line"), "content")


def matches(lines: DataFrame, pattern: str) -> DataFrame:
    """All lines with a match: what scores are worked out from."""
    return lines.where(F.col("content").rlike(pattern))


def grep(lines: DataFrame, pattern: str, per_file: int = 3, most: int = 80) -> DataFrame:
    """Lines with a match: the first `per_file` of a file, of at most `most` files, `most` lines in all (a report)."""
    hits = matches(lines, pattern)
    first = hits.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where(F.col("nth") <= per_file)
    return first.orderBy("path", "line").limit(most).drop("nth")


def knowledge(docs: DataFrame, query: str, top: int = 8) -> DataFrame:
    """docs(path, text) by the number of times that a query's terms stand in them: the best, with where the first is."""
    import re

    terms = [t.lower() for t in re.findall(r"[A-Za-z0-9_.$:/-]{2,}|[一-鿿]{2,}", query)]
    hay = F.lower(F.concat_ws("\n", "path", "text"))
    counts = [((F.length(hay) - F.length(F.replace(hay, F.lit(t), F.lit("")))) / len(t)).cast("long") for t in terms]
    score = sum(counts[1:], counts[0]) if counts else F.lit(0).cast("long")
    places = [F.nullif(F.instr(F.lower("text"), t), F.lit(0)) for t in terms]
    first = F.coalesce(F.least(*places, places[0]) if places else F.lit(1), F.lit(1))
    out = docs.withColumns({"score": score, "first_at": first}).where("score > 0")
    snippet = F.substring(F.col("text"), F.greatest(F.lit(1), F.col("first_at") - 220), F.least(F.lit(220), F.col("first_at") - 1) + 900)
    return out.withColumn("snippet", snippet).orderBy(F.desc("score"), "path").limit(top)


def observation(mode: Column, matches: Column, complete: Column) -> Column:
    """What a search for a claim's requirement shows, by what the requirement is for."""
    hit = matches > 0
    return (
        F.when((mode == "challenge-if-match") & hit, "challenge-signal").when((mode == "challenge-if-no-match") & complete & ~hit, "challenge-signal")
        .when((mode == "support-if-match") & hit, "support-signal").when((mode == "counter-context") & hit, "counter-context-found")
        .when(hit, "evidence-found").when(complete, "checked-no-match").otherwise("incomplete")
    )


def observe(requirements: list[tuple[str, str, str]], texts: DataFrame) -> DataFrame:
    """Observations of requirements (id, mode, pattern) over texts(path, text): all are searched in one scan.

    Matches are counted by a conditional sum for each requirement, so the texts are read once and one row of sums is
    shuffled from each task.
    """
    sums = texts.agg(*[F.count_if(F.col("text").rlike(p)).alias(f"m{i}") for i, (_, _, p) in enumerate(requirements)])
    rows = F.array(*[F.struct(F.lit(r).alias("requirement_id"), F.lit(m).alias("mode"), F.col(f"m{i}").alias("match_count")) for i, (r, m, _) in enumerate(requirements)])
    return sums.select(F.explode(rows).alias("r")).select("r.*").withColumn("status", observation(F.col("mode"), F.col("match_count"), F.lit(True)))


def verification_status(observations: DataFrame) -> DataFrame:
    """One row: challenged if anything challenges, provisionally supported if something supports and all is complete."""
    counts = observations.agg(
        F.count_if(F.col("status") == "challenge-signal").alias("challenge"), F.count_if(F.col("status") == "support-signal").alias("support"), F.count_if(F.col("status") == "counter-context-found").alias("counter"),
        F.count_if(F.col("status") == "incomplete").alias("incomplete"),
    )
    status = F.when(F.col("challenge") > 0, "challenged").when((F.col("support") > 0) & (F.col("incomplete") == 0), "provisionally-supported").otherwise("inconclusive")
    return counts.withColumn("status", status)
