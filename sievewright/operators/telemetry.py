"""Roll-ups of run telemetry, provider health, traces, budgets and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens


def summary(events: DataFrame, by: str = "run_id") -> DataFrame:
    """events(run_id, node_id, status, input_tokens, output_tokens, cost_usd, latency_ms) of workers, by run."""
    cost = F.when(F.count("cost_usd") == 0, "unreported").when(F.count("cost_usd") == F.count("*"), "complete").otherwise("partial")
    return events.groupBy(by).agg(
        F.count_distinct("node_id").alias("workers"), F.count("*").alias("attempts"), F.count_if(F.col("status") == "ok").alias("succeeded"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("latency_ms"), 2).alias("latency_ms"), F.count("cost_usd").alias("cost_samples"), cost.alias("cost_completeness"),
    )


def health(calls: DataFrame) -> DataFrame:
    """calls(provider, success, latency_ms): success rate, mean latency, health (null before three calls), penalty."""
    out = calls.groupBy("provider").agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"), F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"))
    rate = F.round(F.col("successes") / F.col("attempts"), 4)
    enough = F.col("attempts") >= 3
    return out.withColumns({"success_rate": rate, "healthy": F.when(enough, rate >= 0.5), "penalty": F.when(enough, F.round((1 - rate) * 20, 4)).otherwise(0.0)})


def replay(events: DataFrame) -> DataFrame:
    """Number of events of each kind."""
    return events.groupBy("kind").agg(F.count("*").alias("events"))


def economics(tokens_in: Column, tokens_out: Column, base_in: Column, base_out: Column) -> Column:
    """Struct of a run's total tokens, their multiple of the baseline's, and the savings."""
    total, base = tokens_in + tokens_out, base_in + base_out
    return F.struct(total.alias("total_tokens"), F.round(total / F.greatest(F.lit(1), base), 4).alias("amplification"), (base - total).alias("net_savings"))


def budget_status(uses: DataFrame, limits: DataFrame) -> DataFrame:
    """uses(resource, amount) against limits(resource, most): used up once the limit is reached."""
    used = uses.groupBy("resource").agg(F.sum("amount").alias("used"))
    return limits.join(used, "resource", "left").fillna(0, ["used"]).withColumn("exceeded", F.col("used") >= F.col("most"))


def usage(blocks: DataFrame, answer: Column) -> DataFrame:
    """blocks(identifiers, tokens) with whether an answer names any of their identifiers."""
    return blocks.withColumn("used", F.exists("identifiers", lambda i: (i != "") & F.contains(F.lower(answer), F.lower(i))))


def recall_quality(gold: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """gold(case, id) against active(case, id) before and after recall: found shares, and what stayed filtered."""
    tag = lambda df, name: df.select("case", "id").distinct().withColumn(name, F.lit(1))
    rows = tag(gold, "g").join(tag(before, "b"), ["case", "id"], "left").join(tag(after, "a"), ["case", "id"], "left")
    out = rows.groupBy("case").agg(F.count("*").alias("gold"), F.count("b").alias("found_before"), F.count(F.coalesce("b", "a")).alias("found_after"))
    return out.withColumns({"recall_before": F.round(F.col("found_before") / F.col("gold"), 4), "recall_after": F.round(F.col("found_after") / F.col("gold"), 4)})


def evaluate_answer(answer: Column, required: list[str], forbidden: list[str]) -> Column:
    """Struct of missing and forbidden texts that an answer has, and whether it passes."""
    text = F.lower(F.coalesce(answer, F.lit("")))
    pick = lambda terms, has: F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t.lower())) == has, t) for t in terms])) if terms else F.array().cast("array<string>")
    missing, found = pick(required, False), pick(forbidden, True)
    return F.struct(missing.alias("missing"), found.alias("forbidden"), ((F.size(missing) == 0) & (F.size(found) == 0)).alias("passed"))


def reported_usage(reported_in: Column, reported_out: Column, request: Column, payload: Column) -> Column:
    """Struct of a call's tokens: as reported where that is a number from 0 on, else estimated from the text."""
    told = lambda c: c.isNotNull() & (c >= 0)
    source = lambda c: F.when(told(c), "provider-reported").otherwise("estimated")
    a, b = F.when(told(reported_in), reported_in).otherwise(estimated_tokens(request)), F.when(told(reported_out), reported_out).otherwise(estimated_tokens(payload))
    return F.struct(a.alias("input_tokens"), b.alias("output_tokens"), (a + b).alias("total_tokens"), source(reported_in).alias("input_tokens_source"), source(reported_out).alias("output_tokens_source"))


def planes(data: Column, whole: Column) -> Column:
    """Struct of a request's tokens that carry data, and those that carry control; never below 0."""
    d, w = estimated_tokens(data), estimated_tokens(whole)
    return F.struct(F.least(d, w).alias("data_plane"), F.greatest(F.lit(0), w - d).alias("control_plane"), w.alias("total"))


def ratios(valid: Column, duplicates: Column, output: Column, contradictions: Column) -> Column:
    """Struct of the shares of duplicates and contradictions of a reduction, at most 1."""
    share = lambda a, b: F.least(F.lit(1.0), a / F.greatest(F.lit(1), b))
    return F.struct(share(duplicates, valid).alias("duplicate_ratio"), share(contradictions, output).alias("conflict_ratio"))
