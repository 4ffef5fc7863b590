"""Evaluation: route accuracy, hit rate, lexical faithfulness, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import text as X


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of the answer's distinct tokens that the context has; null if either has none."""
    a, b = (F.array_distinct(X.tokens(F.lower(c))) for c in (answer, context))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a))


def route_matches(expected: Column, got: Column) -> Column:
    """Whether two '+'-joined routes name the same branches."""
    parts = lambda c: F.array_sort(F.array_distinct(F.transform(F.split(c, "\\+"), F.trim)))
    return parts(expected) == parts(got)


def summary(rows: DataFrame, ok: Column, hit: Column, score: Column, failed: Column) -> DataFrame:
    """One row of counts, percentages (one decimal) and the mean score (four); nulls don't count."""
    pct = lambda c: F.bround(100 * F.count_if(c) / F.count(c), 1)
    return rows.agg(
        F.count("*").alias("runs"), F.count_if(failed).alias("failed"), F.count_if(ok).alias("right"), pct(ok).alias("route_accuracy"),
        pct(hit).alias("hit_rate"), F.bround(F.avg(score), 4).alias("faithfulness"),
    )


def markdown(row: dict) -> str:
    """A summary's row as a report."""
    return "\n".join(["# Evaluation", "", "| measure | value |", "|-|-|", *(f"| {k} | {'-' if v is None else v} |" for k, v in row.items())]) + "\n"


def selected(queries: DataFrame, ids: list[str] | None = None, limit: int | None = None, key: str = "id") -> DataFrame:
    """The queries of a run: those named, the first ``limit`` of them by id."""
    chosen = queries if ids is None else queries.where(F.col(key).isin(ids))
    return chosen if limit is None else chosen.orderBy(key).limit(limit)


def run(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Each query with its result and what it is worth.

    ``queries``: id, query, expected_route, ground_truth; ``results``: id, route, answer, chunks (an array of texts), error.
    A query without a result counts as failed. A hit is asked for only where retrieval was expected.
    """
    met = queries.join(results, "id", "left")
    chunks = F.coalesce("chunks", F.array().cast("array<string>"))
    failed = F.col("error").isNotNull() | F.col("route").isNull()
    rag = F.array_contains(F.split("expected_route", "\\+"), "rag")
    return met.select(
        "id", "query", "expected_route", "route", F.when(~failed, route_matches(F.col("expected_route"), F.col("route"))).alias("route_correct"), F.size(chunks).alias("n_chunks"),
        F.when(rag & ~failed, F.size(chunks) > 0).alias("hit"), F.length(F.coalesce("answer", F.lit(""))).alias("answer_chars"),
        faithfulness(F.col("answer"), F.array_join(chunks, " ")).alias("faithfulness"), F.when(failed, F.coalesce("error", F.lit("no result"))).alias("error"), "ground_truth",
    )
