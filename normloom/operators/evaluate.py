"""Evaluation against labels: confusion, precision and recall, set scores, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """Counts, precision, recall and F1 of boolean ``predicted`` against ``expected``; a null prediction is false."""
    p, e = F.coalesce("predicted", F.lit(False)), F.col("expected")
    counts = rows.groupBy(*by).agg(F.count_if(p & e).alias("tp"), F.count_if(p & ~e).alias("fp"), F.count_if(~p & e).alias("fn"), F.count_if(~p & ~e).alias("tn"))
    precision, recall = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": F.round(precision, 6), "recall": F.round(recall, 6), "f1": F.round(rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)})


def set_scores(expected: Column, found: Column) -> Column:
    """Precision, recall and F1 of two arrays as sets; all 1 if both are empty."""
    e, f = F.array_distinct(expected), F.array_distinct(found)
    hit, one = F.size(F.array_intersect(e, f)), F.lit(1.0)
    empty = (F.size(e) == 0) & (F.size(f) == 0)
    score = lambda of: F.when(empty, one).otherwise(rate(hit, of))
    return F.struct(score(F.size(f)).alias("precision"), score(F.size(e)).alias("recall"), F.when(empty, one).otherwise(rate(2.0 * hit, F.size(e) + F.size(f))).alias("f1"))


def macro(rows: DataFrame, score: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(f"{score}.precision"), 6).alias("precision"), F.round(F.avg(f"{score}.recall"), 6).alias("recall"), F.round(F.avg(f"{score}.f1"), 6).alias("f1"))


def span_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two ``start, end`` spans."""
    shared = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    return shared / F.greatest(F.lit(1), F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"]))


def core_field_accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """Shares of ``rows`` whose actor sets meet (in lower case) and whose action, object and deadline equal the expected ones,
    and the mean of actor, action and object. Columns: ``actor, action, object, deadline`` and each with ``expected_`` before it."""
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6)
    made = rows.groupBy(*by).agg(
        share(F.arrays_overlap(low("actor"), low("expected_actor"))).alias("actor"), share(plain("action") == plain("expected_action")).alias("action"),
        share(plain("object") == plain("expected_object")).alias("object"), share(F.col("deadline").eqNullSafe(F.col("expected_deadline"))).alias("deadline"),
    )
    return made.withColumn("core", F.round((F.col("actor") + F.col("action") + F.col("object")) / 3, 6))


def competency(results: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id, correct``: a query is right if its count, status, path length and text presence are as expected.

    ``results(query_id, review_status, path_length, verbatim_text)`` has a row for each path found.
    """
    got = results.groupBy("query_id").agg(F.count("*").alias("n"), F.min("review_status").alias("status"), F.min("path_length").alias("length"), F.bool_and(F.coalesce("verbatim_text", F.lit("")) != "").alias("text"))
    joined = expected.join(got, "query_id", "left")
    right = (F.coalesce("n", F.lit(0)) == F.col("count")) & ((F.col("count") == 0) | (F.col("status").eqNullSafe(F.col("review_status")) & F.col("length").eqNullSafe(F.col("path_length")) & F.col("text").eqNullSafe(F.col("verbatim_text_nonempty"))))
    return joined.select("query_id", right.alias("correct"))


def chain_rates(rows: DataFrame, *by: str) -> DataFrame:
    """Of ``rows(passed, resolved)``: attempts, the share that passed, resolved, and the integrity rate, the lesser of the two."""
    made = rows.groupBy(*by).agg(F.count("*").alias("attempts"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("success"), F.round(F.avg(F.col("resolved").cast("int")), 6).alias("resolves"))
    return made.withColumn("integrity", F.least("success", "resolves"))


def labelled(labels: DataFrame, predictions: DataFrame, key: str = "path") -> DataFrame:
    """``labels`` with ``predicted``: what ``predictions(key, predicted)`` say of the same path, false where they say nothing."""
    return labels.join(predictions.select(key, "predicted"), key, "left").withColumn("predicted", F.coalesce("predicted", F.lit(False)))


def shares(rows: DataFrame, conditions: dict[str, Column], *by: str) -> DataFrame:
    """The share of rows for which each condition holds; a null does not."""
    return rows.groupBy(*by).agg(*[F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6).alias(name) for name, c in conditions.items()])
