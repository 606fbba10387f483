"""Reports over match results and mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.operators.relational import bucket_of


def match_report(df: DataFrame, conf: str, high: float) -> DataFrame:
    """One row: all, matched and high-confidence rows with percentages; none gives 0."""
    n, matched, sure = F.count("*"), F.count(conf), F.count(F.when(F.col(conf) >= high, 1))
    share = lambda k: F.when(n == 0, 0.0).otherwise(F.round(100.0 * k / n, 1))
    return df.agg(n.alias("n"), matched.alias("matched"), sure.alias("high"), share(matched).alias("matched_pct"), share(sure).alias("high_pct"))


def histogram(df: DataFrame, score: str) -> DataFrame:
    """``(bucket, cnt)`` by tenths of a score; null scores make a bucket of their own, empty ones have no row."""
    return df.groupBy(bucket_of(F.col(score)).alias("bucket")).agg(F.count("*").alias("cnt"))


def weighted_coverage(df: DataFrame, score: str, weight: str, threshold: float) -> DataFrame:
    """Share of the weight whose score reaches the threshold."""
    return df.agg((F.sum(F.when(F.col(score) >= threshold, F.col(weight)).otherwise(0)) / F.sum(weight)).alias("coverage"))
