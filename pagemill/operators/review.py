"""Review queue: filters, bulk decisions and counts over scored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ACTIVE = ["auto_approved", "approved", "edited"]
ERROR_BELOW = 0.3
LOW_BELOW = 0.8


def review_filter(mode: str, overall: Column, flags: Column) -> Column:
    """``all``, ``errors``, ``low_confidence`` or ``warnings``."""
    if mode == "errors":
        return overall < ERROR_BELOW
    if mode == "low_confidence":
        return (overall >= ERROR_BELOW) & (overall < LOW_BELOW)
    if mode == "warnings":
        return F.size(flags) > 0
    return F.lit(True)


def title_contains(title: Column, query: str) -> Column:
    return F.contains(F.lower(title), F.lit(query.lower())) if query.strip() else F.lit(True)


def is_active(status: Column) -> Column:
    return status.isin(ACTIVE)


def bulk_approve(status: Column, overall: Column) -> Column:
    return F.when((status == "needs_review") & (overall >= ERROR_BELOW), "approved").otherwise(status)


def bulk_skip(status: Column) -> Column:
    return F.when(status == "needs_review", "skipped").otherwise(status)


def apply_decisions(df: DataFrame, decisions: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Lay reviewers' decisions (``key, decision``) over the statuses.

    ``approve``, ``skip`` and ``edit`` set a status, ``reset`` puts a row back to review.
    """
    d = decisions.select(F.col(key).alias("_k"), F.col("decision").alias("_d"))
    new = (
        F.when(F.col("_d") == "approve", "approved").when(F.col("_d") == "skip", "skipped")
        .when(F.col("_d") == "edit", "edited").when(F.col("_d") == "reset", "needs_review").otherwise(F.col(status))
    )
    return df.join(d, df[key] == d["_k"], "left").withColumn(status, new).select(*df.columns)


def review_counts(df: DataFrame, status: str = "status", overall: str = "overall") -> DataFrame:
    s, o = F.col(status), F.col(overall)
    return df.agg(
        F.count_if(s == "auto_approved").alias("auto_approved"),
        F.count_if(s == "needs_review").alias("needs_review"),
        F.count_if(s == "approved").alias("approved"),
        F.count_if(s == "skipped").alias("skipped"),
        F.count_if((s == "needs_review") & (o < ERROR_BELOW)).alias("errors"),
    )


def confidence_summary(df: DataFrame, status: str = "status", overall: str = "overall") -> DataFrame:
    active = df.where(is_active(F.col(status)))
    return active.agg(
        F.avg(overall).alias("avg_confidence"), F.min(overall).alias("min_confidence"),
        F.max(overall).alias("max_confidence"), F.count("*").alias("n"),
    )
