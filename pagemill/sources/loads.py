"""Loading a batch into a content table, with per-row outcome and job log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MODES = ("create", "update", "upsert", "skip_duplicates")


def load_outcomes(target: DataFrame, batch: DataFrame, key: str, order: str, mode: str) -> DataFrame:
    """``order, key, status, error_message`` per batch row.

    A key repeated inside the batch is written once by its first row; what later rows get
    follows the mode, as if the first were already in the table.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    rows = batch.select(F.col(order).alias("row_index"), F.col(key).alias("slug"))
    firsts = rows.groupBy("slug").agg(F.min("row_index").alias("_first"))
    have = target.select(F.col(key).alias("slug"), F.lit(True).alias("_exists"))
    marked = firsts.join(have, "slug", "left").select("slug", "_first", F.coalesce("_exists", F.lit(False)).alias("_exists"))
    joined = rows.join(marked, "slug", "left")
    exists = F.col("_exists")
    known = exists | (F.col("row_index") != F.col("_first"))
    status = {
        "create": F.when(known, "failed").otherwise("created"),
        "skip_duplicates": F.when(known, "skipped").otherwise("created"),
        "upsert": F.when(known, "updated").otherwise("created"),
        "update": F.when(exists, "updated").otherwise("failed"),
    }[mode]
    blank = F.col("slug").isNull() | (F.col("slug") == "")
    status = F.when(blank, "failed").otherwise(status)
    text = F.when(blank, "Missing key").when(
        status == "failed", F.lit("Already exists" if mode == "create" else "Not found")
    )
    return joined.select("row_index", "slug", status.alias("status"), text.alias("error_message"))


def written_rows(batch: DataFrame, outcomes: DataFrame, key: str, order: str) -> DataFrame:
    """The last written row of each created or updated key."""
    written = outcomes.where(F.col("status").isin("created", "updated")).select(F.col("row_index").alias("_ri"))
    rows = batch.join(written, batch[order] == F.col("_ri"), "left_semi")
    rest = [c for c in batch.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(*[F.col(key) if c == key else F.col(f"_r.`{c}`").alias(c) for c in batch.columns])


def load_target(target: DataFrame, batch: DataFrame, outcomes: DataFrame, key: str, order: str) -> DataFrame:
    """Target table after the load: survivors, plus the written rows."""
    new = written_rows(batch, outcomes, key, order).select(*target.columns)
    return target.join(new.select(key), key, "left_anti").select(*target.columns).unionByName(new)


def job_items(outcomes: DataFrame, job_id: Column) -> DataFrame:
    return outcomes.select(
        job_id.alias("import_job_id"), "row_index", "status", "error_message", F.sha2(F.coalesce("slug", F.lit("")), 256).alias("entity_id"), "slug"
    )


def job_row(
    items: DataFrame, template: str, recipe_json: str = "{}", mode: str | None = None, source_type: str | None = None,
    recipe_id: str | None = None, created_at: Column | None = None,
) -> DataFrame:
    """Job rows with their counters and when and how they ran, the recipe kept as a snapshot. ``created_at`` defaults to now."""
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(f"{status}_count")

    return items.groupBy("import_job_id").agg(
        F.count("*").alias("total_records"), n("created"), n("updated"), n("skipped"), n("failed")
    ).select(
        F.col("import_job_id").alias("id"), F.lit(template).alias("template_type"), F.lit("completed").alias("status"),
        F.lit(mode).cast("string").alias("import_mode"), F.lit(source_type).cast("string").alias("source_type"),
        F.lit(recipe_id).cast("string").alias("recipe_id"), (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        "total_records", "created_count", "updated_count", "skipped_count", "failed_count", F.lit(recipe_json).alias("recipe_json"),
    )


def job_counters(items: DataFrame) -> DataFrame:
    """Status counts per job as columns."""
    counted = items.groupBy("import_job_id").pivot("status", ["created", "updated", "skipped", "failed"]).count()
    return counted.na.fill(0)


def jobs_with_items(jobs: DataFrame, items: DataFrame) -> DataFrame:
    return jobs.join(items.withColumnRenamed("status", "item_status"), jobs["id"] == items["import_job_id"], "left")


def recent_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc_nulls_first("created_at"), "id").limit(limit)

