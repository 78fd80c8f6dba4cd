"""Table expectations, revisions, and search-and-replace with audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.operators.joins import ranged

# The allowed values of enumerated columns.
ENUMS = {
    "pages.page_type": ["standard", "practice", "landing"],
    "pages.status": ["draft", "published"],
    "posts.status": ["draft", "published"],
    "templates.page_type": ["standard", "practice", "landing", "post"],
    "redirects.status_code": ["301", "302"],
    "cms_users.role": ["admin", "editor"],
    "import_jobs.template_type": ["practice", "post"],
    "import_jobs.source_type": ["csv", "api", "json"],
    "import_jobs.mode": ["create", "update", "upsert", "skip_duplicates"],
    "import_jobs.status": ["pending", "processing", "completed", "failed"],
    "import_job_items.status": ["pending", "created", "updated", "skipped", "failed"],
    "import_mapping_presets.template_type": ["practice", "post"],
    "import_migration_sessions.status": ["in_progress", "completed", "abandoned"],
}
# Media policy.
MEDIA_TYPES = ["image/jpeg", "image/png", "image/gif", "image/webp", "image/svg+xml", "application/pdf"]
MEDIA_MAX_BYTES = 52_428_800


def enum_violations(df: DataFrame, key: str, column: str, allowed: list) -> DataFrame:
    value = F.col(column).cast("string")
    return df.where(value.isNotNull() & ~value.isin([str(a) for a in allowed])).select(
        key, F.lit(column).alias("column"), value.alias("value")
    )


def null_violations(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    return df.select(key, F.explode(missing).alias("column"))


def unique_violations(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col("value").isNotNull())


def insert_if_absent(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Target plus the rows whose key it lacks."""
    return target.unionByName(rows.join(target.select(key), key, "left_anti").select(*target.columns))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def cascade_delete(parent: DataFrame, pk: str, child: DataFrame, fk: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parent and child without the keys in ``gone`` (one column, named ``pk``)."""
    dead = gone.select(F.col(pk).alias("_gone"))
    return (
        parent.join(dead, F.col(pk) == F.col("_gone"), "left_anti"),
        child.join(dead, F.col(fk) == F.col("_gone"), "left_anti"),
    )


def set_null_on_delete(child: DataFrame, fk: str, gone: DataFrame, pk: str) -> DataFrame:
    dead = gone.select(F.col(pk).alias("_gone"))
    joined = child.join(dead, F.col(fk) == F.col("_gone"), "left")
    return joined.withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk))).select(*child.columns)


def row_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns])), 256)


def stamp_updates(old: DataFrame, new: DataFrame, key: str, columns: list[str], now: Column) -> DataFrame:
    """New rows; ``updated_at`` moves only where a compared column changed."""
    before = old.select(F.col(key).alias("_k"), row_hash(columns).alias("_h"), F.col("updated_at").alias("_u"))
    joined = new.drop("updated_at").join(before, F.col(key) == F.col("_k"), "left")
    changed = F.col("_h").isNull() | (F.col("_h") != row_hash(columns))
    return joined.withColumn("updated_at", F.when(changed, now).otherwise(F.col("_u"))).drop("_k", "_h", "_u")


def assign_ids(existing: DataFrame, rows: DataFrame, column: str, order: str) -> DataFrame:
    """Next sequence values for new rows, by ``order``, without one global sort task.

    Rows are range-partitioned; each partition numbers its own rows after the sum of the
    partitions before it. Only the partition counts meet in one place.
    """
    top = existing.agg(F.coalesce(F.max(column), F.lit(0)).alias("top")).first()["top"]
    sorted_rows = ranged(rows, F.col(order))
    inside = Window.partitionBy("_pid").orderBy(order)
    numbered = sorted_rows.withColumn("_rn", F.row_number().over(inside))
    counts = sorted_rows.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = numbered.join(offsets, "_pid")
    return numbered.withColumn(column, F.lit(top) + F.col("_off") + F.col("_rn")).drop("_pid", "_rn", "_off")


def revision_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str], at: Column) -> DataFrame:
    """Snapshots of the rows whose compared columns changed, as they were before."""
    now = new.select(F.col(key).alias("_k"), row_hash(columns).alias("_h"))
    joined = old.join(now, F.col(key) == F.col("_k"))
    return joined.where(row_hash(columns) != F.col("_h")).select(key, *columns, at.alias("revised_at"))


def with_previous(df: DataFrame, key: str, order: str, columns: list[str], out: str = "_prev") -> DataFrame:
    """Add the values of the row before, per key by ``order``, as a struct; NULL on a key's first row.

    Rows are range-partitioned by key and order, so one long history spreads over many tasks.
    A partition's first row takes its predecessor from the last rows of the partitions before,
    the only rows that meet in one place.
    """
    rows = ranged(df, F.col(key), F.col(order))
    inside = Window.partitionBy("_pid").orderBy(key, order)
    pick = F.struct(F.col(key).alias("k"), *columns)
    numbered = rows.withColumn("_near", F.lag(pick).over(inside)).withColumn("_n", F.row_number().over(inside))
    tails = rows.groupBy("_pid").agg(F.max_by(pick, F.struct(key, order)).alias("_tail"))
    shifted = tails.select("_pid", F.lag("_tail").over(Window.orderBy("_pid")).alias("_far"))
    joined = numbered.join(shifted, "_pid")
    before = F.when(F.col("_n") == 1, F.col("_far")).otherwise(F.col("_near"))
    return joined.withColumn(out, F.when(before["k"] == F.col(key), before)).drop("_pid", "_near", "_n", "_far")


def revision_changes(history: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Field-level difference of each revision to the one before it."""
    rows = with_previous(history.select(key, order, *columns), key, order, columns).where(F.col("_prev").isNotNull())
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"_prev.{c}").cast("string").alias("old"), F.col(c).cast("string").alias("new")) for c in columns
    ])
    changed = F.filter(pairs, lambda x: ~x["old"].eqNullSafe(x["new"]))
    return rows.select(key, order, F.explode(changed).alias("x")).select(key, order, "x.field", "x.old", "x.new")


def latest_per_id(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest row per key. ``max_by`` reduces before the shuffle, unlike a window."""
    rest = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(key).agg(newest).select(*[F.col(key) if c == key else F.col(f"_r.`{c}`").alias(c) for c in df.columns])


def search_replace(df: DataFrame, table: str, key: str, columns: list[str], search: str, replacement: str, operation: Column) -> DataFrame:
    """Audit rows of every text value a replacement would change."""
    pairs = F.array(*[
        F.struct(
            F.lit(c).alias("field"), F.col(c).alias("old_value"), F.replace(F.col(c), F.lit(search), F.lit(replacement)).alias("new_value")
        )
        for c in columns
    ])
    hits = F.filter(pairs, lambda p: F.contains(p["old_value"], F.lit(search)))
    return df.select(operation.alias("operation_id"), F.lit(table).alias("table_name"), F.col(key).alias("row_id"), F.explode(hits).alias("x")).select(
        "operation_id", "table_name", "row_id", "x.field", "x.old_value", "x.new_value"
    )


def apply_audit(
    df: DataFrame, audit: DataFrame, key: str, columns: list[str], value: str = "new_value", order: str = "operation_id"
) -> DataFrame:
    """Write audited values to the table; of several operations on one field the last by ``order`` counts."""
    last = audit.groupBy("row_id", "field")
    last = last.agg((F.max_by(value, order) if order in audit.columns else F.max(value)).alias(value))
    changes = last.groupBy(F.col("row_id").alias("_k")).agg(
        F.map_from_entries(F.collect_list(F.struct("field", value))).alias("_m")
    )
    joined = df.join(changes, F.col(key) == F.col("_k"), "left")
    out = [
        (F.coalesce(F.try_element_at("_m", F.lit(c)), F.col(c)) if c in columns else F.col(f"`{c}`")).alias(c) for c in df.columns
    ]
    return joined.select(*out)


def rollback(df: DataFrame, audit: DataFrame, key: str, columns: list[str], order: str = "operation_id") -> DataFrame:
    """Undo operations that are not rolled back: the oldest recorded value of each field returns."""
    live = audit.where(~F.coalesce(F.col("rolled_back"), F.lit(False))) if "rolled_back" in audit.columns else audit
    first = live.groupBy("row_id", "field").agg(F.min_by("old_value", order).alias("old_value"))
    return apply_audit(df, first, key, columns, "old_value")


def media_violations(df: DataFrame, key: str, mime: str = "mime_type", size: str = "file_size") -> DataFrame:
    bad = F.filter(
        F.array(
            F.when(~F.col(mime).isin(MEDIA_TYPES), F.concat(F.lit("type not allowed: "), F.col(mime))),
            F.when(F.col(size) > MEDIA_MAX_BYTES, F.concat(F.lit("too large: "), F.col(size).cast("string"))),
        ),
        lambda m: m.isNotNull(),
    )
    return df.select(key, F.explode(bad).alias("message"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
