"""Versioned recipes, migration sessions and mapping presets as append-only tables.

A change is a new row; the current state of an id is its newest row. Appends never rewrite
data, so a lost executor or a repeated batch cannot damage a store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagemill.operators.constraints import latest_per_id

RECIPE_SCHEMA = (
    "id string, name string, template_type string, rules_json string, confidence_threshold double, version int, "
    "is_active boolean, last_used_at timestamp, created_at timestamp, updated_at timestamp"
)
SESSION_SCHEMA = (
    "id string, name string, template_type string, source_type string, recipe_id string, current_step string, "
    "records_count int, approved_count int, exception_count int, skipped_count int, error_count int, "
    "mapping_json string, recipe_json string, review_state_json string, validation_result_json string, "
    "status string, created_by string, created_at timestamp, updated_at timestamp"
)
PRESET_SCHEMA = "id string, name string, template_type string, mapping_json string, is_active boolean, created_at timestamp, updated_at timestamp"
SESSION_LIMIT = 10


def camel(name: str) -> str:
    head, *rest = name.removesuffix("_json").split("_")
    return head + "".join(p.capitalize() for p in rest)


def to_session_fields(df: DataFrame) -> DataFrame:
    """Table columns to the session's own field names."""
    return df.select(*[F.col(c).alias(camel(c)) for c in df.columns])


def to_session_columns(df: DataFrame) -> DataFrame:
    """Session field names back to table columns; unknown fields are dropped."""
    known = {camel(part.split()[0]): part.split()[0] for part in SESSION_SCHEMA.split(", ")}
    return df.select(*[F.col(c).alias(known[c]) for c in df.columns if c in known])


class AppendStore:
    """One append-only table in a folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def history(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.folder)
        except Exception as err:  # an absent folder is an empty store
            if "PATH_NOT_FOUND" not in str(err):
                raise
            return self.spark.createDataFrame([], self.schema)

    def append(self, df: DataFrame) -> None:
        names = [part.split()[0] for part in self.schema.split(", ")]
        types = {part.split()[0]: part.split()[1] for part in self.schema.split(", ")}
        cols = [(F.col(n) if n in df.columns else F.lit(None)).cast(types[n]).alias(n) for n in names]
        df.select(*cols).write.mode("append").parquet(self.folder)

    def current(self) -> DataFrame:
        order = [c for c in ("version", "updated_at", "created_at") if f"{c} " in self.schema]
        return latest_per_id(self.history(), "id", order)

    def change(self, where: Column, **changes: Column) -> None:
        """Append the newest rows that match, with some columns changed."""
        rows = self.current().where(where)
        for name, value in changes.items():
            rows = rows.withColumn(name, value)
        self.append(rows.withColumn("updated_at", F.current_timestamp()))


class RecipeStore(AppendStore):
    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, RECIPE_SCHEMA)

    def create(self, rows: DataFrame) -> None:
        now = F.current_timestamp()
        given = rows if "id" in rows.columns else rows.withColumn("id", F.uuid())
        self.append(
            given.withColumn("version", F.lit(1)).withColumn("is_active", F.lit(True)).withColumn("created_at", now).withColumn("updated_at", now)
        )

    def update(self, recipe_id: str, **changes: Column) -> None:
        self.change(F.col("id") == recipe_id, version=F.col("version") + 1, **changes)

    def delete(self, recipe_id: str) -> None:
        self.change(F.col("id") == recipe_id, is_active=F.lit(False))

    def touch(self, recipe_id: str) -> None:
        self.change(F.col("id") == recipe_id, last_used_at=F.current_timestamp())

    def load(self, recipe_id: str) -> DataFrame:
        return self.current().where((F.col("id") == recipe_id) & F.col("is_active"))

    def list(self, template: str | None = None) -> DataFrame:
        rows = self.current().where("is_active")
        rows = rows if template is None else rows.where(F.col("template_type") == template)
        return rows.orderBy(F.desc_nulls_first("updated_at"), "id")


class SessionStore(AppendStore):
    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, SESSION_SCHEMA)

    def create(self, rows: DataFrame) -> None:
        now = F.current_timestamp()
        given = rows if "id" in rows.columns else rows.withColumn("id", F.uuid())
        self.append(given.withColumn("status", F.lit("in_progress")).withColumn("created_at", now).withColumn("updated_at", now))

    def save(self, session_id: str, **changes: Column) -> None:
        self.change(F.col("id") == session_id, **changes)

    def load(self, session_id: str) -> DataFrame:
        return self.current().where(F.col("id") == session_id)

    def list_active(self, limit: int = SESSION_LIMIT) -> DataFrame:
        return self.current().where("status = 'in_progress'").orderBy(F.desc_nulls_first("updated_at"), "id").limit(limit)

    def complete(self, session_id: str) -> None:
        self.save(session_id, status=F.lit("completed"))

    def abandon(self, session_id: str) -> None:
        self.save(session_id, status=F.lit("abandoned"))


class PresetStore(AppendStore):
    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, PRESET_SCHEMA)

    def insert(self, rows: DataFrame) -> None:
        now = F.current_timestamp()
        given = rows if "id" in rows.columns else rows.withColumn("id", F.uuid())
        self.append(given.withColumn("is_active", F.lit(True)).withColumn("created_at", now).withColumn("updated_at", now))

    def delete(self, preset_id: str) -> None:
        self.change(F.col("id") == preset_id, is_active=F.lit(False))

    def list(self, template: str | None = None) -> DataFrame:
        rows = self.current().where("is_active")
        rows = rows if template is None else rows.where(F.col("template_type") == template)
        return rows.orderBy(F.desc_nulls_first("created_at"), "id")
