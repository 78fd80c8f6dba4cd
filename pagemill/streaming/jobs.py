"""Structured Streaming forms of the import and tracking jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.functions.html import SHORT_FINGERPRINT
from pagemill.functions.text import fingerprint, null_if_blank
from pagemill.operators.constraints import latest_per_id
from pagemill.sources.loads import job_items, job_row, load_outcomes, written_rows

QUIET = "1 second"
THROTTLE_MS = 500


#: Key buckets of a loaded table, and after how many batches its keys and rows are written together.
BUCKETS, COMPACT_EVERY = 16, 20


def import_batches(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, jobs: str, items: str,
    checkpoint: str, key: str, order: str, mode: str, template: str = "practice",
    write: Callable[[DataFrame, str], None] | None = None, progress: Callable[[dict], None] | None = None,
    buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY,
):
    """Run the import over every micro-batch and load the result.

    The target is a log of key buckets: a delta per batch, and every ``compact_every`` batches a snapshot of the newest row per
    key. To know which keys exist, a batch reads the key column of its own buckets in the last snapshot and the deltas since;
    so its cost does not grow with the number of batches. It writes only under its batch id, so a batch
    repeated after a failure overwrites its own folders and loads nothing twice.

    ``write(rows, path)`` writes the rows of a batch. If loading fails it is tried once more; then its rows are ``failed`` in the
    items, with the error, are kept in ``<target>_failed``, and the stream goes on. ``progress`` gets the counters of each
    batch, which also stand in ``<target>_progress``.
    """
    put = write or (lambda rows, path: rows.write.mode("overwrite").partitionBy("bucket").parquet(path))

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The transformed rows are read several times; they are written once and read back.
        staged = f"{target}_staged/batch_id={batch_id}"
        bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
        transform(batch).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(staged)
        rows = spark.read.schema(f"{_ddl(transform(batch))}, bucket int").parquet(staged)
        name, log_path = F.lit(f"batch-{batch_id}"), f"{items}/batch_id={batch_id}"
        error = None
        for _ in range(2):
            try:
                if batch_id and batch_id % compact_every == 0:
                    compact(spark, target, key, batch_id)
                touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
                before = _log(spark, target, batch_id)
                known = rows.limit(0) if before is None else before.where(F.col("bucket").isin(touched))
                done = load_outcomes(known.select(key).distinct(), rows, key, order, mode)
                job_items(done, name).write.mode("overwrite").parquet(log_path)
                put(written_rows(rows, spark.read.parquet(log_path), key, order), f"{target}/deltas/batch_id={batch_id}")
                error = None
                break
            except Exception as err:  # whatever a sink raises; the rows are kept and the error is told
                error = str(err).splitlines()[0] if str(err) else type(err).__name__
        if error is not None:
            rows.drop("bucket").write.mode("overwrite").parquet(f"{target}_failed/batch_id={batch_id}")
            lost = rows.select(F.col(order).alias("row_index"), F.col(key).alias("slug"), F.lit("failed").alias("status"), F.lit(error).alias("error_message"))
            job_items(lost, name).write.mode("overwrite").parquet(log_path)
        log = spark.read.parquet(log_path)
        seen = Observation(f"import-{uuid.uuid4().hex}")
        counted = job_row(log, template, mode=mode, source_type="stream")
        counted = counted.observe(seen, *[F.max(c).alias(c) for c in ("total_records", "created_count", "updated_count", "skipped_count", "failed_count")])
        counted.write.mode("overwrite").parquet(f"{jobs}/batch_id={batch_id}")
        now = {"batch_id": batch_id, **{k: int(v or 0) for k, v in seen.get.items()}}
        spark.createDataFrame([tuple(now.values())], ", ".join(f"{k} long" for k in now)).drop("batch_id").write.mode("overwrite").parquet(f"{target}_progress/batch_id={batch_id}")
        if progress:
            progress(now)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _read(spark, path: str) -> DataFrame | None:
    """A folder of Parquet, None where no row was written yet: batches without rows leave folders without files."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _log(spark, target: str, before_batch: int | None) -> DataFrame | None:
    """The last snapshot and the deltas since, with ``batch_id`` and ``bucket``, as the batches before one left them."""
    deltas, ready = _read(spark, f"{target}/deltas"), _read(spark, f"{target}/ready")
    if deltas is None:
        return None
    if before_batch is not None:
        deltas = deltas.where(F.col("batch_id") < before_batch)
        ready = None if ready is None else ready.where(F.col("batch_id") < before_batch)
    upto = None if ready is None else ready.agg(F.max("batch_id")).first()[0]
    if upto is None:
        return deltas
    snapshot, since = _read(spark, f"{target}/snapshots/upto={upto}"), deltas.where(F.col("batch_id") > upto)
    return since if snapshot is None else snapshot.unionByName(since)


def compact(spark, target: str, key: str, before_batch: int) -> None:
    """Write the newest row per key, as the batches before one left them, as one snapshot; deltas and older snapshots stay."""
    log, upto = _log(spark, target, before_batch), before_batch - 1
    if log is not None:
        newest = latest_per_id(log, key, ["batch_id"])
        newest.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/snapshots/upto={upto}")
        spark.range(1).write.mode("overwrite").parquet(f"{target}/ready/batch_id={upto}")


def loaded_rows(spark, target: str, key: str, before_batch: int | None = None) -> DataFrame | None:
    """The loaded table as the batches before one left it, None when nothing was loaded."""
    log = _log(spark, target, before_batch)
    return None if log is None else latest_per_id(log, key, ["batch_id"]).drop("batch_id", "bucket")


def debounced(df: DataFrame, key: str, at: str, state: Column, quiet: str = QUIET, lateness: str = "10 seconds") -> DataFrame:
    """Last state of each burst of changes that ends in a quiet second. Works on streams and tables."""
    marked = df.withWatermark(at, lateness) if df.isStreaming else df
    return marked.groupBy(F.session_window(at, quiet).alias("w"), key).agg(
        F.max_by(state, F.col(at)).alias("state"), F.count("*").alias("changes")
    ).select(key, F.col("w.start").alias("first_change"), F.col("w.end").alias("saved_at"), "state", "changes")


def _sessions(df: DataFrame, at: str, key: str, gap: str, lateness: str):
    marked = df.withWatermark(at, lateness) if df.isStreaming else df
    return marked.groupBy(F.session_window(at, gap).alias("_w"), F.col(key).cast("string").alias("_key"))


def first_touches(df: DataFrame, session: str, url: str, at: str, idle: str = "30 minutes", lateness: str = "10 seconds") -> DataFrame:
    """``session, landing_page, seen_at``: the first landing page of every session, which ends when it is idle.

    Works on tables and, in append mode, on streams, where a session is told once the watermark has passed its end. The earliest
    page by time, then by name, reduces before the shuffle. Blank pages do not count.
    """
    rows = df.where(null_if_blank(F.col(url)).isNotNull())
    first = _sessions(rows, at, session, idle, lateness).agg(F.min_by(F.col(url), F.struct(at, url)).alias("landing_page"), F.min(at).alias("seen_at"))
    return first.select(F.col("_key").alias("session"), "landing_page", "seen_at")


def throttled(df: DataFrame, key: str, at: str, min_gap_ms: int = THROTTLE_MS, lateness: str = "10 seconds") -> DataFrame:
    """``key, emitted``: the calls that go through, each at least ``min_gap_ms`` after the last one that did.

    A call after a pause of that length always goes through, so each burst between pauses is decided by itself: a fold over its
    sorted times. Works on tables and, in append mode, on streams, once the watermark has passed a burst. Memory holds the
    times of a burst, 8 bytes a call.
    """
    burst = _sessions(df, at, key, f"{min_gap_ms} milliseconds", lateness).agg(F.sort_array(F.collect_list(F.unix_micros(F.col(at).cast("timestamp")))).alias("_times"))

    def step(acc: Column, t: Column) -> Column:
        goes = F.coalesce(t - F.element_at(acc, -1) >= min_gap_ms * 1000, F.lit(True))
        return F.when(goes, F.array_append(acc, t)).otherwise(acc)

    first = F.slice("_times", 1, 1)
    through = F.aggregate(F.slice("_times", 2, F.size("_times")), first, step)
    return burst.select(F.col("_key").alias("key"), F.explode(through).alias("_t")).select("key", F.timestamp_micros("_t").alias("emitted"))


def first_touch_stream(df: DataFrame, session: str, url: str, at: str, ttl_minutes: int = 30) -> DataFrame:
    """The first landing page of every session, emitted at once and kept until the session is idle: one row of state per session.

    ``first_touches`` does the same without Python where a result may wait for the end of a session.
    """

    def remember(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = None
        for pdf in frames:
            row = pdf.sort_values("_at").iloc[0]
            if first is None or row["_at"] < first["_at"]:
                first = row
        if first is not None and not state.exists:
            state.update((str(first["_url"]),))
            yield pd.DataFrame({"session": [str(k[0])], "landing_page": [first["_url"]], "seen_at": [first["_at"]]})
        state.setTimeoutDuration(ttl_minutes * 60_000)

    rows = df.where(null_if_blank(F.col(url)).isNotNull()).select(
        F.col(session).cast("string").alias("_session"), F.col(url).alias("_url"), F.col(at).alias("_at")
    )
    return rows.groupBy("_session").applyInPandasWithState(
        remember, "session string, landing_page string, seen_at timestamp", "landing_page string", "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )


def _throttle(min_gap_ms: int):
    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Calls are taken in order of arrival, one Arrow batch at a time.
        last = state.get[0] if state.exists else None
        for pdf in frames:
            out = []
            for ms in pdf["_ms"]:
                if last is None or ms - last >= min_gap_ms:
                    last = int(ms)
                    out.append(last)
            yield pd.DataFrame({"key": [str(k[0])] * len(out), "emitted_ms": out})
        if last is not None:
            state.update((last,))

    return run


def throttled_stream(df: DataFrame, key: str, at: str, min_gap_ms: int = THROTTLE_MS) -> DataFrame:
    """Calls at least half a second after the last one that went through, emitted at once; one number of state per key.

    ``throttled`` does the same without Python where a result may wait for the end of a burst.
    """
    rows = df.select(F.col(key).cast("string").alias("_key"), F.unix_millis(F.col(at)).alias("_ms"))
    return rows.groupBy("_key").applyInPandasWithState(
        _throttle(min_gap_ms), "key string, emitted_ms bigint", "last_ms bigint", "append", GroupStateTimeout.NoTimeout
    )


def fresh_records(df: DataFrame, text: str, at: str, key: str, lateness: str = "1 hour") -> DataFrame:
    """Incoming records whose fingerprint was not seen within the lateness span; short texts are exempt.

    Texts with a short or no fingerprint are told apart by ``key``. The state holds a digest, not the text.
    A table keeps the first record of each fingerprint by time and key, as an aggregate that reduces before the shuffle.
    """
    print_ = fingerprint(F.col(text))
    short = F.coalesce(F.length(print_), F.lit(0)) < SHORT_FINGERPRINT
    marked = df.withColumn("_print", F.when(short, F.concat(F.lit("own:"), F.coalesce(F.col(key).cast("string"), F.uuid()))).otherwise(F.sha2(print_, 256)))
    if df.isStreaming:
        return marked.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["_print"]).drop("_print")
    # By time, then key: null times come last, not first.
    order = F.struct(F.col(at).isNull(), F.col(at), F.col(key).cast("string"))
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    first = marked.groupBy("_print").agg(F.min_by(rest, order).alias("_r"))
    return first.select(*[F.col(f"_r.`{c}`").alias(c) for c in df.columns])


def live_counters(df: DataFrame, status: str) -> DataFrame:
    """Running counts by status, for update or complete output."""
    return df.groupBy(F.col(status).alias("status")).count()


def observed(df: DataFrame, name: str, status: str) -> DataFrame:
    """Attach progress metrics that a listener can read while the job runs."""
    s = F.col(status)
    return df.observe(
        name, F.count(F.lit(1)).alias("records"), F.count_if(s == "auto_approved").alias("auto_approved"),
        F.count_if(s == "needs_review").alias("needs_review"),
    )
