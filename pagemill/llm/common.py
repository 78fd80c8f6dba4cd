"""What the operators of this package share: appending columns in Arrow batches, word bytes, checkpoints."""

from __future__ import annotations

import gc
import os
import shutil
import site
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

import pagemill
from pagemill.session import checkpoint  # noqa: F401  (the operators take it from here)

#: Text bytes that one Arrow batch may hold, so that a run of very long texts stays within a worker's memory.
BATCH_BYTES = 8 << 20
#: Rows of one Arrow batch.
BATCH_ROWS = 2000

Batch = Callable[[pa.RecordBatch], list]


def ship(spark: SparkSession) -> None:
    """Send the package to the workers where they would not find it: imported from a path of the driver's own."""
    root = os.path.realpath(os.path.dirname(os.path.dirname(pagemill.__file__)))
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    sc = spark.sparkContext
    if root in map(os.path.realpath, filter(None, found)) or any(os.path.basename(x) == "pagemill.zip" for x in sc.listFiles):
        return
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="pagemill-"), "pagemill"), "zip", root, "pagemill"))


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_BYTES`` and ``BATCH_ROWS``, unless the session already asks for less."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(key, None)
        digits = "".join(c for c in str(now or "") if c.isdigit())
        if not digits or int(digits) > most or int(digits) <= 0:
            spark.conf.set(key, str(most))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The columns whose names, in either case, are not among ``names``."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


_HELD: dict = {}


def held(key, make: Callable):
    """A large object that a worker process keeps over tasks. It keeps one at a time: a task of another kind frees it."""
    if _HELD.get("key") != key:
        _HELD.clear()
        _HELD.update(key=key, value=make())
    return _HELD["value"]


def append(df: DataFrame, ddl: str, start: Callable[[], Batch], needs: Iterable[str] = (), keeps: bool = False) -> DataFrame:
    """``df`` and new columns that Python makes from each Arrow batch; no shuffle.

    ``start()`` runs once in each task and returns the function from a batch to the list of new columns.
    Columns of ``df`` named like a new one are replaced, unless ``needs`` says that the function reads them.
    ``keeps`` says that ``start`` uses ``held``; else what the worker holds is freed first.
    """
    bound_batches(df.sparkSession)
    new = StructType.fromDDL(ddl)
    kept = {n.lower() for n in needs}
    clash = [f.name for f in new.fields if f.name.lower() not in kept]
    base = without(df, clash)
    drop = {f.name.lower() for f in new.fields}
    fields = [f for f in base.schema.fields if f.name.lower() not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        if not keeps:
            _HELD.clear()
        made = start()
        types = [to_arrow_type(f.dataType) for f in new.fields]
        for batch in batches:
            columns = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(made(batch), types)]
            own = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*own, *columns], names=[f.name for f in fields] + [f.name for f in new.fields])

    return base.mapInArrow(run, StructType(fields + new.fields))


def texts(batch: pa.RecordBatch, name: str = "text") -> list:
    """A text column of a batch as a list; null stays None."""
    return batch.column(name).to_pylist()


#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lower-cased; every other byte becomes a blank.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of ``[^\x20\x09-\x0D]`` as they are, or with A-Z lower-cased; white space becomes a blank.
PLAIN = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


def words(text: str | None, table: bytes) -> list[bytes]:
    """UTF-8 words of a text under one of the tables above, which turn all that separates words to blanks."""
    return text.encode().translate(table).split() if text else []


#: Most rows of a narrow table of ids (a few long columns) that is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are gone: it does so once the driver has collected its garbage, which may be long after."""
    for _ in range(2):  # what Python lets go of in the first round, the JVM can collect in the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the checkpoint folder and read again: unlike a checkpoint, plans that read it twice share their shuffles."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        checkpoint(spark.range(0))  # sets the folder
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


#: Rows of a narrow table that one task takes.
TASK_ROWS = 20_000


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint of a narrow table, read by as many tasks as its rows need: rounds over few rows stay cheap."""
    out = checkpoint(df)
    return out.coalesce(max(1, -(-out.count() // TASK_ROWS)))


def few(ids: DataFrame) -> DataFrame:
    """A checkpointed table of a few long columns, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
