"""Records that span lines, and items of large JSON arrays, cut out of one file by many tasks.

A file is read in units that end with a separator: a line break, or a closing brace. Whether a unit begins inside of quotes
depends on all units before it, but each unit by itself maps that state to the state at its end, and such maps compose.
So states come from running sums on two levels: narrow rows compose the maps of each piece of a file (a few thousand units), the
pieces of a file follow one another, and with the state at its start each piece gives every unit its own. Units form
records inside of their piece; only the first and last part of a piece meets those of others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

PIECE = ["file", "block"]
#: A piece is at most 2 ** PIECE_BITS units of what one task reads, so that its texts are few beside a task's memory.
PIECE_BITS = 12


def read_units(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """(file, block, n, value): units of text without their separator; ``n`` orders the units of a piece, ``block`` the pieces of a file.

    What a task reads of a file is cut into pieces after a fixed number of units. ``block`` is the place in the file where the read
    begins plus the number of the piece; a unit is a byte or more, so that stays below the place where the next read begins.
    """
    raw = spark.read.option("lineSep", separator).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("n"), "value")
    nth = F.shiftright(F.col("n").bitwiseAND(F.lit((1 << 33) - 1)), PIECE_BITS)
    return raw.select("file", (F.col("begin") + nth).alias("block"), "n", "value")


def with_states(df: DataFrame, parts: list[str], order: str, **starts: Column) -> DataFrame:
    """The states before and after each row (``before_x``, ``after_x``) for each start ``x``: 0 outside, 1 inside.

    ``end0`` and ``end1`` are a row's state at its end if it begins outside or inside.
    """
    ordered = Window.partitionBy(*parts).orderBy(order)
    through = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    toggles = (F.col("end0") == 1) & (F.col("end1") == 0)
    odd = (F.sum(toggles.cast("int")).over(through) % 2).cast("int")
    # Of the last row that ends alike from both states: its end, less the toggles up to it. What toggles later is added again.
    fixed = F.last(F.when(F.col("end0") == F.col("end1"), F.col("end0").bitwiseXOR(F.col("_odd"))), ignorenulls=True).over(through)
    out = df.withColumn("_odd", odd).withColumn("_fixed", fixed)
    for name, start in starts.items():
        out = out.withColumn(f"after_{name}", F.coalesce("_fixed", start).bitwiseXOR(F.col("_odd")))
        out = out.withColumn(f"before_{name}", F.coalesce(F.lag(f"after_{name}").over(ordered), start))
    return out.drop("_odd", "_fixed")


def started(units: DataFrame, gain, *more: Column) -> DataFrame:
    """One row of each piece: ``start``, its state at the start, ``offset``, what earlier pieces of the file gained, and ``more`` aggregates.

    ``gain(before, after)`` is what a unit adds under these states. ``units`` has end0 and end1 and should be narrow.
    """
    both = with_states(units, PIECE, "n", a=F.lit(0), b=F.lit(1))
    pieces = both.groupBy(*PIECE).agg(
        F.max_by("after_a", "n").alias("end0"), F.max_by("after_b", "n").alias("end1"),
        F.sum(gain(F.col("before_a"), F.col("after_a"))).alias("gain0"), F.sum(gain(F.col("before_b"), F.col("after_b"))).alias("gain1"), *more)
    return in_files(pieces)


def started_lines(lines: DataFrame, end0: Column, end1: Column, *more: Column) -> DataFrame:
    """As ``started`` for lines that gain 1 where they end outside; one scan, one row a piece in the shuffle.

    Most lines leave the state as it is. Of the others a piece gathers one number each, so it should have what a task can hold.
    """
    code = F.when((end0 != 0) | (end1 != 1), F.col("n") * 4 + end0 * 2 + end1)
    pieces = lines.groupBy(*PIECE).agg(F.sort_array(F.collect_list(code)).alias("codes"), F.min("n").alias("first"), F.count("*").alias("lines"), *more)

    def step(acc: Column, code: Column) -> Column:
        n, state = F.shiftright(code, 2), F.when(acc["state"] == 0, F.shiftright(code, 1).bitwiseAND(1)).otherwise(code.bitwiseAND(1)).cast("int")
        passed = F.when(acc["state"] == 0, n - acc["next"]).otherwise(0)
        return F.struct(state.alias("state"), (acc["ended"] + passed + (state == 0).cast("long")).alias("ended"), (n + 1).alias("next"))

    for k in (0, 1):
        begin = F.struct(F.lit(k).alias("state"), F.lit(0).cast("long").alias("ended"), F.col("first").alias("next"))
        pieces = pieces.withColumn("walked", F.aggregate("codes", begin, step))
        left = F.when(F.col("walked.state") == 0, F.col("first") + F.col("lines") - F.col("walked.next")).otherwise(0)
        pieces = pieces.withColumn(f"end{k}", F.col("walked.state")).withColumn(f"gain{k}", F.col("walked.ended") + left)
    return in_files(pieces.drop("codes", "walked", "lines"))


def in_files(pieces: DataFrame) -> DataFrame:
    """``start`` and ``offset`` of pieces from their end0, end1, gain0 and gain1."""
    pieces = with_states(pieces, ["file"], "block", x=F.lit(0))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    gained = F.when(F.col("before_x") == 0, F.col("gain0")).otherwise(F.col("gain1"))
    offset = F.coalesce(F.sum(gained).over(earlier), F.lit(0)).alias("offset")
    return pieces.select("*", F.col("before_x").alias("start"), offset).drop("end0", "end1", "gain0", "gain1", "before_x", "after_x")


def assemble(units: DataFrame, separator: str, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(records, rest)``: values of units put together up to each that has ``ended``, and parts of what never ends.

    Both have (file, block, n, value) and ``keep``, columns of the first unit. Most records are one unit and are not grouped.
    An unended rest is left in parts, one a piece, since a quote that is never closed may leave the whole file.
    """
    keep = keep or []
    ordered = Window.partitionBy(*PIECE).orderBy("n")
    nth = F.coalesce(F.sum(F.col("ended").cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("nth")
    marked = units.select(*PIECE, "n", "value", "ended", *keep, nth, F.coalesce(F.lag("ended").over(ordered), F.lit(False)).alias("fresh"))
    alone = marked.where("ended and fresh").select(*PIECE, "n", "value", *keep)

    def joined(df, keys, *by):
        parts = F.transform(F.array_sort(F.collect_list(F.struct(*by, "value"))), lambda x: x["value"])
        firsts = [F.min_by(c, F.struct(*by)).alias(c) for c in (*[c for c in ("block", "n") if c not in keys], *keep)]
        return df.groupBy(*keys).agg(F.array_join(parts, separator).alias("value"), F.max("ended").alias("ended"), *firsts)

    some = joined(marked.where("not (ended and fresh)"), [*PIECE, "nth"], "n")
    inner = some.where("ended and nth > 0").select(*PIECE, "n", "value", *keep)
    # First and last parts of pieces: those up to an ended one are a record.
    edges = some.where("not ended or nth = 0")
    along = Window.partitionBy("file").orderBy("block", "nth")
    edges = edges.withColumn("record", F.coalesce(F.sum(F.col("ended").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edges = edges.withColumn("whole", F.max("ended").over(Window.partitionBy("file", "record")))
    crossing = joined(edges.where("whole"), ["file", "record"], "block", "nth").select(*PIECE, "n", "value", *keep)
    return alone.unionByName(inner).unionByName(crossing), edges.where("not whole").select(*PIECE, "n", "value", *keep)


def csv_ends(line: Column, delimiter: str = ",") -> tuple[Column, Column]:
    """State after a line of CSV that begins outside, and that begins inside of a quoted cell.

    A quote opens a cell only at its begin; inside, two quotes are one, and what follows a closing quote belongs to the cell.
    """
    # 0 at the begin of a cell, 1 inside quotes, 2 after a quote inside quotes, 3 in a cell; 10 more before the first part.
    def step(s: Column, part: Column) -> Column:
        s = F.when(s >= 10, s - 10).when(s == 0, 1).when(s == 1, 2).when(s == 2, 1).otherwise(3)
        return F.when(part == "", s).when(s == 1, 1).when(F.endswith(part, F.lit(delimiter)), 0).otherwise(3)

    def end(start: int) -> Column:
        state = F.aggregate(F.split(line, '"', -1), F.lit(10 + start), step)
        return F.when(F.contains(line, F.lit('"')), (state == 1).cast("int")).otherwise(start)

    return end(0), end(1)


def brace_ends(text: Column) -> list[Column]:
    """``end0, end1, gain0, gain1`` of a JSON text up to a closing brace: state of strings and change of depth, with the brace, from either state."""

    def opened(part: Column) -> Column:
        return sum(sign * (F.length(part) - F.length(F.replace(part, F.lit(c), F.lit("")))) for c, sign in (("{", 1), ("[", 1), ("]", -1)))

    # State 0 outside, 1 in a string, 2 in a string after an odd number of backslashes; 10 more before the first part.
    def step(acc: Column, part: Column) -> Column:
        s = acc["s"]
        s = F.when(s >= 10, s - 10).when(s == 1, 0).otherwise(1)
        odd = (F.length(part) - F.length(F.rtrim(part, F.lit("\\")))) % 2 == 1
        return F.struct(F.when(s == 0, 0).when(odd, 2).otherwise(1).alias("s"), (acc["d"] + F.when(s == 0, opened(part)).otherwise(0)).alias("d"))

    out = []
    for start in (0, 1):
        walked = F.aggregate(F.split(text, '"', -1), F.struct(F.lit(10 + start).alias("s"), F.lit(0).alias("d")), step)
        out.append(walked)
    return [*[(x["s"] > 0).cast("int") for x in out], *[x["d"] - (x["s"] == 0).cast("int") for x in out]]
