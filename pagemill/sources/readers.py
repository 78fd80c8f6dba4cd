"""Source records from CSV, JSON and landed feeds."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from pagemill.functions.text import nonblank
from pagemill.session import checkpoint
from pagemill.sources import framed

BAD = "_bad_record"


def with_index(df: DataFrame, name: str = "source_index") -> DataFrame:
    """Dense 0-based record number in file order.

    The rows are written once, so that counting and numbering see the same partitions. Partition
    sizes are counted and only those meet in one task; the rows themselves are never sorted together.
    """
    tagged = checkpoint(df.withColumn("_mid", F.monotonically_increasing_id())).withColumn("_pid", F.shiftright("_mid", 33))
    sizes = tagged.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + inside).drop("_mid", "_pid", "_off")


def read_csv(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``(records, errors)`` of CSV files with a header row.

    Files may differ in columns and their order; rows come together by column name. Header names are trimmed and rows whose
    cells are all blank are left out. Rows the parser rejects are kept in ``errors(file, row, record, message)``, ``row`` counting
    from 1 after the header; a quote that is never closed makes an error of each part of the file it swallows.

    One file is read by many tasks, line breaks in cells or not: a first pass over the lines finds where quotes are
    open at the begin of each piece (``sources.framed``), a second cuts the records. Lines end in LF or CRLF. A header is the first line that
    is not blank and has no line breaks in its names; only the distinct headers go to the driver.
    """
    lines = framed.read_units(spark, path, "\n")
    end0, end1 = framed.csv_ends(F.col("value"))
    filled = nonblank(F.col("value"))
    # A line that ends outside of quotes ends a record.
    pieces = framed.started_lines(lines, end0, end1, F.min(F.when(nonblank(F.col("value")), F.struct("n", "value"))).alias("head"))
    by_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Lines before the header are blank, so each is a record.
    found = F.first(F.when(F.col("head").isNotNull(), F.struct(F.col("head.value").alias("text"), (F.col("offset") + F.col("head.n") - F.col("first") + 1).alias("at"))), ignorenulls=True)
    pieces = checkpoint(pieces.withColumn("header", found.over(by_file)).select(*framed.PIECE, "start", "offset", F.regexp_replace("header.text", "^\ufeff|\r$", "").alias("header"), F.col("header.at").alias("header_at")))
    headers = sorted(r["header"] for r in pieces.where("header is not null").select("header").distinct().collect())
    units = framed.with_states(lines.withColumns({"end0": end0, "end1": end1}).join(pieces, framed.PIECE), framed.PIECE, "n", x=F.col("start"))
    ended = F.col("after_x") == 0
    before = Window.partitionBy(*framed.PIECE).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    row = F.col("offset") + F.coalesce(F.sum(ended.cast("long")).over(before), F.lit(0)) + 1 - F.col("header_at")
    units = units.select(*framed.PIECE, "n", "value", ended.alias("ended"), "header", row.alias("row"))
    whole, rest = framed.assemble(units, "\n", ["header", "row"])
    whole = whole.where("row > 0").withColumn("value", F.regexp_replace("value", "\r$", ""))
    names = {h: next(csv.reader([h])) for h in headers}
    columns = list(dict.fromkeys(c.strip() for h in headers for c in names[h]))
    parsed, cells, bad = whole, {c: [] for c in columns}, []
    for i, h in enumerate(headers):
        fields = [T.StructField(f"c{k}", T.StringType()) for k in range(len(names[h]))]
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "escape": '"', "multiLine": "true"}
        of_header = F.when(F.col("header") == h, F.from_csv("value", T.StructType([*fields, T.StructField(BAD, T.StringType())]).simpleString(), options))
        parsed = parsed.withColumn(f"_h{i}", of_header)
        bad.append(F.col(f"_h{i}.{BAD}"))
        for k, c in enumerate(names[h]):
            cells[c.strip()].append(F.col(f"_h{i}.c{k}"))
    taken = parsed.select("file", "row", "value", *[F.coalesce(*cells[c]).alias(f"_c{k}") for k, c in enumerate(columns)], F.coalesce(F.lit(None), *bad).isNotNull().alias("_wrong"))
    held = [F.col(f"_c{k}") for k in range(len(columns))]
    some = F.exists(F.array(*held), nonblank) if held else F.lit(False)
    records = taken.where(some).select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(columns)])
    errors = taken.where(F.col("_wrong") & nonblank(F.col("value"))).select("file", "row", F.col("value").alias("record"), F.lit("Row does not match the header").alias("message"))
    unclosed = rest.where("row > 0").where(nonblank(F.col("value"))).select("file", "row", F.col("value").alias("record"), F.lit("Quoted field unterminated").alias("message"))
    return records, errors.unionByName(unclosed)


def _variant_path(path: str) -> str:
    out = "$"
    for part in path.strip().split("."):
        out += f"[{part}]" if part.isdigit() else f"['{part}']"
    return out


def json_items(df: DataFrame, text: str, json_path: str | None = None, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Items of JSON documents: ``(items(item json), errors(row, message))``.

    The value at the dot path is an array of objects, or one object that counts as an array
    of one. Entries that are no objects, and texts that are no JSON, become errors.
    """
    keep = keep or []
    v = F.try_parse_json(F.col(text))
    target = F.try_variant_get(v, _variant_path(json_path), "variant") if json_path else v
    rows = df.select(*keep, v.alias("_v"), target.alias("_t")).withColumn("_s", F.schema_of_variant("_t"))
    is_array = F.startswith("_s", F.lit("ARRAY"))
    is_object = F.startswith("_s", F.lit("OBJECT"))
    items = F.when(is_array, F.col("_t").cast("array<variant>")).when(is_object, F.array("_t"))
    exploded = rows.where(is_array | is_object).select(*keep, F.posexplode(items).alias("pos", "item"))
    exploded = exploded.withColumn("_s", F.schema_of_variant("item"))
    good = F.startswith("_s", F.lit("OBJECT"))
    message = F.when(F.col("_v").isNull(), "Invalid JSON").when(
        F.lit(json_path is not None), f'JSON path "{json_path}" did not resolve to an array or object'
    ).otherwise("JSON must be an array of objects or an object")
    errors = rows.where(~F.coalesce(is_array | is_object, F.lit(False))).select(
        *keep, F.lit(None).cast("int").alias("row"), message.alias("message")
    ).unionByName(
        exploded.where(~good).select(
            *keep, (F.col("pos") + 1).alias("row"), F.concat(F.lit("Row "), F.col("pos") + 1, F.lit(" is not an object")).alias("message")
        )
    )
    return exploded.where(good).select(*keep, "pos", F.to_json("item").alias("item")), errors


def read_json(spark: SparkSession, path: str | list[str], json_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(records, errors)`` of JSON files, nested objects flattened to dotted columns.

    Without a path, a file that is an array of objects, or one object, is cut into items by many tasks (``json_entries``).
    With one, a file is one document in one row.
    """
    if json_path:
        files = spark.read.option("wholetext", True).text(path)
        items, errors = json_items(files, "value", json_path)
    else:
        items, errors = json_entries(spark, path)
    return flatten(_infer(items)), errors


def json_entries(spark: SparkSession, path: str | list[str], one_list: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(items(file, item json), errors(row, message))`` of files that hold a JSON array, one object, or objects one after the other.

    The text is read in units up to each closing brace, and running sums over strings and depth tell which brace ends an entry
    of the array (``sources.framed``); so arrays of any size are read by many tasks. Entries that are no objects become errors; ``row`` counts
    entries from 1, in each file or, with ``one_list``, on through all files in the order of their paths. What is no JSON is
    an error of its entry only, without a row.
    """
    units = framed.read_units(spark, path, "}")
    ends = dict(zip(("end0", "end1", "depth0", "depth1"), framed.brace_ends(F.col("value"))))
    narrow = units.select(*framed.PIECE, "n", *[c.alias(k) for k, c in ends.items()], F.substring(F.regexp_replace("value", r"^[\s\ufeff]+", ""), 1, 1).alias("sign"))

    def gain(before: Column, after: Column) -> Column:
        return F.when(before == 0, F.col("depth0")).otherwise(F.col("depth1"))

    pieces = framed.started(narrow, gain, F.min_by("sign", "n").alias("sign"))
    # Entries of an array end at depth 1, of a file without one at depth 0.
    base = (F.first("sign").over(Window.partitionBy("file").orderBy("block")) == "[").cast("int")
    pieces = checkpoint(pieces.select(*framed.PIECE, "start", "offset", base.alias("base")))
    states = framed.with_states(units.withColumns(ends).join(pieces, framed.PIECE), framed.PIECE, "n", x=F.col("start"))
    through = Window.partitionBy(*framed.PIECE).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = F.col("offset") + F.sum(gain(F.col("before_x"), F.col("after_x"))).over(through)
    states = states.select(*framed.PIECE, "n", "value", "base", ((F.col("after_x") == 0) & (depth == F.col("base"))).alias("ended"))
    whole, rest = framed.assemble(states, "}", ["base"])
    bare = F.regexp_replace("value", r"^[\s\ufeff]*[\[,]?", "")
    whole = whole.select(*framed.PIECE, "n", "base", F.concat(F.lit("["), bare, F.lit("}]")).alias("list"))
    closed = F.when(F.col("base") == 1, F.concat(F.lit("["), bare)).otherwise(F.concat(F.lit("["), bare, F.lit("]")))
    rest = rest.where(F.col("value").rlike(r"\S")).select(*framed.PIECE, "n", "base", closed.alias("list"))
    lists = whole.unionByName(rest).select(*framed.PIECE, "n", "base", F.try_parse_json("list").alias("list"))
    entries = lists.select(*framed.PIECE, "n", "base", F.posexplode(F.col("list").cast("array<variant>")).alias("pos", "entry"))
    entries = entries.withColumn("good", F.startswith(F.schema_of_variant("entry"), F.lit("OBJECT")))
    inside = Window.partitionBy(*framed.PIECE).orderBy("n", "pos")
    counts = entries.groupBy(*framed.PIECE).agg(F.count("*").alias("held"))
    earlier = (Window.orderBy("file", "block") if one_list else Window.partitionBy("file").orderBy("block")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*framed.PIECE, F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("held"))
    nth = entries.select(*framed.PIECE, "n", "pos", "base", "good").join(counts, framed.PIECE).withColumn("row", F.col("held") + F.row_number().over(inside))
    message = F.when(F.col("base") == 1, F.concat(F.lit("Row "), F.col("row"), F.lit(" is not an object"))).otherwise("JSON must be an array of objects or an object")
    errors = nth.where("not good").select(F.col("row").cast("long").alias("row"), message.alias("message"))
    broken = lists.where("list is null").select(F.lit(None).cast("long").alias("row"), F.lit("Invalid JSON").alias("message"))
    items = entries.where("good").select("file", F.to_json("entry").alias("item"))
    return items, errors.unionByName(broken)


def _infer(items: DataFrame) -> DataFrame:
    """Typed columns for JSON items: the merged schema of all items comes from one aggregate."""
    ddl = items.agg(F.schema_of_variant_agg(F.parse_json("item")).alias("s")).first()["s"]
    if ddl is None:
        return items.select()
    ddl = ddl.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    return items.select(F.from_json("item", ddl).alias("r")).select("r.*")


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs to dotted columns; arrays stay whole."""

    def walk(schema: T.StructType, col, prefix: str) -> list[Column]:
        out = []
        for f in schema.fields:
            value = col(f.name)
            name = f"{prefix}.{f.name}" if prefix else f.name
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, value.getField, name)
            else:
                out.append(value.alias(name))
        return out

    return df.select(*walk(df.schema, lambda n: F.col(f"`{n}`"), ""))


def value_at(doc: Column, path: str) -> Column:
    """Text at a dot path of a JSON text; numeric parts index arrays, NULL where it leads nowhere."""
    return F.try_variant_get(F.try_parse_json(doc), _variant_path(path), "string")


def read_feed(spark: SparkSession, folder: str, schema: str, streaming: bool = False) -> DataFrame:
    """A landed API feed: JSON lines in a folder, batch or stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).json(folder)


def content_scan(
    df: DataFrame, where: Column | None = None, columns: list[str] | None = None, order: list[Column] | None = None, limit: int | None = None
) -> DataFrame:
    """Filtered, projected, ordered and limited read of a content table; Catalyst pushes the filter and columns."""
    out = df if where is None else df.where(where)
    if order:
        out = out.orderBy(*order)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*columns) if columns else out
