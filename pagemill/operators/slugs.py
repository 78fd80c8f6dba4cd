"""Slug collisions inside an import.

``unique_suffix`` gives a repeated slug the first free of ``-1 … -99``, in record order. What a record gets depends
only on those that compete for the numbers of one base: its repeated records, which take the lowest free number each, and slugs of
the batch that spell such a number and hold it if they come before it is taken. Row-number limits, which Spark applies before the
shuffle, leave at most 99 of either, so a base is one short array, and a fold over it hands out the numbers. A slug that lost
its own name is a taker itself: at the same base for posts, and for pages at its own, which is one level deeper. All
later holders are numbered by many tasks, from the first number above 99 and above every numbered slug of the batch with that name,
so all slugs end up distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.functions.urls import strip_slashes
from pagemill.operators.joins import numbered
from pagemill.session import checkpoint

#: Suffixes that are handed out one by one; numbers beyond them are given without looking at single slugs.
SLOTS = 99
#: Changed slugs that are sent to all tasks at most.
BROADCAST_CHANGES = 100_000
_SLOT = r"\A(.*)-([1-9][0-9]?)\z"


def _bare(slug: Column, template: str) -> Column:
    """What a suffix is appended to."""
    return strip_slashes(slug) if template == "practice" else F.regexp_replace(slug, r"-\d+\z", "")


def _hand_out(competing: DataFrame, slots: int, losers_take: bool) -> DataFrame:
    """``(_base, _order, _got)`` of competitors ``(_base, _order, _k)``: the number each gets, 0 without one, -1 for a slug that lost its own.

    ``_k`` is 0 for a taker of the lowest free number, else the number that the slug spells. ``losers_take`` lets
    a slug whose number is gone take another one.
    """
    used = F.array_repeat(F.lit(False), slots)
    events = competing.groupBy("_base").agg(F.array_sort(F.collect_list(F.struct("_order", "_k"))).alias("_events"))
    out_type = dict(events.dtypes)["_events"].replace("_k:", "_got:")

    def step(acc: Column, e: Column) -> Column:
        own = (e["_k"] > 0) & ~F.get(acc["used"], e["_k"] - 1)
        lowest = F.array_position(acc["used"], False).cast("int")
        got = F.when(own, e["_k"]).when((e["_k"] > 0) & F.lit(not losers_take), F.lit(-1)).otherwise(lowest)
        return F.struct(
            F.transform(acc["used"], lambda x, i: x | (i == got - 1)).alias("used"),
            F.array_append(acc["out"], F.struct(e["_order"].alias("_order"), got.alias("_got"))).alias("out"))

    start = F.struct(used.alias("used"), F.array().cast(out_type).alias("out"))
    told = events.select("_base", F.explode(F.aggregate("_events", start, step, lambda acc: acc["out"])).alias("x"))
    return told.select("_base", "x._order", "x._got")


def _compete(heads: DataFrame, slots: int, template: str) -> DataFrame:
    """``(_order, _new)`` of all repeated slugs among the first holders of each, and of slugs that lost their name; null without a free number."""
    practice = template == "practice"
    bare = strip_slashes(F.col("_slug")) if practice else F.col("_slug")
    spelled = F.regexp_extract("_bare", _SLOT, 2).try_cast("int")
    in_slots = (spelled <= slots) & (F.col("_slug") == F.concat(F.lit("/"), "_bare", F.lit("/")) if practice else F.lit(True))
    named = heads.withColumn("_bare", bare).select("_order", "_r", "_bare", F.when(in_slots, spelled).alias("_k"), F.when(in_slots, F.regexp_extract("_bare", _SLOT, 1)).alias("_parent"))
    if practice:
        # How many numbers stand at the end: a slug can lose its name only to a base one level up.
        depth = F.length(F.regexp_replace(F.regexp_extract("_bare", r"((?:-[1-9][0-9]?)*)\z", 1), "[0-9]", ""))
        named = named.withColumn("_base", F.col("_bare")).withColumn("_depth", depth)
    else:
        named = named.withColumn("_base", F.regexp_replace("_bare", r"-\d+\z", "")).withColumn("_depth", F.lit(0))
    named = checkpoint(named)
    firsts = named.where("_r = 1 and _k is not null").select(F.col("_parent").alias("_base"), "_order", "_k", F.col("_bare").alias("_name"))
    by_base = Window.partitionBy("_base").orderBy("_order")
    levels = sorted(r["_depth"] for r in named.where("_r > 1").select("_depth").distinct().collect())
    lost, done = None, []
    while levels:
        level = levels.pop(0)
        takers = named.where((F.col("_depth") == level) & (F.col("_r") > 1)).select("_base", "_order")
        if lost is not None:
            takers = takers.unionByName(lost)
        ranked = takers.withColumn("_q", F.row_number().over(by_base))
        some, late = ranked.where(F.col("_q") <= slots).select("_base", "_order", F.lit(0).alias("_k")), ranked.where(F.col("_q") > slots)
        rivals = firsts.join(some.select("_base").distinct(), "_base", "left_semi").select("_base", "_order", "_k")
        got = checkpoint(_hand_out(some.unionByName(rivals), slots, not practice))
        number = F.when(F.col("_got") > 0, F.concat("_base", F.lit("-"), F.col("_got").cast("string")))
        done += [got.where("_got >= 0").select("_order", number.alias("_new")), late.select("_order", F.lit(None).cast("string").alias("_new"))]
        losers = got.where("_got < 0").select("_order") if practice else None
        lost = None
        if losers is not None and not losers.isEmpty():
            # Their base is their own name, one level down.
            lost = checkpoint(firsts.join(losers, "_order", "left_semi").select(F.col("_name").alias("_base"), "_order"))
            if level + 1 not in levels:
                levels.insert(0, level + 1)
    out = done[0] if done else named.select("_order", F.lit(None).cast("string").alias("_new")).limit(0)
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("_new", F.concat(F.lit("/"), "_new", F.lit("/"))) if practice else out


def resolve_collisions(
    df: DataFrame, order: str, slug: str, template: str, mode: str = "skip", max_suffix: int | None = None, unsolved: str | None = None
) -> DataFrame:
    """``df`` with ``slug`` made unique; modes ``skip`` and ``overwrite`` leave it for load time.

    ``order`` is the unique record number that decides who came first. With ``max_suffix`` no higher number is
    given: records without a free one share the last, and a column named ``unsolved`` tells which, if asked for.
    """
    if mode != "unique_suffix":
        return df if unsolved is None else df.withColumn(unsolved, F.lit(False))
    slots = SLOTS if max_suffix is None else min(SLOTS, max_suffix)
    # Narrow rows (number, slug, rank), read several times below; written once, as the whole records are far wider.
    rows = checkpoint(df.select(F.col(order).alias("_order"), F.col(slug).alias("_slug")).where(F.coalesce("_slug", F.lit("")) != ""))
    by_slug = Window.partitionBy("_slug").orderBy("_order")
    heads = checkpoint(rows.withColumn("_r", F.row_number().over(by_slug)).where(F.col("_r") <= slots + 1))
    none = F.lit(None).cast("string")
    decided = _compete(heads, slots, template)
    # Beyond its first hundred holders a slug finds every slot taken.
    heavy = rows.groupBy("_slug").agg(F.count("*").alias("_n")).where(F.col("_n") > slots + 1).select("_slug")
    beyond = rows.join(heavy, "_slug", "left_semi").join(heads.select("_order"), "_order", "left_anti").select("_order", none.alias("_new"))
    decided = checkpoint(decided.unionByName(beyond))
    open_ = rows.join(decided.where(F.col("_new").isNull()).select("_order"), "_order", "left_semi").withColumn("_bare", _bare(F.col("_slug"), template))
    if max_suffix is not None and max_suffix <= SLOTS:
        last = open_.select("_order", F.concat("_bare", F.lit(f"-{max_suffix}")).alias("_text"), F.lit(True).alias("_open"))
    else:
        # Numbers start above all that the batch itself spells out.
        plain = strip_slashes(F.col("_slug")) if template == "practice" else F.col("_slug")
        spelled = rows.select(F.regexp_extract(plain, r"\A(.*)-([0-9]{1,15})\z", 1).alias("_bare"), F.regexp_extract(plain, r"-([0-9]{1,15})\z", 1).try_cast("long").alias("_k"))
        spelled = spelled.where("_k is not null").groupBy("_bare").agg(F.max("_k").alias("_k"))
        start = F.greatest(F.coalesce("_k", F.lit(0)), F.lit(SLOTS))
        number = numbered(open_.select("_bare", "_order"), "_bare", "_order", "_q").join(spelled, "_bare", "left").withColumn("_q", start + F.col("_q"))
        too_many = F.lit(False) if max_suffix is None else F.col("_q") > max_suffix
        shown = F.col("_q") if max_suffix is None else F.least("_q", F.lit(max_suffix))
        last = number.select("_order", F.concat("_bare", F.lit("-"), shown.cast("string")).alias("_text"), too_many.alias("_open"))
    text = F.concat(F.lit("/"), F.col("_text"), F.lit("/")) if template == "practice" else F.col("_text")
    changed = decided.where(F.col("_new").isNotNull()).select("_order", "_new", F.lit(False).alias("_open")).unionByName(
        last.select("_order", text.alias("_new"), "_open"))
    # Only changed records travel to the join; where they are few, the whole records stay where they are.
    changed = checkpoint(changed.join(rows, "_order").where((F.col("_new") != F.col("_slug")) | F.col("_open")).select("_order", "_new", "_open"))
    if changed.limit(BROADCAST_CHANGES + 1).count() <= BROADCAST_CHANGES:
        changed = F.broadcast(changed)
    out = df.join(changed, F.col(order) == F.col("_order"), "left")
    new = F.coalesce("_new", F.col(slug))
    flag = [] if unsolved is None else [F.coalesce("_open", F.lit(False)).alias(unsolved)]
    return out.select(*[(new.alias(c) if c == slug else F.col(f"`{c}`")) for c in df.columns], *flag)
