"""Token table: nested markup as rows, matched with windows.

``split`` turns a page into tokens, one row each. A running count per tag name
gives the nesting level; the next token of the same page, tag and level is the
matching close. Pages are distributed once, by key, before they are exploded, and
every window reuses that distribution. Main-content extraction sends only an index of the tags through
the windows: positions, lengths and flags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType, StringType

from pagemill.functions.text import WS_TEXT, holds, nonblank, once, squeeze_newlines, strip_long, strip_ws, tag_like
from pagemill.functions.html import (
    remove_empty_wrappers, strip_layout_attributes, strip_page_shell,
)
from pagemill.session import task_count

# Class and id vocabularies of layout markup.
BUILDER_CLASS_PARTS = [
    "et_pb_", "et_builder_", "et-l", "et-boc", "et-main", "elementor-", "vc_", "fl-", "fusion-",
    "av-", "cs-", "wp-block-", "site-content", "entry-content", "page-content",
]
CONTAINER_IDS = [
    "page-container", "main-content", "et-boc", "et-main-area", "content-area", "primary",
    "site-content", "page", "wrapper", "main", "content", "app", "root",
]
CONTENT_CLASSES = [
    "et_pb_text_inner", "elementor-widget-container", "vc_column-inner", "fl-rich-text",
    "fusion-text", "av-special-heading", "entry-content", "post-content", "article-content",
    "page-content",
]
LAYOUT_TAGS = ["div", "section", "article", "main", "header", "footer", "aside", "nav"]
STRUCTURE_TAGS = ["div", "section", "article", "main", "header", "footer", "aside", "nav", "span"]
NESTED_BLOCK_TAGS = ["div", "section", "article", "main", "aside", "nav"]
CONTENT_CONTAINER_TAGS = ["div", "span", "section", "article"]
REMOVABLE_TAGS = ["div", "section", "article", "aside", "nav"]
SEMANTIC_IN_CONTAINER = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "blockquote", "table", "img"]
SEMANTIC_IN_WRAPPER = SEMANTIC_IN_CONTAINER + ["figure"]
LAYOUT_WORDS = (
    r"(?i)\b(wrap|wrapper|container|row|column|col|inner|outer|grid|layout|main|content-area|site-main|page-wrap)\b"
)
KEPT_LAYOUT_WORDS = r"(?i)\b(wrap|wrapper|container|row|column|grid|layout|site-main|page-wrap)\b"
LAYOUT_ID_WORDS = r"(?i)^(wrap|wrapper|container|page|main|content|primary|site|app|root|layout)\z"
WIDE_COLUMNS = ["et_pb_column_2_3", "et_pb_column_3_4"]
NARROW_COLUMNS = ["et_pb_column_1_3", "et_pb_column_1_4"]
SIDEBAR_WORDS = ["sidebar", "widget-area", "secondary-content", "aside-content"]
SIDEBAR_HINT = r"(?i)" + "|".join(rf"\b{w}\b" for w in SIDEBAR_WORDS)
SIDEBAR_CLASSES = ["sidebar", "widget-area"]
SIDEBAR_KEEP_SHARE = 0.95


def _contains_any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(c, F.lit(part))
    return out


def _attr(attrs: Column, name: str) -> Column:
    return F.regexp_extract(attrs, rf"""(?i){name}=["']([^"']*)["']""", 1)


def distribute(df: DataFrame, key: str) -> DataFrame:
    """Hash the rows by key once, into tasks for the size of the input.

    The count is named so that adaptive execution does not fold the tasks together on the
    small size of the unexploded pages.
    """
    return df.repartition(task_count(df), F.col(key))


Keys = str | list[str]


def _keys(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def split_at_tags(html: Column, tags: list[str]) -> Column:
    """A page cut before each of its structural tags."""
    return F.split(F.coalesce(html, F.lit("")), rf"(?i)(?=</?(?:{'|'.join(tags)})(?:\s|>|/))")


def has_tags(html: Column, tags: list[str]) -> Column:
    """Whether ``split_at_tags`` would cut a text."""
    return F.contains(html, F.lit("<")) & html.rlike(rf"(?i)</?(?:{'|'.join(tags)})(?:\s|>|/)")


def tokenize(df: DataFrame, key: Keys, html: str, tags: list[str], carry: list[str] | None = None) -> DataFrame:
    """One row per structural tag: ``key, pos, head, tail, tag, kind, attrs`` and the carried columns.

    ``head`` is the tag itself and ``tail`` everything up to the next structural tag, so
    running text and inline markup cost no rows. ``kind`` is ``open``, ``close``,
    ``single`` or ``text``. Concatenating head and tail by ``pos`` gives the page back.
    """
    rows = df.select(*_keys(key), *(carry or []), F.posexplode(split_at_tags(F.col(html), tags)).alias("pos", "_piece"))
    head = F.regexp_extract("_piece", rf"(?i)^</?(?:{'|'.join(tags)})(?:\s[^>]*|/)?>", 0)
    rows = rows.withColumn("head", F.when(F.startswith("_piece", F.lit("<")), head).otherwise(""))
    rows = rows.withColumn("tail", F.expr("substr(_piece, length(head) + 1)")).drop("_piece")
    kind = (
        F.when(F.col("head") == "", "text")
        .when(F.startswith("head", F.lit("</")), "close")
        .when(F.col("head").rlike(r"^<[a-zA-Z]+/>\z"), "single")
        .otherwise("open")
    )
    return (
        rows.withColumn("tag", F.lower(F.regexp_extract("head", r"^</?([a-zA-Z]+)", 1)))
        .withColumn("kind", kind)
        .withColumn("attrs", F.when(F.col("kind") == "open", F.regexp_extract("head", r"(?s)^<[a-zA-Z]+(.*)>\z", 1)).otherwise(""))
    )


def with_levels(tokens: DataFrame, key: Keys) -> DataFrame:
    """Add ``level``: equal on an opening tag and its matching close."""
    w = Window.partitionBy(*_keys(key), "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    delta = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    running = F.sum(delta).over(w)
    return tokens.withColumn("level", F.when(F.col("kind") == "close", running + 1).otherwise(running))


def _pair_window(key: Keys):
    return Window.partitionBy(*_keys(key), "tag", "level", F.col("kind").isin("open", "close")).orderBy("pos")


def with_close(tokens: DataFrame, key: Keys) -> DataFrame:
    """Add ``close_pos`` on every opening tag, NULL when it is never closed."""
    w = _pair_window(key)
    return with_levels(tokens, key).withColumn(
        "close_pos",
        F.when((F.col("kind") == "open") & (F.lead("kind").over(w) == "close"), F.lead("pos").over(w)),
    )


def drop_spans(tokens: DataFrame, key: Keys, unwanted: Column) -> DataFrame:
    """Mark what survives when every matched ``unwanted`` element goes, content included.

    Adds ``_keep_head`` and ``_keep_tail``.
    """
    pairs = _pair_window(key)
    running = Window.partitionBy(*_keys(key)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        with_close(tokens, key)
        .withColumn("_open_cut", F.coalesce(unwanted & F.col("close_pos").isNotNull(), F.lit(False)))
        .withColumn(
            "_close_cut",
            F.coalesce((F.col("kind") == "close") & F.lag("_open_cut").over(pairs), F.lit(False)),
        )
        .withColumn("_depth", F.sum(F.col("_open_cut").cast("int") - F.col("_close_cut").cast("int")).over(running))
    )
    return marked.withColumn("_keep_tail", F.col("_depth") == 0).withColumn(
        "_keep_head", (F.col("_depth") == 0) & ~F.col("_close_cut")
    )


def span_index(tokens: DataFrame, key: Keys) -> DataFrame:
    """What the rules ask of each token, without its text: lengths, and flags of its attributes and its tail."""
    attrs, tail = F.col("attrs"), F.col("tail")
    cls, ident = _attr(attrs, "class"), F.lower(strip_ws(_attr(attrs, "id")))
    removable = F.col("tag").isin(REMOVABLE_TAGS)
    side = (
        F.when(F.col("_layout") == "columns", removable & _contains_any(cls, NARROW_COLUMNS))
        .when(F.col("_layout") == "aside", F.col("tag") == "aside")
        .when(F.col("_layout") == "sidebar", removable & F.lower(cls).rlike("|".join(SIDEBAR_CLASSES)))
        .otherwise(F.lit(False))
    )
    is_open = F.col("kind") == "open"
    return tokens.select(
        *_keys(key), "pos", "tag", "kind", F.length("head").alias("head_len"), F.length("tail").alias("tail_len"), (F.col("_layout") == "sidebar").alias("by_share"),
        (is_open & side).alias("side"), _is_layout_wrapper().alias("wrapper"),
        (is_open & F.col("tag").isin(CONTENT_CONTAINER_TAGS) & _contains_any(cls, CONTENT_CLASSES)).alias("container"),
        (~nonblank(attrs)).alias("bare"), _contains_any(attrs, BUILDER_CLASS_PARTS).alias("builder"),
        (((ident != "") & _contains_any(ident, CONTAINER_IDS)) | cls.rlike(KEPT_LAYOUT_WORDS)).alias("layout_name"),
        tail.rlike(rf"(?i)<(?:{'|'.join(SEMANTIC_IN_CONTAINER)})\b").cast("int").alias("core"), tail.rlike(rf"(?i)<(?:{'|'.join(SEMANTIC_IN_WRAPPER)})\b").cast("int").alias("semantic"),
    )


def main_column(index: DataFrame, key: Keys) -> DataFrame:
    """Drop narrow columns, asides or sidebars, whichever the page's layout calls for: ``keep_head``, ``keep_tail``; tokens of which nothing stays are left out."""
    whole = Window.partitionBy(*_keys(key))
    marked = drop_spans(index, key, F.col("side"))
    kept = F.when(F.col("_keep_head"), F.col("head_len")).otherwise(0) + F.when(F.col("_keep_tail"), F.col("tail_len")).otherwise(0)
    marked = marked.withColumn("_all_len", F.sum(F.col("head_len") + F.col("tail_len")).over(whole)).withColumn("_kept_len", F.sum(kept).over(whole))
    too_little = F.col("by_share") & (F.col("_kept_len") >= F.col("_all_len") * SIDEBAR_KEEP_SHARE)
    marked = marked.withColumn("keep_head", F.col("_keep_head") | too_little).withColumn("keep_tail", F.col("_keep_tail") | too_little)
    gone = ~F.col("keep_head")
    out = marked.where(F.col("keep_head") | F.col("keep_tail"))
    flags = [F.when(gone, F.lit(False)).otherwise(F.col(c)).alias(c) for c in ("wrapper", "container", "bare", "builder", "layout_name")]
    counts = [F.when(F.col("keep_tail"), F.col(c)).otherwise(0).alias(c) for c in ("core", "semantic")]
    kind, tag = F.when(gone, "text").otherwise(F.col("kind")).alias("kind"), F.when(gone, "").otherwise(F.col("tag")).alias("tag")
    return out.select(*_keys(key), "pos", tag, kind, "head_len", *flags, *counts, "keep_head", "keep_tail")


def page_layout(html: Column) -> Column:
    """Which main-column rule applies to a page."""
    return (
        F.when(_contains_any(html, WIDE_COLUMNS) & _contains_any(html, NARROW_COLUMNS), "columns")
        .when(tag_like(html, r"(?i)<aside\b", "<a"), "aside")
        .when(holds(F.lower(html), *SIDEBAR_WORDS) & html.rlike(SIDEBAR_HINT), "sidebar")
        .otherwise("none")
    )


def _is_layout_wrapper() -> Column:
    attrs = F.col("attrs")
    cls, ident = _attr(attrs, "class"), _attr(attrs, "id")
    ident_l = F.lower(strip_ws(ident))
    has_class, has_id = cls != "", ident != ""
    return (
        F.when((F.col("kind") != "open") | ~F.col("tag").isin(LAYOUT_TAGS), F.lit(False))
        .when(~nonblank(attrs), F.lit(True))
        .when(has_class & _contains_any(cls, CONTENT_CLASSES), F.lit(False))
        .when(has_class & _contains_any(cls, BUILDER_CLASS_PARTS), F.lit(True))
        .when(has_id & _contains_any(ident_l, CONTAINER_IDS), F.lit(True))
        .when(has_class & cls.rlike(LAYOUT_WORDS), F.lit(True))
        .when(has_id & ident.rlike(LAYOUT_ID_WORDS), F.lit(True))
        .otherwise(F.lit(False))
    )


def unwrap(index: DataFrame, key: Keys) -> DataFrame:
    """Delete the tags of layout wrappers and of content containers that hold content: ``keep_head``, and which tails lose white space at an edge.

    Closed form of the repeated outer-to-inner unwrapping: a kept wrapper has no nested
    block, so a later pass could not change it.
    """
    pairs = _pair_window(key)
    running = Window.partitionBy(*_keys(key)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy(*_keys(key)).orderBy("pos")
    is_open, is_close = F.col("kind") == "open", F.col("kind") == "close"

    def inside(total: str) -> Column:
        return F.lead(total).over(pairs) - F.col(total)

    t = (
        with_close(index, key)
        .withColumn("_n_core", F.sum("core").over(running) - F.col("core"))
        .withColumn("_n_sem", F.sum("semantic").over(running) - F.col("semantic"))
    )
    closed = F.col("close_pos").isNotNull()
    t = t.withColumn("_opened", F.coalesce(F.col("container") & closed & (inside("_n_core") > 0), F.lit(False)))
    nested = F.col("kind").isin("open", "single") & F.col("tag").isin(NESTED_BLOCK_TAGS) & ~F.col("_opened")
    t = t.withColumn("_n_block", F.sum(nested.cast("int")).over(running))
    cut = (
        F.when(F.col("bare"), F.lit(True))
        .when((inside("_n_block") > 0) | F.col("builder"), F.lit(True))
        .when(inside("_n_sem") > 0, F.col("layout_name"))
        .otherwise(F.lit(True))
    )
    t = t.withColumn("_verdict", F.when(F.col("_opened"), "cut").when(F.col("wrapper") & closed, F.when(cut, "cut").otherwise("keep")))
    t = t.withColumn("_verdict", F.when(is_close, F.lag("_verdict").over(pairs)).otherwise(F.col("_verdict")))
    # Nothing inside a kept wrapper is visited.
    held = F.col("_verdict") == "keep"
    step = F.when(held & is_open, 1).when(held & is_close, -1).otherwise(0)
    t = t.withColumn("_in_kept", F.sum(step).over(running))
    gone = (F.col("_verdict") == "cut") & ((F.col("_in_kept") == 0) | F.col("_opened"))
    t = t.withColumn("_cut", F.coalesce(gone, F.lit(False)))
    # An unwrapped element loses the white space at both inner edges.
    next_cut = F.coalesce(F.lead("_cut").over(order) & (F.lead("kind").over(order) == "close"), F.lit(False))
    return t.select(
        *_keys(key), "pos", "head_len", (F.col("keep_head") & ~F.col("_cut")).alias("keep_head"), "keep_tail",
        (F.col("_cut") & is_open).alias("trim_left"), next_cut.alias("trim_right"))


def kept_text(pieces: Column, spans: Column) -> Column:
    """The text of the spans that stay, of a page cut at its tags."""

    def one(piece: Column, s: Column) -> Column:
        tail = F.substring(piece, s["head_len"] + 1, F.length(piece))
        tail = F.when(s["trim_left"] & s["trim_right"], strip_long(tail)).when(s["trim_left"], F.ltrim(tail, F.lit(WS_TEXT))).when(s["trim_right"], F.rtrim(tail, F.lit(WS_TEXT))).otherwise(tail)
        head = F.when(s["keep_head"], F.substring(piece, F.lit(1), s["head_len"])).otherwise("")
        return F.concat(head, F.when(s["keep_tail"], tail).otherwise(""))

    return once(pieces, lambda p: F.array_join(F.transform(spans, lambda s: one(F.get(p, s["pos"]), s)), ""))


def reassemble(tokens: DataFrame, key: Keys, out: str, carry: str | None = None) -> DataFrame:
    """Tokens back to one text per key, with the carried struct of the first row."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "head", "tail")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat(x["head"], x["tail"])), "")
    extra = [F.first(carry, ignorenulls=True).alias(carry)] if carry else []
    return tokens.groupBy(*_keys(key)).agg(text.alias(out), *extra)


def _filled_key(df: DataFrame, key: str) -> Column:
    """A key without nulls, as these would be filtered on one side of the join and so give it an exchange of its own."""
    kind = df.schema[key].dataType
    if isinstance(kind, (IntegralType, StringType)):
        return F.coalesce(F.col(key), F.lit("") if isinstance(kind, StringType) else F.lit(0).cast(kind))
    return F.col(key)


def _spread_together(df: DataFrame, key: str, body: dict[str, Column], shells: Column) -> tuple[DataFrame, DataFrame]:
    """Rows ``_key, _cell`` of the bodies, and rows ``_key, _no_key, _row, _shells``, both from one exchange behind the steps up to the shells."""
    held = F.struct(*[(F.when(body[c].isNull(), F.col(f"`{c}`")).alias(c) if c in body else F.col(f"`{c}`")) for c in df.columns])
    spread = distribute(df.select(_filled_key(df, key).alias("_key"), F.col(key).isNull().alias("_no_key"), held.alias("_row"), shells.alias("_shells")), "_key")
    # The second part is always true: it names the other column, which would else be left out on this side, and the exchange with it be another one.
    seen = ~F.col("_no_key") & (F.coalesce(F.xxhash64("_row") % 2, F.lit(0)) < 2)
    return spread.select("_key", F.explode(F.filter("_shells", lambda c: seen)).alias("_cell")), spread


def main_content_of_cells(
    df: DataFrame, key: str, cells: dict[str, Column], finish: Callable[[Column], Column]
) -> DataFrame:
    """Main content of several text columns in one pass.

    ``cells`` maps a column to the condition under which its value is a page body; other
    values stay as they are. ``finish`` runs on the extracted text. ``key`` must be unique and not null:
    rows are hashed by it once. An index of the tags, without text, goes through the windows; the verdicts come back as one array per row and are
    applied to the text where it stands, so no text is sorted; only several columns meet in one grouping by key.
    """
    names = list(cells)
    body = {n: F.when(F.coalesce(cells[n] & nonblank(F.col(f"`{n}`")), F.lit(False)), F.col(f"`{n}`")) for n in names}
    shells = F.filter(F.array(*[F.struct(F.lit(i).alias("no"), strip_page_shell(body[n]).alias("shell")) for i, n in enumerate(names)]), lambda c: c["shell"].isNotNull())
    alone = len(names) == 1
    if alone:
        spread = distribute(df, key)
        rows, joined = spread.select(F.col(key).alias("_key"), F.explode(shells).alias("_cell")), spread.withColumn("_key", F.col(key))
    else:
        rows, joined = _spread_together(df, key, body, shells)
    rows = rows.select("_key", F.col("_cell.no").alias("_no"), F.col("_cell.shell").alias("_shell"))
    # A text without such tags stays as it is and needs no index.
    rows = rows.where(has_tags(F.col("_shell"), STRUCTURE_TAGS))
    keys = ["_key", "_no"]
    index = span_index(tokenize(rows.withColumn("_layout", page_layout(F.col("_shell"))), keys, "_shell", STRUCTURE_TAGS, ["_layout"]), keys)
    spans = unwrap(main_column(index, keys), keys)
    fields = ["pos", "head_len", "keep_head", "keep_tail", "trim_left", "trim_right"]
    spans = spans.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_no", *fields))).alias("_spans"))
    joined = joined.join(spans.hint("shuffle_hash"), "_key", "left")

    def finished(rows: DataFrame, shell: Column, own: Column) -> DataFrame:
        # Each step is a column of its own: the optimizer keeps apart what is costly and used more than once.
        rows = rows.withColumn("_shell", shell)
        kept = kept_text(split_at_tags(F.col("_shell"), STRUCTURE_TAGS), F.coalesce(own, F.array()))
        rows = rows.withColumn("_main", F.when(has_tags(F.col("_shell"), STRUCTURE_TAGS), kept).otherwise(F.col("_shell")))
        return rows.withColumn("_main", finish(squeeze_newlines(remove_empty_wrappers(strip_layout_attributes(F.col("_main"))))))

    if alone:
        done = finished(joined, strip_page_shell(body[names[0]]), F.col("_spans"))
        return done.select(*[(F.when(F.col("_shell").isNotNull(), F.col("_main")).otherwise(F.col(f"`{c}`")).alias(c) if c in cells else F.col(f"`{c}`")) for c in df.columns])
    # Several cells of a row are finished as rows, so that the plan holds the steps once; they meet again in one grouping.
    rows = joined.select("_key", "_no_key", "_row", F.when(~F.col("_no_key"), F.col("_spans")).alias("_spans"), F.posexplode_outer("_shells").alias("_at", "_cell"))
    rows = rows.withColumn("_row", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_row")))
    done = finished(rows, F.col("_cell.shell"), F.filter("_spans", lambda s: s["_no"] == F.col("_cell.no")))
    whole = done.groupBy("_key", "_no_key").agg(
        F.first("_row", ignorenulls=True).alias("_row"), F.collect_list(F.when(F.col("_cell").isNotNull(), F.struct("_cell.no", "_main"))).alias("_done"))
    texts = F.map_from_entries(F.col("_done"))
    return whole.select(*[
        (F.coalesce(F.try_element_at(texts, F.lit(names.index(c))), F.col(f"_row.`{c}`")) if c in cells else F.col(f"_row.`{c}`")).alias(c) for c in df.columns])


def extract_main_content(df: DataFrame, key: str, html: str) -> DataFrame:
    """Page shell, side columns, layout wrappers, layout attributes and empty wrappers out.

    Null and blank texts pass unchanged.
    """
    return main_content_of_cells(df, key, {html: F.lit(True)}, lambda c: c)

