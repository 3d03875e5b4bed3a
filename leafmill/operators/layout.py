"""Reading order, lines, groups, paragraphs and styles as windows over text elements.

``page`` names the columns that identify a page's content stream; every window is
partitioned by them, so a page is the largest unit that one task must hold in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["file_id", "page_index", "stream_seq"]


def reading_order(elements: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Adds ``seq``: objects from top to bottom, then left to right, by their first element; elements of an object stay in order.

    Where ``tables.text_columns`` has found columns, a block of them stands where its top is, and is read column by column.
    """
    own = Window.partitionBy(*page, "obj_seq").orderBy("elem_seq")
    e = elements.withColumn("__y", F.first("ty").over(own)).withColumn("__x", F.first("tx").over(own)).withColumn("__top", F.col("__y"))
    by = [F.desc("__y"), "__x", "obj_seq", "elem_seq"]
    if "block" in elements.columns:
        top = F.max("__y").over(Window.partitionBy(*page, "block"))
        e = e.withColumn("__top", F.when(F.col("block").isNull(), F.col("__y")).otherwise(top))
        by = [F.desc("__top"), F.asc_nulls_first("block"), "block_column", *by]
    return e.withColumn("seq", F.row_number().over(Window.partitionBy(*page).orderBy(*by))).drop("__y", "__x", "__top")


def text_runs(elements: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Adds ``run`` to elements of all kinds, in reading order: text between two images or external objects is one run, and so is a text column."""
    order = Window.partitionBy(*page).orderBy("seq")
    e = reading_order(elements, page)
    turn = F.col("kind") != "text"
    if "block" in elements.columns:
        turn = turn | ~(F.lag("block", 1).over(order).eqNullSafe(F.col("block")) & F.lag("block_column", 1).over(order).eqNullSafe(F.col("block_column")))
    e = e.withColumn("__turn", turn.cast("int"))
    return e.withColumn("run", F.sum("__turn").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("seq", "__turn")


def advance(elements: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Moves ``tx`` of an element that follows another without a move (``moved`` is false) to where that ends."""
    own = Window.partitionBy(*page, "obj_seq").orderBy("elem_seq")
    e = elements.withColumn("__run", F.sum(F.col("moved").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*page, "obj_seq", "__run").orderBy("elem_seq").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("tx", F.col("tx") + F.coalesce(F.sum("width").over(before), F.lit(0.0))).drop("__run")


def lines_and_groups(elements: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Adds ``line_id`` and ``group_id``: a step of less than the height stays on the line, of less than two in the group."""
    w = Window.partitionBy(*page).orderBy("seq")
    dy = F.abs(F.col("ty") - F.lag("ty").over(w))
    e = elements.withColumn("__line", F.coalesce((dy >= F.col("scale_y")).cast("int"), F.lit(0)))
    e = e.withColumn("__group", F.coalesce((dy >= 2 * F.col("scale_y")).cast("int"), F.lit(0)))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("line_id", F.sum("__line").over(upto)).withColumn("group_id", F.sum("__group").over(upto)).drop("__line", "__group")


def insert_spaces(elements: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Prefixes ``text`` with a space where the gap to the element before on its line is at least half a space.

    Without a known width there is always a space; none if either side has one, or is empty.  Cells of a table (``column``)
    are apart already.
    """
    w = Window.partitionBy(*page, "line_id", *(["column"] if "column" in elements.columns else [])).orderBy("seq")
    before, end = F.lag("text").over(w), F.lag(F.col("tx") + F.col("width")).over(w)
    gap = F.coalesce(F.col("tx") - end >= F.col("space_width") / 2, F.lit(True))
    apart = before.isNotNull() & (before != "") & (F.col("text") != "") & ~F.endswith(before, F.lit(" ")) & ~F.startswith("text", F.lit(" ")) & gap
    return elements.withColumn("text", F.when(apart, F.concat(F.lit(" "), "text")).otherwise(F.col("text")))


def in_order(value: str, order: str) -> Column:
    """The strings of a group, joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "")


def line_texts(elements: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """One row per line: its group, text, left edge, width, and text of its last element; blank lines go."""
    lines = elements.groupBy(*page, "group_id", "line_id").agg(
        in_order("text", "seq").alias("line_text"), F.min_by("tx", "seq").alias("line_x"), F.sum("width").alias("line_width"), F.max_by("text", "seq").alias("last_text")
    )
    return lines.where(F.trim("line_text") != "")


def page_width(lines: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """The widest line of each page, by width and in characters."""
    return lines.groupBy(*page).agg(F.max("line_width").alias("page_width"), F.max(F.char_length("line_text")).alias("page_chars"))


def list_groups(lines: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Groups all of whose lines end with a full stop are lists."""
    return lines.groupBy(*page, "group_id").agg(F.bool_and(F.endswith("last_text", F.lit("."))).alias("is_list"))


def paragraphs(lines: DataFrame, page: list[str] = PAGE, by_chars: bool | Column = False) -> DataFrame:
    """(page, group_id, paragraph, text, line_x): a line joins the one before if that fills 0.8 of the page's width.

    A hyphen at the end of a line is dropped where the next joins it, else a space comes between.  By
    characters (a column may say so for each page), a joined line counts the space before it.  Lists keep their lines.
    """
    whole, group = Window.partitionBy(*page), Window.partitionBy(*page, "group_id")
    d = lines.withColumn("by_chars", by_chars if isinstance(by_chars, Column) else F.lit(by_chars))
    d = d.withColumn("page_width", F.max("line_width").over(whole)).withColumn("page_chars", F.max(F.char_length("line_text")).over(whole))
    d = d.withColumn("is_list", F.bool_and(F.endswith("last_text", F.lit("."))).over(group))
    grp = [*page, "group_id"]
    # whether a line has a space before it depends on the line before: carried along the group's lines
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.lit(False).alias("hyphen"), F.array().cast("array<int>").alias("ids"))

    def step(a: Column, x: Column) -> Column:
        some = F.size(a["ids"]) > 0
        joins = some & ~x["is_list"] & a["full"]
        length = F.char_length(x["line_text"]) + (joins & ~a["hyphen"]).cast("int")
        full = F.when(x["by_chars"], length >= 0.8 * x["page_chars"]).otherwise(F.coalesce(x["line_width"] >= 0.8 * x["page_width"], F.lit(False)))
        n = a["n"] + (~joins & some).cast("int")
        return F.struct(n.alias("n"), full.alias("full"), F.endswith(x["line_text"], F.lit("-")).alias("hyphen"), F.concat(a["ids"], F.array(n)).alias("ids"))

    row = F.struct("line_id", "line_text", "line_x", "line_width", "is_list", "page_chars", "page_width", "by_chars")
    g = d.groupBy(*grp).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    g = g.withColumn("ids", F.aggregate("rows", start, step, lambda a: a["ids"]))
    d = g.select(*grp, F.explode(F.arrays_zip("rows", "ids")).alias("z")).select(*grp, "z.rows.*", F.col("z.ids").alias("paragraph"))
    mine = Window.partitionBy(*grp, "paragraph").orderBy("line_id")
    first, last = F.lag("line_id").over(mine).isNull(), F.lead("line_id").over(mine).isNull()
    hyphen = F.coalesce(F.endswith(F.lag("line_text").over(mine), F.lit("-")), F.lit(False))
    body = F.when(last, F.col("line_text")).otherwise(F.regexp_replace("line_text", "-$", ""))
    d = d.withColumn("piece", F.concat(F.when(first | hyphen, F.lit("")).otherwise(F.lit(" ")), body))
    return d.groupBy(*grp, "paragraph").agg(in_order("piece", "line_id").alias("text"), F.min_by("line_x", "line_id").alias("line_x"), F.min("line_id").alias("first_line"), F.count("*").alias("n_lines"))


def indent_levels(rows: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Adds ``indent``: the rank of the left edge among those of the group."""
    return rows.withColumn("indent", F.dense_rank().over(Window.partitionBy(*page, "group_id").orderBy("line_x")) - 1)


def merge_styles(elements: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Neighbours on a line with the same font and colour become one element."""
    w = Window.partitionBy(*page, "line_id").orderBy("seq")
    new = ~(F.col("font_key").eqNullSafe(F.lag("font_key").over(w)) & F.col("rgb").eqNullSafe(F.lag("rgb").over(w)))
    e = elements.withColumn("__run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(*page, "line_id", "__run").agg(
        F.min("seq").alias("seq"), F.first("font_key").alias("font_key"), F.first("rgb").alias("rgb"), in_order("text", "seq").alias("text")
    ).drop("__run")


def space_width_by_mode(adjustments: DataFrame, key: list[str]) -> DataFrame:
    """The commonest width of backward kerning by font (``adj`` in the order of ``pos``); ties: the one that got there first."""
    n = adjustments.where("adj < 0").groupBy(*key, (-F.col("adj")).alias("w")).agg(F.count("*").alias("n"), F.max("pos").alias("last"))
    return n.groupBy(*key).agg(F.max_by("w", F.struct("n", (-F.col("last")).alias("l"))).alias("space_width"))


def min_nonzero(widths: Column) -> Column:
    """The smallest width of a map that isn't zero."""
    return F.array_min(F.filter(F.map_values(widths), lambda w: w != 0))


def kerned_text(tj: Column, space_width: Column) -> Column:
    """Text of an array of struct(s, adj), adj standing before s: a space where -adj is at least 0.6 of a space."""
    return F.array_join(F.transform(tj, lambda x: F.concat(F.when(-x["adj"] >= 0.6 * space_width, F.lit(" ")).otherwise(F.lit("")), x["s"])), "")


def glyph_widths(tj: Column, widths: Column, missing: Column) -> Column:
    """Adds ``w`` to the structs (s, adj): the sum of the characters' widths; one without a width has the missing one."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    one = lambda c: F.coalesce(F.try_element_at(widths, F.ascii(c)), missing)
    total = lambda s: F.aggregate(F.transform(chars(s), one), F.lit(0.0), lambda a, b: a + b)
    return F.transform(tj, lambda x: F.struct(x["s"].alias("s"), x["adj"].alias("adj"), total(x["s"]).alias("w")))


def kerned_width(tj: Column, scale: Column) -> Column:
    """Sum of the widths of an array of struct(s, adj, w) less adjustments, in thousandths of the scale; null if one is unknown."""
    return F.aggregate(tj, F.lit(0.0), lambda a, x: a + x["w"] - F.coalesce(x["adj"], F.lit(0.0))) / 1000 * scale


def render_table(rows: Column) -> Column:
    """Cells joined by bars, rows by line feeds."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " || ")), "\n")
