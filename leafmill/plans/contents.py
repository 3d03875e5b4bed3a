"""From text elements to page contents: the layout steps in order.

Elements are dealt out by page once; every step after that is a window or a group-by within
a page, so no other shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import stored
from ..functions import scalars
from ..operators import fonts, tables
from ..operators import layout as L


def measured(elements: DataFrame, page: list[str] = L.PAGE) -> DataFrame:
    """Text elements with ``text`` by kerning, ``width``, ``space_width`` (null: unknown) and ``tx`` where they begin.

    A font without widths has the commonest backward kerning of the page as its space.
    """
    e = elements.where("kind = 'text'")
    e = e if "run" in page else e.repartition(*page)  # runs are dealt out by their page already
    adj = F.filter(F.transform("tj", lambda x: x["adj"]), lambda a: a < 0)
    of_font = Window.partitionBy(*page, "font_key")
    # the mode of the page's kerning: values of a page by font, in order
    all_adj = F.transform(F.array_sort(F.collect_list(F.when(F.col("font_space").isNull() & (F.size(adj) > 0), F.struct("obj_seq", "elem_seq", adj.alias("a")))).over(of_font)), lambda x: x["a"])
    e = e.withColumn("__mode", F.when(F.col("font_space").isNull(), _mode(F.flatten(all_adj))))
    e = e.withColumn("__space", F.coalesce("font_space", "__mode"))
    e = e.withColumns({"text": L.kerned_text(F.col("tj"), F.col("__space")), "width": L.kerned_width(F.col("tj"), F.col("scale_x")), "space_width": F.col("__space") / 1000 * F.col("scale_x")})
    return L.advance(e.drop("__mode", "__space"), page)


def _mode(adjustments: Column) -> Column:
    """The commonest width of backward kerning; of equally common ones that which reached its count first."""
    values = F.array_distinct(adjustments)
    places = lambda v: F.filter(F.transform(adjustments, lambda x, i: F.when(x == v, i)), lambda i: i.isNotNull())
    ranked = F.transform(values, lambda v: F.struct(F.size(places(v)).alias("n"), (-F.array_max(places(v))).alias("last"), (-v).alias("w")))
    return F.array_max(ranked)["w"]


def page_elements(elements: DataFrame, page: list[str] = L.PAGE) -> DataFrame:
    """Elements in reading order with line, group, table and column; spaces stand in ``text``."""
    e = L.lines_and_groups(L.reading_order(measured(elements, page), page), page)
    return L.insert_spaces(tables.divide_columns(e, page), page)


def page_lines(elements: DataFrame, page: list[str] = L.PAGE) -> DataFrame:
    """(page, group_id, line_id, line_text, ...): lines of each page from top to bottom, those of tables included."""
    e = tables.text_columns(measured(elements, page), page)
    e = L.lines_and_groups(L.reading_order(e, page), page)
    return L.line_texts(L.insert_spaces(e, page), page)


def page_parts(elements: DataFrame, page: list[str] = L.PAGE) -> DataFrame:
    """(page, run, seq, kind, group_id, indent, text, rows): paragraphs and tables of each page in order, blank lines left out.

    Text between images, and each text column, is laid out by itself, run by run.  Whether a line is full is measured
    by widths if all fonts of the page have them, else in characters.  The elements with their lines, groups and tables
    are written once; text and tables are made from that.
    """
    elements, page = L.text_runs(tables.text_columns(elements.repartition(*page), page), page), [*page, "run"]
    e = stored(page_elements(elements, page).withColumn("metric", F.bool_and("metric").over(Window.partitionBy(*page))))
    e = e.repartition(*page[:-1])
    by_line = [*page, "group_id", "line_id"]
    chars = e.where("table_id is null").groupBy(*by_line).agg(L.in_order("text", "seq").alias("line_text"), F.min_by("tx", "seq").alias("line_x"), F.sum("width").alias("line_width"), F.max_by("text", "seq").alias("last_text"), (~F.bool_and("metric")).alias("chars"))
    made = L.paragraphs(chars.where(F.trim("line_text") != ""), page, F.col("chars"))
    texts = L.indent_levels(made, page).select(*page, F.col("first_line").alias("seq"), F.lit("text").alias("kind"), "group_id", "indent", scalars.collapse_spaces(F.col("text")).alias("text"), F.lit(None).cast("array<array<string>>").alias("rows"))
    t = e.where("table_id is not null")
    where = t.groupBy(*page, "table_id").agg(F.min("line_id").alias("seq"), F.min("group_id").alias("group_id"))
    found = tables.table_rows(t, page).join(where, [*page, "table_id"])
    cells = found.select(*page, "seq", F.lit("table").alias("kind"), "group_id", F.lit(0).alias("indent"), L.render_table(F.col("rows")).alias("text"), "rows")
    return texts.unionByName(cells)


def page_texts(elements: DataFrame, page: list[str] = L.PAGE) -> DataFrame:
    """One text per page: paragraphs and tables joined by line feeds, groups by an empty line."""
    joined = lambda order, value, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), sep)
    groups = page_parts(elements, page).groupBy(*page, "run", "group_id").agg(joined("seq", "text", "\n").alias("t"), F.struct("run", F.min("seq")).alias("first"))
    return groups.groupBy(*page).agg(joined("first", "t", "\n\n").alias("text"))


def page_spans(elements: DataFrame, page: list[str] = L.PAGE) -> DataFrame:
    """(page, line_id, seq, text, family, rgb): neighbours of one font and colour; bright colours are darkened, parts are 0 to 255 (-1: unset)."""
    e = page_elements(elements, page)
    families = e.groupBy(*page, "font_key").agg(F.first("base_font", ignorenulls=True).alias("base_font"))
    spans = L.merge_styles(e, page).join(families, [*page, "font_key"], "left")
    colour = scalars.to_255(scalars.darken_bright(F.col("rgb")))
    return spans.select(*page, "line_id", "seq", "text", fonts.typeface(fonts.font_name(F.coalesce("base_font", F.lit("")))).alias("family"), colour.alias("rgb"))
