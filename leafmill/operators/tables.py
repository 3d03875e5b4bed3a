"""Tables and text columns on a page.

A wide gap in a line that overlaps one of the next line divides columns.  All dividers of a table share their column
boundaries: the fewest places such that each divider has one (gaps sorted by their right ends; one that begins at or
right of the last place opens the next).  So a cell has the same column number in every line, and a gap over two
boundaries leaves a blank cell.  Everything is worked out line by line: elements are gathered into rows of lines once,
and no table is joined with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import PAGE, in_order, kerned_width

#: Spaces that a gap, and what two gaps have in common, must be wider than.
WIDE = 3
_GAP = "array<struct<i:int,l:double,r:double,sp:double>>"


def divide_columns(elements: DataFrame, page: list[str] = PAGE, wide: float = WIDE) -> DataFrame:
    """Adds ``column`` (of its cell, from 0) and ``table_id`` (null outside tables) to elements with seq and line_id.

    A table is a run of lines with a divider each; lines below that begin right of one of its dividers, or leave it free,
    are of it too, and have blank cells.  Without a space width there is no divider.
    """
    own = [c for c in elements.columns if c not in page and c != "line_id"]
    lines = elements.groupBy(*page, "line_id").agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in own if c != "seq"]))).alias("els"))
    width = lambda e: e["tx"] + e["width"]  # noqa: E731  where an element ends
    pairs = F.transform(F.slice("els", F.lit(2), F.size("els")), lambda e, i: F.struct((i + 1).cast("int").alias("i"), width(F.get("els", i)).alias("l"), e["tx"].alias("r"), F.get("els", i)["space_width"].alias("sp")))
    lines = lines.withColumn("gaps", F.filter(pairs, lambda g: g["r"] - g["l"] > wide * g["sp"]).cast(_GAP))
    w = Window.partitionBy(*page).orderBy("line_id")
    next_to = lambda c, f: F.when(f("line_id").over(w) == F.col("line_id") + (1 if f is F.lead else -1), f(c).over(w))
    lines = lines.withColumns({"above": next_to("gaps", F.lag), "below": next_to("gaps", F.lead)})
    common = lambda a, b: F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"])
    some = lambda c: F.coalesce(c, F.array().cast(_GAP))
    # the hole is measured by the space of the lower line
    met = lambda g: F.exists(some(F.col("above")), lambda h: common(g, h) > wide * g["sp"]) | F.exists(some(F.col("below")), lambda h: common(g, h) > wide * h["sp"])
    lines = lines.withColumn("dividers", F.filter("gaps", met))
    # lines without a divider belong to the table above if they begin right of one of its dividers, or leave it free
    has, upto = F.size("dividers") > 0, w.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("over", some(F.last(F.when(has, F.col("dividers")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    first = F.get("els", F.lit(0))
    begun = F.exists("over", lambda h: first["tx"] - h["l"] > wide * first["space_width"])
    free = F.exists("gaps", lambda g: F.exists("over", lambda h: common(g, h) > wide * g["sp"]))
    lines = lines.withColumn("follows", F.coalesce(begun, F.lit(False)) | F.coalesce(free, F.lit(False)))
    lines = lines.withColumn("breaks", F.sum((~has & ~F.col("follows")).cast("int")).over(upto))
    since = F.last(F.when(has, F.col("breaks")), ignorenulls=True).over(upto)
    lines = lines.withColumn("inside", has | (F.col("follows") & F.coalesce(since == F.col("breaks"), F.lit(False))))
    starts = (F.col("inside") & ~F.coalesce(next_to("inside", F.lag), F.lit(False))).cast("int")
    lines = lines.withColumn("starts", starts)
    lines = lines.withColumn("table_id", F.when(F.col("inside"), F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    of_table = F.array_sort(F.flatten(F.collect_list(F.transform("dividers", lambda g: F.struct(g["r"].alias("r"), g["l"].alias("l")))).over(Window.partitionBy(*page, "table_id"))))
    lines = lines.withColumn("places", F.when(F.col("inside"), boundaries(of_table)))
    # a cell begins after each gap of its line that has a boundary; its first element tells its column
    parting = F.filter("gaps", lambda g: F.exists("places", lambda p: (g["l"] < p) & (p <= g["r"])))
    begins = F.concat(F.array(F.lit(0)), F.transform(parting, lambda g: g["i"]))
    cell = lambda i: F.get("els", F.array_max(F.filter(begins, lambda b: b <= i)))["tx"]
    column = lambda i: F.when(F.col("inside"), F.size(F.filter("places", lambda p: p <= cell(i)))).otherwise(F.lit(0)).cast("long")
    numbered = F.transform("els", lambda e, i: F.struct(e.alias("e"), column(i).alias("column")))
    lines = lines.select(*page, "line_id", "table_id", F.explode(numbered).alias("x"))
    return lines.select(*page, "line_id", *[F.col(f"x.e.{c}").alias(c) for c in own], "x.column", "table_id")


def boundaries(gaps: Column) -> Column:
    """The fewest places such that each of the gaps (structs of r and l, sorted by r) has one."""
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(float("-inf")))
    return F.aggregate(gaps, F.array().cast("array<double>"), lambda a, g: F.when(g["l"] >= last(a), F.array_append(a, g["r"])).otherwise(a))


def table_rows(divided: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """(page, table_id, rows): cells by line and column; a column that a line skips is a blank cell."""
    cells = divided.where("table_id is not null").groupBy(*page, "table_id", "line_id", "column").agg(in_order("text", "seq").alias("cell"))
    widest = Window.partitionBy(*page, "table_id")
    cells = cells.withColumn("n", F.max("column").over(widest) + 1)
    lines = cells.groupBy(*page, "table_id", "line_id").agg(F.map_from_entries(F.collect_list(F.struct("column", "cell"))).alias("m"), F.first("n").alias("n"))
    lines = lines.withColumn("cells", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(" "))))
    return lines.groupBy(*page, "table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "cells"))), lambda x: x["cells"]).alias("rows"))


def text_columns(elements: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Adds ``block`` and ``block_column``: text objects of several lines that stand side by side are columns.

    Objects whose heights overlap are one block (a sweep from the top by the lowest line so far); a block with an object
    of several lines has columns (a sweep from the left by the furthest right end so far).  Blocks count from the top,
    columns from 0; ``block`` is null where a block has one column only, or no object of several lines.  Elements other
    than text have neither.
    """
    text = F.col("kind") == "text" if "kind" in elements.columns else F.lit(True)
    right = F.col("width") if "width" in elements.columns else kerned_width(F.col("tj"), F.col("scale_x"))
    of_object = Window.partitionBy(*page, "obj_seq")
    end = F.sum(F.when(text, F.coalesce(right, F.lit(0.0)))).over(Window.partitionBy(*page, "obj_seq", "ty"))
    e = elements.withColumn("__end", F.when(text, F.col("tx") + end))
    # an object whose first element isn't text is none: its number may be that of no text at all
    mine = lambda c: F.when(text, c)
    e = e.withColumns({"__top": F.max(mine(F.col("ty"))).over(of_object), "__low": F.min(mine(F.col("ty"))).over(of_object), "__left": F.min(mine(F.col("tx"))).over(of_object), "__right": F.max("__end").over(of_object)})
    down = Window.partitionBy(*page).orderBy(F.desc_nulls_last("__top"), "__low", "obj_seq", "elem_seq")
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    new = text & F.coalesce(F.col("__top") < F.min("__low").over(before), F.lit(True))
    e = e.withColumn("__new", new.cast("int")).withColumn("block", F.when(text, F.sum("__new").over(down.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    across = Window.partitionBy(*page, "block").orderBy("__left", "__right", "obj_seq", "elem_seq")
    apart = F.col("__left") > F.max("__right").over(across.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("__new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("block_column", F.sum("__new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*page, "block")
    columns = text & (F.max("block_column").over(whole) > 0) & (F.max((F.col("__top") > F.col("__low")).cast("int")).over(whole) > 0)
    e = e.withColumn("__is", columns)
    return e.withColumns({"block": F.when(F.col("__is"), F.col("block")), "block_column": F.when(F.col("__is"), F.col("block_column"))}).drop("__end", "__top", "__low", "__left", "__right", "__new", "__is")
