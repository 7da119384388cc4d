"""Pages of spans to elements: blocks, their classes, columns and reading order, tables across pages, captions.

PDF files are read where a reader for them is installed; what the engine works on is its output as rows: spans
(doc_id, page, width, height, block, block_type, x0, y0, x1, y1, span, text, size, font).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import layout as Y
from tessella.functions import tables as B
from tessella.functions import text as X
from tessella.sources.elements import heading_path

SHORT = 30
CAPTION_REACH = 0.3


def page_layout(spans: DataFrame) -> DataFrame:
    """One row per block: class, text, largest size, first font, column, and place in reading order.

    The mean font size is that of a page's spans with text. The first and last text block of a page go, if they are
    short and lie in the margin. Two columns are told by a gap of left edges more than twice the mean gap.
    """
    page = ["doc_id", "page"]
    text = X.strip(F.coalesce("text", F.lit("")))
    spans = spans.withColumn("_t", text).withColumn("_mean", F.coalesce(F.avg(F.when((F.col("block_type") == 0) & (text != ""), F.col("size"))).over(Window.partitionBy(*page)), F.lit(0.0)))
    rest = [F.first(c).alias(c) for c in ("width", "height", "block_type", "x0", "y0", "x1", "y1", "_mean")]
    listed = F.filter(F.sort_array(F.collect_list(F.struct("span", "_t", "font"))), lambda x: x["_t"] != "")
    block = spans.groupBy(*page, "block").agg(*rest, listed.alias("_l"), F.coalesce(F.max(F.when(F.col("_t") != "", F.col("size"))), F.lit(0.0)).alias("font_size"))
    block = block.withColumns({"text": F.array_join(F.transform("_l", lambda x: x["_t"]), " "), "font_name": F.get("_l", F.lit(0))["font"]}).drop("_l")
    block = block.where((F.col("block_type") != 0) | (F.col("text") != ""))
    kind = Y.block_class("text", "font_size", "_mean", "y0", "y1", "height")
    block = block.withColumn("category", F.when(F.col("block_type") == 1, "figure").when(F.col("block_type") != 0, "table").otherwise(kind))
    texts = Window.partitionBy(*page, (F.col("block_type") == 0)).orderBy("block")
    edge = lambda f: f("text").over(texts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    block = block.withColumns({"_head": edge(F.first), "_foot": edge(F.last)})
    nth = F.row_number().over(Window.partitionBy(*page, "text", "category").orderBy("block"))
    gone = (nth == 1) & (((F.col("category") == "header") & (F.col("text") == F.col("_head")) & (F.length("text") < SHORT)) | ((F.col("category") == "footer") & (F.col("text") == F.col("_foot")) & (F.col("_foot") != F.col("_head")) & (F.length("text") < SHORT)))
    block = block.withColumn("_gone", gone).where("not _gone").drop("_gone", "_head", "_foot")
    return reading_order(columns(block))


def columns(block: DataFrame) -> DataFrame:
    """column: 1 for blocks whose centre lies right of the page's widest gap of left edges, if that is a gap of columns."""
    w = Window.partitionBy("doc_id", "page")
    row = block.withColumn("_gap", F.col("x0") - F.lag("x0").over(w.orderBy("x0", "block"))).withColumn("_left", F.lag("x0").over(w.orderBy("x0", "block")))
    row = row.withColumns({"_n": F.count("*").over(w), "_avg": F.avg("_gap").over(w), "_max": F.max("_gap").over(w)})
    cut = F.min(F.when(F.col("_gap") == F.col("_max"), (F.col("x0") + F.col("_left")) / 2)).over(w)
    two = (F.col("_n") >= 4) & (F.col("_max") > 2 * F.col("_avg"))
    return row.withColumn("_cut", cut).withColumn("column", F.when(two & ((F.col("x0") + F.col("x1")) / 2 >= F.col("_cut")), 1).otherwise(0)).drop("_gap", "_left", "_n", "_avg", "_max", "_cut")


def reading_order(block: DataFrame) -> DataFrame:
    return block.withColumn("order", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("column", "y0", "x0", "block")) - 1)


def layout_counts(block: DataFrame) -> DataFrame:
    return block.groupBy("doc_id", "page", "category").agg(F.count("*").alias("n"))


def tables_of(matrices: DataFrame) -> DataFrame:
    """matrices (doc_id, page, place, matrix: array<array<string>>) as tables: header, rows, cells, markdown, html, error.

    The first row is the header, whatever the widths; line ends in a cell are blanks, null cells empty, ends stripped. A
    null or empty matrix and a null row are no table: everything is empty, and error says why.
    """
    cell = lambda c: X.strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    error = F.when(F.coalesce(F.size("matrix"), F.lit(0)) <= 0, "no rows").when(F.exists("matrix", lambda r: r.isNull()), "a row is missing")
    none = F.array().cast("array<array<string>>")
    row = matrices.withColumn("error", error).withColumn("_m", F.when(F.col("error").isNull(), F.transform("matrix", lambda r: F.transform(r, cell))).otherwise(none))
    row = row.withColumns({"header": F.coalesce(F.get("_m", F.lit(0)), F.array().cast("array<string>")), "rows": F.slice("_m", 2, F.greatest(F.size("_m") - 1, F.lit(0)))})
    listed = F.flatten(F.transform("_m", lambda r, i: F.transform(r, lambda c, j: F.struct(i.alias("row"), j.alias("col"), c.alias("text")))))
    return row.withColumns({"cells": listed, "markdown": B.to_markdown("header", "rows"), "html": B.to_html("header", "rows")}).drop("_m", "matrix")


def merge_tables(tables: DataFrame) -> DataFrame:
    """tables (doc_id, page, place, header, rows) with those that go on from the one before united: equal headers, without case."""
    order = Window.partitionBy("doc_id").orderBy("page", "place")
    key = F.transform("header", lambda c: F.lower(X.strip(c)))
    row = tables.withColumn("_key", key)
    follows = (F.size("_key") > 0) & (F.col("_key") == F.lag("_key").over(order))
    row = row.withColumn("_group", F.sum((~F.coalesce(follows, F.lit(False))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page", "place", "rows"))), lambda x: x["rows"]))
    out = row.groupBy("doc_id", "_group").agg(F.min("page").alias("page"), F.min_by("place", F.struct("page", "place")).alias("place"), F.min_by("header", F.struct("page", "place")).alias("header"), body.alias("rows"), F.count("*").alias("parts"))
    return out.drop("_group").withColumns({"markdown": B.to_markdown("header", "rows"), "html": B.to_html("header", "rows")})


def captions(block: DataFrame) -> DataFrame:
    """doc_id, page, block, caption: for each figure the nearest caption of its page within three tenths of the page's longer side."""
    figure = block.where("category = 'figure'").select("doc_id", "page", F.col("block").alias("_b"), ((F.col("x0") + F.col("x1")) / 2).alias("_x"), ((F.col("y0") + F.col("y1")) / 2).alias("_y"))
    texts = block.where((F.col("category") == "paragraph") & Y.is_caption("text"))
    far = F.sqrt(((F.col("x0") + F.col("x1")) / 2 - F.col("_x")) ** 2 + ((F.col("y0") + F.col("y1")) / 2 - F.col("_y")) ** 2)
    near = figure.join(texts, ["doc_id", "page"]).withColumn("_d", far).where(F.col("_d") < F.greatest("width", "height") * CAPTION_REACH)
    return near.groupBy("doc_id", "page", F.col("_b").alias("block")).agg(F.min_by("text", F.struct("_d", "order")).alias("caption"))


def elements(spans: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Titles, paragraphs, tables (those found at a block's box) and captioned figures in reading order, with heading paths."""
    block = page_layout(spans)
    # The document's mean is that of its pages' means, which are means of their blocks' largest sizes.
    pages = block.where("font_size > 0").groupBy("doc_id", "page").agg(F.avg("font_size").alias("m")).groupBy("doc_id").agg(F.avg("m").alias("_doc_mean"))
    row = block.join(pages, "doc_id", "left").join(captions(block), ["doc_id", "page", "block"], "left")
    box = ["x0", "y0", "x1", "y1"]
    if tables is not None:
        row = row.join(tables.select("doc_id", "page", *box, B.to_markdown("header", "rows").alias("_md")), ["doc_id", "page", *box], "left")
    else:
        row = row.withColumn("_md", F.lit(None).cast("string"))
    level = F.when(F.col("category") == "title", Y.page_heading_level("text", "font_size", F.coalesce("_doc_mean", F.lit(0.0))))
    row = row.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "order"))).withColumn("_level", level)
    past = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    row = row.withColumn("heading_path", F.filter(heading_path(F.col("_level"), F.col("text"), past), lambda p: p != ""))
    content = F.when(F.col("category") == "table", F.col("_md")).when(F.col("category") == "figure", F.col("caption")).when(F.col("category").isin("title", "paragraph"), F.col("text"))
    row = row.withColumn("content", content).where("content is not null")
    return row.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).alias("chunk_index"), "content", "category", "heading_path", (F.col("page") + 1).alias("page"), F.expr("cast(map() as map<string, string>)").alias("extra"))
