"""Block types, heading levels and the classes of page blocks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import _c, strip

# The block types of the layout service by the category that they become, and those that become nothing.
CATEGORY_TYPES = {
    "title": ("doc_title", "title", "paragraph_title"),
    "paragraph": ("paragraph", "abstract", "ref_text", "page_aside_text", "footnote", "page_footnote", "index"),
    "list_item": ("list", "text_list", "reference_list"),
    "table": ("table", "table_body", "simple_table", "complex_table", "chart", "chart_body"),
    "formula": ("equation_interline", "interline_equation", "equation"),
    "figure": ("image", "image_body", "seal"),
    "code": ("code", "code_body", "algorithm"),
    "header": ("page_header",),
    "footer": ("page_footer",),
}
IGNORED_TYPES = ("page_number", "discarded", "image_caption", "table_caption", "chart_caption", "algorithm_caption", "code_caption", "caption", "header_image", "footer_image", "formula_number", "code_footnote", "image_footnote", "table_footnote", "chart_footnote")
SPAN_TYPES = ("text", "equation_inline", "inline_equation", "phonetic", "md", "code_inline")
#: Beginnings of list items on a page. Fixed values.
LIST_MARKS = ("•", "·", "- ", "* ", "○", "■")
ZONE = 0.05
HEADING_RATIO, HEADING_CHARS = 1.1, 60


def category(block_type: Column | str) -> Column:
    """The category of a block type; unknown types are paragraphs, ignored and missing ones null."""
    kind = _c(block_type)
    out = F.when(F.coalesce(kind, F.lit("")) == "", None).when(kind.isin(*IGNORED_TYPES), None)
    for name, kinds in CATEGORY_TYPES.items():
        out = out.when(kind.isin(*kinds), name)
    return out.otherwise("paragraph")


def _number_head(text: Column) -> Column:
    """The first word, if it is made of digits and dots."""
    return F.regexp_extract(text, r"^([0-9.]*[0-9][0-9.]*)(?= |$)", 1)


def _dots(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))


def heading_level(level: Column | str, title: Column | str) -> Column:
    """A given level, else the depth of the title's number, else 1."""
    level, head = _c(level).cast("string"), _number_head(_c(title))
    given = F.when(level.rlike(r"^[0-9]+$"), F.coalesce(level.try_cast("int"), F.lit(2**31 - 1)))  # longer numbers are no integers here
    return F.when(given.isNotNull(), F.greatest(F.lit(1), given)).when(head != "", F.least(F.lit(6), _dots(head) + 1)).otherwise(1)


def numbered_heading(text: Column | str) -> Column:
    text = strip(_c(text))
    head = F.when(text.contains(" "), F.split_part(text, F.lit(" "), F.lit(1))).otherwise(F.substring(text, 1, 8))
    return head.rlike(r"^[0-9][0-9.]*$")


def page_heading_level(text: Column | str, size: Column | str, mean: Column | str) -> Column:
    """By number, else by the ratio of the font size to the mean."""
    text, ratio = _c(text), _c(size) / _c(mean)
    head = F.split_part(text, F.lit(" "), F.lit(1))
    return F.when(numbered_heading(text), F.least(F.lit(6), _dots(head) + 1)).when(_c(mean) <= 0, 2).when(ratio >= 1.8, 1).when(ratio >= 1.5, 2).when(ratio >= 1.3, 3).otherwise(4)


def block_class(text: Column | str, size: Column | str, mean: Column | str, y0: Column | str, y1: Column | str, height: Column | str) -> Column:
    """header, footer, list_item, title or paragraph for a text block of a page."""
    text, mean = _c(text), _c(mean)
    listed = F.lit(False)
    for mark in LIST_MARKS:
        listed = listed | text.startswith(mark)
    large = (mean > 0) & (_c(size) >= mean * HEADING_RATIO) & (F.length(text) < HEADING_CHARS)
    return F.when(_c(y1) <= _c(height) * ZONE, "header").when(_c(y0) >= _c(height) * (1 - ZONE), "footer").when(listed, "list_item").when(numbered_heading(text) | large, "title").otherwise("paragraph")


def is_caption(text: Column | str) -> Column:
    head = F.lower(F.regexp_replace(_c(text), r"^(?U)\s+", ""))
    return head.startswith("图") | head.startswith("fig")


def bbox(values: Column | str) -> Column:
    """The first four of a list of numbers as a box, null if there are fewer."""
    v = _c(values)
    return F.when(F.size(v) >= 4, F.struct(*[F.get(v, F.lit(i)).cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]))


def placeholder(kind: str, page: Column | str, box: Column | str) -> Column:
    """What stands for a table or formula whose content is unknown."""
    box = _c(box)
    return F.format_string(f"[{kind}: page=%d, bbox=(%s, %s, %s, %s)]", _c(page), box["x0"], box["y0"], box["x1"], box["y1"])
