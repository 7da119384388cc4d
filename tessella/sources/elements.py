"""Plain text and Markdown to elements: one row per element with category, heading path, index and extra.

Documents come as rows (doc_id, text, ...). Lines are rows and the grammar is windows over a document's lines; only the
fences of code blocks need a walk, one pass with the open fence as its state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.tables import is_separator
from tessella.operators.passes import running

#: Signs that open and close code, and those that begin a line of a list.
FENCES, BULLETS = ("`", "~"), ("*", "+", "-")
_BLANK = " \t\x0b\f\r"
ELEMENT = ["doc_id", "chunk_index", "content", "category", "heading_path", "page", "extra"]
_NO_PATH = "cast(array() as array<string>)"
_NO_EXTRA = "cast(map() as map<string, string>)"


def _leading(line: Column, sign: str) -> Column:
    """How often a line begins with a sign."""
    return F.length(line) - F.length(F.ltrim(line, F.lit(sign)))


def _blank_at(line: Column, place: Column) -> Column:
    return F.substr(line, place, F.lit(1)).isin(*_BLANK)


def heading(line: Column) -> tuple[Column, Column]:
    """Level and title of a line of one to six # with a blank after them; the level of any other line is 0."""
    n = _leading(line, "#")
    level = F.when((n >= 1) & (n <= 6) & _blank_at(line, n + 1), n).otherwise(0)
    return level, F.when(level > 0, F.ltrim(F.substr(line, n + 1), F.lit(_BLANK)))


def fence(line: Column) -> tuple[Column, Column]:
    """The mark that opens code, three signs or more (else empty), and the language after it."""
    mark = F.lit("")
    for sign in FENCES:
        mark = F.when(_leading(line, sign) >= 3, F.repeat(F.lit(sign), _leading(line, sign))).otherwise(mark)
    rest = F.ltrim(F.substr(line, F.length(mark) + 1), F.lit(_BLANK))
    return mark, F.regexp_extract(rest, r"^[\w+-]*", 0)


def is_listed(line: Column) -> Column:
    """Whether a line begins, after blanks, with a bullet or a number and a full stop, and then a blank."""
    text = F.ltrim(line, F.lit(_BLANK))
    first = F.substring_index(F.translate(text, _BLANK, " " * len(_BLANK)), " ", 1)
    number = F.left(first, F.length(first) - 1)
    return _blank_at(text, F.length(first) + 1) & (first.isin(*BULLETS) | (first.endswith(".") & (number != "") & (F.translate(number, "0123456789", "") == "")))


def plain_text(docs: DataFrame) -> DataFrame:
    """Paragraphs between blank lines, stripped, without empty ones, numbered from 0. A null text has none."""
    parts = F.split(F.regexp_replace("text", "\r\n", "\n"), "\n\n")
    kept = F.filter(F.transform(parts, X.strip), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(kept).alias("chunk_index", "content")).select("doc_id", "chunk_index", "content", F.lit("paragraph").alias("category"), F.expr(_NO_PATH).alias("heading_path"), F.lit(1).alias("page"), F.expr(_NO_EXTRA).alias("extra"))


def _code(state: tuple[str, int], line: str, opens: str) -> tuple[tuple[str, int], int]:
    """The mark of the code that is open, the number of code blocks so far, and the block that the line is in (0: none)."""
    mark, n = state
    if mark:
        return ("" if line.startswith(mark) else mark, n), n
    return ((opens, n + 1), n + 1) if opens else (state, 0)


def heading_path(level: Column, title: Column, at: Window) -> Column:
    """The path of headings that hold at a row: per level the last one, if none of a smaller level came after it; gaps are empty."""
    place = F.col("at")
    last = {k: F.last(F.when(level == k, F.struct(place.alias("i"), title.alias("t"))), True).over(at) for k in range(1, 7)}
    current = F.coalesce(F.last(level, True).over(at), F.lit(0))
    shown = []
    for k in range(1, 7):
        above = F.greatest(F.lit(-1), *[F.coalesce(last[m]["i"], F.lit(-1)) for m in range(1, k)]) if k > 1 else F.lit(-1)
        shown.append(F.when(F.coalesce(last[k]["i"], F.lit(-2)) > above, last[k]["t"]).otherwise(F.lit("")))
    return F.slice(F.array(*shown), F.lit(1), current)


def markdown(docs: DataFrame) -> DataFrame:
    """Headings, fenced code, tables, lists and paragraphs of Markdown texts, in order.

    A block of list lines followed by text is a paragraph that keeps the list's extra, as its last line decides the
    category. A fence that nothing closes reaches to the end. Null texts have no elements.
    """
    lines = F.transform(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), lambda x: F.rtrim(x, F.lit(X.WHITE)))
    row = docs.where("text is not null").select("doc_id", F.posexplode(lines).alias("at", "line")).withColumn("_opens", fence(F.col("line"))[0])
    row = running(row, "doc_id", ["line", "_opens"], "code", lambda: ("", 0), _code).drop("_opens")
    order = Window.partitionBy("doc_id").orderBy("at")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    # Runs of lines with a bar; a table is what follows the first header line of its run.
    row = row.withColumn("bar", (F.col("code") == 0) & F.contains("line", F.lit("|")) & (F.trim("line") != ""))
    row = row.withColumn("below", F.lead("line").over(order))
    row = row.withColumns({"run": F.sum((~F.col("bar")).cast("int")).over(past), "head": F.col("bar") & F.coalesce(is_separator(F.col("below")) & F.lead("bar").over(order), F.lit(False))})
    in_run = Window.partitionBy("doc_id", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    row = row.withColumn("table", F.col("bar") & (F.max(F.col("head").cast("int")).over(in_run) == 1))
    level, title = heading(F.col("line"))
    free = (F.col("code") == 0) & ~F.col("table")
    kind = F.when(F.col("code") > 0, "code").when(F.col("table"), "table").when(level > 0, "title").when(is_listed(F.col("line")), "list").when(F.trim("line") == "", "blank").otherwise("paragraph")
    row = row.withColumns({"kind": kind, "level": F.when(free & (level > 0), level), "title": F.when(free, X.strip(F.coalesce(title, F.lit(""))))})
    row = row.withColumn("path", heading_path(F.col("level"), F.col("title"), past))
    # A block is one code fence, table or heading, or the text lines between two such or blank lines.
    group = F.when(F.col("kind").isin("list", "paragraph"), "text").otherwise(F.col("kind"))
    row = row.withColumn("group", group)
    new = (F.col("group") != F.coalesce(F.lag("group").over(order), F.lit(""))) | (F.col("group") == "title") | (F.col("code") != F.coalesce(F.lag("code").over(order), F.lit(0))) | ((F.col("group") == "table") & (F.col("run") != F.lag("run").over(order)))
    row = row.withColumn("block", F.sum(new.cast("int")).over(past)).where("group <> 'blank'")
    listed = F.sort_array(F.collect_list(F.struct("at", "line", "kind")))
    block = row.groupBy("doc_id", "block").agg(listed.alias("l"), F.max("level").alias("level"), F.max("title").alias("title"), F.min_by("path", "at").alias("heading_path"), F.max(F.col("kind") == "list").alias("any_list"), F.min_by("group", "at").alias("group"))
    body = X.strip(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    content = F.when(F.col("group") == "title", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("title"))).otherwise(body)
    category = F.when(F.col("group") == "text", F.element_at("l", -1)["kind"]).otherwise(F.col("group"))
    first = F.get("l", F.lit(0))["line"]
    cells = F.size(F.filter(F.split(F.regexp_replace(F.trim(first), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c) != ""))
    extra = (
        F.when(F.col("group") == "title", F.create_map(F.lit("element_type"), F.lit("heading"), F.lit("header_level"), F.col("level").cast("string"), F.lit("split_reason"), F.lit("heading")))
        .when(F.col("group") == "code", F.create_map(F.lit("element_type"), F.lit("fenced_code"), F.lit("is_atomic"), F.lit("true"), F.lit("language"), fence(first)[1], F.lit("split_reason"), F.lit("code")))
        .when(F.col("group") == "table", F.create_map(F.lit("element_type"), F.lit("markdown_table"), F.lit("is_atomic"), F.lit("true"), F.lit("split_reason"), F.lit("table"), F.lit("table_rows"), F.greatest(F.lit(0), F.size("l") - 2).cast("string"), F.lit("table_cols"), cells.cast("string")))
        .when(F.col("any_list"), F.create_map(F.lit("element_type"), F.lit("markdown_list"), F.lit("split_reason"), F.lit("list")))
        .otherwise(F.expr(_NO_EXTRA))
    )
    out = block.withColumns({"content": content, "category": category, "extra": extra, "page": F.lit(1)}).where("content <> ''")
    return out.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("block")) - 1).select(*ELEMENT)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8; of what is not, the valid parts."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.translate(F.make_valid_utf8(text), "\ufffd", ""))


def typed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, content_type; text or content, which is bytes; maybe file_type) with text, _kind and warning.

    The type is the given one, else that of the content type or of the name; a text without a content type may also say
    it itself. _kind is null for what no parser reads, and then the warning names it.
    """
    uploaded = "content" in docs.columns
    text = decoded(F.col("content")) if uploaded else F.col("text")
    if uploaded and "text" in docs.columns:
        text = F.coalesce("text", text)
    docs = docs.withColumn("text", text)
    given = F.lower(F.trim("file_type")) if "file_type" in docs.columns else F.lit(None).cast("string")
    named = X.file_type("source", "content_type")
    said = F.coalesce(F.trim("content_type"), F.lit("")) != ""
    bare = ~said if not uploaded else ~said & (F.coalesce("source", F.lit("")) == "")
    known = F.when(given.isin("md", "markdown"), "md").when(given.isin("txt", "text"), "txt").when(given == "pdf", "pdf")
    kind = F.when(F.coalesce(given, F.lit("")) != "", known).otherwise(F.coalesce(named, F.when(bare, X.text_type("text", "source"))))
    what = F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce("content_type", F.lit(""))))
    garbled = ~F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(True)) if uploaded else F.lit(False)
    row = docs.withColumn("_kind", kind)
    warning = F.when(F.col("_kind").isNull(), F.concat(F.lit("UnsupportedFormat: "), F.trim(what))).when(F.col("_kind") == "pdf", "parser_degraded: UnsupportedFormat").when(garbled, "parser_degraded: UnicodeDecodeError")
    return row.withColumn("warning", warning)


def parse(docs: DataFrame) -> DataFrame:
    """Elements of docs by their type, Markdown or plain text, with a warning where a parser gave way to plain text.

    Documents of other types have no elements; parse_report() names them. PDF pages come as spans, see
    tessella.sources.pages (bytes of a PDF are read as text, with a warning); remote services' JSON, see
    tessella.sources.layout_json.
    """
    row = typed(docs)
    md = markdown(row.where("_kind = 'md' AND warning IS NULL")).withColumn("warning", F.lit(None).cast("string"))
    txt = plain_text(row.where("_kind IS NOT NULL AND NOT (_kind = 'md' AND warning IS NULL)")).join(row.select("doc_id", "warning"), "doc_id")
    return md.unionByName(txt)


def parse_report(docs: DataFrame) -> DataFrame:
    """doc_id, file_type, outcome (parsed, degraded, empty or unsupported) and warning: a row for each document, whatever it holds."""
    row = typed(docs)
    outcome = F.when(F.col("_kind").isNull(), "unsupported").when(X.strip(F.coalesce("text", F.lit(""))) == "", "empty").when(F.col("warning").isNotNull(), "degraded").otherwise("parsed")
    return row.select("doc_id", F.col("_kind").alias("file_type"), outcome.alias("outcome"), "warning")


def layout_summary(elements: DataFrame) -> DataFrame:
    """Elements by category (null is paragraph), and their total."""
    return elements.select(F.coalesce("category", F.lit("paragraph")).alias("category")).rollup("category").agg(F.count("*").alias("n")).select(F.coalesce("category", F.lit("total")).alias("category"), "n")
