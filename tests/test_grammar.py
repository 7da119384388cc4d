"""The line grammar, tables, JSON texts and cleaning case by case; long documents; documents that cannot be read."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tessella.functions import layout, tables
from tessella.functions import text as X
from tessella.operators import chunking
from tessella.sources import elements, layout_json

ELEMENTS = "doc_id string, chunk_index int, content string, category string, heading_path array<string>, page int, extra map<string,string>"


def values(spark, rows, *columns):
    """The columns for each text of rows."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_lines(spark):
    x = F.col("x")
    heads = {"# a": (1, "a"), "###### b c": (6, "b c"), "####### no": (0, None), "#no": (0, None), "#": (0, None), "##\tt": (2, "t"), " # no": (0, None), "": (0, None), "# # x": (1, "# x"), "#   y": (1, "y")}
    assert dict(zip(heads, values(spark, heads, *elements.heading(x)))) == heads
    fences = {"```": ("```", ""), "```` c++ x": ("````", "c++"), "~~~py": ("~~~", "py"), "``no": ("", ""), "``~": ("", ""), "a```": ("", ""), "```!": ("```", "")}
    got = dict(zip(fences, values(spark, fences, *elements.fence(x))))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in fences.items()} and all(got[k] == v for k, v in fences.items() if v[0])
    lists = {"- a": True, "  * b": True, "+ c": True, "12. d": True, "\t3.\te": True, "-a": False, "-": False, "1.": False, "1) x": False, ". x": False, "a. x": False, "**b** x": False, "1.2. x": False}
    assert {k: v[0] for k, v in zip(lists, values(spark, lists, elements.is_listed(x)))} == lists


def test_separators(spark):
    lines = {"|---|---|": True, "--- | :---:": True, "  |:---|---:|  ": True, "|---|": False, "---": False, "|--|---|": False, "|-:-|---|": False, "|---|---": True, "||---|---|": False, "a|---": False, "": False, "|:::---|---|": False}
    assert {k: v[0] for k, v in zip(lines, values(spark, lines, tables.is_separator(F.col("x"))))} == lines
    assert {k: tables.separates(k) for k in lines} == lines


def test_numbers(spark):
    cells = {"1": True, "-1.5": True, "+2": True, "1,000%": True, "1.": False, ".5": False, "1.2.3": False, "": False, "x1": False, "--1": False}
    assert {k: v[0] for k, v in zip(cells, values(spark, cells, tables.is_numeric(F.col("x"))))} == cells


def test_html_tables(spark):
    html = "<TABLE class='x'><caption> A <b>b</b></caption><tr id=1><TH>h</TH><td> a<br/>b <i>c</i></td><td></td></tr><tr><td>open</tr><td>stray</td><tr><td>1</td></tr><tr><td>cut"
    assert tables.html_table(html) == ([[["h"], [" a", " ", "b ", "c"], []], [], [["1"]]], [" A ", "b"])
    t = values(spark, [html], tables.table(F.col("x")))[0][0]
    assert t.rows == [["h", "a b c"], ["1"]] and t.caption == "A b" and t.grid == [["h", "a b c", ""], [], ["1"]]
    assert tables.html_table("a < b") == ([], None)
    assert values(spark, ["x &amp; y<br>z", "plain", None], tables.fragment(F.col("x"))) == [("x & y z",), ("plain",), ("",)]


def test_cleaning_and_redaction(spark):
    texts = ["a\n\n\tb", "re-\nturn", "□a□ b", "ﬁn　", None, "", " x "]
    assert [r[0] for r in values(spark, texts, X.clean_plain(F.col("x")))] == ["a b", "return", "a b", "fin", None, "", "x"]
    secret = spark.range(1).select(X.redact_map(F.create_map(*[F.lit(v) for k in ("My_API-Key", "apikey", "TOKENS", "key", "Authorization") for v in (k, "0123456789")])).alias("m")).first().m
    assert {k for k, v in secret.items() if v == "0123...6789"} == {"My_API-Key", "apikey", "TOKENS", "Authorization"}


@pytest.mark.parametrize(
    "content, text",
    [
        ({"paragraph_content": [{"content": " "}], "text": "real"}, "real"),
        ({"text": "b", "title_content": "a"}, "a"),
        ({"zeta": "z", "alpha": "a"}, "z"),
        ({"math_content": " x ", "text": "no"}, "x"),
        ({"math_content": ["no"], "text": "yes"}, "yes"),
        ({"list_items": [{"item_content": [{"type": "text", "content": "p"}]}, {"item_content": "q"}]}, "p q"),
        ({"list_items": [{"type": "odd"}], "other": "no"}, ""),
        ({"list_items": "said", "a": ""}, "said"),
        ({"text": " ", "content": ""}, ""),
        ([{"type": "inline_equation", "content": "x"}, {"type": "image", "content": "no"}, "no", {"text": 3}], "$x$ 3"),
        ("  s ", "s"), (None, ""), (7, ""), ([], ""), ({"a": {"text": "no"}}, ""),
    ],
)
def test_texts_of_json(content, text):
    assert layout_json.text_of(content) == text


def test_levels(spark):
    levels = {"2": 2, "0": 1, "99999999999": 2**31 - 1, "x": 1}
    df = spark.createDataFrame([(k,) for k in levels], "x string")
    assert {r.x: r.l for r in df.select("x", layout.heading_level("x", F.lit("t")).alias("l")).collect()} == levels


def test_documents_that_cannot_be_read(spark):
    """They end no job: the others have their elements, and these a row that says why."""
    page = json.dumps([{"type": "paragraph", "content": "fine", "page_idx": 0}])
    raw = spark.createDataFrame([("a", page), ("broken", "{"), ("odd", json.dumps([{"type": "paragraph", "content": "x", "page_idx": "two"}])), ("deep", "[" * 100_000), ("huge", json.dumps([{"type": "text", "page_idx": 2**40}])), ("b", page), ("none", None)], "doc_id string, json string")
    assert {r.doc_id for r in layout_json.elements(raw).collect()} == {"a", "b"}
    said = {r.doc_id: r.warning for r in layout_json.failures(raw).collect()}
    assert said.keys() == {"broken", "odd", "deep", "huge"} and said["broken"].startswith("parser_degraded: JSONDecodeError")


def test_uploads(spark):
    rows = [
        ("md", "a.md", None, b"# T\nx"), ("bad", "b.md", None, b"ok \xff\xfe ok"), ("pdf", None, "application/pdf", b"%PDF"), ("zip", "c.zip", None, b"PK"),
        ("png", "d", "image/png", b"\x89"), ("bare", None, None, b"## h"), ("none", "e.txt", None, None), ("blank", "e.txt", None, b" \n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id string, source string, content_type string, content binary")
    said = {r.doc_id: (r.file_type, r.outcome, r.warning) for r in elements.parse_report(docs).collect()}
    assert said == {
        "md": ("md", "parsed", None), "bad": ("md", "degraded", "parser_degraded: UnicodeDecodeError"), "pdf": ("pdf", "degraded", "parser_degraded: UnsupportedFormat"), "zip": (None, "unsupported", "UnsupportedFormat: c.zip"),
        "png": (None, "unsupported", "UnsupportedFormat: d image/png"), "bare": ("md", "parsed", None), "none": ("txt", "empty", None), "blank": ("txt", "empty", None),
    }
    assert {(r.doc_id, r.content, r.warning) for r in elements.parse(docs).collect()} == {("md", "# T", None), ("md", "x", None), ("bad", "ok  ok", said["bad"][2]), ("pdf", "%PDF", said["pdf"][2]), ("bare", "## h", None)}
    given = spark.createDataFrame([("a", "x", "docx"), ("b", "# x", "TXT"), ("c", "# x", "markdown")], "doc_id string, text string, file_type string").withColumns({"source": F.lit("s"), "content_type": F.lit(None).cast("string")})
    assert {(r.doc_id, r.file_type) for r in elements.parse_report(given).collect()} == {("a", None), ("b", "txt"), ("c", "md")}


def test_a_document_of_many_elements(spark):
    """100,000 elements, sentences and lines of one document take time in proportion."""
    n = 100_000
    rows = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("chunk_index"), F.concat(F.lit("word "), F.col("id") % 10).alias("content"), F.lit("paragraph").alias("category"), F.expr("cast(array() as array<string>)").alias("heading_path"), F.lit(1).alias("page"), F.expr("cast(map() as map<string,string>)").alias("extra"))
    began = time.time()
    packed = chunking.structure_aware(rows)
    assert packed.agg(F.sum(F.length("content") + 2)).first()[0] == n * 8
    assert packed.agg(F.max(F.length("content"))).first()[0] <= 800
    lines = spark.createDataFrame([("d", "\n".join(f"```\nline {i}\n```\ntext!" for i in range(n // 4)))], "doc_id string, text string")
    assert {r.category: r["count"] for r in elements.markdown(lines).groupBy("category").count().collect()} == {"code": n // 4, "paragraph": n // 4}
    said = spark.createDataFrame([("d", 0, "".join(f"w{i % 9} a{i} b{i}!" for i in range(n)), "paragraph", [], 1, {})], ELEMENTS)
    assert chunking.semantic(said).count() > n // 800
    assert time.time() - began < 120


def test_passes_start_anew_for_each_document(spark):
    rows = [("a", i, "x" * 500, "paragraph", [], 1, {}) for i in range(2)] + [("b", 0, "x" * 200, "paragraph", [], 1, {}), ("b", 1, "y" * 200, "paragraph", [], 1, {})]
    out = chunking.structure_aware(spark.createDataFrame(rows, ELEMENTS)).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, len(r.content)) for r in out] == [("a", 0, 500), ("a", 1, 500), ("b", 0, 402)]
