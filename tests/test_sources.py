import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import latex, tables
from tessella.functions import text as X
from tessella.operators import chunking
from tessella.sources import elements, golden, layout_json, pages
from tessella.streaming import ingest

MARKDOWN = """# Title
intro

### Deep
- a
- b
tail

| h1 | h2 |
|----|----|
| 1 | 2 |
## Second
```python
# no heading
| a | b |
```
end
"""


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_markdown(spark):
    rows = elements.markdown(docs(spark, MARKDOWN, None, "")).orderBy("chunk_index").collect()
    assert [r.category for r in rows] == ["title", "paragraph", "title", "paragraph", "table", "title", "code", "paragraph"]
    assert rows[2].heading_path == ["Title", "", "Deep"] and rows[5].heading_path == ["Title", "Second"]
    assert rows[3].extra["element_type"] == "markdown_list" and rows[4].extra["table_rows"] == "1" and rows[4].extra["table_cols"] == "2"
    assert rows[6].content.startswith("```python") and rows[6].extra["language"] == "python"


def test_open_fence_reaches_the_end(spark):
    rows = elements.markdown(docs(spark, "a\n~~~\n# x\n\ny")).orderBy("chunk_index").collect()
    assert [(r.category, r.content) for r in rows] == [("paragraph", "a"), ("code", "~~~\n# x\n\ny")]


def test_plain_text(spark):
    rows = elements.plain_text(docs(spark, "one\r\n\r\n two  \n\n\n\nthree", None)).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.content) for r in rows] == [(0, "one"), (1, "two"), (2, "three")]


def test_parse_by_type(spark):
    rows = spark.createDataFrame([("a", "# T\nx", "a.md", None), ("b", "p", "b.txt", None), ("c", "## h", None, None), ("d", "%PDF", "d.pdf", None)], "doc_id string, text string, source string, content_type string")
    out = {(r.doc_id, r.category, r.warning) for r in elements.parse(rows).collect()}
    assert ("a", "title", None) in out and ("b", "paragraph", None) in out and ("c", "title", None) in out and ("d", "paragraph", "parser_degraded: UnsupportedFormat") in out


def test_fixed_windows(spark):
    rows = chunking.fixed_windows(docs(spark, "x" * 1200, "", None, " " * 600)).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, len(r.content)) for r in rows] == [("d0", 0, 500), ("d0", 1, 500), ("d0", 2, 300)]


@pytest.mark.parametrize("strategy", chunking.STRATEGIES)
def test_strategies(spark, strategy):
    out = chunking.chunk(elements.markdown(docs(spark, MARKDOWN)), strategy).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in out] == list(range(len(out)))
    ids = [r.chunk_id for r in out]
    assert [r.prev_view_id for r in out] == [None, *ids[:-1]] and [r.next_view_id for r in out] == [*ids[1:], None]


def test_packing_stops_at_size_and_heading(spark):
    rows = [("d", i, "w" * 300, "paragraph", ["A"] if i < 4 else ["B"], 1, {}) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_index int, content string, category string, heading_path array<string>, page int, extra map<string,string>")
    assert [len(r.content) for r in chunking.structure_aware(df).orderBy("chunk_index").collect()] == [602, 602, 602]


def test_splitting():
    assert chunking.split_oversized("ab! cd! ef!", 7) == ["ab! cd!", "ef!"]
    assert chunking.split_oversized("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunking.split_long("a" * 5 + " " + "b" * 5, 7) == ["aaaaa", "bbbbb"]
    assert chunking.split_long("a" * 9, 4) == ["aaaa", "aaaa", "a"]


def test_cleaning(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.clean_plain(F.lit("hy-\nphen \n next  □ ﬁ"))) == "hyphen next  fi"
    assert one(X.clean_structured(F.lit("a  \r\n  b\t\n\n"))) == "a\n  b"
    rows = [("d", 0, "A long enough paragraph for the rule.", "paragraph"), ("d", 1, "short", "paragraph"), ("d", 2, "■", "paragraph"), ("d", 3, "t", "table")]
    df = spark.createDataFrame(rows, "doc_id string, chunk_index int, content string, category string").withColumn("heading_path", F.array().cast("array<string>"))
    out = chunking.clean(df).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.content) for r in out] == [(0, "A long enough paragraph for the rule. short"), (1, "t")]


def test_table_cells_and_tables(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    cells = {"27,400,1.20": "274001.2", "| 08.500 |": " 08.500 ", "61 %": "61%", "k = 4 / 9": "k=4/9", "-0.000": "0", "5 6 7": "567", "p&lt;q": "p<q", "+19": "19", "0.9999999999999": "1", "0.1234567890126": "0.123456789013", "1.2.3": "1.2.3", "--4": "--4", "a<BR />b": "a b", "": ""}
    assert {k: one(tables.cell(F.lit(k))) for k in cells} == cells
    html = "<table><caption>C</caption><tr><th>a</th><th>b</th></tr><tr><td>1</td><td></td></tr><tr><td>x<br/>y</td><td>2</td></tr></table>"
    t = one(tables.table(F.lit(html)))
    assert t.rows == [["a", "b"], ["1"], ["x y", "2"]] and t.caption == "C"
    assert one(tables.records(F.array(F.lit("a"), F.lit("b")), tables.table(F.lit(html)).rows)) == [{"a": "x y", "b": "2"}]
    assert one(tables.table(F.lit("a\tb\n1\t2"))).rows == [["a", "b"], ["1", "2"]] and one(tables.table(F.lit(None).cast("string"))).rows == []
    assert "|  |" in one(tables.html_to_markdown(F.lit(html)))
    assert one(tables.looks_like_table(F.lit("|a|b|\n|1|2|"))) and not one(tables.looks_like_table(F.lit("a|b")))


def test_latex(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(latex.normalise(F.lit(r"\mathrm{d x} ^ { 2 }"))) == r"\mathrm{dx}^{2}"
    assert one(latex.to_text(F.lit(r"\alpha^{2} + \int \cdots 0 . 7"))) == "α² + ∫ ⋯ 0.7"
    same = {r"A ^ { \wedge } T": "A^T", r"x _ { i j }": r"x_{ij}", r"{a} + {b": "{a} + {b", r"\mathbb R": r"\mathbbR", r"y ^ { \text {a b} }": r"y^{ \text {a b} }"}
    assert {k: one(latex.normalise(F.lit(k))) for k in same} == same
    read = {r"\mathrm {kg} \leq 1 2": "kg ≤ 12", r"x_{3} \in \{0\}": r"x3 ∈ \{0\}", r"\operatorname{rank} q^{ab}": "operatornamerank q^ab", r"\frac{p}{q}": r"\fracpq"}
    assert {k: one(latex.to_text(F.lit(k))) for k in read} == read
    assert one(latex.to_text(F.lit(None).cast("string"))) is None


def test_paths_of_titles_with_skipped_levels(spark):
    import json

    level = lambda k, t, y: {"type": "title", "text_level": k, "content": t, "page_idx": 0, "bbox": [0, y, 10, y + 5]}
    blocks = [level(1, "one", 0), level(2, "two", 10), level(1, "uno", 20), level(3, "deep", 30), {"type": "table", "bbox": [0, 40, 10, 45], "page_idx": 0}]
    raw = spark.createDataFrame([("d", json.dumps(blocks)), ("e", json.dumps([blocks[0], blocks[3], blocks[4]]))], "doc_id string, json string")
    from tessella.sources import layout_json

    got = {r.doc_id: list(r.anchor_path) for r in layout_json.anchors(layout_json.blocks(raw)).collect()}
    assert got == {"d": ["one", "two", "deep"], "e": ["one", "deep"]}


def test_layout_json(spark):
    blocks = [
        {"type": "title", "text_level": 1, "content": "C", "page_idx": 0, "bbox": [0, 0, 10, 10]}, {"type": "paragraph", "content": [{"type": "text", "content": "p"}, {"type": "equation_inline", "content": "x"}]},
        {"type": "title", "text_level": 2, "content": "Left", "bbox": [0, 20, 40, 30]}, {"type": "title", "text_level": 2, "content": "Right", "bbox": [100, 20, 140, 30]},
        {"type": "equation", "content": {"math_content": "y"}, "bbox": [0, 40, 40, 60]}, {"type": "page_number", "content": "1"}, {"content": "no type"}, {"type": "new", "content": "unknown"},
    ]
    raw = spark.createDataFrame([("d", json.dumps({"a_content_list_v2": [blocks], "list": []})), ("broken", "{"), ("none", None)], "doc_id string, json string")
    out = layout_json.elements(raw).orderBy("chunk_index").collect()
    assert [r.category for r in out] == ["title", "paragraph", "title", "title", "formula", "paragraph"]
    assert out[1].content == "p $x$" and out[4].heading_path == ["C", "Left"] and out[5].heading_path == ["C", "Right"]
    assert [r.logic_idx for r in out] == list(range(6)) and out[5].prev_view_id == "d:1"
    assert {r.block_type: r.n for r in layout_json.type_histogram(layout_json.blocks(raw)).collect()}["<missing>"] == 1


def test_pages(spark):
    schema = "doc_id string, page int, width double, height double, block int, block_type int, x0 double, y0 double, x1 double, y1 double, span int, text string, size double, font string"
    rows = [("d", 0, 100.0, 200.0, i, kind, *box, 0, text, size, "F") for i, (kind, box, text, size) in enumerate([
        (0, (0.0, 0.0, 50.0, 5.0), "Head", 10.0), (0, (0.0, 20.0, 40.0, 30.0), "1.2 Intro", 12.0), (0, (0.0, 40.0, 40.0, 50.0), "left", 10.0), (0, (60.0, 20.0, 90.0, 30.0), "right", 10.0),
        (1, (0.0, 60.0, 40.0, 80.0), None, 0.0), (0, (1.0, 82.0, 40.0, 90.0), "Figure 1: x", 10.0)])]
    spans = spark.createDataFrame(rows, schema)
    layout = {r.block: r for r in pages.page_layout(spans).collect()}
    assert 0 not in layout and layout[1].category == "title" and (layout[3].column, layout[2].column) == (1, 0)
    out = pages.elements(spans).orderBy("chunk_index").collect()
    assert [r.content for r in out] == ["1.2 Intro", "left", "Figure 1: x", "Figure 1: x", "right"]
    tabs = spark.createDataFrame([("d", 0, 0, ["A", "b "], [["1", "2"]]), ("d", 1, 0, ["a", "B"], [["3", "4"]]), ("d", 2, 0, ["c"], [["9"]])], "doc_id string, page int, place int, header array<string>, rows array<array<string>>")
    assert [(r.parts, len(r.rows)) for r in pages.merge_tables(tabs).orderBy("page").collect()] == [(2, 2), (1, 1)]


def test_golden(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('# note\n\n{"query": "q", "collection": "c", "relevant": ["a#0"]}\n')
    assert golden.read_golden(spark, str(tmp_path / "g.jsonl")).count() == 1
    (tmp_path / "bad.jsonl").write_text('{"query": "q", "collection": "c", "relevant": []}\n')
    with pytest.raises(Exception, match="not a golden sample"):
        golden.read_golden(spark, str(tmp_path / "bad.jsonl")).collect()
    for stamp in ("20260101_000000", "20260102_000000"):
        golden.write_report(spark.createDataFrame([(stamp,)], "m string"), str(tmp_path / "r"), stamp)
    assert golden.latest_report(spark, str(tmp_path / "r")).first().m == "20260102_000000"


def test_each_document_by_its_own_strategy(spark):
    rows = [("a", 0, "x. " * 300, "paragraph", ["H"], 1, {}, "fixed"), ("b", 0, "T", "title", ["T"], 1, {}, "structure_aware"), ("b", 1, "one paragraph that is long enough to stay", "paragraph", ["T"], 1, {}, "structure_aware"), ("c", 0, "one paragraph that is long enough to stay", "paragraph", [], 1, {}, "unknown")]
    df = spark.createDataFrame(rows, "doc_id string, chunk_index int, content string, category string, heading_path array<string>, page int, extra map<string,string>, strategy string")
    out = {}
    for r in chunking.chunk_each(df).orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r.doc_id, []).append(r.category)
    assert out == {"a": ["paragraph"] * 2, "b": ["title", "paragraph"], "c": ["paragraph"]}


def test_payloads(spark):
    df = spark.createDataFrame([("d", 3, "text", None, ["A", "B"], 2, {"page": "9", "k": "v", "_p": "x"}, "s")], "doc_id string, chunk_index int, content string, category string, heading_path array<string>, page int, extra map<string,string>, source string")
    r = chunking.from_payload(chunking.payload(df)).first()
    assert (r.doc_id, r.chunk_index, r.category, r.heading_path, r.page, r.extra) == ("d", 3, "paragraph", ["A", "B"], 9, {"k": "v"})
