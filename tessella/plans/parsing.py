"""Registered queries of parsing, chunking, cleaning and scalar functions over documents, pages, conversations and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import layout as Y
from tessella.functions import tables as B
from tessella.functions import text as X
from tessella.operators import chunking
from tessella.sources import elements, layout_json, pages
from tessella.plans._tables import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _turns(spark, d):
    """Turns as chunks of their conversation: the role is the category."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("content"), F.col("role").alias("category"))


def doc_identity(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.doc_id("text").alias("content_id"), X.content_hash("text").alias("content_hash"))


def term_hash_tf(spark: SparkSession, d: str) -> DataFrame:
    """Distinct terms, occurrences, and sums over the sparse vector of each document."""
    from tessella.operators.search import postings

    return postings(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("top_tf"), F.min("term").alias("first_term"), F.sum("term").cast("long").alias("term_sum"))


def compare_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.compare_tokens("text").alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens_md5"))


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_windows(_docs(spark, d)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("content").cast("long").alias("chars"), F.md5("content").alias("content_md5"))


def plain_elements(spark: SparkSession, d: str) -> DataFrame:
    """Line-separated documents with blank lines between their lines, as plain text."""
    spaced = _docs(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return elements.plain_text(spaced).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("content_md5"))


def markdown_elements(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their headings and list items as Markdown: elements by category and heading path."""
    page = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?i)<h1[^>]*>", "\n\n# "), r"(?i)<li[^>]*>", "\n- "), r"<[^>]+>", "\n").alias("text"))
    return elements.markdown(page).groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.max(F.size("heading_path")).cast("long").alias("depth"), F.sum(F.length("content")).alias("chars"))


def structured_chunks(spark: SparkSession, d: str) -> DataFrame:
    spaced = _docs(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    out = chunking.chunk(elements.plain_text(spaced), "structure_aware")
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("content").cast("long").alias("chars"), "prev_view_id", "next_view_id")


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.chunk(elements.plain_text(_docs(spark, d)), "semantic")
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("content").cast("long").alias("chars"))


def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.chunk(elements.plain_text(_docs(spark, d)), "markdown_structure")
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "category", F.length("content").cast("long").alias("chars"))


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.length(X.clean_plain("text")).cast("long").alias("plain_chars"), F.length(X.clean_structured("text")).cast("long").alias("structured_chars"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.sentences("text").alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


def neighbor_links(spark: SparkSession, d: str) -> DataFrame:
    return chunking.neighbours(_turns(spark, d)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", "prev_view_id", "next_view_id")


def neighbor_links_by_category(spark: SparkSession, d: str) -> DataFrame:
    return chunking.neighbours(_turns(spark, d), "category").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "prev_view_id", "next_view_id")


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Places of all turns within their conversation: those with a logical index (two of three turns, backwards) by it, the others by page (the turn's half) and index."""
    index = F.when(F.col("chunk_index") % 3 != 0, 1000 - F.col("chunk_index"))
    rows = _turns(spark, d).withColumns({"page": F.floor(F.col("chunk_index") / 2), "logic_idx": index.cast("int")})
    return chunking.reading_order(rows).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("position").cast("long").alias("logic_idx"))


def chunk_payloads(spark: SparkSession, d: str) -> DataFrame:
    """All turns as chunks, turned into payloads and read back."""
    rows = _turns(spark, d).withColumns({"source": F.lit("chat"), "page": F.floor(F.col("chunk_index") / 2).cast("int"), "heading_path": F.array("category", F.lit("turns")), "extra": F.create_map(F.lit("mark"), F.col("category"), F.lit("_hidden"), F.lit("x"))})
    out = chunking.from_payload(chunking.payload(rows).select("payload"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), "category", F.col("page").cast("long").alias("page"), F.array_join("heading_path", "/").alias("path"), F.md5("content").alias("content_md5"), F.concat_ws(",", F.array_sort(F.map_keys("extra"))).alias("extra_keys"), F.col("extra")["mark"].alias("mark"))


def dispatched_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents chunked by the default strategy of a type that depends on their language."""
    docs = _docs(spark, d)
    kind = F.when(F.col("lang") == "en", "md").when(F.col("lang") == "de", "pdf").otherwise("txt")
    own = docs.select("doc_id", chunking.strategy_of(kind, F.when(F.col("lang") == "fr", "semantic")).alias("strategy"))
    out = chunking.chunk_each(elements.plain_text(docs).join(own, "doc_id"))
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "category", F.length("content").cast("long").alias("chars"), "prev_view_id", "next_view_id")


def short_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).withColumns({"heading_path": F.array("category"), "category": F.lit("paragraph")})
    return chunking.merge_short(rows, 200).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("content_md5"))


def layout_summary(spark: SparkSession, d: str) -> DataFrame:
    return elements.layout_summary(_docs(spark, d).select(F.when(F.col("lang") != "en", F.col("lang")).alias("category")))


def layout_json_elements(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as layout JSON: system turns are titles, users' are paragraphs, assistants' formulas, two a page."""
    kind = F.when(F.col("role") == "system", "title").when(F.col("role") == "user", "paragraph").otherwise("equation")
    block = F.struct(kind.alias("type"), F.col("text").alias("content"), F.floor(F.col("turn") / 2).cast("int").alias("page_idx"), F.array(F.lit(0.0), F.col("turn") * 10.0, F.lit(100.0), F.col("turn") * 10.0 + 5).alias("bbox"))
    raw = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"])).alias("json"))
    out = layout_json.elements(raw.select(F.col("conv_id").alias("doc_id"), "json"))
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "category", F.col("page").cast("long").alias("page"), F.size("heading_path").cast("long").alias("depth"), F.col("logic_idx").cast("long").alias("logic_idx"))


def extracted_tables(spark: SparkSession, d: str) -> DataFrame:
    """Pages as matrices of cells: four pages are a document, a page's lines its rows, cut at blanks into three cells; those that go on are united.

    Every third page repeats the header of the page before it, in capitals; pages without text are no tables.
    """
    line = lambda x: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.split_part(x, F.lit(" "), i))
    p = table(spark, d, "pages").select(F.expr("page_id div 4").alias("doc_id"), (F.col("page_id") % 4).cast("int").alias("page"), F.lit(0).alias("place"), F.filter(F.split("html", "\n"), lambda x: x != "").alias("l"))
    head = F.when(F.col("page") % 3 == 0, F.array(F.concat(F.lit("Head "), F.col("doc_id").cast("string")), F.lit("b\nb"), F.lit(" c "))).otherwise(F.array(F.concat(F.lit("HEAD "), F.col("doc_id").cast("string")), F.lit("B B"), F.when(F.col("page") == 2, F.lit("d")).otherwise(F.lit("C"))))
    made = pages.tables_of(p.select("doc_id", "page", "place", F.when(F.size("l") > 0, F.concat(F.array(head), F.transform("l", line))).alias("matrix")))
    out = pages.merge_tables(made.where("error IS NULL").select("doc_id", "page", "place", "header", "rows"))
    return out.select("doc_id", F.col("page").cast("long").alias("page"), F.array_join("header", "|").alias("header"), "parts", F.size("rows").cast("long").alias("n_rows"), F.md5(F.array_join(F.flatten("rows"), "|")).alias("rows_md5"))


def file_type_detect(spark: SparkSession, d: str) -> DataFrame:
    """Names made of pages' addresses, with and without a content type."""
    p = table(spark, d, "pages").withColumn("name", F.concat("url", F.element_at(F.array(*map(F.lit, (".pdf", ".MD", ".txt", ".doc", ""))), (F.col("page_id") % 5 + 1).cast("int"))))
    p = p.withColumn("kind", F.element_at(F.array(*map(F.lit, ("application/pdf", "text/markdown", "text/html", "", "image/png"))), (F.floor(F.col("page_id") / 5) % 5 + 1).cast("int")))
    return p.select("page_id", X.file_type("name", "kind").alias("file_type"), X.text_type("html", "name").alias("text_type"))


def parse_report(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of all pages as uploads, under names with and without a known ending and content types of all kinds."""
    p = table(spark, d, "pages").withColumn("source", F.concat("url", F.element_at(F.array(*map(F.lit, (".pdf", ".MD", ".txt", ".doc", ""))), (F.col("page_id") % 5 + 1).cast("int"))))
    p = p.withColumn("content_type", F.element_at(F.array(*map(F.lit, ("application/pdf", "text/markdown", "text/html", "", "image/png"))), (F.floor(F.col("page_id") / 5) % 5 + 1).cast("int")))
    return elements.parse_report(p.select(F.col("page_id").alias("doc_id"), "source", "content_type", F.col("html").cast("binary").alias("content")))


def address_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url", X.vector_url("url").alias("a"))
    return p.select("page_id", F.col("a.scheme").alias("scheme"), F.col("a.host").alias("host"), F.col("a.port").alias("port"), X.redact_url(F.replace("url", F.lit("://"), F.lit("://user:pw@"))).alias("redacted"))


def secret_redact(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    m = X.redact_map(F.create_map(F.lit("api_key"), F.col("p_name"), F.lit("brand"), F.col("p_brand")))
    return p.select("p_partkey", X.redact_secret("p_name").alias("secret"), X.redact_secret("p_brand").alias("short"), m["api_key"].alias("key_entry"), m["brand"].alias("brand_entry"))


def table_cell_norm(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    cell = F.concat(F.lit("|"), F.format_number("p_retailprice", 3), F.lit("| "))
    return p.select("p_partkey", B.cell(cell).alias("price"), B.cell(F.concat(F.col("p_size").cast("string"), F.lit(" %"))).alias("share"), B.cell(F.concat("p_brand", F.lit(" , "), "p_type")).alias("words"), B.is_numeric(F.col("p_size").cast("string")).alias("numeric"))


def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's customers by segment as a Markdown and an HTML table, read back to records."""
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    rows = c.groupBy("c_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("c_mktsegment", "n"))), lambda x: F.array(x["c_mktsegment"], x["n"].cast("string"))).alias("rows"))
    rows = rows.withColumn("head", F.array(F.lit("segment"), F.lit("n"))).select("c_nationkey", B.to_markdown("head", "rows").alias("md"), B.to_html("head", "rows").alias("html"))
    back = rows.withColumn("again", B.table("html").rows)
    return back.select("c_nationkey", F.md5("md").alias("md_md5"), F.md5("html").alias("html_md5"), (B.html_to_markdown("html") == F.col("md")).alias("same"), F.size(B.records(B.header("again"), "again")).cast("long").alias("n_records"))


#: All types of blocks that are known, one that is not, and the empty one.
_TYPES = [t for kinds in Y.CATEGORY_TYPES.values() for t in kinds] + [*Y.IGNORED_TYPES, "unknown", ""]


def block_categories(spark: SparkSession, d: str) -> DataFrame:
    """All turns as blocks of all types in turn: the category of each."""
    n = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(_TYPES) + 1)).cast("int")
    turns = table(spark, d, "conversations").withColumn("kind", F.get(F.array(*map(F.lit, _TYPES)), n))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "kind", Y.category("kind").alias("category"))


def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(" "), F.col("p_name"))
    p = table(spark, d, "part").withColumn("title", F.when(F.col("p_partkey") % 2 == 0, name).otherwise(F.col("p_name")))
    return p.select("p_partkey", Y.heading_level(F.lit(None).cast("string"), "title").cast("long").alias("level"), Y.numbered_heading("title").alias("numbered"), Y.page_heading_level("title", "p_size", F.lit(25.0)).cast("long").alias("page_level"))


_CHUNKS = "w AS (SELECT doc_id, i, regexp_replace(substr(text, i * 450 + 1, 500), '^\\s+|\\s+$', '', 'g') AS content FROM (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text) - 500) / 450::DOUBLE) AS BIGINT)))) AS i FROM documents))"
_T = "t AS (SELECT conv_id AS doc_id, turn AS chunk_index, text AS content, role AS category, conv_id || ':' || turn AS chunk_id FROM conversations)"
#: Where a piece of x that begins at `cut` ends: at the last full stop, or else blank, of the second half of 400 characters.
_CUT = r"""CASE WHEN {cut} + 400 >= length(x) THEN {cut} + 400
 WHEN contains(substr(x, {cut} + 1, 400), '。') AND length(regexp_extract(substr(x, {cut} + 1, 400), '(?s)^(.*)。', 1)) >= 200 THEN {cut} + length(regexp_extract(substr(x, {cut} + 1, 400), '(?s)^(.*)。', 1))
 WHEN contains(substr(x, {cut} + 1, 400), ' ') AND length(regexp_extract(substr(x, {cut} + 1, 400), '(?s)^(.*) ', 1)) >= 200 THEN {cut} + length(regexp_extract(substr(x, {cut} + 1, 400), '(?s)^(.*) ', 1)) ELSE {cut} + 400 END"""
QUERIES = {f.__name__: f for f in (doc_identity, term_hash_tf, compare_tokens, fixed_chunks, plain_elements, markdown_elements, structured_chunks, semantic_chunks, markdown_chunks, clean_texts, sentence_split, neighbor_links, neighbor_links_by_category, reading_order, chunk_payloads, dispatched_chunks, short_merge, layout_summary, layout_json_elements, extracted_tables, file_type_detect, parse_report, address_parts, secret_redact, table_cell_norm, table_markdown, block_categories, heading_levels)}
SQL = {
    "doc_identity": "SELECT doc_id, substr(md5(text), 1, 12) AS content_id, md5(text) AS content_hash FROM documents",
    "term_hash_tf": r"""WITH p AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 2147483648 AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM documents) GROUP BY ALL)
SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens, max(tf) AS top_tf, min(term) AS first_term, CAST(sum(term) AS BIGINT) AS term_sum FROM p GROUP BY doc_id""",
    "compare_tokens": "SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(list_sort(t), ' ')) AS tokens_md5 FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS t FROM documents)",
    "fixed_chunks": f"WITH {_CHUNKS} SELECT doc_id, i AS chunk_index, CAST(length(content) AS BIGINT) AS chars, md5(content) AS content_md5 FROM w WHERE content <> ''",
    "plain_elements": r"WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents), s AS (SELECT doc_id, p, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM r) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS chunk_index, md5(x) AS content_md5 FROM s WHERE x <> ''",
    "neighbor_links": f"WITH {_T} SELECT doc_id, chunk_index, chunk_id, lag(chunk_id) OVER w AS prev_view_id, lead(chunk_id) OVER w AS next_view_id FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)",
    "neighbor_links_by_category": f"WITH {_T} SELECT doc_id, chunk_index, lag(chunk_id) OVER w AS prev_view_id, lead(chunk_id) OVER w AS next_view_id FROM t WINDOW w AS (PARTITION BY doc_id, category ORDER BY chunk_index)",
    "reading_order": f"WITH {_T} SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN chunk_index % 3 <> 0 THEN 1000 - chunk_index ELSE 99999 END, chunk_index // 2, chunk_index) - 1 AS logic_idx FROM t",
    "chunk_payloads": f"WITH {_T} SELECT doc_id, chunk_index, category, chunk_index // 2 AS page, category || '/turns' AS path, md5(content) AS content_md5, 'mark' AS extra_keys, category AS mark FROM t",
    "short_merge": rf"""WITH {_T}, b AS (SELECT *, CASE WHEN length(content) < 200 AND lag(category) OVER w = category THEN 0 ELSE 1 END AS n FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS g FROM b)
SELECT doc_id, CAST(g - 1 AS BIGINT) AS chunk_index, md5(regexp_replace(string_agg(content, ' ' ORDER BY chunk_index), '^\s+|\s+$', '', 'g')) AS content_md5 FROM g GROUP BY doc_id, g""",
    "sentence_split": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?；;\n]*[。！？!?；;\n]|[^。！？!?；;\n]+$'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS sentences_md5 FROM s""",
    "layout_summary": "WITH c AS (SELECT CASE WHEN lang <> 'en' THEN lang ELSE 'paragraph' END AS category FROM documents) SELECT category, count(*) AS n FROM c GROUP BY category UNION ALL SELECT 'total', count(*) FROM c",
    "file_type_detect": r"""WITH p AS (SELECT page_id, html, url || ['.pdf', '.MD', '.txt', '.doc', ''][page_id % 5 + 1] AS name, ['application/pdf', 'text/markdown', 'text/html', '', 'image/png'][(page_id // 5) % 5 + 1] AS kind FROM pages),
s AS (SELECT *, lower(regexp_extract(name, '\.([^.]+)$', 1)) AS x FROM p)
SELECT page_id, CASE WHEN kind = 'application/pdf' THEN 'pdf' WHEN kind = 'text/markdown' THEN 'md' WHEN kind LIKE 'text/%' THEN 'txt' WHEN x = 'pdf' THEN 'pdf' WHEN x IN ('md', 'markdown') THEN 'md' WHEN x IN ('txt', 'text') THEN 'txt' END AS file_type,
CASE WHEN x IN ('md', 'markdown') THEN 'md' WHEN x IN ('txt', 'text') THEN 'txt' WHEN regexp_matches(html, '(?m)^\s*#{1,3} ') THEN 'md' ELSE 'txt' END AS text_type FROM s""",
    "extracted_tables": r"""WITH l AS (SELECT page_id // 4 AS doc_id, page_id % 4 AS page, list_filter(string_split(html, chr(10)), lambda x: x <> '') AS l FROM pages),
h AS (SELECT doc_id, page, CASE WHEN page = 2 THEN 'd' ELSE 'c' END AS k, CASE WHEN page % 3 = 0 THEN 'Head ' || doc_id || '|b b|c' ELSE 'HEAD ' || doc_id || '|B B|' || CASE WHEN page = 2 THEN 'd' ELSE 'C' END END AS header,
 list_transform(l, lambda x: list_transform([1, 2, 3], lambda i: regexp_replace(split_part(x, ' ', i), '^\s+|\s+$', '', 'g'))) AS m FROM l WHERE len(l) > 0),
g AS (SELECT *, sum(CASE WHEN before = k THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page) AS g FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY page) AS before FROM h))
SELECT doc_id, min(page) AS page, arg_min(header, page) AS header, count(*) AS parts, CAST(sum(len(m)) AS BIGINT) AS n_rows, md5(array_to_string(flatten(flatten(list(m ORDER BY page))), '|')) AS rows_md5 FROM g GROUP BY doc_id, g""",
    "layout_json_elements": r"""WITH b AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'title' WHEN 'user' THEN 'paragraph' ELSE 'formula' END AS category, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text FROM conversations),
p AS (SELECT *, max(CASE WHEN category = 'title' AND text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS depth FROM b)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, row_number() OVER w - 1 AS chunk_index, category, turn // 2 + 1 AS page, CAST(depth AS BIGINT) AS depth, row_number() OVER w - 1 AS logic_idx FROM p WHERE text <> '' OR category <> 'paragraph' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "parse_report": r"""WITH p AS (SELECT page_id, html, url || ['.pdf', '.MD', '.txt', '.doc', ''][page_id % 5 + 1] AS name, ['application/pdf', 'text/markdown', 'text/html', '', 'image/png'][(page_id // 5) % 5 + 1] AS kind FROM pages),
s AS (SELECT *, lower(regexp_extract(name, '\.([^.]+)$', 1)) AS x FROM p),
t AS (SELECT *, CASE WHEN kind = 'application/pdf' THEN 'pdf' WHEN kind = 'text/markdown' THEN 'md' WHEN kind LIKE 'text/%' THEN 'txt' WHEN x = 'pdf' THEN 'pdf' WHEN x IN ('md', 'markdown') THEN 'md' WHEN x IN ('txt', 'text') THEN 'txt' END AS file_type FROM s)
SELECT page_id AS doc_id, file_type, CASE WHEN file_type IS NULL THEN 'unsupported' WHEN regexp_matches(coalesce(html, ''), '^\s*$') THEN 'empty' WHEN file_type = 'pdf' THEN 'degraded' ELSE 'parsed' END AS outcome,
CASE WHEN file_type IS NULL THEN 'UnsupportedFormat: ' || trim(coalesce(name, '') || ' ' || kind) WHEN file_type = 'pdf' THEN 'parser_degraded: UnsupportedFormat' END AS warning FROM t""",
    "clean_texts": r"""SELECT doc_id, length(regexp_replace(translate(regexp_replace(translate(replace(text, '-' || chr(10), ''), chr(10) || chr(9), '  '), ' {2,}', ' ', 'g'), '□■◆◇▪▫●○☐', ''), '^\s+|\s+$', '', 'g')) AS plain_chars,
length(regexp_replace(regexp_replace(translate(replace(text, chr(13) || chr(10), chr(10)), '□■◆◇▪▫●○☐', ''), '[ \t]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g')) AS structured_chars FROM documents""",
    "structured_chunks": r"""WITH RECURSIVE l AS (SELECT doc_id, p, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)),
e AS MATERIALIZED (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM l WHERE x <> ''),
k AS (SELECT doc_id, i, length(x) + 2 AS chars, 0 AS pack FROM e WHERE i = 1 UNION ALL
 SELECT e.doc_id, e.i, CASE WHEN k.chars + length(x) > 800 THEN 0 ELSE k.chars END + length(x) + 2, pack + CASE WHEN k.chars + length(x) > 800 THEN 1 ELSE 0 END FROM k JOIN e ON e.doc_id = k.doc_id AND e.i = k.i + 1),
j AS (SELECT doc_id, pack, string_agg(x, chr(10) || chr(10) ORDER BY i) AS x FROM e JOIN k USING (doc_id, i) GROUP BY ALL),
c AS (SELECT doc_id, pack, regexp_replace(translate(regexp_replace(translate(replace(x, '-' || chr(10), ''), chr(10) || chr(9), '  '), ' {2,}', ' ', 'g'), '□■◆◇▪▫●○☐', ''), '^\s+|\s+$', '', 'g') AS x FROM j),
b AS (SELECT *, sum(CASE WHEN length(x) < 30 AND pos > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pack) AS pos FROM c WHERE x <> '')),
m AS (SELECT doc_id, g - 1 AS chunk_index, length(regexp_replace(string_agg(x, ' ' ORDER BY pos), '^\s+|\s+$', '', 'g')) AS chars FROM b GROUP BY doc_id, g)
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, chars, lag(doc_id || ':' || CAST(chunk_index AS BIGINT)) OVER w AS prev_view_id, lead(doc_id || ':' || CAST(chunk_index AS BIGINT)) OVER w AS next_view_id FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""",
    "markdown_chunks": r"""WITH RECURSIVE l AS (SELECT doc_id, p, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS x, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS p FROM (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents))),
e AS MATERIALIZED (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM l WHERE x <> ''),
k AS (SELECT doc_id, i, length(x) + 2 AS chars, 0 AS pack FROM e WHERE i = 1 UNION ALL
 SELECT e.doc_id, e.i, CASE WHEN k.chars + length(x) > 1200 THEN 0 ELSE k.chars END + length(x) + 2, pack + CASE WHEN k.chars + length(x) > 1200 THEN 1 ELSE 0 END FROM k JOIN e ON e.doc_id = k.doc_id AND e.i = k.i + 1),
j AS MATERIALIZED (SELECT doc_id, pack, string_agg(x, chr(10) || chr(10) ORDER BY i) AS x FROM e JOIN k USING (doc_id, i) GROUP BY ALL),
o AS (SELECT doc_id, pack, regexp_extract_all(x, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$') AS w FROM j WHERE length(x) > 1200),
s AS MATERIALIZED (SELECT doc_id, pack, x, row_number() OVER (PARTITION BY doc_id, pack ORDER BY p) AS i FROM (SELECT doc_id, pack, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x, p FROM (SELECT doc_id, pack, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM o)) WHERE x <> ''),
q AS (SELECT doc_id, pack, i, length(x) AS chars, 0 AS part FROM s WHERE i = 1 UNION ALL
 SELECT s.doc_id, s.pack, s.i, CASE WHEN q.chars + length(x) + 1 > 1200 THEN length(x) ELSE q.chars + 1 + length(x) END, part + CASE WHEN q.chars + length(x) + 1 > 1200 THEN 1 ELSE 0 END FROM q JOIN s ON s.doc_id = q.doc_id AND s.pack = q.pack AND s.i = q.i + 1),
u AS (SELECT doc_id, pack, part, string_agg(x, ' ' ORDER BY i) AS x FROM s JOIN q USING (doc_id, pack, i) GROUP BY ALL),
v AS (SELECT doc_id, pack, part, piece, regexp_replace(substr(x, piece + 1, 1200), '^\s+|\s+$', '', 'g') AS x FROM (SELECT *, unnest(range(0, length(x), 1200)) AS piece FROM u) UNION ALL SELECT doc_id, pack, 0, 0, x FROM j WHERE length(x) <= 1200),
c AS (SELECT doc_id, pack, part, piece, regexp_replace(translate(regexp_replace(translate(replace(x, '-' || chr(10), ''), chr(10) || chr(9), '  '), ' {2,}', ' ', 'g'), '□■◆◇▪▫●○☐', ''), '^\s+|\s+$', '', 'g') AS x FROM v WHERE x <> ''),
b AS (SELECT *, sum(CASE WHEN length(x) < 30 AND pos > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pack, part, piece) AS pos FROM c WHERE x <> ''))
SELECT doc_id, CAST(g - 1 AS BIGINT) AS chunk_index, 'paragraph' AS category, length(regexp_replace(string_agg(x, ' ' ORDER BY pos), '^\s+|\s+$', '', 'g')) AS chars FROM b GROUP BY doc_id, g""",
    "semantic_chunks": r"""WITH RECURSIVE l AS (SELECT doc_id, p, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS x, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS p FROM (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents))),
t AS (SELECT doc_id, string_agg(x, chr(10) || chr(10) ORDER BY p) AS x FROM l WHERE x <> '' GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all(x, '[^。！？!?；;\n]*[。！？!?；;\n]|[^。！？!?；;\n]+$') AS w FROM t),
s AS MATERIALIZED (SELECT *, length(x) AS n, list_distinct(list_filter(regexp_extract_all(lower(x), '[\p{L}\p{N}_]+'), lambda y: length(y) > 1)) AS k FROM (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM (SELECT doc_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x, p FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w)) WHERE x <> '')),
r AS (SELECT doc_id, i, 1 AS g, n AS chars, k AS seen FROM s WHERE i = 1 UNION ALL
 SELECT doc_id, i, CASE WHEN new THEN g + 1 ELSE g END, CASE WHEN new THEN n ELSE chars + n END, CASE WHEN new THEN k ELSE list_distinct(list_concat(seen, k)) END
 FROM (SELECT s.doc_id, s.i, s.n, s.k, r.g, r.chars, r.seen, len(seen) = 0 OR len(k) = 0 OR len(list_intersect(seen, k)) / (len(seen) + len(k) - len(list_intersect(seen, k)))::DOUBLE < 0.2::DOUBLE OR chars + n > 800 AS new FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)),
u AS MATERIALIZED (SELECT doc_id, g, string_agg(x, ' ' ORDER BY i) AS x FROM s JOIN r USING (doc_id, i) GROUP BY ALL),
z AS (SELECT doc_id, g, x, 0 AS a, FIRST_CUT AS b FROM u WHERE length(x) > 800 UNION ALL SELECT doc_id, g, x, b AS a, NEXT_CUT AS b FROM z WHERE b < length(x)),
v AS (SELECT doc_id, g, a, regexp_replace(substr(x, a + 1, b - a), '^\s+|\s+$', '', 'g') AS x FROM z UNION ALL SELECT doc_id, g, 0, x FROM u WHERE length(x) <= 800),
c AS (SELECT doc_id, g, a, regexp_replace(translate(regexp_replace(translate(replace(x, '-' || chr(10), ''), chr(10) || chr(9), '  '), ' {2,}', ' ', 'g'), '□■◆◇▪▫●○☐', ''), '^\s+|\s+$', '', 'g') AS x FROM v WHERE x <> ''),
b AS (SELECT doc_id, x, pos, sum(CASE WHEN length(x) < 30 AND pos > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS m FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g, a) AS pos FROM c WHERE x <> ''))
SELECT doc_id, CAST(m - 1 AS BIGINT) AS chunk_index, length(regexp_replace(string_agg(x, ' ' ORDER BY pos), '^\s+|\s+$', '', 'g')) AS chars FROM b GROUP BY doc_id, m""".replace("FIRST_CUT", _CUT.format(cut="0")).replace("NEXT_CUT", _CUT.format(cut="b")),
    "markdown_elements": r"""WITH t AS (SELECT page_id AS doc_id, regexp_replace(regexp_replace(regexp_replace(html, '<h1[^>]*>', chr(10) || chr(10) || '# ', 'gi'), '<li[^>]*>', chr(10) || '- ', 'gi'), '<[^>]+>', chr(10), 'g') AS text FROM pages WHERE html IS NOT NULL),
l AS (SELECT doc_id, p, regexp_replace(x, '\s+$', '') AS x FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM t))),
k AS (SELECT *, length(regexp_extract(x, '^(#{1,6})\s+\S', 1)) AS level FROM l),
n AS (SELECT *, CASE WHEN level > 0 THEN 'title' WHEN regexp_matches(x, '^\s*([*+-]|[0-9]+\.)\s') THEN 'list' WHEN x = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM k),
g AS (SELECT *, CASE WHEN kind IN ('list', 'paragraph') THEN 'text' ELSE kind END AS grp, last_value(CASE WHEN level > 0 THEN level END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS depth FROM n),
b AS (SELECT *, sum(CASE WHEN grp = before AND grp <> 'title' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS block FROM (SELECT *, lag(grp) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM g)),
e AS (SELECT doc_id, block, CASE WHEN any_value(grp) = 'title' THEN 'title' ELSE arg_max(kind, p) END AS category, coalesce(max(depth), 0) AS depth, CASE WHEN any_value(grp) = 'title' THEN max(level) + 1 + length(regexp_replace(max(x), '^#+\s+', '')) ELSE length(regexp_replace(string_agg(x, chr(10) ORDER BY p), '^\s+|\s+$', '', 'g')) END AS chars FROM b WHERE grp <> 'blank' GROUP BY doc_id, block)
SELECT doc_id, category, count(*) AS n, CAST(max(depth) AS BIGINT) AS depth, CAST(sum(chars) AS BIGINT) AS chars FROM e GROUP BY doc_id, category""",
    "address_parts": r"""SELECT page_id, CASE WHEN contains(url, '://') THEN split_part(url, '://', 1) END AS scheme, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^:]*)', 1) ELSE url END AS host,
CASE WHEN contains(url, '://') THEN TRY_CAST(nullif(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^:]*:(\d+)$', 1), '') AS INTEGER) END AS port, url AS redacted FROM pages""",
    "secret_redact": "WITH r AS (SELECT *, CASE WHEN p_name = '' THEN '(empty)' WHEN length(p_name) <= 8 THEN '***' ELSE left(p_name, 4) || '...' || right(p_name, 4) END AS s FROM part) SELECT p_partkey, s AS secret, CASE WHEN p_brand = '' THEN '(empty)' WHEN length(p_brand) <= 8 THEN '***' ELSE left(p_brand, 4) || '...' || right(p_brand, 4) END AS short, s AS key_entry, p_brand AS brand_entry FROM r",
    "table_cell_norm": r"SELECT p_partkey, regexp_replace(regexp_replace(format('{:.3f}', p_retailprice), '0+$', ''), '\.$', '') AS price, p_size || '%' AS share, p_brand || ',' || p_type AS words, true AS numeric FROM part",
    "block_categories": f"SELECT conv_id, turn, kind, CASE WHEN kind IS NULL OR kind = '' OR kind IN {Y.IGNORED_TYPES} THEN NULL {' '.join(f'WHEN kind IN ({chr(44).join(map(repr, kinds))}) THEN {name!r}' for name, kinds in Y.CATEGORY_TYPES.items())} ELSE 'paragraph' END AS category FROM (SELECT conv_id, CAST(turn AS BIGINT) AS turn, {_TYPES}[(conv_id * 7 + turn) % {len(_TYPES) + 1} + 1] AS kind FROM conversations)",
    "table_markdown": r"""WITH c AS (SELECT c_nationkey, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL)
SELECT c_nationkey, md5('| segment | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || s || ' | ' || n || ' |', chr(10) ORDER BY s)) AS md_md5,
md5('<table><thead><tr><th>segment</th><th>n</th></tr></thead><tbody>' || string_agg('<tr><td>' || s || '</td><td>' || n || '</td></tr>', '' ORDER BY s) || '</tbody></table>') AS html_md5, true AS same, count(*) AS n_records FROM c GROUP BY c_nationkey""",
    "heading_levels": r"""WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN p_size || '.' || (p_partkey % 7) || ' ' || p_name ELSE p_name END AS title FROM part),
n AS (SELECT *, p_partkey % 2 = 0 AS num FROM p)
SELECT p_partkey, CASE WHEN num THEN 2 ELSE 1 END::BIGINT AS level, num AS numbered, CASE WHEN num THEN 2 WHEN p_size / 25.0::DOUBLE >= 1.8::DOUBLE THEN 1 WHEN p_size / 25.0::DOUBLE >= 1.5::DOUBLE THEN 2 WHEN p_size / 25.0::DOUBLE >= 1.3::DOUBLE THEN 3 ELSE 4 END::BIGINT AS page_level FROM n""",
}


def _dispatched() -> str:
    """The chunks of each strategy for the documents that have it; text between blank lines is an element."""
    lines = SQL["markdown_chunks"].partition("e AS MATERIALIZED")[0]
    structured = lines + "e AS MATERIALIZED" + SQL["structured_chunks"].partition("e AS MATERIALIZED")[2]
    clean = SQL["structured_chunks"].partition("c AS (SELECT doc_id, pack, ")[2].partition(" AS x FROM j)")[0]
    strip = r"'^\s+|\s+$', '', 'g')"
    fixed = rf"""{lines} t AS (SELECT doc_id, string_agg(x, chr(10) || chr(10) ORDER BY p) AS x FROM l WHERE x <> '' GROUP BY doc_id),
f AS (SELECT doc_id, i, regexp_replace(substr(x, i * 450 + 1, 500), {strip} AS x FROM (SELECT doc_id, x, unnest(range(0, 1 + greatest(0, CAST(ceil((length(x) - 500) / 450::DOUBLE) AS BIGINT)))) AS i FROM t)),
c AS (SELECT doc_id, i, {clean} AS x FROM f WHERE x <> ''),
b AS (SELECT *, sum(CASE WHEN length(x) < 30 AND pos > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM c WHERE x <> ''))
SELECT doc_id, CAST(g - 1 AS BIGINT) AS chunk_index, length(regexp_replace(string_agg(x, ' ' ORDER BY pos), {strip}) AS chars FROM b GROUP BY doc_id, g"""
    parts = {"lang = 'en'": SQL["markdown_chunks"], "lang = 'de'": structured, "lang = 'fr'": SQL["semantic_chunks"], "lang IS NULL OR lang NOT IN ('en', 'de', 'fr')": fixed}
    union = " UNION ALL ".join(f"SELECT doc_id, chunk_index, chars FROM ({sql}) JOIN documents USING (doc_id) WHERE {where}" for where, sql in parts.items())
    return f"SELECT doc_id, chunk_index, 'paragraph' AS category, chars, lag(doc_id || ':' || chunk_index) OVER w AS prev_view_id, lead(doc_id || ':' || chunk_index) OVER w AS next_view_id FROM ({union}) WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)"


SQL["dispatched_chunks"] = _dispatched()
