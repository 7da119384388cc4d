"""Benchmark decontamination: training texts are scanned for the word windows of test items.

Windows of the test items form a hash set that is broadcast, as scalar subqueries of the scan, behind a check of its
bytes. Before a window of a training text is looked up there, a table of one byte a slot tells whether it can be in the
set at all; the few that can are compared letter by letter with the windows of their bucket, so hits are exact. All that
is done in the row: training texts are read once, and neither multiplied nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import PUNCTUATION, as_given, ascii_lower, bound, documents, drop_since, hex_sha256, mark, materialise, set_aside, without, words_of

#: Words in a window.
WINDOW = 10
#: Slots of the first test, and buckets of the set. These are their sizes whatever the benchmark's; a crowded table lets more windows through to the exact test.
SLOTS = 1 << 18
BUCKETS = 1 << 14
#: Most bytes of the set that is broadcast; windows of larger benchmarks are joined by a shuffle of what passes the first test.
BROADCAST_BYTES = 32_000_000
#: Bytes of a window in the set beside those of its text and its items.
HEAD = 48
RESULTS = ["n_words", "n_hit", "spans", "items"]


def normalised_words(text: Column) -> Column:
    return words_of(ascii_lower(text), PUNCTUATION)


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per distinct window of the items: `window` (its words, joined by blanks), `width`, `items` (ids as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), normalised_words(F.col("text")).alias("w")).where((F.size("w") > 0) & F.col("item_id").isNotNull())
    size = F.least(F.size("w"), F.lit(width))
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.array_join(F.slice(F.col("w"), i + 1, size), " "))
    return items.select("item_id", size.alias("width"), F.explode(windows).alias("window")).groupBy("window", "width").agg(F.collect_set("item_id").alias("items"))


def _slot(hashes: list[Column]) -> Column:
    return F.xxhash64(*hashes).bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def _dense(rows: DataFrame, size: int, none: Column) -> DataFrame:
    """The rows (at, v) as one array of `size`, by `at`, with `none` where no row is: a written table of one row, for scalar()."""
    gap = lambda at, before: F.array_repeat(none, at - F.coalesce(before, F.lit(-1)) - 1)
    held = rows.agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("x"))
    parts = F.transform("x", lambda r, i: F.concat(gap(r["at"], F.get("x", i - 1)["at"]), F.array(r["v"])))
    rest = gap(F.lit(size), F.get("x", F.size("x") - 1)["at"])
    return materialise(held.select(F.flatten(F.concat(parts, F.array(rest))).alias("x")))


def _slot_table(windows: DataFrame, width: int) -> DataFrame:
    """array<tinyint>: a byte for each slot, 1 where a window of this width falls."""
    words = F.split("window", " ")
    slots = windows.where(F.col("width") == width).select(_slot([F.xxhash64(words[i]) for i in range(width)]).alias("at")).distinct()
    return _dense(slots.select("at", F.lit(1).cast("tinyint").alias("v")), SLOTS, F.lit(0).cast("tinyint"))


def _starts(hashes: str, width: int) -> Column:
    size = F.size(hashes)
    return F.when(size >= width, F.sequence(F.lit(0), size - width)).otherwise(F.array().cast("array<int>"))


def candidates(tables: dict[int, tuple[str, str]], words: str, hashes: str) -> Column:
    """array<struct<at, width, hash, window>>: the windows of an array of words that may be windows of an item, by the columns of each width's starts and slot table."""
    found = [F.array().cast("array<struct<at:int,width:int,hash:bigint,window:string>>")]
    h = F.col(hashes)
    for width, (starts, table) in tables.items():
        may = F.filter(starts, lambda i: F.get(table, _slot([F.get(h, i + k) for k in range(width)])) == F.lit(1).cast("tinyint"))
        found.append(F.transform(may, lambda i: F.struct(i.alias("at"), F.lit(width).alias("width"), F.xxhash64(*[F.get(h, i + k) for k in range(width)]).alias("hash"), F.array_join(F.slice(F.col(words), i + 1, width), " ").alias("window"))))
    return F.concat(*found)


def _bucket(hash: Column) -> Column:
    return hash.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _window_set(windows: DataFrame, widths: list[int]) -> DataFrame:
    """array<array<struct<window, items>>>: the windows by their bucket; items: ids with NUL between them."""
    word = F.split("window", " ")
    bucket = F.coalesce(F.lit(None).cast("int"), *[F.when(F.col("width") == k, _bucket(F.xxhash64(*[F.xxhash64(F.get(word, F.lit(i))) for i in range(k)]))) for k in widths])
    rows = windows.select(bucket.alias("at"), F.struct("window", F.array_join(F.array_sort("items"), "\0").alias("items")).alias("v")).groupBy("at").agg(F.collect_list("v").alias("v"))
    return _dense(rows, BUCKETS, F.array().cast(rows.schema["v"].dataType))


def known(found: str, buckets: str) -> Column:
    """array<struct<at, width, items>> of those candidates that are windows; items: ids with NUL between them."""
    items = lambda c: F.get(F.filter(F.get(buckets, _bucket(c["hash"])), lambda x: x["window"] == c["window"]), F.lit(0))["items"]
    owned = F.transform(found, lambda c: F.struct(c["at"].alias("at"), c["width"].alias("width"), items(c).alias("items")))
    return F.filter(owned, lambda x: x["items"].isNotNull())


def _runs(hits: Column) -> Column:
    """array<struct<at, end>>: the runs of words that hits cover, in time linear in their number but for one sort."""
    covered = F.sort_array(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["at"], x["at"] + x["width"] - 1)))))

    def runs(places: Column) -> Column:
        firsts = F.filter(places, lambda p, i: (i == 0) | (F.get(places, i - 1) < p - 1))
        lasts = F.filter(places, lambda p, i: (i == F.size(places) - 1) | (F.get(places, i + 1) > p + 1))
        return F.zip_with(firsts, lasts, lambda a, z: F.struct(a.alias("at"), (z + 1).alias("end")))

    return bound(covered, runs)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Add to each row of docs: `n_words`, `n_hit` (words inside any occurrence of a window), `spans`, `items`.

    spans: array<struct<at, end>>, the merged runs of hit words. items: sorted ids, as strings, of the items with
    occurring windows. A null or empty text has no words; an item with none, or without an id, has no window; repeated
    rows are scanned each for itself, so ties need no rule; whole texts of any length are scanned. An empty table gives
    an empty result, and with an empty benchmark nothing is hit. Other columns pass through; those that have a result's
    name are given back as `<name>_in`.
    """
    work, back = set_aside(docs, ["text"], RESULTS)
    start = mark()
    windows = materialise(item_windows(benchmark, width))
    sizes = {r.width: r.n for r in windows.groupBy("width").agg(F.sum(F.octet_length("window") + F.octet_length(F.array_join("items", "\0")) + HEAD).alias("n")).collect()}
    tables = {k: _slot_table(windows, k) for k in sorted(sizes)}  # widths from 1 to the window's
    row = work.withColumn("_w", normalised_words(F.col("text"))).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    # A subquery has to stand outside lambdas here. Spark moves it into the one column above that names it, and not down
    # to _h, which _s names more than once; so no row carries its value.
    asked = {k: (f"_s{k}", f"_t{k}") for k in tables}
    row = row.withColumns({c: v for k, (x, t) in asked.items() for c, v in ((x, _starts("_h", k)), (t, tables[k].scalar()))})
    row = row.select(*work.columns, F.size("_w").cast("long").alias("n_words"), candidates(asked, "_w", "_h").alias("_found"))
    if sum(sizes.values()) <= BROADCAST_BYTES:
        buckets = _window_set(windows, list(tables))
        drop_since(docs.sparkSession, start, *tables.values(), buckets)
        row = row.withColumn("_set", buckets.scalar()).withColumn("_hits", known("_found", "_set")).drop("_set")
    else:
        row = _joined(row, windows)
    out = row.withColumn("spans", _runs(F.col("_hits")))
    return back(out.withColumns({
        "n_hit": F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["at"]),
        "items": F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda x: F.split(x["items"], "\0"))))),
    }))


def _joined(row: DataFrame, windows: DataFrame) -> DataFrame:
    """row with _hits, where the set is too large to broadcast.

    Texts are known by two hashes, so that candidates of equal texts are looked up once and without the text. Only
    texts with hits get into the last join's smaller side; a frequent text's rows are split there by Spark.
    """
    row = row.withColumns({"_k": F.when(F.size("_found") > 0, F.xxhash64("text")), "_l": F.xxhash64(F.lit(3), F.col("text"))})
    asked = row.where(F.col("_k").isNotNull()).select("_k", "_l", F.explode("_found").alias("_c")).select("_k", "_l", F.col("_c.at").alias("at"), F.col("_c.width").alias("width"), F.col("_c.window").alias("window")).distinct()
    found = asked.join(windows.select("window", F.array_join(F.array_sort("items"), "\0").alias("items")), "window")
    hits = materialise(found.groupBy("_k", "_l").agg(F.collect_list(F.struct("at", "width", "items")).alias("_hits")))
    none = F.array().cast(hits.schema["_hits"].dataType)
    return row.join(hits, ["_k", "_l"], "left").withColumn("_hits", F.coalesce("_hits", none))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most: float = 0.0) -> DataFrame:
    """The rows of docs of whose words at most the share `most` is hit, with the columns of docs, as they are."""
    # A row number, which no filter is pushed below, so that the scan is not made once more for the filter.
    out = scan(docs, benchmark, width).withColumn("_no", F.monotonically_increasing_id())
    return as_given(out.where((F.col("_no") >= 0) & (F.col("n_hit") <= F.col("n_words") * F.lit(most))), docs)


#: What stands between words in a text whose capitals are still there.
_BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of docs with the hit words cut out of their texts; what stands between two words goes with the first.

    Texts without a hit stay as they are, null texts stay null.
    """
    out = scan(docs, benchmark, width)
    # The text as pieces, each a word and what follows it; piece 0 is what stands before the first word.
    pieces = F.regexp_extract_all(F.concat(F.lit(""), "text"), F.lit(f"^[{_BETWEEN}]+|[^{_BETWEEN}]+[{_BETWEEN}]*"), 0)
    lead = F.when(F.regexp_like("text", F.lit(f"^[{_BETWEEN}]")), 1).otherwise(0)
    gone = F.transform(F.flatten(F.transform("spans", lambda x: F.sequence(x["at"], x["end"] - 1))), lambda i: i + lead)
    kept = without(pieces, gone)
    return as_given(out.withColumn("text", F.when(F.col("n_hit") > 0, F.array_join(kept, "")).otherwise(F.col("text"))), docs)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), hex_sha256(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op1_benchmark_decontamination": op1_benchmark_decontamination}
SQL = {
    "op1_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, r, i, k, array_to_string(w[i + 1 : i + k], ' ') AS win
  FROM (SELECT doc_id, r, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT r, i, dw.k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
""",
}
