"""Quality rules by cross-document line frequency: lines that too many documents of a host carry are boilerplate.

A host is the value of `source`. Lines are hashed once a document, counted by (host, line), and taken out above the
limit; documents of which too little is left are rejected, as are those that fail the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import BLANKS, documents, materialise, set_aside, without, words_of

#: A document needs so many words, and at most half of them in repeated windows.
LEAST_WORDS = 50
WINDOW = 3
SYMBOLS = r"[#*$%&|<>]"
#: A line is boilerplate on a host if more documents of the host hold it than this number and than this share of them.
MOST_DOCUMENTS = 20
MOST_SHARE = 0.001
#: A document is depleted if boilerplate lines hold more than this share of its words.
MOST_DEPLETED = 0.9
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "boilerplate_words", "kept"]


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text, the first occurrence included.

    Each window is a long: the top bits of its hash, then its place. Sorting those brings equal windows together; the
    whole hashes of neighbours are compared, so the bits that gave way to the place cost nothing.
    """
    n = F.size(words)
    bits = F.ceil(F.log2(n + F.lit(2))).cast("int")
    window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    packed = F.sort_array(F.transform(starts, lambda i: F.call_function("shiftleft", window(i), bits).bitwiseOR(i.cast("long"))))
    top = lambda x: F.call_function("shiftright", x, bits)
    same = lambda x, y: (top(x) == top(y)) & (window(place(x)) == window(place(y)))

    def counted(all_packed: Column) -> Column:
        twice = F.filter(all_packed, lambda x, i: ((i > 0) & same(x, F.get(all_packed, i - 1))) | ((i < F.size(all_packed) - 1) & same(x, F.get(all_packed, i + 1))))
        places = F.sort_array(F.transform(twice, place))
        return F.aggregate(places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("n")), lambda acc: acc["n"])

    # A lambda over a single array: the sorted windows are computed once.
    return F.get(F.transform(F.array(packed), counted), F.lit(0)).cast("long")


def line_words(line: Column) -> Column:
    return F.size(words_of(line, BLANKS))


def base_counts(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to docs.

    A null text has no words and no lines. Every count is a long.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    row = docs.withColumn("_w", words_of(F.col("text"), BLANKS)).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    row = row.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, BLANKS, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_w"), F.col("_h")),
    })
    return row.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("_w", "_h")


def _host(host: str) -> Column:
    """A host's hash; a null host and an empty one are one host."""
    return F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit("")))


def _line_key(host: Column, line: Column) -> Column:
    """Lines are compared without case and with runs of white space as one blank."""
    return F.xxhash64(host, F.trim(F.regexp_replace(F.lower(line), BLANKS, " ")))


def frequent_lines(docs: DataFrame, host: str = "source", doc: str = "doc_id") -> DataFrame:
    """key, documents: the (host, line) pairs that more documents of the host hold than the limit.

    Documents are distinct values of `doc`: rows that repeat one count once, as does a line that a document repeats;
    rows without one do not count. Spark counts by (host, line, document) first and then by (host, line) before the
    shuffle, so a frequent line costs one row a task there. The table is written, and its size then decides how it is joined.
    """
    given = docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("_doc"), _host(host).alias("_host"), F.col("text").alias("_text"))
    sizes = given.groupBy("_host").agg(F.count_distinct("_doc").alias("_docs"))
    lines = F.filter(F.transform(F.split("_text", "\n"), lambda x: F.trim(F.regexp_replace(F.lower(x), BLANKS, " "))), lambda x: x != "")
    each = given.select("_doc", "_host", F.explode(F.array_distinct(lines)).alias("_line")).select("_doc", "_host", F.xxhash64("_host", "_line").alias("key"))
    counted = each.groupBy("_host", "key").agg(F.count_distinct("_doc").alias("documents")).where(F.col("documents") > MOST_DOCUMENTS)
    return materialise(counted.join(sizes, "_host").where(F.col("documents") > F.col("_docs") * MOST_SHARE).select("key", "documents"))


def depleted(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, _host, _text (hashes of host and text), boilerplate_words: the words of a row in lines above its host's limit, where it has any.

    Rows that are equal in all three have one result, of one of them.
    """
    frequent = frequent_lines(docs, host)
    lines = docs.select("doc_id", _host(host).alias("_host"), F.xxhash64("text").alias("_text"), F.posexplode(F.split("text", "\n")).alias("_at", "_line"))
    found = lines.select("doc_id", "_host", "_text", "_at", _line_key(F.col("_host"), F.col("_line")).alias("key"), line_words(F.col("_line")).alias("words")).where("words > 0").join(frequent, "key", "left_semi")
    return found.dropDuplicates(["doc_id", "_host", "_text", "_at"]).groupBy("doc_id", "_host", "_text").agg(F.sum("words").alias("boilerplate_words"))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """Add the base counts, boilerplate_words and `kept` to docs.

    Null texts and texts without words fail the base rules; a null host and an empty one are one host; rows that repeat
    a doc_id are one document in the counts and are each judged by their own text; rows without doc_id count nowhere and
    are judged by the base rules alone. Whole texts of any length are read; there are no ties to break; an empty table
    gives an empty result. Further columns pass through; one that has a result's name is given back as `<name>_in`.
    """
    work, back = set_aside(docs, ["doc_id", "text", host], RESULTS)
    lost = depleted(work.where(F.col("doc_id").isNotNull()).select("doc_id", "text", host), host)
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("_host").alias("_lost_host"), F.col("_text").alias("_lost_text"), F.col("boilerplate_words").alias("_lost"))
    rows = base_counts(work).withColumns({"_host": _host(host), "_text": F.xxhash64("text")})
    out = rows.join(lost, (F.col("doc_id") == F.col("_id")) & (F.col("_host") == F.col("_lost_host")) & (F.col("_text") == F.col("_lost_text")), "left")
    out = out.withColumn("boilerplate_words", F.coalesce("_lost", F.lit(0)).cast("long"))
    return back(out.withColumn("kept", ~F.col("base_failed") & (F.col("boilerplate_words") <= MOST_DEPLETED * F.col("n_words"))))


def without_boilerplate(docs: DataFrame, host: str = "source") -> DataFrame:
    """docs with the lines above their host's limit cut out of `text`; null texts stay null. Other columns are kept."""
    work, back = set_aside(docs, ["doc_id", "text", host], [])
    frequent = frequent_lines(work, host)
    keyed = materialise(work.withColumn("_row", F.monotonically_increasing_id()))  # read twice, so its numbers must stay
    lines = keyed.select("_row", _host(host).alias("_host"), F.posexplode(F.split("text", "\n")).alias("_at", "_text"))
    gone = lines.select("_row", "_at", _line_key(F.col("_host"), F.col("_text")).alias("key")).join(frequent, "key", "left_semi").groupBy("_row").agg(F.collect_set("_at").alias("_gone"))
    left = F.array_join(without(F.split("text", "\n"), F.col("_gone")), "\n")
    return back(keyed.join(gone, "_row", "left").withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left)))


def op7_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "boilerplate_words")


QUERIES = {"op7_line_frequency_rules": op7_line_frequency_rules}
SQL = {
    "op7_line_frequency_rules": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
raw AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, host, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS k FROM raw),
hosts AS (SELECT host, count(*) AS n FROM d GROUP BY host),
freq AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT doc_id) AS c FROM line WHERE k <> '' GROUP BY host, k) JOIN hosts USING (host) WHERE c > 20 AND c > n * CAST(0.001 AS DOUBLE)),
lost AS (SELECT doc_id, sum(len(string_split(k, ' '))) AS b FROM line JOIN freq USING (host, k) GROUP BY doc_id),
o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(b, 0) AS BIGINT) AS boilerplate_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND boilerplate_words <= CAST(0.9 AS DOUBLE) * n_words AS kept FROM o
""",
}
