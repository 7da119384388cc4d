"""Line dedup: windows of three consecutive lines that occur before, in any document, are removed.

Lines are few words long and there are few of them a document, so the windows travel as one hash and a place each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import BLANKS, bound, documents, hex_sha256, materialise, set_aside, without

#: Lines in a window.
LINES = 3
RESULTS = ["n_lines", "n_removed"]


def normalised_line(line: Column) -> Column:
    """Lines are compared without case and with runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(line), BLANKS, " "))


def line_windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, copy, at, key: the hash of each run of `lines` consecutive lines that have a word. `at` counts such lines from 0.

    Lines without a word are no lines here. A document with fewer lines than that has no window. copy, the hash of the
    text, tells apart rows that share a doc_id.
    """
    line = F.filter(F.transform(F.split("text", "\n"), normalised_line), lambda x: x != "")
    row = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.transform(line, lambda x: F.xxhash64(x)).alias("_h")).where(F.size("_h") >= lines)
    hashed = F.transform(F.sequence(F.lit(0), F.size("_h") - lines), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(lines)]))
    return row.select("doc_id", "copy", F.posexplode(hashed).alias("at", "key"))


def later_windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, copy, starts: the sorted places of those windows of a row that occur at a smaller (doc_id, copy, place) too.

    The first place of each window is a minimum, which is taken before the shuffle where rows are read, so a window
    that a third of the documents hold costs one row a task. Windows found once end there; only the places of the
    others are joined, and Spark splits the places of a frequent one.
    """
    found, place = line_windows(docs, lines), F.struct("doc_id", "copy", "at")
    first = found.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    first = materialise(first)
    later = found.join(first, "key").where(place != F.col("first"))
    return later.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """docs with every later occurrence of a window cut out of `text`, and `n_lines`, `n_removed` (lines with a word).

    The removed places are the union of the windows' places: overlapping windows merge. Which occurrence stays is
    decided by the smallest (doc_id, hash of the text, place). Rows that share a doc_id but not the text are rows of
    their own; rows that repeat both are one document and are treated alike; rows without doc_id are passed through whole, as are null
    texts (no lines), empty ones and those with fewer lines than a window. A text's work grows in proportion to its
    lines. An empty table gives an empty result. Further columns are kept; one that has a result's name is given back
    as `<name>_in`.
    """
    work, back = set_aside(docs, ["doc_id", "text"], RESULTS)
    starts = later_windows(work.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), lines).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), F.col("starts").alias("_starts"))
    row = work.join(starts, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_copy")), "left")
    split, has_word = F.split("text", "\n"), lambda x: normalised_line(x) != ""
    # The lines with a word that go, as places among such lines and then among all lines.
    gone = F.array_distinct(F.flatten(F.transform("_starts", lambda i: F.sequence(i, i + lines - 1))))
    worded = lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: has_word(F.get(x, i)))
    left = bound(split, lambda x: bound(worded(x), lambda places: without(x, F.transform(gone, lambda i: F.get(places, i)))))
    return back(row.withColumns({
        "text": F.when(F.col("_starts").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text")),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(split, has_word))).cast("long"),
        "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
    }))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", hex_sha256(F.coalesce("text", F.lit(""))).alias("text_sha256"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
SQL = {
    "op9_line_dedup": r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, p, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS k FROM raw),
n AS (SELECT doc_id, p, k, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS a FROM l WHERE k <> ''),
w AS (SELECT doc_id, a, k || chr(10) || lead(k) OVER o || chr(10) || lead(k, 2) OVER o AS key FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY a)),
later AS (SELECT doc_id, a FROM (SELECT doc_id, a, row_number() OVER (PARTITION BY key ORDER BY doc_id, a) AS r FROM w WHERE key IS NOT NULL) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, a + 3)) AS a FROM later),
marked AS (SELECT l.doc_id, l.p, l.line, l.k, g.a IS NOT NULL AS gone FROM l LEFT JOIN n ON n.doc_id = l.doc_id AND n.p = l.p LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.a = n.a),
agg AS (SELECT doc_id, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(agg.text, '')) AS text_sha256
FROM documents LEFT JOIN agg USING (doc_id)
""",
}
