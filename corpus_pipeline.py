"""The corpus pipeline: five stages over documents, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontamination, jaccard_join, language, line_dedup
from tessella.llm._shared import as_given, documents, drop_since, hex_sha256, mark, materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is none of the learned ones go; the others keep their columns as they are.

    Null and empty texts and texts without a letter go; repeated rows stay or go together; ties go to the first
    language by name; an empty table stays empty. All columns come back under their names, whatever these are.
    """
    return as_given(language.identify(docs, language.learn(docs.select("doc_id", "text", "lang"))).where("not rejected"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut out, `n_chars` follows; documents of which no word is left go.

    Null and empty texts and those of fewer than three lines stay as they are, as do rows without doc_id; rows that
    repeat a doc_id and text are treated alike; of equal windows the one of the smallest (doc_id, place) stays; an empty
    table stays empty. All columns come back under their names, whatever these are.
    """
    out = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))
    out = out.where(~emptied).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return as_given(out, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one of the smallest doc_id stays.

    Texts without words, null ones included, and rows without doc_id stay; rows that repeat a doc_id stay or go together;
    an empty table stays empty. Columns are those of docs.
    """
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts have no window and stay; repeated rows stay or go together; an empty table stays empty, and
    with an empty benchmark all stay. All columns come back under their names, whatever these are.
    """
    return decontamination.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays, as token ids: doc_id, lang, source, n_tokens, ids, and digests of the ids and of the decoded text.

    A null or empty text has no ids and decodes to an empty text; repeated rows give repeated rows; an empty table
    gives an empty result. Columns other than those named are left out, whatever their names are.
    """
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), bpe.build_lexicon(docs))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", hex_sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), hex_sha256("decoded").alias("decoded_sha256"))


STAGES = [("language ID", language_id), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("BPE encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, start = documents(spark, sf_dir), mark()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
            drop_since(spark, start, docs)  # what the stage wrote, and what it read
    return docs


#: Trained models and the tokenizer cannot be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None
