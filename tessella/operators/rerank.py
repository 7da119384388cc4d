"""Reranking with pluggable scorers, and the order-keeping fallback."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text as X

SNIPPET = 300


def overlap_score(query: Column | str, document: Column | str) -> Column:
    """A deterministic stand-in for a reranking model: the share of the query's tokens that a document holds."""
    q, d = X.compare_tokens(query), X.compare_tokens(document)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, d)) / F.size(q))


def rerank(rows: DataFrame, score: Column, top_k: int = 5) -> DataFrame:
    """The top_k rows of each query by score, with new_rank; ties keep their original order (original_index)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "original_index")
    return rows.withColumn("score", F.round(score, 6)).withColumn("new_rank", F.row_number().over(w) - 1).where(F.col("new_rank") < top_k)


def keep_order(rows: DataFrame, top_k: int = 5) -> DataFrame:
    """Without a reranker: the original order, scores that fall by a thousandth, and a warning."""
    return rows.where(F.col("original_index") < top_k).withColumns({"score": F.round(F.greatest(F.lit(0.0), 1 - 0.001 * F.col("original_index")), 6), "new_rank": F.col("original_index"), "warning": F.lit("reranker_degraded")})


def prompt(query: str, documents: list[str]) -> str:
    """What a language model is asked: the question and the beginnings of the documents, numbered."""
    listed = "\n".join(f"[{i}] {d[:SNIPPET]}" for i, d in enumerate(documents))
    return f'Rate how well each document answers the question, from 0 to 1.\nQuestion: {query}\nDocuments:\n{listed}\nAnswer with JSON only: {{"scores": [..]}}'


def parse_scores(answer: str, expected: int) -> list[float]:
    """The scores of a model's answer: the first JSON object with scores, cut or filled with zeros; zeros if there is none."""
    found = re.search(r"\{.*\}", answer or "", re.S)
    try:
        scores = [float(x) for x in json.loads(found[0])["scores"]] if found else []
    except (ValueError, KeyError, TypeError):
        scores = []
    return (scores + [0.0] * expected)[:expected]


def _scored(rows: DataFrame, scorer, failing: bool) -> DataFrame:
    """rows with `_score` by a scorer that takes a query and the list of its documents, which are few: one list.

    failing: an error of the scorer leaves its query's scores null instead of ending the job.
    """
    listed = rows.groupBy("query_id", "query").agg(F.sort_array(F.collect_list(F.struct("original_index", "text"))).alias("docs"))

    def run(batches):
        for batch in batches:
            for i, query, docs in zip(range(batch.num_rows), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    values = list(map(float, scorer(query or "", [d["text"] or "" for d in docs])))
                except Exception:
                    if not failing:
                        raise
                    values = [None] * len(docs)
                ids = batch.column(0).take(pa.array([i] * len(docs)))
                yield pa.RecordBatch.from_arrays([ids, pa.array([d["original_index"] for d in docs], pa.int64()), pa.array(values, pa.float64())], names=["query_id", "original_index", "_score"])

    schema = T.StructType([T.StructField("query_id", rows.schema["query_id"].dataType), T.StructField("original_index", T.LongType()), T.StructField("_score", T.DoubleType())])
    return rows.join(listed.mapInArrow(run, schema), ["query_id", "original_index"])


def score_with(rows: DataFrame, scorer, top_k: int = 5) -> DataFrame:
    """rerank() by a scorer. Texts that are equal get the score of their own place."""
    return rerank(_scored(rows, scorer, False), F.col("_score"), top_k).drop("_score")


#: Scorers by the names of their providers: each a function of a query and its documents that gives their scores.
PROVIDERS: dict = {}


def register(name: str, scorer) -> None:
    PROVIDERS[name.lower()] = scorer


def rerank_by(rows: DataFrame, provider: str | None, top_k: int = 5) -> DataFrame:
    """Rerank by the scorer of a provider; without one, or for queries at which it fails, keep_order() and its warning."""
    scorer = PROVIDERS.get((provider or "disabled").lower())
    if scorer is None:
        return keep_order(rows, top_k)
    out = _scored(rows, scorer, True)
    score = F.coalesce("_score", F.greatest(F.lit(0.0), 1 - 0.001 * F.col("original_index")))
    return rerank(out.withColumn("warning", F.when(F.col("_score").isNull(), "reranker_degraded")), score, top_k).drop("_score")
