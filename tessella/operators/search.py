"""Dense and sparse top-k search for whole tables of queries.

Queries are rows (query_id, ...), results are rows (query_id, rank, doc id, score). Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text as X
from tessella.operators import conditions, lexical, stored

#: Rows that are multiplied at once: of the corpus, and queries.
CORPUS_BLOCK, QUERY_BLOCK = 8192, 256
#: Most bytes of query vectors that are broadcast, and keys that the corpus is dealt to beyond it.
BROADCAST_BYTES = 16_000_000
SALTS = 64


def equality_filter(df: DataFrame, filters: dict | None) -> DataFrame:
    """Rows whose columns equal the given values; {"must": {...}} means the same. A list of conditions is an error here."""
    wanted = (filters or {}).get("must", filters) or {}
    if not isinstance(wanted, dict):
        raise ValueError("filters are given as a mapping of column to value")
    for name, value in wanted.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def check_top_k(top_k: int, most: int = 100) -> int:
    if not 1 <= top_k <= most:
        raise ValueError(f"top_k must lie between 1 and {most}")
    return top_k


def ranked(df: DataFrame, k: int | None, id_col: str = "doc_id", by: str = "query_id") -> DataFrame:
    """The k best rows of each query with their rank from 0. Spark cuts to k before the shuffle and again after it."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.col(id_col))
    out = df.withColumn("rank", F.row_number().over(w) - 1)
    return out if k is None else out.where(F.col("rank") < k)


def _blocks(df: DataFrame, id_col: str, vector: str, rows: int, prefix: str, where: str | None = None) -> DataFrame:
    """Vectors stacked to matrices, a block's rows in the order of their ids: ids of any type, the rows of a matrix as bytes of doubles, and the rows' maps of conditions."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                part = part.filter(part.column(1).is_valid())
                sizes = [len(x) for x in part.column(1)]
                for dim in sorted(set(sizes)):  # vectors of different length are never compared
                    own = part.filter(pa.array([n == dim for n in sizes]))
                    matrix = np.array(own.column(1).flatten().to_numpy(zero_copy_only=False), np.float64)
                    ids = pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(0))
                    maps = pa.array([own.column(2).to_pylist() if where else None], pa.list_(pa.map_(pa.string(), pa.string())))
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), ids, pa.array([matrix.tobytes()], pa.binary()), maps], names=[f"{prefix}_{c}" for c in ("dim", "ids", "rows", "where")])

    schema = T.StructType([T.StructField(f"{prefix}_dim", T.IntegerType()), T.StructField(f"{prefix}_ids", T.ArrayType(df.schema[id_col].dataType)), T.StructField(f"{prefix}_rows", T.BinaryType()), T.StructField(f"{prefix}_where", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])
    return df.select(id_col, vector, *[where] * bool(where)).sortWithinPartitions(id_col).mapInArrow(run, schema)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None = None, distance: str = "cosine", id_col: str = "doc_id", vector: str = "embedding", where: str | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the k nearest rows of corpus for each row of queries (query_id, vector).

    Exact; ids may be of any type that Spark can order, structs too. Blocks of queries meet blocks of the corpus, each
    pair is one matrix product, and only the k best of a pair go on. Query blocks are broadcast if they have few bytes;
    else the corpus blocks are dealt to SALTS keys, at each of which all query blocks pass by. Distances: cosine, dot,
    euclid (as a negative distance). A zero vector has cosine 0 with everything. Scores are rounded to 6 digits before
    they are ranked, so results do not depend on the order of additions. where: a column that both have, of queries a map
    of conditions, of corpus the map that has to meet them.
    """
    distance = distance_name(distance)
    asked, held = _blocks(queries, "query_id", vector, QUERY_BLOCK, "q", where), _blocks(corpus, id_col, vector, CORPUS_BLOCK, "c", where)
    if _few_bytes(queries, vector):
        pairs = held.join(F.broadcast(asked), F.col("c_dim") == F.col("q_dim"))
    else:
        asked = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = held.withColumn("_salt", F.pmod(F.xxhash64("c_rows"), F.lit(SALTS)).cast("int"))
        pairs = held.join(asked, (F.col("c_dim") == F.col("q_dim")) & (held["_salt"] == asked["_salt"]))
    out = multiplied(pairs, queries.schema["query_id"].dataType, corpus.schema[id_col].dataType, k, distance, id_col, where is not None)
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    return ranked(out, k, id_col)


def distance_name(distance: str) -> str:
    return {"cos": "cosine"}.get(distance.lower(), distance.lower())


def multiplied(pairs: DataFrame, query_type: T.DataType, id_type: T.DataType, k: int, distance: str, id_col: str, conditional: bool = False) -> DataFrame:
    """query_id, id, score: the k best of each pair of a block of queries (q_...) and one of the corpus (c_...)."""

    def run(batches):
        for batch in batches:
            for q_ids, c_ids, q_rows, c_rows, q_where, c_where in zip(*(batch.column(i) for i in range(6))):
                q_ids, c_ids = q_ids.values, c_ids.values
                c = np.frombuffer(c_rows.as_py()).reshape(len(c_ids), -1)
                q = np.frombuffer(q_rows.as_py()).reshape(len(q_ids), -1)
                score = q @ c.T
                if distance == "cosine":
                    norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
                    score = np.divide(score, norm, out=np.zeros_like(score), where=norm > 0)
                elif distance == "euclid":
                    score = -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * score, 0))
                score = np.round(score, 6)
                if conditional:
                    masks = conditions.Matcher(c_where.as_py()).masks(q_where.as_py())
                    score = score if masks is None else np.where(masks, score, -np.inf)
                score[np.isnan(score)] = -np.inf
                row, place = lexical.best_of(score, k, -np.inf)  # columns lie in the order of ids, which so decides ties
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row)), c_ids.take(pa.array(place)), pa.array(score[row, place])], names=["query_id", id_col, "score"])

    schema = T.StructType([T.StructField("query_id", query_type), T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())])
    return pairs.select("q_ids", "c_ids", "q_rows", "c_rows", "q_where", "c_where").mapInArrow(run, schema)


def _few_bytes(queries: DataFrame, vector: str) -> bool:
    """Whether the queries' vectors are so small together that all of them may be sent to every task."""
    return (queries.agg(F.sum(F.size(vector) * 8 + 32).alias("n")).first().n or 0) <= BROADCAST_BYTES


def postings(docs: DataFrame, id_col: str = "doc_id", content: str = "text") -> DataFrame:
    """doc id, term, tf: the sparse vectors of texts in long form; counts are added up where texts are read."""
    return docs.select(id_col, F.explode(X.terms(content)).alias("_t")).groupBy(id_col, X.term_index("_t").alias("term")).agg(F.count("*").alias("tf"))


def sparse_topk(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "doc_id", where: str | None = None) -> DataFrame:
    """Top-k by the dot product of term counts. queries: (query_id, text); corpus: (doc_id, text). No text, no result.

    where: a column that both have, of queries a map of conditions, of corpus the map that has to meet them.
    """
    return ranked(lexical.topk(queries, lexical.blocks(corpus, id_col, where=where), k, "counts", where, id_col=id_col), k, id_col)


def fallback_topk(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "doc_id", where: str | None = None) -> DataFrame:
    """Top-k without a sparse index: each occurrence of a query's token that a text holds adds 1 + its share of the text."""
    return ranked(lexical.topk(queries, lexical.blocks(corpus, id_col, where=where, exact=True), k, "shares", where, True, id_col), k, id_col)


def lexical_topk(queries: DataFrame, corpus: DataFrame, k: int, layout: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sparse_topk() in collections that have a sparse index, fallback_topk() in those that have none.

    queries and corpus bear a `collection`, in which a query is asked alone; layout: catalog.vector_layout().
    """
    known = layout.select("collection", "has_sparse")
    inside = conditions.attributes(queries, ["collection"]).alias("_where")
    asked = queries.join(known, "collection").select(F.struct("collection", "query_id").alias("query_id"), "text", "has_sparse", inside)
    held = corpus.join(known, "collection").select(F.struct("collection", F.col(id_col).alias("id")).alias("_id"), "text", "has_sparse", inside)
    legs = [search(asked.where(F.col("has_sparse") == has), held.where(F.col("has_sparse") == has), k, "_id", "_where") for has, search in ((True, sparse_topk), (False, fallback_topk))]
    return legs[0].unionByName(legs[1]).select("query_id.collection", "query_id.query_id", F.col("_id.id").alias(id_col), "score", "rank")


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """Top-k by BM25 proper (k1 = 1.2, b = 0.75), which the plain product of counts is not. The index is written, as it is read three times."""
    index = stored.written(lexical.blocks(corpus, id_col))
    return ranked(lexical.topk(queries, index, k, "bm25", id_col=id_col, kept=True), k, id_col)


def hashed_embedding(text: Column | str, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of terms, hashed to `dim` places. Not a trained model."""
    index = F.transform(X.terms(text), lambda t: X.term_index(t))
    sign = lambda h: F.when(F.floor(h / dim) % 2 == 0, 1.0).otherwise(-1.0)
    places = lambda ix: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.aggregate(F.filter(ix, lambda h: h % dim == d), F.lit(0.0), lambda acc, h: acc + sign(h)).cast("float"))
    return X.let(F.coalesce(index, F.array().cast("array<bigint>")), places)


def embed(texts: DataFrame, encode, dim: int, column: str = "text", out: str = "embedding", batch: int = 64) -> DataFrame:
    """texts with vectors of a pluggable encoder, a function of a list of texts; it gets `batch` texts at a time. A null or blank text has zeros."""

    def run(batches):
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                given = [t or "" for t in part.column(part.schema.get_field_index(column)).to_pylist()]
                some = [i for i, t in enumerate(given) if t.strip()]
                vectors = [[0.0] * dim for _ in given]
                for i, v in zip(some, encode([given[i] for i in some]) if some else []):
                    vectors[i] = list(map(float, v))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*part.schema.names, out])

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))
