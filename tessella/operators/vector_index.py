"""A vector index in lists: each vector is filed under the nearest of some coarse centroids, and a query looks into few lists.

Vectors are kept whole, so what is looked at is scored as exactly as search.dense_topk() does, which stays the way to go
where nothing may be missed. Centroids are fitted on a bounded sample; all vectors are filed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators import search, stored

#: Lists of an index, and vectors that centroids are fitted on: those of the smallest hashes of their ids.
LISTS, SAMPLE = 128, 16_384
ROUNDS = 12
#: Of the vectors, so many are asked exactly, and queries look into as many lists as find the share RECALL of their K nearest.
ASKED, RECALL, K = 256, 0.95, 10
#: The list of vectors that have another length than the index, or no direction; every query of their length looks into it.
OTHERS = -1


def fit(corpus: DataFrame, lists: int = LISTS, id_col: str = "doc_id", vector: str = "embedding", sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of directions, from a sample of at most `sample` vectors of its most frequent length; fewer than `lists` of a small one."""
    rows = corpus.where(F.size(vector) > 0).select(F.xxhash64(F.lit(3), id_col).alias("h"), F.col(vector).alias("v")).orderBy("h").limit(sample).collect()
    sizes = [len(r.v) for r in rows]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n), default=1)
    x = np.array([r.v for r in rows if len(r.v) == dim and None not in r.v], np.float64).reshape(-1, dim)
    x = _units(x[np.isfinite(x).all(1) & (x != 0).any(1)])
    centroids = x[: min(lists, len(x))]  # the sample is in the order of hashes, so these are drawn by chance
    for _ in range(ROUNDS if len(x) else 0):
        near = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        moved = (sums != 0).any(1)
        centroids = np.where(moved[:, None], _units(np.where(moved[:, None], sums, 1.0)), centroids)
    return centroids


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filed(df: DataFrame, id_col: str, vector: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """_id, _v, _list: each row once for each of its `probes` nearest lists; a vector without direction or of another length is in OTHERS alone."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = shared.value
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            fits = np.array([v is not None and len(c) > 0 and len(v) == c.shape[1] and None not in v and any(v) and np.isfinite(v).all() for v in vectors], bool)
            rows, lists = [], []
            where = np.nonzero(fits)[0]
            if len(where):
                score = np.array([vectors[i] for i in where], np.float64) @ c.T
                near = np.argsort(-score, 1, kind="stable")[:, :probes]
                rows, lists = np.repeat(where, near.shape[1]).tolist(), near.ravel().tolist()
            odd = [i for i, v in enumerate(vectors) if not fits[i] and v]
            order = pa.array(rows + odd, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(order), batch.column(1).take(order), pa.array(lists + [OTHERS] * len(odd), pa.int32())], names=["_id", "_v", "_list"])

    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), T.StructField("_v", df.schema[vector].dataType), T.StructField("_list", T.IntegerType())])
    return df.select(id_col, vector).mapInArrow(run, schema)


def _stacked(filed: DataFrame, rows: int, prefix: str) -> DataFrame:
    """The vectors of each list as matrices of `rows` rows at most, each of one length, in the order of ids. A list of many vectors is split."""

    def run(batches):
        for batch in batches:
            lists, sizes = batch.column(2).to_numpy(), np.array([len(v) for v in batch.column(1)])
            edges = np.nonzero(np.diff(lists, prepend=lists[0] - 1) | np.diff(sizes, prepend=-1))[0] if batch.num_rows else []
            for a, b in zip(edges, [*edges[1:], batch.num_rows]):
                for start in range(a, b, rows):
                    part = batch.slice(start, min(rows, b - start))
                    matrix = np.array(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64)
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                    yield pa.RecordBatch.from_arrays([pa.array([int(lists[a])], pa.int32()), pa.array([int(sizes[a])], pa.int32()), ids, pa.array([matrix.tobytes()], pa.binary()), pa.nulls(1, pa.list_(pa.map_(pa.string(), pa.string())))], names=[f"{prefix}_{c}" for c in ("list", "dim", "ids", "rows", "where")])

    schema = T.StructType([T.StructField(f"{prefix}_list", T.IntegerType()), T.StructField(f"{prefix}_dim", T.IntegerType()), T.StructField(f"{prefix}_ids", T.ArrayType(filed.schema["_id"].dataType)), T.StructField(f"{prefix}_rows", T.BinaryType()), T.StructField(f"{prefix}_where", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])
    dealt = filed.hint("rebalance", "_list").sortWithinPartitions("_list", F.size("_v"), "_id")
    return dealt.select("_id", "_v", "_list").mapInArrow(run, schema)


def probes_for(corpus: DataFrame, centroids: np.ndarray, id_col: str = "doc_id", vector: str = "embedding", share: float = RECALL) -> int:
    """The fewest lists that hold the share of the K nearest of ASKED vectors, drawn by hash, in an exact search of all."""
    drawn = corpus.where(F.size(vector) == (centroids.shape[1] if len(centroids) else 0)).orderBy(F.xxhash64(F.lit(4), id_col)).limit(ASKED).select(F.col(id_col).alias("query_id"), F.col(vector).alias("_q"))
    drawn = stored.written(drawn)
    found = search.dense_topk(drawn.withColumnRenamed("_q", vector), corpus, K, id_col=id_col, vector=vector).select("query_id", id_col)
    pairs = found.join(corpus.select(id_col, vector), id_col).join(drawn, "query_id").select(vector, "_q").collect()
    pairs = [(r[0], r[1]) for r in pairs if len(r[0]) == len(r[1]) and None not in r[0] and None not in r[1]]
    if not pairs:
        return max(1, len(centroids))
    near, asked = (np.array(x, np.float64) for x in zip(*pairs))
    order = np.argsort(-(asked @ centroids.T), 1, kind="stable")
    places = np.sort(np.argmax(order == (near @ centroids.T).argmax(1)[:, None], 1))
    return int(places[int(np.ceil(share * len(places))) - 1]) + 1


class VectorIndex:
    """An index in a folder: its blocks, by list, its centroids, and how many lists a query looks into."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.probes = spark.read.parquet(f"{folder}/probes").first().probes
        rows = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()
        self.centroids = np.array([r.centroid for r in rows], np.float64) if rows else np.zeros((0, 1))

    @classmethod
    def build(cls, corpus: DataFrame, folder: str, lists: int = LISTS, id_col: str = "doc_id", vector: str = "embedding", sample: int = SAMPLE, share: float = RECALL) -> VectorIndex:
        """File all vectors of corpus; null and empty ones are left out. share: the part of the nearest that is to be found."""
        spark = corpus.sparkSession
        centroids = fit(corpus, lists, id_col, vector, sample)
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").write.parquet(f"{folder}/centroids")
        _stacked(_filed(corpus, id_col, vector, centroids, 1), search.CORPUS_BLOCK, "c").write.partitionBy("c_list").parquet(f"{folder}/blocks")
        spark.createDataFrame([(probes_for(corpus, centroids, id_col, vector, share),)], "probes int").write.parquet(f"{folder}/probes")
        return cls(spark, folder)

    def add(self, rows: DataFrame, id_col: str = "doc_id", vector: str = "embedding") -> None:
        """File further vectors under the centroids as they are."""
        _stacked(_filed(rows, id_col, vector, self.centroids, 1), search.CORPUS_BLOCK, "c").write.mode("append").partitionBy("c_list").parquet(f"{self.folder}/blocks")

    def topk(self, queries: DataFrame, k: int, probes: int | None = None, threshold: float | None = None, distance: str = "cosine", id_col: str = "doc_id", vector: str = "embedding") -> DataFrame:
        """query_id, id, score, rank as dense_topk() has them, of what the lists nearest to each query's direction hold; as many as the index has found to be enough, if not given.

        With as many probes as lists nothing is missed. Queries of one list meet its blocks together.
        """
        blocks = self.spark.read.parquet(f"{self.folder}/blocks")
        asked = _filed(queries, "query_id", vector, self.centroids, probes or self.probes)
        everywhere = queries.where(F.size(vector) > 0).select(F.col("query_id").alias("_id"), F.col(vector).alias("_v"), F.lit(OTHERS).alias("_list"))
        odd = asked.where(F.col("_list") == OTHERS).select("_id", "_v")  # they look into every list of their length
        lists = [F.lit(i) for i in range(len(self.centroids))]
        spread = odd.withColumn("_list", F.explode(F.array(*lists).cast("array<int>")))
        every = asked.where(F.col("_list") != OTHERS).unionByName(everywhere).unionByName(spread.select("_id", "_v", "_list"))
        asked_blocks = _stacked(every, search.QUERY_BLOCK, "q")
        pairs = blocks.join(asked_blocks, (F.col("c_list") == F.col("q_list")) & (F.col("c_dim") == F.col("q_dim")))
        out = search.multiplied(pairs, queries.schema["query_id"].dataType, blocks.schema["c_ids"].dataType.elementType, k, search.distance_name(distance), id_col)
        if threshold is not None:
            out = out.where(F.col("score") >= threshold)
        return search.ranked(out, k, id_col)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """query_id, recall: the share of the exact results that was found."""
    hit = exact.select("query_id", id_col).join(found.select("query_id", id_col, F.lit(1).alias("_hit")), ["query_id", id_col], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
