"""Centroid clustering of integer vectors by Spark's own expressions: no row leaves the JVM.

Each round sends k centroids as literal arrays. zip_with and aggregate give a vector's squared distance to each,
array_min over structs of (distance, number) the nearest one, and sums of the components by cluster are added up where
the vectors are read. So a round shuffles k rows a task, and what the driver gets is k rows of sums.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import documents, drop_since, mark, materialise, set_aside

CLUSTERS, ROUNDS, COMPONENTS, SCALE = 8, 10, 64, 1024
#: Largest absolute value of an integer component: squares of differences of 64 of them still fit a long.
LARGEST = 1 << 27
RESULTS = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def integers(vectors: DataFrame, column: str = "embedding", size: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """The rows whose vector has exactly `size` components, all of them finite numbers, with `_v`: floor(scale * x) of each.

    Vectors that are null, shorter, longer, or that hold a null, NaN, an infinity or a component beyond LARGEST go.
    """
    x = F.transform(F.col(column), lambda c: F.floor(c.cast("double") * scale))
    sound = F.forall(F.col(column), lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LARGEST, F.lit(False)))
    return vectors.where((F.size(column) == size) & sound).withColumn("_v", F.transform(x, lambda c: c.cast("int")))


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid; of those as near the one of the smallest number."""

    def distance(c: list[int]) -> Column:
        literal = F.expr(f"array({', '.join(f'{x}L' for x in c)})")
        return F.aggregate(F.zip_with(vector, literal, lambda a, b: a - b), F.lit(0).cast("long"), lambda s, d: s + d * d)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def first_centroids(rows: DataFrame, id_column: str, k: int, seed: int) -> list[list[int]]:
    """The k vectors of the smallest sha256 of `<seed>:<id>`, in that order; equal ids are ordered by their vectors, null ids come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 256)
    return [list(r._v) for r in rows.select(order.alias("h"), "_v").orderBy(F.col("h").asc_nulls_last(), "_v").limit(k).collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid replaced by the floor of the mean of its vectors; one without vectors stays."""
    size = len(centroids[0])
    sums = rows.select(nearest(F.col("_v"), centroids)["cluster"].alias("cluster"), "_v").groupBy("cluster").agg(F.count("*").alias("n"), *[F.expr(f"sum(_v[{i}]) AS s{i}") for i in range(size)])
    out = list(centroids)
    for r in sums.collect():
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(size)]
    return out


def cluster(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, size: int = COMPONENTS, scale: int = SCALE, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """The kept vectors with cluster, distance, cluster_inertia, inertia and centroid_sha256; and the final centroids.

    Vectors are kept as integers() says and become integers, so results are exact and do not depend on partitions. Where
    fewer than k vectors are kept there are as many clusters as vectors; an empty table gives an empty result. Repeated
    vectors go to one cluster, and copies may be among the first centroids: of equal ones the first takes all vectors,
    the others stay as they are. Repeated and null ids are rows like others. Sums of distances beyond a long are null.
    Further columns pass through; one that has the name of a result is given back as `<name>_in`.
    """
    work, back = set_aside(vectors, [id_column, column], RESULTS)
    kept = integers(work, column, size, scale)
    start = mark()
    rows = materialise(kept.select(id_column, "_v"))
    centroids = first_centroids(rows, id_column, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids)
    if not centroids:
        drop_since(vectors.sparkSession, start)
        none = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return back(kept.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})), []
    near = nearest(F.col("_v"), centroids)
    by_cluster = {r.cluster: r.d for r in rows.select(near.alias("near")).groupBy("near.cluster").agg(F.try_sum("near.distance").alias("d")).collect()}
    drop_since(vectors.sparkSession, start)
    every = None if None in by_cluster.values() or (total := sum(by_cluster.values())) >= 1 << 63 else total
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    number = F.col("_near.cluster")
    of = lambda values, kind: reduce(lambda out, i: F.when(number == i, F.lit(values[i]).cast(kind)).otherwise(out), range(len(centroids)), F.lit(None).cast(kind))
    out = kept.withColumn("_near", near).withColumns({
        "cluster": number, "distance": F.col("_near.distance"), "cluster_inertia": of([by_cluster.get(i) for i in range(len(centroids))], "long"),
        "inertia": F.lit(every).cast("long"), "centroid_sha256": of(digests, "string"),
    })
    return back(out), centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(documents(spark, sf_dir, "embeddings").select("vec_id", "embedding"))[0].drop("embedding")


def _sql() -> str:
    """The rounds one after another: a_i assigns by the centroids c_i, and c_(i+1) are its means."""
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = {COMPONENTS} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {COMPONENTS})",
        f"c0 AS MATERIALIZED (SELECT k, v AS c FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v FROM kept) WHERE k < {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, v, min({{'d': CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, c)]) AS BIGINT), 'k': k}}) AS best FROM kept, c{i} GROUP BY vec_id, v)")
        if i < ROUNDS:
            parts.append(
                f"m{i} AS MATERIALIZED (SELECT k, list(m ORDER BY p) AS c FROM (SELECT best.k AS k, p, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i}) GROUP BY best.k, p) GROUP BY k)"
            )
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    last = ROUNDS
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} ON c{last}.k = best.k"


QUERIES = {"op12_centroid_clustering": op12_centroid_clustering}
SQL = {"op12_centroid_clustering": _sql()}
