"""Centroid clustering against its SQL and a version in plain numbers."""

import hashlib
from math import floor, inf, isfinite, nan

from oracle import same

from tessella.llm import centroids

FOLDER = "/root/testdata/sf0.001"


def plainly(rows, k, rounds, size, scale, seed):
    kept = [(i, [floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and isfinite(x) and abs(scale * x) < centroids.LARGEST for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    means = [v for _, v in first[:k]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((distance(v, c), n) for n, c in enumerate(means))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        means = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else c for n, c in enumerate(means)]
    return sorted((i, near(v)[1], near(v)[0], hashlib.sha256(",".join(map(str, means[near(v)[1]])).encode()).hexdigest()) for i, v in kept)


def test_op12_rows(spark):
    same(spark, centroids.QUERIES["op12_centroid_clustering"], centroids.SQL["op12_centroid_clustering"], FOLDER)


def test_odd_vectors(spark):
    """Nulls, other lengths, numbers that are none, copies, repeated ids, and columns that clash."""
    good = [(i, [((i * 37 + j * 11) % 50 - 25) / 7.0 for j in range(4)]) for i in range(60)]
    copies = [(100 + i, [0.5, -0.5, 0.25, 1.0]) for i in range(30)] + [(5, [9.0, 9.0, 9.0, 9.0])]
    bad = [(200, None), (201, []), (202, [1.0] * 3), (203, [1.0] * 5), (204, [1.0, None, 1.0, 1.0]), (205, [nan, 1.0, 1.0, 1.0]), (206, [1.0, inf, 1.0, 1.0]), (207, [1e30, 1.0, 1.0, 1.0])]
    rows = good + copies + bad
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "vec_id long, embedding array<double>, Cluster string, inertia int").repartition(5)
    out, means = centroids.cluster(df, k=6, rounds=4, size=4)
    got = out.collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == plainly(rows, 6, 4, 4, centroids.SCALE, 3)
    assert {(r.Cluster_in, r.inertia_in) for r in got} == {("own", 1)} and len(means) == 6
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    assert all(r.cluster_inertia == sum(x.distance for x in got if x.cluster == r.cluster) for r in got)


def test_copies_among_the_first_centroids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(20)]
    out, means = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3, rounds=2, size=2)
    assert {(r.cluster, r.distance, r.inertia) for r in out.collect()} == {(0, 0, 0)} and means == [[1024, 2048]] * 3


def test_few_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (None, [5.0, 6.0]), (None, None)], "vec_id long, embedding array<double>")
    assert sorted(r.cluster for r in centroids.cluster(df, size=2)[0].collect()) == [0, 1, 2]
    none, means = centroids.cluster(df.limit(0), size=2)
    assert none.count() == 0 and means == [] and none.columns == ["vec_id", "embedding", *centroids.RESULTS]
    assert centroids.cluster(df, size=3)[0].count() == 0
