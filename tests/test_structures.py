"""Sketched percentiles, the vector index, title paths of large documents and extracted tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import metrics, search
from tessella.operators.vector_index import OTHERS, VectorIndex, recall
from tessella.sources import layout_json, pages


def at_place(values, share):
    return sorted(values)[max(1, int(len(values) * share)) - 1]


@pytest.mark.parametrize("share", [0.5, 0.95, 0.999])
def test_percentiles_of_heavy_tails(spark, share):
    """Exact where one value is far from all others, where half are equal, and where there are few."""
    draw = random.Random(1)
    values = {"tail": [draw.paretovariate(0.3) for _ in range(30_000)], "ties": [float(draw.randint(0, 1) * draw.randint(0, 5)) for _ in range(20_000)], "far": [1e300, *(draw.random() for _ in range(15_000))], "few": [3.0, 1.0, 2.0], "one": [7.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("none", None), ("nan", float("nan")), (None, 1.0)], "name string, value double").repartition(6)
    out = {r.name: r for r in metrics.summary(df, share=share).collect()}
    assert {k: (r.n, r.percentile) for k, r in out.items()} == {k: (len(v), at_place(v, share)) for k, v in values.items()}


def test_a_bracket_that_misses_is_looked_at_again(spark, monkeypatch):
    monkeypatch.setattr(metrics, "FEW", 0)
    monkeypatch.setattr(metrics, "SKETCH", 8)
    monkeypatch.setattr(metrics, "MARGIN", -0.2)  # the bracket is empty
    df = spark.range(5000).select(F.lit("a").alias("name"), (F.col("id") * 7 % 5000).cast("double").alias("value"))
    assert [(r.n, r.percentile) for r in metrics.summary(df).collect()] == [(5000, 4749.0)]


def test_sketches_merge(spark):
    df = spark.range(20_000).select(F.lit("a").alias("name"), F.col("id").cast("double").alias("value"))
    days = metrics.sketches(df.where("value < 5000")).unionByName(metrics.sketches(df.where("value >= 5000")))
    row = metrics.estimated(metrics.merged(days)).first()
    assert (row.n, row.total) == (20_000, sum(range(20_000))) and abs(row.percentile - 19_000) < 100


def test_vector_index(spark, tmp_path):
    """Whole when all lists are looked into, and nearly so with a few; odd vectors are found too."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = rows.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    index = VectorIndex.build(rows, str(tmp_path / "i"), 32)
    exact = search.dense_topk(queries, rows, 10)
    assert sorted(map(tuple, index.topk(queries, 10, probes=32).collect())) == sorted(map(tuple, exact.collect()))
    assert 1 < index.probes < 32
    some = index.topk(queries, 10)
    assert recall(some, exact).agg(F.avg("recall")).first()[0] >= 0.9
    filed = spark.read.parquet(str(tmp_path / "i/blocks")).agg(F.sum(F.size("c_ids")), F.count_distinct("c_list")).first()
    assert filed[0] == rows.count() and filed[1] > 20
    strange = spark.createDataFrame([(-1, [0.0] * 64), (-2, [1.0, 2.0]), (-3, None), (-4, [float("inf")] + [0.0] * 63)], "doc_id long, embedding array<float>")
    index.add(strange)
    assert {i for r in spark.read.parquet(str(tmp_path / "i/blocks")).where(F.col("c_list") == OTHERS).collect() for i in r.c_ids} == {-1, -2, -4}
    asked = spark.createDataFrame([(1, [2.0, 4.0]), (2, [0.0] * 64)], "query_id long, embedding array<float>")
    found = index.topk(asked, 5000, probes=1).collect()
    assert [r.doc_id for r in found if r.query_id == 1] == [-2] and len([r for r in found if r.query_id == 2]) == 2002 - 0


def test_an_empty_index(spark, tmp_path):
    rows = spark.createDataFrame([], "doc_id long, embedding array<float>")
    index = VectorIndex.build(rows, str(tmp_path / "i"))
    index.add(spark.createDataFrame([(1, [1.0, 0.0])], rows.schema))
    assert [r.doc_id for r in index.topk(spark.createDataFrame([(5, [1.0, 1.0])], "query_id long, embedding array<float>"), 3).collect()] == [1]


def test_title_paths_of_a_large_document(spark):
    """100,000 titles, each below the last of the next smaller level that there was; levels of any size."""
    draw = random.Random(2)
    levels = [draw.choice([1, 2, 3, 3, 5, 2**31 - 1]) for _ in range(100_000)]
    flat = layout_json.blocks(spark.createDataFrame([("d", json.dumps([{"type": "title", "text_level": k, "content": f"t{i}"} for i, k in enumerate(levels)]))], "doc_id string, json string"))
    got = {r.item: r.anchor_path for r in layout_json.title_paths(flat).collect()}
    last = {}
    for i, k in enumerate(levels):
        last[k] = last.get(max((m for m in last if m < k), default=0), []) + [f"t{i}"]
        assert got[i] == last[k]


def test_extracted_tables(spark):
    rows = [("d", 0, 0, [["A", "b\nc"], ["1", None], ["2"]]), ("d", 1, 0, [["a ", "B C"], ["3", "4 "]]), ("d", 2, 0, []), ("d", 3, 0, None), ("d", 4, 0, [["x"], None]), ("d", 5, 0, [["h"]])]
    made = pages.tables_of(spark.createDataFrame(rows, "doc_id string, page int, place int, matrix array<array<string>>"))
    out = {r.page: r for r in made.collect()}
    assert (out[0].header, out[0].rows, len(out[0].cells)) == (["A", "b c"], [["1", ""], ["2"]], 5) and "| 2 |  |" in out[0].markdown and "<td></td>" in out[0].html
    assert [out[i].error for i in range(6)] == [None, None, "no rows", "no rows", "a row is missing", None] and out[5].rows == [] and out[2].markdown == ""
    united = pages.merge_tables(made.where("error IS NULL").select("doc_id", "page", "place", "header", "rows")).collect()
    assert sorted((r.page, r.parts, len(r.rows)) for r in united) == [(0, 2, 3), (5, 1, 0)]
