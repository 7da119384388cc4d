import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.evaluate import evaluate
from tessella.functions import text as X
from tessella.operators import catalog, evaluation, fusion, metrics, rerank, search
from tessella.sources import golden


def leg(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank long")


def test_shared_result_comes_first(spark):
    dense, sparse = leg(spark, [(1, 0, 0.9, 0), (1, 1, 0.8, 1)]), leg(spark, [(1, 0, 5.0, 0), (1, 2, 4.0, 1)])
    out = [r.doc_id for r in fusion.hybrid(dense, sparse, 10, use_minmax=False).orderBy("rank").collect()]
    assert out[0] == 0 and set(out) == {0, 1, 2}


def test_fused_halves_are_rounded_as_in_sql(spark):
    """0.3 * 41 / 192 = 0.0640625, whose product with 10^6 lies below the half; 0.3 * 141 / 320 the other way round."""
    sparse = leg(spark, [(q, d, float(s), 0) for q, low, s, high in ((1, 2508, 2549, 2700), (2, 828, 969, 1148)) for d, s in enumerate((low, s, high))])
    found = {r.query_id: r.score for r in fusion.fuse(sparse.limit(0), sparse).where("doc_id = 1").collect()}
    sql = "SELECT round(0.3::DOUBLE * (({s} - {low}::DOUBLE) / ({high} - {low}::DOUBLE)), 6)"
    want = {q: duckdb.sql(sql.format(s=s, low=low, high=high)).fetchall()[0][0] for q, low, s, high in ((1, 2508, 2549, 2700), (2, 828, 969, 1148))}
    assert found == want == {1: 0.064062, 2: 0.132188}


def test_a_block_gives_its_k_best_without_a_sort(spark):
    """Ties go to the smaller id, and scores of 0 and below are results of dense search."""
    corpus = spark.createDataFrame([(i, [float(-(i % 3)), 0.0]) for i in range(30)], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    out = search.dense_topk(asked, corpus, 12, distance="dot").orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in out] == [(i, 0.0) for i in range(0, 30, 3)] + [(1, -1.0), (4, -1.0)]


def test_weights_flip_the_order(spark):
    dense, sparse = leg(spark, [(1, 0, 0.9, 0)]), leg(spark, [(1, 2, 4.0, 0)])
    first = lambda w: fusion.hybrid(dense, sparse, 10, use_minmax=False, weights=w).where("rank = 0").first().doc_id
    assert (first((0.9, 0.1)), first((0.1, 0.9))) == (0, 2)
    assert fusion.normalised_weights(0, 0) == fusion.WEIGHTS and fusion.normalised_weights(1, 3) == (0.25, 0.75)


def test_top_k_cuts(spark):
    rows = [(1, i, 1.0 - i / 100, i) for i in range(20)]
    assert fusion.hybrid(leg(spark, rows), leg(spark, [(1, 100 + i, 1.0, i) for i in range(20)]), 5).count() == 5
    with pytest.raises(ValueError):
        search.check_top_k(0)


def test_diversity_keeps_the_first_and_has_a_floor(spark):
    rows = spark.createDataFrame([(1, i, 0.5, "g") for i in range(5)], "query_id long, doc_id long, score double, g string")
    out = sorted(r.score for r in fusion.diversify(rows, "g", 0.9, 0.5).collect())
    assert out == [0.25] * 4 + [0.5]
    alone = fusion.diversify(rows.withColumn("g", F.lit("")), "g", 0.9, 0.5)
    assert {r.score for r in alone.collect()} == {0.5}


def test_similar_results_go_in_order(spark):
    rows = [(1, 0, 3.0, 0, "alpha beta gamma delta"), (1, 1, 2.0, 1, "alpha beta gamma delta"), (1, 2, 1.0, 2, "other words here"), (1, 3, 1.0, 3, None)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank long, text string")
    assert [r.doc_id for r in fusion.drop_similar(df, threshold=0.7).orderBy("rank").collect()] == [0, 2, 3]


def test_visibility_without_metadata_keeps_all(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3)], "query_id long, collection string, doc_id long")
    meta = spark.createDataFrame([("a", 1)], "collection string, doc_id long")
    assert sorted((r.collection, r.doc_id) for r in fusion.visible(rows, meta).collect()) == [("a", 1), ("b", 2)]


def test_a_query_without_vector_falls_back(spark):
    corpus = spark.createDataFrame([(1, "red fox", [1.0, 0.0]), (2, "blue sky", [0.0, 1.0])], "doc_id long, text string, embedding array<float>")
    queries = spark.createDataFrame([(7, "sky", None), (8, "fox", [1.0, 0.1])], "query_id long, text string, embedding array<float>")
    out = {(r.query_id, r.doc_id): (r.actual_mode, r.warning) for r in fusion.retrieve(queries, corpus, "vector", 5).collect()}
    assert out == {(7, 2): ("bm25", "embedder_unavailable"), (8, 1): ("vector", None)}
    with pytest.raises(ValueError):
        fusion.retrieve(queries, corpus, "none")
    with pytest.raises(ValueError):
        search.equality_filter(corpus, {"must": [1]})


def test_chunks_of_one_document_are_results_of_their_own(spark):
    corpus = spark.createDataFrame([("a:1", i, t, [1.0, float(i)]) for i, t in enumerate(["red fox", "red hen", "grey owl"])] + [("b", 0, "red fox", [1.0, 0.0])], "doc_id string, chunk_index int, text string, embedding array<float>")
    queries = spark.createDataFrame([("q", "red fox", [1.0, 0.0])], "query_id string, text string, embedding array<float>")
    out = fusion.retrieve(queries, corpus, "hybrid", 5, "doc_id", key=("doc_id", "chunk_index"), payload=("text",)).orderBy("rank").collect()
    assert [(r.doc_id, r.chunk_index, r.text) for r in out][:2] == [("a:1", 0, "red fox"), ("b", 0, "red fox")]
    assert len({(r.doc_id, r.chunk_index) for r in out}) == len(out) == 4 and all(r.score <= 1 for r in out)
    with pytest.raises(ValueError):
        fusion.retrieve(queries, corpus, top_k=101)


def test_dense_search_without_a_broadcast(spark, monkeypatch):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("embedding"))
    queries = rows.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    found = lambda: sorted(search.dense_topk(queries, rows, 7).collect())
    first = found()
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    assert found() == first and len(first) == 70


def test_dense_with_zero_and_short_vectors(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, None)], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert {r.doc_id: r.score for r in search.dense_topk(queries, corpus, 5).collect()} == {2: 1.0, 1: 0.0}
    assert search.dense_topk(queries, corpus, 5, 0.3).count() == 1


def test_term_index_is_the_md5_prefix(spark):
    import hashlib

    word = "Größe"
    want = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % 2**31
    assert spark.range(1).select(X.term_index(F.lit(word)).alias("t")).first().t == want


def test_cjk_bigrams(spark):
    row = spark.range(1).select(X.compare_tokens(F.lit("数据 库 ab a 数据")).alias("t")).first()
    assert set(row.t) == {"数据", "据库", "库数", "ab"}


def test_metrics(spark):
    results = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "x", 0), (2, "y", 1)], "query_id long, key string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (1, "c"), (2, "y"), (3, "q")], "query_id long, key string")
    m = {r.query_id: r for r in evaluation.per_query(results, relevant, (1, 3)).collect()}
    assert (m[1].recall_1, m[1].recall_3, round(m[1].precision_3, 6), m[1].mrr) == (0.5, 1.0, round(2 / 3, 6), 1.0)
    assert (m[2].mrr, m[3].mrr, m[3].first_rank) == (0.5, 0.0, None)
    assert m[1].ndcg_3 == round((1 + 0.5) / (1 + 1 / math.log2(3)), 6)
    total = evaluation.averaged(evaluation.per_query(results, relevant, (1, 3))).first()
    assert (total.sample_count, total.hit_rate) == (3, round(2 / 3, 6))
    assert evaluation.long_form(evaluation.averaged(evaluation.per_query(results, relevant, (1, 3)))).count() == 6


def test_alias_by_stem(spark):
    row = spark.range(1).select(evaluation.aliases(F.lit("d"), F.lit("dir/page.tar.md"), F.lit(2)).alias("a")).first()
    assert set(row.a) == {"d#2", "dir/page.tar.md#2", "page.tar#2"}


def test_failure_stages(spark):
    rel = spark.createDataFrame([(i, "k") for i in range(4)], "query_id long, key string")
    hits = lambda *ids: spark.createDataFrame([(i, "k", 0) for i in ids] or [(99, "k", 0)], "query_id long, key string, rank int")
    out = evaluation.failure_stages(hits(0), {"dense": hits(0, 1, 2), "sparse": hits(), "hybrid": hits(0, 1)}, rel)
    assert [r.stage for r in out.orderBy("query_id").collect()] == ["hit", "ranking", "fusion", "retrieval_missing"]


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "q", i, t) for i, t in enumerate(["aa", "bb", "aa"])], "query_id long, query string, original_index long, text string")
    out = rerank.score_with(rows, lambda q, docs: [float(d == "bb") for d in docs], 2).orderBy("new_rank").collect()
    assert [r.original_index for r in out] == [1, 0]
    assert rerank.parse_scores('noise {"scores": [0.5, 1]} x', 3) == [0.5, 1.0, 0.0]
    assert rerank.parse_scores("nothing", 2) == rerank.parse_scores('{"scores": "x"}', 2) == [0.0, 0.0]
    assert rerank.keep_order(rows, 2).where("warning = 'reranker_degraded'").count() == 2
    assert "[0]" in rerank.prompt("q", ["d" * 500]) and len(rerank.prompt("q", ["d" * 500])) < 500


def test_catalog(spark):
    meta = spark.createDataFrame([(f"d{i:02d}", "c", "s", "x", 1, f"h{i}", None, i) for i in range(15)], "doc_id string, collection string, source string, category string, chunk_count int, content_hash string, extra string, ingested_at long")
    page = catalog.page(meta, 2, 10).collect()
    assert len(page) == 5 and page[0].total == 15 and page[0].doc_id == "d04"
    fresh = meta.where("doc_id = 'd00'").withColumn("content_hash", F.lit("new"))
    merged = catalog.upsert(meta, fresh)
    assert merged.count() == 15 and merged.where("content_hash = 'new'").count() == 1
    incoming = meta.where("doc_id < 'd02'").withColumn("content_hash", F.when(F.col("doc_id") == "d00", "h0").otherwise("z")).unionByName(fresh.withColumn("doc_id", F.lit("n")))
    actions = {r.doc_id: r.action for r in catalog.ingest_actions(incoming, meta).collect()}
    assert actions == {"d00": "noop", "d01": "updated", "n": "created"}
    notes = {r.doc_id: r.note for r in catalog.new_versions(catalog.ingest_actions(incoming, meta), F.lit("2026-01-01").cast("timestamp")).collect()}
    assert notes == {"d01": "updated from h1", "n": "initial"}
    ids = spark.createDataFrame([(" d01 ", 0), ("d01", 1), ("", 2), ("zz", 3)], "doc_id string, position int")
    points = spark.createDataFrame([("c", "d01"), ("c", "d01"), ("c", None), ("e", "d01")], "collection string, doc_id string")
    status = catalog.batch_delete(ids, meta, points, "c")
    assert sorted((r.doc_id, r.status, r.deleted_points) for r in status.collect()) == [("d01", "deleted", 2), ("zz", "not_found", 0)]
    assert catalog.delete_totals(status).first().failed == 1
    assert {(r.collection, r.orphan_points) for r in catalog.orphan_summary(points, meta).collect()} == {("c", 1), ("e", 1)}
    cat = catalog.create_collection(spark.createDataFrame([], "name string, vector_dim int, distance string"), "c1", 8, "cos")
    assert catalog.create_collection(cat, "c1", 9).first().vector_dim == 8 and catalog.collection_exists(cat, "c1")
    with pytest.raises(LookupError):
        catalog.collection_exists(catalog.drop_collection(cat, "c1"), "c1", required=True)


def test_upsert_of_equal_keys_is_the_same_every_time(spark):
    schema = "doc_id string, collection string, extra map<string,string>, n int"
    table = spark.createDataFrame([("a", "c", {"k": "0"}, 0), ("b", "c", None, 0)], schema)
    rows = spark.createDataFrame([("a", "c", {"k": str(i)}, i) for i in range(9)] + [("z", "c", None, None)], schema)
    found = [sorted((r.doc_id, r.n) for r in catalog.upsert(table, rows.repartition(k)).collect() if r.doc_id != "z") for k in (1, 7)]
    assert found[0] == found[1] == [("a", 8), ("b", 0)] and catalog.upsert(table, rows).count() == 3
    assert catalog.upsert(table.select("doc_id"), rows.select("doc_id"), ["doc_id"]).count() == 3


def test_rerank_by_provider(spark):
    rows = spark.createDataFrame([(str(q), "q", i, t) for q in (1, 2) for i, t in enumerate(["aa", "bb"])], "query_id string, query string, original_index long, text string")
    order = lambda df: [(r.query_id, r.text, r.warning) for r in df.orderBy("query_id", "new_rank").collect()]
    rerank.register("Last", lambda q, docs: [float(i) for i, _ in enumerate(docs)])
    rerank.register("broken", lambda q, docs: 1 / 0)
    assert order(rerank.rerank_by(rows, "last")) == [(q, t, None) for q in "12" for t in ("bb", "aa")]
    kept = [(q, t, "reranker_degraded") for q in "12" for t in ("aa", "bb")]
    assert order(rerank.rerank_by(rows, "broken")) == kept and order(rerank.rerank_by(rows, None)) == kept


def test_lexical_search_by_layout(spark):
    names = spark.createDataFrame([("new",), ("old",), ("odd",)], "collection string")
    held = spark.createDataFrame([("old", None, None), ("odd", ["text"], ["sparse"])], "collection string, vector_names array<string>, sparse_names array<string>")
    layout = catalog.vector_layout(names, held)
    assert {tuple(r) for r in layout.collect()} == {("new", "dense", True), ("old", None, False), ("odd", "text", True)}
    corpus = spark.createDataFrame([(c, i, t) for c in ("new", "old") for i, t in enumerate(["fox fox den", "sky"])], "collection string, doc_id long, text string")
    queries = spark.createDataFrame([("new", 7, "fox"), ("old", 7, "fox")], "collection string, query_id long, text string")
    out = {(r.collection, r.doc_id): (round(r.score, 4), r["rank"]) for r in search.lexical_topk(queries, corpus, 5, layout).collect()}
    assert out == {("new", 0): (2.0, 0), ("old", 0): (1.6667, 0)}


def test_a_single_delete_needs_its_document(spark):
    meta = spark.createDataFrame([("a", "c"), ("b", "c")], "doc_id string, collection string")
    left = catalog.delete_document(meta, meta, "a", "c")
    assert [[r.doc_id for r in t.collect()] for t in left] == [["b"], ["b"]]
    with pytest.raises(LookupError):
        catalog.delete_document(meta, meta, "a", "other")


def test_percentiles(spark):
    rows = [("a", float(v)) for v in range(1, 101)] + [("b", 7.0)] * 30 + [("c", float("nan")), ("c", None), (None, 1.0), ("d", 5.0)]
    out = {r[0]: tuple(r)[1:] for r in metrics.summary(spark.createDataFrame(rows, "name string, value double")).collect()}
    assert out == {"a": (100, 5050.0, 95.0), "b": (30, 210.0, 7.0), "d": (1, 5.0, 5.0)}


def test_evaluation_from_file_to_report(spark, tmp_path):
    corpus = [("d1", 0, "c", "a/fox.md", "red fox den", "x"), ("d2", 3, "c", "sky.md", "blue sky", "y"), ("d3", 0, "other", "z.md", "red fox", "x")]
    corpus = spark.createDataFrame(corpus, "doc_id string, chunk_index int, collection string, source string, text string, kind string").withColumn("embedding", search.hashed_embedding("text", 8))
    lines = ['{"query": "fox", "collection": "c", "relevant": ["fox#0"], "tags": ["t"]}', '{"query": "sky", "collection": "c", "relevant": ["d1#0"], "filters": {"kind": "y"}}', '{"query": "fox", "collection": "none", "relevant": ["d1#0"], "use_hyde": true}']
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    path, averages = evaluate(spark, str(tmp_path / "g.jsonl"), corpus, str(tmp_path / "r"), top_k=5, ks=(1, 3), stamp="20260101_000000")
    row = averages.first()
    assert (row.sample_count, row.recall_1, row.mrr, row.mode, row.top_k) == (3, 0.333333, 0.333333, "hybrid", 5)
    assert golden.latest_report(spark, str(tmp_path / "r")).first() == row and path.endswith("retrieval_eval_20260101_000000")
    samples = {(r.text, r.collection): r for r in spark.read.json(str(tmp_path / "r" / "samples_20260101_000000")).collect()}
    fox, sky, none = (samples[k] for k in (("fox", "c"), ("sky", "c"), ("fox", "none")))
    assert (fox.first_hit_rank, fox.failure_stage, fox.retrieved[0], "d3#0" in fox.retrieved) == (1, "hit", "fox#0", False)
    assert (sky.hit, sky.failure_stage, sky.retrieved) == (False, "retrieval_missing", ["d2#3"])
    assert (none.hit, none.retrieved, none.hybrid_count, none.warning) == (False, [], 0, "hyde_not_configured")
