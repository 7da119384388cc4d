"""Registered queries of search, fusion and what follows them. Query rows are those whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import fusion, search, stored
from tessella.operators.vector_index import VectorIndex
from tessella.plans._tables import table

K = 10


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _vector_queries(spark, d):
    return _vectors(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


def _texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang")


def _text_queries(spark, d):
    return _texts(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")


def _out(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _out(search.dense_topk(_vector_queries(spark, d), _vectors(spark, d), K))


def dense_topk_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _out(search.dense_topk(_vector_queries(spark, d), _vectors(spark, d), K, 0.3))


def dense_topk_dot(spark: SparkSession, d: str) -> DataFrame:
    return _out(search.dense_topk(_vector_queries(spark, d), _vectors(spark, d), K, distance="dot"))


def dense_topk_euclid(spark: SparkSession, d: str) -> DataFrame:
    return _out(search.dense_topk(_vector_queries(spark, d), _vectors(spark, d), K, distance="euclid"))


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _out(search.dense_topk(_vector_queries(spark, d), search.equality_filter(_vectors(spark, d), {"must": {"label": 1}}), K))


def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The results of an index over all vectors, which looks into a part of its lists."""
    index = VectorIndex.build(_vectors(spark, d), stored.shared_folder(spark))
    return _out(index.topk(_vector_queries(spark, d), K))


def vector_index_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same with all lists looked into, which is exact."""
    index = VectorIndex.build(_vectors(spark, d), stored.shared_folder(spark), 32)
    return _out(index.topk(_vector_queries(spark, d), K, probes=32))


def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return _out(search.sparse_topk(_text_queries(spark, d), _texts(spark, d), K))


def sparse_fallback_topk(spark: SparkSession, d: str) -> DataFrame:
    return _out(search.fallback_topk(_text_queries(spark, d), _texts(spark, d), K))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _out(search.bm25_topk(_text_queries(spark, d), _texts(spark, d), K))


def _legs(spark, d):
    k = fusion.recall_k(K)
    return search.dense_topk(_vector_queries(spark, d), _vectors(spark, d), k, 0.3), search.sparse_topk(_text_queries(spark, d), _texts(spark, d), k)


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _out(fusion.hybrid(*_legs(spark, d), K, use_minmax=False))


def hybrid_minmax(spark: SparkSession, d: str) -> DataFrame:
    return _out(fusion.hybrid(*_legs(spark, d), K))


def hybrid_diversity(spark: SparkSession, d: str) -> DataFrame:
    return _out(fusion.hybrid(*_legs(spark, d), K, _texts(spark, d).select("doc_id", "source"), "source"))


def visibility(spark: SparkSession, d: str) -> DataFrame:
    found = search.sparse_topk(_text_queries(spark, d), _texts(spark, d), K).withColumn("collection", F.lit("main"))
    meta = table(spark, d, "labels").select("doc_id", F.lit("main").alias("collection"))
    return _out(fusion.visible(found, meta))


def result_dedup(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    found = search.sparse_topk(_text_queries(spark, d), texts, K).join(texts.select("doc_id", "text"), "doc_id")
    return _out(fusion.drop_similar(found, threshold=0.7))


def retrieve_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The whole flow: both legs, fusion, diversity, visibility, duplicate removal; queries without a vector fall back."""
    corpus = _texts(spark, d).join(_vectors(spark, d).select("doc_id", "embedding"), "doc_id", "left").withColumn("collection", F.lit("main"))
    queries = corpus.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text", "embedding")
    meta = table(spark, d, "labels").select("doc_id", F.lit("main").alias("collection"))
    out = fusion.retrieve(queries, corpus, "hybrid", K, "source", meta, 0.3, 0.85)
    return out.select("query_id", "doc_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"), "actual_mode", "warning")


def _lines(spark, d):
    line = F.posexplode(F.split("text", "\n")).alias("chunk_index", "text")
    return _texts(spark, d).select("doc_id", line).where(F.trim("text") != "")


def retrieve_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The whole flow over chunks, here the lines of whole documents, keyed by (doc_id, chunk_index); a chunk has its document's vector."""
    vectors = _vectors(spark, d).select("doc_id", "embedding")
    corpus = _lines(spark, d).join(vectors, "doc_id", "left").withColumn("collection", F.lit("main"))
    queries = _text_queries(spark, d).join(vectors.withColumnRenamed("doc_id", "query_id"), "query_id", "left")
    meta = table(spark, d, "labels").select("doc_id", F.lit("main").alias("collection"))
    out = fusion.retrieve(queries, corpus, "hybrid", K, "doc_id", meta, key=("doc_id", "chunk_index"), payload=("text",))
    return out.select("query_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"), F.md5("text").alias("text_md5"), "actual_mode", "warning")


def hyde_warning(spark: SparkSession, d: str) -> DataFrame:
    return fusion.hypothetical(_text_queries(spark, d)).select("query_id", F.length("text").cast("long").alias("chars"), "warning")


def hyde_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """A rewriter that fails for every third length of a text and else puts a word before the text."""
    out = fusion.hypothetical(_text_queries(spark, d), lambda t: F.when(F.length(t) % 3 != 0, F.concat(F.lit("passage "), t)))
    return out.select("query_id", F.md5("text").alias("text_md5"), "warning")


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in encoder over all conversation turns: the number of nonzero places and the squared length of each vector."""
    v = table(spark, d, "conversations").select("conv_id", "turn", search.hashed_embedding("text").alias("v"))
    return v.select("conv_id", "turn", F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("n_nonzero"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("squared"))


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_IDX = "(('0x' || substr(md5(t), 1, 8))::BIGINT % 2147483648)"
_POST = rf"""p AS MATERIALIZED (SELECT doc_id, {_IDX} AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS t FROM documents) GROUP BY ALL)"""
_TOP = "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s) WHERE rank < {k}"


def _dense(expr: str, where: str = "", k: int = K) -> str:
    return f"""WITH e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round({expr}, 6) AS score FROM e q, e c WHERE q.vec_id % 100 = 0 {where}) """ + _TOP.format(k=k)


_COS = "list_cosine_similarity(q.v, c.v)"
_SPARSE = f"SELECT q.doc_id AS query_id, p.doc_id, sum(q.tf * p.tf)::DOUBLE AS score FROM p JOIN p q USING (term) WHERE q.doc_id % 100 = 0 GROUP BY ALL"
_LEGS = f"""e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
dn AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round({_COS}, 6) AS score FROM e q, e c WHERE q.vec_id % 100 = 0 AND round({_COS}, 6) >= 0.3),
sp AS ({_SPARSE}),
legs AS (SELECT *, row_number() OVER (PARTITION BY leg, query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM (SELECT *, 0 AS leg FROM dn UNION ALL SELECT *, 1 AS leg FROM sp) QUALIFY rank < 20)"""
_MM = "CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
_FUSED = f"""f AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM (SELECT query_id, doc_id, CASE leg WHEN 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * {_MM} AS part FROM legs WINDOW w AS (PARTITION BY query_id, leg)) GROUP BY ALL)"""

#: Of the results t (query_id, doc_id, rank, score) in their order: u, with whether each stays beside those that stayed before it.
_KEPT = r"""n AS MATERIALIZED (SELECT query_id, t.doc_id, score, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{2,}}')) AS w FROM t JOIN documents d ON d.doc_id = t.doc_id),
u AS (SELECT query_id, doc_id, score, rank, i, true AS stays, [w] AS held FROM n WHERE i = 1 UNION ALL
 SELECT query_id, doc_id, score, rank, i, stays, CASE WHEN stays THEN list_append(held, w) ELSE held END FROM (SELECT n.*, u.held, len(list_filter(u.held, lambda x: len(x) > 0 AND len(w) > 0 AND len(list_intersect(x, w)) / (len(x) + len(w) - len(list_intersect(x, w)))::DOUBLE >= {least})) = 0 AS stays FROM u JOIN n ON n.query_id = u.query_id AND n.i = u.i + 1))"""

QUERIES = {f.__name__: f for f in (dense_topk, dense_topk_threshold, dense_topk_dot, dense_topk_euclid, dense_topk_filtered, vector_index_topk, vector_index_whole, sparse_topk, sparse_fallback_topk, bm25_topk, hybrid_rrf, hybrid_minmax, hybrid_diversity, visibility, result_dedup, retrieve_hybrid, retrieve_chunks, hyde_warning, hyde_rewritten, hashed_vectors)}
SQL = {
    "dense_topk": _dense(_COS),
    "vector_index_whole": _dense(_COS),
    "dense_topk_threshold": _dense(_COS, f"AND round({_COS}, 6) >= 0.3"),
    "dense_topk_dot": _dense("list_inner_product(q.v, c.v)"),
    "dense_topk_euclid": _dense("-list_distance(q.v, c.v)"),
    "dense_topk_filtered": _dense(_COS, "AND c.label = 1"),
    "sparse_topk": f"WITH {_POST}, s AS ({_SPARSE}) " + _TOP.format(k=K),
    "sparse_fallback_topk": rf"""WITH c AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS t FROM documents) GROUP BY doc_id, t),
p AS MATERIALIZED (SELECT *, sum(tf) OVER (PARTITION BY doc_id) AS n FROM c),
s AS (SELECT q.doc_id AS query_id, p.doc_id, round(sum(q.tf * (1 + p.tf / p.n::DOUBLE)), 6) AS score FROM p JOIN p q USING (t) WHERE q.doc_id % 100 = 0 GROUP BY ALL) """ + _TOP.format(k=K),
    "bm25_topk": f"""WITH {_POST}, l AS (SELECT doc_id, sum(tf) AS n FROM p GROUP BY doc_id), st AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean FROM l),
df AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term),
s AS (SELECT q.doc_id AS query_id, p.doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * q.tf * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.n / mean))), 6) AS score
 FROM p JOIN p q USING (term) JOIN df USING (term) JOIN l ON l.doc_id = p.doc_id, st WHERE q.doc_id % 100 = 0 GROUP BY ALL) """ + _TOP.format(k=K),
    "hybrid_rrf": f"""WITH {_POST}, {_LEGS}, s AS (SELECT query_id, doc_id, round(sum(CASE leg WHEN 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END / (60 + rank + 1)), 6) AS score FROM legs GROUP BY ALL) """ + _TOP.format(k=K),
    "hybrid_minmax": f"WITH {_POST}, {_LEGS}, {_FUSED}, s AS (SELECT * FROM f) " + _TOP.format(k=K),
    "hybrid_diversity": f"""WITH {_POST}, {_LEGS}, {_FUSED}, s AS (SELECT query_id, doc_id, round(score * CASE WHEN coalesce(source, '') = '' THEN 1.0::DOUBLE ELSE greatest(0.5::DOUBLE, 1 - 0.1::DOUBLE * (n - 1)) END + 1e-10::DOUBLE, 6) AS score
 FROM (SELECT f.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, f.doc_id) AS n FROM f LEFT JOIN documents USING (doc_id))) """ + _TOP.format(k=K),
    "visibility": f"WITH {_POST}, s AS ({_SPARSE}), r AS ({_TOP.format(k=K)}) SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM labels) OR doc_id IN (SELECT doc_id FROM labels)",
    "retrieve_chunks": rf"""WITH c AS MATERIALIZED (SELECT * FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM documents) WHERE trim(text, ' ') <> ''),
t AS MATERIALIZED (SELECT doc_id, chunk_index, {_IDX} AS term, count(*) AS tf FROM (SELECT doc_id, chunk_index, unnest({_TOK}) AS t FROM c) GROUP BY ALL),
qt AS MATERIALIZED (SELECT query_id, {_IDX} AS term, count(*) AS tf FROM (SELECT doc_id AS query_id, unnest({_TOK}) AS t FROM documents WHERE doc_id % 100 = 0) GROUP BY ALL),
e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
dn AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id, round({_COS.replace('c.v', 'x.v')}, 6) AS score FROM e q, e x WHERE q.vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 100 = 0) AND round({_COS.replace('c.v', 'x.v')}, 6) >= 0.3),
sp AS (SELECT query_id, doc_id, chunk_index, sum(qt.tf * t.tf)::DOUBLE AS score FROM t JOIN qt USING (term) GROUP BY ALL),
legs AS (SELECT *, row_number() OVER (PARTITION BY leg, query_id ORDER BY score DESC, doc_id, chunk_index) - 1 AS rank FROM (SELECT query_id, doc_id, chunk_index, score, 0 AS leg FROM dn JOIN c USING (doc_id) UNION ALL SELECT query_id, doc_id, chunk_index, score, 1 AS leg FROM sp) QUALIFY rank < 20),
f AS (SELECT query_id, doc_id, chunk_index, round(sum(part), 6) AS score FROM (SELECT query_id, doc_id, chunk_index, CASE leg WHEN 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * {_MM} AS part FROM legs WINDOW w AS (PARTITION BY query_id, leg)) GROUP BY ALL),
g AS (SELECT query_id, doc_id, chunk_index, round(score * greatest(0.5::DOUBLE, 1 - 0.1::DOUBLE * (row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_index) - 1)) + 1e-10::DOUBLE, 6) AS score FROM f),
s AS (SELECT *, 'hybrid' AS actual_mode, CAST(NULL AS VARCHAR) AS warning FROM g WHERE query_id IN (SELECT vec_id FROM e) UNION ALL SELECT *, 'bm25', 'embedder_unavailable' FROM (SELECT query_id, doc_id, chunk_index, score FROM legs WHERE leg = 1) WHERE query_id NOT IN (SELECT vec_id FROM e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) - 1 AS rank FROM s QUALIFY rank < {K})
SELECT r.query_id, r.doc_id, r.chunk_index, r.score, r.rank, md5(c.text) AS text_md5, actual_mode, warning FROM r JOIN c USING (doc_id, chunk_index) WHERE NOT EXISTS (SELECT 1 FROM labels) OR r.doc_id IN (SELECT doc_id FROM labels)""",
    "hyde_warning": "SELECT doc_id AS query_id, length(text) AS chars, 'hyde_not_configured' AS warning FROM documents WHERE doc_id % 100 = 0",
    "hyde_rewritten": "SELECT doc_id AS query_id, md5(CASE WHEN length(text) % 3 <> 0 THEN 'passage ' || text ELSE text END) AS text_md5, CASE WHEN length(text) % 3 <> 0 THEN NULL ELSE 'hyde_failed' END AS warning FROM documents WHERE doc_id % 100 = 0",
    "result_dedup": f"WITH RECURSIVE {_POST}, s AS ({_SPARSE}), t AS MATERIALIZED ({_TOP.format(k=K)}), {_KEPT.format(least=0.7)} SELECT query_id, doc_id, score, rank FROM u JOIN t USING (query_id, doc_id, score, rank) WHERE stays",
    "retrieve_hybrid": f"""WITH RECURSIVE {_POST}, e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
dn AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round({_COS}, 6) AS score FROM e q, e c WHERE q.vec_id % 100 = 0 AND round({_COS}, 6) >= 0.3),
sp AS ({_SPARSE}),
legs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY leg, query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM (SELECT *, 0 AS leg FROM dn UNION ALL SELECT *, 1 AS leg FROM sp) QUALIFY rank < 20), {_FUSED},
g AS (SELECT query_id, doc_id, round(score * CASE WHEN coalesce(source, '') = '' THEN 1.0::DOUBLE ELSE greatest(0.5::DOUBLE, 1 - 0.1::DOUBLE * (n - 1)) END + 1e-10::DOUBLE, 6) AS score
 FROM (SELECT f.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, f.doc_id) AS n FROM f LEFT JOIN documents USING (doc_id))),
s AS (SELECT * FROM g WHERE query_id IN (SELECT vec_id FROM e) UNION ALL SELECT query_id, doc_id, score FROM legs WHERE leg = 1 AND query_id NOT IN (SELECT vec_id FROM e)),
r AS ({_TOP.format(k=K)}),
t AS MATERIALIZED (SELECT query_id, doc_id, score, rank FROM r WHERE NOT EXISTS (SELECT 1 FROM labels) OR doc_id IN (SELECT doc_id FROM labels)), {_KEPT.format(least=0.85)}
SELECT query_id, doc_id, score, rank, CASE WHEN query_id IN (SELECT vec_id FROM e) THEN 'hybrid' ELSE 'bm25' END AS actual_mode, CASE WHEN query_id IN (SELECT vec_id FROM e) THEN NULL ELSE 'embedder_unavailable' END AS warning
FROM u JOIN t USING (query_id, doc_id, score, rank) WHERE stays""",
    "hashed_vectors": rf"""WITH h AS (SELECT conv_id, turn, {_IDX} AS h FROM (SELECT conv_id, turn, unnest({_TOK}) AS t FROM conversations)),
v AS (SELECT conv_id, turn, h % 64 AS d, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM h GROUP BY ALL)
SELECT c.conv_id, c.turn, count(*) FILTER (x <> 0) AS n_nonzero, coalesce(sum(x * x), 0)::DOUBLE AS squared FROM conversations c LEFT JOIN v ON v.conv_id = c.conv_id AND v.turn = c.turn GROUP BY ALL""",
}
