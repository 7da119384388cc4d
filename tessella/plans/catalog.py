"""Registered queries of ingest actions, metadata, versions and maintenance, over documents and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import catalog, chunking, metrics, search, stored
from tessella.operators.point_store import PointStore, page_after, pages
from tessella.plans._tables import table
from tessella.plans.parsing import _CHUNKS
from tessella.plans.retrieval import _IDX, _TOK


def _incoming(spark, d):
    """All documents as they come in: the collection is the language."""
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("collection"), "source", X.content_hash("text").alias("content_hash"), F.lit(1).alias("chunk_count"))


def _meta(spark, d):
    """Metadata of the labelled documents; those of quality 0 have another hash than what comes in."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    old = _incoming(spark, d).join(labels, "doc_id").withColumn("content_hash", F.when(F.col("quality") == 1, F.col("content_hash")).otherwise(F.md5("content_hash")))
    return old.select("doc_id", "collection", "source", "content_hash", "chunk_count")


def ingest_action(spark: SparkSession, d: str) -> DataFrame:
    return catalog.ingest_actions(_incoming(spark, d), _meta(spark, d)).select("doc_id", "collection", "action", "previous_hash")


def ingest_totals(spark: SparkSession, d: str) -> DataFrame:
    return catalog.ingest_actions(_incoming(spark, d), _meta(spark, d)).groupBy("collection", "action").agg(F.count("*").alias("n"))


def meta_upsert(spark: SparkSession, d: str) -> DataFrame:
    meta = _meta(spark, d)
    changed = catalog.ingest_actions(_incoming(spark, d), meta).where("action <> 'noop'")
    return catalog.upsert(meta, changed.select(meta.columns)).select("doc_id", "collection", "content_hash")


def version_append(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.new_versions(catalog.ingest_actions(_incoming(spark, d), _meta(spark, d)), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return out.select("doc_id", "collection", "content_hash", "note")


def _versions(spark, d):
    """Every turn of a conversation as a version of it."""
    c = table(spark, d, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("version_id"), F.col("conv_id").alias("doc_id"), F.lit("chat").alias("collection"), X.content_hash("text").alias("content_hash"), F.col("turn").alias("created_at"), "role")


def version_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.version_summary(_versions(spark, d))


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return catalog.latest_versions(_versions(spark, d)).select("doc_id", "version_id", "content_hash")


def version_list(spark: SparkSession, d: str) -> DataFrame:
    """All versions, each with its place from the newest of its document."""
    return catalog.placed_versions(_versions(spark, d)).select("doc_id", "version_id", F.col("place").cast("long").alias("place"))


def _points(spark, d):
    return table(spark, d, "documents").select(F.col("lang").alias("collection"), "doc_id", F.lit(0).alias("chunk_index"))


def orphan_prune(spark: SparkSession, d: str) -> DataFrame:
    return catalog.orphans(_points(spark, d), _meta(spark, d)).select("collection", "doc_id")


def orphan_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.orphan_summary(_points(spark, d), _meta(spark, d))


def batch_delete(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "labels").select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("doc_id"), F.col("doc_id").alias("position"))
    ids = ids.unionAll(ids.withColumn("position", F.col("position") + 1)).unionAll(ids.selectExpr("'x' as doc_id", "0L as position"))
    return catalog.batch_delete(ids, _meta(spark, d), _points(spark, d), "en")


def batch_delete_totals(spark: SparkSession, d: str) -> DataFrame:
    return catalog.delete_totals(batch_delete(spark, d))


def delete_rows(spark: SparkSession, d: str) -> DataFrame:
    gone = _meta(spark, d).where("collection = 'fr'")
    return catalog.delete_documents(_points(spark, d), gone).groupBy("collection").agg(F.count("*").alias("points"))


def collection_list(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "embeddings").select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("collection"), "embedding")
    return catalog.preferred_first(catalog.collection_list(points).withColumn("dim", F.col("dim").cast("long")), "label3", "collection").withColumn("position", F.col("position").cast("long"))


def doc_page(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("ingested_at"), "source")
    return catalog.page(meta, 2, 20)


def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    """Count, sum and p95 of the events' values by type, p95 as the value at place max(1, 95 % of n, rounded down)."""
    return metrics.summary(table(spark, d, "events"), "event_type").select("event_type", "n", F.round("total", 3).alias("total"), F.col("percentile").alias("p95"))


def vector_layouts(spark: SparkSession, d: str) -> DataFrame:
    """How the vectors of each document's collection are laid out, where every label is one; some are of older kinds or unknown."""
    labels = table(spark, d, "embeddings").select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("collection"), "label").distinct()
    kind = F.col("label") % 4
    vectors = F.when(kind == 0, F.array(F.lit("dense"), F.lit("title"))).when(kind == 1, F.array(F.lit("text")))
    held = labels.where(kind != 3).select("collection", vectors.alias("vector_names"), F.when(kind == 0, F.array(F.lit("sparse"))).alias("sparse_names"))
    named = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("label"), F.col("label").cast("string")).alias("collection"))
    return catalog.vector_layout(named, held)


def _stored(spark, d):
    """A store after two batches, of which the second is sent twice, and a delete. The first has other texts of the documents of quality 0; toxic ones are deleted."""
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").join(labels.select("doc_id", "quality"), "doc_id", "left").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("lang", F.lit("none")).alias("collection"), "source", "text", "quality")
    old = docs.withColumn("text", F.when(F.col("quality") == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text")))
    store = PointStore(spark, stored.shared_folder(spark), 16)
    chunked = lambda work: chunking.fixed_windows(work).join(work.select("doc_id", "collection", "source"), "doc_id")
    embed = lambda chunks: chunks.withColumn("embedding", search.hashed_embedding("content", 8))
    for number, rows in enumerate((old, docs, docs)):
        store.ingest(rows.withColumn("content_hash", X.content_hash("text")), chunked, embed, F.timestamp_seconds(F.lit(number)), min(number, 1))
        store.vacuum()  # nobody reads older rows
    toxic = docs.join(labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_semi")
    store.remove(toxic.select("collection", "doc_id"))
    store.vacuum()
    return store


def point_store(spark: SparkSession, d: str) -> DataFrame:
    """The current points of the store, each with what its vectors and payload hold."""
    store = _stored(spark, d)
    action = store.meta().select("collection", "doc_id", "action")
    terms = F.aggregate("sparse.values", F.lit(0.0), lambda a, x: a + x).cast("long")
    return store.points().join(action, ["collection", "doc_id"]).select("collection", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.size("sparse.indices").cast("long").alias("n_terms"), terms.alias("n_tokens"), F.element_at("sparse.indices", 1).alias("first_term"), F.size("embedding").cast("long").alias("dim"), F.md5(F.col("payload")["content"]).alias("content_md5"), F.col("payload")["source"].alias("source"), "action")


def point_scroll(spark: SparkSession, d: str) -> DataFrame:
    """All documents page by page with a cursor of (collection, doc_id): pages of 10,000 rows, put together again, each with its page."""
    rows = table(spark, d, "documents").select(F.col("lang").alias("collection"), "doc_id")
    cursors = [(i, after) for i, (_, after) in enumerate(pages(rows, ["collection", "doc_id"], 10_000))]
    parts = [page_after(rows, ["collection", "doc_id"], cursors[i - 1][1] if i else None, 10_000).withColumn("page", F.lit(i).cast("long")) for i, _ in cursors]
    return reduce(DataFrame.unionByName, parts) if parts else rows.withColumn("page", F.lit(0).cast("long"))


_IN = "inc AS (SELECT doc_id, lang AS collection, source, md5(text) AS content_hash FROM documents)"
_META = _IN + ", meta AS (SELECT doc_id, collection, source, CASE quality WHEN 1 THEN content_hash ELSE md5(content_hash) END AS content_hash FROM inc JOIN labels USING (doc_id))"
_ACT = _META + ", act AS (SELECT inc.*, m.content_hash AS previous_hash, CASE WHEN m.content_hash IS NULL THEN 'created' WHEN m.content_hash = inc.content_hash THEN 'noop' ELSE 'updated' END AS action FROM inc LEFT JOIN meta m USING (doc_id, collection))"
_VER = "v AS (SELECT conv_id || '-' || turn AS version_id, conv_id AS doc_id, 'chat' AS collection, md5(text) AS content_hash, turn AS created_at FROM conversations)"
_DEL = _META + ", ids AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, min(doc_id) AS position FROM labels GROUP BY doc_id UNION ALL SELECT 'x', 0 FROM (SELECT count(*) AS c FROM labels) WHERE c > 0), st AS (SELECT doc_id, position, CASE WHEN m.k IS NOT NULL THEN 'deleted' ELSE 'not_found' END AS status, CASE WHEN m.k IS NOT NULL THEN coalesce(p.n, 0) ELSE 0 END AS deleted_points FROM ids LEFT JOIN (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc_id, 1 AS k FROM meta WHERE collection = 'en') m USING (doc_id) LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1) p USING (doc_id))"

QUERIES = {f.__name__: f for f in (ingest_action, ingest_totals, meta_upsert, version_append, version_summary, latest_version, version_list, orphan_prune, orphan_summary, batch_delete, batch_delete_totals, delete_rows, collection_list, doc_page, latency_p95, vector_layouts, point_store, point_scroll)}
SQL = {
    "ingest_action": f"WITH {_ACT} SELECT doc_id, collection, action, previous_hash FROM act",
    "ingest_totals": f"WITH {_ACT} SELECT collection, action, count(*) AS n FROM act GROUP BY ALL",
    "meta_upsert": f"WITH {_ACT}, new AS (SELECT * FROM act WHERE action <> 'noop') SELECT doc_id, collection, content_hash FROM new UNION ALL SELECT doc_id, collection, content_hash FROM meta ANTI JOIN new USING (doc_id, collection)",
    "version_append": f"WITH {_ACT} SELECT doc_id, collection, content_hash, CASE WHEN previous_hash IS NULL THEN 'initial' ELSE 'updated from ' || substr(previous_hash, 1, 8) END AS note FROM act WHERE action <> 'noop'",
    "version_summary": f"WITH {_VER} SELECT doc_id, collection, count(*) AS version_count, arg_max(content_hash, created_at) AS current_hash, arg_min(content_hash, created_at) AS first_hash, max(created_at) AS last_updated_at FROM v GROUP BY ALL",
    "latest_version": f"WITH {_VER} SELECT doc_id, version_id, content_hash FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, version_id DESC) = 1",
    "version_list": f"WITH {_VER} SELECT doc_id, version_id, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, version_id) AS place FROM v",
    "orphan_prune": f"WITH {_META} SELECT lang AS collection, doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM meta m WHERE m.doc_id = d.doc_id AND m.collection = d.lang)",
    "orphan_summary": f"WITH {_META} SELECT lang AS collection, count(*) AS points, count(*) FILTER (m.doc_id IS NULL) AS orphan_points, count(DISTINCT CASE WHEN m.doc_id IS NULL THEN d.doc_id END) AS orphan_documents FROM documents d LEFT JOIN meta m ON m.doc_id = d.doc_id AND m.collection = d.lang GROUP BY lang",
    "batch_delete": f"WITH {_DEL} SELECT doc_id, position, status, CAST(deleted_points AS BIGINT) AS deleted_points FROM st",
    "batch_delete_totals": f"WITH {_DEL} SELECT count(*) AS requested, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status <> 'deleted') AS failed, CAST(coalesce(sum(deleted_points), 0) AS BIGINT) AS deleted_points FROM st",
    "delete_rows": "SELECT lang AS collection, count(*) AS points FROM documents d WHERE NOT (lang = 'fr' AND doc_id IN (SELECT doc_id FROM labels)) GROUP BY lang",
    "collection_list": "SELECT *, row_number() OVER (ORDER BY collection <> 'label3', collection) - 1 AS position FROM (SELECT 'label' || label AS collection, count(*) AS points_count, count(embedding) AS vectors_count, max(len(embedding)) AS dim FROM embeddings GROUP BY label)",
    "vector_layouts": "SELECT vec_id, 'label' || label AS collection, CASE label % 4 WHEN 1 THEN 'text' WHEN 2 THEN NULL ELSE 'dense' END AS dense_name, label % 4 IN (0, 3) AS has_sparse FROM embeddings",
    "point_store": f"""WITH {_CHUNKS} SELECT coalesce(lang, 'none') AS collection, CAST(w.doc_id AS VARCHAR) AS doc_id, w.i AS chunk_index, CAST(len(list_distinct(x)) AS BIGINT) AS n_terms, CAST(len(x) AS BIGINT) AS n_tokens, list_min(x) AS first_term, CAST(8 AS BIGINT) AS dim, md5(content) AS content_md5, source, CASE WHEN quality = 0 THEN 'updated' ELSE 'created' END AS action
FROM (SELECT *, list_transform({_TOK.replace('text', 'content')}, lambda t: {_IDX}) AS x FROM w WHERE content <> '') w JOIN documents d USING (doc_id) LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) <> 1""",
    "point_scroll": "SELECT lang AS collection, doc_id, (row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST) - 1) // 10000 AS page FROM documents",
    "doc_page": "SELECT doc_id, n_chars AS ingested_at, source, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20",
    "latency_p95": "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, list_sort(list(value))[greatest(1, CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT))] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type",
}
