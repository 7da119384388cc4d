"""Collections, document metadata, versions and their maintenance, as transformations of tables.

Tables: documents_meta (doc_id, collection, source, category, chunk_count, content_hash, extra, ingested_at),
versions (version_id, doc_id, collection, content_hash, chunk_count, created_at, note), points (collection, doc_id,
chunk_index, ...). Nothing is changed in place: each function gives the new table, which the caller writes elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "collection"]
META_COLUMNS = ["doc_id", "collection", "source", "category", "chunk_count", "content_hash", "extra", "ingested_at"]


def ingest_actions(incoming: DataFrame, meta: DataFrame) -> DataFrame:
    """incoming (doc_id, collection, content_hash, ...) with previous_hash and action: noop, updated or created."""
    old = meta.select(*KEY, F.col("content_hash").alias("previous_hash"))
    action = F.when(F.col("previous_hash").isNull(), "created").when(F.col("previous_hash") == F.col("content_hash"), "noop").otherwise("updated")
    return incoming.join(old, KEY, "left").withColumn("action", action)


def upsert(table: DataFrame, rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """rows replace those of the same key and are added otherwise; of rows that share a key the one that is greatest as JSON is taken, so a rerun gives the same."""
    rest = F.struct(*[c for c in rows.columns if c not in key])
    one = rows.groupBy(*key).agg(F.max_by(rest, F.to_json(rest)).alias("_r")).select(*key, "_r.*") if len(rows.columns) > len(key) else rows.distinct()
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(one.select(rows.columns))


def version_note(note, previous_hash):
    """A given note, else what the version came from."""
    return F.coalesce(note, F.when(previous_hash.isNotNull() & (previous_hash != ""), F.concat(F.lit("updated from "), F.substring(previous_hash, 1, 8))), F.lit("initial"))


def new_versions(actions: DataFrame, at) -> DataFrame:
    """A version row for each document that was created or updated. The id is derived from what the row says, so a retry gives the same."""
    rows = actions.where("action <> 'noop'").withColumn("created_at", at)
    given = F.col("note") if "note" in actions.columns else F.lit(None).cast("string")
    version_id = F.substring(F.md5(F.concat_ws("|", "collection", "doc_id", "content_hash", F.col("created_at").cast("string"))), 1, 12)
    return rows.select(version_id.alias("version_id"), "doc_id", "collection", "content_hash", "chunk_count", "created_at", version_note(given, F.col("previous_hash")).alias("note"))


def replace_points(points: DataFrame, fresh: DataFrame) -> DataFrame:
    """The points of documents that fresh has go, and fresh comes in."""
    return points.join(fresh.select("collection", "doc_id").distinct(), ["collection", "doc_id"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def document(meta: DataFrame, doc_id, collection) -> DataFrame:
    return meta.where((F.col("doc_id") == F.lit(doc_id)) & (F.col("collection") == F.lit(collection)))


def page(meta: DataFrame, number: int, size: int, order: str = "ingested_at", tie: str = "doc_id") -> DataFrame:
    """Rows of one page, newest first, each with the total. The page is a limit with an offset, not a sort of all to one task."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages count from 1 and have 1 to 100 rows")
    total = meta.agg(F.count("*").alias("total"))
    return meta.orderBy(F.desc(order), tie).offset((number - 1) * size).limit(size).join(F.broadcast(total))  # one row


def placed_versions(versions: DataFrame) -> DataFrame:
    """versions with `place`, from 1 for the newest of each document."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("created_at"), "version_id")
    return versions.withColumn("place", F.row_number().over(w))


def list_versions(versions: DataFrame, doc_id, collection) -> DataFrame:
    return document(versions, doc_id, collection).orderBy(F.desc("created_at"), "version_id")


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each document."""
    return versions.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in versions.columns if c not in KEY]), F.struct("created_at", "version_id")).alias("v")).select(*KEY, "v.*")


def version_summary(versions: DataFrame) -> DataFrame:
    """Per document: how many versions, the first and the current hash, and when it was last updated."""
    at = F.struct("created_at", "version_id")
    return versions.groupBy(*KEY).agg(F.count("*").alias("version_count"), F.max_by("content_hash", at).alias("current_hash"), F.min_by("content_hash", at).alias("first_hash"), F.max("created_at").alias("last_updated_at"))


def ordered_distinct(ids: DataFrame, column: str = "doc_id", order: str = "position") -> DataFrame:
    """Stripped, without empty ones, the first of each, in the order of first occurrence."""
    clean = ids.select(F.trim(F.col(column).cast("string")).alias(column), order).where(F.col(column) != "")
    return clean.groupBy(column).agg(F.min(order).alias(order))


def batch_delete(ids: DataFrame, meta: DataFrame, points: DataFrame, collection: str) -> DataFrame:
    """doc_id, position, status (deleted or not_found), deleted_points for each distinct id asked for."""
    asked = ordered_distinct(ids)
    known = meta.where(F.col("collection") == collection).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(True).alias("_known")).distinct()
    counts = points.where(F.col("collection") == collection).groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.count("*").alias("_n"))
    out = asked.join(known, "doc_id", "left").join(counts, "doc_id", "left")
    return out.select("doc_id", "position", F.when(F.col("_known"), "deleted").otherwise("not_found").alias("status"), F.when(F.col("_known"), F.coalesce("_n", F.lit(0))).otherwise(0).cast("long").alias("deleted_points"))


def delete_totals(status: DataFrame) -> DataFrame:
    """Totals of a batch; what was not found counts as failed."""
    return status.agg(F.count("*").alias("requested"), F.count_if(F.col("status") == "deleted").alias("deleted"), F.count_if(F.col("status") != "deleted").alias("failed"), F.coalesce(F.sum("deleted_points"), F.lit(0)).alias("deleted_points"))


def delete_documents(table: DataFrame, gone: DataFrame) -> DataFrame:
    """table (metadata or points) without the rows of (collection, doc_id) in gone. Versions are kept by not calling it for them."""
    return table.join(gone.select("collection", "doc_id").distinct(), ["collection", "doc_id"], "left_anti")


def orphans(points: DataFrame, meta: DataFrame) -> DataFrame:
    """Points without metadata of their collection; those without doc_id too, and all where there is no metadata."""
    return points.join(meta.select("collection", "doc_id").distinct(), ["collection", "doc_id"], "left_anti")


def orphan_summary(points: DataFrame, meta: DataFrame) -> DataFrame:
    """Per collection: points, orphaned points and orphaned documents; a missing doc_id counts as one document."""
    lost = orphans(points, meta).groupBy("collection").agg(F.count("*").alias("orphan_points"), F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("<missing>"))).alias("orphan_documents"))
    every = points.groupBy("collection").agg(F.count("*").alias("points"))
    return every.join(lost, "collection", "left").select("collection", "points", F.coalesce("orphan_points", F.lit(0)).alias("orphan_points"), F.coalesce("orphan_documents", F.lit(0)).alias("orphan_documents"))


def delete_document(meta: DataFrame, points: DataFrame, doc_id, collection: str) -> tuple[DataFrame, DataFrame]:
    """The new metadata and points without one document; one that metadata does not have is an error."""
    one = document(meta, doc_id, collection).select("collection", "doc_id")
    if one.isEmpty():
        raise LookupError(f"document not found: {doc_id} in {collection}")
    return delete_documents(meta, one), delete_documents(points, one)


#: Names of the vectors of a collection made today.
DENSE, SPARSE = "dense", "sparse"


def vector_layout(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """names (collection) with dense_name and has_sparse, by catalog (collection, vector_names, sparse_names: arrays).

    A collection that the catalog lacks is laid out as today. vector_names is null where the only vector bears no name,
    and so is dense_name then; else it is the vector of today's name, or the only one there is.
    """
    rows = names.join(catalog.select("collection", "vector_names", "sparse_names", F.lit(True).alias("_known")), "collection", "left")
    old = F.when(F.col("vector_names").isNull(), None).when(F.array_contains("vector_names", DENSE) | (F.size("vector_names") != 1), DENSE).otherwise(F.get("vector_names", F.lit(0)))
    return rows.select(*names.columns, F.when(F.col("_known"), old).otherwise(DENSE).alias("dense_name"), F.when(F.col("_known"), F.coalesce(F.array_contains("sparse_names", SPARSE), F.lit(False))).otherwise(True).alias("has_sparse"))


def create_collection(catalog: DataFrame, name: str, dim: int = 3072, distance: str = "Cosine", overwrite: bool = False) -> DataFrame:
    """catalog (name, vector_dim, distance) with the collection; an existing one stays unless it is to be overwritten."""
    kinds = {"COSINE": "Cosine", "COS": "Cosine", "DOT": "Dot", "EUCLID": "Euclid", "MANHATTAN": "Manhattan"}
    if distance.upper() not in kinds:
        raise ValueError(f"unknown distance: {distance}")
    row = catalog.sparkSession.createDataFrame([(name, dim, kinds[distance.upper()])], catalog.schema)
    return upsert(catalog, row, ["name"]) if overwrite else catalog.unionByName(row.join(catalog.select("name"), "name", "left_anti").select(catalog.columns))


def drop_collection(catalog: DataFrame, name: str) -> DataFrame:
    return catalog.where(F.col("name") != name)


def collection_exists(catalog: DataFrame, name: str, required: bool = False) -> bool:
    """Whether the catalog has the collection; an error instead of False where it is required."""
    found = not catalog.where(F.col("name") == name).isEmpty()
    if required and not found:
        raise LookupError(f"collection not found: {name}")
    return found


def collection_list(points: DataFrame, vector: str = "embedding") -> DataFrame:
    """Per collection: points, vectors and their dimension."""
    return points.groupBy("collection").agg(F.count("*").alias("points_count"), F.count(vector).alias("vectors_count"), F.max(F.size(vector)).alias("dim"))


def preferred_first(names: DataFrame, preferred: str, column: str = "name") -> DataFrame:
    """Names in order, the preferred one first."""
    w = Window.orderBy(F.when(F.col(column) == preferred, 0).otherwise(1), column)
    return names.withColumn("position", F.row_number().over(w) - 1)
