"""Token-id files: ids are ranked by frequency, and a rank takes one to four bytes, with control bytes of their own.

A file is Parquet with a row for each block of consecutive documents: their ids and lengths, the control bytes (two
bits a token: its number of bytes less one) and the data bytes. Frequent ids have low ranks, so most take one byte.
Blocks are decoded by numpy: a table turns a control byte into four lengths, and bytes are gathered by place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import bpe
from tessella.llm._shared import documents, materialise, portions, shared_folder

#: The id that ends a document.
END = 2
#: Tokens of a block, more if a document alone has more.
BLOCK_TOKENS = 1 << 18
_LENGTHS = np.array([[(b >> 2 * k & 3) + 1 for k in range(4)] for b in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of ranks."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) <= extra[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of pack()."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        has = lengths > k
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenised(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """A written table with a row per document in the order of doc_id: part, in_part (tokens before it there), doc_id, n, ids.

    ids: little-endian, of two bytes where the vocabulary allows, else four. Texts, not ids, are dealt out by doc_id, so
    that each is encoded once. Parts follow each other as doc_id does, nulls first.
    """
    path = path or bpe.default_tokenizer()

    def run(batches):
        coder = bpe.encoder(path, library=True)
        kind, before = np.dtype("<u2" if coder.size <= 1 << 16 else "<u4"), 0
        for batch in portions(batches):
            flat, ends = coder.encode(batch.column(1).to_pylist())
            flat = flat.astype(kind)
            # Room for the end id after each document.
            whole = np.full(len(flat) + len(ends), end, kind)
            whole[np.arange(len(flat)) + np.searchsorted(ends, np.arange(len(flat)), "right")] = flat
            stops = ends + np.arange(1, len(ends) + 1)
            starts = np.concatenate([[0], stops[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(before + starts), batch.column(0), pa.array(stops - starts), pa.array([whole[a:b].tobytes() for a, b in zip(starts, stops)], pa.binary())], names=["part", "in_part", "doc_id", "n", "ids"])
            before += len(whole)

    kind = docs.schema["doc_id"].dataType
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.length("text")).withColumn("part", F.spark_partition_id())
    return materialise(ordered.mapInArrow(run, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("in_part", T.LongType()), T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])))


def ranks_of(coded: DataFrame, path: str | None = None) -> np.ndarray:
    """The vocabulary's ids in the order of their ranks: by frequency in all documents, ties by id. One number an id comes to the driver."""
    size = max(bpe.encoder(path or bpe.default_tokenizer()).size, END + 1)
    wide = "<u2" if size <= 1 << 16 else "<u4"

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), wide), minlength=size) if x.as_buffer().size > 8 * size else 0
            small = [x.as_py() for x in batch.column(0) if x.as_buffer().size <= 8 * size]
            total += np.bincount(np.frombuffer(b"".join(small), wide), minlength=size)
        ids = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["id", "n"])

    rows = coded.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(size, np.int64)
    n[rows.id.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return np.argsort(-n, kind="stable").astype(np.uint32)


def write_files(coded: DataFrame, ranked: np.ndarray, folder: str) -> None:
    """Write the rows of tokenised() as files of blocks, and the ids by rank beside them."""
    spark = coded.sparkSession
    wide = "<u2" if len(ranked) <= 1 << 16 else "<u4"
    rank = np.empty(len(ranked), np.uint32)
    rank[ranked] = np.arange(len(ranked))
    shared = spark.sparkContext.broadcast(rank)
    names = ["part", "in_part", "doc_ids", "lengths", "control", "data"]

    def block(part, in_part, ids, lengths, raw, kind):
        control, data = pack(shared.value[np.frombuffer(b"".join(raw), wide)])
        columns = [pa.array([part], pa.int32()), pa.array([in_part], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, kind)), pa.array([np.array(lengths, "<u4").tobytes()], pa.binary()), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        part, first, ids, lengths, raw, held, kind = None, 0, [], [], [], 0, None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for p, at, doc, n, x in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if ids and (p != part or at != first + held or held >= BLOCK_TOKENS):
                    yield block(part, first, ids, lengths, raw, kind)
                    ids, lengths, raw, held = [], [], [], 0
                if not ids:
                    part, first = p, at
                ids.append(doc)
                lengths.append(n)
                raw.append(x)
                held += n
        if ids:
            yield block(part, first, ids, lengths, raw, kind)

    kind = coded.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("in_part", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("lengths", T.BinaryType()), T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])
    coded.select("part", "in_part", "doc_id", "n", "ids").mapInArrow(run, schema).write.parquet(f"{folder}/blocks")
    spark.createDataFrame([(bytearray(ranked.astype("<u4").tobytes()),)], "ranked binary").write.parquet(f"{folder}/ranks")


def read_files(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """One row per document from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids.

    ids (array<int>, the end id among them) is left out on request.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    ranked = np.frombuffer(bytes(spark.read.parquet(f"{folder}/ranks").first().ranked), "<u4")
    shared = spark.sparkContext.broadcast(ranked)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                part, first, _, lengths, control, data = (one.column(i)[0].as_py() for i in range(6))
                n = np.frombuffer(lengths, "<u4").astype(np.int64)
                values = shared.value[unpack(control, data, int(n.sum()))].astype("<u4")
                stops = np.cumsum(n)
                crc = [zlib.crc32(values[b - k : b].tobytes()) for b, k in zip(stops, n)]
                columns = {"part": pa.array([part] * len(n), pa.int32()), "in_part": pa.array(first + stops - n), "doc_id": one.column(2).flatten(), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())}
                if ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(values.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = blocks.schema["doc_ids"].dataType.elementType
    fields = [T.StructField("part", T.IntegerType()), T.StructField("in_part", T.LongType()), T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    rows = blocks.select("part", "in_part", "doc_ids", "lengths", "control", "data").mapInArrow(run, T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids))
    # What each part holds: one row for each partition of the job that wrote the table, so few that all are sent along.
    totals = _totals(blocks)
    before, starts = 0, []
    for part, n in sorted(totals.items()):
        starts.append((part, before))
        before += n
    offsets = spark.createDataFrame(starts, "part int, _before long")
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("in_part") + F.col("_before")).select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids)


def _totals(blocks: DataFrame) -> dict[int, int]:
    def run(batches):
        for batch in batches:
            n = [int(np.frombuffer(x.as_py(), "<u4").sum(dtype=np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["part", "n"])

    return {r.part: r.n for r in blocks.select("part", "lengths").mapInArrow(run, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()}


def store(docs: DataFrame, path: str | None = None, folder: str | None = None) -> str:
    """Encode docs (doc_id, text), write the files in the order of doc_id, and return their folder.

    A null or empty text has the end id alone. Rows that repeat a doc_id stand side by side, shorter texts first; rows
    without doc_id come first; an empty table gives files without blocks; extra columns are left out.
    """
    folder = folder or shared_folder(docs.sparkSession)
    coded = tokenised(docs, path)
    write_files(coded, ranks_of(coded, path), folder)
    return folder


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(spark, store(documents(spark, sf_dir).select("doc_id", "text")), ids=False)


QUERIES = {"op8_token_files": op8_token_files}
SQL: dict[str, str] = {}
