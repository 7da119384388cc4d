"""What the operators of this folder share: words, the shared folder, tables written between jobs."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words that are runs of anything but ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"
#: Separators of words that are runs of ASCII letters, digits and everything beyond ASCII.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Pieces that a table of fixed size comes to the driver in, and bits of the table that sorts out rows before a join.
PACKS = 256
FILTER_BITS = 1 << 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Texts that are all ASCII take the fast built-in."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, separators: str) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.coalesce(F.filter(F.split(text, separators), lambda w: w != ""), F.array().cast("array<string>"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often and deep in other lambdas `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without(items: Column, gone: Column) -> Column:
    """An array without the items at the places `gone` (an array of ints from 0), in time linear in both."""
    every = lambda x: F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
    return bound(items, lambda x: F.transform(F.array_except(every(x), gone), lambda i: F.get(x, i)))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that every executor can reach, below spark.checkpoint.dir.

    Where that is unset, a local master takes a temporary folder, as driver and executors are one process. A cluster
    must name one: a folder of one machine would lose what the others write.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_folder()
    return f"{root.rstrip('/')}/tessella-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tessella-')}"


#: Folders of the tables written so far and not yet dropped, in their order.
_written: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends here and Spark knows its size."""
    path = shared_folder(df.sparkSession)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place among the written tables, for drop_since()."""
    return len(_written)


def drop_since(spark: SparkSession, place: int, *kept: DataFrame) -> None:
    """Delete the tables written since mark() gave `place`, but for those that `kept` read."""
    still = {f for df in kept for f in df.inputFiles()}
    gone = [p for p in _written[place:] if not any(p.rpartition("/")[2] in f for f in still)]
    _written[place:] = [p for p in _written[place:] if p not in gone]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def set_aside(docs: DataFrame, needed: list[str], results: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the needed ones under names that no operator uses, and what gives those names back.

    The rule for clashes, whatever the case of letters: result columns bear their own names, and a column of docs of
    such a name is given back as `<name>_in` (or with more `_in`, until the name is free).
    """
    plain = {c.lower() for c in needed}
    aside = {c: f"_x{i}" for i, c in enumerate(docs.columns) if c.lower() not in plain}
    taken, names = {x.lower() for x in results} | plain, {}
    for c in aside:
        name = c
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        names[c] = name
    columns = [F.col(aside[c]).alias(names[c]) if c in aside else F.col(c) for c in docs.columns]
    return docs.toDF(*[aside.get(c, c) for c in docs.columns]), lambda out: out.select(*columns, *results)


def as_given(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of out, which set_aside() gave their names, with the columns of docs alone and under docs' names."""
    return out.select(*[F.col(out.columns[i]).alias(c) for i, c in enumerate(docs.columns)])


def fixed_table(rows: DataFrame, slots: int, kind: str, together: np.ufunc = np.add, last: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """An array of `slots` numbers from rows (slot, v), where `together` joins the rows of a slot, from 0; `last` may turn sums (long) into numbers of `kind`.

    Executors pack the rows into PACKS pieces, so what the driver gets are that many rows, of the array's size together.
    """
    width = -(-slots // PACKS)

    def pack(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slot, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(slot // width, kind="stable")
            slot, v = slot[order], v[order]
            packs, starts = np.unique(slot // width, return_index=True)
            for p, i, j in zip(packs.tolist(), starts, [*starts[1:], len(slot)]):
                together.at(held.setdefault(p, np.zeros(width, np.int64)), slot[i:j] % width, v[i:j])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([(last(x) if last else x).astype(kind).tobytes() for x in held.values()], pa.binary())], names=["pack", "data"])

    dealt = rows.select(F.col("slot").cast("long"), F.col("v").cast("long")).repartition(F.expr(f"slot div {width}"))
    out = np.zeros(width * PACKS, kind)
    for r in dealt.mapInArrow(pack, "pack long, data binary").collect():
        piece = np.frombuffer(r.data, kind)
        at = r.pack * width + np.nonzero(piece)[0]
        out[at] = piece[piece != 0]
    return out[:slots]


def id_filter(ids: DataFrame, name: str) -> np.ndarray:
    """FILTER_BITS bits as bytes, set where an id of a column falls."""
    slot = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    rows = ids.select(slot.alias("s")).select(F.expr("s div 32").alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 32).cast("int")).alias("v"))
    return fixed_table(rows, FILTER_BITS // 32, "<u4", np.bitwise_or).view(np.uint8)


def narrowed(rows: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """Rows of which nearly all have an id (column `name`) that is among ids: what a join with ids need not shuffle goes here.

    The table that decides has FILTER_BITS bits always; when crowded it lets more rows through, and never too few.
    """
    shared = rows.sparkSession.sparkContext.broadcast(id_filter(ids, name))

    def run(batches):
        table = shared.value
        for batch in batches:
            slot = batch.column(batch.num_columns - 1).to_numpy()
            keep = table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
            yield batch.filter(pa.array(keep.astype(bool))).select(list(range(batch.num_columns - 1)))

    return rows.withColumn("_slot", F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))).mapInArrow(run, rows.schema)


def hex_sha256(text: Column | str) -> Column:
    return F.sha2(text, 256)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct numbers of an array. numpy.unique() hashes where only values are asked for, which takes far longer than to sort."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def give_back() -> None:
    """Hand memory that is free but held, by Arrow and the C library, back to the machine: workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def portions(batches, column: str = "text", most: int = 1_000_000):
    """Slices of Arrow record batches whose texts hold about `most` bytes at most; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def with_columns(batch, **more):
    """An Arrow record batch with further columns, as arrays or lists."""
    names = [*batch.schema.names, *more]
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=names)


def most_frequent(counted: DataFrame, n: Column | str, most: int, name: str) -> DataFrame:
    """The rows of counted of the largest n, `most` at most and nearly so many.

    The bound comes from a histogram of n in steps, 64 of them for each doubling, so its size hardly depends on the
    rows. Of the step at the bound, in which n ties or differs by a hundredth, those of the smallest hashes of `name` stay. Nothing is sorted, and the driver gets the rows
    kept. counted is read three times: give it as a written table.
    """
    n = F.col(n) if isinstance(n, str) else n
    step = F.floor(F.log2(n.cast("double")) * 64).cast("int")
    steps = {r.v: r.c for r in counted.where(n > 0).groupBy(step.alias("v")).agg(F.count("*").alias("c")).collect()}
    kept = 0
    for v in sorted(steps, reverse=True):
        if kept + steps[v] > most:
            break
        kept += steps[v]
    else:
        return counted.where(n > 0)
    order = F.pmod(F.xxhash64(F.lit(5), F.col(name)), F.lit(1 << 16))
    tied = {r.v: r.c for r in counted.where((n > 0) & (step == v)).groupBy(order.alias("v")).agg(F.count("*").alias("c")).collect()}
    bound = -1
    for h in sorted(tied):
        if kept + tied[h] > most:
            break
        kept, bound = kept + tied[h], h
    return counted.where((n > 0) & ((step > v) | ((step == v) & (order <= bound))))
