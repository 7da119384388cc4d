"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers (law `rows`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm._shared import documents, set_aside

SHARDS = 8
SEED = 20_260
ROUNDS = 6
RESULTS = ["row_no", "n_rows", "position", "shard", "slot"]
#: Row numbers are given bucket by bucket; a bucket is what one sort holds together. A power of two.
BUCKETS = 8192


def numbered(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Add `row_no`, the numbers 0 .. n-1 in an order that only the values of `keys` decide, and `n_rows`.

    Rows are dealt to buckets by a hash of the keys, numbered inside their bucket and shifted by the sizes of the
    buckets before. Both uses of the bucketed rows share one exchange; the only global step adds up one row a bucket.
    Rows equal in all keys are interchangeable: they get consecutive numbers. Nulls are keys like others.
    """
    row = df.withColumn("_bucket", F.xxhash64(*keys).bitwiseAND(F.lit(buckets - 1)))
    inside = row.withColumn("_in", F.row_number().over(Window.partitionBy("_bucket").orderBy(*[F.col(k).asc_nulls_first() for k in keys])) - 1)
    sizes = inside.groupBy("_bucket").agg((F.max("_in") + 1).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.sum("_size").over(everything).alias("n_rows"))
    return inside.join(starts, "_bucket").withColumn("row_no", F.col("_start") + F.col("_in")).drop("_bucket", "_in", "_start")


def _step(x: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of the permutation of 0 .. a*b-1: the halves x div b and x mod b are shifted in turn by a hash of the other."""

    def turn(halves: Column, i: Column) -> Column:
        left, right = halves["left"], halves["right"]
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), i, right), a), a)).otherwise(left).alias("left"),
            F.when(even, right).otherwise(F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), i, left), b), b)).alias("right"),
        )

    halves = F.struct(((x - F.pmod(x, b)) / b).cast("long").alias("left"), F.pmod(x, b).alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda h: h["left"] * b + h["right"])


def permuted(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Add `position`: where the row `row_no` of `n_rows` stands after the shuffle.

    The domain a * b is the smallest rectangle of nearly equal sides that holds n_rows, so fewer than a of its
    numbers lie beyond n_rows and a cycle walk ends after at most that many steps more. Nearly no row needs a step.
    """
    n = F.col("n_rows")
    df = df.withColumn("_a", F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double")))).cast("long"))
    df = df.withColumn("_b", F.greatest(F.lit(1), F.ceil(n / F.col("_a"))).cast("long"))
    a, b = F.col("_a"), F.col("_b")
    first = df.withColumn("_x", _step(F.col("row_no"), a, b, seed))
    walk = F.aggregate(F.sequence(F.lit(0).cast("long"), a * b - n), F.col("_x"), lambda x, _: F.when(x < n, x).otherwise(_step(x, a, b, seed)))
    return first.withColumn("position", F.when(F.col("_x") < n, F.col("_x")).otherwise(walk)).drop("_a", "_b", "_x")


def shard(df: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Shuffle the rows of df and deal them out in turn: shard = position mod shards, slot = position div shards.

    Law `rows`: the shards' counts differ by one at most and slots have no gaps. The same rows, keys and seed give
    the same result whatever the partitions are. Nulls in keys are values like others; equal rows may swap places;
    an empty table gives an empty result; texts are never looked at unless they are keys. The permutation places each
    row for itself, so law `rows` does not keep groups of equal texts together. More columns pass through; one that has
    the name of a result (row_no, n_rows, position, shard, slot) is given back as `<name>_in`.
    """
    work, back = set_aside(df, keys, RESULTS)
    out = permuted(numbered(work, keys), seed)
    return back(out.withColumns({"shard": F.pmod("position", F.lit(shards)).cast("int"), "slot": ((F.col("position") - F.pmod("position", F.lit(shards))) / shards).cast("long")}))


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = documents(spark, sf_dir).select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard(rows, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_feistel_sharding": op5_feistel_sharding}
SQL: dict[str, str] = {}
