"""Counts, sums and a high percentile of measured values by name: a mergeable sketch first, then one exact pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of a sketch, the ranks around the wanted one that its bracket spans, and the values up to which all are looked at.
SKETCH, MARGIN, FEW = 4096, 0.004, 10_000


def sketches(samples: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """name, sketch, n, total, low, high: what is kept of the values of a name. Rows without a name, and null and NaN values are left out."""
    rows = samples.where(F.col(name).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(name).alias("name"), F.col(value).cast("double").alias("_v"))
    return rows.groupBy("name").agg(F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("sketch"), F.count("*").alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("low"), F.max("_v").alias("high"))


def merged(kept: DataFrame) -> DataFrame:
    """Rows of sketches() of several days, say, as one for each name."""
    return kept.groupBy("name").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def estimated(kept: DataFrame, share: float = 0.95) -> DataFrame:
    """name, n, total, percentile from sketches alone, without a look at the values: near the wanted rank, not at it."""
    return kept.select("name", "n", "total", F.kll_sketch_get_quantile_double("sketch", F.lit(float(share))).alias("percentile"))


def _at(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """name, percentile for rows (name, _v) and brackets (name, _place, _low, _high); null where the place is outside its bracket.

    Values below a bracket are only counted, before anything is moved; those inside are counted by value and put in order.
    """
    near = rows.join(brackets, "name").where("_v <= _high")
    counted = near.groupBy("name", "_place", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_k")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("name").orderBy(F.col("_k").asc_nulls_first()))
    hit = counted.withColumn("_upto", upto).where("_upto >= _place").groupBy("name").agg(F.min_by(F.struct("_k"), "_upto").alias("_hit"))
    return brackets.select("name").join(hit, "name", "left").select("name", F.col("_hit._k").alias("percentile"))


def summary(samples: DataFrame, name: str = "name", value: str = "value", share: float = 0.95) -> DataFrame:
    """name, n, total, percentile: the value at place max(1, share of n rounded down) in ascending order, exactly.

    A sketch of each name brackets the place between two values some thousandths of the ranks apart, however the values
    are spread, and only what lies between them is put in order. Where chance makes a bracket miss the place, all values
    of that name are looked at.
    """
    kept = sketches(samples, name, value)
    rows = samples.where(F.col(name).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(name).alias("name"), F.col(value).cast("double").alias("_v"))
    rank = lambda r: F.kll_sketch_get_quantile_double("sketch", F.lit(min(max(float(r), 0.0), 1.0)))
    edge = lambda r, end: F.when(F.col("n") <= FEW, F.col(end)).otherwise(rank(r))
    place: Column = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    spans = kept.select("name", "n", "total", "low", "high", place.alias("_place"), edge(share - MARGIN, "low").alias("_low"), edge(share + MARGIN, "high").alias("_high"))
    first = _at(rows, spans.select("name", "_place", "_low", "_high"))
    missed = spans.join(first.where("percentile IS NULL").select("name"), "name", "left_semi").select("name", "_place", F.col("low").alias("_low"), F.col("high").alias("_high"))
    found = first.where("percentile IS NOT NULL").unionByName(_at(rows, missed))
    return spans.join(found, "name").select(F.col("name").alias(name), "n", "total", "percentile")
