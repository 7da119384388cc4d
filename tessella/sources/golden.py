"""Golden sets and reports of evaluations as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "query string, collection string, relevant array<string>, tags array<string>, filters map<string,string>, use_hyde boolean"
VERSION = "retrieval-eval-v1"


def read_golden(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The samples of a JSON-lines file; blank lines and those that begin with # are skipped.

    A line without query, collection or relevant keys is an error that shows it, or is left out where strict is off.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    row = lines.select("line", F.from_json("line", SCHEMA).alias("s"))
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    ok = filled(F.col("s.query")) & filled(F.col("s.collection")) & (F.coalesce(F.size("s.relevant"), F.lit(0)) > 0)
    if strict:
        row = row.withColumn("s", F.when(ok, F.col("s")).otherwise(F.raise_error(F.concat(F.lit("not a golden sample: "), F.col("line")))))
    else:
        row = row.where(ok)
    return row.select("s.*").withColumn("use_hyde", F.coalesce("use_hyde", F.lit(False)))


def write_report(metrics: DataFrame, folder: str, stamp: str, samples: DataFrame | None = None, config: dict | None = None) -> str:
    """One JSON report, named by its time so that names sort as times do: a row of averages with the run's settings, and its
    samples, if given, beside it as a table of their own. Gives the report's folder."""
    path = f"{folder}/retrieval_eval_{stamp}"
    said = {"schema_version": F.lit(VERSION), "finished_at": F.lit(stamp)} | {k: F.lit(v) for k, v in (config or {}).items()}
    if samples is not None:
        samples.write.json(f"{folder}/samples_{stamp}")
    metrics.withColumns(said).coalesce(1).write.json(path)  # one row
    return path


def latest_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report whose name is the last; names are listed, and one report is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/retrieval_eval_*")
    names = sorted(str(f.getPath().toString()) for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or [])
    if not names:
        raise LookupError(f"no report in {folder}")
    return spark.read.json(names[-1])
