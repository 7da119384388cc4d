"""Command line of an evaluation: python -m tessella.evaluate --dataset golden.jsonl --corpus chunks.parquet --report-dir reports"""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import evaluation, search
from tessella.sources import golden


def evaluate(spark: SparkSession, dataset: str, corpus: DataFrame, report_dir: str, mode: str = "hybrid", top_k: int = 10, ks: tuple[int, ...] = evaluation.KS, embed=None, stamp: str | None = None) -> tuple[str, DataFrame]:
    """Run a golden set over a corpus and write the report: (its folder, the averages).

    embed: gives a table (query_id, text, ...) its embedding column; without it the deterministic stand-in of as many
    places as the corpus's vectors have.
    """
    samples = golden.read_golden(spark, dataset).withColumnRenamed("query", "text").withColumn("query_id", F.sha2(F.to_json(F.struct("text", "collection", "filters", F.array_sort("relevant"))), 256)).dropDuplicates(["query_id"])
    if embed is None:
        first = corpus.where("embedding is not null").select(F.size("embedding").alias("n")).first()
        samples = samples.withColumn("embedding", search.hashed_embedding("text", first.n) if first else F.lit(None).cast("array<float>"))
    else:
        samples = embed(samples)
    rows, averages = evaluation.run(samples, corpus, mode, top_k, ks)
    stamp = stamp or datetime.now(UTC).strftime("%Y%m%d_%H%M%S")
    path = golden.write_report(averages, report_dir, stamp, rows, {"mode": mode, "top_k": top_k, "dataset_path": dataset})
    return path, spark.read.json(path)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Evaluate retrieval with a golden set")
    parser.add_argument("--dataset", required=True, help="golden set, JSON lines")
    parser.add_argument("--corpus", required=True, help="Parquet with doc_id, chunk_index, collection, source, text, embedding")
    parser.add_argument("--report-dir", required=True)
    parser.add_argument("--mode", choices=("vector", "bm25", "hybrid"), default="hybrid")
    parser.add_argument("--top-k", type=int, default=10)
    parser.add_argument("--k", type=int, nargs="+", default=list(evaluation.KS))
    parser.add_argument("--print-json", action="store_true", help="the whole row of averages")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("evaluate").getOrCreate()
    path, report = evaluate(spark, given.dataset, spark.read.parquet(given.corpus), given.report_dir, given.mode, given.top_k, tuple(given.k))
    row = report.first().asDict()
    if given.print_json:
        print(report.toJSON().first())
        return
    print(f"report_path={path}")
    for name in ("sample_count", "hit_rate", "mrr", *(f"recall_{k}" for k in given.k)):
        print(f"{name}={row[name]}")


if __name__ == "__main__":
    main()
