"""The inverted index against scores counted plainly: hot terms, ties, small blocks, many queries, conditions, additions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import conditions, evaluation, lexical, search

DRAW = random.Random(7)
WORDS = ["the"] * 12 + [f"w{i}" for i in range(40)]
TEXTS = [" ".join(DRAW.choices(WORDS, k=DRAW.randint(0, 30))) for _ in range(300)] + [None, "", "...", "the the the", "数据库 数据"]
ASKED = [" ".join(DRAW.choices(WORDS, k=6)) for _ in range(20)] + [None, "", "nowhere", "数据"]


def tokens(text):
    low = (text or "").lower()
    han = re.findall("[一-龥]", low)
    return re.findall(r"\w+", low) + [a + b for a, b in zip(han, han[1:])]


def plainly(scoring, k):
    held = [Counter(tokens(t)) for t in TEXTS]
    n = sum(bool(h) for h in held)
    average = sum(sum(h.values()) for h in held) / n
    df = Counter(t for h in held for t in h)
    out = {}
    for q, text in enumerate(ASKED):
        scores = []
        for d, h in enumerate(held):
            size, total = sum(h.values()), 0.0
            for t, times in Counter(tokens(text)).items():
                if h[t]:
                    total += times * {
                        "counts": h[t],
                        "shares": 1 + h[t] / size,
                        "bm25": math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * h[t] * 2.2 / (h[t] + 1.2 * (0.25 + 0.75 * size / average)),
                    }[scoring]
            if total > 0:
                scores.append((-round(total, 6), d))
        out |= {(q, i): (d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])}
    return out


def tables(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame(list(enumerate(ASKED)), "query_id long, text string")


@pytest.mark.parametrize("name, scoring", [("sparse_topk", "counts"), ("fallback_topk", "shares"), ("bm25_topk", "bm25")])
@pytest.mark.parametrize("setting", ["large", "small blocks", "no broadcast"])
def test_scores(spark, monkeypatch, name, scoring, setting):
    if setting != "large":
        monkeypatch.setattr(lexical, "QUERIES", 5)
        monkeypatch.setattr(lexical.blocks, "__defaults__", (*lexical.blocks.__defaults__[:-1], 16))
    if setting == "no broadcast":
        monkeypatch.setattr(lexical, "BROADCAST_BYTES", 400)
    docs, queries = tables(spark)
    found = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in getattr(search, name)(queries, docs, 7).collect()}
    want = plainly(scoring, 7)
    assert found.keys() == want.keys()
    for place, (doc, score) in want.items():
        assert abs(found[place][1] - score) < 2e-6 and (found[place][0] == doc or scoring != "counts")


def test_no_join_by_a_term(spark):
    docs, queries = tables(spark)
    for search_by in (search.sparse_topk, search.fallback_topk, search.bm25_topk):
        plan = search_by(queries, docs, 3)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Generate" not in plan


def test_many_queries_are_asked_in_groups(spark, monkeypatch):
    """No task gets more query blocks than those of a group, and blocks of queries and documents never share a row."""
    monkeypatch.setattr(lexical, "QUERIES", 5)
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 2000)
    docs, queries = tables(spark)
    for search_by in (search.sparse_topk, search.bm25_topk):
        sizes, met = [], lexical._met
        monkeypatch.setattr(lexical, "_met", lambda index, asked, *a, **b: (sizes.append(sum(len(x) for x in asked["ids"])), met(index, asked, *a, **b))[1])
        plan = search_by(queries.repartition(2), docs, 3)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and len(sizes) > 2 and max(sizes) < len(ASKED)
        monkeypatch.setattr(lexical, "_met", met)


@pytest.mark.parametrize("scoring", ["counts", "bm25"])
def test_documents_that_are_passed_by(scoring):
    """Long documents bound what the others have to reach; what is found is what all products give, ties and conditions included."""
    draw, numbers, k = random.Random(3), lexical._Numbers(False), 4
    text = lambda n: [f"w{min(int(draw.expovariate(0.05)), 300)}" for _ in range(n)]
    held = [text(int(draw.paretovariate(0.9))) for _ in range(1500)] + [text(3000)] * 9
    asked = [text(draw.choice([1, 5, 50, 500])) for _ in range(40)] + [["none"], []]
    made = lambda rows: lexical._Block({c: v[0].as_py() for c, v in lexical._inverted(pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.string())), None, numbers).items()})
    q, block = made(asked), made(held)
    c = lexical._Held(block, scoring, 20.0)
    idf = None if scoring == "counts" else np.linspace(0.1, 3, len(q.terms))
    weights = np.zeros((block.n, len(block.terms)))
    weights[block.docs, np.repeat(np.arange(len(block.terms)), np.diff(block.starts))] = c.weights
    wanted = np.zeros((q.n, len(q.terms)))
    wanted[q.docs, np.repeat(np.arange(len(q.terms)), np.diff(q.starts))] = q.tf
    wanted *= 1 if idf is None else idf
    at = {t: i for i, t in enumerate(block.terms.tolist())}
    both = [i for i, t in enumerate(q.terms.tolist()) if t in at]
    score = np.round(wanted[:, both] @ weights[:, [at[t] for t in q.terms[both].tolist()]].T, 6)
    masks = np.array([[(i + j) % 3 > 0 or i % 2 == 0 for j in range(block.n)] for i in range(q.n)])
    for mask in (None, masks):
        every = score if mask is None else np.where(mask, score, 0.0)
        rows, columns = lexical.best_of(every, k)
        found = lexical._found(q, c, idf, k, mask, scoring == "counts", block.n)
        assert (found[0] == rows).all() and (found[1] == columns).all() and np.allclose(found[2], every[rows, columns], atol=2e-6)
        q.kth = -np.sort(-every, 1)[:, k - 1]
        rows, docs, _ = lexical._found(q, c, idf, k, mask, scoring == "counts", block.n)
        assert set(zip(rows.tolist(), docs.tolist())) == {(i, j) for i, j in zip(*(x.tolist() for x in lexical.best_of(every, k)))}
        q.kth = None
    assert len(c._parts) > 1


def test_only_what_reaches_goes_on(spark, monkeypatch):
    """The second look at a group gives what reaches the k-th best of the first, not k rows of each block."""
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(lexical.blocks, "__defaults__", (*lexical.blocks.__defaults__[:-1], 16))
    docs = spark.range(640).select(F.col("id").alias("doc_id"), F.repeat(F.lit("fox "), (1 + F.col("id")).cast("int")).alias("text")).repartition(8)
    queries = spark.createDataFrame([(0, "fox")], "query_id long, text string")
    looks, met = [], lexical._met
    monkeypatch.setattr(lexical, "_met", lambda index, asked, k, scoring, average, known, names, *a, **b: looks.append((names, (out := met(index, asked, k, scoring, average, known, names, *a, **b))[0].count())) or out)
    assert [r.doc_id for r in search.sparse_topk(queries, docs, 5).orderBy("rank").collect()] == [639, 638, 637, 636, 635]
    assert [names for names, _ in looks] == [None, ("query_id", "doc_id")] and looks[1][1] <= 2 * 5


def test_a_written_index_grows(spark, tmp_path):
    docs, queries = tables(spark)
    folder = str(tmp_path / "index")
    lexical.write_index(docs.where("doc_id < 100"), folder)
    lexical.add(docs.where("doc_id >= 100"), folder)
    found = lambda index: sorted(map(tuple, search.ranked(lexical.topk(queries, index, 5), 5).collect()))
    assert found(lexical.read_index(spark, folder)) == found(lexical.blocks(docs))


def test_conditions_are_data(spark):
    """Each query has its own; names that no row has, null values and null maps."""
    docs = spark.createDataFrame([(i, "red fox", "ab"[i % 2], i // 4 if i else None) for i in range(12)], "doc_id long, text string, kind string, part int")
    docs = docs.withColumn("at", conditions.attributes(docs, conditions.plain_columns(docs, "text"))).withColumn("embedding", F.array(F.lit(1.0), F.col("doc_id") / 100.0))
    asked = [({"kind": "a"}, {0, 2, 4, 6, 8, 10}), ({"kind": "a", "part": "1"}, {4, 6}), ({"none": "x"}, set()), (None, set(range(12))), ({"part": "0"}, {1, 2, 3})]
    queries = spark.createDataFrame([(i, "fox", w, [1.0, 0.0]) for i, (w, _) in enumerate(asked)], "query_id long, text string, at map<string,string>, embedding array<double>")
    for rows in (search.sparse_topk(queries, docs, 20, where="at"), search.dense_topk(queries, docs, 20, where="at")):
        found = {i: set() for i in range(len(asked))}
        for r in rows.collect():
            found[r.query_id].add(r.doc_id)
        assert found == {i: want for i, (_, want) in enumerate(asked)}
    maps = spark.range(1).select(conditions.of(F.create_map(F.lit("a"), F.lit("1")), conditions.single("a", F.lit("2")), conditions.single("b", F.lit(None))).alias("m"))
    assert maps.first().m == {"a": "2"}


def test_best_of():
    score = np.array([[0.0, 3, 1, 3, 2], [0, 0, 0, 0, 0], [1, 1, 1, 1, 1]])
    rows, columns = lexical.best_of(score, 2)
    assert list(zip(rows.tolist(), columns.tolist())) == [(0, 1), (0, 3), (2, 0), (2, 1)]


def test_evaluation_is_one_plan_for_many_settings(spark):
    """As many settings as samples, of which none is collected; cuts up to 200, more is an error."""
    corpus = spark.range(260).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), (F.col("id") % 65).cast("string").alias("collection"), F.lit("s").alias("source"), F.lit("red fox").alias("text"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    golden = spark.range(65).select(F.col("id").alias("query_id"), F.lit("fox").alias("text"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"), F.col("id").cast("string").alias("collection"), F.create_map(F.lit("doc_id"), F.col("id").cast("string")).alias("filters"), F.array(F.concat("id", F.lit("#0"))).alias("relevant"))
    jobs = lambda: spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    before = len(jobs())
    samples, averages = evaluation.run(golden, corpus, diagnostic_k=200)
    many = len(jobs()) - before
    evaluation.run(golden.limit(1), corpus, diagnostic_k=200)
    assert len(jobs()) - before - many <= many + 2
    rows = samples.collect()
    assert len(rows) == 65 and all(r.hit and r.retrieved == [f"{r.query_id}#0"] and r.dense_count == r.hybrid_count == 1 for r in rows)
    assert averages.first().recall_1 == 1.0
    with pytest.raises(ValueError):
        evaluation.run(golden, corpus, diagnostic_k=201)
