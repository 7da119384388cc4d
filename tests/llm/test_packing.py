"""Packing against its contract: every token once, sequences without gaps, and few of them."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessella.llm import bpe, packing

FOLDER = "/root/testdata/sf0.001"


def checked(rows, texts, capacity, end=packing.END):
    """The pieces (number of the text, piece, start, length, ids, sequence_id, offset) hold all texts whole; the number of sequences."""
    model = Tokenizer.from_file(bpe.default_tokenizer())
    want = [e.ids + [end] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    by_text, by_sequence = {}, {}
    for r in rows:
        by_text.setdefault(r[0], []).append(r)
        by_sequence.setdefault(r[5], []).append(r)
    assert len(by_text) == len(texts)
    for i, ids in enumerate(want):
        own = sorted(by_text[i], key=lambda r: r[1])
        assert [r[1] for r in own] == list(range(-(-len(ids) // capacity)))
        assert [x for r in own for x in r[4]] == ids and [r[3] for r in own[1:]] == [capacity] * (len(own) - 1)
        assert [r[2] for r in own] == np.cumsum([0, *(r[3] for r in own)])[:-1].tolist()
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r[6]):
            assert r[6] == at and r[3] == len(r[4])
            at += r[3]
        assert at <= capacity
    return len(by_sequence), sum(map(len, want))


def test_op11_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    number = {r.doc_id: i for i, r in enumerate(docs)}
    model = Tokenizer.from_file(bpe.default_tokenizer())
    ids = [e.ids + [2] for e in model.encode_batch([r.text or "" for r in docs], add_special_tokens=False)]
    out, rows = packing.op11_genetic_packing(spark, FOLDER).collect(), []
    for r in out:
        own = ids[number[r.doc_id]][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        rows.append((number[r.doc_id], r.piece, r.start, r.length, own, r.sequence_id, r.offset))
    used, tokens = checked(rows, [r.text for r in docs], packing.CAPACITY)
    assert used <= 1.02 * tokens / packing.CAPACITY + 1


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeats, null ids, texts of exactly one sequence, columns that clash."""
    texts = [None, "", "a b c", "a b c", "x " * 3000, " x" * 15, " x" * 16, " x" * 31, "<|endoftext|>z", *[" y" * k for k in range(40)]]
    df = spark.createDataFrame([(i if i % 5 else None, i, t, "own", 5) for i, t in enumerate(texts)], "doc_id long, n int, text string, Offset string, ids int").repartition(4)
    out = packing.pack(df, capacity=16, block=10).collect()
    rows = [(r.n, r.piece, r.start, r.length, r.ids, r.sequence_id, r.offset) for r in out]
    used, tokens = checked(rows, texts, 16)
    assert used <= tokens / 16 + 8 and {(r.Offset_in, r.ids_in) for r in out} == {("own", 5)}
    assert all((r.doc_id is None) == (r.n % 5 == 0) for r in out)
    whole = packing.sequences(packing.pack(df, capacity=16)).collect()
    assert sum(len(r.ids) for r in whole) == tokens and all(sum(r.lengths) == len(r.ids) <= 16 for r in whole)
    assert packing.pack(df.limit(0)).count() == 0
    assert [r.length for r in packing.pack(df.where("text is null")).collect()] == [1]


@pytest.mark.parametrize("seed", range(3))
def test_islands_get_better(seed):
    """Crossover and mutation keep every piece once, and evolution never loses bins; the bound is one."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(150, 700, 600)
    island = packing.Island(sizes, 1000, rng).found(6)
    first, bound = packing.Island._bins(island.population[0]), packing.lower_bound(sizes, 1000)
    for child in (island.crossed(*island.population[:2]), island.mutated(island.population[0])):
        fills = np.bincount(child, sizes)
        assert child.min() == 0 and fills.max() <= 1000 and (fills > 0).all() and fills.sum() == sizes.sum()
    assert bound <= packing.Island._bins(island.evolve(60).best()) <= first


def test_lower_bound():
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert packing.lower_bound(np.array([5, 5, 5]), 10) == 2
    assert packing.lower_bound(np.array([7, 3, 4]), 10) == 2
    assert packing.lower_bound(np.array([], np.int64), 10) == 0


def test_best_fit():
    bins = packing.Bins(10)
    assert bins.place([6, 7, 3, 4, 9, 2]) == [0, 1, 1, 0, 2, 3]
    assert packing.Bins.of(10, np.array([4, 7, 10])).place([3, 6, 1]) == [1, 0, 3]


def test_the_same_whatever_the_partitions(spark):
    items = spark.createDataFrame([(i, 1 + i * 37 % 900) for i in range(500)], "_row long, _size int")
    runs = [sorted(map(tuple, packing.place(items.repartition(k), block=200).collect())) for k in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 500
