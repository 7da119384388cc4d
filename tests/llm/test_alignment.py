"""Cross-tokenizer alignment against a version written apart, over both libraries."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import alignment, bpe
from tessella.llm._shared import materialise

FOLDER = "/root/testdata/sf0.001"
ODD = ["", None, "<|endoftext|>a<s>", "it's  I'll\t\n\n x", "é" * 900, "a" * 5000, "中文字 १२ ²½ \x1c\x85​😀", " ", "the the the", "the the the", "a▁b", "x  ", "nul\0x", "word " * 20_000]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plainly(texts):
    path_a, path_b = alignment.default_tokenizers()
    a_model, b_model = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a_model.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(bpe.byte_characters())}
    spelled = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    rows, links = [], []
    for t in texts:
        whole = f" {t}".encode()
        a = a_model.encode(f" {t or ''}", add_special_tokens=False).ids
        b = b_model.encode(t or "")
        a_bytes, b_bytes = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a], [spelled(i) for i in b]
        if not t or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
        at, groups = 0, []
        by_a, by_b = dict(zip(ends_a, range(len(a)))), dict(zip(ends_b, range(len(b))))
        i = j = 0
        for end in sorted(by_a.keys() & by_b.keys()):
            groups.append(",".join(map(str, a[i : by_a[end] + 1])) + "|" + ",".join(map(str, b[j : by_b[end] + 1])))
            i, j, at = by_a[end] + 1, by_b[end] + 1, end
        assert at == len(whole)
        own = [(a[by_a[e]], b[by_b[e]]) for e in by_a.keys() & by_b.keys()]
        links.append(own)
        rows.append((len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for own in links for x in own)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(*r[:4], sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own), r[4]) for r, own in zip(rows, links)]


@pytest.mark.parametrize("chunk", [alignment.CHUNK_BYTES, 20])
def test_odd_texts(spark, chunk):
    """Whatever the chunks; columns of the input that clash come back under other names."""
    docs = spark.createDataFrame([(i, t, 7, "z", 2) for i, t in enumerate(ODD)], "doc_id long, text string, N_BEST int, _chunk string, Groups int").repartition(3)
    out = {r.doc_id: r for r in alignment.weigh(materialise(alignment.align(docs, chunk_bytes=chunk))).collect()}
    want = plainly(ODD)
    assert sum(w[0] > 0 for w in want) > 8 and any(t and not w[0] for t, w in zip(ODD, want))
    for i, w in enumerate(want):
        r = out[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == w[:6]
        assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") == w[6]
        assert (r.N_BEST_in, r._chunk_in, r.Groups_in, r.text) == (7, "z", 2, ODD[i])


def test_op13_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    out = {r.doc_id: r for r in alignment.op13_cross_tokenizer_alignment(spark, FOLDER).collect()}
    assert len(out) == len(docs)
    for r, w in zip(docs, plainly([r.text for r in docs])):
        assert tuple(out[r.doc_id][c] for c in COLUMNS) == w


def test_tables_without_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    run = lambda d: alignment.weigh(materialise(alignment.align(d))).collect()
    assert run(docs.limit(0)) == []
    assert [(r.n_a, r.n_links, r.n_best, r.count_sum, r.groups) for r in run(docs)] == [(0, 0, 0, 0, "")] * 2


def test_pair_counts(spark):
    texts = ["the cat", "the cat", "the dog"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = alignment.pair_counts(materialise(alignment.align(docs))).collect()
    a, b = (alignment.tokenizer(p) for p in alignment.default_tokenizers())
    spelled = {(a.bytes_of[r.a], b.bytes_of[r.b]): r.n for r in rows}
    assert spelled[b" the", b" the"] == 3 and len(rows) == len({(r.a, r.b) for r in rows})


def test_words_have_the_pieces_of_whole_texts():
    pieces = alignment.tokenizer(alignment.default_tokenizers()[1])
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab  \n\t　é中😀ﬁ.,x▁\0") for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    assert pieces.by_words and pieces.encode(texts).to_pylist() == pieces.model.encode(texts)


@pytest.mark.parametrize("n", [[], [1], [300, 1, 70_000]])
def test_packed_pairs(n):
    numbers = np.array([5, 0, 1 << 20][: len(n)], np.int64)
    got = alignment._unpacked(alignment._packed(numbers, np.array(n, np.int64)))
    assert dict(zip(*map(list, got))) == dict(zip(numbers, n))
