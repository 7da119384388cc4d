"""Tokenizer, chat, token files, language and LM operators: against the library, exact round trips, held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from oracle import same
from tokenizers import Tokenizer

from tessella.llm import bpe, chat, language, lm_scoring, token_files

FOLDER = "/root/testdata/sf0.001"
ODD = ["", None, "<|endoftext|>a<|endoftext|>", "it's  I'll\t\n\n x", "é" * 900, "a" * 5000, "中文字 १२ ²½ \x1c\x85​😀", " ", "the the the", "the the the"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def test_encoder_equals_the_library(library, tmp_path):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcXYZ 019\t\n'!?.éñ中😀 ²\x1f") for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += [t for t in ODD if t is not None]
    lexicon = bpe.compile_lexicon([" the", "the", " and", "中", "abc"], bpe.default_tokenizer())
    file = tmp_path / "lexicon"
    file.write_bytes(lexicon)
    plain = bpe.Encoder(bpe.default_tokenizer())
    for coder in (plain, plain.with_lexicon(str(file)), bpe.Encoder(bpe.default_tokenizer(), library=True)):
        flat, ends = coder.encode(texts)
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(flat, ends[:-1])] == want
        assert coder.decoded(flat, ends).to_pylist() == texts


def test_automaton():
    words = sorted({b"a", b"ab", b"abc", b"xbc", b"b", b"stop", b"top"})
    a = bpe.Automaton.of(words)
    assert a.numbers(words).tolist() == list(range(len(words)))
    assert a.numbers([b"", b"x", b"abcd", b"zz"]).tolist() == [-1] * 4
    assert len(a.final) < sum(map(len, words))  # suffixes are shared
    assert bpe.Automaton.of([]).numbers([b"a"]).tolist() == [-1]


def test_op2_rows(spark, frame, library):
    docs = frame(*ODD)
    out = bpe.decode(bpe.encode(docs, bpe.build_lexicon(docs))).orderBy("doc_id").collect()
    for r, t in zip(out, ODD):
        assert r.ids == library.encode(t or "", add_special_tokens=False).ids and r.decoded == (t or "") and r.source
    assert bpe.encode(docs.limit(0)).count() == 0


def test_round_trip(spark, frame):
    """The rows and columns of encode() and decode(), by one worker a task: two side by side took too much memory."""
    import corpus_pipeline

    docs = frame(*ODD, "word " * 300_000).withColumn("ids", bpe.F.lit(7)).withColumn("Decoded", bpe.F.lit("given"))
    one, two = bpe.round_trip(docs, bpe.build_lexicon(docs)), bpe.decode(bpe.encode(docs, bpe.build_lexicon(docs)).drop("text"))
    assert sorted(one.columns) == sorted(two.columns)
    assert one.select(two.columns).orderBy("doc_id").collect() == two.orderBy("doc_id").collect()
    assert bpe.round_trip(docs.limit(0)).count() == 0
    for out in (bpe.op2_transducer_bpe(spark, FOLDER), corpus_pipeline.encode(spark, docs.drop("ids", "Decoded"), FOLDER)):
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("values", [[0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], [], list(range(1000))])
def test_packed_ranks(values):
    control, data = token_files.pack(np.array(values, np.uint32))
    assert token_files.unpack(control, data, len(values)).tolist() == values


def test_token_files(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    small = token_files.BLOCK_TOKENS
    try:
        token_files.BLOCK_TOKENS = 4
        out = token_files.read_files(spark, token_files.store(df)).orderBy("start").collect()
    finally:
        token_files.BLOCK_TOKENS = small
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or "")))
    start = 0
    for r, (i, t) in zip(out, order):
        ids = library.encode(t or "", add_special_tokens=False).ids + [token_files.END]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = token_files.store(df.limit(0))
    assert token_files.read_files(spark, empty).count() == 0


def test_escaping():
    rng = random.Random(2)
    parts = [*chat.CONTROLS, "\\", "<", "[", "/", "s>", "x", "|>"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 8)))
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROLS)


def test_chat(spark):
    same(spark, chat.QUERIES["op4_chat_formatting"], chat.SQL["op4_chat_formatting"], FOLDER)
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, None, None), (1, 1, "assistant", "b<|im_end|>"), (None, 0, "user", "x"), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(df)).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("", ""), ("assistant", "b<|im_end|>"), ("assistant", "b<|im_end|>")]
    assert out[1].loss_text == "b<|im_end|>" * 2 and out[2].loss_text == "" and [t.text for t in out[None].turns] == ["x"]
    assert sum(out[1].formatted.count(m) for m in chat.MARKS) == 9
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [r for r in language.op3_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(rows) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.99
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) / len(rows) < 0.02


def test_language_edges(spark, frame):
    df = frame("hello there", None, "", "123 !", "hello there", *["more words of text"] * 40)
    models = language.learn(df)
    out = {r.doc_id: r for r in language.identify(df, models).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(out[i].rejected and out[i].lang_score == 0 for i in (1, 2, 3))
    assert out[0].lang_pred == out[4].lang_pred == "en"
    none = language.learn(df.withColumn("lang", df.lang.substr(9, 1)).where("false"))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}
    assert language.identify(df.limit(0), models).count() == 0


def test_kneser_ney_sums_to_one():
    codes, _ = language.normalised(["abracadabra abba", "cadabra"])
    windows = np.lib.stride_tricks.sliding_window_view(codes, language.ORDER)
    grams, n = np.unique(windows[windows[:, -1] > 0], axis=0, return_counts=True)
    m = language.Models(["x"], {"x": (grams, n)})
    for k in range(1, language.ORDER + 1):
        assert np.exp(m.logs[k - 1]).max() <= 1
    seen = sorted({chr(c) for c in codes if c})
    total = sum(np.exp(-(m.losses([f"abra{c}"])[0][0, 0] * 5) + m.losses(["abra"])[0][0, 0] * 4) for c in seen)
    assert 0.5 < total <= 1 + 1e-6  # the rest is for characters that were never seen


def test_lm_scoring(spark, frame):
    good = ["alpha beta gamma"] * 6
    bad = ["delta epsilon zeta"] * 6
    df = frame(*good, *bad, None, "", "alpha beta gamma")
    target = spark.createDataFrame([(i,) for i in range(6)], "doc_id long")
    models = lm_scoring.learn(df, target)
    out = {r.doc_id: r for r in lm_scoring.score(df, models).collect()}
    assert out[14].lm_score == out[0].lm_score < out[6].lm_score
    assert (out[12].lm_score, out[12].n_words, out[13].n_words) == (0, 0, 0)
    assert lm_scoring.score(df.limit(0), models).count() == 0
    size = models.size
    for side in (models.target, models.background):
        for before in range(size):
            keys = before * size + np.arange(size)
            at = np.minimum(np.searchsorted(models.keys, keys), len(models.keys) - 1)
            p = np.exp(-side.loss(np.full(size, before), np.arange(size), at, models.keys[at] == keys))
            assert abs(p.sum() - 1) < 1e-9
    nothing = lm_scoring.learn(df, target.limit(0))
    assert {r.lm_score for r in lm_scoring.score(df, nothing).collect()} == {0.0}


def test_lm_scoring_takes_all_pairs(spark, frame, monkeypatch):
    """Pairs met once count, and what a context word hands to the back-off is of all pairs; chunks do not matter."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(0, 40))) for _ in range(200)] + ["the " + " the ".join(f"w{i}" for i in range(300)), "the w0 the w0", None]
    df, target = frame(*texts).repartition(3), spark.createDataFrame([(i,) for i in [*range(80), 200, 201]], "doc_id long")
    monkeypatch.setattr(lm_scoring, "CHUNK", 1000, raising=False)
    models = lm_scoring.learn(df, target)
    taken = lm_scoring.samples(df, target).collect()
    pairs = lambda t: list(zip(["", *lm_scoring.words(t)], lm_scoring.words(t)))
    sides = []
    for side in ("in_target", "in_background"):
        own = [p for r in taken if r[side] for p in pairs(r.text)]
        sides.append((Counter(own), Counter(b for b, _ in own), Counter(b for b, _ in set(own)), Counter(w for _, w in own)))
    size = models.size

    def loss(side, before, word):
        both, total, kinds, single = side
        under = (single[word] + 0.5) / (sum(single.values()) + 0.5 * size)
        return -np.log(max(both[before, word] - 0.75, 0) / total[before] + 0.75 * kinds[before] / total[before] * under if total[before] else under)

    known = set(models.ids)
    out = lm_scoring.score(df, models).collect()
    assert len(out) == len(texts) and len(known) == len({w for s in sides for w in s[3]})
    for r in out:
        own = [p for p in pairs(texts[r.doc_id])]
        if all(w in known for _, w in own):
            want = [sum(loss(s, *p) for p in own) / max(len(own), 1) for s in sides]
            assert np.allclose([r.loss_target, r.loss_background], want) and r.n_words == len(own) and r.text == texts[r.doc_id]


def test_long_texts_are_not_rejected_for_their_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = language.learn(docs.select("doc_id", "text", "lang"))
    texts = [r.text for r in docs.where(language._remainder() == 2).where("length(text) < 3000").orderBy("doc_id").limit(80).collect()]
    rejected = lambda times: sum(sum(models.predict([(t + "\n") * times])[3]) for t in texts)
    assert rejected(1) <= 2 and rejected(100) <= 8
    assert all(models.predict(["xq zvw kjqx wqzp vxkq " * 5000])[3])


def test_a_small_language_keeps_its_grams(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_GRAMS", 300, raising=False)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=30)), "aa") for i in range(200)] + [(1000 + i, "ωμέγα σίγμα " + chr(945 + i), "bb") for i in range(8)]
    models = language.learn(spark.createDataFrame(rows + [(2000 + i, "".join(rng.choices("abcde", k=2000)), "aa") for i in range(40)], "doc_id long, text string, lang string"))
    assert models.langs == ["aa", "bb"] and models.losses(["ωμέγα σίγμα"])[0][0, 1] < 1.5


def test_words_merged_together_have_the_ids_of_those_merged_one_by_one():
    coder = bpe.encoder(bpe.default_tokenizer())
    draw = random.Random(5)
    words = ["".join(draw.choice(" abcdeth'19é中\U0001f600") for _ in range(draw.randint(1, 12))).encode() for _ in range(500)] + [b"a", b"aaaaaaaa", b" the"]
    for longest in bpe.TOGETHER:
        some = [w for w in words if len(w) <= longest]
        assert [np.frombuffer(x, "<i4").tolist() for x in coder.merge_all(some, longest)] == [list(coder.merge(w.decode())) for w in some]
    assert coder.merge_all([], 8) == []


def test_cuts_are_those_of_the_pattern():
    coder, rng = bpe.encoder(bpe.default_tokenizer(), library=True), random.Random(3)
    cut = regex.compile(bpe.WORD).findall
    for _ in range(3000):
        text = "".join(rng.choice("abXY 09'stmrevld\n\t  .,!\xe9\xdf\u2013\u2019\xa0\u3000\x85\u65e5\ud55c\u043a\u0661\xb2\U0001f600") for _ in range(rng.randrange(30)))
        assert coder.words_of(text) == cut(text)


def test_distinct_pairs_by_sorting(monkeypatch):
    """The pairs that a chunk asks for are found by sorting: numpy.unique() hashes values, which took most of the step's time."""
    import pyarrow as pa
    from tessella.llm import _shared

    unique = np.unique

    def only_with_more(values, **more):
        assert more, "values alone are hashed"
        return unique(values, **more)

    class Rows:  # hands out the function that workers run
        select = lambda self, *names: self
        mapInArrow = lambda self, run, schema: run

    rng, size = np.random.default_rng(1), 50
    texts = [[0, *rng.integers(1, size, n).tolist()] for n in (0, 5, 900, 40)]
    chunks, whole = [3, 3, 4, 4], pa.array(texts, pa.list_(pa.int32()))
    batches = [pa.RecordBatch.from_arrays([whole.slice(i, 2), pa.array(chunks[i : i + 2], pa.int64())], names=["_codes", "_chunk"]) for i in (0, 2)]
    monkeypatch.setattr(np, "unique", only_with_more)
    out = {int(b.column(0)[0].as_py()): b.column(1).to_pylist() for b in lm_scoring.asked_pairs(Rows(), size)(batches)}
    pairs = {c: sorted({a * size + b for t, k in zip(texts, chunks) if k == c for a, b in zip(t, t[1:])}) for c in chunks}
    assert out == pairs
    assert [_shared.distinct(np.array(x, np.int64)).tolist() for x in ([], [2], [3, 1, 3, 2, 1])] == [[], [2], [1, 2, 3]]
