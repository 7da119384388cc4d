"""The similarity join against brute force, and the pipeline's stages against their operators' rules."""

import random

import pytest
from oracle import same

from tessella.llm import jaccard_join as J


def brute(texts):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("seed,crowd", [(1, 8), (2, 2), (3, 1)])
def test_by_brute_force(spark, frame, seed, crowd, monkeypatch):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    texts = [None, "", "one two", "One  two", "a b c d e", "A b c d e"]
    for base in range(12):
        words = [f"w{base}x{rng.randrange(60)}" for _ in range(rng.randint(6, 150))]
        texts += [" ".join(edited(rng, words, rng.randrange(0, 6))) for _ in range(rng.randint(1, 12))]
    for i in range(30):  # a passage that many share
        texts.append(" ".join([f"u{i}x{k}" for k in range(rng.randint(2, 30))] + passage))
    rng.shuffle(texts)
    monkeypatch.setattr(J, "GROUP", 3)
    monkeypatch.setattr(J, "CROWD", crowd)
    monkeypatch.setattr(J, "QUERIES_A_COPY", 2)
    out = J.similarity_classes(frame(*texts)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in out] == brute(texts)


def test_sql(spark):
    for name, sql in J.SQL.items():
        same(spark, J.QUERIES[name], sql, "/root/testdata/sf0.001")


def test_crowded_near_threshold(spark, frame):
    """A family that shares a passage, of which some link and some do not, in several groups that are compared with each other."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(60)]
    texts = [" ".join(edited(rng, base, rng.randrange(0, 5)) + [f"v{i % 40}x{k}" for k in range(rng.randrange(0, 14))]) for i in range(300)]
    out = J.similarity_classes(frame(*texts)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in out] == brute(texts)


def test_opened_group():
    """Members are linked with each other, and a query with one of each component that is not joined yet."""
    tokens = lambda *x: J._packed(J.np.array(x))
    group = J._Opened([(1, 1, 5, tokens(1, 2, 3, 4, 5)), (2, 2, 5, tokens(1, 2, 3, 4, 5)), (3, 3, 2, tokens(8, 9)), (4, 4, 5, tokens(1, 2, 3, 4, 7))])
    assert [set(x) for x in group.inner()] == [{1, 2}]
    assert group.links(9, 9, 5, J._numbers(tokens(1, 2, 3, 4, 5))) == [(9, 1)] and group.links(10, 9, 5, J._numbers(tokens(1, 2, 3, 4, 5))) == []


def test_kin(spark):
    """Of a family that shares a passage's token only those members are compared that share enough tokens, whatever they have of their own."""
    rows = [(1, i, i, 100, 7) for i in range(1, 21)] + [(1, i, c, 100, 50 + k) for i, c in ((30, 30), (31, 31), (32, 30)) for k in range(12)]
    rows += [(1, 40, 40, 100, 200 + k) for k in range(12)] + [(1, 41, 41, 200, 200 + k) for k in range(12)] + [(2, 50, 30, 100, 50 + k) for k in range(12)]
    df = spark.createDataFrame(rows, "gid long, node long, component long, n int, token long")
    assert sorted(map(tuple, J.kin(df).collect())) == [(1, 30, 30), (1, 31, 31), (1, 32, 30)]


def test_long_chain(spark):
    """Neighbours link, the ends do not: the class is the whole chain."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[4 * i : 4 * i + 60]) for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in J.similarity_classes(df).collect()} == {0}


def test_edges(spark, frame):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None), (2, "x y")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.component_id) for r in J.similarity_classes(df).collect()), key=str)
    assert out == sorted([(None, 5), (5, 5), (5, 5), (None, None), (2, 2)], key=str)
    assert J.similarity_classes(df.limit(0)).count() == 0
    kept = J.keep_one(frame("a b c d e f", "A b c d e f", "other words", None)).orderBy("doc_id").collect()
    assert [r.doc_id for r in kept] == [0, 2, 3] and kept[0].source == "s0"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P
    from test_native import brute_dedup, brute_hits
    from tessella.llm import language

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {r.doc_id: r for r in P.run(spark, folder).collect()}
    models = language.learn(docs)
    rows = sorted(((r.doc_id, r.text) for r in language.identify(docs, models).where("not rejected").collect()))
    deduped = brute_dedup([t for _, t in rows])
    rows = [(i, new) for (i, old), new in zip(rows, deduped) if not (old != new and not new.strip())]
    classes = brute([t for _, t in rows])
    rows = [r for k, (r, (_, c)) in enumerate(zip(rows, classes)) if c == k]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [r for r, (_, hit, _) in zip(rows, brute_hits([t for _, t in rows], items)) if not hit]
    assert sorted(out) == [i for i, _ in rows]
    import hashlib

    assert all(out[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in rows)
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
