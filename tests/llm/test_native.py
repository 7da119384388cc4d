"""The operators of DataFrame functions alone, against brute force: sharding, decontamination, line dedup, line frequency."""

import random
import re
import zlib
from collections import Counter

import pytest
from oracle import same

from pyspark.sql import functions as F

from tessella.llm import decontamination, line_dedup, quality, sharding

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module", [decontamination, line_dedup, quality])
def test_sql(spark, module):
    for name, sql in module.SQL.items():
        same(spark, module.QUERIES[name], sql, FOLDER)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 50, 1000])
def test_permutation_is_a_bijection(spark, n):
    df = sharding.permuted(spark.range(n).selectExpr("id as row_no", f"{n}L as n_rows"))
    assert sorted(r.position for r in df.collect()) == list(range(n))


def test_shards_are_even_and_reproducible(spark, frame):
    df = frame(*(f"t{i % 5}" if i % 7 else None for i in range(203)))
    runs = [{r.doc_id: (r.shard, r.slot) for r in sharding.shard(d, ["doc_id", "text"]).collect()} for d in (df, df.repartition(5))]
    assert runs[0] == runs[1]
    counts = Counter(s for s, _ in runs[0].values())
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(slot for shard, slot in runs[0].values() if shard == s) == list(range(n))


def test_sharding_of_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a")] * 5 + [(1, "a")] * 5 + [(1, None)], "doc_id long, text string")
    rows = sharding.shard(df, ["doc_id", "text"], 3).collect()
    assert sorted((r.shard, r.slot) for r in rows) == sorted((i % 3, i // 3) for i in range(11))


def test_op5_contract(spark):
    rows = sharding.op5_feistel_sharding(spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def brute_hits(texts, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(len(w), width)
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for win, ids in windows.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    found |= ids
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontamination_by_brute_force(spark, frame):
    rng = random.Random(3)
    vocab = ["ab", "Cd", "É", "x1", "zz"]
    items = [(i, " ".join(rng.choices(vocab, k=k))) for i, k in enumerate([3, 10, 12, 1, 14])] + [(8, None), (9, "..."), (10, "zz")]
    texts = ["; ".join(rng.choices(vocab, k=rng.randint(0, 60))) for _ in range(40)] + [None, "", "!!", items[4][1].upper(), f"x {items[1][1]} {items[1][1]} y"]
    texts += texts[:3]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = sorted(decontamination.scan(frame(*texts), bench).collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.n_hit, list(r["items"])) for r in out] == brute_hits(texts, items)
    many = decontamination.BROADCAST_BYTES
    try:
        decontamination.BROADCAST_BYTES = 0  # the join of large benchmarks
        again = sorted(decontamination.scan(frame(*texts), bench).collect(), key=lambda r: r.doc_id)
    finally:
        decontamination.BROADCAST_BYTES = many
    assert [(r.n_words, r.n_hit) for r in again] == [(r.n_words, r.n_hit) for r in out]


def test_decontamination_edges(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontamination.scan(frame("a b", None), none).collect()] == [0, 0]
    assert decontamination.scan(frame("a").limit(0), none).count() == 0
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(frame("x, One  two! y", "one", None), bench).collect()}
    assert cut == {0: "x, y", 1: "one", 2: None}
    assert [r.doc_id for r in decontamination.decontaminate(frame("x one two", "clean", None), bench).orderBy("doc_id").collect()] == [1, 2]
    dirty = frame("one two").withColumnRenamed("source", "n_lines")
    assert decontamination.scan(dirty, bench).first().n_hit == 2


def brute_dedup(texts, width=3):
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip()
    first, out = set(), []
    for t in texts:
        lines = t.split("\n")
        at = [i for i, x in enumerate(lines) if norm(x)]
        gone = set()
        for a in range(len(at) - width + 1):
            key = tuple(norm(lines[i]) for i in at[a : a + width])
            if key in first:
                gone |= set(at[a : a + width])
            first.add(key)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup_by_brute_force(spark, frame):
    rng = random.Random(5)
    texts = ["\n".join(rng.choices(["a b", "A  B", "c", "d", "", "e f"], k=rng.randint(0, 14))) for _ in range(60)]
    out = line_dedup.dedup_lines(frame(*texts)).orderBy("doc_id").collect()
    assert [r.text for r in out] == brute_dedup(texts)


def test_line_dedup_edges(spark, frame):
    df = frame(None, "", "x\ny", "a\nb\nc", "a\nb\nc\n\nd", "\n" * 5)
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    assert out == {0: (None, 0, 0), 1: ("", 0, 0), 2: ("x\ny", 2, 0), 3: ("a\nb\nc", 3, 0), 4: ("\nd", 4, 3), 5: ("\n" * 5, 0, 0)}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, "a\nb\nc"), (None, "a\nb\nc")], "doc_id long, text string")
    assert [r.n_removed for r in line_dedup.dedup_lines(lost).collect()] == [0, 0]


def test_line_dedup_where_a_doc_id_has_two_texts(spark):
    """Each row loses what is its own and nothing is lost altogether, in the operator and in the stage of the pipeline."""
    import corpus_pipeline as P

    short, long = "a\nb\nc", "x\ny\nz\na\nb\nc"
    df = spark.createDataFrame([(1, short), (1, long), (1, long), (2, "d\n" + short)], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    rows = line_dedup.dedup_lines(df).collect()
    assert all(r.n_removed == r.n_lines - len((r.text or "").split()) for r in rows if r.n_removed)
    left = [r.text for r in rows if r.doc_id == 1]
    assert sorted(left) in (sorted([short, "x\ny\nz", "x\ny\nz"]), sorted(["", long, long])) and [r.text for r in rows if r.doc_id == 2] == ["d"]
    kept = [r.text for r in P.lines(spark, df, FOLDER).collect()]
    assert sorted(kept) in (sorted([short, "x\ny\nz", "x\ny\nz", "d"]), sorted([long, long, "d"]))


def test_repeated_words_by_brute_force(spark, frame):
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abcd", k=rng.randint(0, 40))) for _ in range(80)] + [None, "", "a b", "x " * 3000, "a\tb\nc a b c"]
    out = {r.doc_id: r.n_repeat_words for r in quality.base_counts(frame(*texts)).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {p for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
        assert out[i] == len(hit), t


def test_boilerplate(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    line = " ".join(["notice"] * 1 + [f"n{k}" for k in range(59)])
    rows = [(i, f"{line}\n{own(i)}", "h") for i in range(30)] + [(100, line, "h"), (101, line, "other"), (102, None, "h"), (103, own(1), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality.judge(df).collect()}
    assert all(out[i].kept for i in range(30)) and not out[100].kept and out[101].kept and not out[102].kept and out[103].kept
    assert out[100].boilerplate_words == 60 and out[101].boilerplate_words == 0
    left = {r.doc_id: r.text for r in quality.without_boilerplate(df).collect()}
    assert left[0] == own(0) and left[100] == "" and left[101] == line and left[102] is None
    assert quality.judge(df.limit(0)).count() == 0


def test_rows_of_one_document_count_once(spark):
    own = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, own, "h")] * 30 + [(2, own, None), (3, own, "")], "doc_id long, text string, source string")
    out = quality.judge(df).collect()
    assert {(r.doc_id, r.boilerplate_words, r.kept) for r in out} == {(1, 0, True), (2, 0, True), (3, 0, True)} and len(out) == 32
    many = spark.createDataFrame([(i, own, None if i % 2 else "") for i in range(22)] + [(0, own, "")] * 3, "doc_id long, text string, source string")
    assert {r.boilerplate_words for r in quality.judge(many).collect()} == {60}  # null and empty are one host; copies of a row have their own words


LONG = "\n".join(f"line {i} of a long text" for i in range(20_000))
CLASHES = ["n_lines", "N_Words", "items", "_w", "_h", "starts", "rejected", "ids", "shard", "row_no", "kept", "_x0", "decoded", "lm_score"]


def clashing(spark, *texts):
    """documents whose further columns have the names of results and of columns that operators make."""
    rows = [(i, t, "en", "h", len(t or ""), *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES))


def test_clashing_names_long_texts_and_empty_tables(spark):
    from tessella.llm import bpe, jaccard_join, language, lm_scoring

    df = clashing(spark, LONG, LONG, None, "", "a b c d e f g", "a b c d e f g")
    bench = spark.createDataFrame([(1, "d e f")], "item_id long, text string")
    models, target = language.learn(df), spark.createDataFrame([(4,)], "doc_id long")
    scores = lm_scoring.learn(df, target)
    made = {
        "scan": lambda x: decontamination.scan(x, bench), "dedup": line_dedup.dedup_lines, "judge": quality.judge, "shard": lambda x: sharding.shard(x, ["doc_id"]),
        "identify": lambda x: language.identify(x, models), "encode": bpe.encode, "decode": lambda x: bpe.decode(bpe.encode(x)), "score": lambda x: lm_scoring.score(x, scores),
    }
    for name, make in made.items():
        out = make(df)
        low = [c.lower() for c in out.columns]
        assert len(set(low)) == len(low), name
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == 6, name
        given = {c: next(o for o in out.columns if o in (c, f"{c}_in", f"{c}_in_in") and rows[0][o] == f"{c}0") for c in CLASHES}
        assert all(rows[i][given[c]] == f"{c}{i}" for i in rows for c in CLASHES), name
        assert make(df.limit(0)).count() == 0, name
    for name, keep in {"decontaminate": lambda x: decontamination.decontaminate(x, bench), "cut": lambda x: decontamination.remove_spans(x, bench), "boilerplate": quality.without_boilerplate, "one": jaccard_join.keep_one}.items():
        assert keep(df).columns == df.columns, name
        assert sorted(r.n_lines for r in keep(df).collect()) == [f"n_lines{i}" for i in {"decontaminate": range(4), "one": (0, 2, 3, 4)}.get(name, range(6))], name


def test_stages_on_odd_tables(spark):
    import corpus_pipeline as P

    df = clashing(spark, LONG, LONG, None, "", "a b c d e f g", "a b c d e f g", *[f"more words of text {i} and more" for i in range(30)])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, FOLDER)
        assert out.columns == df.columns, name
        rows = out.collect()
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES) and len(rows) > 1, name
        assert stage(spark, df.limit(0), FOLDER).count() == 0, name
    coded = P.STAGES[-1][1](spark, df, FOLDER).collect()
    assert len(coded) == 36 and {r.n_tokens for r in coded if r.doc_id in (2, 3)} == {0}


def test_slot_table_by_few_jobs(spark):
    """The table of windows comes to the driver by one query, not by a job for each partition."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "40")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    windows = decontamination.item_windows(session.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "x y")], "item_id long, text string"))
    spark.sparkContext.setJobGroup("slots", "slots")
    try:
        decontamination._slot_table(windows, 10)
        assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("slots")) < 10
    finally:
        for name in ("spark.job.description", "spark.jobGroup.id"):
            spark.sparkContext.setLocalProperty(name, None)


def test_decontamination_without_python_or_literals(spark, tmp_path):
    """No job of the scan runs Python on the executors, and the set of windows is no part of the plans that the driver holds."""
    items = [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(60)] + [(100, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    docs = spark.createDataFrame([(1, f"a {items[7][1]} b"), (2, "One, two!"), (3, "clean")], "doc_id long, text string")
    held = spark._jsparkSession.sharedState().statusStore()
    before = held.executionsCount()
    decontamination.decontaminate(docs, bench).write.parquet(str(tmp_path / "kept"))
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "kept")).collect()] == [3]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = held.executionsList(int(before), 1000)
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size())]
    assert any("scalar-subquery" in x or "Subquery" in x for x in plans)
    assert not [x for x in plans if re.search("InArrow|InPandas|EvalPython", x)]
    assert max(map(len, plans)) < 100_000, max(map(len, plans))


def test_decontamination_rows_carry_no_table(spark, frame):
    """The tables of windows are values inside expressions: no column of a row holds one."""
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "x y")], "item_id long, text string")
    docs = frame("x y", "a b c d e f g h i j k", None)
    scanned = decontamination.scan(docs, bench)
    for out in (scanned, scanned.select("doc_id", "n_hit"), scanned.select("spans"), decontamination.decontaminate(docs, bench), decontamination.remove_spans(docs, bench)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "scalar-subquery" in plan and not re.search(r"scalar-subquery#\d+ \[[^\]]*\] AS |\b_(t\d+|set)#", plan), plan
