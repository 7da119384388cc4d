"""LM scoring by cross-entropy difference: a target model and a matched background model share one vocabulary.

The background is as many bytes of text as the target, drawn from all documents by a hash of doc_id. Both are counted
whole, by Spark; a document's score is the mean over its words of the loss under the target model less that under the
background model, so lower is nearer to the target.

The models keep every pair of both samples. Their number grows with the corpus, so the counts stay a written table:
documents are coded and dealt into chunks, a chunk asks for each of its distinct pairs once, and is scored with what
comes back. Only words, and a row for each context word, are broadcast; both are bounded by the vocabulary.
"""

from __future__ import annotations

from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import distinct, documents, drop_since, mark, materialise, most_frequent, narrowed, portions, set_aside, with_columns

#: Words of the shared vocabulary at most, the most frequent of both samples; others are one unknown word.
VOCABULARY = 50_000
#: Bytes of text, about, whose distinct pairs are asked for together.
CHUNK = 16_000_000
DISCOUNT = 0.75
UNKNOWN = 1  # 0 begins a text


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def samples(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """A written table of text, in_target, in_background: target documents, and as many bytes of documents drawn from all.

    A document may be in both samples and then has two rows. Rows without doc_id are in neither.
    """
    # The target grows with the corpus, so it is never broadcast, however small it is today.
    target = target_ids.select("doc_id").where("doc_id is not null").distinct()
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    every = docs.agg(F.sum(size).alias("n")).first().n or 0
    wanted = docs.select("doc_id", size.alias("_n")).join(target, "doc_id", "left_semi").agg(F.sum("_n").alias("n")).first().n or 0
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    drawn = chance < wanted / max(every, 1)
    # Texts travel for the target alone, of which a table of fixed size lets nearly no other document through.
    marked = narrowed(docs.select("doc_id", "text"), "doc_id", target).join(target.hint("merge"), "doc_id", "left_semi")
    rows = marked.select("text", F.lit(True).alias("in_target"), F.lit(False).alias("in_background")).unionAll(docs.where(drawn).select("text", F.lit(False), F.lit(True)))
    return materialise(rows.where("in_target or in_background"))


def count_words(sample: DataFrame) -> DataFrame:
    """word, target, background."""

    def run(batches):
        totals = (Counter(), Counter())

        def counted():
            listed = list(totals[0].keys() | totals[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(listed, pa.string()), *(pa.array([t[w] for w in listed], pa.int64()) for t in totals)], names=["word", "target", "background"])

        for batch in portions(batches):
            for text, *sides in zip(*(c.to_pylist() for c in batch.columns)):
                own = Counter(words(text))
                for total, side in zip(totals, sides):
                    if side:
                        total.update(own)
            if len(totals[0]) + len(totals[1]) > 500_000:
                yield counted()
                totals[0].clear(), totals[1].clear()
        yield counted()

    return sample.mapInArrow(run, "word string, target long, background long").groupBy("word").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def _codes(texts: list[str | None], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words of all texts, 0 before each text; the number of codes of each text."""
    get, flat, sizes = ids.get, [], []
    for text in texts:
        own = words(text)
        flat.append(0)
        flat += [get(w, UNKNOWN) for w in own]
        sizes.append(len(own) + 1)
    return np.array(flat, np.int32), np.array(sizes, np.int64)


def _paired(codes: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word of each text the word before it and itself, as one number, and the text that it is in."""
    keys = codes[:-1].astype(np.int64) * size + codes[1:]
    inner = np.ones(len(codes), bool)
    inner[np.cumsum(sizes) - sizes] = False
    return keys[inner[1:]], np.repeat(np.arange(len(sizes)), sizes - 1)


def _coded(texts: list[str | None], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    return _paired(*_codes(texts, ids), len(ids) + 2)


def count_pairs(sample: DataFrame, ids: dict[str, int]) -> DataFrame:
    """key, target, background for pairs of consecutive words, the first after the beginning of the text."""
    shared = sample.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        held: list[list[np.ndarray]] = [[], []]

        def counted():
            found = [np.unique(np.concatenate(h or [np.zeros(0, np.int64)]), return_counts=True) for h in held]
            every = distinct(np.concatenate([found[0][0], found[1][0]]))
            columns = [np.zeros(len(every), np.int64) for _ in found]
            for c, (k, n) in zip(columns, found):
                c[np.searchsorted(every, k)] = n
            return pa.RecordBatch.from_arrays([pa.array(every), *map(pa.array, columns)], names=["key", "target", "background"])

        for batch in portions(batches):
            texts, *sides = (c.to_pylist() for c in batch.columns)
            keys, whose = _coded(texts, shared.value)
            for h, side in zip(held, sides):
                h.append(keys[np.array(side, bool)[whose]])
            if sum(map(len, held[0])) + sum(map(len, held[1])) > 6_000_000:
                yield counted()
                held = [[], []]
        yield counted()

    return sample.mapInArrow(run, "key long, target long, background long").groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


class Side:
    """An interpolated model of word pairs with absolute discounting over a model of words.

    total and kinds are, for each word, the count and the number of all pairs that it begins; pairs are those at hand.
    """

    def __init__(self, word_counts: np.ndarray, total: np.ndarray, kinds: np.ndarray):
        size = len(word_counts)
        self.word = ((word_counts + 0.5) / (word_counts.sum() + 0.5 * size)).astype(np.float64)
        self.total, self.own = total, np.zeros(0)
        self.rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)

    def with_pairs(self, before: np.ndarray, pair_counts: np.ndarray) -> Side:
        out = object.__new__(Side)
        out.word, out.total, out.rest = self.word, self.total, self.rest
        out.own = np.maximum(pair_counts - DISCOUNT, 0) / np.maximum(self.total[before], 1)
        return out

    def loss(self, before: np.ndarray, word: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        own = np.where(known, self.own[at], 0.0) if len(self.own) else 0.0
        return -np.log(own + self.rest[before] * self.word[word])


class Sides:
    """Both models for texts whose pairs are among keys, or are pairs of neither sample."""

    def __init__(self, target: Side, background: Side, keys: np.ndarray | None = None):
        self.target, self.background, self.size = target, background, len(target.word)
        self.keys = np.zeros(0, np.int64) if keys is None else keys

    def with_pairs(self, keys: np.ndarray, target_pairs: np.ndarray, background_pairs: np.ndarray) -> Sides:
        keys, first = np.unique(keys, return_index=True)
        before = keys // self.size
        return Sides(self.target.with_pairs(before, target_pairs[first]), self.background.with_pairs(before, background_pairs[first]), keys)

    def score(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, and the mean loss of a word under the target and the background model (0 for a text without words)."""
        keys, whose = _paired(codes, sizes, self.size)
        before, word = keys // self.size, keys % self.size
        # Each distinct pair is looked up once, in order.
        own, which = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, own), max(len(self.keys) - 1, 0))[which]
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        n = sizes - 1
        mean = lambda side: np.bincount(whose, side.loss(before, word, at, known), len(sizes)) / np.maximum(n, 1)
        return n, mean(self.target), mean(self.background)


class Models:
    """The numbers of words, both models without their pairs, and the written table (key, target, background) of all pairs."""

    def __init__(self, ids: dict[str, int], bare: Sides, pairs: DataFrame):
        self.ids, self.bare, self.pairs, self.size = ids, bare, pairs, len(ids) + 2

    @cached_property
    def whole(self) -> Sides:
        """Both models with all pairs, in the driver: to look into those of small samples. Scoring does without."""
        rows = self.pairs.toPandas()
        return self.bare.with_pairs(*(rows[c].to_numpy(np.int64) for c in ("key", "target", "background")))

    keys = property(lambda self: self.whole.keys)
    target = property(lambda self: self.whole.target)
    background = property(lambda self: self.whole.background)


def learn(docs: DataFrame, target_ids: DataFrame, vocabulary: int = VOCABULARY) -> Models:
    """The models of docs (doc_id, text) for the documents of target_ids (doc_id). Counts are of all text of both samples."""
    start = mark()
    sample = samples(docs, target_ids)
    counted = materialise(count_words(sample))
    top = most_frequent(counted, F.col("target") + F.col("background"), vocabulary, "word").toPandas()
    ids = {w: i + 2 for i, w in enumerate(top.word)}
    size = len(ids) + 2
    every = counted.agg(F.sum("target").alias("t"), F.sum("background").alias("b")).first()
    pairs = materialise(count_pairs(sample, ids))
    sums = [x for c in ("target", "background") for x in (F.sum(c).alias(c), F.count_if(F.col(c) > 0).alias(f"{c}_kinds"))]
    contexts = pairs.groupBy(F.expr(f"key div {size}L").alias("before")).agg(*sums).toPandas()
    sides = []
    for column, total in (("target", every.t), ("background", every.b)):
        n, begun, kinds = np.zeros((3, size), np.float64)
        n[2:] = top[column].to_numpy()
        n[UNKNOWN] = (total or 0) - n.sum()
        begun[contexts.before] = contexts[column]
        kinds[contexts.before] = contexts[f"{column}_kinds"]
        sides.append(Side(n, begun, kinds))
    drop_since(docs.sparkSession, start, pairs)
    return Models(ids, Sides(*sides), pairs)


def coded(docs: DataFrame, models: Models) -> DataFrame:
    """docs with _codes, the numbers of a text's words, and _chunk: neighbouring rows of about CHUNK bytes share one."""
    shared = docs.sparkSession.sparkContext.broadcast(models.ids)

    def run(batches):
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in portions(batches):
            texts = batch.column(batch.schema.get_field_index("text"))
            codes, sizes = _codes(texts.to_pylist(), shared.value)
            yield with_columns(batch, _codes=pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(codes)), _chunk=pa.array(np.full(len(sizes), chunk)))
            held += texts.nbytes
            if held >= CHUNK:
                chunk, held = chunk + 1, 0

    more = [T.StructField("_codes", T.ArrayType(T.IntegerType())), T.StructField("_chunk", T.LongType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def asked_pairs(rows: DataFrame, size: int) -> DataFrame:
    """_chunk, key: the distinct pairs of each chunk of coded rows, again for each task that reads a part of it."""

    def run(batches):
        chunk, held = None, []

        def asked():
            keys = distinct(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk, np.int64)), pa.array(keys)], names=["_chunk", "key"])

        for batch in batches:
            own = batch.column(1).to_numpy()
            starts = np.nonzero(np.diff(own, prepend=-1))[0]
            for start, end in zip(starts, [*starts[1:], len(own)]):
                if own[start] != chunk and held:
                    yield asked()
                    held = []
                chunk = own[start]
                part = batch.column(0).slice(start, end - start)
                held.append(distinct(_paired(part.flatten().to_numpy(), part.value_lengths().to_numpy().astype(np.int64), size)[0]))
        if held:
            yield asked()

    return rows.select("_codes", "_chunk").mapInArrow(run, "_chunk long, key long")


def _planes(numbers: np.ndarray) -> bytes:
    """Rows of longs, byte by byte of equal weight, so that the shuffle's compression sees runs of zeros."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(*numbers.shape, 8).transpose(0, 2, 1).tobytes()


def _from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(3, 8, -1).transpose(0, 2, 1)).view(np.int64)[..., 0]


def packed_pairs(found: DataFrame) -> DataFrame:
    """_chunk, pairs: key, target and background of what a task found for a chunk, as few rows."""

    def run(batches):
        held, n = [], 0

        def packed():
            chunk, *rest = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(chunk, kind="stable")
            chunk, rest = chunk[order], np.stack(rest)[:, order]
            starts = np.nonzero(np.diff(chunk, prepend=-1))[0]
            ends = [*starts[1:], len(chunk)]
            return pa.RecordBatch.from_arrays([pa.array(chunk[starts]), pa.array([_planes(rest[:, i:j]) for i, j in zip(starts, ends)], pa.binary())], names=["_chunk", "pairs"])

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                n += batch.num_rows
            if n > 1_000_000:
                yield packed()
                held, n = [], 0
        if held:
            yield packed()

    return found.select("_chunk", "key", "target", "background").mapInArrow(run, "_chunk long, pairs binary")


def scored(rows: DataFrame, models: Models) -> DataFrame:
    """Coded rows with their scores. Neither join may turn into a broadcast: both sides grow with the corpus."""
    rows = materialise(rows)
    found = packed_pairs(asked_pairs(rows, models.size).join(models.pairs.hint("merge"), "key"))
    shared = rows.sparkSession.sparkContext.broadcast(models.bare)
    fields = [f for f in rows.schema.fields if f.name not in ("_codes", "_chunk")]

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        every = [_from_planes(x) for x in pairs.column("pairs").to_pylist()]
        sides = shared.value.with_pairs(*np.concatenate(every, 1)) if every else shared.value
        results = []
        for batch in texts.to_batches(max_chunksize=500):
            codes = batch.column(batch.schema.get_field_index("_codes"))
            results.append(sides.score(codes.flatten().to_numpy(), codes.value_lengths().to_numpy().astype(np.int64)))
        n, target, background = (np.concatenate(x) if x else np.zeros(0) for x in zip(*results)) if results else [np.zeros(0)] * 3
        out = texts.select([f.name for f in fields])
        for name, values in (("n_words", n.astype(np.int64)), ("loss_target", target), ("loss_background", background), ("lm_score", target - background)):
            out = out.append_column(name, pa.array(values))
        return out

    more = [T.StructField("n_words", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in ("loss_target", "loss_background", "lm_score"))]
    return rows.groupBy("_chunk").cogroup(found.groupBy("_chunk")).applyInArrow(run, T.StructType([*fields, *more]))


def score(docs: DataFrame, models: Models) -> DataFrame:
    """docs with n_words, loss_target, loss_background and lm_score (their difference, in nats a word).

    Null and empty texts have no words and score 0; whole texts of any length are scored. Work is by row: ties and
    repeated rows need no rule, and an empty table gives an empty result. Further columns pass through; one that has a
    result's name is given back as `<name>_in`.
    """
    work, back = set_aside(docs, ["text"], ["n_words", "loss_target", "loss_background", "lm_score"])
    return back(scored(coded(work, models), models))


def good_documents(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that labels call good and not toxic."""
    is_good: Column = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where(is_good).select("doc_id")


def op6_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    models = learn(docs, good_documents(documents(spark, sf_dir, "labels")))
    out = scored(coded(docs, models).drop("text"), models)
    return out.select("doc_id", "n_words", *(F.round(x, 6).alias(x) for x in ("loss_target", "loss_background", "lm_score")))


QUERIES = {"op6_cross_entropy_difference": op6_cross_entropy_difference}
SQL: dict[str, str] = {}
