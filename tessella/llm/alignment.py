"""Alignment of two tokenizers over the same texts, in Arrow inside Spark's tasks.

Both tokenizers cut a text's bytes. Token lists are flattened with the index of their document, running sums of token
bytes less those before the document give where each token ends, and a hash join on (document, end) links the tokens
that end together. Between two common ends lies a group: some tokens of A against some of B.

How often two ids are linked is counted in two steps: each chunk of documents counts its own pairs, Spark adds them up,
and each chunk asks for each of its distinct pairs once. A document keeps its pairs as numbers of its chunk's list.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import bpe
from tessella.llm._shared import documents, give_back, hex_sha256, materialise, portions, set_aside, with_columns

#: Bytes of text that share a list of pairs; a document of more is a chunk of its own.
CHUNK_BYTES = 16_000_000
#: Words whose pieces a worker remembers before it starts anew, and their longest, in characters. Speed only.
REMEMBERED, LONGEST = 400_000, 64
COUNTS = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long"}
WEIGHTS = {"n_best": "long", "count_sum": "long"}
#: What weigh() needs of align(): the document's pairs, and with one document of each chunk the chunk's pairs.
PRIVATE = {"_chunk": "long", "_pairs": "binary", "_codes": "array<long>", "_counts": "array<long>"}


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Byte:
    """A byte-level BPE file. It encodes a space and the text, strings of special tokens as plain text."""

    def __init__(self, path: str):
        self.coder = bpe.encoder(path, specials=False, library=True)
        self.bytes_of = self.coder.bytes_of

    def encode(self, texts: list[str]) -> pa.ListArray:
        flat, ends = self.coder.encode([f" {t}" for t in texts])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))


class Piece:
    """A sentencepiece model. It puts a space before the text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Where no piece has a space after another character and texts are taken as they are, no merge crosses the end of
        #: a word, and words with the spaces before them are encoded each for itself.
        odd = "ﬁ\u3000Å\tx  y"
        self.by_words = all(" " not in p.replace("▁", " ").lstrip(" ") for p in pieces) and self.model.decode(self.model.encode(odd)) == odd
        self.words, self.memo = re.compile(" [ ]*[^ ]+").findall, _Memo(self.model)

    def encode(self, texts: list[str]) -> pa.ListArray:
        if not self.by_words:
            return pa.array(self.model.encode(texts, num_threads=1), pa.list_(pa.int32()))
        known = self.memo.__getitem__
        # The sign that stands for a space in pieces is one in texts too. A text that ends with a space has no word for it.
        texts = [t.replace("▁", " ") for t in texts]
        coded = [np.array(self.model.encode(t), "<i4").tobytes() if t.endswith(" ") else b"".join(map(known, self.words(f" {t}"))) for t in texts]
        ends = np.cumsum([0, *map(len, coded)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), "<i4")))


class _Memo(dict):
    """The ids of words, which begin with a space, as bytes of 32-bit numbers."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.model.encode(word[1:]), "<i4").tobytes()
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Byte | Piece:
    """One tokenizer of a file for each worker process: of a JSON file a byte-level BPE, else a sentencepiece model."""
    return Byte(path) if path.endswith(".json") else Piece(path)


class Side:
    """The tokens of a portion's documents under one tokenizer: ids, document of each, and where in the portion's bytes it ends."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.spelled = pa.array(self.tokenizer.bytes_of, pa.large_binary())
        #: Each id in decimal with what may follow it: nothing, or one of the three signs.
        self.named = pa.array([f"{i}{sign}" for i in range(len(self.spelled)) for sign in ("", ",", "|", ";")], pa.large_string())

    def tokens(self, texts: list[str]) -> tuple[pa.ListArray, pa.LargeBinaryArray]:
        lists = self.tokenizer.encode(texts)
        return lists, self.spelled.take(pc.list_flatten(lists))


def _offsets(values: pa.Array) -> np.ndarray:
    return np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]


def _joined(spelled: pa.LargeBinaryArray, ends: np.ndarray) -> list[bytes]:
    """The bytes of the tokens up to each of the token numbers `ends`."""
    at, data = _offsets(spelled), spelled.buffers()[2]
    stops = at[ends]
    return [data[a:b].to_pybytes() if data is not None else b"" for a, b in zip(np.concatenate([[at[0]], stops[:-1]]), stops)]


class Aligner:
    """Aligns portions of texts under two tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Side(path_a), Side(path_b)
        self.size_b = len(self.b.spelled)

    def tokens(self, texts: list[str | None]) -> tuple[list[int], list]:
        """Of the texts that both tokenizers give back byte by byte: their places, and the tokens of each side."""
        places = [i for i, t in enumerate(texts) if t]
        while True:
            kept = [texts[i] for i in places]
            sides = [s.tokens(kept) for s in (self.a, self.b)]
            want = b"".join(f" {t}".encode("utf-8", "replace") for t in kept)
            if all((x.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[: len(want) + 1] == want for _, x in sides):
                ends = [lists.offsets.to_numpy()[1:] for lists, _ in sides]
                sizes = np.cumsum([len(t.encode("utf-8", "replace")) + 1 for t in kept])
                if all((_offsets(x)[e] == sizes).all() for e, (_, x) in zip(ends, sides)):
                    return places, sides
            whole = [_joined(x, lists.offsets.to_numpy()[1:]) for lists, x in sides]
            places = [p for p, t, *own in zip(places, kept, *whole) if all(o == f" {t}".encode("utf-8", "replace") for o in own)]

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray | pa.Array]:
        """For each text n_a, n_b, n_groups, n_links and groups; for all, the links of each document by pair: whose, code, n."""
        places, sides = self.tokens(texts)
        n = len(places)
        tables, keys, firsts = [], [], []
        for (lists, spelled), name in zip(sides, "ab"):
            parent = pc.list_parent_indices(lists)
            # A running sum over all tokens, less what stood before the token's document: where it ends in its own text.
            running = pc.cumulative_sum(pc.binary_length(spelled).cast(pa.int64()))
            before = pa.array(_offsets(spelled)[lists.offsets.to_numpy()[:-1]] - (_offsets(spelled)[0] if len(spelled) else 0), pa.int64())
            end = pc.subtract(running, before.take(parent))
            key = pc.add(pc.shift_left(parent.cast(pa.int64()), pa.scalar(40, pa.int64())), end)
            tables.append(pa.table({"key": key, name: pc.list_flatten(lists)}))
            keys.append(key.to_numpy())
            firsts.append(lists.offsets.to_numpy())
        linked = tables[0].join(tables[1], "key", join_type="inner", use_threads=False).combine_chunks()
        key = linked["key"].to_numpy()
        whose = (key >> 40).astype(np.int64)
        common = np.sort(key)
        common = common[np.diff(common, prepend=-1) > 0]
        codes = pa.table({"doc": whose, "code": linked["a"].to_numpy().astype(np.int64) * self.size_b + linked["b"].to_numpy()})
        pairs = codes.group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
        spread = lambda counts: self._spread(counts, places, len(texts))
        return {
            "n_a": spread(np.diff(firsts[0])), "n_b": spread(np.diff(firsts[1])), "n_groups": spread(np.bincount((common >> 40).astype(np.int64), minlength=n)),
            "n_links": spread(np.bincount(whose, minlength=n)), "groups": self._groups(sides, keys, firsts, common, places, len(texts)),
            "whose": np.array(places, np.int64)[pairs["doc"].to_numpy()] if n else np.zeros(0, np.int64), "code": pairs["code"].to_numpy(), "n": pairs["count_all"].to_numpy(),
        }

    @staticmethod
    def _spread(counts: np.ndarray, places: list[int], size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        out[places] = counts
        return out

    def _groups(self, sides, keys, firsts, common, places, size) -> pa.Array:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`: all ids in their order, each with the sign that follows it."""
        of = [np.searchsorted(common, k) for k in keys]
        counts = [np.bincount(g, minlength=len(common)) for g in of]
        before = [np.cumsum(c) - c for c in counts]
        # A token's place: the tokens of its own side before it, and those of the other side that stand in groups before (B: up to) its own.
        place_a = np.arange(len(of[0])) + before[1][of[0]]
        place_b = np.arange(len(of[1])) + (before[0] + counts[0])[of[1]]
        sign_a = np.ones(len(of[0]), np.int64)
        sign_a[before[0] + counts[0] - 1] = 2
        sign_b = np.ones(len(of[1]), np.int64)
        sign_b[before[1] + counts[1] - 1] = 3
        sign_b[firsts[1][1:] - 1] = 0
        ids = [pc.list_flatten(lists).to_numpy().astype(np.int64) for lists, _ in sides]
        where = np.empty(len(place_a) + len(place_b), np.int64)
        where[place_a] = ids[0] * 4 + sign_a
        where[place_b] = ids[1] * 4 + sign_b + len(self.a.named)
        written = self._names.take(pa.array(where))
        stops = np.zeros(size, np.int64)
        stops[places] = np.diff(_offsets(written)[firsts[0] + firsts[1]]) if len(places) else 0
        ends = np.concatenate([[0], np.cumsum(stops)])
        data = written.buffers()[2] if len(written) else pa.py_buffer(b"")
        return pa.LargeStringArray.from_buffers(size, pa.py_buffer(ends), data).cast(pa.string())

    @property
    def _names(self) -> pa.Array:
        if not hasattr(self, "_all_names"):
            self._all_names = pa.concat_arrays([self.a.named, self.b.named])
        return self._all_names


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _packed(numbers: np.ndarray, n: np.ndarray) -> bytes:
    """A document's pairs: their numbers in the chunk, sorted, as steps, and how often each is linked."""
    order = np.argsort(numbers)
    steps = np.diff(numbers[order], prepend=0)
    kind = "<u2" if steps.max(initial=0) < 1 << 16 else "<u4"
    wide = "u1" if n.max(initial=0) < 1 << 8 else "<u4"
    return bytes([kind == "<u2", wide == "u1"]) + steps.astype(kind).tobytes() + n[order].astype(wide).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind, wide = np.dtype("<u2" if data[0] else "<u4"), np.dtype("u1" if data[1] else "<u4")
    size = (len(data) - 2) // (kind.itemsize + wide.itemsize)
    return np.cumsum(np.frombuffer(data, kind, size, 2).astype(np.int64)), np.frombuffer(data, wide, size, 2 + size * kind.itemsize).astype(np.int64)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, column: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links and groups (`a1,a2|b1;a3|b2,b3`: the ids of A and B group by group).

    Whole texts of any length are cut. A text that is null or empty, or that one of the tokenizers does not give back
    byte by byte with a space before it, has no tokens: zeros and an empty text. Rows stand for themselves, so repeated
    rows need no rule; an empty table gives an empty result. Columns that begin with an underscore are for weigh(),
    which wants the result written. Further columns pass through, clashing ones as `<name>_in`.
    """
    defaults = default_tokenizers()
    path_a, path_b = path_a or defaults[0], path_b or defaults[1]
    results = {**COUNTS, "groups": "string", **PRIVATE}
    work, back = set_aside(docs, [column], [*results, *WEIGHTS])

    def run(batches):
        tools = aligner(path_a, path_b)
        held, size, number = [], 0, 0
        first = _task() << 32

        def closed(number):
            """The rows of a chunk: the pair that is linked most has number 0."""
            whose = np.concatenate([x["whose"] + s for (_, x), s in zip(held, np.cumsum([0, *(b.num_rows for b, _ in held)]))])
            code, n = (np.concatenate([x[k] for _, x in held]) for k in ("code", "n"))
            codes, at = np.unique(code, return_inverse=True)
            counts = np.bincount(at, n, len(codes)).astype(np.int64)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            numbers, by = rank[at], np.argsort(whose, kind="stable")
            edges = np.searchsorted(whose[by], np.arange(sum(b.num_rows for b, _ in held) + 1))
            row = 0
            for i, (batch, x) in enumerate(held):
                own = [by[edges[r] : edges[r + 1]] for r in range(row, row + batch.num_rows)]
                row += batch.num_rows
                lead = [codes[order], counts[order]] if i == 0 else [None, None]
                more = {k: pa.array(x[k]) for k in COUNTS} | {"groups": x["groups"], "_chunk": pa.array([first + number] * batch.num_rows, pa.int64()), "_pairs": pa.array([_packed(numbers[o], n[o]) for o in own], pa.binary())}
                more |= {k: pa.array([v, *[None] * (batch.num_rows - 1)], pa.list_(pa.int64())) for k, v in zip(("_codes", "_counts"), lead)}
                yield with_columns(batch, **more)

        for batch in portions(batches, column):
            texts = batch.column(batch.schema.get_field_index(column))
            nbytes = pc.sum(pc.binary_length(texts)).as_py() or 0
            if held and size + nbytes > chunk_bytes:
                yield from closed(number)
                held, size, number = [], 0, number + 1
            held.append((batch, tools.align(texts.to_pylist())))
            size += nbytes
        if held:
            yield from closed(number)
        give_back()

    schema = T.StructType([*work.schema.fields, *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in results.items())).fields])
    return back(work.mapInArrow(run, schema).withColumns({c: F.lit(None) for c in WEIGHTS})).drop(*WEIGHTS)


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def pair_counts(aligned: DataFrame, path_b: str | None = None) -> DataFrame:
    """Of written rows of align(): a, b and n, the links of the two ids in all documents. No two rows have the same ids."""
    size = len(tokenizer(path_b or default_tokenizers()[1]).bytes_of)
    return _totals(aligned).select(F.expr(f"_code div {size}").alias("a"), (F.col("_code") % size).alias("b"), F.col("_n").alias("n"))


def _totals(aligned: DataFrame) -> DataFrame:
    own = aligned.where("_codes IS NOT NULL").select(F.explode(F.arrays_zip("_codes", "_counts")).alias("p"))
    return own.groupBy(F.col("p._codes").alias("_code")).agg(F.sum("p._counts").alias("_n"))


def weigh(aligned: DataFrame, path_b: str | None = None) -> DataFrame:
    """Written rows of align() with n_best (links whose count is the highest of their B id) and count_sum (over links).

    Counts are of all documents. Each chunk's distinct pairs are looked up once by a shuffle; the highest count of each B
    id is a row an id, so its size is bound by the vocabulary. Ties are all best. Columns for weigh() are left out.
    """
    size = len(tokenizer(path_b or default_tokenizers()[1]).bytes_of)
    asked = aligned.where("_codes IS NOT NULL").select(F.col("_chunk").alias("_of"), F.posexplode("_codes").alias("_number", "_code"))
    total = materialise(_totals(aligned))
    highest = total.groupBy((F.col("_code") % size).alias("_b")).agg(F.max("_n").alias("_top"))
    known = total.withColumn("_b", F.col("_code") % size).join(F.broadcast(highest), "_b").select("_code", "_n", (F.col("_n") == F.col("_top")).alias("_best"))
    answers = asked.join(known, "_code").select("_of", "_number", "_n", "_best")
    kept = [c for c in aligned.columns if c not in PRIVATE]
    rows = aligned.select("_chunk", "_pairs", *kept)
    schema = T.StructType([*rows.select(*kept).schema.fields, *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in WEIGHTS.items())).fields])

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        n, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)
        at = found["_number"].to_numpy()
        n[at] = found["_n"].to_numpy()
        best[at] = found["_best"].to_numpy(zero_copy_only=False)
        sums = []
        for x in docs["_pairs"]:
            numbers, times = _unpacked(x.as_py())
            sums.append((int((best[numbers] * times).sum()), int((n[numbers] * times).sum())))
        return pa.table([docs[c] for c in kept] + [pa.array([s[i] for s in sums], pa.int64()) for i in range(2)], names=[*kept, *WEIGHTS])

    return rows.groupBy("_chunk").cogroup(answers.groupBy("_of")).applyInArrow(run, schema)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.when(F.col("n_a") > 0, hex_sha256("groups")).otherwise("")
    return weigh(materialise(aligned.withColumn("groups_sha256", digest).drop("text", "groups")))


QUERIES = {"op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment}
SQL: dict[str, str] = {}
