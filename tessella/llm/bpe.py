"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words.

The words of a text (as the tokenizer's pattern cuts them) are looked up in an automaton that shares prefixes and
suffixes and gives each accepted word its number, which leads to the word's ids. The workers of a machine map one file of
it. Words that it doesn't accept are merged by the tokenizer's ranks. Both give the ids that the tokenizer itself gives,
so neither the lexicon's size nor the number of words that a worker remembers changes a result.
"""

from __future__ import annotations

import copy
import hashlib
import heapq
import json
import os
import re
import struct
import tempfile
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import documents, drop_since, give_back, hex_sha256, mark, materialise, most_frequent, portions, set_aside, with_columns

#: Words of the lexicon; the driver gets this many at most, and executors an automaton of about 20 bytes for each.
LEXICON_WORDS = 32_768
#: Longest word of the lexicon, in bytes.
LONGEST = 48
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 120_000
#: The same where the library merges words one by one, which needs no lexicon and so has more memory to spare.
REMEMBERED_ALONE = 800_000
#: Unseen words of up to so many bytes are merged together, in arrays of that width; longer ones one by one.
TOGETHER = (8, 16, 32)
#: The pattern that cuts texts into words, as byte-level tokenizers of this family define it. Fixed value.
#: What cuts texts has letters and digits before the contractions: a word of theirs never begins with an apostrophe, so the
#: cuts are the same, in less time.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Latin letters, and signs that are neither letters, digits nor white space. Texts of these, ASCII digits and blanks alone
#: are cut by the standard library's faster expressions, in which the same pattern needs its classes spelled out.
LATIN, SIGNS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", "\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\u2010-\u2027\u2030-\u205e\u20a0-\u20bf"
_OTHER = re.compile(f"[^\t-\r -~{LATIN}{SIGNS}]").search
_LATIN_WORDS = re.compile(rf" ?[{LATIN}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+").findall
_ANY_WORDS = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Automaton:
    """A minimal acyclic automaton over byte strings that numbers what it accepts, 0 .. n-1 in sorted order.

    Three arrays: `keys` (state * 256 + byte, sorted), and for each such edge `target` and `skipped`, the words that
    sort before those below the edge and come from the same state. The sum of skipped along a word's path is its number.
    """

    def __init__(self, keys, target, skipped, final):
        self.keys, self.target, self.skipped, self.final = keys, target, skipped, final

    @classmethod
    def of(cls, words: list[bytes]) -> "Automaton":
        """Compile sorted distinct words. A state is made when no later word can change it, and equal states are one."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        below: list[int] = []
        path: list[list] = [[False, []]]  # for each prefix of the last word: final, edges

        def freeze(node) -> int:
            key = (node[0], tuple(node[1]))
            at = register.get(key)
            if at is None:
                at = register[key] = len(states)
                states.append(key)
                below.append(node[0] + sum(below[t] for _, t in node[1]))
            return at

        last = b""
        for word in words:
            common = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            for i in range(len(last), common, -1):
                done = freeze(path.pop())
                path[-1][1].append((last[i - 1], done))
            path += [[False, []] for _ in word[common:]]
            path[-1][0] = True
            last = word
        for i in range(len(last), 0, -1):
            done = freeze(path.pop())
            path[-1][1].append((last[i - 1], done))
        root = freeze(path[0])
        order = [root, *(i for i in range(len(states)) if i != root)]  # the root is state 0
        number = {old: new for new, old in enumerate(order)}
        keys, target, skipped = [], [], []
        for new, old in enumerate(order):
            before = int(states[old][0])
            for label, to in sorted(states[old][1]):
                keys.append(new * 256 + label)
                target.append(number[to])
                skipped.append(before)
                before += below[to]
        final = [states[old][0] for old in order]
        return cls(np.array(keys, np.uint64), np.array(target, np.uint32), np.array(skipped, np.uint32), np.array(final, np.bool_))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those that are not accepted. All words take their steps together."""
        size = np.fromiter((len(w) for w in words), np.int64, len(words))
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.keys):
            return out
        data, start = np.frombuffer(b"".join(words) or b"\0", np.uint8), np.cumsum(size) - size
        alive, state, number = np.nonzero(size > 0)[0], np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
        step = 0
        while len(alive):
            key = state[alive] * np.uint64(256) + data[start[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            alive, at = alive[ok], at[ok]
            state[alive] = self.target[at]
            number[alive] += self.skipped[at]
            step += 1
            ended = size[alive] == step
            stops = alive[ended]
            accepted = stops[self.final[state[stops].astype(np.int64)]]
            out[accepted] = number[accepted]
            alive = alive[~ended]
        return out


def _pack(arrays: list[np.ndarray]) -> bytes:
    heads = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    parts = [len(heads).to_bytes(8, "little"), heads]
    at = 8 + len(heads)
    for a in arrays:
        parts += [b"\0" * (-at % 16), a.tobytes()]
        at += -at % 16 + a.nbytes
    return b"".join(parts)


def _mapped(path: str) -> list[np.ndarray]:
    """The arrays of _pack() as views of a memory-mapped file."""
    data = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(data[:8].tobytes(), "little")
    at, out = 8 + n, []
    for kind, length in json.loads(data[8 : 8 + n].tobytes()):
        at += -at % 16
        size = np.dtype(kind).itemsize * length
        out.append(data[at : at + size].view(kind))
        at += size
    return out


def _handed_out(spark: SparkSession, lexicon: bytes | None) -> str | None:
    """The name under which Spark brings the lexicon's file to each machine, once."""
    if lexicon is None:
        return None
    name = f"lexicon-{hashlib.sha256(lexicon).hexdigest()[:24]}.bin"
    path = os.path.join(_folder(), name)
    if not os.path.exists(path):
        with open(path, "wb") as f:
            f.write(lexicon)
    spark.sparkContext.addFile(path)
    return name


@lru_cache(maxsize=1)
def _folder() -> str:
    return tempfile.mkdtemp(prefix="tessella-lexicons-")


@lru_cache(maxsize=256)
def _pack_ids(n: int):
    return struct.Struct(f"<{n}i").pack


class _Memo(dict):
    """The ids of words as bytes of 32-bit numbers; a word that is not there is merged."""

    def __init__(self, coder: "Encoder"):
        self.coder = coder

    def __missing__(self, word: str) -> bytes:
        if len(self) >= (REMEMBERED if self.coder._model is None else REMEMBERED_ALONE):
            self.clear()
        coded = self.coder.merge(word)
        ids = self[word] = _pack_ids(len(coded))(*coded)
        return ids


class Encoder:
    """Encodes and decodes texts with a byte-level BPE tokenizer file, with or without a lexicon."""

    automaton = None

    def __init__(self, path: str, specials: bool = True, library: bool = False):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = byte_characters()
        value = {c: b for b, c in enumerate(chars)}
        self.first = [vocab[c] for c in chars]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(value[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.added = added if specials else {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._any_words = regex.compile(_ANY_WORDS).findall
        ends = np.cumsum([len(b) for b in self.bytes_of])
        self._blob, self._from, self._size = np.frombuffer(b"".join(self.bytes_of), np.uint8), ends - np.array([len(b) for b in self.bytes_of]), np.array([len(b) for b in self.bytes_of])
        model = spec["model"]
        pairs = (p.split(" ") if isinstance(p, str) else p for p in model["merges"])
        #: For each pair of ids that is merged its rank and the id it becomes.
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        order = sorted((a * self.size + b, rank, to) for (a, b), (rank, to) in self.merges.items())
        keys, ranks, _ = np.array(order, np.int64).reshape(-1, 3).T
        into = np.zeros(int(ranks.max(initial=0)) + 1, np.int64)
        into[ranks] = [to for _, _, to in order]
        #: The same as arrays: pairs as sorted numbers, their ranks, and by rank the id.
        self.pairs = np.ascontiguousarray(keys), np.ascontiguousarray(ranks), into
        self._model, self._chars = None, dict(enumerate(chars))
        if library:
            from tokenizers import Tokenizer

            self._model = Tokenizer.from_file(path).model
        self.memo = _Memo(self)

    def with_lexicon(self, path: str) -> Encoder:
        """The same tables with the lexicon of a file, and a memory of their own."""
        out = copy.copy(self)
        *parts, out.starts, out.ids = _mapped(path)
        out.automaton, out.memo = Automaton(*parts), _Memo(out)
        return out

    def words_of(self, text: str) -> list[str]:
        return _LATIN_WORDS(text) if _OTHER(text) is None else self._any_words(text)

    def words(self, text: str) -> list[str]:
        """The words of a text; strings of added tokens are words of their own."""
        if self.special is None or not any(s in text for s in self.added):
            return self.words_of(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.words_of(part)
        return out

    def merge(self, word: str) -> tuple:
        """The ids of a word by the ranks: the leftmost pair of the lowest rank is merged until none is left.

        With library it is the tokenizers library that merges, which gives the same ids.
        """
        if word in self.added:
            return (self.added[word],)
        if self._model is not None:
            plain = word.isascii() and word.isprintable()
            named = word.replace(" ", self._chars[32]) if plain else word.encode("utf-8", "replace").decode("latin-1").translate(self._chars)
            return tuple([t.id for t in self._model.tokenize(named)])
        ids = [self.first[b] for b in word.encode("utf-8", "replace")]
        merges = self.merges
        if len(ids) > 100:
            return self._merge_long(ids)
        while len(ids) > 1:
            best, at = None, 0
            for i in range(len(ids) - 1):
                m = merges.get((ids[i], ids[i + 1]))
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple:
        """The same with a heap over a linked list, for words of any length."""
        merges, n = self.merges, len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = merges[a, b][1], False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get((ids[i], ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (m := merges.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], ids[i]))
        return tuple(x for x, ok in zip(ids, alive) if ok)

    def learn(self, words: set[str]) -> None:
        """Put the ids of words into the memo: those that the automaton accepts, and others merged together; long ones are merged when they are met."""
        listed = [w for w in words if w not in self.added]
        coded = [w.encode("utf-8", "replace") for w in listed]
        numbers = self.automaton.numbers(coded)
        if len(self.memo) + len(listed) > REMEMBERED:
            self.memo.clear()
        for i in np.nonzero(numbers >= 0)[0].tolist():
            k = numbers[i]
            self.memo[listed[i]] = self.ids[self.starts[k] : self.starts[k + 1]].tobytes()
        for longest in TOGETHER:
            new = [i for i in np.nonzero(numbers < 0)[0].tolist() if 0 < len(coded[i]) <= longest]
            numbers[new] = 0
            for i, ids in zip(new, self.merge_all([coded[i] for i in new], longest)):
                self.memo[listed[i]] = ids

    def merge_all(self, words: list[bytes], longest: int) -> list[bytes]:
        """merge() for words of up to `longest` bytes that are none of the added tokens, as bytes of 32-bit numbers: a step merges one pair of each word."""
        if not words:
            return []
        keys, ranks, into = self.pairs
        never, size = len(keys), np.fromiter(map(len, words), np.int64, len(words))
        ids = np.full((len(words), longest + 1), -1, np.int64)
        ids[np.arange(longest + 1) < size[:, None]] = np.array(self.first)[np.frombuffer(b"".join(words), np.uint8)]

        def rank(a, b):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(keys, key), never - 1)
            return np.where((a >= 0) & (b >= 0) & (keys[at] == key), ranks[at], never)

        found, place = rank(ids[:, :-1], ids[:, 1:]), np.arange(longest)
        live = np.arange(len(words))
        while True:
            at = found[live].argmin(1)
            best = found[live, at]
            live, at, best = live[best < never], at[best < never], best[best < never]
            if not len(live):
                return [x[:n].tobytes() for x, n in zip(ids.astype("<i4"), size)]
            # What follows a merged pair moves up by one, ids and ranks alike; the last place is always empty.
            n, later = np.arange(len(live)), np.minimum(place + (place > at[:, None]), longest)
            row = np.take_along_axis(ids[live], np.column_stack([later, np.full(len(live), longest)]), 1)
            row[n, at] = into[best]
            ids[live], size[live] = row, size[live] - 1
            own = np.take_along_axis(np.column_stack([found[live], np.full(len(live), never)]), later, 1)
            own[n, at] = rank(row[n, at], row[n, at + 1])
            left = np.maximum(at - 1, 0)
            own[n, left] = np.where(at > 0, rank(row[n, left], row[n, left + 1]), own[n, left])
            found[live] = own

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's end; a null text has none."""
        cut = [self.words(t) if t else [] for t in texts]
        if self.automaton is not None:
            self.learn(set().union(*cut) - self.memo.keys())
        known = self.memo.__getitem__
        coded = [b"".join(map(known, words)) for words in cut]
        return np.frombuffer(b"".join(coded), "<i4"), np.cumsum([len(c) for c in coded], dtype=np.int64) // 4

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids that end at `ends`, as one Arrow array: the bytes of all ids are gathered at once."""
        size = self._size[ids]
        stops = np.cumsum(size)
        data = self._blob[np.repeat(self._from[ids] - (stops - size), size) + np.arange(stops[-1] if len(ids) else 0)]
        offsets = np.concatenate([[0], np.concatenate([[0], stops])[ends]])
        firsts = data[offsets[:-1][offsets[:-1] < offsets[1:]]]
        try:
            data.tobytes().decode()
            whole = not ((firsts & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if whole:
            return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])], pa.string())

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str, specials: bool = True, library: bool = False) -> Encoder:
    """One encoder for each worker process, which later tasks use again."""
    return Encoder(path, specials, library)


@lru_cache(maxsize=1)
def _lexicon_encoder(path: str, name: str, specials: bool) -> Encoder:
    return encoder(path, specials).with_lexicon(SparkFiles.get(name))


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """word, n over all texts; counted where texts are read, then added up."""

    def count(batches):
        coder = encoder(path)
        total: Counter = Counter()
        for batch in portions(batches):
            for text in batch.column(0).to_pylist():
                total.update(coder.words(text or ""))
            if len(total) > 120_000:
                yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})
                total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(words: list[str], path: str) -> bytes:
    """The transducer of a list of words as one block of bytes: automaton, id offsets by word number, ids."""
    coder = encoder(path)
    coded = sorted({w.encode("utf-8", "replace"): w for w in words if w}.items())
    automaton = Automaton.of([b for b, _ in coded])
    ids = [coder.merge(w) for _, w in coded]
    starts = np.cumsum([0, *map(len, ids)])
    return _pack([automaton.keys, automaton.target, automaton.skipped, automaton.final, starts.astype(np.int64), np.array([i for x in ids for i in x], np.int32)])


def build_lexicon(docs: DataFrame, path: str | None = None, size: int = LEXICON_WORDS) -> bytes:
    """The transducer of the words that are most frequent in docs, `size` at most. A null text has none."""
    path = path or default_tokenizer()
    start = mark()
    top = most_frequent(materialise(word_counts(docs, path).where((F.octet_length("word") <= LONGEST) & (F.col("n") > 1))), "n", size, "word")
    words = [r.word for r in top.collect()]
    drop_since(docs.sparkSession, start)
    return compile_lexicon(words, path)


def encode(docs: DataFrame, lexicon: bytes | None = None, path: str | None = None, column: str = "text", specials: bool = True) -> DataFrame:
    """docs with `ids`, array<int>: the ids of each whole text as the tokenizer gives them, no special ones added.

    A null or empty text has no ids; whole texts of any length are encoded. With specials, strings of added tokens in a
    text are those tokens, else ordinary text. The work is by row, so ties and repeated rows need no rule, and an empty
    table gives an empty result. Further columns pass through; one named `ids` is given back as `ids_in`.
    """
    path = path or default_tokenizer()
    name = _handed_out(docs.sparkSession, lexicon)
    work, back = set_aside(docs, [column], ["ids"])

    def run(batches):
        coder = _coder(path, name, specials)
        for batch in portions(batches, column):
            flat, ends = coder.encode(batch.column(batch.schema.get_field_index(column)).to_pylist())
            yield with_columns(batch, ids=_lists(flat, ends))

    return back(work.mapInArrow(run, T.StructType([*work.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])))


def round_trip(docs: DataFrame, lexicon: bytes | None = None, path: str | None = None, column: str = "text", specials: bool = True, out: str = "decoded") -> DataFrame:
    """decode(encode(docs)) without the texts that it was given, in one worker instead of two that run side by side.

    Rows, names and texts are those of encode() and decode(); the texts are made from the ids alone.
    """
    path = path or default_tokenizer()
    name = _handed_out(docs.sparkSession, lexicon)
    work, back = set_aside(docs, [column], ["ids", out])
    rest = [f for f in work.schema.fields if f.name != column]

    def run(batches):
        coder = _coder(path, name, specials)
        for batch in portions(batches, column):
            flat, ends = coder.encode(batch.column(batch.schema.get_field_index(column)).to_pylist())
            yield with_columns(batch.select([f.name for f in rest]), ids=_lists(flat, ends), **{out: _texts(coder, flat, ends)})

    made = work.mapInArrow(run, T.StructType([*rest, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField(out, T.StringType())]))
    return back(made.withColumn(column, F.lit(None).cast("string"))).drop(column)


def _coder(path: str, lexicon: str | None, specials: bool) -> Encoder:
    return encoder(path, specials) if lexicon is None else _lexicon_encoder(path, lexicon, specials)


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))


def _texts(coder: Encoder, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts of ids that end at `ends`, some 250,000 ids at a time."""
    parts, start = [pa.array([], pa.string())], 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + 250_000, "right")))
        parts.append(coder.decoded(flat[done : ends[stop - 1]], ends[start:stop] - done))
        start = stop
    return pa.concat_arrays(parts)


def decode(coded: DataFrame, path: str | None = None, column: str = "ids", out: str = "decoded") -> DataFrame:
    """coded with the text of its ids; null ids give an empty text, special ids their string, bytes that are no UTF-8 U+FFFD.

    Rows are decoded each for itself, however many ids they have: ties, repeats and an empty table need no rule.
    Further columns pass through; one with the result's name is given back as `<name>_in`.
    """
    path = path or default_tokenizer()
    work, back = set_aside(coded, [column], [out])

    def by_rows(batches):
        coder = encoder(path)
        for batch in batches:
            at, start = batch.schema.get_field_index(column), 0
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
            while start < batch.num_rows:  # rows of some 250,000 ids at a time
                done = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, done + 250_000, "right")))
                part = batch.slice(start, stop - start)
                yield with_columns(part, **{out: coder.decoded(part.column(at).flatten().to_numpy(), sizes[start:stop] - done)})
                start = stop
        give_back()

    return back(work.mapInArrow(by_rows, T.StructType([*work.schema.fields, T.StructField(out, T.StringType())])))


def op2_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return round_trip(docs, build_lexicon(docs)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), hex_sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), hex_sha256("decoded").alias("decoded_sha256"))


QUERIES = {"op2_transducer_bpe": op2_transducer_bpe}
SQL: dict[str, str] = {}
