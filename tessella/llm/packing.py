"""Packing of tokenised documents into sequences of fixed length by a grouping genetic algorithm.

A document longer than a sequence is cut: its pieces are full but for the first, so each document has one piece at most
that shares a sequence. These pieces are dealt by hash to blocks of bounded size. A chromosome is the grouping of a
block's pieces into bins: crossover takes whole well-filled bins of one parent, the other's bins that hold any of their
pieces are dissolved, and what is displaced goes, longest first, where it fits best. Every block has several islands,
each a task of its own, and between epochs the best of an island moves on to the next.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import bpe
from tessella.llm._shared import documents, give_back, materialise, portions, set_aside, with_columns

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 1024, 2
#: Pieces of a block on average. Each block may leave one sequence half empty.
BLOCK = 32_768
#: Islands of a block, epochs with a migration between them, chromosomes of an island, children of an epoch.
ISLANDS, EPOCHS, POPULATION, CHILDREN = 3, 2, 6, 40
SEED = 11
PIECES = {"piece": "int", "start": "long", "length": "long", "ids": "array<int>", "sequence_id": "long", "offset": "long"}


class Bins:
    """Open bins by what they have left; bits of `mask` say for which remainders there are any."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.left: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    @classmethod
    def of(cls, capacity: int, fills: np.ndarray) -> Bins:
        out = cls(capacity)
        out.made = len(fills)
        rest = capacity - fills
        for b in np.nonzero(rest)[0].tolist():
            out.left[rest[b]].append(b)
        for r in np.unique(rest[rest > 0]).tolist():
            out.mask |= 1 << r
        return out

    def place(self, sizes: list[int]) -> list[int]:
        """The bin of each piece: of those with room the one with the least, else a new one."""
        out, left, mask = [], self.left, self.mask
        for s in sizes:
            fits = mask >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                b = left[r].pop()
                if not left[r]:
                    mask ^= 1 << r
            else:
                r, b = self.capacity, self.made
                self.made += 1
            r -= s
            if r:
                left[r].append(b)
                mask |= 1 << r
            out.append(b)
        self.mask = mask
        return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can go below (Martello and Toth's L2)."""
    n = np.bincount(sizes, minlength=capacity + 1)
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * np.arange(capacity + 1))])
    small = np.arange(capacity // 2 + 1)
    half = capacity // 2
    large = count[-1] - count[capacity - small + 1]
    middle, middle_sum = count[capacity - small + 1] - count[half + 1], total[capacity - small + 1] - total[half + 1]
    rest = total[half + 1] - total[small]
    return int((large + middle + np.maximum(0, -(-(rest - (middle * capacity - middle_sum)) // capacity))).max(initial=0))


class Island:
    """A population of groupings of the same pieces: `bin_of` has the bin of each piece, bins are numbered without gaps."""

    def __init__(self, sizes: np.ndarray, capacity: int, rng: np.random.Generator, population: list[np.ndarray] | None = None):
        self.sizes, self.capacity, self.rng = sizes.astype(np.int64), capacity, rng
        self.bound = lower_bound(self.sizes, capacity)
        self.population = population or []

    def found(self, size: int) -> Island:
        """Best fit decreasing first, then best fit in orders that noise has disturbed. None more if nothing can be better."""
        while len(self.population) < size and not self.done:
            noise = 1 + 0.2 * self.rng.random(len(self.sizes)) * bool(self.population)
            self.population.append(self._completed(np.full(len(self.sizes), -1), np.argsort(-self.sizes * noise, kind="stable")))
        return self

    @property
    def done(self) -> bool:
        return any(self._bins(x) <= self.bound for x in self.population)

    @staticmethod
    def _bins(bin_of: np.ndarray) -> int:
        return int(bin_of.max(initial=-1)) + 1

    def fitness(self, bin_of: np.ndarray) -> tuple[int, float]:
        """Fewer bins first; of as many, those of which some are full and others empty."""
        fills = np.bincount(bin_of, self.sizes)
        return -len(fills), float((fills**2).sum())

    def best(self) -> np.ndarray:
        return max(self.population, key=self.fitness)

    def _completed(self, bin_of: np.ndarray, order: np.ndarray) -> np.ndarray:
        """bin_of (-1: none) with bins numbered anew and the pieces of `order` put where they fit best."""
        placed = bin_of >= 0
        used = np.bincount(bin_of[placed], minlength=1) > 0
        bin_of = np.where(placed, (np.cumsum(used) - 1)[bin_of], -1)
        fills = np.bincount(bin_of[placed], self.sizes[placed]).astype(np.int64)
        bin_of[order] = Bins.of(self.capacity, fills).place(self.sizes[order].tolist())
        return bin_of

    def crossed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """b with some of the fuller bins of a, whole; displaced pieces are put in again, the longest first."""
        fills = np.bincount(a, self.sizes)
        fuller = fills + self.rng.random(len(fills)) >= np.median(fills)
        chosen = fuller & (self.rng.random(len(fills)) < self.rng.uniform(0.1, 0.6))
        taken = chosen[a]
        hit = np.zeros(self._bins(b), bool)
        hit[b[taken]] = True
        child = np.where(taken, a, np.where(hit[b], -1, b + len(fills)))
        return self._completed(child, self._longest_first(child))

    def mutated(self, a: np.ndarray) -> np.ndarray:
        """Without the emptiest bins and a few others, whose pieces are put in again."""
        fills = np.bincount(a, self.sizes)
        gone = self.rng.random(len(fills)) < 0.02
        gone[np.argsort(fills)[: 2 + len(fills) // 50]] = True
        child = np.where(gone[a], -1, a)
        return self._completed(child, self._longest_first(child))

    def _longest_first(self, bin_of: np.ndarray) -> np.ndarray:
        out = np.nonzero(bin_of < 0)[0]
        return out[np.argsort(-self.sizes[out], kind="stable")]

    def evolve(self, children: int) -> Island:
        """So many children, each in the place of the worst if it is better; it ends early at the lower bound."""
        if not len(self.sizes) or self.done:
            return self
        scored = sorted(((self.fitness(x), i, x) for i, x in enumerate(self.population)), key=lambda r: r[:2], reverse=True)
        for k in range(children):
            i, j = sorted(self.rng.choice(len(scored), 2, replace=False)) if len(scored) > 1 else (0, 0)
            child = self.crossed(scored[j][2], scored[i][2]) if k % 4 < 3 and i != j else self.mutated(scored[i][2])
            fit = self.fitness(child)
            if fit > scored[-1][0] and all(fit != s[0] for s in scored):
                scored[-1] = (fit, -k, child)
                scored.sort(key=lambda r: r[:2], reverse=True)
            if -fit[0] <= self.bound:
                break
        self.population = [x for _, _, x in scored]
        return self


def tokenised(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A written table: docs without text, with _row (a number of its own), _n and _ids (binary) of all tokens, the end id last, and _full, a number for its full pieces."""
    path = path or bpe.default_tokenizer()
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        from pyspark import TaskContext

        coder, first = bpe.encoder(path, library=True), TaskContext.get().partitionId()
        kind, row, full = np.dtype("<u2" if max(coder.size, end + 1) <= 1 << 16 else "<u4"), first << 36, first << 36
        for batch in portions(batches):
            flat, ends = coder.encode(batch.column(batch.schema.get_field_index("text")).to_pylist())
            flat = flat.astype(kind)
            n = np.diff(ends, prepend=0) + 1
            held = n // capacity
            ids = [np.append(flat[b - k + 1 : b], kind.type(end)).tobytes() for b, k in zip(ends, n)]
            more = {"_row": pa.array(row + np.arange(len(n))), "_n": pa.array(n), "_full": pa.array(full + np.cumsum(held) - held), "_ids": pa.array(ids, pa.binary())}
            row, full = row + len(n), full + int(held.sum())
            yield with_columns(batch.select(rest), **more)

    added = T.StructType.fromDDL("_row long, _n long, _full long, _ids binary")
    return materialise(docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in rest], *added.fields])))


def place(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """items (_row, _size: 1 .. capacity) with sequence_id and offset: bins of capacity at most, as few as are found.

    Equal sizes are pieces of their own. The same rows give the same bins whatever the partitions are. An empty table
    gives an empty result.
    """
    blocks = max(1, -(-items.count() // block))
    grouped = items.groupBy(F.pmod(F.xxhash64("_row"), F.lit(blocks)).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("_row", "_size"))).alias("_items"))
    grouped = materialise(grouped.select("_block", F.col("_items._row").alias("_rows"), F.col("_items._size").alias("_sizes")))
    state = grouped.select("_block", "_sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("_island")).withColumns({"_population": F.array().cast("array<binary>"), "_guest": F.lit(None).cast("binary")})
    kind = "_block long, _island int, _sizes array<int>, _population array<binary>, _best binary, _bins int, _fit double"

    def run(epoch):
        def evolve(batches):
            for batch in batches:
                rows = batch.to_pylist()
                for r in rows:
                    sizes = np.array(r["_sizes"], np.int64)
                    island = Island(sizes, capacity, np.random.default_rng([seed, r["_block"], r["_island"], epoch]), [np.frombuffer(x, "<u4").astype(np.int64) for x in r["_population"]])
                    if r["_guest"] is not None and not island.done:
                        worst = min(range(len(island.population)), key=lambda i: island.fitness(island.population[i]))
                        island.population[worst] = np.frombuffer(r["_guest"], "<u4").astype(np.int64)
                    island.found(POPULATION).evolve(CHILDREN)
                    best = island.best()
                    r |= {"_population": [x.astype("<u4").tobytes() for x in island.population], "_best": best.astype("<u4").tobytes()}
                    r["_bins"], r["_fit"] = -island.fitness(best)[0], island.fitness(best)[1]
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names}], schema)

        schema = pa.schema([("_block", pa.int64()), ("_island", pa.int32()), ("_sizes", pa.list_(pa.int32())), ("_population", pa.list_(pa.binary())), ("_best", pa.binary()), ("_bins", pa.int32()), ("_fit", pa.float64())])
        return evolve

    for epoch in range(epochs):
        # So many partitions that each island may have a task of its own; without a number small rows would be put together.
        dealt = state.select("_block", "_island", "_sizes", "_population", "_guest").repartition(min(blocks * islands, 1 << 14), "_block", "_island")
        state = materialise(dealt.mapInArrow(run(epoch), kind))
        if epoch < epochs - 1:
            guests = state.select("_block", F.pmod(F.col("_island") + 1, F.lit(islands)).alias("_island"), F.col("_best").alias("_guest"))
            state = state.drop("_best").join(guests, ["_block", "_island"])
    best = state.groupBy("_block").agg(F.min_by("_best", F.struct("_bins", -F.col("_fit"), "_island")).alias("_best"))

    def spread(batches):
        for batch in batches:
            for rows, sizes, found, number in zip(*(batch.column(i) for i in range(4))):
                bins, sizes = np.frombuffer(found.as_py(), "<u4").astype(np.int64), sizes.values.to_numpy().astype(np.int64)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                offset = np.empty(len(bins), np.int64)
                firsts = np.searchsorted(bins[order], np.arange(bins.max() + 1))
                offset[order] = before - before[firsts][bins[order]]
                yield pa.RecordBatch.from_arrays([rows.values, pa.array((number.as_py() << 36) + bins), pa.array(offset)], names=["_row", "sequence_id", "offset"])

    return grouped.join(best, "_block").select("_rows", "_sizes", "_best", "_block").mapInArrow(spread, "_row long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, **settings) -> DataFrame:
    """The pieces of all documents (text) with piece, start, length, ids, sequence_id and offset, and docs' other columns.

    A null or empty text is its end id alone. Each row of docs is a document, so repeated rows, ids and null ids need no
    rule; whole texts of any length are packed; an empty table gives an empty result. A sequence of one full piece has a
    negative number. Further columns pass through, clashing ones as `<name>_in`; text is left out.
    """
    work, back = set_aside(docs, ["text"], list(PIECES))
    coded = tokenised(work, path, capacity, end)
    first = F.col("_n") - (F.ceil(F.col("_n") / capacity) - 1) * capacity
    placed = place(coded.select("_row", first.cast("int").alias("_size")).where(f"_size < {capacity}"), capacity, **settings)
    joined = coded.join(placed, "_row", "left")
    rest = [c for c in work.columns if c != "text"]
    names = joined.columns
    at = [names.index(c) for c in rest]

    def cut(batches):
        for batch in batches:
            ids, n, full, sequence, offset = (batch.column(names.index(c)) for c in ("_ids", "_n", "_full", "sequence_id", "offset"))
            n, full = n.to_numpy(), full.to_numpy()
            sequence, offset = (x.fill_null(0).to_numpy() for x in (sequence, offset))
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - (np.cumsum(count) - count)[row]
            begins = n - (count - 1) * capacity  # of the first piece, the length
            start = np.where(piece > 0, begins[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, begins[row])
            whole = length == capacity
            earlier = piece - (begins < capacity)[row]  # full pieces of the document before this one
            number = np.where(whole, -1 - (full[row] + earlier), sequence[row])
            wide = np.dtype("<u2") if n[0] * 2 == len(ids[0].as_buffer()) else np.dtype("<u4")
            tokens = np.frombuffer(b"".join(x.as_buffer() for x in ids), wide).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(tokens))
            kept = [batch.column(i).take(pa.array(row)) for i in at]
            more = [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), lists, pa.array(number), pa.array(np.where(whole, 0, offset[row]))]
            yield pa.RecordBatch.from_arrays([*kept, *more], names=[*rest, *PIECES])
        give_back()

    fields = [*[work.schema[c] for c in rest], *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in PIECES.items())).fields]
    out = joined.mapInArrow(cut, T.StructType(fields)).withColumn("text", F.lit(None).cast("string"))
    return back(out).drop("text")


def sequences(pieces: DataFrame) -> DataFrame:
    """Rows of pack() put together: sequence_id, ids (array<int>) and lengths, those of its pieces in their order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("_p")).select("sequence_id", F.flatten("_p.ids").alias("ids"), F.col("_p.length").alias("lengths"))


def ids_crc32(pieces: DataFrame) -> DataFrame:
    """pieces with ids_crc32, of the ids as little-endian numbers of 32 bits, in the place of ids."""

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            ids, ends = lists.flatten().to_numpy().astype("<u4"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:])]
            yield with_columns(batch.drop_columns(["ids"]), ids_crc32=pa.array(crc, pa.int64()))

    kept = pieces.drop("ids")
    return pieces.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("ids_crc32", T.LongType())]))


def op11_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_crc32(pack(documents(spark, sf_dir).select("doc_id", "text")))


QUERIES = {"op11_genetic_packing": op11_genetic_packing}
SQL: dict[str, str] = {}
