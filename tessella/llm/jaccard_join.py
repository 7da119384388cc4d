"""Similarity join of documents by the Jaccard similarity of their word shingles, with a token-group matrix.

Similar documents are put into groups of bounded size. The matrix says which groups hold a token; a document asks it
with the few tokens of which a similar document must have one, and so finds the groups that can hold a partner. Sets
travel once to where their groups are, those of members and of documents that ask alike. There the overlap with the
union of the group's tokens is counted, and only where it reaches what a link needs are the group's members compared
with the document, all at once: one link with each component of the group is enough.

1. Each text becomes a set of hashed shingles; texts of one set are one node.
2. The tokens that a node asks with are its rarest ones, by a table of fixed size of how many documents hold a token.
3. Of the nodes that ask with a token the smallest is its leader; each node is compared with the leader that it shares
   most with. Nodes so linked make up components, cut into pieces. Pieces that meet at crowded tokens are put together
   by the leader of most of these, whether they link or not: these families, in parts, and the other pieces are the groups.
4. Groups ask the matrix for other groups: of two that can hold a link the nodes of the smaller ask the larger. Nodes of
   a family are compared with each other if the tokens they ask with allow a link. Components of all links are the result.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tessella.llm._shared import distinct, documents, drop_since, fixed_table, mark, materialise, narrowed, portions

#: Words of a shingle, and the similarity of a link in hundredths.
WORDS = 5
PERCENT = 80
#: Documents of a group, and shingles of all of them, or so; queries that are compared with one copy of a group at most.
GROUP = 256
GROUP_SHINGLES = 1_000_000
#: Pieces of components that ask with a token at least, for these to be put together as a family. It changes speed only.
CROWD = 8
QUERIES_A_COPY = 4096
#: A task counts the tokens that so many of some thousands of documents read together hold; the counts, added up by slot,
#: order tokens. Any order gives the same links, so neither the bound nor crowded slots lose one; the table has this size
#: (a byte a slot, broadcast) whatever the corpus is.
LOCALLY_FREQUENT = 2
SLOTS = 1 << 23
#: The nodes of a token are split into parts of about so many, by the token's count, when they look for its leader.
PART = 512
#: Bits for a part beside the token's in one number.
PART_BITS = 20
#: Half of the overlap that a link of sets of n and m shingles takes, as a part of n + m, and half of needed(), of n.
_HALF_OVERLAP, _HALF_NEEDED = PERCENT / (100 + PERCENT) / 2, PERCENT / 200
#: Bytes of a token: the top bits of a shingle's 64-bit hash.
TOKEN = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]  # A-Z are a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_PLACE = _mix(np.arange(301, 301 + WORDS, dtype=np.uint64))


def shingle_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; of a text with fewer words, one of all its words."""
    raw = [(t or "").encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    text_ends = np.cumsum([len(x) for x in raw])
    blank = _BLANK[data]
    before = np.concatenate([[True], blank[:-1]])
    starts, ends = np.nonzero(~blank & before)[0], np.nonzero(blank & ~before)[0]
    with np.errstate(over="ignore"):
        powers = np.full(len(data), _BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * powers)])
        back = np.full(len(data), _INVERSE, np.uint64)
        back[0] = 1
        back = np.cumprod(back)
        words = _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
        last = np.searchsorted(starts, text_ends)
        first = np.concatenate([[0], last[:-1]])
        n = max(len(words) - WORDS + 1, 0)
        runs = np.zeros(n, np.uint64)
        for k in range(WORDS):
            runs += words[k : k + n] * _PLACE[k]
        runs = _mix(runs)
        out = []
        for a, b in zip(first.tolist(), last.tolist()):
            if b - a >= WORDS:
                out.append(distinct(runs[a : b - WORDS + 1]))
            elif b > a:
                out.append(_mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _tokens(hashes: np.ndarray) -> bytes:
    return _packed(distinct(hashes >> np.uint64(64 - 8 * TOKEN)))


def _packed(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :TOKEN]).tobytes()


def _numbers(tokens: bytes) -> np.ndarray:
    raw = np.frombuffer(tokens, np.uint8).reshape(-1, TOKEN)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :TOKEN] = raw
    return out.view("<i8").reshape(-1)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """A written table: doc_id, n (shingles of the whole text), node (a number of the set, null if empty), tokens (sorted).

    The number is a 64-bit hash of the set. Where a second such hash shows that sets share a number, both hashes
    together make other numbers for these.
    """

    def run(batches):
        for batch in portions(batches, most=2_000_000):
            sets = shingle_hashes(batch.column(1).to_pylist())
            salted = lambda h, salt: int((_mix(h ^ np.uint64(salt)).sum(dtype=np.uint64) ^ np.uint64(len(h) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).astype(np.int64))
            columns = [pa.array([salted(h, salt) if len(h) else None for h in sets], pa.int64()) for salt in (0, 0x5851F42D4C957F2D)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in sets], pa.int32()), *columns, pa.array([_tokens(h) for h in sets], pa.binary())], names=["doc_id", "n", "node", "second", "tokens"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("second", T.LongType()), T.StructField("tokens", T.BinaryType())])
    sets = materialise(docs.select("doc_id", "text").mapInArrow(run, schema))
    shared = materialise(sets.groupBy("node").agg(F.min("second").alias("_a"), F.max("second").alias("_b")).where("_a < _b").select("node", F.lit(True).alias("_two")))
    if not shared.isEmpty():  # not to be expected below some 10^9 different sets
        sets = materialise(sets.join(shared, "node", "left").withColumn("node", F.when(F.col("_two"), F.xxhash64("node", "second")).otherwise(F.col("node"))))
    return sets.select("doc_id", "n", "node", "tokens")


def token_levels(sets: DataFrame) -> np.ndarray:
    """For each slot of tokens the number of binary digits of how many documents hold one, 0 for all that are rare."""

    def run(batches):
        held, size = {}, 0

        def counted():
            tokens, n = np.unique(np.concatenate([_numbers(x) for x in held.values()] or [np.zeros(0, np.int64)]), return_counts=True)
            often = n >= LOCALLY_FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(tokens[often] & (SLOTS - 1)), pa.array(n[often])], names=["slot", "v"])

        for batch in batches:
            for node, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node not in held:
                    held[node] = x
                    size += len(x)
                if size > 24_000_000:
                    yield counted()
                    held, size = {}, 0
        yield counted()

    rows = sets.where("n > 0").select("node", "tokens").mapInArrow(run, "slot long, v long")
    return fixed_table(rows, SLOTS, "u1", last=lambda n: np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))) + 1, 0))


def needed(n):
    """Shingles that a partner of a set of n must share with it at least."""
    return -(-n * PERCENT // 100)


def shared_tokens(sets: DataFrame) -> DataFrame:
    """A written table of the tokens that nodes ask with, without those of one node: token, part, node, n, at, leader, leader_n.

    Each node asks with n - needed(n) + 1 of its tokens, the rarest first. Two linked nodes share one of them: the
    order is one for all nodes, and of all but these a node has too few to link. The nodes of a frequent token are
    dealt to parts from 1, the more the more there are; other tokens have part 0. `at` is the token's place in the node's order, from 0.
    """
    shared = sets.sparkSession.sparkContext.broadcast(token_levels(sets))
    split = PART.bit_length()

    def run(batches):
        levels = shared.value
        for batch in batches:
            seen, tokens, nodes, sizes = set(), [], [], []
            for node, n, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if node in seen:
                    continue
                seen.add(node)
                own = _numbers(x)
                level = levels[own & (SLOTS - 1)]
                first = np.argsort(level, kind="stable")[: n - needed(n) + 1]
                many = np.left_shift(1, np.clip(level[first].astype(np.int64) - split, 0, PART_BITS - 1))
                tokens.append(own[first] << PART_BITS | np.where(many > 1, 1 + node % many, 0))
                nodes.append(np.full(len(first), node, np.int64))
                sizes.append((n << 32) + np.arange(len(first), dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, nodes, sizes)], names=["key", "node", "size"])

    # Few columns and one exchange for all that follows: these are the rows of most of the job.
    asking = sets.where("n > 0").select("node", "n", "tokens").mapInArrow(run, "key long, node long, size long").repartition("key").dropDuplicates(["key", "node"])
    asking = asking.select("key", "node", F.expr("cast(shiftright(size, 32) as int)").alias("n"), F.expr("cast(size & 4294967295 as int)").alias("at"))
    # Of the tokens that a pair is looked at by, see link(), the node that is not the larger one has each so early.
    early = F.col("at") <= F.col("n") * (1 - 2 * _HALF_OVERLAP - _HALF_NEEDED) + 1e-6
    w = Window.partitionBy("key")
    led = asking.withColumns({"_first": F.min(F.struct("node", "n")).over(w), "_last": F.max("node").over(w), "_early": F.max(early).over(w)})
    led = led.withColumns({"token": F.expr(f"shiftright(key, {PART_BITS})"), "part": F.expr(f"cast(key & {(1 << PART_BITS) - 1} as int)")})
    led = led.where((F.col("_early") & (F.col("_first.node") < F.col("_last"))) | (F.col("part") != 0))
    out = materialise(led.select("token", "part", "node", "n", "at", F.col("_first.node").alias("leader"), F.col("_first.n").alias("leader_n")))
    shared.destroy()
    return out


def _comparable(a: str, b: str):
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def _least_common(n, m):
    """How many of the tokens that both ask with sets of n and m shingles share at least, if they link.

    Of the two, take the one whose asking tokens end first. It has needed() - 1 other tokens, so the overlap that a
    link takes is reached only if these few and the shared asking tokens make it up.
    """
    overlap = F.ceil(PERCENT * (n + m) / (100 + PERCENT))
    return overlap - F.ceil(F.greatest(n, m) * PERCENT / 100) + 1


def leader_pairs(shared: DataFrame) -> DataFrame:
    """gid, node: each node with the leader of most of its tokens, and the leaders of a token's parts with the first of them."""
    # One exchange, by node, serves both sums; a node has a token once.
    near = shared.where((F.col("node") != F.col("leader")) & _comparable("n", "leader_n")).select("node", "leader", "n", "leader_n").repartition("node").groupBy("node", "leader", "n", "leader_n").agg(F.count("*").alias("c"))
    # This step need not find all links, as the matrix does; pairs that share less than half of what links do are left to it.
    near = near.where(2 * F.col("c") >= _least_common(F.col("n"), F.col("leader_n")))
    best = near.groupBy("node").agg(F.max(F.struct("c", "leader"))["leader"].alias("gid"))
    heads = shared.where((F.col("part") != 0) & (F.col("node") == F.col("leader"))).select("token", "leader", "leader_n")
    across = heads.withColumn("_f", F.min(F.struct("leader", "leader_n")).over(Window.partitionBy("token"))).where((F.col("leader") != F.col("_f.leader")) & (F.col("leader_n") * 100 >= F.col("_f.leader_n") * PERCENT) & (F.col("_f.leader_n") * 100 >= F.col("leader_n") * PERCENT))
    return best.select("gid", "node").union(across.select(F.col("_f.leader").alias("gid"), F.col("leader").alias("node"))).distinct()


def with_sets(sets: DataFrame, places: DataFrame) -> DataFrame:
    """places (node and more) with n and tokens of the nodes. Rows of sets of other nodes hardly get into a shuffle.

    The exchange that makes one row of a node's copies is that of the join as well, so tokens travel once.
    """
    found = narrowed(sets.where("n > 0").select("node", "n", "tokens"), "node", places)
    return places.join(found.groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "node")


class _Opened:
    """The members of a group, for counts of what a set shares with each of them at once.

    It remembers which components its links have joined so far, and gives no link between what hangs together already.
    """

    def __init__(self, members: list[tuple[int, int, int, bytes]]):
        self.nodes, self.components, self.sizes = [x[0] for x in members], [x[1] for x in members], np.array([x[2] for x in members])
        tokens = [_numbers(x[3]) for x in members]
        self.union, self.places = np.unique(np.concatenate(tokens), return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in tokens])[:-1]])
        self.joined: dict[int, int] = {}

    def _root(self, component: int) -> int:
        while (up := self.joined.get(component, component)) != component:
            self.joined[component] = component = self.joined.get(up, up)
        return component

    def _common(self, at: np.ndarray) -> np.ndarray:
        """How many of the tokens at these places of the union each member holds."""
        held = np.zeros(len(self.union), np.int64)
        held[at] = 1
        return np.add.reduceat(held[self.places], self.starts)

    def _own(self) -> list[np.ndarray]:
        """For each member the places of its tokens in the union."""
        return np.split(self.places, self.starts[1:])

    def links(self, node: int, component: int, n: int, own: np.ndarray) -> list[tuple[int, int]]:
        at = np.minimum(np.searchsorted(self.union, own), len(self.union) - 1)
        at = at[self.union[at] == own]
        if len(at) < needed(n):
            return []
        common, out = self._common(at), []
        for i in np.nonzero(100 * common >= PERCENT * (n + self.sizes - common))[0].tolist():
            x, y = self._root(component), self._root(self.components[i])
            if x != y:
                self.joined[max(x, y)] = min(x, y)
                out.append((node, self.nodes[i]))
        return out

    def inner(self) -> list[tuple[int, int]]:
        """Links between the members."""
        return [x for i, at in enumerate(self._own()) for x in self.links(self.nodes[i], self.components[i], int(self.sizes[i]), self.union[at])]

    def kin(self) -> list[tuple[int, int]]:
        """Node and component of the members that may link with a member of another component, where the tokens are those asked with."""
        components, out = np.array(self.components), []
        for i, at in enumerate(self._own()):
            n, m = self.sizes[i], self.sizes
            most = np.maximum(n, m)
            least = -(-PERCENT * (n + m) // (100 + PERCENT)) - needed(most) + 1  # as in _least_common(), and half of it as in group_pairs()
            fits = (components != components[i]) & (100 * np.minimum(n, m) >= PERCENT * most) & (self._common(at) >= np.maximum(least // 2, 1))
            if fits.any():
                out.append((self.nodes[i], self.components[i]))
        return out


def kin(rows: DataFrame) -> DataFrame:
    """gid, node, component of those nodes of rows (gid, node, component, n, token) that may link with a node of another component in their group, as a written table.

    The tokens that nodes ask with decide, so the sets of most nodes of a family, which share a passage only, need not travel.
    """
    dealt = rows.select("gid", "node", "component", "n", "token").repartition("gid").sortWithinPartitions("gid", "node")

    def run(batches):
        each = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5))))
        for gid, some in groupby(each, lambda row: row[0]):
            members = [(*member, _packed(np.array([row[4] for row in held]))) for member, held in groupby(some, lambda row: row[1:4])]
            found = _Opened(members).kin()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([gid] * len(found), pa.int64()), *(pa.array([x[i] for x in found], pa.int64()) for i in range(2))], names=["gid", "node", "component"])

    return materialise(dealt.mapInArrow(run, "gid long, node long, component long"))


def open_groups(members: DataFrame, queries: DataFrame, near: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links of each query (gid, node, component) with members (gid, node, component) of its group, and of those in `near` (the same columns) with each other; as a written table.

    Links between what those given join already are left out, so there are fewer than queries and members together. Of
    groups with many queries there are copies, each with a share of these; a task holds one group at a time and the
    queries pass by. Members of groups that nobody asks stay where they are.
    """
    copies = queries.groupBy("gid").agg(F.ceil(F.count("*") / QUERIES_A_COPY).cast("int").alias("copies"))
    asked = queries.join(copies, "gid").select("gid", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int").alias("copy"), F.lit(2).alias("kind"), "node", "component")
    held = members.join(copies, "gid").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("gid", "copy", F.lit(0).alias("kind"), "node", "component")
    within = near.select("gid", F.lit(-1).alias("copy"), F.lit(1).alias("kind"), "node", "component")
    rows = with_sets(sets, materialise(held.union(asked).union(within))).select("gid", "copy", "kind", "node", "component", "n", "tokens").repartition("gid", "copy").sortWithinPartitions("gid", "copy", "kind", "node")

    def run(batches):
        found, group = [], None

        def taken():
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])

        each = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(7))))
        for (_, _, kind), some in groupby(each, lambda row: row[:3]):
            if kind < 2:  # they come before the group's queries
                group = _Opened([row[3:] for row in some])
                found += group.inner() if kind else []
            else:
                for row in some:
                    found += group.links(*row[3:6], _numbers(row[6]))
            if len(found) > 10_000:
                yield taken()
                found = []
        yield taken()

    return materialise(rows.mapInArrow(run, "a long, b long"))


def _roots(edges: DataFrame) -> DataFrame:
    """x, root: each node points to its smallest neighbour if that is smaller; the end of the pointers, found by doubling them."""
    up = materialise(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")))
    while True:
        far = materialise(up.join(up.select(F.col("x").alias("root"), F.col("root").alias("_next")), "root").select("x", "root", F.col("_next")))
        done = far.where(F.col("root") != F.col("_next")).isEmpty()
        up = far.select("x", F.col("_next").alias("root"))
        if done:
            return up


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that links reach), for the nodes that have links.

    In each round nodes are contracted to the smaller nodes that their pointers end at, and links within one go. Every
    node that has links left joins another, so half of them at least go in each round, and with them their links.
    """
    edges = materialise(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).where("x <> y").distinct())
    whole = None
    while True:
        roots = _roots(edges)
        whole = roots if whole is None else materialise(whole.join(roots.select(F.col("x").alias("root"), F.col("root").alias("_next")), "root", "left").select("x", F.coalesce("_next", "root").alias("root")))
        one = edges.join(roots, "x").select(F.col("root").alias("x"), "y")
        both = one.join(roots.select(F.col("x").alias("y"), "root"), "y").select("x", F.col("root").alias("y"))
        edges = materialise(both.where("x <> y").distinct())
        if edges.isEmpty():
            return whole.select(F.col("x").alias("node"), F.col("root").alias("component"))


def _pieces(nodes, shingles):
    """Into how many groups so many nodes with so many shingles together are dealt."""
    return F.ceil(F.greatest(nodes / GROUP, shingles / GROUP_SHINGLES)).cast("long")


def families(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """A written table: unit, gid for the units that crowded tokens put together, from rows (unit, crowd) and nodes (unit, node, n).

    `crowd` is the smallest unit of a crowded token, in one row of each of its units, else null. Units that share a passage but do not link would meet in pairs at each of its tokens. The smallest unit of a crowded
    token is its leader; a unit goes with the leader of most of its crowded tokens, and what goes with one leader is dealt to
    groups. Where a unit goes changes no link, as groups are compared within and with each other.
    """
    led = rows.where(F.col("crowd").isNotNull()).select("unit", F.col("crowd").alias("leader")).repartition("unit").groupBy("unit", "leader").agg(F.count("*").alias("c"))
    best = led.groupBy("unit").agg(F.max(F.struct("c", "leader"))["leader"].alias("leader"))
    held = nodes.groupBy("unit").agg(F.count("*").alias("nodes"), F.sum("n").alias("n"))
    best = materialise(best.join(held, "unit"))
    pieces = best.groupBy("leader").agg(_pieces(F.sum("nodes"), F.sum("n")).alias("pieces"))
    return materialise(best.join(pieces, "leader").select("unit", F.xxhash64("leader", F.pmod(F.xxhash64("unit"), F.col("pieces")), F.lit("family")).alias("gid")))


def group_pairs(rows: DataFrame) -> DataFrame:
    """x, y: groups of rows (token, n, at, component, gid) between which a link is possible, x the smaller number."""
    # Linked nodes of n and m shingles share an overlap o, so of the first n - o + l and m - o + l of their tokens l at
    # least are common, for any l that the asking tokens reach. l is taken as half of the most: their places then say
    # how large the other node may be, so that a token which many have behind more tokens of their own than a link
    # allows brings no two of them together; and a few tokens that two texts share by chance are not enough.
    reach = F.col("n") * (1 - _HALF_OVERLAP) - F.col("at") + 1e-6
    columns = {"least": F.min("n"), "most": F.max("n"), "reach": F.max(reach), "low": F.min("component"), "high": F.max("component")}
    # One exchange, by token, serves the matrix and both sides of the join.
    matrix = rows.select("token", "gid", "n", "at", "component").repartition("token").groupBy("token", "gid").agg(*[v.alias(k) for k, v in columns.items()])
    x, y = (matrix.select("token", F.col("gid").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s in "xy")
    fits = F.lit(True)
    for a, b in ("xy", "yx"):
        fits &= (F.col(f"{a}_most") * 100 >= F.col(f"{b}_least") * PERCENT) & (F.col(f"{a}_reach") >= F.col(f"{b}_least") * (_HALF_OVERLAP + _HALF_NEEDED))
    one = F.greatest("x_high", "y_high") == F.least("x_low", "y_low")
    met = x.join(y, "token").where((F.col("x") < F.col("y")) & ~one & fits).groupBy("x", "y").agg(F.count("*").alias("c"), *[(F.min if c == "least" else F.max)(f"{s}_{c}").alias(f"{s}_{c}") for s in "xy" for c in ("least", "most")])

    def fewest(a, b):
        """If all of group a have one size: of b's sizes the least and the largest that can link ask for the fewest shared tokens."""
        n = F.col(f"{a}_least")
        low, high = F.greatest(F.col(f"{b}_least"), F.ceil(n * PERCENT / 100)), F.least(F.col(f"{b}_most"), F.floor(n * 100 / PERCENT))
        # Between these sizes rounding may ask for one less.
        return F.least(_least_common(n, low), _least_common(n, high)) - F.when(low < high, 1).otherwise(0)

    even = lambda s: F.col(f"{s}_least") == F.col(f"{s}_most")
    return met.where(F.col("c") >= F.floor(F.when(even("x"), fewest("x", "y")).when(even("y"), fewest("y", "x")).otherwise(0) / 2)).select("x", "y")


def link(sets: DataFrame) -> DataFrame:
    """a, b: links between nodes that join exactly the nodes which all links join. sets: as of shingle_sets()."""
    start, spark = mark(), sets.sparkSession
    shared = shared_tokens(sets)
    pairs = materialise(leader_pairs(shared))
    heads = pairs.select("gid", F.col("gid").alias("node"), F.col("gid").alias("component")).distinct()
    first = open_groups(heads, pairs.select("gid", "node", F.col("node").alias("component")), heads.limit(0), sets)
    known = components(first)
    # Units: components, those of many nodes in pieces; a node without links is a unit of its own.
    known = known.join(sets.where("n > 0").select("node", "n").dropDuplicates(["node"]), "node")
    size = known.groupBy("component").agg(_pieces(F.count("*"), F.sum("n")).alias("pieces"))
    grouped = materialise(known.join(size, "component").select("node", "component", F.pmod(F.xxhash64("node"), F.col("pieces")).alias("piece")))
    rows = shared.join(grouped, "node", "left").select("token", "node", "n", "at", F.coalesce("component", "node").alias("component"), F.coalesce("piece", F.lit(0)).alias("piece"))
    # One exchange, by token, tells which tokens are of more than one component and which are crowded.
    rows = rows.select("token", "node", "n", "at", "component", F.xxhash64("component", "piece").alias("unit"))
    whole = Window.partitionBy("token").orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    new = F.coalesce(F.col("unit") != F.lag("unit").over(Window.partitionBy("token").orderBy("unit")), F.lit(True))
    rows = rows.withColumn("_new", new).withColumns({"_a": F.min("component").over(whole), "_b": F.max("component").over(whole), "_units": F.count_if("_new").over(whole), "_first": F.min("unit").over(whole)})
    crowd = F.when(F.col("_new") & (F.col("_units") >= CROWD), F.col("_first"))
    rows = materialise(rows.where("_a < _b").select("token", "node", "n", "at", "component", "unit", crowd.alias("crowd")))
    drop_since(spark, start, first, rows)
    nodes = materialise(rows.select("unit", "node", "component", "n").distinct())
    in_family = families(rows, nodes)
    rows = materialise(rows.drop("crowd").join(in_family, "unit", "left").withColumns({"family": F.col("gid").isNotNull(), "gid": F.coalesce("gid", "unit")}))
    members = materialise(nodes.join(in_family, "unit", "left").select(F.coalesce("gid", "unit").alias("gid"), "node", "component"))
    sizes = materialise(members.groupBy("gid").agg(F.count("*").alias("size")))
    pairs = group_pairs(rows)
    for side in "xy":
        pairs = pairs.join(sizes.select(F.col("gid").alias(side), F.col("size").alias(f"{side}_size")), side)
    swap = F.struct("x_size", "x") > F.struct("y_size", "y")
    asked = materialise(pairs.select(F.when(swap, F.col("x")).otherwise(F.col("y")).alias("gid"), F.when(swap, F.col("y")).otherwise(F.col("x")).alias("asker")))
    queries = materialise(asked.join(members.withColumnRenamed("gid", "asker"), "asker").select("gid", "node", "component"))
    out = materialise(first.union(open_groups(members, queries, kin(rows.where("family")), sets)))
    drop_since(spark, start, out)
    return out


def similarity_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text); extra columns are left out.

    Texts without words have no shingles and are linked with nothing: their class is their own id. Rows that repeat a
    text, with the same doc_id or not, are linked. A row without doc_id has the class of what it is linked with, or
    null. An empty table gives an empty result. Texts of any length count whole. Sets are compared by 40 bits of each
    shingle's 64-bit hash, sizes by all 64, and texts of one set are known by 128 bits: links are those of the shingles
    themselves but for such hashes that agree by chance.
    """
    start = mark()
    sets = shingle_sets(docs)
    joined = components(link(sets))
    members = sets.select("doc_id", "n", "node")
    first = members.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    # What a component's nodes have in common is found over nodes, of which copies are one.
    named = first.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = materialise(named.select("node", "component").join(least, "component").select("node", "component_id"))
    members = materialise(members)
    drop_since(docs.sparkSession, start, by_node, members)
    out = members.join(by_node, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its class, as they are; rows without doc_id stay.

    Rows that repeat a doc_id are one document and stay or go together.
    """
    start = mark()
    gone = materialise(similarity_classes(docs).where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct())
    drop_since(docs.sparkSession, start, gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
SQL = {
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i + 1 : i + 5], ' ')) AS t FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT r.a AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a, n.n
""",
}
