"""SimHash near duplicates with vantage-point trees.

Fingerprints of 64 bits that differ in at most d bits agree up to d // k bits in one of k equal blocks of bits.
For each block there is one vantage-point tree. A node has a vantage point p, a mask of the bits that its Hamming
distance looks at, and a radius m: fingerprints within m of p go inside, the others outside. By the triangle
inequality two fingerprints at most r masked bits apart have distances to p that differ by at most r, so only the
outside fingerprints at distance m + r or less can have a partner inside: those also visit the inside. A node looks
at its tree's block (r = d // k), or, where all have the same block, at all bits (r = d).

Trees grow over the whole table until no shard has more than SHARD_ROWS fingerprints: in each round, samples of
the shards that are too large are split on the executors, and the driver gets the new nodes only. Each shard
grows its own lower levels in memory. Every candidate pair is compared on all 64 bits, so the links are exact;
samples decide the balance of the shards alone.

EXACT_BITS links equal shingle fingerprints up to three bits: two blocks of 32 bits. Near copies for removal are
linked by such trees first, and completed to all pairs of a similarity by copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenward.llm import common, copies, graph
from lumenward.llm.graph import spanning

SEED = 42
SHINGLE_WORDS = 3


@dataclass(frozen=True)
class Rule:
    """When two prints link: at most `distance` differing bits, looked for by so many blocks."""

    distance: int
    blocks: int

    @property
    def width(self) -> int:
        return 64 // self.blocks

    @property
    def radius(self) -> int:
        """Differing bits of the closest block, at most."""
        return self.distance // self.blocks

    def mask(self, k: int) -> int:
        """The bits of the k-th block."""
        return ((1 << self.width) - 1) << (k * self.width)

    def metrics(self, k: int) -> list[tuple[int, int]]:
        """(mask, how many masked bits partners can differ in) that the k-th tree's nodes may use, the best first."""
        return [(self.mask(k), self.radius), (ALL_BITS, self.distance)]


ALL_BITS = (1 << 64) - 1
EXACT_BITS = Rule(distance=3, blocks=2)
#: Prints of a shard that a split is fitted on, about, and the levels that one round adds at most.
FIT_ROWS = 8_192
FIT_LEVELS = 8
#: Distinct prints of one shard, at most (but for prints that no vantage point splits).
SHARD_ROWS = 32_768
#: A split must leave each side at most this part of its prints, visitors included.
SIDE = 0.85
#: Residents of a leaf that are compared without further splits.
LEAF_ROWS = 96
#: Cells of one comparison matrix.
MATRIX = 1 << 21
#: Hashes counted at once.
CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of all runs of n words, joined by single spaces; of the whole sequence if it is shorter."""
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < n:
        return np.array([digest(line, SEED)], dtype=np.uint64)
    stops = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in stops)]
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops[n - 1 :], strict=False)), np.uint64, len(words) - n + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        octets = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        if len(octets) < 512:
            ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            ones += np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None) -> int:
    """The shingle fingerprint of a text as an unsigned integer; zero for a text without words."""
    words = common.words_of(text)
    return majority(shingle_hashes(words, SHINGLE_WORDS)) if words else 0


def fingerprint_of(text: Column) -> Column:
    """The shingle fingerprint as 8 bytes, highest first; null texts count as empty."""

    @F.pandas_udf("binary")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t).to_bytes(8, "big") for t in texts], dtype=object)

    return compute(common.text_of(text))


#: A node of a tree: vantage point, mask, how far partners' distances can lie apart, radius, inside, outside. A
#: negative child is a shard.
Node = tuple[int, int, int, int, int, int]


def vantage(points: np.ndarray, metrics: list[tuple[int, int]]) -> Node | None:
    """The node that splits points best of a few tried, children left at 0; None if none splits them well enough."""
    for mask, reach in metrics:
        best = None
        for k in range(3):
            point = points[(len(points) // 4) * k + len(points) // 8]
            sizes = np.cumsum(np.bincount(np.bitwise_count((points ^ point) & np.uint64(mask)), minlength=65 + reach))
            radius = int(np.argmin(np.abs(2 * sizes[:65] - len(points))))
            most = max(int(sizes[radius + reach]), len(points) - int(sizes[radius]))
            if sizes[radius] and (best is None or most < best[0]):
                best = most, (int(point), mask, reach, radius, 0, 0)
        if best is not None and best[0] <= SIDE * len(points):
            return best[1]
    return None


def split(home: np.ndarray, guest: np.ndarray, node: Node) -> tuple[np.ndarray, ...]:
    """Masks: residents inside, residents outside; guests who visit the inside, the outside; residents outside who also visit the inside."""
    point, mask, reach, radius = np.uint64(node[0]), np.uint64(node[1]), node[2], node[3]
    near, far = (np.bitwise_count((x ^ point) & mask).astype(np.int16) for x in (home, guest))
    inside = near <= radius
    return inside, ~inside, far <= radius + reach, far > radius - reach, ~inside & (near <= radius + reach)


def fitted(points: np.ndarray, metrics: list[tuple[int, int]], depth: int) -> list[Node]:
    """A tree of up to so many levels over points, its root first, its shards numbered from 1; empty if nothing splits them."""
    nodes: list[list[int]] = []
    shards = 0

    def grow(points: np.ndarray, depth: int) -> int:
        nonlocal shards
        cut = vantage(points, metrics) if depth and len(points) >= 16 else None
        if cut is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(list(cut))
        inside = split(points, points[:0], cut)[0]
        nodes[at][4] = grow(points[inside], depth - 1)
        nodes[at][5] = grow(points[~inside], depth - 1)
        return at

    grow(np.sort(points), depth)
    return [tuple(n) for n in nodes]


class Routes:
    """A grown tree as arrays, to be broadcast: 32 bytes a node."""

    def __init__(self, nodes: list[Node], root: int) -> None:
        self.words = np.array([n[:2] for n in nodes], dtype=np.uint64).reshape(-1, 2)
        self.rest = np.array([n[2:] for n in nodes], dtype=np.int32).reshape(-1, 4)
        self.root = root

    def route(self, bits: np.ndarray, visits: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, positions of residents, positions of visitors); without visits, residents only."""
        work = [(self.root, np.arange(len(bits)), np.zeros(0, np.int64))]
        while work:
            at, home, guest = work.pop()
            if not len(home) and not len(guest):
                continue
            if at < 0:
                yield -at, home, guest
                continue
            node = (*self.words[at], *map(int, self.rest[at]))
            a, b, c, d, e = split(bits[home], bits[guest], node)
            work.append((node[4], home[a], np.concatenate((guest[c], home[e])) if visits else guest))
            work.append((node[5], home[b], guest[d]))


class Tree:
    """The top levels over one block, as the driver grows them: one shard at first."""

    def __init__(self) -> None:
        self.nodes: list[list[int]] = []
        self.shards = 1
        self.root = -1
        self.above: dict[int, tuple[int, int]] = {}

    def attach(self, shard: int, new: list[Node]) -> None:
        """Put a fitted tree in place of a shard, whose number its first shard takes over."""
        begin, fresh = len(self.nodes), self.shards

        def moved(child: int) -> int:
            return child + begin if child >= 0 else -shard if child == -1 else child + 1 - fresh

        for n in new:
            self.nodes.append([*n[:4], moved(n[4]), moved(n[5])])
        if shard in self.above:
            at, side = self.above[shard]
            self.nodes[at][side] = begin
        else:
            self.root = begin
        for at in range(begin, len(self.nodes)):
            for side in (4, 5):
                if self.nodes[at][side] < 0:
                    self.above[-self.nodes[at][side]] = at, side
                    self.shards = max(self.shards, -self.nodes[at][side])

    def routes(self) -> Routes:
        return Routes(self.nodes, self.root)


@dataclass
class Prints:
    """Fingerprints, and when they link."""

    bits: np.ndarray
    rule: Rule

    def flood(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spanning edges of members by breadth-first search: each is compared with those not yet reached only.

        Used where no vantage point splits the members, so that a dense cluster costs one pass over it.
        """
        left, out = members, []
        while len(left):
            root, left = left[0], left[1:]
            queue = [root]
            while queue and len(left):
                at = queue.pop()
                near = np.bitwise_count(self.bits[left] ^ self.bits[at]) <= self.rule.distance
                if near.any():
                    out.append((left[near], np.full(int(near.sum()), root)))
                    queue += left[near].tolist()
                    left = left[~near]
        return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (members[:0], members[:0])

    def links(self, home: np.ndarray, guest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Spanning edges of all linked pairs among residents, and between residents and guests, by the tree over block k."""
        metrics = self.rule.metrics(k)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        work = [(home, guest)]
        while work:
            home, guest = work.pop()
            if not len(home):
                continue
            cut = vantage(self.bits[home], metrics) if len(home) > LEAF_ROWS else None
            if cut is not None:
                a, b, c, d, e = split(self.bits[home], self.bits[guest], cut)
                work += [(home[a], np.concatenate((guest[c], home[e]))), (home[b], guest[d])]
                continue
            every = np.concatenate((home, guest))
            if len(home) > 4 * LEAF_ROWS:
                found.append(self.flood(every))
                held += len(found[-1][0])
            else:
                wide = max(1, MATRIX // len(home))
                for at in range(0, len(every), wide):
                    other = every[at : at + wide]
                    i, j = np.nonzero(np.bitwise_count(self.bits[home][:, None] ^ self.bits[other][None, :]) <= self.rule.distance)
                    i, j = home[i], other[j]
                    differ = i != j
                    found.append((i[differ], j[differ]))
                    held += len(found[-1][0])
            if held > MATRIX:
                found = [spanning(*(np.concatenate(x) for x in zip(*found, strict=True)))]
                held = len(found[0][0])
        return spanning(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (home[:0], home[:0])


NODES = "tree int, shard int, nodes array<struct<point:long,mask:long,reach:int,radius:int,inside:int,outside:int>>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grown(prints: DataFrame, rule: Rule) -> list[Tree]:
    """The trees over all prints (print long), split until no shard that can be split has more than SHARD_ROWS.

    Each round fits the shards that are too large on samples of FIT_ROWS, in one group each, and adds up to
    FIT_LEVELS levels; the driver collects nodes, of which there are about twice as many as shards.
    """
    spark = prints.sparkSession
    trees, done = [Tree() for _ in range(rule.blocks)], set()
    while True:
        shared = spark.sparkContext.broadcast([t.routes() for t in trees])

        def residents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                bits = batch["print"].to_numpy(np.int64).view(np.uint64)
                for k, tree in enumerate(shared.value):  # noqa: B023
                    rows = [(k, shard, len(home)) for shard, home, _ in tree.route(bits, visits=False)]
                    yield pd.DataFrame(rows, columns=["tree", "shard", "n"])

        counted = prints.mapInPandas(residents, "tree int, shard int, n long").groupBy("tree", "shard").agg(F.sum("n").alias("n"))
        large = {(r.tree, r.shard): r.n for r in counted.where(F.col("n") > SHARD_ROWS).collect() if (r.tree, r.shard) not in done}
        if not large:
            return trees
        shares = {key: min(1 << 30, int(FIT_ROWS / n * (1 << 30))) for key, n in large.items()}
        depths = {key: min(FIT_LEVELS, int(np.ceil(np.log2(n / SHARD_ROWS))) + 1) for key, n in large.items()}

        def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                bits = batch["print"].to_numpy(np.int64).view(np.uint64)
                luck = (copies.mixed(bits) >> np.uint64(34)).astype(np.int64)
                for k, tree in enumerate(shared.value):  # noqa: B023
                    for shard, home, _ in tree.route(bits, visits=False):
                        some = home[luck[home] < shares.get((k, shard), 0)]  # noqa: B023
                        yield pd.DataFrame({"tree": np.int32(k), "shard": np.int32(shard), "print": bits[some].view(np.int64)})

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            k, shard = int(group["tree"].iloc[0]), int(group["shard"].iloc[0])
            nodes = fitted(group["print"].to_numpy(np.int64).view(np.uint64), rule.metrics(k), depths[k, shard])  # noqa: B023
            named = [{"point": _signed(n[0]), "mask": _signed(n[1]), "reach": n[2], "radius": n[3], "inside": n[4], "outside": n[5]} for n in nodes]
            return pd.DataFrame({"tree": [k], "shard": [shard], "nodes": [named]}).astype({"tree": np.int32, "shard": np.int32})

        new = prints.mapInPandas(sampled, "tree int, shard int, print long").groupBy("tree", "shard").applyInPandas(fit, NODES).collect()
        done |= large.keys()
        for r in new:
            if r.nodes:
                trees[r.tree].attach(r.shard, [(n.point % (1 << 64), n.mask % (1 << 64), n.reach, n.radius, n.inside, n.outside) for n in r.nodes])
                done.discard((r.tree, r.shard))  # its number goes on as one of the new shards
        shared.unpersist()


def link_edges(prints: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): edges that connect all prints (print long, distinct) that links connect.

    Rows grow by the visits only; a shard's edges are at most as many as its prints.
    """
    trees = prints.sparkSession.sparkContext.broadcast([t.routes() for t in grown(prints, rule)])

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["print"].to_numpy(np.int64)
            for k, tree in enumerate(trees.value):
                for shard, home, guest in tree.route(own.view(np.uint64)):
                    at = np.concatenate((home, guest))
                    yield pd.DataFrame({"tree": np.int32(k), "shard": np.int32(shard), "guest": np.arange(len(at)) >= len(home), "print": own[at]})

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        guest, own = group["guest"].to_numpy(bool), group["print"].to_numpy(np.int64)
        a, b = Prints(own.view(np.uint64), rule).links(np.flatnonzero(~guest), np.flatnonzero(guest), int(group["tree"].iloc[0]))
        return pd.DataFrame({"a": own[a], "b": own[b]})

    routed = prints.select("print").mapInPandas(visits, "tree int, shard int, guest boolean, print long")
    return routed.groupBy("tree", "shard").applyInPandas(joined, "a long, b long")


def classes(rows: DataFrame, key: str, rule: Rule) -> DataFrame:
    """(print, low, root, component_id) for every distinct print of rows(key, print).

    low: the smallest non-null key of the print's rows; root: equal for linked prints; component_id: the
    smallest low of the component, null if it has none. Prints are numbers, so that all of it aggregates in place.
    """
    prints = common.written(rows.groupBy("print").agg(F.min(key).alias("low")), "prints")
    roots = graph.components(link_edges(prints, rule)).withColumnRenamed("node", "print")
    placed = prints.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return placed.join(lowest, "root")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = EXACT_BITS) -> DataFrame:
    """(key, print, component_id) of every row of df: its shingle fingerprint as a signed number, and its component."""
    rows = df.select(F.col(key), fingerprint_of(F.col(text)).alias("body"))
    # Two's complement from its hex digits, in two halves.
    half = lambda at: F.conv(F.substring(F.hex("body"), at, 8), 16, 10).cast("long")
    rows = common.written(rows.select(key, F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("print")), "fingerprints")
    return rows.join(classes(rows, key, rule).select("print", "component_id"), "print").select(key, "print", "component_id")


def without_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of near copies: five-word shingles, a similarity of four fifths or more.

    The trees link texts whose five-word fingerprints differ in three bits or fewer; copies confirms those links
    on the whole sets and finds all that fingerprints are too coarse for.

    Of a component the row with the smallest key stays, whole; nulls count as largest. Null, empty and white-space
    texts are copies of each other. Of repeated rows and of equal keys in a component one row stays. Very long
    texts are compared whole. Empty table: no rows. Extra columns stay, whatever their names.
    """
    return copies.without_near_copies(df, lambda prints: link_edges(prints, EXACT_BITS), key, text)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents.

    Null, empty and white-space texts: fingerprint zero, linked like any other. Repeated rows: a row each, the
    same component. Null ids: a row each; they give no component id unless a component has no other (then
    null). Empty table: no rows. Other columns of documents are not read.
    """
    common.arrow_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
