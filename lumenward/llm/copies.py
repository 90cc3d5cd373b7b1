"""Near copies: texts whose five-word shingles have a Jaccard similarity of four fifths or more, all of them.

Links of fingerprints (see simhash) come first and connect most copies cheaply, but at a similarity of four fifths
two fingerprints of 64 bits differ in ten bits or so, more than any tree can look for; so the rest is found by the
sets themselves. Two sets of sizes n and m with that similarity have at least 4/5 * max(n, m) shingles in common.
In any order of all shingles, the first n - ceil(4/5 * n) + 1 of one set and the like of the other share one: no
pair is missed by looking for partners by those alone. At the first shingle that a pair shares, at most the rest of
either set is shared as well, so one of the two stands among the first ninth of its set there: only such rows are
compared with the others of their shingle. The order puts shingles that are frequent in a sample last, so that a
common line brings few together, and deals their rows to several groups; the sample decides the cost alone.

Candidates whose sketches (256 bits of fingerprint) are too far apart for the similarity go first: beyond FAR bits
fewer than one pair in 10^12 of that similarity is lost, as by an unlucky hash. Then go those whose parities differ in
more bits than the sets may differ in shingles: a set's parity has a bit for each of PARITY_BITS classes of shingles,
whether the set has an odd number of them, so each shingle that one of two sets lacks turns one bit, and none is lost.
All others are compared on whole sets.

Partners are compared in three turns, each but for what is connected by then. First each text is compared with the
one, of all that stand for the groups that share a shingle with it, with which it shares most; links of fingerprints
are part of this turn. Then with the others that stand for its groups. Both connect dense clusters at a cost in
proportion to them. Then the remaining pairs of a group, but for those that sizes, places, sketches and parities rule
out: a pair becomes a row only after that, so that many texts of one origin that are not alike make few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenward.llm import common, graph

WORDS = 5
#: The similarity as a fraction.
PART, WHOLE = 4, 5
#: Documents whose shingles are counted for the order, about, and how many frequent ones it knows.
SAMPLE_ROWS = 10_000
FREQUENT = 50_000
#: First shingles that are grouped in one call, about.
BUCKET_ROWS = 200_000
#: Rows of one shingle that one group gets, about, as far as the sample tells.
SALT_ROWS = 50_000
#: So many texts of a dense cluster serve as the one that others are compared with.
HUBS = 8
#: 64-bit words of a sketch, and the differing bits beyond which a pair is not compared. At a similarity of four
#: fifths 15.2 % of the bits differ, 39 of 256 with a deviation of 5.7.
LANES = 4
FAR = 85
#: Bits of a set's parity. Sets of up to some 2,000 shingles that are not alike mostly differ in too many of them.
PARITY_BITS = 1024
#: Texts whose numbers (16 bytes each) may be broadcast.
BROADCAST_ROWS = 500_000
#: Pairs held before repeated ones are dropped.
HELD = 1 << 20
#: Pairs whose sizes, places, sketches and parities are looked at in one go.
CELLS = 1 << 17
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
_LANE = np.arange(1, LANES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, scrambled one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's runs of WORDS words; of the whole text if it is shorter; none without words."""
    words = common.words_of(text)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(WORDS, len(own))
    if not n:
        return own
    out = own[: len(own) - n + 1]
    for k in range(1, n):
        out = mixed(out) + own[k : len(own) - n + 1 + k]
    return np.unique(mixed(out))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """LANES words of fingerprint of each set: the bits that more than half of its shingles' hashes have; 0 for an empty set."""
    out = np.zeros((len(sets), LANES), np.uint64)
    some = [k for k, s in enumerate(sets) if len(s)]
    ones = np.zeros((len(sets), LANES, 64), np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([sets[k] for k in some]) if some else np.zeros(0, np.uint64)
    owner = np.repeat(some, size[some]).astype(np.int64)
    for at in range(0, len(flat), CHUNK):
        part, own = flat[at : at + CHUNK], owner[at : at + CHUNK]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for lane in range(LANES):
            values = part if lane == 0 else mixed(part + _LANE[lane - 1])
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[own[begin], lane] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    if some:
        out[:] = np.packbits(ones * 2 > size[:, None, None], axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    return out


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """PARITY_BITS bits of each set, as 64-bit words: whether it has an odd number of the shingles that fall on a bit."""
    out = np.zeros((len(sets), PARITY_BITS // 8), np.uint8)
    for k, s in enumerate(sets):
        odd = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
        out[k] = np.packbits(odd.astype(np.uint8), bitorder="little")
    return out.view(np.uint64)


def within(differing: np.ndarray | Column, size: np.ndarray | Column, other_size: np.ndarray | Column) -> np.ndarray | Column:
    """Whether sets of these sizes that differ in so many shingles at least can have the similarity."""
    return (PART + WHOLE) * differing <= (WHOLE - PART) * (size + other_size)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have the similarity."""
    both = np.sort(np.concatenate((a, b)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return WHOLE * shared >= PART * (len(both) - shared)


def firsts(own: np.ndarray, frequent: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set by which its partners can be found, in the common order, and how frequent each is in the sample."""
    n = len(own) + PART * len(own) // -WHOLE + 1 if len(own) else 0
    often = np.zeros(len(own), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        often = np.where(frequent[at] == own, times[at], 0)
        order = np.argsort(often, kind="stable")
        own, often = own[order], often[order]
    return own[:n], often[:n]


def possible(size: np.ndarray, place: np.ndarray, other_size: np.ndarray, other_place: np.ndarray) -> np.ndarray:
    """Whether sets whose first shared shingles stand at these places can have the similarity."""
    most = np.minimum(size - place, other_size - other_place)
    return (PART + WHOLE) * most >= PART * (size + other_size)


def leads(size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a set can be the smaller of a possible pair at a place: the first ninth."""
    return (PART + WHOLE) * (size - place) >= 2 * PART * size


def frequent_shingles(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted shingles, how often each occurs) of the most frequent ones in a sample, and how many rows a sampled one stands for."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["text"]:
                yield pd.DataFrame({"shingle": shingles(t).view(np.int64)})

    rows = docs.count()
    some = docs.select(F.col(text).alias("text"))
    some = some if rows <= SAMPLE_ROWS else some.sample(SAMPLE_ROWS / rows, seed=3)
    counted = some.mapInPandas(explode, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    top = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    found, times = top.column("shingle").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(found)
    return found[order], times[order], max(1.0, rows / SAMPLE_ROWS)


def marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, k, id, h1, h2, n, sketch, parity, first, salts) of docs: the whole row, its key and number, its set's 128-bit hash, size, sketch, parity and firsts().

    salts: to how many groups the rows of a first shingle are dealt.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text))

    @F.pandas_udf("struct<h1:long,h2:long,n:int,sketch:array<long>,parity:array<long>,first:array<long>,salts:array<int>>")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        frequent, times, scale = known.value
        for texts in batches:
            out = []
            for run in common.portions(texts.tolist()):
                sets = [shingles(t) for t in run]
                wide = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                first = [firsts(s, frequent, times) for s in sets]
                salts = [(1 + often * scale // SALT_ROWS).astype(np.int32) for _, often in first]
                row = {"h1": wide[:, 0], "h2": wide[:, 1], "n": [len(s) for s in sets], "sketch": list(sketches(sets).view(np.int64)), "parity": list(parities(sets).view(np.int64)), "first": [s.view(np.int64) for s, _ in first], "salts": salts}
                out.append(pd.DataFrame(row).astype({"n": np.int32}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"h1": [], "h2": [], "n": [], "sketch": [], "parity": [], "first": [], "salts": []})

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("k"), compute(common.text_of(F.col(text))).alias("m"))
    return common.written(rows.select("row", "k", F.monotonically_increasing_id().alias("id"), "m.*"), "marked")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def runs(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal neighbours."""
    starts = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]]) if len(shingle) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(shingle)])


def with_hubs(group: pd.DataFrame) -> pd.DataFrame:
    """Rows of shingles that several sets share, with their hub: a set that may lead a pair, the same in all groups of the shingle.

    able: whether the two can be alike. Shingles in which no set can lead a pair are dropped.
    """
    shingle, salt, node, size = (group[c].to_numpy(np.int64) for c in ("shingle", "salt", "node", "size"))
    n, place = size >> 32, size & 0xFFFFFFFF
    lead = leads(n, place)
    scrambled = mixed(node.view(np.uint64) ^ mixed((shingle.view(np.uint64) % np.uint64(HUBS)) + np.uint64(1)))
    order = np.lexsort((scrambled, ~lead, salt, shingle))
    shingle, salt, node, size, n, place, lead = (x[order] for x in (shingle, salt, node, size, n, place, lead))
    starts, lengths = runs(mixed(shingle.view(np.uint64)) + salt.view(np.uint64))
    use = np.repeat((lengths > 1) & lead[starts], lengths)
    hub = np.repeat(starts, lengths)[use]
    at = np.flatnonzero(use)
    able = (node[at] != node[hub]) & possible(n[at], place[at], n[hub], place[hub])
    return pd.DataFrame({"shingle": shingle[at], "salt": salt[at], "node": node[at], "size": size[at], "hub": node[hub], "able": able})


def open_rows(group: pd.DataFrame) -> pd.DataFrame:
    """Rows of shingles whose rows are in several components, but for their hub, with which they were compared before."""
    group = group[(group["node"] != group["hub"]).to_numpy()]
    shingle, salt, part, size = (group[c].to_numpy(np.int64) for c in ("shingle", "salt", "part", "size"))
    order = np.lexsort((salt, shingle))
    starts, lengths = runs(mixed(shingle[order].view(np.uint64)) + salt[order].view(np.uint64))
    use = np.zeros(len(order), bool)
    if len(order):
        part, lead = part[order], leads(size >> 32, size & 0xFFFFFFFF)[order]
        several = (np.maximum.reduceat(part, starts) != np.minimum.reduceat(part, starts)) & np.logical_or.reduceat(lead, starts)
        use = np.repeat(several, lengths)
    return group.iloc[order[use]][["shingle", "salt", "node", "part", "size"]]


def open_pairs(group: pd.DataFrame) -> pd.DataFrame:
    """Distinct pairs (a, b) of open rows that share a shingle, are in two components and can be alike."""
    shingle, salt, node, part, size = (group[c].to_numpy(np.int64) for c in ("shingle", "salt", "node", "part", "size"))
    order = np.lexsort((salt, shingle))
    shingle, salt, node, part, size = (x[order] for x in (shingle, salt, node, part, size))
    n, place = size >> 32, size & 0xFFFFFFFF
    lead = leads(n, place)
    words = lambda c: np.concatenate(group[c].tolist()).view(np.uint64).reshape(len(order), -1)[order] if len(order) else None
    sketch, parity = words("sketch"), words("parity")
    bits = lambda x, i, j: np.bitwise_count(x[i] ^ x[j]).sum(axis=1, dtype=np.int64)
    found, held = [np.zeros((0, 2), np.int64)], 0
    for start, length in zip(*(x.tolist() for x in runs(mixed(shingle.view(np.uint64)) + salt.view(np.uint64))), strict=True):
        rest = np.arange(start, start + length)
        first = rest[lead[rest]]
        high = max(1, CELLS // length)
        for some in (first[at : at + high, None] for at in range(0, len(first), high)):
            # Of two that can both lead, the pair is looked at once.
            keep = (part[rest] != part[some]) & (~lead[rest] | (rest > some)) & possible(n[rest], place[rest], n[some], place[some])
            i, j = np.nonzero(keep)
            i, j = some[i, 0], rest[j]
            use = bits(sketch, i, j) <= FAR
            i, j = i[use], j[use]
            use = within(bits(parity, i, j), n[i], n[j])
            i, j = node[i[use]], node[j[use]]
            if len(i):
                found.append(np.stack((np.minimum(i, j), np.maximum(i, j)), axis=1))
                held += len(i)
                if held > HELD:
                    found = [np.unique(np.concatenate(found), axis=0)]
                    held = len(found[0]) // 2
    pairs = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def apart(a: Column, b: Column) -> Column:
    """In how many bits two arrays of words differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def near(a: Column, b: Column) -> Column:
    """Whether two prints (n, sketch, parity) are close enough for the similarity."""
    return (apart(a["sketch"], b["sketch"]) <= FAR) & within(apart(a["parity"], b["parity"]), a["n"], b["n"])


def confirmed(pairs: DataFrame, prints: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) of prints whose whole sets are alike, written."""
    spark = rows.sparkSession

    @F.pandas_udf("binary")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t).tobytes() for t in texts], dtype=object)

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)], dtype=bool)

    own = lambda end, name: prints.select(F.col("id").alias(end), F.struct("n", "sketch", "parity").alias(name))
    with common.temporary(spark) as kept:
        close = pairs.distinct().join(own("a", "__a"), "a").join(own("b", "__b"), "b").where(near(F.col("__a"), F.col("__b"))).select("a", "b")
        close = common.written(close, "pairs")
        ends = common.written(close.select(F.col("a").alias("id")).union(close.select("b")).distinct(), "ends")
        # Texts are not dealt out for it unless their numbers are too many to broadcast.
        texts = rows.select("id", F.col("row").getField(text).alias("t")).join(small(ends, ends.count()), "id")
        sets = common.written(texts.select("id", whole(common.text_of("t")).alias("s")), "sets")
        both = close.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        kept.append(common.scratch(spark, "links"))
        return common.written(both.where(linked("sa", "sb")).select("a", "b"), "links", kept[0])


def links(rows: DataFrame, prints: DataFrame, n_prints: int, linked_prints: Callable[[DataFrame], DataFrame], text: str) -> DataFrame:
    """(a, b): edges between prints (id, n, sketch, parity) that connect all of them that are alike."""
    spark = rows.sparkSession
    total, most = rows.agg(F.sum(F.size("first")), F.max(F.array_max("salts"))).first()
    buckets = F.lit(max(1, -(-(total or 0) // BUCKET_ROWS)))
    bucket = F.pmod(F.xxhash64("shingle", "salt"), buckets).alias("bucket")
    first = rows.select("id", "n", "first", "salts").join(small(prints.select("id"), n_prints), "id", "left_semi")
    each = F.transform("first", lambda s, i: F.struct(s.alias("shingle"), F.get("salts", i).alias("salts"), F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(i.cast("long")).alias("size")))
    spread = first.select(F.col("id").alias("node"), F.inline(each))
    if (most or 1) > 1:
        # Rows of a frequent shingle that can lead a pair go to all its groups, the others to one.
        lead = (PART + WHOLE) * (F.shiftright("size", 32) - F.col("size").bitwiseAND(0xFFFFFFFF)) >= 2 * PART * F.shiftright("size", 32)
        to = F.when(F.col("salts") == 1, F.array(F.lit(0))).when(lead, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")))
        spread = spread.select("node", "shingle", "size", F.explode(to).alias("salt"))
    else:
        spread = spread.select("node", "shingle", "size", F.lit(0).alias("salt"))
    shared = common.written(spread.groupBy(bucket).applyInPandas(with_hubs, "shingle long, salt int, node long, size long, hub long, able boolean"), "shared")
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    # Fingerprints: the first word of the sketch; one text stands for all of equal ones.
    stands = common.written(prints.groupBy(F.col("sketch")[0].alias("print")).agg(F.min("id").alias("stand")), "stands")
    edges = linked_prints(stands.select("print"))
    ends = lambda name: stands.select(F.col("print").alias(name), F.col("stand").alias(f"stand_{name}"))
    by_prints = edges.join(ends("a"), "a").join(ends("b"), "b").select(*pair("stand_a", "stand_b"))
    equal = prints.select("id", F.col("sketch")[0].alias("print")).join(stands, "print").where("id <> stand").select(*pair("id", "stand"))
    compare = lambda pairs: confirmed(pairs, prints, rows, text)
    connected = lambda edges, end, name: graph.components(edges).select(F.col("node").alias(end), F.col("root").alias(name))
    often = shared.where("able").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = often.groupBy("node").agg(F.max(F.struct("n", "hub")).alias("best"))
    one = compare(best.select(*pair("node", F.col("best.hub"))).union(by_prints).union(equal))
    parts = connected(one, "node", "part")
    placed = shared.where("able").join(parts, "node", "left").join(parts.select(F.col("node").alias("hub"), F.col("part").alias("hub_part")), "hub", "left")
    others = placed.where(F.coalesce("part", "node") != F.coalesce("hub_part", "hub"))
    two = one.unionByName(compare(others.groupBy(*pair("node", "hub")).agg(F.lit(1).alias("one")).select("a", "b")))
    placed = shared.join(connected(two, "node", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    opened = common.written(placed.groupBy(bucket).applyInPandas(open_rows, "shingle long, salt int, node long, part long, size long"), "open")
    opened = opened.join(prints.select(F.col("id").alias("node"), "sketch", "parity"), "node")
    return two.unionByName(compare(opened.groupBy(bucket).applyInPandas(open_pairs, "a long, b long")))


def without_near_copies(df: DataFrame, linked_prints: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of near copies, whole: that with the smallest key.

    Of repeated rows one stays; of a component whose keys are all null, one row stays. Texts without words are
    copies of each other. Extra columns are kept. linked_prints: (a, b) edges between close fingerprints.
    """
    rows = marked(df, key, text)
    # The first row of equal sets stands for them: sets are told apart by 128 bits, and nodes are row numbers.
    prints = rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min(F.struct(F.col("k").isNull(), "k", "id")).alias("best"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("parity").alias("parity"))
    prints = common.written(prints.select("id", "n", "sketch", "parity", "best"), "prints")
    n_prints = prints.count()
    roots = graph.components(links(rows, prints.select("id", "n", "sketch", "parity"), n_prints, linked_prints, text))
    placed = prints.select("id", "best").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    keep = common.written(placed.groupBy("root").agg(F.min("best").alias("best")).select("best.id"), "keep")
    kept = rows.select("id", "row").join(small(keep, keep.count()), "id", "left_semi")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
