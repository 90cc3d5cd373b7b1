"""Benchmark decontamination by spaced-seed hashing.

A fixed mask over a window of words keeps some positions and ignores the others, so a substituted word at an
ignored position leaves the window's hash as it was. The masks below miss no stretch of up to 20 words with one in
five substituted, wherever the substitutions are. Hashes of benchmark and document windows are joined; every hit
names a diagonal (how far the item is shifted against the document), and along it the two texts are compared word
by word. A leak is a stretch of the diagonal with at least four in five words equal: the one with most to gain, or
all of the overlap if that is good enough.

What is broadcast has a fixed size, whatever the benchmark's: bit maps of its words and of its hashes, which say
what cannot be in it. Document windows that may be in it become rows and are joined with the benchmark's; frequent
hashes are dealt to several tasks. Each text is verified once, however many rows have it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenward.llm import common

#: Kept (1) and ignored (0) positions, by the least number of words of the items that they are for.
MASKS = {1: None, 5: ("1101", "1011"), 8: ("11101", "1111"), 16: ("1111011", "1110100011", "10101111")}
#: Equal words that a leak needs; of a shorter item, four fifths of its words.
MIN_EQUAL = 13
SHARE = 0.8
#: A substituted word costs as much as this many equal words earn: the share above.
COST = 4
#: Bits of the maps of words and of hashes, as powers of two.
WORD_BITS, HASH_BITS = 24, 26
#: Hits of one hash that one task joins, about.
SALT_ROWS = 100_000
#: Leaking texts (16 bytes each) that may be broadcast.
BROADCAST_ROWS = 1_000_000
CACHE_CHUNKS = 150_000
_EDGE = b".,;:!?\"'()[]{}<>*_`%#-"
#: Codes of bare punctuation, which is no word, and of words that the benchmark does not have.
_NONE, _OTHER = 0, 1
LEAK = "item_id long, n_equal int, item_words int, start int, stop int"


def normal(word: bytes) -> bytes:
    """A word in lower case (of all scripts) without ASCII punctuation at its ends."""
    bare = word.strip(_EDGE)
    return bare if bare.isascii() else bare.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for an item of so many words; one of up to four words is looked for whole."""
    least = max((k for k in MASKS if k <= n), default=0)
    return () if not least else MASKS[least] or ("1" * n,)


def need_of(n: int) -> int:
    """Equal words that a leak of an item of so many words needs."""
    return min(MIN_EQUAL, -(-4 * n // 5))


class Coder:
    """Texts as 64-bit codes of their words; chunks keep their number in a bounded cache, numbers their code."""

    def __init__(self, known: np.ndarray | None = None) -> None:
        self.known = known
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.table = np.zeros(0, np.uint64)

    def _learn(self, words: list[list[bytes]]) -> None:
        if len(self.numbers) > CACHE_CHUNKS:
            self._clear()
        new = list(set().union(*words).difference(self.numbers)) if words else []
        if new:
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
            bare = [normal(w) for w in new]
            code = np.fromiter(map(xxhash.xxh64_intdigest, bare), np.uint64, len(bare)) | np.uint64(2)
            if self.known is not None:
                code[~on(self.known, _top(code, bits_of(self.known)))] = _OTHER
            code[np.fromiter(map(len, bare), np.int64, len(bare)) == 0] = _NONE
            self.table = np.concatenate((self.table, code))

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code, text and place among the text's chunks of every word; bare punctuation is left out."""
        words = [common.words_of(t) for t in texts]
        self._learn(words)
        size = np.fromiter(map(len, words), np.int32, len(words))
        number = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int32, int(size.sum()))
        code = self.table[number]
        text = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        place = np.arange(len(code), dtype=np.int32) - np.repeat(np.cumsum(size, dtype=np.int32) - size, size)
        solid = code != _NONE
        return code[solid], text[solid], place[solid]


def bits_of(bitmap: np.ndarray) -> int:
    """The size of a map as a power of two."""
    return len(bitmap).bit_length() + 5


def _top(codes: np.ndarray, size: int) -> np.ndarray:
    return codes >> np.uint64(64 - size)


def on(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which bits are set in a map of 64-bit words."""
    return (bitmap[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) == 1


def windows(code: np.ndarray, text: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the windows of a mask that lie in one text and whose kept words the benchmark may have."""
    kept, last = [k for k, c in enumerate(mask) if c == "1"], len(code) - len(mask) + 1
    if last < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    known = code != _OTHER
    full = known[kept[0] : kept[0] + last].copy()
    for k in kept[1:]:
        full &= known[k : k + last]
    at = np.flatnonzero(full)
    at = at[text[at] == text[at + len(mask) - 1]]
    out = np.full(len(at), xxhash.xxh64_intdigest(mask.encode()), dtype=np.uint64)
    for k in kept:
        out = (out ^ code[at + k]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out, at


def _probes(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the map that a hash sets."""
    return _top(hashes, size), _top(hashes * np.uint64(0x9E3779B97F4A7C15), size)


def bitmap(bits: DataFrame, size: int) -> np.ndarray:
    """A map of 2 ** size bits with those of bits(bit long) set; at most 2 ** (size - 6) rows come to the driver."""
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("own")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("own").to_numpy().view(np.uint64)
    return out


class Benchmark:
    """The items of a benchmark and their seeds as tables, and what is broadcast of them."""

    def __init__(self, items: DataFrame, key: str = "item_id", text: str = "text") -> None:
        spark = items.sparkSession
        word_bits, hash_bits = WORD_BITS, HASH_BITS
        rows = items.where(F.length(F.trim(common.text_of(text))) > 0)
        self.items = common.written(rows.select(F.monotonically_increasing_id().alias("item"), F.col(key).cast("long").alias("item_id"), F.col(text).alias("item_text")), "items")

        def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            coder = Coder()
            for batch in batches:
                for item, own in zip(batch["item"], batch["item_text"], strict=True):
                    code, text, _ = coder.codes([own])
                    for mask in masks_of(len(code)):
                        hashes, at = windows(code, text, mask)
                        yield pd.DataFrame({"mask": mask, "hash": hashes.view(np.int64), "item": item, "inside": at.astype(np.int32)})

        def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            coder = Coder()
            for batch in batches:
                for own in batch["item_text"]:
                    yield pd.DataFrame({"bit": _top(np.unique(coder.codes([own])[0]), word_bits).view(np.int64)})

        def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"bit": np.concatenate(_probes(batch["hash"].to_numpy(np.int64).view(np.uint64), hash_bits)).view(np.int64)})

        self.seeds = common.written(self.items.mapInPandas(seeds, "mask string, hash long, item long, inside int"), "seeds")
        self.masks = sorted(r.mask for r in self.seeds.select("mask").distinct().collect())
        maps = bitmap(self.items.mapInPandas(words, "bit long"), word_bits), bitmap(self.seeds.select("hash").mapInPandas(probes, "bit long"), hash_bits)
        self.maps = spark.sparkContext.broadcast(maps)

    def hits(self, text: Column) -> Column:
        """struct<hash, at>: the windows of a text that the benchmark may have, null if there is none."""
        shared, masks = self.maps, self.masks

        @F.pandas_udf("struct<hash:array<long>,at:array<int>>")
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known, seeded = shared.value
            coder = Coder(known)
            for batch in batches:
                out: list[dict | None] = []
                for texts in common.portions(batch.tolist()):
                    code, text, _ = coder.codes(texts)
                    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
                    for mask in masks:
                        hashes, at = windows(code, text, mask)
                        a, b = _probes(hashes, bits_of(seeded))
                        maybe = on(seeded, a)
                        maybe[maybe] = on(seeded, b[maybe])
                        found.append((hashes[maybe], at[maybe]))
                    hashes, at = (np.concatenate(x) for x in zip(*found, strict=True))
                    begin = np.searchsorted(text, np.arange(len(texts)))
                    order = np.argsort(text[at], kind="stable")
                    hashes, at = hashes[order].view(np.int64), at[order]
                    cut = np.searchsorted(text[at], np.arange(len(texts) + 1))
                    out += [{"hash": hashes[a:b], "at": (at[a:b] - begin[t]).astype(np.int32)} if b > a else None for t, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
                yield pd.DataFrame({"hash": [x and x["hash"] for x in out], "at": [x and x["at"] for x in out]}).astype(object)

        return find(common.text_of(text))


def verified(text: str, item: str, shifts: list[int]) -> dict | None:
    """The best leak of an item in a text along the given diagonals: equal words, and where the stretch stands (word numbers)."""
    coder = Coder()
    (words, _, place), (own, _, _) = coder.codes([text]), coder.codes([item])
    best: dict | None = None
    for shift in sorted(set(shifts)):
        a, b = max(shift, 0), min(shift + len(own), len(words))
        if b <= a:
            continue
        equal = words[a:b] == own[a - shift : b - shift]
        run = np.concatenate(([0], np.cumsum(np.where(equal, 1, -COST))))
        gain = run - np.minimum.accumulate(run)
        stop = int(gain.argmax())
        start = int(run[: stop + 1].argmin())
        n = int(equal[start:stop].sum())
        if n < equal.sum() >= SHARE * len(equal):  # substitutions near the ends cost more than they stand for
            start, stop, n = 0, len(equal), int(equal.sum())
        if n >= need_of(len(own)) and n > (best or {}).get("n_equal", 0):
            best = {"n_equal": n, "item_words": len(own), "start": int(place[a + start]), "stop": int(place[a + stop - 1]) + 1}
    return best


def digest(text: Column) -> list[Column]:
    """128 bits that stand for a text (null: empty)."""
    own = common.text_of(text)
    return [F.xxhash64(own).alias("h1"), F.xxhash64(F.lit("second lane"), own).alias("h2")]


def suspects(docs: DataFrame, text: str, benchmark: Benchmark, *carried: Column) -> DataFrame:
    """(carried, h1, h2, text, hits) of the rows whose text has any window that the benchmark may have, written."""
    rows = docs.select(*carried, *digest(F.col(text)), F.col(text).alias("__text"), benchmark.hits(F.col(text)).alias("__hits"))
    return common.written(rows.where("__hits.hash is not null"), "suspects")


def leaks(found: DataFrame, benchmark: Benchmark) -> DataFrame:
    """(h1, h2, LEAK) of every text of suspects() and every item that it leaks, written; equal texts are one."""
    once = found.groupBy("h1", "h2").agg(F.first(F.struct("__text", "__hits")).alias("own"))
    once = common.written(once.select("h1", "h2", "own.*"), "once")
    hits = once.select("h1", "h2", F.inline(F.arrays_zip(F.col("__hits.hash").alias("hash"), F.col("__hits.at").alias("at"))))
    # Hits and seeds of a frequent hash meet in several tasks: each hit in one of them, the seeds in all.
    frequent = common.written(hits.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SALT_ROWS).select("hash", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")), "frequent")
    salts = F.coalesce("salts", F.lit(1))
    hits = hits.join(frequent, "hash", "left").withColumn("salt", F.pmod(F.xxhash64("h1", "at"), salts).cast("int")).drop("salts")
    seeds = benchmark.seeds.join(frequent, "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    pairs = hits.join(seeds, ["hash", "salt"]).select("h1", "h2", "item", (F.col("at") - F.col("inside")).alias("shift")).distinct()
    pairs = common.written(pairs.groupBy("h1", "h2", "item").agg(F.collect_list("shift").alias("shifts")), "diagonals")

    @F.pandas_udf("struct<n_equal:int,item_words:int,start:int,stop:int>")
    def verify(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, items, shifts in batches:
            rows = [verified(t, i, s) or {} for t, i, s in zip(texts, items, shifts, strict=True)]
            yield pd.DataFrame({k: pd.array([r.get(k) for r in rows], dtype="Int32") for k in ("n_equal", "item_words", "start", "stop")})

    both = pairs.join(once.select("h1", "h2", "__text"), ["h1", "h2"]).join(benchmark.items, "item")
    checked = both.select("h1", "h2", "item_id", verify("__text", "item_text", "shifts").alias("leak"))
    return common.written(checked.select("h1", "h2", "item_id", "leak.*").where("n_equal is not null"), "leaks")


def leaked(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, LEAK): a row for each document and benchmark item that it leaks."""
    own = Benchmark(benchmark)
    found = suspects(docs, text, own, F.col(key))
    return found.select(key, "h1", "h2").join(leaks(found, own), ["h1", "h2"]).drop("h1", "h2")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that leak no benchmark item, with their columns, whatever their names.

    Null and empty texts stay. Repeated rows: all stay or all go. Empty benchmark: all stay. Empty table: no rows.
    """
    own = Benchmark(benchmark)
    with common.temporary(docs.sparkSession) as kept:
        kept.append(common.scratch(docs.sparkSession, "leaking"))
        bad = common.written(leaks(suspects(docs, text, own), own).select("h1", "h2").distinct(), "leaking", kept[0])
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    # The row travels as one value, so that no column of its own can clash with the digests.
    rows = docs.select(F.struct(*docs.columns).alias("row"), *digest(F.col(text)))
    return rows.join(bad, ["h1", "h2"], "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it leaks: equal words, and word numbers of the stretch.

    Null and empty texts or items: no rows. Repeated documents or items: a row each. Null ids: kept as null.
    Empty tables: no rows. Other columns are not read.
    """
    common.arrow_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaked(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_equal", "item_words", "start", "stop")
