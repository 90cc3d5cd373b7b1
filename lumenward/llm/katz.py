"""Language-model scores by Katz backoff.

n-gram counts are discounted by Good-Turing, and the freed mass of a context goes to the words not seen after it,
in proportion to the next shorter context's model; the backoff weight is exactly what makes each context's
probabilities add up to one over the vocabulary and one unknown word.

Texts are read once: tasks cut their rows into blocks and write each block's tokens as numbers, with the block's
own number. For each order a block sends its distinct n-grams, with their counts in training rows, to the task
that owns their context, and gets back their counts in the corpus and their contexts' statistics. An n-gram is one
entry of a block however often it stands there, and entries travel as sorted, byte-transposed, compressed arrays.
The n-grams of a frequent context are dealt to several owners by word; their partial statistics are added up
afterwards, and there are at most HOT_CONTEXTS of them, so they are broadcast.

What owners merge is the model: for each order a table of n-grams with their counts and one of contexts with their
backoff weights (see ngrams() and weights()), partitioned by context. The next order's pass, and the last one,
which adds up each text's tokens, find a block's answers in the shared folder by its number, on whatever executor
and in whatever partition the block comes up.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenward.llm import common

ORDER = 2
#: Counts up to this one are discounted.
DISCOUNTED = 5
#: UTF-8 bytes of the texts of one block (a longer text is a block by itself).
BLOCK_BYTES = 10_000_000
#: Blocks, as a power of two, whose answers stand in one folder; a block's are in one of its files.
BUCKET = 3
#: Rows for each owner of contexts, unless the session has more shuffle partitions.
ROWS_PER_OWNER = 8_000
#: Training tokens after a context that one owner gets, about; and contexts with more owners than one, at most.
SALT_TOKENS, HOT_CONTEXTS = 20_000, 1_000_000
#: n-grams in one row of a model's table.
CHUNK_ROWS = 200_000
#: No word has white space in it.
END = b"\n"
SENT = "part int, block long, body binary"
_STATS = [f"n{r}" for r in range(1, DISCOUNTED + 2)]
_SPECTRUM = [f"s{r}" for r in range(1, DISCOUNTED + 1)]
#: An answer to a block, or a part of the model (block -1): the contexts known in training with their statistics, and
#: their n-grams as a body (see ngrams).
OWNED = (
    "block long, part int, body binary, tokens long, types long, " + ", ".join(f"{s} long" for s in _STATS) + ", contexts array<long>, totals array<long>, "
    + ", ".join(f"{s} array<long>" for s in _SPECTRUM) + ", low array<double>, hot array<boolean>"
)
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<boolean>": pa.list_(pa.bool_())}


# Arrays as compressed bytes.


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed body: integers as narrow as they can be, the bytes of equal weight together."""
    parts = [struct.pack("<H", len(arrays))]
    for a in arrays:
        if a.dtype.kind in "iu":
            top = int(a.max()) if len(a) else 0
            a = a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))
        a = np.ascontiguousarray(a)
        parts += (struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)), a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=3, write_content_size=True).compress(b"".join(parts))


def unpack(body: bytes) -> list[np.ndarray]:
    """What pack() was given; integers come back as int64, except for 64-bit ones, which stay unsigned."""
    data = zstandard.ZstdDecompressor().decompress(body)
    at, out = 2, []
    for _ in range(struct.unpack_from("<H", data)[0]):
        code, n = struct.unpack_from("<2sQ", data, at)
        kind = np.dtype(f"<{code.decode()}")
        size = n * kind.itemsize
        a = np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at + 10).reshape(kind.itemsize, n).T).view(kind).reshape(n)
        out.append(a.astype(np.int64) if kind.kind in "iu" and kind.itemsize < 8 else a)
        at += 10 + size
    return out


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct floats, and which of them each value is."""
    distinct, at = np.unique(values, return_inverse=True)
    return distinct, at


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of integers."""
    z = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


# The model of one order.


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for r up to DISCOUNTED from the numbers of n-grams seen 1, 2, ... DISCOUNTED + 1 times.

    Katz's Good-Turing discounts; where they are undefined or outside (0, 1), as on small tables, absolute
    discounting by n1 / (n1 + 2 n2), kept within 0.1 and 0.9.
    """
    k = DISCOUNTED
    flat = min(0.9, max(0.1, n[0] / (n[0] + 2 * n[1]))) if n[0] else 0.5
    out = np.ones(k + 1)
    cut = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) if n[r - 1] and n[r] and cut < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - flat) / r
    return out


@dataclass
class Order:
    """What one order's n-grams amount to over the corpus."""

    tokens: int
    types: int
    discount: np.ndarray
    n: list[int]

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of words by count; all words of count 0 are one unknown word."""
        freed = sum(self.n[r - 1] * r * (1 - self.discount[r]) for r in range(1, DISCOUNTED + 1))
        if not self.tokens:
            return np.ones(len(c))
        if freed <= 0:
            return (c + 1) / (self.tokens + self.types + 1)
        return np.where(c > 0, self.factor(c) * c, freed) / self.tokens

    def factor(self, c: np.ndarray) -> np.ndarray:
        return np.where(c <= DISCOUNTED, self.discount[np.minimum(c, DISCOUNTED)], 1.0)

    def conditional(self, c: np.ndarray, lower: np.ndarray, c_context: np.ndarray, spectrum: list[np.ndarray], low_seen: np.ndarray) -> np.ndarray:
        """Probabilities of words after contexts.

        c: count of the n-gram; lower: the shorter context's probability; c_context: n-grams in the context;
        spectrum[r - 1]: its n-grams of count r; low_seen: the lower probability of all its seen words.
        Contexts never seen pass lower on. Contexts without a discounted n-gram are smoothed as if one more
        event had been unseen. Contexts after which all of the lower model's mass was seen keep plain shares.
        """
        n = np.maximum(c_context, 1)
        freed = sum(s * r * (1 - self.discount[r]) for r, s in enumerate(spectrum, 1)) / n
        rest = 1 - low_seen
        bare, full = freed <= 0, rest <= 1e-12
        seen = np.where(full, c / n, np.where(bare, c / (n + 1), self.factor(c) * c / n))
        freed = np.where(bare, 1 / (n + 1), freed)
        unseen = np.where(c_context > 0, freed / np.where(full, 1, rest), 1.0) * lower
        return np.where(c > 0, seen, unseen)


    def backoff(self, n: np.ndarray, spectrum: list[np.ndarray], low_seen: np.ndarray) -> np.ndarray:
        """The weights of contexts seen in training: what a word not seen after one gets of the shorter context's probability."""
        freed = sum(s * r * (1 - self.discount[r]) for r, s in enumerate(spectrum, 1)) / n
        return np.where(freed <= 0, 1 / (n + 1), freed) / np.where(1 - low_seen <= 1e-12, 1, 1 - low_seen)


@dataclass
class Hot:
    """Statistics of the contexts that several owners share, by context."""

    context: np.ndarray
    total: np.ndarray
    spectrum: list[np.ndarray]
    low: np.ndarray

    def fill(self, contexts: np.ndarray, at: np.ndarray, columns: list[np.ndarray]) -> None:
        """Put their statistics into columns (total, spectrum..., low) at the given places."""
        k = np.minimum(np.searchsorted(self.context, contexts[at]), max(0, len(self.context) - 1))
        known = self.context[k] == contexts[at] if len(self.context) else np.zeros(len(at), bool)
        for column, own in zip(columns, (self.total, *self.spectrum, self.low), strict=True):
            column[at] = np.where(known, own[k], 0) if len(own) else 0


# Blocks.


def numbered(texts: list[str | None], train: np.ndarray) -> bytes:
    """The tokens of some texts as numbers, packed: words' hashes, tokens, texts' sizes, and which are trained on."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = []

    def tokens() -> Iterator[list[bytes]]:
        for text in texts:
            words = common.words_of(text)
            words.append(END)
            sizes.append(len(words))
            yield words

    code = np.fromiter(map(number.__getitem__, chain.from_iterable(tokens())), np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    return pack(hashes, code, np.array(sizes, np.int64), train.astype(np.uint8))


class Block:
    """The tokens of some texts as numbers, and for each order so far the block's distinct n-grams."""

    def __init__(self, body: bytes) -> None:
        self.hash, self.code, self.size, train = unpack(body)
        self.hash = self.hash.astype(np.uint64)
        self.starts = np.cumsum(self.size) - self.size
        self.train = np.repeat(train.astype(bool), self.size)
        self.words = self.every = self.code
        self.order = 1
        self.at = np.arange(len(self.code))
        self.place = self.at - np.repeat(self.starts, self.size)
        self.p = np.zeros(len(self.code))
        self.keys: tuple[np.ndarray, ...] = (self.hash,)
        self.salts = np.ones(len(self.hash), np.int64)
        self.lower = np.zeros(0)
        self.c1 = self.c = self.gid1 = self.gid = np.zeros(0)

    def sending(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The order in which the current n-grams are sent, and where each part begins in it."""
        salt = mixed(self.keys[-1]) % self.salts.astype(np.uint64)
        part = (mixed(self.keys[0].astype(np.uint64) ^ (salt * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((*reversed(self.keys), part))
        return order, np.searchsorted(part[order], np.arange(parts + 1))

    def sent(self, parts: int) -> Iterator[tuple[int, bytes]]:
        """(part, body) for each part that owns any of the current n-grams."""
        order, cut = self.sending(parts)
        seen = np.bincount(self.code[self.train[self.at]], minlength=len(self.salts))[order]
        keys, hot = [k[order] for k in self.keys], self.salts[order] > 1
        for part in range(parts):
            a, b = cut[part], cut[part + 1]
            if a == b:
                continue
            own = [k[a:b] for k in keys]
            if len(own) == 1:
                yield part, pack(own[0], seen[a:b])
            else:
                begins = np.flatnonzero(np.diff(own[0], prepend=-1))
                yield part, pack(own[0][begins], np.diff(np.append(begins, b - a)), own[1], seen[a:b], *coded(self.lower[order[a:b]]), hot[a:b][begins].astype(np.uint8))

    def answered(self, parts: int, answers: dict[int, bytes], model: Order, hot: Hot | None) -> None:
        """Take the owners' answers for the current n-grams; self.p has the probabilities of their places then."""
        order, cut = self.sending(parts)
        c, gid, p = np.empty(len(order), np.int64), np.empty(len(order), np.int64), np.empty(len(order))
        for part in range(parts):  # one at a time: statistics of contexts are spread over their n-grams
            own = order[cut[part] : cut[part + 1]]
            if not len(own):
                continue
            got = unpack(answers.pop(part))
            c[own], gid[own] = got[0], got[1]
            if len(self.keys) == 1:
                p[own] = model.unigram(c[own])
                continue
            contexts = self.keys[0][own]
            begins = np.flatnonzero(np.diff(contexts, prepend=-1))
            runs = np.diff(np.append(begins, len(own)))
            rest = [np.repeat(x, runs) for x in (*got[2:-2], got[-2][got[-1].astype(np.int64)])]
            shared = np.flatnonzero(self.salts[own] > 1)
            if len(shared):
                hot.fill(contexts, shared, rest)
            p[own] = model.conditional(c[own], self.lower[own], rest[0], rest[1:-1], rest[-1])
        self.c, self.gid = c, gid
        if len(self.keys) == 1:
            self.c1, self.gid1 = c, gid
        self.p[self.at] = p[self.code]

    def longer(self, salt_tokens: int) -> None:
        """Go on to the next order: the n-grams so far become the contexts of the words after them.

        The start of a text is a context for its first word; a longer context that would reach before the start
        does not exist, and the words it would be for keep the probability they have.
        """
        self.order += 1
        context = np.empty_like(self.every)
        context[1:] = self.every[:-1] + 1
        context[self.starts] = 0
        self.at = np.flatnonzero(self.place >= self.order - 2)
        width = len(self.hash)
        self.code, pair = pd.factorize(context[self.at] * width + self.words[self.at])
        first = np.flatnonzero(np.diff(np.maximum.accumulate(self.code), prepend=-1) > 0)  # of each n-gram, in its order
        self.lower = self.p[self.at[first]]
        # As many texts are trained on as ends are; a start is a context of the second order only.
        begun = self.c1[self.words[self.starts + self.size - 1][:1]]
        gids, counts = np.concatenate(([0], self.gid)), np.concatenate((begun, self.c))
        self.salts = 1 + counts[pair // width] // salt_tokens
        self.keys = (gids[pair // width], self.gid1[pair % width])
        self.every = np.full(len(self.words), -1)
        self.every[self.at] = self.code


def cut() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from rows of (id, text, train) to blocks (block, ids, body)."""
    block_bytes = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held = TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Array] = []
        texts: list[str | None] = []
        train: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            own = pa.concat_arrays(ids)
            listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            return pa.RecordBatch.from_arrays([pa.array([(task << 24) + number], pa.int64()), listed, pa.array([numbered(texts, np.concatenate(train))], pa.binary())], names=["block", "ids", "body"])

        for batch in batches:
            at = 0
            sizes = np.array([len(t or "") for t in batch.column(1).to_pylist()], np.int64)
            while at < len(sizes):
                upto = np.cumsum(sizes[at:]) + held
                n = min(int(np.searchsorted(upto, block_bytes)) + 1, len(sizes) - at)
                part = batch.slice(at, n)
                ids.append(part.column(0))
                texts += part.column(1).to_pylist()
                train.append(part.column(2).to_numpy(zero_copy_only=False).astype(bool))
                held, at = int(upto[n - 1]), at + n
                if held >= block_bytes:
                    yield block()
                    number, held, ids, texts, train = number + 1, 0, [], [], []
        if texts:
            yield block()

    return run


def answers_of(folder: str, block: int) -> dict[int, bytes]:
    """The owners' answers to a block, by part. The statistics of the first column, the block, say where they may be."""
    files, path = fs.FileSystem.from_uri(folder)
    out: dict[int, bytes] = {}
    for info in files.get_file_info(fs.FileSelector(f"{path}/bucket={block >> BUCKET}")):
        if not info.base_name.endswith(".parquet"):
            continue
        with files.open_input_file(info.path) as source:
            file = pq.ParquetFile(source)
            for k in range(file.num_row_groups):
                seen = file.metadata.row_group(k).column(0).statistics
                if seen is None or seen.min <= block <= seen.max:
                    rows = file.read_row_group(k, columns=["block", "part", "body"])
                    rows = rows.filter(pc.equal(rows.column("block"), block))
                    out |= dict(zip(rows.column("part").to_pylist(), rows.column("body").to_pylist(), strict=True))
    return out


@dataclass
class Pass:
    """What a task needs to bring its blocks up to an order: the folders of answers and models so far."""

    parts: int
    last: int
    folders: list[str] = field(default_factory=list)
    models: list[Order] = field(default_factory=list)
    hot: list = field(default_factory=list)

    @property
    def salt_tokens(self) -> int:
        """Training tokens after a context from which on it has several owners: few enough contexts have them."""
        return max(SALT_TOKENS, self.models[0].tokens // HOT_CONTEXTS)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, Block]]:
        """(number, ids, block) of each block, up to the last order answered."""
        for batch in batches:
            for k in range(batch.num_rows):
                number, block = batch.column(0)[k].as_py(), Block(batch.column(2)[k].as_py())
                for folder, model, hot in zip(self.folders, self.models, self.hot, strict=True):
                    if block.c1.size:
                        block.longer(self.salt_tokens)
                    block.answered(self.parts, answers_of(folder, number), model, hot and hot.value)
                yield number, batch.column(1)[k].values, block
                del block  # before the next one is built

    def send(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The requests of every block for the order after those answered."""
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])
        for number, _, block in self.blocks(batches):
            if self.folders:
                block.longer(self.salt_tokens)
            rows = list(block.sent(self.parts))
            del block
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    def owned(self, group: pa.Table) -> pa.Table:
        """Merge what all blocks send to one owner: an answer for each block, and the model's table of this part."""
        part, first = group.column("part")[0].as_py(), not self.folders
        sent = [unpack(b.as_py()) for b in group.column("body")]
        sizes = [len(s[0]) if first else len(s[2]) for s in sent]
        if first:
            columns, seen = [np.concatenate([s[0].astype(np.uint64) for s in sent])], np.concatenate([s[1] for s in sent])
        else:
            columns = [np.concatenate([np.repeat(s[0].astype(np.int64), s[1]) for s in sent]), np.concatenate([s[2].astype(np.int64) for s in sent])]
            seen, low = np.concatenate([s[3] for s in sent]), np.concatenate([s[4][s[5]] for s in sent])
        order = np.lexsort(tuple(reversed(columns)))
        columns = [c[order] for c in columns]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        at = np.empty_like(order)
        at[order] = np.cumsum(new) - 1
        columns = [c[new] for c in columns]
        c = np.bincount(at, weights=seen, minlength=len(columns[0])).astype(np.int64)
        gid = np.empty(len(c), np.int64)
        gid[np.argsort(-c, kind="stable")] = np.arange(len(c))  # frequent ones get small numbers
        gid = gid * self.parts + part + 1
        further = len(self.folders) < self.last - 1
        answers, begin = [], 0
        if not first:
            lower = low[order][new]
            context, which = np.unique(columns[0], return_inverse=True)
            in_context = np.bincount(which, weights=c, minlength=len(context)).astype(np.int64)
            spectrum = [np.bincount(which[c == r], minlength=len(context)) for r in range(1, DISCOUNTED + 1)]
            low_seen = np.bincount(which, weights=np.where(c > 0, lower, 0), minlength=len(context))
            hot = np.zeros(len(context), bool)
        for s, n in zip(sent, sizes, strict=True):
            own = at[begin : begin + n]
            begin += n
            if first:
                answers.append(pack(c[own], gid[own]))
            else:
                k = np.searchsorted(context, s[0].astype(np.int64))
                hot[k] |= s[6].astype(bool)
                answers.append(pack(c[own], gid[own] if further else np.zeros(len(own), np.int64), in_context[k], *(x[k] for x in spectrum), *coded(low_seen[k])))
        rows = [{"block": b, "body": a} for b, a in zip(group.column("block").to_pylist(), answers, strict=True)]
        known = c > 0
        grams = [columns[-1][known], c[known], gid[known] if further else c[:0]]
        cuts = np.append(np.arange(0, max(1, int(known.sum())), CHUNK_ROWS), known.sum())
        if not first:
            learnt = in_context > 0
            size = np.bincount(which[known], minlength=len(context))[learnt]
            stats = {"contexts": context[learnt], "totals": in_context[learnt]} | {n: x[learnt] for n, x in zip(_SPECTRUM, spectrum, strict=True)} | {"low": low_seen[learnt], "hot": hot[learnt]}
            ends = np.cumsum(size)  # a row ends with a context
            upto = np.unique(np.append(np.searchsorted(ends, cuts[1:-1]), len(size)))
            cuts = np.concatenate(([0], ends[upto[:-1]], [known.sum()])) if len(size) else cuts
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            row = {"block": -1}
            low_at = high_at = 0
            if not first:
                low_at, high_at = np.searchsorted(ends, (a, b), side="right") if len(ends) else (0, 0)
                row |= {name: x[low_at:high_at] for name, x in stats.items()}
            row["body"] = pack(*(x[a:b] for x in grams), c[:0] if first else size[low_at:high_at])
            totals = {"tokens": int(c.sum()), "types": int(known.sum())} | {f"n{r}": int((c == r).sum()) for r in range(1, DISCOUNTED + 2)}
            rows.append(row | (totals if k == 0 else {}))
        schema = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in OWNED.split(", "))])
        return pa.table([pa.array([r.get(f.name, part if f.name == "part" else None) for r in rows], f.type) for f in schema], schema=schema)

    def owner(self) -> Callable[[pa.Table], pa.Table]:
        """owned() as a function of one argument, which is how Spark tells it from one that wants the key too."""
        return lambda group: self.owned(group)

    def score(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The scores of every text."""
        one = self.models[0]
        for _, ids, block in self.blocks(batches):
            known = block.c1[block.words]
            base = np.log10((known + 1) / (one.tokens + one.types + 1))
            logs = np.log10(np.maximum(block.p, 1e-300))
            sums = lambda x, starts=block.starts: np.add.reduceat(x, starts)
            values = {"n_tokens": block.size, "n_known": sums((known > 0).astype(np.int64)), "base_score": sums(base), "score": sums(logs)}
            del block, known, base, logs, sums
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v) for v in values.values())], names=["id", *values])


def contexts_of(table: DataFrame) -> DataFrame:
    """(context, total, s1.., low, hot): the statistics of every context of an order's table; parts of one context are added up."""
    each = table.select(F.inline(F.arrays_zip("contexts", "totals", *_SPECTRUM, "low", "hot"))).withColumnRenamed("contexts", "context")
    sums = [F.sum(c).alias(c) for c in ("totals", *_SPECTRUM, "low")]
    alone = each.where(~F.col("hot"))
    return alone.unionByName(each.where("hot").groupBy("context").agg(*sums, F.lit(True).alias("hot")).select(*each.columns))


def ngrams(table: DataFrame) -> DataFrame:
    """(context, word, id, count): the n-grams of an order's table that training rows have.

    Words of the first order are hashes, else ids; a context is an id of the order below, 0 the start of a text.
    Null: contexts of the first order, ids of the last.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, contexts in zip(batch.column(0), batch.column(1), strict=True):
                words, counts, ids, sizes = unpack(body.as_py())
                none = pa.nulls(len(words), pa.int64())
                of = pa.array(np.repeat(contexts.values.to_numpy(), sizes.astype(np.int64)), pa.int64()) if contexts.is_valid else none
                yield pa.RecordBatch.from_arrays([of, pa.array(words.astype(np.uint64).view(np.int64)), pa.array(ids.astype(np.int64)) if len(ids) else none, pa.array(counts.astype(np.int64))], names=["context", "word", "id", "count"])

    return table.select("body", "contexts").mapInArrow(rows, "context long, word long, id long, count long")


def weights(table: DataFrame, model: Order) -> DataFrame:
    """(context, total, backoff): the backoff weight of every context of an order that training rows have."""
    n = F.col("totals").cast("double")
    freed = sum((F.col(s) * F.lit(r * float(1 - model.discount[r])) for r, s in enumerate(_SPECTRUM, 1)), F.lit(0.0)) / n
    rest = 1 - F.col("low")
    backoff = F.when(freed <= 0, 1 / (n + 1)).otherwise(freed) / F.when(rest <= 1e-12, 1.0).otherwise(rest)
    return contexts_of(table).select("context", F.col("totals").alias("total"), backoff.alias("backoff"))


@dataclass
class Tables:
    """One order's part of the model."""

    model: Order
    grams: DataFrame
    weights: DataFrame | None


def katz_scores(docs: DataFrame, key: str, text: str, train: str, order: int = ORDER) -> tuple[DataFrame, list[Tables]]:
    """(key, n_tokens, n_known, base_score, score) of all rows under the model of those whose train column is true, and the model.

    Null texts are empty; null train columns count as false. Null and repeated keys: a row each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    kind = dict(rows.dtypes)["id"]
    blocks = common.written(rows.mapInArrow(cut(), f"block long, ids array<{kind}>, body binary"), "blocks")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(blocks.agg(F.sum(F.size("ids"))).first()[0] or 0) // ROWS_PER_OWNER))
    state, tables = Pass(parts, order), []
    for k in range(1, order + 1):
        folder = common.scratch(spark, f"ngrams-{k}")
        owned = blocks.mapInArrow(state.send, SENT).groupBy("part").applyInArrow(state.owner(), OWNED)
        # A block's answers go to one file; the model's rows stay apart by part.
        placed = owned.repartition(parts, F.when(F.col("block") >= 0, F.col("block")).otherwise(-1 - F.col("part")))
        placed.withColumn("bucket", F.shiftright("block", BUCKET)).write.option("compression", "zstd").partitionBy("bucket").parquet(folder)
        table = spark.read.schema(f"{OWNED}, bucket long").parquet(folder).where("bucket < 0")
        total = table.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tokens", "types", *_STATS))).first()
        n = [total[s] for s in _STATS]
        model = Order(total["tokens"], total["types"], discounts(n), n)
        hot = None
        if k > 1:
            own = contexts_of(table).where("hot").sort("context").toArrow()
            column = lambda name: own.column(name).to_numpy()  # noqa: B023, E731
            hot = spark.sparkContext.broadcast(Hot(column("context"), column("totals"), [column(s) for s in _SPECTRUM], column("low")))
        tables.append(Tables(model, ngrams(table), common.written(weights(table, model), f"weights-{k}") if k > 1 else None))
        state = Pass(parts, order, [*state.folders, folder], [*state.models, model], [*state.hot, hot])
    scored = blocks.mapInArrow(state.score, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumnRenamed("id", key), tables


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents.

    Null and empty texts: the end token alone. Repeated rows: a row each, each counted in training. Null ids:
    the CRC of the empty text. No training rows: both scores 0. Empty table: no rows. Other columns of
    documents are not read.
    """
    common.arrow_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(common.crc_of_id(), F.lit(7)) == 2
    scored, tables = katz_scores(docs.withColumn("train", ~held_out), "doc_id", "text", "train")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tables[0].model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
