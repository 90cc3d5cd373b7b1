"""Token counts of a word-end byte-pair vocabulary by rank-synchronous array merging.

All pre-tokens of a batch lie end to end in one array of symbols. In each round every sequence finds its own
lowest-rank adjacent pair and all sequences merge theirs at once; a sequence without a known pair is finished
and leaves the arrays. What survives of a sequence is its number of tokens.

Merging all places of a sequence's lowest-rank pair together gives the same symbols as merging one place at a
time from the left, because a pair that a merge creates always has a higher rank than that merge.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenward.llm import common

TOKEN_LIMIT = 2048
#: The vocabulary is broadcast; files beyond this many bytes are refused.
VOCABULARY_BYTES = 64_000_000
#: Distinct words whose counts a worker keeps.
CACHE_WORDS = 200_000
#: Symbols merged together at most (a single longer word is merged alone).
ROUND_SYMBOLS = 4_000_000
_SHIFT = 32
_NONE = np.int64(1 << 40)
# Unicode's white space characters, as the inside of a character class.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte.

    Printable Latin-1 bytes stand for themselves; the others get the letters from U+0100 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class RankMerger:
    """Token counts of texts under one vocabulary file."""

    def __init__(self, vocabulary: bytes) -> None:
        spec = json.loads(vocabulary)
        model, known = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([known[c] for c in letters], dtype=np.int64)
        self.final = np.array([known[c + end] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = np.array([known[a + b] for a, b in pairs], dtype=np.int64)
        keys = np.array([(known[a] << _SHIFT) | known[b] for a, b in pairs], dtype=np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", WHITE)).findall
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.marks = tuple({s[:2] for s in specials})
        self.odd = regex.compile("[\x1c-\x1f]").search
        self.parts = regex.compile(f"[{WHITE}]+").split
        self.cache: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        """Runs without white space. str.split also splits at U+001C to U+001F, which are no white space here."""
        return [w for w in self.parts(text) if w] if self.odd(text) else text.split()

    def pre_tokens(self, word: str) -> tuple[list[str], int]:
        """Pre-tokens of a run without white space, and how many added special tokens stand in it."""
        special, runs = 0, [word]
        if self.special is not None and any(m in word for m in self.marks):
            special, runs = len(self.special.findall(word)), self.special.split(word)
        out: list[str] = []
        for run in runs:
            if not run.isascii():
                run = unicodedata.normalize("NFC", run).replace("Σ", "σ")
            out += self.pieces(run.lower())
        return out, special

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def surviving(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token (none is empty) when no known pair remains."""
        count = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        data = np.frombuffer(b"".join(pre_tokens), np.uint8)
        last = np.cumsum(count) - 1
        ids = self.inner[data]
        ids[last] = self.final[data[last]]
        seq = np.repeat(np.arange(len(count)), count)
        rank = np.full(len(ids), _NONE)
        inside = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inside] = self.ranks(ids[inside], ids[inside + 1])
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            sizes = np.diff(np.append(starts, len(seq)))
            best = np.minimum.reduceat(rank, starts)
            live = best < _NONE
            if not live.all():
                count[seq[starts[~live]]] = sizes[~live]
                stay = np.repeat(live, sizes)
                ids, seq, rank, best, sizes = ids[stay], seq[stay], rank[stay], best[live], sizes[live]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            fresh = np.concatenate(([True], np.diff(hit) != 1))
            run = hit[np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))]
            hit = hit[(hit - run) % 2 == 0]  # in a run such as a-a-a the pairs overlap: every other one merges
            ids[hit] = self.merged[rank[hit]]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            ids, seq, rank = ids[stay], seq[stay], rank[stay]
            new = hit - np.arange(len(hit))
            touched = np.unique(np.concatenate((new, new[new > 0] - 1)))
            paired = touched[touched + 1 < len(ids)]
            paired = paired[seq[paired] == seq[paired + 1]]
            rank[touched] = _NONE
            rank[paired] = self.ranks(ids[paired], ids[paired + 1])
        return count

    def _learn(self, words: list[str]) -> dict[str, int]:
        """Token counts of distinct words."""
        cut = [self.pre_tokens(w) for w in words]
        distinct = list({p for pieces, _ in cut for p in pieces})
        counts: dict[str, int] = {}
        block: list[bytes] = []
        size = at = 0
        for piece in [*distinct, None]:
            data = piece.encode("utf-8", "surrogatepass") if piece is not None else b""
            if block and (piece is None or size + len(data) > ROUND_SYMBOLS):
                counts.update(zip(distinct[at : at + len(block)], self.surviving(block).tolist(), strict=True))
                at, block, size = at + len(block), [], 0
            if piece is not None:
                block.append(data)
                size += len(data)
        return {w: special + sum(map(counts.__getitem__, pieces)) for w, (pieces, special) in zip(words, cut, strict=True)}

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        parts = [self._count(run) for run in common.portions(texts)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _count(self, texts: list[str]) -> np.ndarray:
        cut = [self.words(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = set().union(*cut).difference(self.cache)
        if new:
            self.cache.update(self._learn(list(new)))
        known = self.cache.__getitem__
        return np.fromiter((sum(map(known, words)) for words in cut), np.int64, len(cut))


def token_count(spark: SparkSession, text: Column, vocabulary: str) -> Column:
    """Tokens of a text (null: 0) under the vocabulary file at a path the driver can read.

    The file's bytes are broadcast, so executors need no copy; their size is checked first.
    """
    data = Path(vocabulary).read_bytes()
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has {len(data)} bytes; {VOCABULARY_BYTES} may be broadcast")
    shared = spark.sparkContext.broadcast(data)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merger = RankMerger(shared.value)
        for texts in batches:
            yield pd.Series(merger.count(texts.tolist()))

    return count(common.text_of(text))


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token counts of all documents; row-local, no shuffle.

    Null and empty texts: 0 bytes, 0 tokens. Repeated rows and null ids: a row each. Empty table: no rows.
    Other columns of documents are not read.
    """
    import public_tokenizers

    common.arrow_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    counted = docs.select(
        "doc_id",
        F.octet_length(common.text_of("text")).cast("long").alias("n_bytes"),
        token_count(spark, F.col("text"), vocabulary or public_tokenizers.path("word_bpe_49k.json")).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
