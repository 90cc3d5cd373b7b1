"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the weights of its words; the bag's is
the noisy-or of its sentences: 1 - prod(1 - p). Only the noisy-or meets a label in training, so the model has to
find out which sentences a label is about, and can then point at them. A word's weight is the sum over its
hashed features (the word and its prefixes), so that inflected forms unseen in training share weights. Words
only add evidence: weights are never negative, the bias is, and a word counts once in a sentence. A sentence's
probability is measured from that of one without evidence, which has none: else every very long document would be
toxic by its length. In training a small leak stands for labels that no sentence explains.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenward.llm import common

#: Labelled documents the classifier is fitted on, about so many of either class at most.
TRAIN_ROWS_PER_CLASS = 2000
#: Characters of one labelled text that are trained on, about: of a longer one, sentences chosen by their hash.
TRAIN_TEXT_CHARS = 20_000
#: Words after which a sentence without an end is cut for that choice.
LONG_SENTENCE = 200
THRESHOLD = 0.3
#: A sentence of a predicted document is reported from this probability on; the worst one always.
SENTENCE_THRESHOLD = 0.2
FEATURES = 1 << 18
PREFIXES = (3, 4, 5, 6)
#: Features that fewer chunks of training documents have get no weight.
MIN_DOCUMENTS = 3
ROUNDS = 200
RATE = 0.1
DECAY = 1e-4
START_BIAS = -6.0
LEAK = 0.03
CACHE_CHUNKS = 150_000
_EDGE = "\x00.,;:!?\"'()[]{}<>*_`«»“”‘’¿¡…-"
_CHUNKS = re.compile(r"\S+\n?|\n")


def chunks_of(text: str) -> list[str]:
    """Runs without white space; one that a line end follows ends in U+0000."""
    return text.replace("\n", "\x00 ").split()


def features_of(chunk: str) -> list[int]:
    """Feature numbers of a chunk; none if it has no letter or digit."""
    word = chunk.strip(_EDGE).lower()
    if not word:
        return []
    parts = ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % FEATURES for p in parts]


def ends(chunk: str) -> bool:
    """Whether a sentence ends with this chunk."""
    return chunk[-1] in "\x00.!?" or chunk.rstrip("\"')]»”’")[-1:] in (".", "!", "?")


def part_of(text: str) -> str:
    """What is trained on of a text: all of it, or of a long one sentences of TRAIN_TEXT_CHARS characters in all.

    The choice depends on the sentences' words alone and keeps their order. A sentence without an end in sight is
    cut into runs of words, so that one endless sentence is sampled too.
    """
    if len(text) <= TRAIN_TEXT_CHARS:
        return text
    found: list[str] = []
    run: list[str] = []
    for chunk in chunks_of(text):
        run.append(chunk[:TRAIN_TEXT_CHARS])
        if ends(chunk) or len(run) == LONG_SENTENCE:
            found.append(" ".join(run))
            run = []
    found.append(" ".join(run))
    chosen, size = set(), 0
    for at in sorted(range(len(found)), key=lambda i: (xxhash.xxh64_intdigest(found[i].encode("utf-8", "surrogatepass")), i)):
        if size + len(found[at]) < TRAIN_TEXT_CHARS:
            chosen.add(at)
            size += len(found[at]) + 1
    return " ".join(found[at] for at in sorted(chosen)).replace("\x00 ", "\n").replace("\x00", "\n")


@dataclass
class Model:
    """Feature weights, the bias of a sentence, and what a document has without any evidence."""

    weights: np.ndarray
    bias: float
    base: float = 0.0


class Scorer:
    """Sentence and document probabilities; chunks keep their number in a bounded cache."""

    def __init__(self, model: Model, limit: int = CACHE_CHUNKS) -> None:
        self.model, self.limit = model, limit
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.weight, self.stop = np.zeros(0), np.zeros(0, bool)

    def _learn(self, chunks: list[list[str]]) -> None:
        if len(self.numbers) > self.limit:
            self._clear()
        new = list(set().union(*chunks).difference(self.numbers)) if chunks else []
        if new:
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
            own = [features_of(c) for c in new]
            flat = self.model.weights[np.fromiter(chain.from_iterable(own), np.int64)].astype(np.float64)
            at = np.repeat(np.arange(len(new)), [len(x) for x in own])
            self.weight = np.concatenate((self.weight, np.bincount(at, weights=flat, minlength=len(new))))
            self.stop = np.concatenate((self.stop, np.fromiter(map(ends, new), bool, len(new))))

    def sentences(self, chunks: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability (0 without evidence), document number and first chunk (over all documents) of each sentence."""
        self._learn(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(chunks)), np.int64, int(sizes.sum()))
        if not len(numbers):
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = self.stop[numbers]
        last &= ~np.append(last[1:], False)  # a sentence of one word belongs to the one before it
        last[np.cumsum(sizes)[sizes > 0] - 1] = True
        first = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
        sentence = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(numbers))))
        self.once = np.unique((sentence << 32) | numbers)
        logit = np.bincount(self.once >> 32, weights=self.weight[self.once & 0xFFFFFFFF], minlength=len(first)) + self.model.bias
        calm = 1 / (1 + np.exp(-self.model.bias))
        p = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - calm) / (1 - calm)
        return np.clip(p, 0, 1), np.repeat(np.arange(len(sizes)), sizes)[first], first

    def scores(self, texts: list[str]) -> np.ndarray:
        """The noisy-or of each text's sentences; 0 without any."""
        parts = [self._scores(run) for run in common.portions(texts)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _scores(self, texts: list[str]) -> np.ndarray:
        chunks = [chunks_of(t) for t in texts]
        p, document, _ = self.sentences(chunks)
        none = np.exp(np.bincount(document, weights=np.log1p(-np.minimum(p, 1 - 1e-15)), minlength=len(texts)))
        return 1 - (1 - self.model.base) * none

    def offending(self, text: str) -> list[tuple[int, int, float]]:
        """(start, stop, probability) in characters of the sentences that the score is due to."""
        spans = [m.span() for m in _CHUNKS.finditer(text)]
        p, _, first = self.sentences([[text[a:b].replace("\n", "\x00") for a, b in spans]])
        if not len(p):
            return []
        until = np.append(first[1:], len(spans)) - 1
        chosen = (p >= SENTENCE_THRESHOLD) | (p == p.max())
        return [(spans[a][0], spans[b][1], float(x)) for a, b, x in zip(first[chosen], until[chosen], p[chosen], strict=True)]


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Weights by Adam on the noisy-or likelihood of whole bags. Without both classes: that class for all."""
    start = Model(np.zeros(FEATURES, np.float32), START_BIAS)
    if not toxic.any() or toxic.all():
        return Model(start.weights, START_BIAS, float(toxic.any()))
    scorer, parts, n_sentences, n_bags = Scorer(start, limit=1 << 62), [], 0, 0
    for run in common.portions(texts):  # chunks of a portion at a time
        _, bag, first = scorer.sentences([chunks_of(t) for t in run])
        if len(first):
            parts.append((bag + n_bags, (scorer.once >> 32).astype(np.int32) + n_sentences, (scorer.once & 0xFFFFFFFF).astype(np.int32)))
        n_sentences, n_bags = n_sentences + len(first), n_bags + len(run)
    names = list(scorer.numbers)
    if not names:
        return start
    bag, sentence, numbers = (np.concatenate(x) for x in zip(*parts, strict=True))
    del scorer, parts
    features, sizes = [], []
    for k in range(0, len(names), 10_000):  # lists of some names at a time
        own = [features_of(c) for c in names[k : k + 10_000]]
        features.append(np.fromiter(chain.from_iterable(own), np.int32))
        sizes.append(np.fromiter(map(len, own), np.int32, len(own)))
    feature, n_names = np.concatenate(features), len(names)
    holder = np.repeat(np.arange(n_names, dtype=np.int32), np.concatenate(sizes))
    del names, own, features, sizes
    used, feature = np.unique(feature, return_inverse=True)
    holders = np.unique(bag[sentence].astype(np.int64) << 32 | numbers) & 0xFFFFFFFF  # each chunk once a bag
    in_bags = np.bincount(holders, minlength=n_names)
    frequent = np.bincount(feature, weights=in_bags[holder], minlength=len(used)) >= MIN_DOCUMENTS
    w, bias = np.zeros(len(used)), START_BIAS
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    y, scale = toxic[bag], (weight / weight.sum())[bag]
    for t in range(1, ROUNDS + 1):
        word = np.bincount(holder, weights=w[feature], minlength=n_names)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(sentence, weights=word[numbers], minlength=n_sentences) + bias, -30, 30)))
        calm = 1 / (1 + np.exp(-bias))
        silent = np.bincount(bag, weights=np.log1p(-np.minimum(p, 1 - 1e-12)) - np.log1p(-calm), minlength=len(texts))
        none = ((1 - LEAK) * np.exp(silent))[bag]
        pull = np.where(y, -none / np.maximum(1 - none, 1e-9), 1.0) * scale
        g = pull * p
        by_word = np.bincount(numbers, weights=g[sentence], minlength=n_names)
        grad = np.bincount(feature, weights=by_word[holder], minlength=len(used)) + DECAY * w
        grad_b = (pull * (p - calm)).sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.999 * vb + 0.001 * grad_b**2
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = np.maximum(w, 0) * frequent
        bias -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = w
    return Model(weights, float(bias))


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.pmod(common.crc_of_id(key), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from a bounded sample of the labelled rows that are not held out.

    About TRAIN_ROWS_PER_CLASS rows of each class at most, chosen by a hash of the key; weights restore the classes'
    true shares. Several labels of one key: toxic if any says so; several texts: the least. Null labels and keys
    are left out. Long texts are trained on in part, see part_of().
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("__y"))
    share = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in sorted(share):
        part = common.sampled(known.where(F.col("__y") == y), "__key", share[y], TRAIN_ROWS_PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return fit([], np.zeros(0, bool), np.zeros(0))

    @F.pandas_udf("string")
    def part(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(part_of)

    texts = docs.select(F.col(key).alias("__key"), common.text_of(text).alias("__text")).join(F.broadcast(chosen), "__key")
    # Of several texts with one key the least counts; they meet on the map side, however many there are.
    texts = texts.groupBy("__key", "__y").agg(F.min("__text").alias("__text")).select("__key", "__y", part("__text").alias("__text"))
    rows = texts.toArrow().sort_by("__key")
    label_of = rows.column("__y").to_numpy()
    found = rows.column("__text").to_pylist()
    del rows
    pa.default_memory_pool().release_unused()
    weight = np.ones(len(label_of))
    for y in share:
        weight[label_of == y] = share[y] / max(1, (label_of == y).sum())
    return fit(found, label_of > 0, weight)


def score_of(spark: SparkSession, text: Column, model: Model) -> Column:
    """struct<score, offending>: a text's probability, and where its offending sentences stand.

    offending is empty below THRESHOLD.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score:double,offending:array<struct<start:int,stop:int,score:double>>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.tolist()
            scores = scorer.scores(texts)
            spans = [[{"start": a, "stop": b, "score": p} for a, b, p in scorer.offending(t)] if s >= THRESHOLD else [] for t, s in zip(texts, scores, strict=True)]
            yield pd.DataFrame({"score": scores, "offending": spans})

    return score(common.text_of(text))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, offending and predicted; columns of these names are replaced. Row-local."""
    kept = [c for c in docs.columns if c not in ("score", "offending", "predicted")]
    both = docs.select(*kept, score_of(docs.sparkSession, F.col(text), model).alias("__tox"))
    return both.select(*kept, "__tox.score", "__tox.offending", (F.col("__tox.score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the model does not predict to be toxic, with their columns, whatever their names.

    Null, empty and white-space texts stay, unless all labels are toxic. Repeated rows: all stay or all go. Null
    ids: scored like others. Very long texts are scored whole. No labels: all stay. Empty table: no rows.
    """
    model = train(docs, labels, text=text)
    # The row travels as one value, so that no column of its own can clash with the score.
    both = docs.select(F.struct(*docs.columns).alias("row"), score_of(docs.sparkSession, F.col(text), model).alias("tox"))
    return both.where(F.col("tox.score") < THRESHOLD).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and offending sentences of all documents.

    Null, empty and white-space texts: score 0, predicted 0. Repeated rows: a row each, equal scores. Null ids:
    scored, never trained on. No labels: score 0; labels of one class: that class for
    all. Empty table: no rows.
    Other columns of documents are not read.
    """
    common.arrow_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "offending")
