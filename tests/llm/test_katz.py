"""Katz scores against a direct computation, and their normalisation."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenward.llm import katz

TEXTS = ["a b c a b", "a b a b a b c", "b c", "", None, "c c c c d", "a e f", "the cat A B", "b a b a x", "a b c d e f g", "q", "a b"] * 3 + ["z y x w a b c", "b b b b", "unique words only here"]


def tokens(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split() + ["</s>"]


class Brute:
    """The model by its definition."""

    def __init__(self, texts, order):
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            w = tokens(t)
            for i in range(len(w)):
                for m in range(1, order + 1):
                    context = w[max(0, i - m + 1) : i]
                    if len(context) < m - 2:
                        continue  # such a context would reach before the start
                    if len(context) < m - 1:
                        context = ["<s>", *context]
                    self.counts[m][(*context, w[i])] += 1
        self.d = [None] + [katz.discounts([sum(c == r for c in k.values()) for r in range(1, katz.DISCOUNTED + 2)]) for k in self.counts[1:]]
        self.total = sum(self.counts[1].values())

    def factor(self, m, c):
        return self.d[m][c] if c <= katz.DISCOUNTED else 1.0

    def p(self, context, w):
        m = len(context) + 1
        if m == 1:
            freed = sum(c * (1 - self.factor(1, c)) for c in self.counts[1].values())
            if not self.total:
                return 1.0
            if freed <= 0:
                return (self.counts[1][(w,)] + 1) / (self.total + len(self.counts[1]) + 1)
            c = self.counts[1][(w,)]
            return (c * self.factor(1, c) if c else freed) / self.total
        shorter = context[1:]
        seen = {g[-1]: c for g, c in self.counts[m].items() if g[:-1] == context}
        if not seen:
            return self.p(shorter, w)
        n = sum(seen.values())
        freed = sum(c * (1 - self.factor(m, c)) for c in seen.values()) / n
        rest = 1 - sum(self.p(shorter, x) for x in seen)
        if rest <= 1e-12:
            return seen[w] / n if w in seen else freed * self.p(shorter, w)
        if freed <= 0:
            return seen[w] / (n + 1) if w in seen else self.p(shorter, w) / (n + 1) / rest
        return seen[w] * self.factor(m, seen[w]) / n if w in seen else freed / rest * self.p(shorter, w)


@pytest.mark.parametrize(("order", "salt"), [(1, 20_000), (2, 20_000), (2, 3)])
def test_scores(spark, monkeypatch, order, salt):
    monkeypatch.setattr(katz, "ROWS_PER_OWNER", 5)
    monkeypatch.setattr(katz, "SALT_TOKENS", salt)
    rows = [(i, t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    got = {r.doc_id: r for r in katz.katz_scores(df, "doc_id", "text", "train", order)[0].collect()}
    brute = Brute([t for _, t, train in rows if train], order)
    for i, t, _ in rows:
        w = tokens(t)
        assert got[i].n_tokens == len(w)
        assert got[i].n_known == sum(brute.counts[1][(x,)] > 0 for x in w)
        base = sum(math.log10((brute.counts[1][(x,)] + 1) / (brute.total + len(brute.counts[1]) + 1)) for x in w)
        assert got[i].base_score == pytest.approx(base, abs=1e-9)
        line = ["<s>", *w]
        want = sum(math.log10(brute.p(tuple(line[max(0, k + 2 - order) : k + 1]), x)) for k, x in enumerate(w))
        assert got[i].score == pytest.approx(want, abs=1e-9), (i, t)


def test_probabilities_add_up_to_one():
    for order in (2, 3):
        brute = Brute(TEXTS, order)
        words = [*{g[0] for g in brute.counts[1]}, "<unknown>"]
        for context in {g[:-1] for g in brute.counts[order]} | {("never", "seen")[: order - 1]}:
            assert sum(brute.p(context, w) for w in words) == pytest.approx(1, abs=1e-9)


def test_trigram_blocks_agree_with_one_block(spark, monkeypatch):
    rows = [(i, t, i % 5 != 0) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    whole = {r.doc_id: r.score for r in katz.katz_scores(df.coalesce(1), "doc_id", "text", "train", 3)[0].collect()}
    monkeypatch.setattr(katz, "BLOCK_BYTES", 20)
    monkeypatch.setattr(katz, "SALT_TOKENS", 5)
    cut = {r.doc_id: r.score for r in katz.katz_scores(df.repartition(5), "doc_id", "text", "train", 3)[0].collect()}
    assert whole.keys() == cut.keys()
    assert all(whole[i] == pytest.approx(cut[i], abs=1e-9) for i in whole)
    brute = Brute([t for _, t, train in rows if train], 3)
    for i, t, _ in rows:
        w = tokens(t)
        line = ["<s>", *w]
        want = sum(math.log10(brute.p(tuple(line[max(0, k - 1) : k + 1]), x)) for k, x in enumerate(w))
        assert whole[i] == pytest.approx(want, abs=1e-9), t


@pytest.mark.parametrize("order", [2, 3])
def test_the_tables_add_up_to_one(spark, monkeypatch, order):
    """The operator's own tables: seen words by discounted counts, the rest by the backoff weight."""
    monkeypatch.setattr(katz, "ROWS_PER_OWNER", 5)
    monkeypatch.setattr(katz, "SALT_TOKENS", 4)
    monkeypatch.setattr(katz, "CHUNK_ROWS", 5)
    rows = [(i, t, i % 5 != 0) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    _, tables = katz.katz_scores(df, "doc_id", "text", "train", order)
    grams = [t.grams.toPandas() for t in tables]
    one = tables[0].model
    unigram = dict(zip(grams[0]["id"], one.unigram(grams[0]["count"].to_numpy()), strict=True))
    unknown = float(one.unigram(np.array([0]))[0])
    assert sum(unigram.values()) + unknown == pytest.approx(1, abs=1e-9)
    for k in range(1, order):
        model, contexts = tables[k].model, {r.context: r for r in tables[k].weights.collect()}
        assert grams[k].groupby("context")["count"].sum().to_dict() == {c: r.total for c, r in contexts.items()}
        if k > 1:
            continue
        for context, own in grams[k].groupby("context"):
            n = contexts[context].total
            low = sum(unigram[w] for w in own["word"])
            bare = not any(model.factor(np.array([c]))[0] < 1 for c in own["count"])
            seen = sum(c / (n + 1) if bare else model.factor(np.array([c]))[0] * c / n for c in own["count"])
            assert seen + contexts[context].backoff * (1 - low) == pytest.approx(1, abs=1e-9)


def test_another_split_between_passes(spark, monkeypatch, tmp_path):
    """Blocks are found by their number, not by where they come up: lost executors and other splits change nothing."""
    monkeypatch.setattr(katz, "BLOCK_BYTES", 60)
    monkeypatch.setattr(katz, "SALT_TOKENS", 6)
    rows = [(i, t, i % 5 != 0) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(4).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    scored, _ = katz.katz_scores(df, "doc_id", "text", "train", 2)
    whole = sorted(map(tuple, scored.collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "40")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        again = katz.katz_scores(df, "doc_id", "text", "train", 2)[0]
        assert [r[0] for r in sorted(map(tuple, scored.collect()))] == [r[0] for r in whole]
        for a, b in zip(whole, sorted(map(tuple, again.collect())), strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-9)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_odd_tables(spark, odd_dir):
    rows = katz.op1_katz(spark, f"{odd_dir}/odd").collect()
    assert len(rows) == 14
    assert all(r.n_tokens >= 1 and math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert {r.n_tokens for r in rows if r.doc_id == 7} == {30_002}
    assert len({r.train_tokens for r in rows}) == 1
    assert katz.op1_katz(spark, f"{odd_dir}/empty").collect() == []


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, train boolean")
    (row,) = katz.katz_scores(df, "doc_id", "text", "train")[0].collect()
    assert (row.base_score, row.score, row.n_known) == (0, 0, 0)


def test_pack_round_trip():
    arrays = [np.array([], np.int64), np.array([1, 300, 70_000]), np.array([2**63 + 5], np.uint64), np.array([0.5, -1.25])]
    for a, b in zip(arrays, katz.unpack(katz.pack(*arrays)), strict=True):
        assert (a == b).all() and len(a) == len(b)
