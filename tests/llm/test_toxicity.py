"""The toxicity model: held-out accuracy, located sentences, odd tables."""

import numpy as np
import pytest

from lumenward.llm import common, toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(common.table(spark, FOLDER, "documents"), common.table(spark, FOLDER, "labels"))


def test_held_out_accuracy(spark, model):
    docs = toxicity.scored(common.table(spark, FOLDER, "documents").where(toxicity.held_out()), model)
    rows = docs.join(common.table(spark, FOLDER, "labels"), "doc_id").select("toxic", "score", "predicted").toPandas()
    y, p = rows.toxic.to_numpy() > 0, rows.predicted.to_numpy() > 0
    rank = rows.score.rank().to_numpy()
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    # Some labels of this table are noise: documents marked toxic that have none of the words that mark the others.
    assert auc > 0.95
    assert p[y].mean() > 0.8 and p[~y].mean() < 0.01


def test_sentences_are_located(spark, model):
    scorer = toxicity.Scorer(model)
    text = "Plain and calm words. You are an idiot and a moron.\nMore calm words follow here."
    spans = scorer.offending(text)
    assert [text[a:b].strip() for a, b, _ in spans] == ["You are an idiot and a moron."]
    assert scorer.scores([text])[0] > 0.3 > scorer.scores(["Plain and calm words.", ""])[0]


def test_noisy_or(model):
    scorer = toxicity.Scorer(model)
    texts = ["One idiot here. Two words.\nThree", "", "idiot", "x. y. z."]
    p, bag, _ = scorer.sentences([toxicity.chunks_of(t) for t in texts])
    want = [1 - np.prod([1 - x for x, b in zip(p, bag) if b == i]) for i in range(4)]
    assert np.allclose(scorer.scores(texts), want, atol=1e-12)


def test_training_ignores_held_out_rows(spark):
    docs = spark.createDataFrame([(i, "calm words only" if i % 2 else "some idiot words") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert a.bias == b.bias and (a.weights == b.weights).all() and a.weights.any()


def test_odd_tables(spark, odd_dir):
    rows = toxicity.op8_toxicity(spark, f"{odd_dir}/odd").collect()
    assert len(rows) == 14
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in rows if r.doc_id in (3, 4, 5)} == {0.0}
    assert toxicity.op8_toxicity(spark, f"{odd_dir}/empty").collect() == []


def test_one_class(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(9)], "doc_id long, text string")
    for y in (0, 1):
        labels = spark.createDataFrame([(i, y) for i in range(9)], "doc_id long, toxic int")
        assert {r.predicted for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()} == {y}


def test_columns_stay(spark, odd):
    """Also those named as the model's own: names, types and values."""
    docs = odd.selectExpr("*", "'mine' as offending", "7 as predicted", "'tox' as tox", "'row' as row")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.dtypes == docs.dtypes
    own = sorted(map(str, docs.collect()))
    rows = sorted(map(str, kept.collect()))
    assert rows and set(rows) <= set(own)


def test_long_texts_are_trained_on(spark, monkeypatch):
    """A class that has long texts only is learnt, from some of its sentences."""
    monkeypatch.setattr(toxicity, "TRAIN_TEXT_CHARS", 400)
    calm = "Calm words stand in this one here.\n" * 3
    docs = spark.createDataFrame([(i, calm if i % 2 else "You idiot there. " * 60) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    assert {(r.doc_id % 2, r.predicted) for r in rows} == {(0, 1), (1, 0)}


def test_part_of_a_long_text(monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_TEXT_CHARS", 1000)
    text = " ".join(f"Sentence number {n} is this." for n in range(200))
    part = toxicity.part_of(text)
    assert 900 < len(part) <= 1000
    places = [text.index(s.strip() + ".") for s in part.split(".") if s.strip()]
    assert places == sorted(places) and len(set(places)) == len(places)
    endless = toxicity.part_of("word " * 3000)
    assert 0 < len(endless) <= 1000 and toxicity.part_of("short\ntext") == "short\ntext"


def brute_score(model, text):
    """The score from its definition: word features, sentences, noisy-or, one at a time and by other code."""
    import math
    import zlib

    sentences, run = [], []
    for line in text.split("\n"):
        for token in line.split():
            bare = token.rstrip("\"')]»”’")
            run.append(token)
            if bare[-1:] in (".", "!", "?") or token[-1] in ".!?":
                sentences.append(run)
                run = []
        if run:
            sentences.append(run)
        run = []
    joined = []
    for s in sentences:  # a sentence of one word belongs to the one before it
        if joined and len(s) == 1:
            joined[-1] = joined[-1] + s
        else:
            joined.append(list(s))
    calm = 1 / (1 + math.exp(-model.bias))
    none = 1.0
    for s in joined:
        logit = model.bias
        for token in set(s):
            word = token.strip(toxicity._EDGE).lower()
            for feature in ["=" + word, *(word[:n] for n in (3, 4, 5, 6) if len(word) >= n)] if word else []:
                logit += float(model.weights[zlib.crc32(feature.encode()) % toxicity.FEATURES])
        p = (1 / (1 + math.exp(-logit)) - calm) / (1 - calm)
        none *= 1 - min(max(p, 0), 1)
    return 1 - none


def test_scores_against_the_definition(spark, model):
    rows = toxicity.scored(common.table(spark, "/root/testdata/sf0.001", "documents"), model).collect()
    texts = [r.text for r in rows if "\x00" not in r.text]
    own = [r.score for r in rows if "\x00" not in r.text]
    want = [brute_score(model, t) for t in texts]
    assert np.mean(np.isclose(own, want, atol=1e-6)) > 0.97
    assert all((a >= 0.3) == (b >= 0.3) for a, b in zip(own, want, strict=True))
