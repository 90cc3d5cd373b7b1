"""Token counts against the library."""

import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenward.llm import common, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return tokens.RankMerger(open(PATH, "rb").read()), Tokenizer.from_file(PATH)


def library(tokenizer, texts):
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


ALPHABET = list("aaabAB'stre ll\x1c\x1d\x85ΣςİẞéÉﬁ日本語٣४²½ß🙂‍﻿\n\t|_-.,!0") + ["<|endoftext|>", "<|startoftext|>", "'re", "é", "\xa0", " ", "힣", "<|"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join))
@example("")
@example("a" * 3000)
@example("ab" * 2000)
@example("<|endoftext|><|endoftext|>a<|endoftext|>")
def test_count(both, text):
    merger, tokenizer = both
    assert merger.count([text])[0] == library(tokenizer, [text])[0]


def test_query(spark, both):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in common.table(spark, folder, "documents").select("doc_id", "text").collect()}
    rows = tokens.op2_token_counts(spark, folder).collect()
    want = dict(zip(texts, library(both[1], list(texts.values())), strict=True))
    assert {r.doc_id: r.n_tokens for r in rows} == want
    assert all(r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048) for r in rows)


def test_odd_tables(spark, odd_dir, both):
    rows = tokens.op2_token_counts(spark, f"{odd_dir}/odd").collect()
    docs = common.table(spark, f"{odd_dir}/odd", "documents").collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == sorted((len((d.text or "").encode()), library(both[1], [d.text or ""])[0]) for d in docs)
    assert tokens.op2_token_counts(spark, f"{odd_dir}/empty").collect() == []


def test_small_cache(both, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    monkeypatch.setattr(tokens, "ROUND_SYMBOLS", 10)
    texts = ["some words here", "and some more words", "unbelievably", "x"] * 3
    assert both[0].count(texts).tolist() == library(both[1], texts)
