"""SimHash links against brute force."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenward.llm import common, graph, simhash

FOLDER = "/root/testdata/sf0.001"


def fingerprint(text):
    """By the definition, one bit at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(linked):
    """The smallest index that each index reaches."""
    low = np.arange(len(linked))
    while True:
        new = np.array([low[row].min() for row in linked])
        if (new == low).all():
            return low
        low = new


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbZé \t\n\x0b\x1c ", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == fingerprint(text)


def test_long_text_fingerprint():
    text = " ".join(f"w{n % 977}" for n in range(3000))
    assert simhash.fingerprint(text) == fingerprint(text)


def clusters(rng, rule):
    """Random prints, near ones, a dense cluster, and many with the same half."""
    base = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    near = np.repeat(base[:200], 3)
    for _ in range(rule.distance):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    dense = np.array([int(base[0]) ^ (1 << a | 1 << b) for a in range(64) for b in range(a)], dtype=np.uint64)
    same_half = (base[7] & np.uint64(0xFFFFFFFF)) | (rng.integers(0, 2**32, 300, dtype=np.uint64) << np.uint64(32))
    return np.unique(np.concatenate((base, near, dense, same_half)))


@pytest.mark.parametrize("rule", [simhash.EXACT_BITS, simhash.Rule(7, 4)])
def test_links_are_exact(rule, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 8)
    bits = clusters(np.random.default_rng(5), rule)
    prints = simhash.Prints(bits, rule)
    found = []
    for k in range(rule.blocks):
        tree = simhash.Tree()
        tree.attach(1, simhash.fitted(bits[::5], rule.metrics(k), 3))
        deeper = [s for s, home, _ in tree.routes().route(bits, visits=False) if len(home) > 300]
        for shard in deeper:
            (own,) = (bits[home] for s, home, _ in tree.routes().route(bits, visits=False) if s == shard)
            if new := simhash.fitted(own, rule.metrics(k), 2):
                tree.attach(shard, new)
        homes = []
        for _, home, guest in tree.routes().route(bits):
            homes.append(home)
            found.append(prints.links(home, guest, k))
        assert sorted(np.concatenate(homes)) == list(range(len(bits)))  # each lives in one shard
        alone = [home for _, home, _ in tree.routes().route(bits, visits=False)]
        assert sorted(map(tuple, alone)) == sorted(tuple(h) for h in homes if len(h))
    member, root = simhash.spanning(*(np.concatenate(x) for x in zip(*found)))
    got = np.arange(len(bits))
    got[member] = root
    assert (got == closure(np.bitwise_count(bits[:, None] ^ bits[None]) <= rule.distance)).all()


def test_shards_go_on_splitting(spark, monkeypatch):
    """Far deeper than one sample can reach, and over prints that share a block."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 60)
    monkeypatch.setattr(simhash, "FIT_ROWS", 256)
    monkeypatch.setattr(simhash, "FIT_LEVELS", 2)
    rng = np.random.default_rng(9)
    spread = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    same = np.uint64(77) | (rng.integers(0, 2**32, 2000, dtype=np.uint64) << np.uint64(32))
    bits = np.unique(np.concatenate((spread, same, clusters(rng, simhash.EXACT_BITS))))
    prints = spark.createDataFrame([(int(b),) for b in bits.view(np.int64)], "print long").repartition(4)
    trees = simhash.grown(prints, simhash.EXACT_BITS)
    for k, tree in enumerate(trees):
        for _, home, _ in tree.routes().route(bits, visits=False):
            if len(home) > 60:  # what no vantage point splits well
                assert simhash.vantage(np.sort(bits[home]), simhash.EXACT_BITS.metrics(k)) is None or len(home) < 120
    assert sum(len(h) for _, h, _ in trees[0].routes().route(bits, visits=False)) == len(bits)
    edges = simhash.link_edges(prints, simhash.EXACT_BITS).collect()
    place = {int(b): n for n, b in enumerate(bits.view(np.int64))}
    member, root = simhash.spanning(np.array([place[r.a] for r in edges]), np.array([place[r.b] for r in edges]))
    got = np.arange(len(bits))
    got[member] = root
    assert (got == closure(np.bitwise_count(bits[:, None] ^ bits[None]) <= 3)).all()


def test_flood_agrees():
    rng = np.random.default_rng(2)
    bits = np.unique(rng.integers(0, 2**10, 400, dtype=np.uint64) << np.uint64(3))
    prints = simhash.Prints(bits, simhash.EXACT_BITS)
    member, root = simhash.spanning(*prints.flood(np.arange(len(bits))))
    got = np.arange(len(bits))
    got[member] = root
    assert (got == closure(np.bitwise_count(bits[:, None] ^ bits[None]) <= 3)).all()


@pytest.mark.parametrize("small", [0, 10**6])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL_EDGES", small)
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 5), (5, 9), (9, 1), (3, 3), (None, 4), (7, 200), (200, 6)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [[1, 5, 9], [6, 7, 200], list(range(100, 141))]
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark):
    rows = common.table(spark, FOLDER, "documents").select("doc_id", "text").collect()
    bits = np.array([fingerprint(r.text) for r in rows], dtype=np.uint64)
    low = closure(np.bitwise_count(bits[:, None] ^ bits[None]) <= 3)
    ids = np.array([r.doc_id for r in rows])
    want = {r.doc_id: (f"{int(b):016x}", min(ids[low == k])) for r, b, k in zip(rows, bits, low)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, FOLDER).collect()}
    assert got == want


def test_odd_tables(spark, odd_dir):
    rows = simhash.op3_simhash(spark, f"{odd_dir}/odd").collect()
    assert len(rows) == 14
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    zero = "0" * 16
    assert by[(3, zero)] == by[(4, zero)] == by[(5, zero)] == by[(None, zero)] == 3
    assert {c for (i, _), c in by.items() if i in (1, 2)} == {1}
    assert [r.component_id for r in rows if r.doc_id is None and r.fingerprint != zero] == [None]
    assert simhash.op3_simhash(spark, f"{odd_dir}/empty").collect() == []


def test_one_of_each_group_stays(spark, odd):
    odd = odd.selectExpr("*", "'n' as __node", "'b' as __body", "'r' as row", "1.5 as id", "'k' as best")
    kept = simhash.without_near_duplicates(odd)
    assert kept.dtypes == odd.dtypes and set(map(str, kept.collect())) <= set(map(str, odd.collect()))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (-3, 1, 3, 6, 7, 8, 9, 9223372036854775807)] + [(True, 0)]
    assert simhash.without_near_duplicates(odd.limit(0)).collect() == []


def test_copies_have_a_similarity_of_four_fifths(spark):
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"word{n}" for n in range(3000)])
    rows, pairs = [], []
    for n in range(60):
        words = rng.choice(vocabulary, 400)
        rows.append((1000 + n, " ".join(words)))
        edited = words.copy()
        edited[rng.choice(400, 4, replace=False)] = "edited"
        rows.append((2000 + n, " ".join(edited)))
        pairs.append((1000 + n, 2000 + n))
    kept = {r.doc_id for r in simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {1000 + n for n in range(60)} <= kept  # nothing else is near anything
    assert sum(b not in kept for _, b in pairs) >= 58
