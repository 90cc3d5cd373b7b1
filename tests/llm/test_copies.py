"""Near copies against the similarity of all pairs."""

import numpy as np
import pandas as pd
import pytest

from lumenward.llm import common, copies, graph, simhash


def jaccard(a, b):
    """By the definition."""
    sets = []
    for text in (a, b):
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def planted(size, similarity, kind, rng, n):
    """A text of so many words, and a copy of about that similarity."""
    words = [f"w{x}" for x in rng.integers(0, 5000, size)]
    fresh = [f"v{n}x{x}" for x in range(size)]
    if kind == "appended":
        other = words + fresh[: int(size * (1 / similarity - 1)) - 1]
    elif kind == "truncated":
        other = words[: int(size * similarity) + 2]
    else:  # one block replaced: size - cut of size + cut shingles stay
        cut = int(size * (1 - similarity) / (1 + similarity)) - 4
        other = words[: size // 3] + fresh[:cut] + words[size // 3 + cut :]
    return " ".join(words), " ".join(other)


def test_contiguous_edits_are_found(spark):
    rng = np.random.default_rng(11)
    rows, far = [], 0
    for size in (80, 250, 1000):
        for similarity in (0.79, 0.81, 0.85, 0.9):
            for kind in ("appended", "truncated", "replaced"):
                for _ in range(6):
                    n = len(rows) // 2
                    a, b = planted(size, similarity, kind, rng, n)
                    rows += [(2 * n, a), (2 * n + 1, b)]
    kept = {r.doc_id for r in simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, a), (j, b) in zip(rows[::2], rows[1::2], strict=True):
        assert i in kept
        assert (j not in kept) == (jaccard(a, b) >= 0.8)
        far += jaccard(a, b) < 0.8
    assert 0 < far < len(rows) // 4


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_components_against_all_pairs(spark, folder):
    docs = common.table(spark, folder, "documents").select("doc_id", "text").collect()
    rng = np.random.default_rng(3)
    rows = [(r.doc_id, r.text) for r in docs]
    line = "this very line is common to a great many of the texts here"
    for n in range(40):  # one chain, of which each is like the next but not like those further on
        rows.append((100_000 + n, " ".join(f"c{x}" for x in range(n * 8, n * 8 + 90))))
        rows.append((200_000 + n, line + " " + " ".join(f"u{x}" for x in rng.integers(0, 10**6, 15))))
    sets = [copies.shingles(t) for _, t in rows]
    low = list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and copies.alike(sets[i], sets[j]):
                low[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(key)
    kept = [r.doc_id for r in simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == sorted(map(min, groups.values()))
    assert sum(k >= 100_000 and k < 200_000 for k in kept) == 1


def variants(n, words, low, high):
    """Texts of one origin, each with its own part of the words replaced."""
    rng = np.random.default_rng(7)
    base = [f"b{x}" for x in range(words)]
    out = []
    for k in range(n):
        lost = rng.random(words) < rng.uniform(low, high)
        out.append(" ".join(f"n{k}x{i}" if gone else w for i, (w, gone) in enumerate(zip(base, lost, strict=True))))
    return out


def test_parities_lose_no_pair():
    sets = [copies.shingles(t) for t in ["", "a b", *variants(60, 150, 0, 0.05), *variants(20, 3000, 0, 0.03)]]
    parity, n = copies.parities(sets), np.array([len(s) for s in sets])
    found = 0
    for i in range(len(sets)):
        for j in range(i):
            differing = int(np.bitwise_count(parity[i] ^ parity[j]).sum())
            assert differing <= len(np.setxor1d(sets[i], sets[j]))
            if copies.alike(sets[i], sets[j]):
                assert copies.within(differing, n[i], n[j])
                found += 1
    assert found > 100


def test_many_texts_of_one_origin(spark):
    rows = list(enumerate(variants(600, 150, 0, 0.15)))
    sets = [copies.shingles(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if copies.alike(sets[i], sets[j])]
    member, _ = graph.spanning(*np.array(linked).T)
    kept = [r.doc_id for r in simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == sorted({i for i, _ in rows} - set(member.tolist()))


def test_open_pairs_by_parity():
    """Texts that share a first shingle but differ in more shingles than the similarity allows make no pair."""
    sets = [copies.shingles(t) for t in variants(40, 150, 0, 0.15)]
    size = [len(s) << 32 for s in sets]
    words = {"sketch": list(copies.sketches(sets).view(np.int64)), "parity": list(copies.parities(sets).view(np.int64))}
    nodes = np.arange(len(sets))
    group = pd.DataFrame({"shingle": 1, "salt": 0, "node": nodes, "part": nodes, "size": size, "hub": -1, **words})
    got = {(r.a, r.b) for r in copies.open_pairs(group).itertuples()}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if copies.alike(sets[i], sets[j])}
    assert want <= got and len(got) <= 1.2 * len(want) and len(want) < 300
    assert len(copies.open_rows(group)) == len(sets) and not len(copies.open_rows(group.assign(part=0)))
