"""Leaks against a direct comparison of every alignment."""

import random

from lumenward.llm import common, decontaminate

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return [w for w in map(decontaminate.normal, common.words_of(text)) if w]


def best(document, item):
    """The most equal words of a good stretch, over all alignments."""
    top = 0
    need = min(decontaminate.MIN_EQUAL, -(-4 * len(item) // 5))
    for shift in range(1 - len(item), len(document)):
        run = gain = n = 0
        for j in range(max(0, -shift), min(len(item), len(document) - shift)):
            same = document[shift + j] == item[j]
            run, n = (run + (1 if same else -decontaminate.COST), n + same)
            if run <= 0:
                run = n = 0
            elif run > gain:
                gain, found = run, n
        overlap = [document[shift + j] == item[j] for j in range(max(0, -shift), min(len(item), len(document) - shift))]
        if gain and sum(overlap) > found and sum(overlap) >= 0.8 * len(overlap):
            found = sum(overlap)
        if gain and found >= need:
            top = max(top, found)
    return top


def leaks(spark, items, texts):
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): r.n_equal for r in decontaminate.leaked(docs, bench).collect()}


def planted(rng, lengths, substituted):
    """Items, and texts that hold each with words substituted at random places."""
    vocabulary = [f"w{n}" for n in range(500)]
    items, texts = [], []
    for n, length in enumerate(lengths):
        own = rng.choices(vocabulary, k=length)
        items.append((n, " ".join(own)))
        for place in rng.sample(range(length), substituted(length)):
            own[place] = "other"
        texts.append(" ".join(rng.choices(vocabulary, k=60) + own + rng.choices(vocabulary, k=60)))
    return items, texts


def test_substitutions(spark):
    """As many as a leak may have, at random places: none is missed, items of five words included."""
    rng = random.Random(3)
    lengths = [rng.randint(5, 50) for _ in range(400)]
    items, texts = planted(rng, lengths, lambda n: n // 5)
    got = leaks(spark, items, texts)
    for n, (item, text) in enumerate(zip(items, texts, strict=True)):
        want = best(words(text), words(item[1]))
        assert got.get((n, n), 0) == want and (want > 0 or lengths[n] > 15)
    missed = sum((n, n) not in got for n in range(400))
    assert missed <= 12  # stretches that lie so badly that no thirteen equal words have four in five


def test_one_word_of_ten(spark):
    item = "one two three four five six seven eight nine ten"
    texts = [item.replace(w, "other") for w in item.split()]
    got = leaks(spark, [(1, item)], [f"x y z {t} x y z" for t in texts])
    assert got == {(n, 1): 9 for n in range(10)}


def test_masks_miss_nothing_up_to_twenty_words():
    """Every way to substitute one word in five, for items of every length up to there."""
    import itertools

    for n in range(1, 21):
        most = n - decontaminate.need_of(n) if n < 17 else n // 5
        for gone in itertools.combinations(range(n), most):
            here = [k not in gone for k in range(n)]
            assert any(all(here[at + k] for k, c in enumerate(mask) if c == "1") for mask in decontaminate.masks_of(n) for at in range(n - len(mask) + 1)), (n, gone)


def test_exact_copies_case_and_punctuation(spark):
    items = [(1, "The quick brown fox jumps over the lazy dog, then sleeps in the warm ÉTÉ sun."), (2, "one two three four five"), (3, ""), (4, "..."), (5, "one two three four five")]
    text = "Before it: THE QUICK, brown fox jumps over -- the lazy dog then sleeps in the warm été sun!! after one two three four five."
    assert leaks(spark, items, [text, "", "calm", "the quick brown fox", None]) == {(0, 1): 16, (0, 2): 5, (0, 5): 5}


def test_no_leak_over_the_end_of_a_text(spark):
    item = "a1 a2 a3 a4 a5 a6 a7 a8 a9 b1 b2 b3 b4 b5"
    own = item.split()
    assert leaks(spark, [(1, item)], [" ".join(own[:7]), " ".join(own[7:])]) == {}


def test_query_against_brute_force(spark):
    docs = {r.doc_id: words(r.text) for r in common.table(spark, FOLDER, "documents").select("doc_id", "text").collect()}
    items = {r.item_id: words(r.text) for r in common.table(spark, FOLDER, "benchmark").collect()}
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontaminate.op10_decontaminate(spark, FOLDER).collect()}
    want = {}
    for d, document in docs.items():
        here = set(document)
        for i, item in items.items():
            if sum(w in here for w in item) >= decontaminate.need_of(len(item)):
                n = best(document, item)
                if n:
                    want[d, i] = n
    assert got == want and got


def test_frequent_hashes_are_dealt_out(spark, monkeypatch):
    find = lambda: sorted(map(tuple, decontaminate.op10_decontaminate(spark, "/root/testdata/sf0.001").collect()))
    whole = find()
    monkeypatch.setattr(decontaminate, "SALT_ROWS", 2)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "HASH_BITS", 8)  # a full map lets everything through
    assert find() == whole and whole


def test_odd_tables(spark, odd_dir, odd):
    rows = decontaminate.op10_decontaminate(spark, f"{odd_dir}/odd").collect()
    assert sorted((r.doc_id, r.item_id is None) for r in rows) == [(1, False)] * 2 + [(2, False)] * 4 + [(7, True)]
    assert decontaminate.op10_decontaminate(spark, f"{odd_dir}/empty").collect() == []
    docs = odd.selectExpr("*", "array(1) as __leaks", "'h' as h1", "2.5 as h2", "'r' as row")
    kept = decontaminate.without_leaks(docs, common.table(spark, f"{odd_dir}/odd", "benchmark"))
    assert kept.dtypes == docs.dtypes and kept.count() == 10
    assert set(map(str, kept.collect())) <= set(map(str, docs.collect()))
    assert decontaminate.without_leaks(docs, common.table(spark, f"{odd_dir}/empty", "benchmark")).count() == 14
