"""Budgets against a direct computation, and the mixture against its SQL."""

import hashlib
import random

import pytest

from lumenward.llm import common, mixing


def waterfill(total, children):
    """Integer shares of (name, weight, cap) by saturating the smallest cap per weight first."""
    children = sorted((c for c in children if c[1] > 0), key=lambda c: (c[2] / c[1], c[0]))
    out, left, weight = {}, total, sum(w for _, w, _ in children)
    rest = list(children)
    while rest and rest[0][2] * weight <= rest[0][1] * left:
        name, w, cap = rest.pop(0)
        out[name], left, weight = cap, left - cap, weight - w
    run = 0
    for name, w, _ in rest:
        out[name] = left * (run + w) // weight - left * run // weight
        run += w
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets(spark, seed):
    rng = random.Random(seed)
    rows = [(a, b, c, rng.choice([0, 1, 7, 500, 10_000, 10**12])) for a in "xyz" for b in "pq" for c in ("s1", "s2", "s3")]
    weights = {"a": {"x": 3, "y": 1, "z": 0 if seed == 3 else 2}, "b": {"p": 5}, "c": {"s1": 2, "s3": 7}}
    leaves = mixing.capacities(spark.createDataFrame(rows, "a string, b string, c string, tokens long"), 2, ["a", "b", "c"], weights)
    w = lambda level, name: weights[level].get(name, 1)
    caps = {r[:3]: r[3] * 2 if w("a", r[0]) else 0 for r in rows}
    for budget in (0, 1, 1000, 25_000, 10**11, 10**15):
        got = {(r.a, r.b, r.c): r.alloc for r in mixing.budgets(leaves, budget, ["a", "b", "c"], weights).collect()}
        want = dict.fromkeys(caps, 0)
        below = lambda *p: sum(v for k, v in caps.items() if k[: len(p)] == p)
        for a, share_a in waterfill(min(budget, sum(caps.values())), [(a, w("a", a), below(a)) for a in "xyz"]).items():
            for b, share_b in waterfill(share_a, [(b, w("b", b), below(a, b)) for b in "pq"]).items():
                for c, share_c in waterfill(share_b, [(c, w("c", c), caps[a, b, c]) for c in ("s1", "s2", "s3")]).items():
                    want[a, b, c] = share_c
        assert got == want
        assert sum(got.values()) == min(budget, sum(caps.values()))
        assert all(got[k] <= caps[k] for k in caps)


def brute_prefix(docs, epochs, rest):
    """Tokens that each document gives to an epoch after `epochs` whole ones."""
    place = lambda i: int(hashlib.md5(f"{mixing.SEED}|{epochs + 1}|{i}".encode()).hexdigest()[:8], 16)
    out, run = {}, 0
    for i, n in sorted(docs, key=lambda d: (place(d[0]), d[0], d[1])):
        out[i] = max(0, min(n, rest - run))
        run += n
    return out


def test_prefixes_do_not_depend_on_buckets(spark, monkeypatch):
    rows = [(n, "web", "en", "src0" if n % 3 else "src4", n % 37) for n in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long").repartition(5)
    one = sorted(mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 30)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(mixing.mix(df).collect()) == one
    for source in ("src0", "src4"):
        own = [r for r in one if r.source == source]
        epochs = own[0].epochs
        want = brute_prefix([(r.doc_id, r.n_tokens) for r in own], epochs, sum(r.taken_tokens for r in own) - epochs * sum(r.n_tokens for r in own))
        assert {r.doc_id: r.prefix_tokens for r in own} == want


def test_query_matches_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    columns = "doc_id, domain, lang, source, n_tokens, epochs, prefix_tokens, taken_tokens"
    want = con.sql(f"select {columns} from ({mixing.ORACLE})").fetchall()
    got = [tuple(r) for r in mixing.op4_mixing(spark, folder).select(*columns.split(", ")).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[7] for r in got) == sum(r[4] for r in got) * mixing.BUDGET_PERCENT // 100


def test_odd_tables(spark, odd_dir):
    rows = mixing.op4_mixing(spark, f"{odd_dir}/odd").collect()
    assert len(rows) == 14
    assert {r.source for r in rows if r.doc_id == 3} == {""} and {r.domain for r in rows if r.doc_id == 9} == {"other"}
    assert all(0 <= r.prefix_tokens <= r.n_tokens and r.epochs <= mixing.MAX_EPOCHS for r in rows)
    assert mixing.op4_mixing(spark, f"{odd_dir}/empty").collect() == []


def test_mixture(spark, odd):
    docs = odd.unionByName(odd.where("doc_id = 1")).selectExpr("*", "'own' as n_tokens", "'own' as epochs", "'own' as k", "'own' as row", "'own' as copy")
    chosen = mixing.mix(mixing.counted(docs)).collect()
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    texts = rows.collect()
    assert len(texts) == sum(r.epochs + (r.prefix_tokens > 0) for r in chosen)
    assert sum(len(common.words_of(r.text)) for r in texts) == sum(r.taken_tokens for r in chosen)
    assert {(r.n_tokens, r.epochs, r.k, r.row, r["copy"], r["__key"], r.hash) for r in texts} == {("own",) * 5 + (1, 2)}
    assert mixing.mixed(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = mixing.op4_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_without_tokens_come_with_whole_epochs(spark):
    rows = [(n, "one two three", "en", "src0") for n in range(4)] + [(10, "", "en", "src0"), (11, None, "en", "src0"), (12, " \n", "en", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    epochs = {r.doc_id: r.epochs for r in mixing.mix(mixing.counted(docs)).collect()}
    got = [r.doc_id for r in mixing.mixed(docs).collect()]
    assert [got.count(i) for i in (10, 11, 12)] == [epochs[i] for i in (10, 11, 12)] and epochs[10] >= 1
