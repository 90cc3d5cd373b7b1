"""The pipeline, stage by stage, and as a whole."""

import corpus_pipeline

from lumenward.llm import common, decontaminate, simhash, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, FOLDER, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, FOLDER), name)
        seen.append(name)
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        had = {r.doc_id for r in before.select("doc_id").collect()}
        assert kept <= had
        if name == "sharding":
            assert docs.columns == [*columns, "shard", "grown_shard"] and docs.count() == before.count()
        else:
            assert docs.columns == columns
        if name == "toxicity":
            labels = common.table(spark, FOLDER, "labels")
            model = toxicity.train(before, labels)
            bad = {r.doc_id for r in toxicity.scored(before, model).where("predicted = 1").collect()}
            assert had - kept == bad and bad
        if name == "near_duplicates":
            assert simhash.without_near_duplicates(docs).count() == docs.count()
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.leaked(before, common.table(spark, FOLDER, "benchmark")).collect()}
            assert had - kept == bad
    assert seen == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    again = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))


def test_odd_tables(spark, odd_dir):
    rows = corpus_pipeline.run(spark, f"{odd_dir}/odd").collect()
    assert {r.doc_id for r in rows} <= {None, -3, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9223372036854775807}
    assert corpus_pipeline.run(spark, f"{odd_dir}/empty").collect() == []


def test_run_against_brute_force(spark):
    """Every stage by other code, one document at a time: scores, all pairs, all alignments, SQL, one key at a time."""
    import duckdb
    import pyarrow as pa
    import xxhash
    from test_copies import jaccard
    from test_decontaminate import best, words
    from test_sharding import jump
    from test_toxicity import brute_score

    from lumenward.llm import mixing

    docs = common.table(spark, FOLDER, "documents")
    model = toxicity.train(docs, common.table(spark, FOLDER, "labels"))
    rows = [r for r in docs.collect() if brute_score(model, r.text or "") < 0.3]
    low = list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in enumerate(rows):
        for j in range(i):
            if jaccard(a.text, rows[j].text) >= 0.8:
                low[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r)
    rows = [min(g, key=lambda r: r.doc_id) for g in groups.values()]
    items = [words(r.text) for r in common.table(spark, FOLDER, "benchmark").collect()]
    rows = [r for r in rows if not any(best(words(r.text), item) for item in items if sum(w in set(words(r.text)) for w in item) >= decontaminate.need_of(len(item)))]
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([r.asDict() for r in rows]))
    taken = {i: (e + (p > 0), n) for i, e, p, n in con.sql(f"select doc_id, epochs, prefix_tokens, taken_tokens from ({mixing.ORACLE})").fetchall()}
    got = {}
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        n, tokens = got.get(r.doc_id, (0, 0))
        got[r.doc_id] = n + 1, tokens + len(common.words_of(r.text))
        key = xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little", signed=True), 42)
        assert (r.shard, r.grown_shard) == (jump(key, 24), jump(key, 25))
    assert got == {i: x for i, x in taken.items() if x[0]}
