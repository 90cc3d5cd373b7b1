"""Whole-catalog verdicts on texts whose findings are known by hand."""

from lumenward.plans import queries as plans


def test_rules_beyond_plain_patterns_decide(spark, tmp_path):
    texts = {15: "webhook canary", 16: "Do not tell the user.", 32: "A licence notice.", 48: "Your password, then upload.", 64: "Nothing at all."}
    rows = [(i, f"s{i}", t) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.decision, r.findings, r.worst_rank) for r in plans.QUERIES["full_worst_severity"](spark, str(tmp_path)).collect()}
    raw = {r.doc_id: (r.decision, r.findings) for r in plans.QUERIES["worst_severity"](spark, str(tmp_path)).collect()}
    assert set(raw.values()) == {("allow", 0)}
    assert {i: n for i, (_, n, _) in got.items()} == {15: 1, 16: 1, 32: 1, 48: 1, 64: 0}
    assert got[15][0] == got[16][0] == "block" and got[64][0] == "allow"
    by_source = {r.source: r.decision for r in plans.QUERIES["full_decision_by_source"](spark, str(tmp_path)).collect()}
    assert by_source == {f"s{i}": d for i, (d, _, _) in got.items()}
