"""The driver contract."""

import __spark_entry__ as entry
from lumenward.plans import queries as plans


def test_names():
    assert set(plans.ORACLES) <= set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"source", "decision", "texts"} == set(rows[0].asDict())


def test_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for name in ("documents", "pages", "conversations", "events"):
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    con.sql("set timezone = 'UTC'")
    for name in ("decision_by_source", "negation_downgrade", "repo_rollup", "keyword_excerpt", "url_parse", "windowed_cooccurrence", "norm_whitespace", "norm_layered", "norm_base64", "norm_html_entities", "full_scan", "full_worst_severity", "finding_delta", "mechanism_suppression", "catalog_stats", "rate_limit_windows"):
        got = plans.QUERIES[name](spark, folder)
        columns = sorted(got.columns)
        want = con.sql(plans.ORACLES[name])
        assert columns == sorted(want.columns), name
        rows = con.sql(f"select {', '.join(columns)} from ({plans.ORACLES[name]})").fetchall()
        plain = lambda r: tuple(str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v) for v in r)
        assert sorted(map(plain, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(plain, rows)), name
