"""Fingerprints and edits against a direct computation."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lumenward.llm import common, fingerprint


def canonical(text):
    once = unicodedata.normalize("NFKC", text)
    return re.sub(r"[\s\x1c-\x1f]+", " ", unicodedata.normalize("NFKC", once.casefold())).strip(" ")


def expected(rows):
    """By id: code points, edited digest, whether canonical forms equal the edited text's and the next one's."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text) // 2
        edited = text[: len(text) - n] + after[:n]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(text) == canonical(edited)), float(canonical(text) == canonical(after))))
    return sorted(out, key=str)


def got(rows):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows), key=str)


@pytest.mark.parametrize("text", ["ﬁne Straße", "ＡＢ ①", "á é", "ΑΣ ΣΑΣ", "  a\t\n b\x1c\xa0 c  ", "İı", "", "🙂 ok", "ẞẛ̣", "İx"])
def test_canonical(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(fingerprint.canonical("t")).first()[0] == canonical(text)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = common.table(spark, folder, "documents").select("doc_id", "text").collect()
    rows = fingerprint.op5_fingerprints(spark, folder).collect()
    assert got(rows) == expected([(d.doc_id, d.text) for d in docs])
    form = {d.doc_id: canonical(d.text) for d in docs}
    pairs = {(form[r.doc_id], r.fingerprint) for r in rows}
    assert len(pairs) == len({f for f, _ in pairs}) == len({p for _, p in pairs})


def test_odd_tables(spark, odd_dir):
    docs = common.table(spark, f"{odd_dir}/odd", "documents").select("doc_id", "text").collect()
    rows = fingerprint.op5_fingerprints(spark, f"{odd_dir}/odd").collect()
    assert got(rows) == expected([(d.doc_id, d.text) for d in docs])
    assert fingerprint.op5_fingerprints(spark, f"{odd_dir}/empty").collect() == []


def test_single_document(spark, tmp_path):
    spark.createDataFrame([(5, "abc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = fingerprint.op5_fingerprints(spark, str(tmp_path)).collect()
    assert (row.edited_sha256, row.near_next) == (hashlib.sha256(b"aba").hexdigest(), 1.0)


def test_equal_buckets_are_compared_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "wide_hash", lambda canon: F.lpad(F.length(canon).cast("string"), 32, "0"))
    df = spark.createDataFrame([(1, "ab"), (2, "AB "), (3, "cd"), (4, "xyz"), (5, None), (6, "cd")], "doc_id long, text string")
    assert [r.hash for r in fingerprint.collided(df).collect()] == ["0" * 31 + "2"]
    rows = {r.doc_id: r for r in fingerprint.exact_groups(df).collect()}
    assert [rows[i].group_id for i in (1, 2, 3, 4, 5, 6)] == [1, 1, 3, 4, 5, 3]
    assert rows[1].fingerprint != rows[3].fingerprint and "-" in rows[1].fingerprint and "-" not in rows[4].fingerprint
    monkeypatch.setattr(fingerprint, "BROADCAST_HASHES", 0)
    assert fingerprint.collided(df).count() == 1


def test_no_python_in_the_plan(spark):
    plan = fingerprint.op5_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_ranges_with_repeated_and_missing_ids(spark, tmp_path, monkeypatch):
    """Ids that a third of the rows share, or lack, are cut into ranges by text."""
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 7)
    rows = [(n % 5 if n % 3 == 0 else None if n % 3 == 1 else n, f"{'Same start ' * 3}{n * 37 % 101} and on" if n % 2 else f"{n * 37 % 101}, other words") for n in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert got(fingerprint.op5_fingerprints(spark, str(tmp_path)).collect()) == expected(rows)
    sizes = fingerprint._with_range(df, "doc_id", "text", fingerprint._bounds(df, "doc_id", "text")).groupBy("__range").count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) < 200


def test_edited_texts_share_the_buckets(spark, tmp_path, monkeypatch):
    """With a hash by length alone, equal fingerprints still mean equal canonical texts, edited ones included."""
    monkeypatch.setattr(fingerprint, "wide_hash", lambda canon: F.lpad(F.length(canon).cast("string"), 32, "0"))
    rows = [(1, "abcd"), (2, "ABCD"), (3, "abxy"), (4, "abab"), (5, "zz"), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = fingerprint.op5_fingerprints(spark, str(tmp_path)).collect()
    assert got(found) == expected(rows)
    edited = {6: "", 5: "za", 4: "abab", 3: "abAB", 2: "ABab", 1: "ab"}
    assert {r.doc_id: r.edited_sha256 for r in found} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in edited.items()}
    prints = {(canonical(t), r.fingerprint) for r in found for i, t in rows if i == r.doc_id} | {(canonical(t), r.edited_fingerprint) for r in found for i, t in edited.items() if i == r.doc_id}
    assert len({a for a, _ in prints}) == len({b for _, b in prints}) == len(prints)
