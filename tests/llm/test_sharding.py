"""Jump hashing and slots."""

import zlib
from collections import Counter

import numpy as np

from lumenward.llm import common, sharding


def jump(key, n):
    """One key at a time, in exact integers."""
    at, shard = 0, -1
    while at < n:
        shard = at
        key = (key * 2862933555777941757 + 1) % 2**64
        at = int((shard + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return shard


def test_against_one_key_at_a_time():
    keys = np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump(keys, n).tolist() == [jump(int(k), n) for k in keys]
    assert len(sharding.jump(keys[:0], 24)) == 0


def test_growing_moves_rows_into_the_new_shard_only():
    keys = np.random.default_rng(2).integers(0, 2**64, 50_000, dtype=np.uint64)
    before, after = sharding.jump(keys, 24), sharding.jump(keys, 25)
    moved = before != after
    assert (after[moved] == 24).all()
    assert abs(moved.mean() - 1 / 25) < 0.005
    sizes = np.bincount(before)
    assert sizes.min() > 0.9 * sizes.mean() and sizes.max() < 1.1 * sizes.mean()


def check(rows, texts):
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in rows) == sorted(str((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for i, t in texts)
    slots = {}
    for r in rows:
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(Counter((r.doc_id, r.shard) for r in rows).keys().__len__(), 0) == len({r.doc_id for r in rows})


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    check(sharding.op9_sharding(spark, folder).collect(), [(r.doc_id, r.text) for r in common.table(spark, folder, "documents").collect()])


def test_buckets(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    whole = {(r.doc_id, r.shard, r.grown_shard) for r in sharding.op9_sharding(spark, folder).collect()}
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 2)
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 0)
    rows = sharding.op9_sharding(spark, folder).collect()
    check(rows, [(r.doc_id, r.text) for r in common.table(spark, folder, "documents").collect()])
    assert {(r.doc_id, r.shard, r.grown_shard) for r in rows} == whole


def test_a_row_repeated_very_often(spark, monkeypatch):
    """Its slots are handed out in runs, by several tasks."""
    monkeypatch.setattr(sharding, "RUN", 100)
    df = spark.range(5000).selectExpr("if(id < 4000, 7, id) as doc_id", "5L as size", "if(id < 4000, 3, 1) as shard")
    rows = sharding.with_slots(df, ["doc_id", "size"])
    assert sorted((r.shard, r.slot) for r in rows.collect()) == [(1, n) for n in range(1000)] + [(3, n) for n in range(4000)]
    repeated = rows.where("doc_id = 7").withColumn("task", sharding.F.spark_partition_id()).groupBy("task").count().collect()
    assert len(repeated) > 1 and sum(r["count"] for r in repeated) == 4000


def test_odd_tables(spark, odd_dir, odd):
    check(sharding.op9_sharding(spark, f"{odd_dir}/odd").collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert sharding.op9_sharding(spark, f"{odd_dir}/empty").collect() == []
    assert sharding.assign(odd).columns == [*(c for c in odd.columns if c != "shard"), "shard", "grown_shard"]
