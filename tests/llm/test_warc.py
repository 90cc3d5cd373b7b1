"""WARC bundles: round trips, random access, and the format."""

import base64
import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from lumenward.llm import common, warc


@pytest.fixture
def archive(spark, odd_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    pages = common.table(spark, f"{odd_dir}/odd", "pages")
    return pages, warc.write(pages.repartition(2), f"file://{tmp_path}/bundles")


def expected(pages):
    rows = [(p.page_id, (p.html or "").encode()) for p in pages]
    out = []
    for page_id, data in rows:
        ids = [i for i, d in rows if d == data and i is not None]
        keeper = max(ids) if ids else None
        again = keeper is not None and page_id != keeper
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=str)


def test_read_back(spark, archive):
    pages, index = archive
    assert sorted((tuple(r) for r in warc.read(spark, index).collect()), key=str) == expected(pages.collect())


def test_random_access(archive):
    pages, index = archive
    payloads = {p.page_id: (p.html or "").encode() for p in pages.collect()}
    rows = index.collect()
    assert len(rows) == pages.count()
    for r in rows:
        head, block = warc.fetch(r.path, r.frame_offset, r.frame_bytes, r.record_offset, r.record_bytes)
        assert warc.page_of(head["WARC-Record-ID"]) == r.page_id
        if head["WARC-Type"] == "response" and r.page_id is not None:
            assert block.partition(b"\r\n\r\n")[2] == payloads[r.page_id]
        assert not any("\n" in v for v in head.values())


def test_bundles_are_plain_zstandard(archive):
    _, index = archive
    most = 0
    for (path,) in index.select("path").distinct().collect():
        data = open(path.removeprefix("file://"), "rb").read()
        frames = warc.frames_of(_Bytes(data))
        assert sum(n for _, n, _ in frames) < len(data)
        whole = b"".join(warc.unpacked(data[a : a + n]) for a, n, _ in frames)
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert plain == whole
        kinds = [h["WARC-Type"] for h, _ in warc.records(whole)]
        assert kinds[0] == "warcinfo" and len(kinds) == 1 + index.where(F.col("path") == path).count()
        most = max(most, len(frames))
    assert most > 1


class _Bytes:
    def __init__(self, data):
        self.data, self.at = data, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.at += n
        return out


def test_salted_join_decides_the_same(spark, odd_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 10)
    pages = common.table(spark, f"{odd_dir}/odd", "pages")
    index = warc.write(pages, f"file://{tmp_path}/salted")
    assert sorted((tuple(r) for r in warc.read(spark, index).collect()), key=str) == expected(pages.collect())


def test_damage_is_noticed():
    record = warc.record(1, "u", b"payload", base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), None, False)
    ((head, block),) = warc.records(record)
    assert warc.described(head, block)[1:4] == (7, head["WARC-Payload-Digest"][5:], "response")
    with pytest.raises(ValueError):
        warc.described(head, block.replace(b"payload", b"qayload"))
    with pytest.raises(ValueError):
        list(warc.records(record[:-3]))
    with pytest.raises(ValueError):
        warc.frames_of(_Bytes(b"x" * 20))


def test_query_matches_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet'")
    columns = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = con.sql(f"select {columns} from ({warc.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in warc.op6_warc(spark, folder).select(*columns.split(", ")).collect()) == sorted(want)


def test_odd_tables(spark, odd_dir):
    assert warc.op6_warc(spark, f"{odd_dir}/odd").count() == 10
    assert warc.op6_warc(spark, f"{odd_dir}/empty").collect() == []
