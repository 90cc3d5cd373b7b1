"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole records, and ends in a seek table: a
skippable frame that lists the compressed and plain size of every frame. An index maps each record to its frame
and to its place inside that frame, so one record costs one seek and one frame. Any Zstandard reader can still
read a bundle from its beginning.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenward.llm import common

#: Plain bytes after which a frame is closed; a larger record has a frame to itself.
FRAME_BYTES = 1 << 18
#: Compressed bytes after which a task begins another bundle.
BUNDLE_BYTES = 1 << 26
LEVEL = 3
#: Payloads of fewer bytes are never made revisits.
MIN_REVISIT_BYTES = 0
#: Digests of repeated payloads that may be broadcast, about 100 bytes each; beyond it they are joined in SALTS parts.
BROADCAST_DIGESTS = 200_000
SALTS = 32
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, path string, frame int, frame_offset long, frame_bytes int, record_offset int, record_bytes int"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def header_value(value: str) -> str:
    """A value that cannot end its header line: control characters and blanks are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def page_name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {page_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url) if url else page_name(page_id)[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_name(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in plain bytes."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError("not a record")
        head = {k: v for k, _, v in (line.partition(": ") for line in lines)}
        size = int(head["Content-Length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) != size or data[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield head, block
        at = stop + 8 + size


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The closing frame for frames of (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", a, b) for a, b in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frames_of(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame of a bundle, from its seek table."""
    end = file.size()
    file.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    file.seek(end - 9 - entry * count)
    body, at, out = file.read(entry * count), 0, []
    for k in range(count):
        packed, plain = struct.unpack_from("<II", body, k * entry)
        out.append((at, packed, plain))
        at += packed
    return out


def unpacked(frame: bytes) -> bytes:
    """The plain bytes of one whole frame."""
    return zstandard.ZstdDecompressor().decompressobj().decompress(frame)


class Bundle:
    """A bundle being written; index rows become known as frames are closed."""

    def __init__(self, files: fs.FileSystem, folder: str, shown: str) -> None:
        name = f"part-{uuid.uuid4().hex}.warc.zst"
        self.path = f"{shown}/{name}"
        self.out = files.open_output_stream(f"{folder}/{name}", compression=None)  # else the suffix means a second compression
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frame: list[bytes] = []
        self.waiting: list[tuple[int | None, int, int]] = []
        self.sizes: list[tuple[int, int]] = []
        self.plain = self.written = 0
        self.index: list[tuple] = []
        info = b"software: lumenward\r\nformat: WARC File Format 1.1\r\n"
        self._append(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")

    def _append(self, data: bytes) -> None:
        self.frame.append(data)
        self.plain += len(data)

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.plain and self.plain + len(data) > FRAME_BYTES:
            self.close_frame()
        self.waiting.append((page_id, self.plain, len(data)))
        self._append(data)

    def close_frame(self) -> None:
        if not self.frame:
            return
        packed = self.zstd.compress(b"".join(self.frame))
        self.out.write(packed)
        self.index += [(p, self.path, len(self.sizes), self.written, len(packed), at, size) for p, at, size in self.waiting]
        self.sizes.append((len(packed), self.plain))
        self.written += len(packed)
        self.frame, self.waiting, self.plain = [], [], 0

    def close(self) -> list[tuple]:
        self.close_frame()
        self.out.write(seek_table(self.sizes))
        self.out.close()
        return self.index


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder or file in the shared store."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def repeated(pages: DataFrame, key: str, digest: str, size: str) -> DataFrame:
    """(digest, keeper): the largest key of each payload that more than one row has. Narrow; combined before the shuffle."""
    counts = pages.where(F.col(size) >= MIN_REVISIT_BYTES).groupBy(digest).agg(F.max(key).alias("keeper"), F.count(F.lit(1)).alias("n"))
    return common.written(counts.where("n > 1").select(digest, "keeper"), "repeated")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for each row to bundles in a new folder of the shared store; returns their index, written too.

    Only files that the index names count: a failed or repeated task leaves files that nothing refers to.
    """
    payload = common.text_of(html).cast("binary")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    known = repeated(rows, "page_id", "digest", "size")
    if known.count() <= BROADCAST_DIGESTS:
        rows = rows.join(F.broadcast(known), "digest", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    # A payload whose rows have no key at all has no keeper: all of them are responses.
    rows = rows.select("page_id", "url", "payload", "digest", (F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisit"), "keeper")
    opened(folder)[0].create_dir(opened(folder)[1], recursive=True)

    def bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, inside = opened(folder)
        bundle = None
        for batch in batches:
            for page_id, uri, data, sha, again, keeper in zip(*(batch[c] for c in ("page_id", "url", "payload", "digest", "revisit", "keeper")), strict=True):
                if bundle is None:
                    bundle = Bundle(files, inside, folder)
                page = None if pd.isna(page_id) else int(page_id)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                bundle.add(page, record(page, uri, bytes(data), digest, int(keeper) if again else None, bool(again)))
                if bundle.written >= BUNDLE_BYTES:
                    yield pd.DataFrame(bundle.close(), columns=_INDEX).astype({"page_id": "Int64"})
                    bundle = None
        if bundle is not None:
            yield pd.DataFrame(bundle.close(), columns=_INDEX).astype({"page_id": "Int64"})

    # Keys go to Python as nullable integers: as floats, large ones would lose digits.
    rows = rows.withColumn("page_id", F.col("page_id").cast("string")).withColumn("keeper", F.col("keeper").cast("string"))
    return common.written(rows.mapInPandas(bundles, INDEX), "index")


_INDEX = [part.split()[0] for part in INDEX.split(", ")]


def fetch(path: str, frame_offset: int, frame_bytes: int, record_offset: int, record_bytes: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: one seek, one frame."""
    files, inside = opened(path)
    with files.open_input_file(inside) as file:
        file.seek(frame_offset)
        plain = unpacked(file.read(frame_bytes))
    return next(records(plain[record_offset : record_offset + record_bytes]))


def read(spark: SparkSession, index: DataFrame) -> DataFrame:
    """What the bundles of an index hold, a row for each record; payloads are checked against their digests."""
    paths = index.select("path").distinct()
    n = max(1, min(paths.count(), 100_000))

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                files, inside = opened(path)
                with files.open_input_file(inside) as file:
                    rows: list[tuple] = []
                    for offset, packed, plain in frames_of(file):
                        file.seek(offset)
                        data = unpacked(file.read(packed))
                        if len(data) != plain:
                            raise ValueError("a frame has another size than its seek table says")
                        rows += [row for row in map(described, *zip(*records(data), strict=True)) if row]
                        if len(rows) > 4000:
                            yield pd.DataFrame(rows, columns=_RECORD).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows = []
                    yield pd.DataFrame(rows, columns=_RECORD).astype({"page_id": "Int64", "refers_to": "Int64"})

    return paths.repartition(n, "path").mapInPandas(parsed, RECORD)


_RECORD = [part.split()[0] for part in RECORD.split(", ")]


def described(head: dict[str, str], block: bytes) -> tuple | None:
    """A record's row; None for a bundle's own description."""
    kind = head["WARC-Type"]
    if kind == "warcinfo":
        return None
    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {head['WARC-Record-ID']} has another digest")
    refers = head.get("WARC-Refers-To")
    return page_of(head["WARC-Record-ID"]), size, digest, kind, page_of(refers) if refers else None


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as records and read back from the archives.

    Null html: an empty payload. Null url: the record's own name. Null page ids: kept as null; they revisit
    the page with the largest id of equal payload, or are all responses if there is none. Repeated rows: a
    record each, all responses if they have the largest id. Empty table: no bundles, no rows. Other columns of
    pages are not read.
    """
    common.arrow_batches(spark)
    pages = common.table(spark, sf_dir, "pages")
    return read(spark, write(pages, common.scratch(spark, "warc")))


ORACLE = """with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) x from pages),
g as (select x, max(page_id) k from p group by x)
select page_id, strlen(h)::bigint payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(rpad(x, 42, '0'), ((i * 5) // 4 + 1)::int, 3))::int >> (7 - (i * 5) % 4)::int) & 31)::int, 1)), '') payload_digest,
  case when k is not null and page_id is distinct from k then 'revisit' else 'response' end record_type,
  case when k is not null and page_id is distinct from k then k end refers_to
from p join g using (x)"""
