"""Document fingerprints: the canonical exact digest, in built-in expressions only.

A text is brought to one form (NFKC, full case folding, NFKC again, white-space runs to one space, ends trimmed)
and hashed with two xxhash64 lanes: 128 bits. Texts in equal buckets are compared byte by byte; a bucket that
holds different canonical texts gives each of them a fingerprint with its SHA-256 appended. Two fingerprints are
equal exactly if the canonical texts are; where edited texts get fingerprints too, they share the buckets.

Spark has no function for Unicode normalisation or case folding; its SQL function `reflect` calls those of the
ICU library that Spark itself ships. Texts of ASCII letters only take Spark's own `lower`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenward.llm import common

#: Hashes of repeated texts that may be broadcast (48 bytes each, about).
BROADCAST_HASHES = 200_000
#: Documents of one range of ids, which one task orders, about.
ROWS_PER_RANGE = 20_000
#: Rows sampled for each range, and for all of them at most: the sample decides the ranges' balance alone.
SAMPLE_PER_RANGE, SAMPLE_ROWS = 20, 500_000
#: Characters of a text by which rows of an equal id, or without one, are cut into ranges.
TIE_CHARS = 32
_WHITE = r"[\\s\\p{Z}\\x1c-\\x1f\\x85]+"


def canonical(text: str) -> Column:
    """The canonical form of the non-null string column of this name."""
    nfkc = "reflect('com.ibm.icu.text.Normalizer', 'compose', {}, true)"
    folded = f"reflect('com.ibm.icu.lang.UCharacter', 'foldCase', {nfkc.format(f'`{text}`')}, true)"
    return F.expr(f"trim(regexp_replace(case when octet_length(`{text}`) = char_length(`{text}`) then lower(`{text}`) else {nfkc.format(folded)} end, '{_WHITE}', ' '))")


def wide_hash(canon: str) -> Column:
    """128 bits of a string column as 32 lower-case hex digits."""
    lane = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.lower(F.concat(lane(F.xxhash64(canon)), lane(F.xxhash64(F.lit("second lane"), canon))))


def with_hash(df: DataFrame, text: str, canon: str, name: str) -> DataFrame:
    """df with the canonical form and wide hash of a string column (null: empty)."""
    return df.withColumn(text, common.text_of(text)).withColumn(canon, canonical(text)).withColumn(name, wide_hash(canon))


def repeated(hashes: DataFrame) -> DataFrame:
    """(hash): those that occur twice or more in hashes(hash), written, to be broadcast if they are few.

    Equal ones meet in the map-side aggregation, so a text that a third of all rows share is one row per task in
    the shuffle.
    """
    out = common.written(hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated")
    return F.broadcast(out) if out.count() <= BROADCAST_HASHES else out


def different(buckets: DataFrame) -> DataFrame:
    """(hash): those of buckets(hash, canon) that hold more than one canonical text. Written, expected to be empty."""
    distinct = buckets.groupBy("hash", "canon").agg(F.lit(1).alias("one"))
    return common.written(distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "collided")


def collided(df: DataFrame, text: str = "text") -> DataFrame:
    """(hash): wide hashes that stand for more than one canonical text. Only buckets of two rows or more are compared."""
    hashed = with_hash(df.select(F.col(text).alias("__t")), "__t", "canon", "hash")
    return different(hashed.join(repeated(hashed.select("hash")), "hash", "left_semi").select("hash", "canon"))


def fingerprint_of(canon: str, hashed: str, is_collided: Column) -> Column:
    """The fingerprint from canonical form and wide hash."""
    return F.when(is_collided, F.concat(F.col(hashed), F.lit("-"), F.sha2(F.col(canon), 256))).otherwise(F.col(hashed))


def fingerprinted(df: DataFrame, text: str, name: str, bad: DataFrame | None) -> DataFrame:
    """df with the fingerprint of a text column under a new name; bad: collided hashes, None if there are none."""
    with_both = with_hash(df, text, "__canon", "__hash")
    if bad is None:
        return with_both.withColumn(name, F.col("__hash")).drop("__canon", "__hash")
    marked = with_both.join(bad.select(F.col("hash").alias("__hash"), F.lit(True).alias("__bad")), "__hash", "left")
    return marked.withColumn(name, fingerprint_of("__canon", "__hash", F.coalesce("__bad", F.lit(False)))).drop("__canon", "__hash", "__bad")


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, group_id, n) of every row: group_id is the group's smallest non-null key, n its rows."""
    bad = collided(df, text)
    rows = fingerprinted(df.select(F.col(key), F.col(text).alias("__text")), "__text", "fingerprint", None if bad.isEmpty() else bad)
    rows = common.written(rows.select(key, "fingerprint"), "fingerprints")
    groups = rows.groupBy("fingerprint").agg(F.min(key).alias("group_id"), F.count(F.lit(1)).alias("n"))
    return rows.join(groups, "fingerprint").select(key, "fingerprint", "group_id", "n")


def _bounds(df: DataFrame, key: str, tie: str) -> list[tuple]:
    """Ascending (key, beginning of the tie column) that cut df into ranges of about ROWS_PER_RANGE, from a sample."""
    spark = df.sparkSession
    rows = df.count()
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_RANGE))
    share = min(1.0, min(SAMPLE_ROWS, SAMPLE_PER_RANGE * ranges) / max(1, rows))
    some = df.select(F.col(key).alias("k"), F.substring(tie, 1, TIE_CHARS).alias("t"))
    some = (some if share == 1 else some.sample(share, seed=7)).groupBy("k", "t").agg(F.count(F.lit(1)).alias("n")).collect()
    some.sort(key=lambda r: (r.k is not None, r.k or 0, r.t.encode("utf-8", "surrogatepass")))
    step, run, out = sum(r.n for r in some) / ranges, 0.0, []
    for r in some:
        run += r.n
        if run >= step:
            out.append((r.k, r.t))
            run = 0.0
    return out


def _with_range(df: DataFrame, key: str, tie: str, bounds: list[tuple]) -> DataFrame:
    """df with __range: how many bounds are below a row. The bounds travel as one broadcast row, searched in two steps."""
    spark = df.sparkSession
    width = max(1, int(len(bounds) ** 0.5))
    nested = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    one = f"struct<k:{dict(df.dtypes)[key]},t:string>"
    table = spark.createDataFrame([(1, [x[-1] for x in nested], [*nested, []])], f"__one int, __heads array<{one}>, __inner array<array<{one}>>")
    own = F.struct(F.col(key).alias("k"), F.substring(tie, 1, TIE_CHARS).alias("t"))
    rows = df.withColumn("__one", F.lit(1)).withColumn("__own", own).join(F.broadcast(table), "__one")
    full = F.size(F.filter("__heads", lambda b: b < F.col("__own")))
    rest = F.size(F.filter(F.element_at("__inner", full + 1), lambda b: b < F.col("__own")))
    return rows.withColumn("__range", F.when(full >= len(nested), len(bounds)).otherwise(full * width + rest)).drop("__one", "__heads", "__inner")


def with_next(df: DataFrame, key: str, text: str, added: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every row of df(key, text) with added()'s columns, and all but the key of the next row by descending key as next_<name>; after the last comes the first.

    Rows of an equal key follow in descending order of the text, null keys come last. Keys (and texts, where many
    rows have one key) are cut into ranges; each range also gets a copy of the first row of the range below, so
    that no row has to look beyond its range. One shuffle; no task holds more than one range at a time. Equal rows
    stay in one range.
    """
    spark = df.sparkSession
    placed = _with_range(df.select(key, text), key, text, _bounds(df, key, text))
    tops = placed.groupBy("__range").agg(F.max("__own").alias("top")).collect()  # one id and beginning of each range
    order = sorted(tops, key=lambda r: -r["__range"])
    to = [(tuple(r["top"]), order[i - 1]["__range"]) for i, r in enumerate(order)]
    copies = spark.createDataFrame(to, f"__top struct<k:{dict(df.dtypes)[key]},t:string>, __to int")
    first = placed.join(F.broadcast(copies), F.col("__own").eqNullSafe(F.col("__top")))
    first = first.groupBy(F.col("__to").alias("__range"), key).agg(F.max(text).alias(text))
    rows = added(placed.select(key, text, "__range")).withColumn("__copy", F.lit(False))
    every = rows.unionByName(added(first).withColumn("__copy", F.lit(True)))
    carried = [c for c in rows.columns if c not in (key, "__range", "__copy")]
    window = Window.partitionBy("__range").orderBy("__copy", F.col(key).desc_nulls_last(), F.col(text).desc())
    led = every.select(key, *carried, "__copy", *[F.lead(c).over(window).alias(f"next_{c}") for c in carried])
    return led.where("not __copy").drop("__copy")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    A likeness is 1 if the fingerprints are equal, else 0: the digest is exact, over documents and edited texts
    together. Null texts count as empty; the fingerprint of an empty text is that of all white space. Repeated
    ids: ordered by text, descending; null ids last. A single document is its own next. Very long texts are hashed
    whole. Empty table: no rows. Other columns of documents are not read.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.text_of("text").alias("text"))

    def hashed(df: DataFrame, text: str, name: str) -> DataFrame:
        """df with the wide hash of a text, and the SHA-256 of its canonical form."""
        return with_hash(df, text, "__canon", name).withColumn(f"{name}_sha", F.sha2("__canon", 256)).drop("__canon")

    paired = with_next(docs, "doc_id", "text", lambda df: hashed(df, "text", "hash"))
    n, half = F.length("text"), "cast(floor(length(text) / 2) as int)"
    edited = F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(next_text, 1, {half}))")
    rows = paired.select("doc_id", n.cast("long").alias("n_chars"), "hash", "hash_sha", "next_hash", "next_hash_sha", edited.alias("edited"))
    rows = hashed(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_hash")
    rows = common.written(rows, "edited")
    twice = repeated(rows.select("hash").union(rows.select("edited_hash")))
    own = with_hash(docs, "text", "canon", "hash").join(twice, "hash", "left_semi").select("hash", "canon")
    other = rows.select("edited", F.col("edited_hash").alias("hash")).join(twice, "hash", "left_semi").withColumn("canon", canonical("edited"))
    bad = different(own.union(other.select("hash", "canon")))
    if bad.isEmpty():
        final = lambda name: F.col(name)
    else:
        known = bad.agg(F.collect_list("hash")).first()[0]
        final = lambda name: F.when(F.col(name).isin(known), F.concat(name, F.lit("-"), f"{name}_sha")).otherwise(F.col(name))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", final("hash").alias("fingerprint"), final("edited_hash").alias("edited_fingerprint"), final("next_hash").alias("next_fingerprint"))
    like = lambda name: (F.col("fingerprint") == F.col(name)).cast("double")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
