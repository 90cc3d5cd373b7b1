"""Where texts come from, what is refused, and how results leave."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenward.operators.scan import channel_or_default

MAX_BYTES = 100_000
MAX_FILES = 15


def spread(df: DataFrame) -> DataFrame:
    """df, read from files, over at least as many partitions as there are cores: a scan costs far more than moving a text.

    The number of files' bytes says how many there will be, without planning the query; a table that fills the
    cores by itself is not moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * split else df


def reject_reason(text: Column) -> Column:
    """Why a text is not scanned: `empty` (or missing), `too large`, or null."""
    return F.when(text.isNull() | (text == ""), "empty").when(F.octet_length(text) > MAX_BYTES, "too large")


def guarded(df: DataFrame, text: str = "text") -> DataFrame:
    """df with reject_reason; texts that have one are for the caller to set aside."""
    return df.withColumn("reject_reason", reject_reason(F.col(text)))


def requests(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON request bodies as text, channel and reject_reason.

    A body that is no JSON, or has more behind its value, is refused as `not JSON`; a value that is no object, or
    whose text is missing or no string, as `empty`. A channel that is no string is as good as none. An object that
    names a key twice is no JSON here.
    """
    # The parser stops behind the first value; with a mark after the body, nothing can stand between the two.
    mark = uuid.uuid4().hex
    df = df.withColumn("__r", F.try_parse_json(F.concat(F.lit("["), F.col(body), F.lit(f',"{mark}"]'))))
    valid = (F.try_variant_get("__r", "$[1]", "string") == mark) & F.try_variant_get("__r", "$[2]", "variant").isNull()
    kind = lambda path: F.schema_of_variant(F.try_variant_get("__r", path, "variant"))
    string = lambda path: F.when(F.coalesce(kind(path) == "STRING", F.lit(False)), F.try_variant_get("__r", path, "string"))
    out = df.withColumn("text", string("$[0].text")).withColumn("channel", channel_or_default(string("$[0].channel")))
    return out.withColumn("reject_reason", F.when(~F.coalesce(valid, F.lit(False)), "not JSON").otherwise(reject_reason(F.col("text")))).drop("__r")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Text files below a folder, one row each: path, bytes and text; files over MAX_BYTES are not read but marked."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    small = F.col("length") <= MAX_BYTES
    text = F.make_valid_utf8(F.when(small, F.col("content")).cast("string"))
    return found.select("path", F.col("length").alias("bytes"), text.alias("text"), F.when(~small, "too large").alias("skipped"))


def limited(targets: DataFrame, collection: str, order: str) -> DataFrame:
    """The first MAX_FILES targets of each collection, by order and then path; the limit is the feature."""
    w = Window.partitionBy(collection).orderBy(order)
    return targets.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= MAX_FILES).drop("__n")


def as_json(df: DataFrame, out: str = "response") -> DataFrame:
    """Every row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))
