"""The scan and the rate limit over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.operators.scan import scan
from lumenward.rules import Rule
from lumenward.sources import texts

#: What a response says beside any decision but allow.
MEANING = "The text contains signals that known attacks on automated readers use. This is a fact about the text and no judgement of its authors: documentation of attacks contains them too."
LIMIT, PERIOD = 30, "60 seconds"


def scan_requests(bodies: DataFrame, rules: Sequence[Rule], body: str = "body") -> DataFrame:
    """JSON requests, batch or stream, with findings, decision and its meaning; refused ones have none of them.

    The scan is row-local, so a stream needs no state and no watermark.
    """
    checked = texts.requests(bodies, body)
    scanned = scan(checked.withColumn("__text_in", F.when(F.col("reject_reason").isNull(), F.col("text"))), rules, "__text_in")
    fine = F.col("reject_reason").isNull()
    return scanned.drop("__text_in").withColumn("findings", F.when(fine, F.col("findings"))).withColumn("decision", F.when(fine, F.col("decision"))).withColumn("verdict_meaning", F.when(F.col("decision") != "allow", MEANING))


def rate_windows(events: DataFrame, key: str, time: str, limit: int = LIMIT, period: str = PERIOD, watermark: str | None = None) -> DataFrame:
    """(key, window_start, requests, allowed, limited) per key and window.

    Counts are combined before the shuffle, so one busy key is one row per task. watermark bounds the state of a
    stream; a batch needs none.
    """
    timed = events.withWatermark(time, watermark) if watermark else events
    counts = timed.groupBy(F.window(F.col(time), period).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("requests"))
    return counts.select(
        key, F.col("w.start").alias("window_start"), "requests", F.least(F.col("requests"), F.lit(limit)).alias("allowed"), F.greatest(F.col("requests") - limit, F.lit(0)).alias("limited")
    )
