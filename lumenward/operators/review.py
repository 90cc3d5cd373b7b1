"""A collection of files from its list to its verdict: limit, size guard, scan, tiers, ladder, presentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.operators import policy
from lumenward.operators.scan import scan
from lumenward.rules import Rule
from lumenward.sources import texts

NOTHING_FOUND = "nothing to scan"


def review(files: DataFrame, rules: Sequence[Rule], collection: str, name: str, order: str, text: str = "text", own: tuple[str, ...] = (), signatures: Sequence[str] | None = None) -> DataFrame:
    """One row per collection of files(collection, name, order, text): the rollup, its presentation, and what was skipped.

    Of each collection the first MAX_FILES files count. A null text is a file that does not exist; one beyond the
    size limit is skipped and listed. A collection with neither scanned nor skipped files has an error and no
    verdict. own: collections that get a note for being the operator's; it changes nothing else. signatures: see
    policy.tiered.
    """
    chosen = texts.limited(files.select(collection, name, order, F.col(text).alias("text")), collection, order)
    chosen = chosen.withColumn("skipped", F.when(F.octet_length("text") > texts.MAX_BYTES, "too large"))
    fine = F.col("text").isNotNull() & F.col("skipped").isNull()
    done = scan(chosen.where(fine).withColumn("channel", F.lit("file")), rules)
    rolled = policy.rollup(done, collection, name, order, signatures)
    told = policy.presented(F.col("overall"), F.col("files_scanned"), F.size("notes"), F.size("review"))
    rolled = rolled.withColumn("p", told).select(*rolled.columns, "p.*")
    left = F.array_sort(F.collect_list(F.when(F.col("skipped").isNotNull(), F.struct(F.col(order).alias("place"), F.col(name).alias("file"), "skipped"))))
    all_ = chosen.groupBy(collection).agg(F.count(F.lit(1)).alias("surfaces_checked"), left.alias("skipped"))
    out = all_.join(rolled, collection, "left")
    empty = F.col("overall").isNull() & (F.size("skipped") == 0)
    # Files that could not be read leave a clean verdict over none.
    out = out.withColumns({"error": F.when(empty, NOTHING_FOUND), "overall": F.when(~empty, F.coalesce("overall", F.lit("clean"))), "files_scanned": F.coalesce("files_scanned", F.lit(0))})
    return out.withColumn("self_scan", F.lower(F.col(collection).cast("string")).isin(*[o.lower() for o in own]) if own else F.lit(False))
