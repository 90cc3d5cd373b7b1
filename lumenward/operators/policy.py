"""The policy ladder for collections of files, by corroboration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenward.functions.normalize import let

# The rungs with the recommendation and the older decision that each stands for.
LADDER = {
    "clean": ("no agent-risk findings", "allow"),
    "clean_notes": ("no blocking agent-input found — notes below for your review", "allow"),
    "review_before_agent_ingestion": ("review the flagged spans before letting an agent consume them", "quarantine"),
    "known_attack": ("contains a known attack signature — do not feed to an agent", "block"),
}
BOUNDARY = "Agent-context decision, not repo reputation."
CORROBORATING = ("high", "critical")
SHOWN_FINDINGS = 25


def note_only(tier: Column, severity: Column) -> Column:
    """Whether a finding can never corroborate: a hint, or not severe enough. A missing severity is not."""
    return (tier == "B") | ~F.coalesce(severity.isin(*CORROBORATING), F.lit(False))


def corroborated(findings: Column) -> Column:
    """Of one file's findings, the categories that two distinct rules on two distinct spans confirm, first seen first.

    Signatures do not count. A file's findings stand in one row, so this needs no shuffle.
    """
    able = F.filter(findings, lambda f: ~note_only(f["tier"], f["severity"]) & (f["tier"] != "S"))

    def of(able: Column) -> Column:
        own = lambda c: F.filter(able, lambda f: f["category"] == c)
        ids = lambda c: F.size(F.array_distinct(F.transform(own(c), lambda f: f["id"])))
        spans = lambda c: F.size(F.array_distinct(F.transform(own(c), lambda f: F.coalesce(f["matched_text"], F.lit("")))))
        categories = F.array_distinct(F.transform(able, lambda f: f["category"]))
        return F.transform(F.filter(categories, lambda c: (ids(c) >= 2) & (spans(c) >= 2)), lambda c: F.struct(c.alias("category"), ids(c).alias("ids"), spans(c).alias("spans")))

    return let(able, of)


def rung(hits: Column, to_review: Column, notes: Column) -> Column:
    """The rung of a collection from its numbers of signature hits, files to review and notes."""
    return F.when(hits > 0, "known_attack").when(to_review > 0, "review_before_agent_ingestion").when(notes > 0, "clean_notes").otherwise("clean")


def _of_tier(signature: bool) -> Column:
    return F.filter("findings", lambda f: (f["tier"] == "S") if signature else (f["tier"] != "S"))


def tiered(files: DataFrame, signatures: Sequence[str] | None) -> DataFrame:
    """files whose findings have tier S exactly if their rule is one of the signatures; None leaves tiers as they are.

    A rule of tier S that is none of them counts as confirmed by a pattern.
    """
    if signatures is None:
        return files
    tier = lambda f: F.when(f["id"].isin(*signatures) if signatures else F.lit(False), "S").when(f["tier"] == "S", "A").otherwise(f["tier"])
    return files.withColumn("findings", F.transform("findings", lambda f: f.withField("tier", tier(f))))


def ladder(files: DataFrame, collection: str, signatures: Sequence[str] | None = None) -> DataFrame:
    """One row per collection: overall, notes, hits, to_review and files_scanned, all numbers.

    signatures: the rules of tier S, if not those of the catalog (see tiered).

    Each file is three numbers before the shuffle and they are added up on both sides of it, so a collection may
    have any number of files and findings.
    """
    rows = tiered(files, signatures).select(collection, F.size(_of_tier(False)).alias("n"), F.size(_of_tier(True)).alias("s"), (F.size(corroborated(F.col("findings"))) > 0).cast("int").alias("r"))
    total = lambda c: F.sum(c).cast("long")
    sums = rows.groupBy(collection).agg(total("n").alias("notes"), total("s").alias("hits"), total("r").alias("to_review"), F.count(F.lit(1)).alias("files_scanned"))
    return sums.withColumn("overall", rung(F.col("hits"), F.col("to_review"), F.col("notes")))


def rollup(files: DataFrame, collection: str, name: str, order: str, signatures: Sequence[str] | None = None) -> DataFrame:
    """One row per collection with everything in it: notes, files to review and signature hits as arrays.

    Notes and hits come in file order, then finding order. For collections whose findings fit in one row, such as
    a repository's files; ladder() has none of that limit.
    """
    entry = lambda f: F.struct(F.col(name).alias("file"), f["id"].alias("id"), f["severity"].alias("severity"), F.coalesce(f["category"], F.lit("")).alias("category"), F.coalesce(f["matched_text"], F.lit("")).alias("matched_text"))
    rows = tiered(files, signatures).select(
        F.col(collection), F.col(order).alias("place"), F.col(name).alias("file"), F.transform(_of_tier(False), entry).alias("notes"), F.transform(_of_tier(True), entry).alias("hits"),
        F.transform(corroborated(F.col("findings")), lambda c: c["category"]).alias("categories"),
    )
    listed = lambda c: F.array_sort(F.collect_list(F.when(F.size(c) > 0, F.struct("place", c))))
    out = rows.groupBy(collection).agg(
        listed("notes").alias("notes"), listed("hits").alias("hits"), F.array_sort(F.collect_list(F.when(F.size("categories") > 0, F.struct("place", "file", "categories")))).alias("review"), F.count(F.lit(1)).alias("files_scanned")
    )
    flat = lambda c: F.flatten(F.transform(c, lambda x: x[c]))
    out = out.withColumns({"notes": flat("notes"), "signature_hits": flat("hits"), "review": F.transform("review", lambda x: F.struct(x["file"].alias("file"), x["categories"].alias("categories")))})
    overall = rung(F.size("signature_hits"), F.size("review"), F.size("notes"))
    return out.select(collection, overall.alias("overall"), F.lit(BOUNDARY).alias("boundary"), "notes", "review", "signature_hits", "files_scanned")


def presented(overall: Column, files: Column, notes: Column, to_review: Column) -> Column:
    """struct<recommendation, overall_decision, summary> of a collection."""
    pick = lambda k: F.element_at(F.create_map(*[F.lit(x) for name, values in LADDER.items() for x in (name, values[k])]), overall)
    review = F.when(to_review > 0, F.format_string(" · %d file(s) to review", to_review)).otherwise("")
    summary = F.concat(F.format_string("%d file(s) scanned · %d note(s)", files, notes), review, F.lit(" · recommendation: "), pick(0))
    return F.struct(pick(0).alias("recommendation"), pick(1).alias("overall_decision"), summary.alias("summary"))


def shown(findings: Column) -> Column:
    """The findings that a report lists."""
    return F.slice(findings, 1, SHOWN_FINDINGS)
