"""The corpus pipeline: stages that each call one operator of lumenward.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenward.llm import common, decontaminate, mixing, sharding, simhash, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    Null, empty and white-space texts stay. Repeated rows: all stay or all go. Null ids: scored, never learnt from.
    Very long texts are scored whole. No labels: all stay. Empty table: no rows. Other columns stay, whatever their
    names.
    """
    common.arrow_batches(spark)
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, or any one row of several with it.

    Null, empty and white-space texts are one group. Null ids count as largest. Very long texts are compared whole.
    Empty table: no rows. Other columns stay, whatever their names.
    """
    return simhash.without_near_duplicates(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Null and empty texts stay. Repeated rows: all stay or all go. Null ids are nothing special. Very long texts are
    searched whole. Empty benchmark: all stay; empty table: no rows. Other columns stay, whatever their names.
    """
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the proportions of the target weights; a document can come more than once.

    Null, empty and white-space texts have no tokens and come with whole epochs only. Null source or language: a
    leaf of its own. Null ids: one place in an epoch's order. Repeated rows: a row each, taken like others of
    their place. Very long texts: the last one of a leaf's prefix is cut. Empty table: no rows. Other columns stay.
    """
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, with the shard among 24, and among 25; columns of these names are replaced.

    Null ids: one fixed shard. Repeated rows: a row each, the same shard. Texts are not looked at. Empty table: no
    rows.
    """
    return sharding.assign(docs)


#: (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The first three stages are a trained classifier, a graph search and word-by-word alignments: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again.

    What a stage wrote besides, and the rows of the stage before, are deleted when its own rows are written.
    """
    common.arrow_batches(spark)
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with common.temporary(spark) as kept:
            kept.append(common.scratch(spark, f"stage-{name}"))
            docs = common.written(stage(spark, docs, sf_dir), name, kept[0])
        if before is not None:
            common.remove(spark, before)
        before = kept[0]
    return docs
