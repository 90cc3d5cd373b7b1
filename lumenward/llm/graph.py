"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.llm import common

#: Edges between numbers (16 bytes each) that one task may connect; more take rounds over all tasks.
SMALL_EDGES = 500_000

#: Rounds before giving up. Local minima are at most half of a path, and a star is done in two rounds.
MAX_ROUNDS = 64


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) that connect what the pairs (a, b) connect."""
    members, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(members))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(members))
    return members[own], members[label[own]]


def _at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all edges of one task."""
    parts = [(b["a"].to_numpy(np.int64), b["b"].to_numpy(np.int64)) for b in batches]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        member, root = spanning(a, b)
        alone = np.unique(root)
        yield pd.DataFrame({"node": np.concatenate((member, alone)), "root": np.concatenate((root, alone))})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); equal root: connected.

    Each round sends every node to its smallest neighbour (or itself), rewrites the edges to those targets and
    keeps the distinct ones that join two targets. Every table is written to the shared folder, so lost
    executors cost no earlier round; few enough edges are connected by one task instead. A round's tables are deleted when the next one's are written. Nodes may be of any orderable type; null ends and loops are ignored.
    """
    spark = edges.sparkSession
    ends = edges.where("a is not null and b is not null and a <> b")
    path = common.scratch(spark, "edges")
    ends = common.written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", path)
    if dict(ends.dtypes)["a"] == "bigint" and ends.count() <= SMALL_EDGES:
        roots = common.written(ends.coalesce(1).mapInPandas(_at_once, "node long, root long"), "roots")
        common.remove(spark, path)
        return roots
    roots, done = None, [path]
    for _ in range(MAX_ROUNDS):
        own = {name: common.scratch(spark, name) for name in ("step", "roots", "edges")}
        both = ends.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(ends.select(F.col("b").alias("node"), F.col("a").alias("other")))
        step = common.written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("to")), "step", own["step"])
        if roots is None:
            roots = step.withColumnRenamed("to", "root")
        else:
            moved = step.select(F.col("node").alias("root"), "to")
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = common.written(roots, "roots", own["roots"])
        at_a = step.select(F.col("node").alias("a"), F.col("to").alias("__a"))
        at_b = step.select(F.col("node").alias("b"), F.col("to").alias("__b"))
        ends = ends.join(at_a, "a").join(at_b, "b").where("__a <> __b")
        ends = common.written(ends.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).distinct(), "edges", own["edges"])
        common.remove(spark, *done)
        done = list(own.values())
        if ends.isEmpty():
            common.remove(spark, own["step"], own["edges"])
            return roots
    raise RuntimeError("contraction did not end")
