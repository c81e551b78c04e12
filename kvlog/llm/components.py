"""Connected components of a table of links, by contraction in DataFrame rounds.

In each round every node joins the least of itself and its neighbours, and links are rewritten to
those. Rounds take the least by value and by a hash in turn: stars around their least node vanish in
one round, and chains shrink by a constant factor in expectation, so rounds grow with the logarithm of
the nodes. Each round's table is written to the shared folder. The last FEW links, at any size of the
table, are settled on the driver: the rounds left for them would each cost it as many stages, tasks and
threads as the first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

FEW = 10_000


def merge_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is connected with over the links a-b."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        low, new = np.minimum(la, lb), label.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b: bigint). A root's own row is there too."""
    edges = materialise(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found, turn = None, 0
    while len(few := edges.limit(FEW + 1).collect()) > FEW:
        rank = (lambda c: F.xxhash64(c, F.lit(turn))) if turn % 2 else (lambda c: F.col(c))  # noqa: B023
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(edges.select("b", "a"))
        least = both.groupBy("node").agg(F.min(F.struct(rank("near").alias("rank"), "near")).alias("m"))
        own = F.struct(rank("node").alias("rank"), F.col("node").alias("near"))
        step = materialise(least.select("node", F.least(own, "m").getField("near").alias("root")), "step")
        left, right = step.toDF("a", "ra"), step.toDF("b", "rb")
        edges = edges.join(left, "a").join(right, "b").filter("ra <> rb")
        edges = materialise(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        found = step if found is None else _followed(found, step)
        turn += 1
    if few:
        nodes, ends = np.unique(np.array(few, np.int64), return_inverse=True)
        label = merge_labels(len(nodes), *ends.reshape(-1, 2).T)
        step = links.sparkSession.createDataFrame(pa.table({"node": nodes, "root": nodes[label]}))
        found = step if found is None else _followed(found, step)
    return found if found is not None else edges.toDF("node", "root")


def _followed(found: DataFrame, step: DataFrame) -> DataFrame:
    """The roots of the roots found so far."""
    return found.join(step.toDF("from", "to"), F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
