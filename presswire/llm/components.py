"""Connected components, and what the pairwise operators share."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b); a component is named by its
    smallest node. Each round takes the smallest label next to a node and then that label's own
    label, so that distances halve; rounds end when nothing changes. Labels stay in tables."""
    both = edges.where("a <> b").select("a", "b")
    both = written(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = written(lower.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), (F.least("low", F.coalesce("far", "low")) != F.col("label")).alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


#: Keys that :func:`of_class` broadcasts at most.
HOT = 10_000


def of_class(rows: DataFrame, per_key: DataFrame, total: int) -> DataFrame:
    """``rows`` with the columns of ``per_key`` (key, n: the number of rows of the key), null where
    that lacks the key; rows without a key are left out. Keys of more than ``total / HOT`` rows, of
    which there are HOT at most, are broadcast, so that their rows stay where they are; the others
    meet by key."""
    often = F.col("n") > math.ceil(total / HOT)
    hot, rest = F.broadcast(per_key.where(often)), per_key.where(~often)
    rows = rows.where("key is not null")
    return rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(rest, "key", "left"))


def seen_before(lists: list, this: int, p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """Which pairs of members ``p`` and ``q`` also meet in a bucket of a smaller number than ``this``.
    Each member has the numbers of all its buckets. A pair counts in its first bucket only."""
    sizes = [len(x) for x in lists]
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists])
    member = np.repeat(np.arange(len(lists)), sizes)
    earlier = flat < this
    numbers, where, counts = np.unique(flat[earlier], return_inverse=True, return_counts=True)
    many = counts >= 2
    if not many.any():
        return None
    column = np.cumsum(many) - 1
    at = many[where]
    m = np.zeros((len(lists), int(many.sum())), np.float32)
    m[member[earlier][at], column[where[at]]] = 1
    return m[p] @ m[q].T > 0


def stars(linked: np.ndarray) -> np.ndarray:
    """For each member the smallest member of its component in a symmetric matrix of links."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = [np.where(linked[i : i + 256], label[None, :], n).min(axis=1, initial=n) for i in range(0, n, 256)]
        new = np.minimum(label, np.concatenate([np.zeros(0, np.int64), *low]))
        new = new[new]
        if (new == label).all():
            return label
        label = new
