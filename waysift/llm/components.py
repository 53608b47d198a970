"""Connected components over tables of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table

#: Links that a task contracts at once.
CHUNK = 250_000


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n nodes linked a to b: each node's smallest reachable node."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def spanning(ids: np.ndarray, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Stars (x to its smallest reachable id y) that span what the pairs of positions of ids connect."""
    nodes, at = np.unique(ids, return_inverse=True)
    root = np.arange(len(nodes))
    for i, j in pairs:
        root = forest(len(nodes), np.r_[np.arange(len(nodes)), at[i]], np.r_[root, at[j]])
    far = root != np.arange(len(nodes))
    return pa.record_batch([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["x", "y"])


def _open(edges: DataFrame) -> bool:
    """Whether edges (x, y) are anything else than stars: an x has two ys, or a y is an x too."""
    ends = edges.select(F.col("x").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("y").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return not ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or (out = 1 and in = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links: a, b long, in any order, repeats and loops allowed, nulls left out. Gives id, component_id (the smallest id reachable) for every id in a link to another id.

    First each task makes CHUNK links at most, whole files of them, into stars. A round makes each node point at its smallest neighbour (large star, then small
    star) and is written to the shared folder; rounds end when all links are stars,
    after about the logarithm of the longest path. Minima are aggregated before the
    shuffle and the joins read written tables, so that Spark can split a hub's rows.
    """
    e = links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
    every = table(e.filter("x != y").distinct(), "links")

    def stars(batches: Iterable) -> Iterator:
        got = [(b.column("x").to_numpy(), b.column("y").to_numpy()) for b in batches if b.num_rows]
        if got:
            x, y = (np.concatenate(c) for c in zip(*got, strict=True))
            yield spanning(np.r_[x, y], [(np.arange(len(x)), len(x) + np.arange(len(x)))])

    now = table(every.coalesce(max(1, -(-every.count() // CHUNK))).mapInArrow(stars, "x long, y long"), "stars")
    drop([every], collect=False)
    while _open(now):
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = table(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "large")
        large = table(both.join(low, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct(), "star")
        least = table(large.groupBy("x").agg(F.min("y").alias("m")), "small")
        small = large.join(least, "x").filter("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        new = table(small.unionByName(least.select("x", F.col("m").alias("y"))).distinct(), "links")
        drop([now, low, large, least], collect=False)
        now = new
    return now.select(F.col("x").alias("id"), F.col("y").alias("component_id")).unionByName(now.select(F.col("y").alias("id"), F.col("y").alias("component_id")).distinct())
