"""Connected components of graphs that come in many independent parts: small parts within tasks, large ones as joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged

#: A key that has one row in HOT or more is hot. As the keys' counts add up to all rows, there are at most HOT of them,
#: which bounds what is broadcast.
HOT = 1000
#: A part of at most so many links is small: it is done within a task, together with others up to as many links.
SMALL = 100_000


def joined(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """left inner join right on keys, of which right has a row each and in ``n`` how many rows of left (``total`` in all) have it.

    Rows of hot keys stay where they are and meet a broadcast; the others have few rows each and meet in a shuffle.
    """
    hot = F.col("n") * HOT >= F.lit(total)
    many, few = F.broadcast(right.filter(hot).drop("n")), right.filter(~hot).drop("n")
    return left.join(many, keys).unionByName(left.join(F.broadcast(right.filter(hot).select(keys)), keys, "left_anti").join(few, keys))


def _hung(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """part, node, root of the nodes of links, the parts whole: each node takes the least of its neighbours' roots and then its root's root until nothing changes."""
    pairs = np.concatenate([np.stack([part, a], 1), np.stack([part, b], 1)])
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    new = np.concatenate([[True], (np.diff(pairs[order], axis=0) != 0).any(1)])
    at = np.empty(len(pairs), np.int64)
    at[order] = np.cumsum(new) - 1
    nodes, u, v = pairs[order[new]], at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[u], root[v])
        if (root[u] == root[v]).all():
            return nodes[:, 0], nodes[:, 1], nodes[root, 1]
        np.minimum.at(root, root[u], least)
        np.minimum.at(root, root[v], least)
        while (root[root] != root).any():
            root = root[root]


def _within_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of sorted links, their parts whole, as many parts at a time as have SMALL links."""
    held = np.zeros((3, 0), np.int64)

    def found(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _hung(*rows)], ["part", "node", "root"])

    for batch in batches:
        held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        if held.shape[1] >= SMALL:
            last = int(np.searchsorted(held[0], held[0, -1]))
            if last:
                yield found(held[:, :last])
                held = held[:, last:]
    if held.shape[1]:
        yield found(held)


def components(links: DataFrame, part: str = "mesh") -> DataFrame:
    """part, node, root of every node of the links (part, a, b; whole numbers): root is the smallest node that it hangs together with.

    Links of different parts have nothing to do with each other; one that lacks an end or its part is none, and one from a node
    to itself is a node. Parts of at most SMALL links are each one task's work, in a bounded number of links at a
    time; of the others each link is a row of joins.
    """
    whole = links.filter(F.col(part).isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.col(part).cast("long").alias("part"), F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    whole = staged(whole.distinct(), "component-links")
    large = staged(whole.groupBy("part").count().filter(F.col("count") > SMALL).select("part"), "component-large")
    few = whole.join(large, "part", "left_anti").repartition("part").sortWithinPartitions("part")
    out = few.mapInArrow(_within_tasks, "part long, node long, root long")
    if large.take(1):
        out = out.unionByName(_by_joins(whole.join(large, "part", "left_semi"), "part"))
    return out.withColumnRenamed("part", part)


def _by_joins(whole: DataFrame, part: str) -> DataFrame:
    """Components of distinct links (a not below b). Each round hangs a node's neighbours on its smallest one, first those above it and then
    those below, until nothing changes: all are stars then. Rounds grow with the square of the logarithm of a
    component's size at most; a node with very many links is never one task's work.
    """
    whole = staged(whole.select(part, F.col("a").alias("u"), F.col("b").alias("v")), "component-links")
    edges = staged(whole.filter("u > v"), "component-edges")
    low = lambda t: t.groupBy(part, "u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m"))
    total = edges.count()
    while total:
        both = staged(edges.unionByName(edges.select(part, F.col("v").alias("u"), F.col("u").alias("v"))), "component-both")
        least = staged(low(both).withColumn("m", F.least("u", "m")), "component-least")
        up = joined(both.filter("v > u"), least, [part, "u"], 2 * total).select(part, F.col("v").alias("u"), F.col("m").alias("v"))
        up = staged(up.distinct(), "component-up")
        least = staged(low(up), "component-least")
        down = joined(up, least, [part, "u"], 2 * total).filter("v <> m").select(part, F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(down.unionByName(least.select(part, "u", F.col("m").alias("v"))).distinct(), "component-edges")
        n = after.count()
        if n == total and not after.join(edges, [part, "u", "v"], "left_anti").take(1):
            break
        edges, total = after, n
    hung = edges.select(part, F.col("u").alias("node"), F.col("v").alias("root"))
    alone = whole.select(part, F.explode(F.array("u", "v")).alias("node")).distinct().join(hung.select(part, "node"), [part, "node"], "left_anti")
    return hung.unionByName(alone.select(part, "node", F.col("node").alias("root")))
