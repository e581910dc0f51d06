"""Connected components by alternating stars, with every round written and read again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import discard, settle

#: Edges up to which one task joins all components; 16 bytes each.
LOCAL_EDGES = 500_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of an edge, the smallest node that links reach.

    ``edges`` holds pairs of longs in any order; loops and repeats do no harm.  Large-star joins a
    node's larger neighbours to its smallest neighbour, small-star its smaller ones; the two
    alternate until nothing changes, in about log(n) rounds.  Minima are pre-aggregated and joined
    back, so the neighbours of a hub are never gathered in a task.  Up to LOCAL_EDGES edges, as
    counted first, are joined by one task instead, since each round costs a few shuffles.
    """
    now = settle(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    if now.count() <= LOCAL_EDGES:
        return settle(now.coalesce(1).mapInArrow(_join_all, "node long, component long"), "cc_local")
    seen = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = settle(large, "cc_large")
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settle(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc_small")
        discard(star)
        discard(now)
        now = after
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    # every node now has one edge, to its component's least node
    leaves = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())


def least_labels(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the smallest id that the pairs (i, j) of rows reach, within one task.

    Rounds of hooking the greater root to the smaller and of pointing rows at their roots: about
    log(n) of them, whatever the shape of the links.
    """
    rank, up = np.argsort(np.argsort(ids, kind="stable"), kind="stable"), np.arange(len(ids))
    i, j = rank[i], rank[j]
    while len(i):
        a, b = up[i], up[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low < high
        if not open_.any():
            break
        i, j = i[open_], j[open_]
        np.minimum.at(up, high[open_], low[open_])
        while (jumped := up[up]).tobytes() != up.tobytes():
            up = jumped
    return np.sort(ids)[up[rank]]


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components over all edges (u, v) of one task, which LOCAL_EDGES bounds."""
    edges = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    u, v = (np.concatenate([e[k] for e in edges] or [np.zeros(0, np.int64)]) for k in range(2))
    nodes = np.unique(np.concatenate((u, v)))
    label = least_labels(np.searchsorted(nodes, u), np.searchsorted(nodes, v), nodes)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(label, pa.int64())], ["node", "component"])
