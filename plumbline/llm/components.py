"""Connected components of an edge table.

Tasks of at most TASK_EDGES edges each bring what they hold to stars; a table that fits one
task is done with that. Larger ones go on with alternating large-star and small-star joins,
which leave no task more than its share, whatever the largest component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch

#: Edges that one task links in memory (about 100 MB at work).
TASK_EDGES = 500_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if held:
        u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for at in range(0, len(u), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[at : at + 50_000]), pa.array(v[at : at + 50_000])], ["u", "v"])


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-large")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of these; edges have u > v."""
    least = scratch.store(edges.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small")
    linked = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none."""
    several = edges.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < high")
    chained = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi")
    return several.limit(1).count() == 0 and chained.limit(1).count() == 0


def components(edges: DataFrame, scratch: Scratch, name: str, task_edges: int = TASK_EDGES) -> DataFrame:
    """id and component (the smallest id reachable) of every node of edges (a, b long).

    Nothing but counts reaches the driver. Joins look up stored minima, one row a node, so
    that Spark can split the rows of a node with very many neighbours.
    """
    now = scratch.store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), f"{name}0")
    step, rows = 0, now.count()
    while True:
        tasks = max(1, math.ceil(rows / task_edges))
        step += 1
        now = scratch.store(now.repartition(tasks).mapInArrow(_starred, "u long, v long"), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        if tasks == 1:
            break
        step += 1
        large = scratch.store(_large_star(now, scratch, f"{name}{step}"), f"{name}{step}-both")
        now = scratch.store(_small_star(large, scratch, f"{name}{step}"), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}", *(f"{name}{step}-{k}" for k in ("large", "small", "both")))
        rows = now.count()
        if rows > task_edges and _all_stars(now):
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
