"""Connected components of an edge table, distributed: tasks join what their edges connect, and the edges between what is
left are contracted until a bounded task can hold them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomspec.llm.common import saved, ship, spread_join

#: Edges that a task joins at a time. An edge table that is larger is contracted across tasks first.
AT_ONCE = 1_000_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some edges, and the least node that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)  # labels are roots here
        while not np.array_equal(up := label[label], label):
            label = up
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[label]


def _forest(edges: DataFrame, tasks: int, at_once: int) -> DataFrame:
    """(node, low): for each block of edges its nodes, with the least one that the block connects them with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def stars() -> pa.RecordBatch:
            nodes, low = least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], names=["node", "low"])

        for batch in batches:
            for first in range(0, batch.num_rows, at_once):
                part = batch.slice(first, at_once)
                if size + part.num_rows > at_once:
                    yield stars()
                    held, size = [], 0
                held.append((part.column("a").to_numpy(), part.column("b").to_numpy()))
                size += part.num_rows
        if held:
            yield stars()

    return edges.select("a", "b").coalesce(tasks).mapInArrow(run, "node bigint, low bigint")


def _between(pairs: DataFrame) -> DataFrame:
    """The distinct edges (a, b), a < b, of different nodes."""
    return saved(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")


def _looked_up(rows: DataFrame, key: str, roots: DataFrame, value: str) -> DataFrame:
    """rows, with the node that roots, (node, root), has for their key, or the key itself; keys may be hot."""
    asked = rows.groupBy(F.col(key).alias("node")).agg(F.count("*").alias("w"))
    found = saved(asked.join(roots.hint("merge"), "node", "left").select(F.col("node").alias(key), F.coalesce("root", "node").alias(value), "w"), "asked")
    return spread_join(rows, found, [key], value, "w", F.xxhash64(*rows.columns), "merge")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that can be reached, for each node of an edge. Edges need no order; loops and repeats do no harm.

    While there are more edges than a task joins at once, tasks replace their blocks of edges by stars. Each node then hooks
    to the smallest that a star of its own names, hooks are followed to their roots, whose distances halve in each step, and
    the edges between roots are the next, smaller table: of two rounds each leaves half of the nodes at most. Nodes that very
    many rows ask for are broadcast, so no task gets all rows of a hub; nothing else is, for files of numbers are several
    times as large in the driver's memory as on disk.
    """
    ship(edges.sparkSession)
    left = _between(edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")))
    steps = []
    while (n := left.count()) > AT_ONCE:
        stars = saved(_forest(left, -(-n // AT_ONCE), AT_ONCE).where("node <> low"), "stars")
        roots = saved(stars.groupBy("node").agg(F.min("low").alias("root")), "roots")
        while True:
            changes = Observation()
            higher = _looked_up(roots.withColumnRenamed("root", "hook"), "hook", roots, "root")
            roots = saved(higher.observe(changes, F.count_if(F.col("hook") != F.col("root")).alias("n")).select("node", "root"), "roots")
            if not changes.get.get("n"):
                break
        steps.append(roots)
        ends = stars.join(roots.hint("merge"), "node").select(F.col("root").alias("a"), "low")
        left = _between(_looked_up(ends, "low", roots, "b").select("a", "b"))
    labels = saved(_forest(left, 1, AT_ONCE).withColumnRenamed("low", "component"), "labels")
    for roots in reversed(steps):
        names = labels.select("node", F.col("component").alias("root"))
        known = _looked_up(roots, "root", names, "component").select("node", "component")
        whole = roots.select(F.col("root").alias("node")).distinct().join(labels, "node", "left_anti")  # no edge leaves them
        labels = saved(known.unionByName(labels).unionByName(whole.withColumn("component", F.col("node"))), "labels")
    return labels


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, component) after more edges (a, b): only the edges between components are followed."""
    one, two = (labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    both = edges.select("a", "b").join(one, "a", "left").join(two, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = components(both.where("a <> b")).select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # nodes that no edge had yet
    return saved(old.unionByName(moved.select(F.col("component").alias("node"), F.col("to").alias("component")).join(labels.select("node"), "node", "left_anti")), "labels")
