"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges that a task contracts at once; bounds its memory.
CHUNK = 1 << 19


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, root): the smallest node connected with each node by the given edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = np.minimum(new, root)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def contract(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: in each chunk of a partition, every node linked with its root there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            nodes, root = forest(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))
            keep = nodes != root
            return pa.RecordBatch.from_arrays([pa.array(root[keep]), pa.array(nodes[keep])], names=["a", "b"])

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in parts) >= CHUNK:
                yield flush(parts)
                parts = []
        if parts:
            yield flush(parts)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of the edges (a, b), both long, the smallest node that it reaches.

    Edges are contracted within partitions, then labels spread: each round takes the
    smallest label among a node's neighbours and jumps to that label's own label, and
    is written to the shared folder. Rounds end when no label changes. Self-links and
    repeated edges are allowed; no edges give no rows. Aggregation is partial before
    each shuffle, and the larger side of the label join is split by AQE, so a hub is no
    bottleneck.
    """
    edges = contract(edges.filter("a <> b"))
    edges = materialise(contract(edges.repartition(F.col("b"))).distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        told = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        own = labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        jumped = told.join(own, told.mid == own["__n"], "left").select("node", "old", F.least("mid", "__l").alias("label"))
        done = materialise(jumped, "labels")
        changed = done.filter("label <> old").limit(1).count()
        labels = done.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
